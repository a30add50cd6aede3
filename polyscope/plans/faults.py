"""Artifacts with a fault for each rule, the same in both engines: some values are replaced, and some rows come twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate


def ends(column: str, suffix: str) -> str:
    return f"right({column}, {len(suffix)}) = '{suffix}'"


#: By artifact: the rows that come twice, and (column, rows, value, the value in DuckDB's words where they differ).
FAULTS: dict[str, tuple[str, list[tuple[str, str, str, str | None]]]] = {
    "manifest": (ends("sample_id", "_9.jpg::en"), [
        ("gold_label", ends("sample_id", "_10.jpg::zh"), "nullif('x', 'x')", None),
        ("asset_exists", ends("sample_id", "_11.jpg::fr"), "false", None),
        ("num_images", ends("sample_id", "ep_14::ru"), "0", None),
        ("option_parse_status", ends("sample_id", "_12.jpg::ja"), "'failed_empty_option'", None),
        ("option_order", ends("sample_id", "_13.jpg::th"), "array('A', 'B', 'C')", "['A', 'B', 'C']"),
    ]),
    "index": (ends("parallel_id", "_18.jpg"), [
        ("languages", ends("parallel_id", "ep_15"), "slice(languages, 1, 5)", "languages[1:5]"),
        ("languages", ends("parallel_id", "_16.jpg"), "array_append(slice(languages, 1, 5), 'xx')", "list_append(languages[1:5], 'xx')"),
        ("gold_labels_consistent", ends("parallel_id", "_17.jpg"), "false", None),
    ]),
    "pairs": (ends("pair_id", "_9.jpg::q=en::gui=zh"), []),
    "canonical": (ends("input_id", "_19.jpg::en"), [
        ("sample_id", ends("input_id", "_20.jpg::en"), "'gone'", None),
        ("gui_language", ends("input_id", "_25.jpg::en"), "'xx'", None),
        ("question_language", ends("input_id", "_26.jpg::en"), "'xx'", None),
        ("gui_language", ends("input_id", "_26.jpg::en"), "'xx'", None),
        ("gold_label", ends("input_id", "_27.jpg::en"), "'Z'", None),
        ("num_images", ends("input_id", "_28.jpg::en"), "99", None),
    ]),
    "mismatch": (ends("input_id", "_29.jpg::q=en::gui=zh"), [
        ("gui_language", ends("input_id", "_33.jpg::q=en::gui=zh"), "'en'", None),
        ("gui_sample_id", ends("input_id", "_34.jpg::q=en::gui=zh"), "'gone'", None),
        ("parallel_id", ends("input_id", "_35.jpg::q=en::gui=zh"), "'other'", None),
        ("dimension", ends("input_id", "_36.jpg::q=en::gui=zh"), "'xx'", None),
        ("gold_label", ends("input_id", "_41.jpg::q=en::gui=zh"), "'Z'", None),
        ("image_paths", ends("input_id", "_42.jpg::q=en::gui=zh"), "array('other.jpg')", "['other.jpg']"),
        ("num_images", ends("input_id", "_43.jpg::q=en::gui=zh"), "99", None),
        ("oracle_sample_id", ends("input_id", "_44.jpg::q=en::gui=zh"), "'gone::x::en'", None),
    ]),
}


#: By artifact: the columns that rules read.
READ: dict[str, tuple[str, ...]] = {
    "manifest": ("sample_id", "parallel_id", "language", "gold_label", "asset_exists", "is_episode", "num_images", "option_parse_status", "option_order"),
    "index": ("parallel_id", "languages", "gold_labels_consistent"),
    "pairs": ("pair_id",),
    "canonical": ("sample_key", "input_id", "sample_id", "question_language", "gui_language", "gold_label", "image_paths", "num_images"),
    "mismatch": ("sample_key", "input_id", "parallel_id", "question_sample_id", "gui_sample_id", "oracle_sample_id", "question_language", "gui_language", "dimension", "gold_label", "image_paths", "num_images"),
}


def faulty(df: DataFrame, artifact: str) -> DataFrame:
    twice, faults = FAULTS[artifact]
    df = reduce(lambda d, f: d.withColumn(f[0], F.expr(f"case when {f[1]} then {f[2]} else {f[0]} end")), faults, df.select(*[c for c in READ[artifact] if c in df.columns]))
    # one scan gives both copies, and rows stay where they are; faults are made once a row, not again in each filter on them
    keys = [c for c in df.columns if c == "sample_key"]  # that by which rows lie where they do stays a column of its own
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.select(*keys, F.inline(F.when(F.expr(twice), F.array(row, row)).otherwise(F.array(row))))


def faulty_sql(artifact: str, source: str) -> str:
    """The same, as relations of DuckDB: ``f_`` and the artifact's name."""
    twice, faults = FAULTS[artifact]
    steps = [f"f_{artifact}_0 as ({source})"]
    for i, (column, rows, value, duck) in enumerate(faults):
        steps.append(f"f_{artifact}_{i + 1} as (select * replace (case when {rows} then {duck or value} else {column} end as {column}) from f_{artifact}_{i})")
    last = f"f_{artifact}_{len(faults)}"
    return ", ".join([*steps, f"f_{artifact} as (select * from {last} union all select * from {last} where {twice})"])


def violations(m: DataFrame, index: DataFrame, pairs: DataFrame, canonical: DataFrame, mismatch: DataFrame, existing: DataFrame, expected: dict) -> DataFrame:
    """artifact, rule, entity; inputs are compared with the manifest as it is without faults."""
    gone = validate.gone_images(m, existing)
    parts = {
        "manifest": validate.manifest_violations(faulty(m, "manifest"), expected), "index": validate.index_violations(faulty(index, "index"), expected), "pairs": validate.pair_violations(faulty(pairs, "pairs"), expected),
        "canonical": validate.canonical_violations(faulty(canonical, "canonical"), m, existing, expected, gone), "mismatch": validate.mismatch_violations(faulty(mismatch, "mismatch"), m, existing, expected, gone),
    }
    return validate.union([df.select(F.lit(name).alias("artifact"), "rule", "entity") for name, df in parts.items()])


def rules_sql(expected: dict) -> str:
    """Each rule by itself, over the relations of :func:`faulty_sql`, the manifest m and ex, the images that are there."""
    def rows(artifact: str, n: int, rule: str) -> str:
        return f"select '{artifact}' as artifact, '{rule}' as rule, n::varchar as entity from (select count(*) as n from f_{artifact}) where n <> {n}"

    def unique(artifact: str, rule: str, by: str) -> str:
        return f"select '{artifact}', '{rule}', null from (select 1 from f_{artifact} group by {by} having count(*) > 1 limit 1)"

    def each(artifact: str, entity: str, source: str, rules: dict[str, str]) -> list[str]:
        return [f"select '{artifact}', '{rule}', {entity} from {source} where {wrong}" for rule, wrong in rules.items()]

    six = "['en', 'fr', 'ja', 'ru', 'th', 'zh']"
    there = "q.sample_id is not null and g.sample_id is not null and r.sample_id is not null"
    of = "f_mismatch f left join m q on q.sample_id = f.question_sample_id left join m g on g.sample_id = f.gui_sample_id left join m r on r.sample_id = f.oracle_sample_id"
    differs = lambda c: f"{there} and (f.{c} is distinct from q.{c} or q.{c} is distinct from g.{c} or g.{c} is distinct from r.{c})"
    parts = [
        rows("manifest", expected["manifest_rows"], "manifest_rows"), unique("manifest", "sample_id_unique", "sample_id"), unique("manifest", "parallel_language_unique", "parallel_id, language"),
        f"select 'manifest', 'rows_per_language', l.language from (select unnest(['en', 'zh', 'fr', 'ru', 'ja', 'th']) as language) l left join f_manifest f on f.language = l.language group by l.language having count(f.language) <> {expected['rows_per_language']}",
        *each("manifest", "sample_id", "f_manifest", {"gold_label": "gold_label is null", "asset_exists": "not asset_exists", "episode_images": "is_episode and num_images < 1", "option_parse": "option_parse_status <> 'ok'", "option_labels": "list_sort(list_distinct(option_order)) <> ['A', 'B', 'C', 'D']"}),
        rows("index", expected["parallel_ids"], "index_entries"),
        *each("index", "parallel_id", "f_index", {"language_count": "len(languages) <> 6", "language_set": f"list_sort(list_distinct(languages)) <> {six}", "gold_labels_consistent": "not gold_labels_consistent"}),
        rows("pairs", expected["directed_pairs"], "pair_rows"), unique("pairs", "pair_id_unique", "pair_id"),
        rows("canonical", expected["canonical_inputs"], "canonical_rows"), unique("canonical", "canonical_input_id_unique", "input_id"),
        *each("canonical", "f.input_id", "f_canonical f left join m s on s.sample_id = f.sample_id", {
            "sample_missing": "s.sample_id is null", "matched_language": "s.sample_id is not null and f.question_language <> f.gui_language", "manifest_language": "s.sample_id is not null and f.question_language <> s.language",
            "manifest_gold_label": "s.sample_id is not null and f.gold_label is distinct from s.gold_label", "num_images": "s.sample_id is not null and f.num_images <> len(f.image_paths)"}),
        "select 'canonical', 'image_exists', input_id || ': ' || path from (select f.input_id, unnest(f.image_paths) as path from f_canonical f join m s on s.sample_id = f.sample_id) where path not in (select path from ex)",
        rows("mismatch", expected["mismatch_inputs"], "mismatch_rows"), unique("mismatch", "mismatch_input_id_unique", "input_id"),
        *each("mismatch", "f.input_id", of, {
            "languages_differ": "f.question_language = f.gui_language", "reference_missing": f"not ({there})", "parallel_id_equal": differs("parallel_id"), "dimension_equal": differs("dimension"), "gold_label_equal": differs("gold_label"),
            "gui_image_paths": f"{there} and f.image_paths <> g.images", "num_images": f"{there} and f.num_images <> len(f.image_paths)"}),
        f"select 'mismatch', 'image_exists', input_id || ': ' || path from (select f.input_id, unnest(f.image_paths) as path from {of} where {there}) where path not in (select path from ex)",
    ]
    return " union all ".join(parts)
