"""Validation rules as tables of violations: rule, entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LABELS, LANGUAGES, RELEASE_COUNTS
from ..sources.shared import written


def violations(df: DataFrame, entity: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule that holds for a row, in one pass. Null is no violation."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return df.select(F.explode(broken).alias("rule"), F.col(entity).cast("string").alias("entity"))


def whole(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Rules on one row of aggregates: (name, violated, what is shown)."""
    found = [F.when(c, F.struct(F.lit(n).alias("rule"), shown.cast("string").alias("entity"))) for n, c, shown in rules]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Hashes that are sent to all tasks at most.
MANY = 100_000


def tallied(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by a hash of their key: __hash and k, how many rows have it, for hashes that come up again, and one row without a hash for all others. It says how many rows ``df`` has, too, so these are made once for both."""
    hashes = df.select(F.xxhash64(*columns).alias("__hash")).groupBy("__hash").agg(F.count("*").alias("k"))
    return written(hashes.groupBy(F.when(F.col("k") > 1, F.col("__hash")).alias("__hash")).agg(F.sum("k").alias("k")), "tally")


def repeated(df: DataFrame, *columns: str, tally: DataFrame | None = None) -> DataFrame:
    """One row, n: how many more rows than distinct keys. Of those only whose hash comes up again whole keys are compared, and none if there is no such hash."""
    again = (tallied(df, *columns) if tally is None else tally).filter("__hash is not null").select("__hash")
    found = again.limit(MANY + 1).count()
    if not found:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"))
    again = again if found > MANY else F.broadcast(again)
    hashed = df.select(*columns, F.xxhash64(*columns).alias("__hash"))
    return hashed.join(again, "__hash", "left_semi").groupBy(*columns).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))


def unique(df: DataFrame, rule: str, *columns: str, tally: DataFrame | None = None) -> DataFrame:
    return whole(repeated(df, *columns, tally=tally), [(rule, F.col("n") > 0, F.lit(None).cast("string"))])


def numbered(n: DataFrame, rule: str, expected: int) -> DataFrame:
    return whole(n, [(rule, F.col("n") != expected, F.col("n"))])


def counted(df: DataFrame, rule: str, expected: int) -> DataFrame:
    return numbered(df.agg(F.count("*").alias("n")), rule, expected)


def counted_and_unique(df: DataFrame, rows: str, expected: int, rule: str, *columns: str) -> DataFrame:
    """The rules on the number of rows and on a key, of one pass over the rows; those that share a hash are read again."""
    tally = tallied(df, *columns)
    return union([numbered(tally.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")), rows, expected), unique(df, rule, *columns, tally=tally)])


def differs(labels: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(labels)) != F.array(*[F.lit(x) for x in LABELS]), F.lit(True))


def manifest_violations(m: DataFrame, expected: dict = RELEASE_COUNTS) -> DataFrame:
    languages = m.sparkSession.createDataFrame([(x,) for x in LANGUAGES], "language string")
    counts = languages.join(m.groupBy("language").agg(F.count("*").alias("n")), "language", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = violations(m, "sample_id", [
        ("gold_label", F.coalesce(~F.col("gold_label").isin(*LABELS), F.lit(True))),
        ("asset_exists", ~F.coalesce("asset_exists", F.lit(False))),
        ("episode_images", F.col("is_episode") & (F.coalesce("num_images", F.lit(0)) < 1)),
        ("option_parse", ~F.col("option_parse_status").eqNullSafe("ok")),
        ("option_labels", differs(F.coalesce("option_order", F.array().cast("array<string>")))),
    ])
    return union([
        counted_and_unique(m, "manifest_rows", expected["manifest_rows"], "sample_id_unique", "sample_id"),
        unique(m, "parallel_language_unique", "parallel_id", "language"),
        violations(counts, "language", [("rows_per_language", F.col("n") != expected["rows_per_language"])]),
        rows,
    ])


def index_violations(index: DataFrame, expected: dict = RELEASE_COUNTS) -> DataFrame:
    distinct = F.array_sort(F.array_distinct("languages"))
    rows = violations(index, "parallel_id", [
        ("language_count", F.size("languages") != expected["languages_per_parallel_id"]),
        ("language_set", distinct != F.array(*[F.lit(x) for x in sorted(LANGUAGES)])),
        ("gold_labels_consistent", ~F.col("gold_labels_consistent")),
    ])
    return union([counted(index, "index_entries", expected["parallel_ids"]), rows])


def pair_violations(pairs: DataFrame, expected: dict = RELEASE_COUNTS) -> DataFrame:
    return counted_and_unique(pairs, "pair_rows", expected["directed_pairs"], "pair_id_unique", "pair_id")


def missing_images(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Images of inputs that aren't in ``existing`` (path)."""
    images = inputs.select("input_id", F.explode("image_paths").alias("path"))
    return images.join(existing.select("path").distinct(), "path", "left_anti").select(F.lit("image_exists").alias("rule"), F.concat_ws(": ", "input_id", "path").alias("entity"))


def canonical_violations(inputs: DataFrame, m: DataFrame, existing: DataFrame, expected: dict = RELEASE_COUNTS, gone: DataFrame | None = None) -> DataFrame:
    joined = looked_up(keyed(inputs, "sample_id"), sample_facts(m), {"s": "sample_id"}, gone_images(m, existing) if gone is None else gone)
    there = F.col("s").isNotNull()
    rows = input_violations(joined, there, "s", existing, [
        ("sample_missing", ~there),
        ("matched_language", there & ~F.col("question_language").eqNullSafe(F.col("gui_language"))),
        ("manifest_language", there & ~F.col("question_language").eqNullSafe(F.col("s.language"))),
        ("manifest_gold_label", there & ~F.col("gold_label").eqNullSafe(F.col("s.gold_label"))),
        ("num_images", there & (F.col("num_images") != F.size("image_paths"))),
    ])
    return union([counted_and_unique(inputs, "canonical_rows", expected["canonical_inputs"], "canonical_input_id_unique", "input_id"), rows])


FACTS = ("parallel_id", "dimension", "language", "gold_label", "image_paths")
#: What a mismatch input refers to: its question's, screen's and oracle's samples.
REFERENCES = {"q": "question_sample_id", "g": "gui_sample_id", "o": "oracle_sample_id"}


def sample_key(sample_id: Column) -> Column:
    """What sample_ids of one parallel_id have in common: all before the language."""
    return F.regexp_replace(sample_id, "::[^:]*$", "")


def of_key(sample_id: Column, key: Column) -> Column:
    """Whether ``key`` is the sample_id's :func:`sample_key`. An id that goes on after its key and "::" without a colon, as almost all do, needs no regular expression."""
    rest = F.substring(sample_id, F.length(key) + 3, F.length(sample_id))
    return F.when(sample_id.startswith(F.concat(key, F.lit("::"))), ~rest.contains(":")).otherwise(sample_key(sample_id).eqNullSafe(key))


def keyed(inputs: DataFrame, sample: str) -> DataFrame:
    """``inputs`` with the sample_key of the sample that they name, if they don't bring it."""
    return inputs if "sample_key" in inputs.columns else inputs.withColumn("sample_key", sample_key(F.col(sample)))


def sample_facts(m: DataFrame) -> DataFrame:
    """sample_key, sample_id and what inputs are compared with, of the manifest's rows, to be stored by sample_key. A manifest may bring its sample_key."""
    return keyed(m, "sample_id").select("sample_key", "sample_id", "qas_file", "qas_line", *[c for c in FACTS if c in m.columns])


def last_facts(facts: DataFrame) -> DataFrame:
    """f, the facts of the last row of each sample_id."""
    of = F.struct(*[c for c in FACTS if c in facts.columns])
    return facts.filter("sample_id is not null").groupBy("sample_key", "sample_id").agg(F.max_by(of, F.struct("qas_file", "qas_line")).alias("f"))


def gone_images(m: DataFrame, existing: DataFrame) -> DataFrame:
    """sample_key and gone (sample_id, path): the images of the key's samples that aren't in ``existing``. Inputs have the images of their samples as a rule, so these are looked for once, not for each input."""
    images = last_facts(sample_facts(m)).select("sample_key", "sample_id", F.explode("f.image_paths").alias("path"))
    missing = images.join(existing.select("path").distinct(), "path", "left_anti")
    return written(missing.groupBy("sample_key").agg(F.collect_list(F.struct("sample_id", "path")).alias("gone")), "gone")  # of as many samples as there are languages


def looked_up(inputs: DataFrame, facts: DataFrame, ids: dict[str, str] = REFERENCES, gone: DataFrame | None = None) -> DataFrame:
    """``inputs`` with the facts of the samples that the columns ``ids`` name, by default their question's, screen's and oracle's as q, g and o, null where there is no such sample; with ``gone`` each has a field gone, too.

    They have one sample_key as a rule, so one join by it finds them all, in a map of as many samples as there are languages; tables bucketed by sample_key need no shuffle for it. What refers to samples of several
    keys is looked up by sample_id: of the manifest nothing moves for it, but those inputs and what they name. Both have sample_key, of inputs that of the first sample.
    """
    by_key = last_facts(facts).groupBy("sample_key").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "f"))).alias("__of"))
    if gone is not None:
        lost = lambda k: F.transform(F.filter(F.coalesce("gone", F.array()), lambda x: x["sample_id"] == k), lambda x: x["path"])
        by_key = by_key.join(gone, "sample_key", "left").select("sample_key", F.transform_values("__of", lambda k, f: f.withField("gone", lost(k))).alias("__of"))
    near = reduce(lambda a, b: a & b, [of_key(F.col(c), F.col("sample_key")) for c in dict.fromkeys(ids.values())])
    far = written(inputs.filter(~near), "far")  # few as a rule: all inputs are asked once
    every = far.isEmpty()
    # what inline gives is made once a row; of a projection each filter above would look it up anew, for each time that it names it
    there = F.inline(F.array(F.struct(*[F.try_element_at("__of", F.col(c)).alias(k) for k, c in ids.items()])))
    found = (inputs if every else inputs.filter(near)).join(by_key, "sample_key", "left").select(*inputs.columns, there)
    if every:
        return found
    named = far.select(F.explode(F.array(*ids.values())).alias("__id")).filter("__id is not null").distinct().withColumn("sample_key", sample_key(F.col("__id")))
    there = named.join(by_key, "sample_key").select("__id", F.try_element_at("__of", F.col("__id")).alias("f"))
    for k, c in ids.items():
        far = far.join(there.select(F.col("__id").alias(f"__{k}"), F.col("f").alias(k)), F.col(c) == F.col(f"__{k}"), "left").drop(f"__{k}")
    return found.unionByName(far)


def input_violations(joined: DataFrame, there: Column, shown: str, existing: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rules that hold for inputs, and images that aren't there of inputs that are ``there``: ``gone`` of the sample that is ``shown``, if it has the same images, or else they are looked for one by one."""
    as_shown = F.col("image_paths").eqNullSafe(F.col(f"{shown}.image_paths"))
    told = lambda rule, entity: F.struct(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"))
    broken = F.array_compact(F.array(*[F.when(c, told(name, F.col("input_id"))) for name, c in rules]))
    lost = F.transform(F.when(there & as_shown, F.col(f"{shown}.gone")).otherwise(F.array()), lambda path: told("image_exists", F.concat_ws(": ", "input_id", path)))
    # most rows have neither, and only lists of those that have are made
    some = reduce(lambda a, b: a | b, [c for _, c in rules]) | (there & as_shown & (F.size(f"{shown}.gone") > 0))
    rows = joined.filter(some).select(F.explode(F.concat(broken, lost)).alias("x")).select("x.*")
    return union([rows, missing_images(joined.filter(there & ~as_shown).select("input_id", "image_paths"), existing)])


def mismatch_violations(inputs: DataFrame, m: DataFrame, existing: DataFrame, expected: dict = RELEASE_COUNTS, gone: DataFrame | None = None) -> DataFrame:
    joined = looked_up(keyed(inputs, "question_sample_id"), sample_facts(m), gone=gone_images(m, existing) if gone is None else gone)
    there = F.col("q").isNotNull() & F.col("g").isNotNull() & F.col("o").isNotNull()
    same = lambda c: F.col(f"q.{c}").eqNullSafe(F.col(f"g.{c}")) & F.col(f"g.{c}").eqNullSafe(F.col(f"o.{c}")) & F.col(f"o.{c}").eqNullSafe(F.col(c))
    rows = input_violations(joined, there, "g", existing, [
        ("languages_differ", F.col("question_language").eqNullSafe(F.col("gui_language"))),
        ("reference_missing", ~there),
        ("parallel_id_equal", there & ~same("parallel_id")),
        ("dimension_equal", there & ~same("dimension")),
        ("gold_label_equal", there & ~same("gold_label")),
        ("gui_image_paths", there & ~F.col("image_paths").eqNullSafe(F.col("g.image_paths"))),
        ("num_images", there & (F.col("num_images") != F.size("image_paths"))),
    ])
    return union([counted_and_unique(inputs, "mismatch_rows", expected["mismatch_inputs"], "mismatch_input_id_unique", "input_id"), rows])


def option_violations(m: DataFrame) -> DataFrame:
    """The first row of each parallel_id whose options aren't A to D."""
    bad = m.filter(differs(F.map_keys("options")))
    first = bad.groupBy("parallel_id").agg(F.min_by("sample_id", F.struct("qas_file", "qas_line")).alias("entity"))
    return first.select(F.lit("options").alias("rule"), "entity")


def option_order_warnings(m: DataFrame) -> DataFrame:
    """Parallel ids with several option orders: worth a look, no error."""
    orders = m.groupBy("parallel_id").agg(F.count_distinct(F.array_join("option_order", ",")).alias("orders"))
    return orders.filter("orders > 1")


#: What each rule's violation is told as; %s is the sample, input or value that it is about.
MESSAGES = {
    "sample_id_unique": "manifest: a sample_id occurs more than once", "parallel_language_unique": "manifest: a parallel_id occurs more than once in a language", "rows_per_language": "manifest: unexpected number of rows in language %s", "manifest_rows": "manifest: unexpected number of rows, %s",
    "gold_label": "%s: the gold label is none of A to D", "asset_exists": "%s: the asset isn't there", "episode_images": "%s: the episode has no images", "option_parse": "%s: the options can't be read", "option_labels": "%s: the options' labels aren't A to D",
    "index_entries": "parallel index: unexpected number of entries, %s", "language_count": "%s: not in as many languages as expected", "language_set": "%s: not in the expected languages", "gold_labels_consistent": "%s: gold labels differ between languages",
    "pair_id_unique": "pairs: a pair_id occurs more than once", "pair_rows": "pairs: unexpected number of rows, %s", "options": "%s: the options aren't A to D",
    "canonical_rows": "canonical inputs: unexpected number of rows, %s", "canonical_input_id_unique": "canonical inputs: an input_id occurs more than once", "sample_missing": "%s: its sample isn't in the manifest", "matched_language": "%s: question and screen differ in language", "manifest_language": "%s: its language isn't the manifest's", "manifest_gold_label": "%s: its gold label isn't the manifest's",
    "mismatch_rows": "mismatch inputs: unexpected number of rows, %s", "mismatch_input_id_unique": "mismatch inputs: an input_id occurs more than once", "languages_differ": "%s: question and screen are in one language", "reference_missing": "%s: a sample that it refers to isn't in the manifest", "parallel_id_equal": "%s: its samples differ in parallel_id", "dimension_equal": "%s: its samples differ in dimension", "gold_label_equal": "%s: its samples differ in gold label", "gui_image_paths": "%s: its images aren't those of its screen's sample",
    "num_images": "%s: num_images isn't the number of images", "image_exists": "image not found, %s",
}
ARTIFACTS = ("manifest", "index", "pairs", "options", "canonical", "mismatch")


def messages(parts: dict[str, DataFrame]) -> DataFrame:
    """artifact, rule, entity and message of all violations, and ``place``, which orders them: by artifact, rules on whole artifacts first, then by entity and rule."""
    rules = list(MESSAGES)
    told = F.create_map(*[F.lit(x) for r in rules for x in (r, MESSAGES[r])])[F.col("rule")]
    number = F.create_map(*[y for i, r in enumerate(rules) for y in (F.lit(r), F.lit(i))])[F.col("rule")]
    of_rows = told.startswith("%s") | told.startswith("image")
    found = union([df.withColumns({"artifact": F.lit(name), "__artifact": F.lit(ARTIFACTS.index(name))}) for name, df in parts.items()])
    message = F.replace(F.coalesce(told, F.col("rule")), F.lit("%s"), F.coalesce("entity", F.lit("")))
    place = F.struct(F.col("__artifact").alias("artifact"), of_rows.cast("int").alias("row"), F.when(of_rows, F.col("entity")).alias("entity"), number.alias("rule"))
    return found.select("artifact", "rule", "entity", message.alias("message"), place.alias("place"))


def release_violations(m: DataFrame, index: DataFrame, pairs: DataFrame, canonical: DataFrame | None = None, mismatch: DataFrame | None = None, existing: DataFrame | None = None, expected: dict = RELEASE_COUNTS) -> dict[str, DataFrame]:
    """The violations of each artifact of a release; inputs that aren't there aren't checked. ``existing`` (path): the images that are there."""
    parts = {"manifest": manifest_violations(m, expected), "index": index_violations(index, expected), "pairs": pair_violations(pairs, expected), "options": option_violations(m)}
    gone = gone_images(m, existing) if canonical is not None or mismatch is not None else None
    if canonical is not None:
        parts["canonical"] = canonical_violations(canonical, m, existing, expected, gone)
    if mismatch is not None:
        parts["mismatch"] = mismatch_violations(mismatch, m, existing, expected, gone)
    return parts


def counts_of(m: DataFrame, index: DataFrame, pairs: DataFrame, canonical: DataFrame | None = None, mismatch: DataFrame | None = None) -> DataFrame:
    """One row: how many rows each artifact has, null where it isn't there."""
    out = None
    for name, df in (("manifest_rows", m), ("parallel_ids", index), ("directed_mismatch_pairs", pairs), ("canonical_inputs", canonical), ("mismatch_inputs", mismatch)):
        one = m.sparkSession.range(1).select(F.lit(None).cast("long").alias(name)) if df is None else df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """What was checked, with the number of violations, and whether there was none at all."""
    counts = union([df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("artifact"), "violations") for name, df in parts.items()])
    total = counts.agg((F.coalesce(F.sum("violations"), F.lit(0)) == 0).alias("ok"))
    return counts.join(F.broadcast(total))
