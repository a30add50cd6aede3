import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from polyscope.functions.constants import LANGUAGES
from polyscope.operators import audit, manifest, retrieval, runs, validate
from polyscope.sources import files, report
from polyscope.streaming.resume import resume_stream

QA = "qas_file string, qas_line int, question string, answer string, asset string, is_episode boolean"
Q = "Q? A: a B: b C: c D: d"


@pytest.fixture(scope="module")
def rows(spark):
    out = [(f"wf_{x}.jsonl", 1, Q, "A" if x != "th" else "x", f"../images/1/{x}/home_{x}_1.png", False) for x in LANGUAGES]
    out += [("knowledge_rich_en.jsonl", 1, Q, "B. yes", "../images/rich/en/ep_en_1", True), ("knowledge_rich_ja.jsonl", 1, Q, "B", "../images/rich/ja/ep_ja_1", True), ("wi_en.jsonl", 3, Q, None, "", False)]
    qa = spark.createDataFrame(out, QA)
    listing = spark.createDataFrame([(f"1/{x}/home_{x}_1.png",) for x in LANGUAGES] + [("rich/en/ep_en_1/frame_10.png",), ("rich/en/ep_en_1/frame_2.png",), ("rich/en/ep_en_1/note.txt",)], "path string")
    return manifest.build_manifest(qa, listing).cache()


def test_manifest(rows):
    got = {r.sample_id: r for r in rows.collect()}
    assert len(got) == 9
    e = got["ri::rich/ep_1::en"]
    assert e.image_paths == ["data/images/rich/en/ep_en_1/frame_2.png", "data/images/rich/en/ep_en_1/frame_10.png"] and e.asset_exists and e.gold_label == "B"
    missing = got["ri::rich/ep_1::ja"]
    assert missing.image_paths == ["data/images/rich/ja/ep_ja_1"] and missing.frame_order == "natural_sort" and not missing.asset_exists
    none = got["wi::.::en"]
    assert none.image_paths == [] and none.asset_path == "" and none.gold_label is None


def test_index_and_pairs(rows):
    index = {r.parallel_id: r for r in manifest.parallel_index(rows).collect()}
    wf = index["wf::1/home_1.png"]
    assert wf.complete and not wf.gold_labels_consistent and wf.samples["en"].sample_id == "wf::1/home_1.png::en"
    assert not index["ri::rich/ep_1"].complete
    assert manifest.cross_locale_pairs(rows).count() == 30
    assert manifest.canonical_inputs(rows).count() == 9
    with pytest.raises(Exception, match="no row in each language"):
        manifest.mismatch_inputs(rows).count()
    two = rows.filter("dimension = 'wf' and language in ('en', 'ja')")
    assert sorted(r.gui_language for r in manifest.mismatch_inputs(two).collect()) == ["en", "ja"]
    assert manifest.cross_locale_pairs(two).count() == 0


def test_last_row_wins(spark):
    qa = spark.createDataFrame([("wf_en.jsonl", 1, Q, "A", "a.png", False), ("wf_en.jsonl", 2, Q, "B", "a.png", False)], QA)
    m = manifest.build_manifest(qa, spark.createDataFrame([], "path string"))
    assert manifest.parallel_index(m).first().gold_labels == {"en": "B"}
    found = {r.rule for r in validate.manifest_violations(m).collect()}
    assert {"sample_id_unique", "parallel_language_unique", "manifest_rows", "rows_per_language", "asset_exists"} <= found


def test_violations(rows):
    m = rows.filter("dimension = 'wf'")
    expected = {"manifest_rows": 6, "rows_per_language": 1, "parallel_ids": 1, "languages_per_parallel_id": 6, "directed_pairs": 30, "canonical_inputs": 6, "mismatch_inputs": 30}
    existing = m.select(F.explode("image_paths").alias("path"))
    got = lambda df: sorted((r.rule, r.entity) for r in df.collect())
    assert got(validate.manifest_violations(m, expected)) == [("gold_label", "wf::1/home_1.png::th")]
    assert got(validate.index_violations(manifest.parallel_index(m), expected)) == [("gold_labels_consistent", "wf::1/home_1.png")]
    inputs = manifest.canonical_inputs(m)
    assert got(validate.canonical_violations(inputs, m, existing, expected)) == []
    bad = inputs.withColumns({"gold_label": F.when(F.col("gui_language") == "en", "Z").otherwise(F.col("gold_label")), "sample_id": F.when(F.col("gui_language") == "fr", "none").otherwise(F.col("sample_id"))})
    assert got(validate.canonical_violations(bad, m, existing.limit(0), expected)) == sorted([("manifest_gold_label", "canonical::wf::1/home_1.png::en"), ("sample_missing", "canonical::wf::1/home_1.png::fr")] + [("image_exists", f"canonical::wf::1/home_1.png::{x}: data/images/1/{x}/home_{x}_1.png") for x in LANGUAGES if x != "fr"])
    mis = manifest.mismatch_inputs(m)
    found = got(validate.mismatch_violations(mis, m, existing, expected))
    assert {r for r, _ in found} == {"gold_label_equal"} and len(found) == 10
    s = validate.summary({"canonical": validate.canonical_violations(inputs, m, existing, expected)}).first()
    assert s.ok and s.violations == 0


def test_audit(rows):
    assert {r.language: r.rows for r in audit.rows_by_language(rows).collect()} == {"en": 3, "zh": 1, "fr": 1, "ru": 1, "ja": 2, "th": 1}
    assert audit.rows_by_dimension(rows).filter("dimension = 'si'").first().rows == 0
    assert [(r.frames, r.first_frame, r.last_frame) for r in audit.episode_rows(rows).collect()] == [(2, "frame_2.png", "frame_10.png")]
    assert audit.malformed_answers(rows).count() == 2 and audit.non_label_only_answers(rows).count() == 1
    assert "Parallel coverage" in report.audit_markdown(rows, "mit")


def test_filter_resume_and_dry_run(spark):
    rows = spark.createDataFrame([(0, "en", "wf"), (1, "ja", "wf"), (2, "en", "ri")], "n int, question_language string, dimension string")
    pick = lambda *a: [r.n for r in runs.filter_rows(rows, ["n"], *a).orderBy("n").collect()]
    assert pick({"en"}, {"wf", "ri"}, 1) == [0] and pick(set(), None, 0) == [0] and pick() == [0, 1, 2]
    log = spark.createDataFrame([("a", "success"), ("b", "failed")], "input_id string, status string")
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "input_id string")
    assert sorted(r.input_id for r in runs.pending(planned, log).collect()) == ["b", "c"]
    assert tuple(runs.dry_run(planned, log).first()) == (3, 2)


def test_metrics(spark):
    acc = spark.createDataFrame([("wf", 1.0), ("ri", 0.0), ("si", 1.0)], "dimension string, accuracy double")
    assert abs(runs.weighted_accuracy(acc).first()[0] - 2 / 3) < 1e-12
    assert runs.weighted_accuracy(acc.limit(0)).first()[0] == 0
    with pytest.raises(Exception, match="no weight"):
        runs.weighted_accuracy(acc.withColumn("dimension", F.lit("zz"))).collect()
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, None, 10)], "v int")
    r = runs.percentiles(df, ["v"]).first()
    assert (r.min, r.p50, r.p90, r.p95, r.p99, r.max) == (1, 3, 10, 10, 10, 10)


def test_model_runs(spark, rows):
    def load():
        def model(row):
            if row["language"] == "th":
                raise ValueError("no")
            return {"raw_output": "A", "rendered_prompt": row["prompt"]}

        return model

    inputs = manifest.canonical_inputs(rows).filter("dimension = 'wf'").withColumn("language", F.col("gui_language")).drop("options")
    got = {r.language: r for r in runs.run_model(inputs, load, "mpr_label_only_v1", {"run_id": F.lit("r")}).collect()}
    assert got["en"].normalized_correct and got["en"].raw_string_exact and got["en"].run_id == "r"
    assert got["th"].status == "failed" and got["th"].error_type == "ValueError" and got["th"].normalized_correct is None


def test_topk(spark):
    m = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.1]), ("c", 1, [0.0, 1.0]), ("d", 2, [1.0, 0.0])], "sample_id string, layer int, key array<double>")
    assert [(r.sample_id, r["rank"]) for r in retrieval.cosine_topk(m.filter("sample_id = 'a'"), m, 1).collect()] == [("b", 1)]


def test_files(spark, tmp_path):
    d = tmp_path / "qas"
    d.mkdir()
    (d / "wf_en.jsonl").write_bytes(('{"question": "q", "answer": null, "image_path": "a.png"}\r\n\r\n' + json.dumps({"question": "x", "answer": "B", "image_folder_path": "f"}) + "\n" + '{"answer": "C", "image_path": null}').encode())
    got = manifest.row_asset(files.read_question_files(spark, str(d / "*.jsonl"))).orderBy("qas_line").collect()
    assert [(r.qas_line, r.question, r.answer, r.asset, r.is_episode) for r in got] == [(1, "q", "None", "a.png", False), (3, "x", "B", "f", True), (4, "", "C", "None", False)]
    assert {r.path for r in files.list_files(spark, str(tmp_path)).collect()} == {"qas/wf_en.jsonl"}
    assert len(files.file_digests(spark, str(d / "*")).first().sha256) == 64
    (tmp_path / "README.md").write_text("# x\nlicense: mit \n")
    assert files.license_line(spark, str(tmp_path / "README.md")) == "mit"


def test_resume_stream(spark, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    for part, stored in (([1, 2, 2], 2), ([2, 3], 3), ([], 3)):
        if part:
            spark.createDataFrame([(str(x),) for x in part], "input_id string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("input_id string").parquet(src)
        resume_stream(spark, stream, log, ck, lambda df: df.withColumn("status", F.lit("success"))).awaitTermination()
        assert spark.read.parquet(log).count() == stored


def test_queries_match_sql(spark):
    """Every query against its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from polyscope.plans.catalogue import QUERIES, SQL

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    key = lambda rows: sorted(tuple(str(v) if not isinstance(v, float) else f"{v:.5g}" for v in r) for r in rows)

    def run(name):
        got = QUERIES[name](spark, str(sf))
        names = sorted(got.columns)
        return name, names, got.select(*names).collect()

    with ThreadPoolExecutor(4) as pool:  # most of their time is planning
        for name, names, got in pool.map(run, QUERIES):
            sql = SQL[name].replace("/root/testdata/sf0.01/", f"{sf}/")  # files are named by constant paths
            want = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
            assert key(got) == key(want), name


def test_frames_of_wanted_folders(spark):
    """Folders of single pictures aren't gathered for the manifest."""
    listing = spark.createDataFrame([("ep/frame_10.jpg",), ("ep/frame_9.jpg",), ("ep/x.txt",), ("1/en/a.jpg",), ("1/en/b.jpg",)], "path string")
    wanted = spark.createDataFrame([("ep",), ("ep",), ("gone",), (None,)], "folder string")
    assert [tuple(r) for r in manifest.episode_frames(listing, wanted).collect()] == [("ep", ["frame_9.jpg", "frame_10.jpg"])]
    assert manifest.episode_frames(listing).count() == 2


def test_mismatch_inputs_hold_no_pairs_of_rows(spark):
    """What a pair doesn't ask for of its two rows isn't copied for it."""
    rows = [(f"p::{x}", "p", x, "wf", "A", "A", [f"{x}.jpg"], 1, "single_image", "f", i) for i, x in enumerate(LANGUAGES[:3])]
    m = spark.createDataFrame(rows, "sample_id string, parallel_id string, language string, dimension string, answer_raw string, gold_label string, image_paths array<string>, num_images int, frame_order string, qas_file string, qas_line int")
    made = manifest.mismatch_inputs(m)
    assert "lambda" not in made.select("input_id")._jdf.queryExecution().optimizedPlan().toString().partition("Generate")[0] and "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.question_sample_id, r.gui_sample_id, r.image_paths) for r in made.collect()] == [(f"p::{q}", f"p::{g}", [f"{g}.jpg"]) for q in LANGUAGES[:3] for g in LANGUAGES[:3] if q != g]
