"""Logs with commits, snapshots, digests, bucketed artifacts, streams with state."""

import re
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyscope import cli
from polyscope.operators import audit, models, retrieval, runs, validate
from polyscope.plans import catalogue, faults
from polyscope.sources import files, runlog, shared, snapshot, store
from polyscope.streaming import resume

SF = "/root/testdata/sf0.001"


def in_log(spark, path):
    return sorted(r.x for r in spark.read.schema("x long, note string").json(path).collect())


def test_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for first in (0, 100):
        runlog.append(spark.range(first, first + 100, 1, 3).select(F.col("id").alias("x"), F.lit(None).cast("string").alias("note")), path)
    assert in_log(spark, path) == list(range(200)) and '"note":null' in next(p for p in (tmp_path / "log").glob("part-*")).read_text()
    ledger = runlog.commits(spark, path)
    assert ledger.agg(F.sum("rows")).first()[0] == 200 and ledger.select("write").distinct().count() == 2 and ledger.filter("not complete").isEmpty()
    assert store.listed(f"{path}/_staged") == []
    runlog.append(spark.range(0).select(F.col("id").alias("x")), path)  # an empty run
    assert len(in_log(spark, path)) == 200
    with pytest.raises(PySparkException):
        spark.range(3).write.format("runlog").mode("append").save(path)


def test_log_keeps_what_was_answered(spark, tmp_path):
    """Tasks that end are in the log though the run fails, those that don't leave nothing, and the next run adds the rest."""
    path, done = str(tmp_path / "log"), str(tmp_path / "done")

    def slow_or_broken(batches):
        import time

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            yield batch
        if part == 1:
            while not os.path.exists(done):  # until the others are through
                time.sleep(0.05)
            time.sleep(2)
            raise RuntimeError("broken")
        if part == 3:
            open(done, "w").close()

    rows = spark.range(0, 400, 1, 4).withColumnRenamed("id", "x")
    with pytest.raises(Exception, match="broken"):
        runlog.append(rows.mapInArrow(slow_or_broken, "x long"), path)
    kept = in_log(spark, path)
    assert set(range(300, 400)) <= set(kept) and not set(range(100, 200)) & set(kept) and len(kept) == len(set(kept)) and len(kept) % 100 == 0
    runlog.append(rows.join(spark.createDataFrame([(x,) for x in kept], "x long"), "x", "left_anti"), path)
    assert in_log(spark, path) == list(range(400))
    assert {r.complete for r in runlog.commits(spark, path).collect()} == {False, True}


def test_log_after_a_lost_driver(spark, tmp_path):
    path = tmp_path / "log"
    staged = path / "_staged" / "w1"
    staged.mkdir(parents=True)
    for name, rows in {"00000-7.jsonl": [1, 2], "00001-8.jsonl": [3], "00001-9.jsonl": [3], "00002-10.jsonl.part": [4]}.items():
        (staged / name).write_text("".join(json.dumps({"x": x}) + "\n" for x in rows))
    assert runlog.recover(str(path)) == 1 and in_log(spark, str(path)) == [1, 2, 3]  # two attempts of one task count once, half a file not at all
    assert runlog.recover(str(path)) == 0
    # the driver was lost between its commit and the moves
    again = path / "_staged" / "w2"
    again.mkdir(parents=True)
    (again / "00000-1.jsonl").write_text('{"x": 9}\n')
    store.write_whole(f"{path}/_commits/w2.json", json.dumps({"write": "w2", "complete": True, "files": [{"partition": 0, "file": "00000-1.jsonl", "rows": 1}]}).encode())
    assert runlog.recover(str(path)) == 1 and in_log(spark, str(path)) == [1, 2, 3, 9]


def test_results_carry_their_rows(spark):
    """Repeated and null ids have a result each."""
    rows = [("a", "q1", ["x"], "A"), ("a", "q2", [], "B"), (None, "q3", ["x", "y"], None)]
    inputs = spark.createDataFrame(rows, "input_id string, question_raw string, image_paths array<string>, gold_label string").withColumns({"sample_id": F.lit("s"), "parallel_id": F.lit("p"), "question_language": F.lit("en"), "dimension": F.lit("wf"), "num_images": F.size("image_paths")})
    got = runs.answered(inputs, models.loader({"adapter": "fixed_label", "label": "B"}), "r", {"model_id": "m"}).collect()
    assert [(r.input_id, r.num_images, r.image_paths, r.normalized_correct, r.status) for r in got] == [("a", 1, ["x"], False, "success"), ("a", 0, [], True, "success"), (None, 2, ["x", "y"], False, "success")]
    plan = runs.answered(inputs, models.loader({"adapter": "fixed_label"}), "r", {"model_id": "m"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    def fails(row):
        if row["question_raw"] == "q2":
            raise ValueError("no")
        return {"raw_output": "A"}

    assert [(r.status, r.error_type, r.parsed_label) for r in runs.answered(inputs, lambda: fails, "r", {"model_id": "m"}).collect()] == [("success", None, "A"), ("failed", "ValueError", None), ("success", None, "A")]


def mirror(root, names):
    for name, raw in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)


FILES = {"1/en/a.jpg": b"a" * 10, "1/en/b.jpg": random.Random(1).randbytes(3 * store.PIECE + 5), "rich/ep/frame_1.png": b"", "README.md": b"license: mit\n", "secret/x": b"no"}


def test_snapshot(spark, tmp_path, capsys):
    root, lock = tmp_path / "mirror", str(tmp_path / "lock.json")
    mirror(root, FILES)
    snapshot.write_lock(spark, str(root), lock, "rev1")
    assert {f["path"]: f["sha256"] for f in json.loads(open(lock).read())["files"]} == {k: hashlib.sha256(v).hexdigest() for k, v in FILES.items()}
    got = snapshot.read(spark, str(root), lock, "1/**,rich/**,*.md")
    rows = got.groupBy("path", "size", "revision").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("c")).collect()
    assert {r.path: b"".join(bytes(c.content) for c in r.c) for r in rows} == {k: v for k, v in FILES.items() if k != "secret/x"} and {r.revision for r in rows} == {"rev1"}
    assert [r.path for r in snapshot.read(spark, str(root), lock, "1/*").select("path").distinct().collect()] == []  # one star is one name
    # filters reach the reader: a file that isn't asked for isn't opened
    (root / "1/en/a.jpg").write_bytes(b"changed")
    assert snapshot.read(spark, str(root), lock).filter((F.col("path") == "README.md") & (F.col("size") > 1)).count() == 1
    with pytest.raises(Exception, match="isn't the file that the lock names"):
        got.count()
    (root / "1/en/a.jpg").write_bytes(FILES["1/en/a.jpg"])
    out = tmp_path / "out"
    assert cli.main(["download", "--root", str(out), "--mirror", str(root), "--lock", lock, "--allow", "1/**,README.md"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"files": 3, "bytes": sum(len(FILES[x]) for x in ("1/en/a.jpg", "1/en/b.jpg", "README.md"))}
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and p.name != "SOURCE.json"} == {k: FILES[k] for k in ("1/en/a.jpg", "1/en/b.jpg", "README.md")}
    assert json.loads((out / "SOURCE.json").read_text())["revision"] == "rev1"
    assert cli.main(["download", "--root", str(out)], spark) == 1


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)  # takes no space
        f.seek(size - 1)
        f.write(b"x")
    zero, sha = bytes(1 << 20), hashlib.sha256()
    for _ in range((size - 1) // len(zero)):
        sha.update(zero)
    sha.update(zero[: (size - 1) % len(zero)] + b"x")
    (tmp_path / "small.bin").write_bytes(b"abc")
    got = {r.file: (r.size, r.sha256) for r in files.file_digests(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {"large.bin": (size, sha.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}


def test_percentiles_among_far_outliers(spark):
    """A million different small values and one of 10**15; the longs' ends too."""
    small = spark.range(1_000_000).select(F.col("id").alias("a"))
    df = small.unionAll(spark.createDataFrame([(10**15,)], "a long"))
    r = runs.percentiles(df, ["a"]).first()
    assert (r.min, r.p50, r.p90, r.p95, r.p99, r.max) == (0, 500_000, 900_000, 950_000, 990_000, 10**15)
    ends = [-(1 << 63), -5, -5, 7, (1 << 63) - 1]
    r = runs.percentiles(spark.createDataFrame([(x,) for x in ends], "a long"), ["a"]).first()
    assert (r.min, r.p50, r.p99, r.max) == (ends[0], -5, ends[-1], ends[-1])
    assert runs.percentiles(df.limit(0), ["a"]).isEmpty()


def test_nearest_in_one_bucket(spark):
    """One bucket, blocks far smaller than it, ties and vectors of length 0."""
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.integers(-2, 3, (230, 4)).astype(float)] + [[0.0] * 4] * 3
    rows = [(f"s{i:03d}", "one", v) for i, v in enumerate(vectors)]
    m = spark.createDataFrame(rows, "sample_id string, layer string, key array<double>")
    got = sorted((r.query_id, r["rank"], r.sample_id, r.cosine) for r in retrieval.cosine_topk(m.filter("sample_id < 's050' or sample_id = 's231'"), m, 4, block=16).collect())

    def cosine(x, y):
        add = lambda v, w: float(np.add.accumulate(np.array(v) * np.array(w))[-1])
        n = np.sqrt(add(x, x)) * np.sqrt(add(y, y))
        return add(x, y) / n if n else 0.0

    expected = []
    for name, _, v in rows[:50] + [rows[231]]:
        near = sorted((-cosine(v, w), other) for other, _, w in rows if other != name)[:4]
        expected += [(name, i, other, -c) for i, (c, other) in enumerate(near, 1)]
    assert got == sorted(expected)


def test_memory(spark):
    rows = [(f"s{i}", i % 2, [float(i), 1.0]) for i in range(40)] + [("odd", 0, [1.0]), ("null", 0, [None, 2.0]), ("none", 0, None)]
    m = spark.createDataFrame(rows, "sample_id string, layer int, key array<double>")
    order = lambda layer: sorted((hashlib.md5(f"memory|{s}".encode()).hexdigest(), s) for s, x, _ in rows if x == layer)[:10]
    assert {(r.layer, r.sample_id) for r in retrieval.sampled(m, "layer").collect()} == {(x, s) for x in (0, 1) for _, s in order(x)}
    assert {(r.layer, r.entries, tuple(r["mean"])) for r in retrieval.mean_vectors(m, "layer", 2).collect()} == {(0, 20, (19.0, 1.0)), (1, 20, (20.0, 1.0))}


def test_lookups_without_exchange(spark):
    rows = [(f"p{i}::{x}", f"p{i}", "wf", "A", [f"{i}{x}"], "f", i) for i in range(50) for x in ("en", "zh")]
    m = spark.createDataFrame(rows, "sample_id string, parallel_id string, dimension string, gold_label string, image_paths array<string>, qas_file string, qas_line int")
    inputs = m.select(F.concat(F.lit("i"), "sample_id").alias("input_id"), F.col("sample_id").alias("question_sample_id"), F.regexp_replace("sample_id", "en$", "zh").alias("gui_sample_id"), F.col("sample_id").alias("oracle_sample_id"))
    inputs = inputs.withColumn("sample_key", validate.sample_key(F.col("question_sample_id")))
    by_key = [shared.bucketed(df, "t", "sample_key", 4) for df in (inputs, validate.sample_facts(m))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = validate.looked_up(*by_key)
        got = found.select("input_id", "q.gold_label", F.col("g.image_paths")[0].alias("image")).collect()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 100 and {r.image for r in got} == {f"{i}zh" for i in range(50)}
    # samples of other keys, and none, are found by their ids
    odd = spark.createDataFrame([("a", "p1::en", "p2::zh", "p1::en", "p1"), ("b", "p1::en", "gone::zh", None, "p1"), ("c", None, None, None, None)], "input_id string, question_sample_id string, gui_sample_id string, oracle_sample_id string, sample_key string")
    got = {r.input_id: (r.q and r.q.parallel_id, r.g and r.g.parallel_id, r.o and r.o.parallel_id) for r in validate.looked_up(odd, validate.sample_facts(m)).collect()}
    assert got == {"a": ("p1", "p2", "p1"), "b": ("p1", None, None), "c": (None, None, None)}


def test_every_rule_is_broken(spark):
    """The fixture breaks each rule, so that each is in the query's rows."""
    rules = {r.rule for r in catalogue.QUERIES["violations_seeded"](spark, SF).select("rule").distinct().collect()}
    assert rules == set(validate.MESSAGES) - {"options"} and set(faults.FAULTS) == {"manifest", "index", "pairs", "canonical", "mismatch"}


def test_levels(spark):
    rows = [("wf", "s1", "en", "a"), ("wf", "s1", "zh", "a"), ("wf", "s1", "zh", "a"), ("wf", "s2", "en", "a"), ("unknown", "s3", "en", "a"), ("wi", "s4", "xx", "a"), ("wi", "s5", "en", "")]
    got = audit.levels(spark.createDataFrame(rows, "dimension string, state_key string, language string, asset string")).collect()
    of = lambda level, *columns: {tuple(r[c] for c in columns) for r in got if r.level == level}
    assert of("language", "language", "rows") == {("en", 4), ("zh", 2), (None, 1)} and of("dimension", "dimension", "rows") == {("wf", 4), ("wi", 2), (None, 1)}
    assert of("coverage", "dimension", "languages", "states") == {("wf", 2, 1), ("wf", 1, 1)}
    assert of("language_dimension", "language", "dimension", "rows") == {("en", "wf", 2), ("zh", "wf", 2), ("en", None, 1), (None, "wi", 1), ("en", "wi", 1)}


def test_reports_from_levels(spark):
    """What the audit takes from one scan is what each count by itself gives."""
    m = catalogue.fx.stored_manifest(spark, SF)
    levels = audit.levels(m).cache()
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(audit.rows_of(levels, "language", audit.LANGUAGES)) == rows(audit.rows_by_language(m)) and rows(audit.rows_of(levels, "dimension", audit.DIMENSIONS)) == rows(audit.rows_by_dimension(m))
    assert rows(audit.matrix_of(levels)) == rows(audit.language_dimension_matrix(m)) and rows(audit.coverage_of(levels)) == rows(audit.coverage_by_dimension(m))
    assert rows(levels.filter("level = 'coverage'").select("dimension", "languages", "states")) == rows(audit.coverage_histogram(m))


def test_configurations(tmp_path, capsys, spark):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("model_id: m\ngeneration:\n  max_new_tokens: 8\n  top_p: null\n")
    (tmp_path / "a.json").write_text('{"model_id": "m", "generation": {"max_new_tokens": 8, "top_p": null}}')
    assert files.load_config(str(tmp_path / "a.yaml")) == files.load_config(str(tmp_path / "a.json")) == {"model_id": "m", "generation": {"max_new_tokens": 8, "top_p": None}}
    assert cli.main(["generate"], spark) == 1


def test_attempts_with_state(spark, tmp_path):
    """An input is tried until it succeeds; a later batch knows."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    load = lambda: lambda row: {"status": "success" if row["good"] else "failed"}
    for rows in ([(1, "a", False), (2, "a", False), (3, "b", True), (4, "b", True)], [(5, "a", True), (6, "a", True), (7, "b", False), (8, None, False)], [(9, "a", False), (10, "c", True), (11, None, True)]):
        spark.createDataFrame(rows, "n long, input_id string, good boolean").write.mode("append").parquet(source)
        stream = spark.readStream.schema("n long, input_id string, good boolean").parquet(source)
        resume.attempt_stream(stream, load, "n", "status string", out, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r.n, r.input_id, r.status) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a", "failed"), (2, "a", "failed"), (3, "b", "success"), (5, "a", "success"), (8, None, "failed"), (10, "c", "success"), (11, None, "success")]


def test_tokenizer_counts(spark):
    """A tokenizer's file counts what it encodes, and images by their sizes."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [("a", "Which one? A: x B: y", ["p.png", "q.png"]), ("b", "", []), ("c", "naïve 中文", ["lost.png"])]
    inputs = spark.createDataFrame(rows, "input_id string, question_raw string, image_paths array<string>").withColumns({"sample_id": F.lit("s"), "parallel_id": F.lit("p"), "question_language": F.lit("en"), "dimension": F.lit("wf"), "num_images": F.size("image_paths")})
    images = spark.createDataFrame([("p.png", 57, 28, "d"), ("q.png", 28, 28, "e")], "path string, width int, height int, sha256 string")
    got = runs.preflight_records(inputs, models.loader({"adapter": "tokenizer_file", "tokenizer_file": path}, models.PROCESSORS), {}, "mpr_minimal_v1", images).collect()
    tokens = {name: len(Tokenizer.from_file(path).encode(q, add_special_tokens=False).ids) for name, q, _ in rows}
    assert {(r.input_id, r.text_tokens, r.visual_grid_tokens, r.total_sequence_length) for r in got} == {("a", tokens["a"], 4, tokens["a"] + 4), ("b", tokens["b"], None, tokens["b"]), ("c", tokens["c"], None, tokens["c"])}


def test_summaries_replace_their_partitions(spark, tmp_path):
    rows = [("r1", "a", 1, "wf", "success", "A", True), ("r1", "a", 2, "wf", "success", "B", False), ("r1", "a", 3, "wf", "failed", None, None), ("r1", "b", 1, "wi", "success", None, False), ("r2", "a", 1, "wf", "success", "C", True)]
    kinds = "run_id string, input_id string, n int, dimension string, status string, parsed_label string, normalized_correct boolean"
    results = lambda x: spark.createDataFrame(x, kinds).withColumns({"raw_string_exact": F.lit(False), "invalid": F.col("parsed_label").isNull()})
    path = str(tmp_path / "s")
    runs.write_summaries(runs.summarised(results(rows), "n"), path)
    runs.write_summaries(runs.summarised(results([("r1", "a", 4, "wf", "success", "A", True)]), "n"), path)
    got = {(r.run_id, r.dimension): (r.rows, r.normalized_accuracy, r.n_a, r.n_b, r.n_c, r.n_invalid) for r in spark.read.parquet(path).collect()}
    assert got == {("r1", "wf"): (1, 1.0, 1, 0, 0, 0), ("r1", "wi"): (1, 0.0, 0, 0, 0, 1), ("r2", "wf"): (1, 1.0, 0, 0, 1, 0)}


def test_image_paths_are_looked_up_where_they_lie(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"1")
    rows = [(str(tmp_path / "a" / "x.png"),), (str(tmp_path / "a"),), (str(tmp_path / "gone.png"),), ("no/such/folder/y.png",)]
    paths = spark.createDataFrame(rows, "path string").withColumn("at", F.col("path"))
    assert {r.path for r in store.existing(paths).collect()} == {rows[0][0], rows[1][0]}


def test_inputs_are_judged_where_they_are_made(spark):
    """Inputs are made of one parallel_id and refer to its samples: of what is judged only paths, and images that aren't there, move."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["violations_mismatch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"hashpartitioning\((\w+)#", plan)
    # by sample_key only what is gone, once for each of the two scans of the inputs
    assert moved.count("sample_key") == 2 and "path" in moved


@pytest.mark.parametrize("many", [0, 100_000])
def test_repeated_keys(spark, monkeypatch, many):
    """Nulls are values of a key; only equal keys count as repeated, however many hashes come up again."""
    monkeypatch.setattr(validate, "MANY", many)
    rows = [("a", None), ("a", None), (None, "a"), ("a", "b"), ("a", "b"), ("a", "b"), (None, None), ("c", "d")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert validate.repeated(df, "x", "y").first().n == 3 and validate.repeated(df.filter("x = 'c'"), "x", "y").first().n == 0


def test_images_that_are_not_those_of_the_sample(spark):
    """Images are looked for whether they are the sample's or not, null ones too; each that isn't there is told once for each time that it is named."""
    m = spark.createDataFrame([(f"p::{x}", "p", "wf", x, "A", [f"{x}1", f"{x}2", None], "f", i) for i, x in enumerate(("en", "zh"))], "sample_id string, parallel_id string, dimension string, language string, gold_label string, image_paths array<string>, qas_file string, qas_line int")
    existing = spark.createDataFrame([("en1",), ("zh2",), ("there",)], "path string")
    inputs = [("own", "p::zh", ["zh1", "zh2", None]), ("other", "p::zh", ["there", "lost", "lost", None]), ("none", "p::zh", None), ("far", "gone::zh", ["lost"])]
    rows = [(i, "p", "p::en", g, "p::en", "en", "zh", "wf", "A", images, len(images or [])) for i, g, images in inputs]
    df = spark.createDataFrame(rows, "input_id string, parallel_id string, question_sample_id string, gui_sample_id string, oracle_sample_id string, question_language string, gui_language string, dimension string, gold_label string, image_paths array<string>, num_images int")
    found = sorted((r.rule, r.entity) for r in validate.mismatch_violations(df, m, existing, {"mismatch_inputs": 4}).collect())
    assert found == sorted([("image_exists", "own: zh1"), ("image_exists", "own"), ("image_exists", "other: lost"), ("image_exists", "other: lost"), ("image_exists", "other"), ("gui_image_paths", "other"), ("gui_image_paths", "none"), ("reference_missing", "far")])


def test_done_ids_are_not_broadcast(spark):
    """What is done may be as much as all inputs: no task holds the whole of it."""
    planned = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "input_id string")
    log = spark.createDataFrame([("a", "success"), ("b", "failed"), ("a", "success")], "input_id string, status string")
    left = runs.pending(planned, log)
    assert {r.input_id for r in left.collect()} == {"b", "c", None}
    assert tuple(runs.dry_run(planned, log).first()) == (4, 3)
    dealt = runs.pending(planned, log, 3)
    assert {r.input_id for r in dealt.collect()} == {"b", "c", None} and dealt.rdd.getNumPartitions() == 3
    for df in (left, dealt, runs.dry_run(planned, log)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_buckets_grow_with_the_manifest(spark, monkeypatch):
    """A bucket holds a bounded number of rows, however many partitions the session has."""
    monkeypatch.setattr(catalogue, "ROWS_OF_BUCKET", 100, raising=False)
    m = catalogue.by_parallel_id(spark, SF)
    # a bucket is one file
    assert len(m.inputFiles()) == -(-m.count() // 100) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_distinct_keys_are_read_once(spark):
    """Where no hash comes up again there are no keys to compare."""
    none = validate.repeated(spark.range(10), "id")
    assert none.first().n == 0 and none.schema["n"].dataType.simpleString() == "bigint"
    assert "Join" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_odd_ids(spark):
    """Whether an id is of a key is what its sample_key says, with colons, lines and nulls anywhere."""
    ids = ["a::en", "a::b::en", "a:::en", "a::", "a", "::en", "", "a::e:n", "a::e\nn", "a::en\n", "a\n::en", "a::::", ":", None]
    df = spark.createDataFrame([(i, k) for i in ids for k in ["a", "a::b", "a:", "", "a\n", "a::", "b", "a::e:n", None]], "id string, key string")
    both = df.select(validate.of_key(F.col("id"), F.col("key")).alias("x"), validate.sample_key(F.col("id")).eqNullSafe(F.col("key")).alias("y"))
    assert both.filter("not x <=> y").count() == 0 and both.filter("x").count() > 9


def test_inputs_of_several_keys_are_found_once(spark):
    """Inputs that refer to samples of several keys are picked in one pass, and what refers to none else is read once more."""
    m = spark.createDataFrame([(f"p{i}::en", f"p{i}", "wf", "A", [f"{i}"], "f", i) for i in range(4)], "sample_id string, parallel_id string, dimension string, gold_label string, image_paths array<string>, qas_file string, qas_line int")
    inputs = spark.range(4).selectExpr("concat('i', id) as input_id", "concat('p', id, '::en') as question_sample_id", "if(id = 2, 'p3::en', concat('p', id, '::en')) as gui_sample_id", "concat('p', id, '::en') as oracle_sample_id", "concat('p', id) as sample_key")
    found = validate.looked_up(inputs, validate.sample_facts(m))
    assert {(r.input_id, r.q.parallel_id, r.g.parallel_id) for r in found.collect()} == {("i0", "p0", "p0"), ("i1", "p1", "p1"), ("i2", "p2", "p3"), ("i3", "p3", "p3")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_faults_are_made_once_a_row(spark):
    """A filter on faulty rows reads their values; it doesn't make them anew, for each time that it names them."""
    rows = spark.range(2).selectExpr("concat('a_', id + 33, '.jpg::q=en::gui=zh') as input_id", "'p::zh' as gui_sample_id", "'zh' as gui_language", "*", *[f"'{c}' as {c}" for c in ("parallel_id", "dimension", "gold_label", "oracle_sample_id", "sample_key")], "array('x') as image_paths", "1 as num_images")
    bad = faults.faulty(rows, "mismatch").filter("gui_sample_id = 'gone' or gui_language = 'en'")
    assert {(r.input_id[:4], r.gui_sample_id, r.gui_language) for r in bad.collect()} == {("a_33", "p::zh", "en"), ("a_34", "gone", "zh")}
    filters = [x for x in bad._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in x]
    assert len(filters) == 1 and "CASE" not in filters[0] and "substring" not in filters[0]


def test_rows_are_counted_where_keys_are(spark, monkeypatch):
    """Of rows without repeated keys the number comes with their keys, from one pass; of repeated ones, too, it is that of all rows."""
    asked = []
    monkeypatch.setattr(validate, "written", lambda df, what: asked.append(what) or shared.written(df, what))
    rows = spark.range(7).selectExpr("if(id < 3, 'a', concat('p', id)) as pair_id")
    few = validate.pair_violations(rows.filter("pair_id <> 'a'"), {"directed_pairs": 5})
    assert [tuple(r) for r in few.collect()] == [("pair_rows", "4")] and asked == ["tally"]
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # the row that stands for no repeated key
    assert sorted(map(tuple, validate.pair_violations(rows, {"directed_pairs": 5}).collect()), key=str) == [("pair_id_unique", None), ("pair_rows", "7")]
    assert [tuple(r) for r in validate.pair_violations(rows.limit(0), {"directed_pairs": 1}).collect()] == [("pair_rows", "0")]
