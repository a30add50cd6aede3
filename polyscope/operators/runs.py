"""Runs of a model over inputs: planning, resuming, results and their metrics."""

from __future__ import annotations

import importlib.metadata
import platform
import subprocess
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import DIMENSION_WEIGHTS, LABELS
from ..sources.shared import written
from .models import PACKAGES


def filter_rows(rows: DataFrame, order: list[str], languages: set[str] | None = None, dimensions: set[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows in the languages and dimensions given (none or an empty set: all), and of those the first, at least one where there is a limit."""
    if languages:
        rows = rows.filter(F.col("question_language").isin(*languages))
    if dimensions:
        rows = rows.filter(F.col("dimension").isin(*dimensions))
    return rows.orderBy(*order).limit(max(limit, 1)) if limit is not None else rows


def sliced(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows, of which 0 are none; a negative limit is an error."""
    if limit is None:
        return rows
    if limit < 0:
        raise ValueError("a limit can't be negative")
    return rows.orderBy(*order).limit(limit)


def done_ids(log: DataFrame) -> DataFrame:
    """Ids with a successful row: input_id, or sample_id where that is empty. They are as many as inputs, so joins merge them: a task never holds all of them, as it would if they were broadcast."""
    sample = F.col("sample_id") if "sample_id" in log.columns else F.lit(None)
    return log.filter("status = 'success'").select(F.coalesce(F.when(F.col("input_id") != "", F.col("input_id")), sample, F.lit("None")).alias("input_id")).distinct().hint("merge")


def pending(planned: DataFrame, log: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows whose input isn't done, compared in ``parts`` tasks where that is given."""
    done = done_ids(log)
    if parts:
        planned, done = planned.repartition(parts, "input_id"), done.repartition(parts, "input_id").hint("merge")
    return planned.join(done, "input_id", "left_anti")


def dry_run(planned: DataFrame, log: DataFrame) -> DataFrame:
    done = done_ids(log).withColumn("done", F.lit(True)).hint("merge")
    return planned.join(done, "input_id", "left").agg(F.count("*").alias("planned_rows"), F.count_if(F.col("done").isNull()).alias("pending_rows"))


#: Rows that a model answers before they are passed on.
AT_A_TIME = 64
RUN_SCHEMA = "rendered_prompt string, prompt_token_count int, output_token_count int, raw_output string, latency_ms int, status string, error_type string, error_message string"


def code_commit() -> str | None:
    """The commit of the code that runs, if there is one: looked up once for a run."""
    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False) if _has("git") else None
    return found.stdout.strip() or None if found else None


def _has(program: str) -> bool:
    import shutil

    return shutil.which(program) is not None


def software_versions(packages: tuple[str, ...] = PACKAGES) -> dict[str, str | None]:
    """Versions of Python, the platform and the packages that results depend on; null where one isn't installed."""

    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {"python": platform.python_version(), "platform": f"{sys.platform}-{platform.machine()}", **{p: version(p) for p in packages}}


def base_columns(columns: list[str], run_id: str, config: dict, lock: dict | None = None, profile: str | None = None, commit: str | None = None, versions: dict[str, str | None] | None = None) -> list[Column]:
    """What every row of a run's results says about where it comes from: the run, code, data, model and input. ``columns``: those of the inputs."""
    lock, null = lock or {}, F.lit(None).cast("string")
    text_of = lambda x: null if x is None else F.lit(str(x))
    software = F.create_map(*[y for k, v in (versions or {}).items() for y in (F.lit(k), text_of(v))]) if versions else F.create_map().cast("map<string,string>")
    raw = F.coalesce("answer_raw", "gold_label") if "answer_raw" in columns else F.col("gold_label")
    return [
        F.lit(run_id).alias("run_id"), text_of(commit).alias("code_commit"), text_of(lock.get("huggingface", {}).get("sha")).alias("dataset_hf_revision"), text_of(lock.get("github", {}).get("commit")).alias("dataset_github_revision"),
        text_of(config.get("model_id")).alias("model_id"), text_of(config.get("revision")).alias("model_revision"), text_of(config.get("revision")).alias("processor_revision"), F.lit("transformers").alias("backend"), software.alias("software_versions"),
        F.lit(profile or config.get("prompt_profile", "mpr_minimal_v1")).alias("prompt_profile"), F.lit(config.get("processor_profile", "qwen_default")).alias("processor_profile"),
        *[F.col(c) for c in ("input_id", "sample_id", "parallel_id")], F.col("question_language").alias("language"), *[F.col(c) for c in ("dimension", "image_paths", "num_images", "gold_label")], raw.alias("gold_raw"),
    ]


def result_base(inputs: DataFrame, *of_run, **more) -> DataFrame:
    """The columns of :func:`base_columns` for inputs."""
    return inputs.select(*base_columns(inputs.columns, *of_run, **more))


RESULT = "rendered_prompt string, prompt_token_count int, output_token_count int, raw_output string, parsed_label string, parse_success boolean, raw_string_exact boolean, normalized_correct boolean, invalid boolean, latency_ms int, status string, error_type string, error_message string"


#: What of an input its result row needs.
INPUT = ("input_id", "sample_id", "parallel_id", "question_language", "dimension", "image_paths", "num_images", "gold_label", "question_raw", "answer_raw")


def answered(inputs: DataFrame, load: Callable[[], Callable[[dict], dict]], run_id: str, config: dict, lock: dict | None = None, profile: str | None = None, commit: str | None = None, versions: dict[str, str | None] | None = None) -> DataFrame:
    """The result rows of a model over inputs, in full: :func:`base_columns` and what came of each. A row goes through the model as it is, so each input, whatever its id, has one result."""
    profile = profile or config.get("prompt_profile", "mpr_minimal_v1")
    got = run_model(inputs.select(*[c for c in INPUT if c in inputs.columns]), load, profile, {})
    base = base_columns(got.columns, run_id, config, lock, profile, commit, versions)
    return got.select(*base, *[c.split()[0] for c in RESULT.split(", ")])


def dry_run_row(planned: DataFrame, log: DataFrame, run_id: str, config: dict, profile: str) -> DataFrame:
    """The one row that a dry run leaves in the log."""
    counts = dry_run(planned, log)
    return counts.select(F.lit(run_id).alias("run_id"), F.lit("dry_run").alias("status"), "planned_rows", "pending_rows", F.lit(profile).alias("prompt_profile"), F.lit(str(config["model_id"])).alias("model_id"))


PREFLIGHT = "text_tokens long, total_sequence_length long, visual_grid_tokens long"
PREFLIGHT_FIELDS = ("num_images", "text_tokens", "total_sequence_length", "visual_grid_tokens")


def preflight_records(inputs: DataFrame, load: Callable[[], Callable[[dict], dict]], config: dict, profile: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """What each input will take of a model's context. ``load`` makes the processor once for each worker; ``images``: path, width, height, sha256."""
    profile = profile or config.get("prompt_profile", "mpr_minimal_v1")
    info = "array<struct<path:string,width:int,height:int,sha256:string>>"
    rows = inputs.select("input_id", "sample_id", "parallel_id", F.col("question_language").alias("language"), "dimension", "num_images", "image_paths", text.prompt_text(F.col("question_raw"), F.lit(profile)).alias("prompt"))
    if images is None:
        rows = rows.withColumn("image_info", F.array().cast(info))
    else:
        # equal lists of images are looked up once, whatever their inputs are called
        each = rows.select("image_paths").distinct().select("image_paths", F.posexplode("image_paths").alias("at", "path")).join(images.select("path", "width", "height", "sha256").dropDuplicates(["path"]), "path", "left")
        known = each.groupBy("image_paths").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path", "width", "height", "sha256"))), lambda x: F.struct(x["path"].alias("path"), x["width"].alias("width"), x["height"].alias("height"), x["sha256"].alias("sha256"))).alias("image_info"))
        rows = rows.join(known, "image_paths", "left").withColumn("image_info", F.coalesce("image_info", F.array().cast(info)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    counted = ("text_tokens", "total_sequence_length", "visual_grid_tokens")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = load()
        for batch in batches:
            got = [process(row) for row in batch.to_pylist()]
            yield pa.record_batch([*batch.columns, *[pa.array([x.get(c) for x in got], pa.int64()) for c in counted]], names=[*batch.schema.names, *counted])

    out = rows.mapInArrow(measure, f"{kinds}, {PREFLIGHT}").drop("prompt", "image_paths")
    return out.withColumns({"prompt_profile": F.lit(profile), "processor_profile": F.lit(config.get("processor_profile", "qwen_default"))})


def run_model(inputs: DataFrame, load: Callable[[], Callable[[dict], dict]], profile: str, base: dict[str, Column]) -> DataFrame:
    """Results of a model over inputs, a batch at a time. ``load`` makes the model once for each worker; an error fails its own row only."""
    made = {"rendered_prompt": pa.string(), "prompt_token_count": pa.int32(), "output_token_count": pa.int32(), "raw_output": pa.string(), "latency_ms": pa.int32(), "status": pa.string(), "error_type": pa.string(), "error_message": pa.string()}
    rows = inputs.withColumns({**base, "prompt": text.prompt_text(F.col("question_raw"), F.lit(profile)), "prompt_profile": F.lit(profile)})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        model = load()
        for whole in batches:
            for first in range(0, whole.num_rows, AT_A_TIME):
                batch, out = whole.slice(first, AT_A_TIME), []
                for row in batch.to_pylist():
                    began = time.perf_counter()
                    try:
                        got = {"status": "success", **model(row)}
                    except Exception as e:  # noqa: BLE001  whatever a model raises is recorded
                        got = {"status": "failed", "error_type": type(e).__name__, "error_message": str(e)}
                    out.append({**got, "latency_ms": int((time.perf_counter() - began) * 1000)})
                yield pa.record_batch([*batch.columns, *[pa.array([x.get(c) for x in out], t) for c, t in made.items()]], names=[*batch.schema.names, *made])

    return scored(rows.mapInArrow(run, f"{kinds}, {RUN_SCHEMA}"))


def scored(results: DataFrame) -> DataFrame:
    """parsed_label, parse_success, invalid, normalized_correct and raw_string_exact of raw outputs. Two nulls are equal: a row without gold label and parsed label is correct."""
    good = F.col("status") == "success"
    label = text.parse_label(F.col("raw_output"))
    gold_raw = F.coalesce("answer_raw", "gold_label") if "answer_raw" in results.columns else F.col("gold_label")
    return results.withColumns({
        "parsed_label": F.when(good, label),
        "parse_success": F.when(good, label.isNotNull()),
        "invalid": F.when(good, label.isNull()),
        "normalized_correct": F.when(good, label.eqNullSafe(F.col("gold_label"))),
        "raw_string_exact": F.when(good, text.exact_match(F.col("raw_output"), F.coalesce(gold_raw, F.lit("None")))),
    })


def latest_success(results: DataFrame, order: str, *by: str) -> DataFrame:
    """Of each input's successful rows the last (of each run's, with ``by`` run_id)."""
    row = F.struct(*results.columns)
    return results.filter("status = 'success'").groupBy(*by, "input_id").agg(F.max_by(row, order).alias("r")).select("r.*")


SUMMARY = ("run_id", "dimension")


def summarised(results: DataFrame, order: str) -> DataFrame:
    """The metrics of each run and dimension, over each input's last successful row of the run: rows, normalized_accuracy, exact_match, and how many answers name each label or none."""
    last = latest_success(results, order, "run_id")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    counts = [F.count_if(F.col("parsed_label").eqNullSafe(F.lit(x))).alias(f"n_{x.lower()}") for x in LABELS]
    return last.groupBy(*SUMMARY).agg(F.count("*").alias("rows"), share("normalized_correct").alias("normalized_accuracy"), share("raw_string_exact").alias("exact_match"), *counts, F.count_if("invalid").alias("n_invalid"))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Puts summaries in the place of those of the same run and dimension; others stay as they are."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SUMMARY).parquet(path)


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Share of correct rows; 0 without rows where there is no grouping."""
    share = F.coalesce(F.avg(F.col("normalized_correct").cast("int")), F.lit(0.0)).alias("accuracy")
    good = results.filter("status = 'success'")
    return good.groupBy(*by).agg(share, F.count("*").alias("rows"))


def weight_of(dimension: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for d, w in (weights or DIMENSION_WEIGHTS).items():
        out = out.when(dimension == d, F.lit(float(w)))
    return out


def weighted_accuracy(by_dimension: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Over the dimensions present; one without a weight is an error."""
    w = weight_of(F.col("dimension"), weights)
    checked = by_dimension.filter(F.assert_true(w.isNotNull(), F.concat(F.lit("no weight for dimension "), F.coalesce("dimension", F.lit("null")))).isNull())
    return checked.agg(F.coalesce(F.sum(w * F.col("accuracy")) / F.sum(w), F.lit(0.0)).alias("weighted_accuracy"))


def label_distribution(results: DataFrame, column: str = "parsed_label") -> DataFrame:
    return results.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


#: Ranges that an interval of values is dealt into in a round of :func:`selected`.
RANGES = 4096


def selected(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """field, i and v: of each field's values (field, v; longs, read more than once) in order the one at index i. ``ranks``: field, i, low and high, a few rows; values lie from low to high.

    Each round counts the values of the intervals where ranks lie in ``RANGES`` ranges of equal width and goes on with the range that holds the rank, so 64 bits take six rounds at most, however the values
    are spread, and no task gets more than counts of ranges.
    """
    spark = values.sparkSession
    kind = "field string, i long, low long, high long, before long"
    known = [(r.field, r.i, r.low, r.high, 0) for r in ranks.collect()]
    while any(low < high for _, _, low, high, _ in known):
        open_ = {(f, low, high) for f, _, low, high, _ in known if low < high}
        # decimals, as an interval may be as wide as all longs
        asked = spark.createDataFrame([(f, low, high, Decimal(-(-(high - low + 1) // RANGES))) for f, low, high in sorted(open_)], "field string, low long, high long, width decimal(20,0)")
        part = F.expr("cast((cast(v as decimal(20,0)) - cast(low as decimal(20,0))) div width as int)")
        counts = values.join(F.broadcast(asked), "field").filter("v between low and high").groupBy("field", "low", "high", part.alias("part")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("field", "low", "high").orderBy("part"))
        placed = counts.withColumn("upto", upto)  # at most RANGES rows an interval
        now = spark.createDataFrame(known, kind)
        at = F.col("i") - F.col("before")
        found = now.join(placed, ["field", "low", "high"]).filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select("field", "i", "low", "high", "part", (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
        narrower = {}
        for r in found.collect():
            width = -(-(r.high - r.low + 1) // RANGES)
            narrower[r.field, r.i] = (r.low + r.part * width, min(r.high, r.low + (r.part + 1) * width - 1), r.before)
        known = [(f, i, *narrower.get((f, i), (low, high, before))) for f, i, low, high, before in known]
    return spark.createDataFrame([(f, i, low) for f, i, low, _, _ in known], "field string, i long, v long")


def percentiles(df: DataFrame, fields: list[str], percents: tuple[int, ...] = (90, 95, 99)) -> DataFrame:
    """field, min, p50, p90 .. max of integer columns, of each in one row (null without values): exact, by :func:`selected`."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("v")) for f in fields])).alias("x")).select("x.*").filter("v is not null")
    values = written(values, "values")
    total = written(values.groupBy("field").agg(F.count("*").alias("total"), F.min("v").alias("min"), F.max("v").alias("max")), "totals")
    last = F.col("total") - 1
    at = {"m0": F.floor(last / 2), "m1": F.ceil(last / 2), **{f"p{p}": F.rint(F.lit(p / 100.0) * last) for p in percents}}
    ranks = total.select("field", F.col("min").alias("low"), F.col("max").alias("high"), F.explode(F.array_distinct(F.array(*[c.cast("long") for c in at.values()]))).alias("i"))
    found = selected(values, ranks).groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("of"))  # a few ranks a field
    value = lambda c: F.col("of")[c.cast("long")]
    half = (value(at["m0"]) + value(at["m1"])) / 2
    truncated = F.when(half < 0, F.ceil(half)).otherwise(F.floor(half)).cast("long").alias("p50")
    return total.join(F.broadcast(found), "field").select("field", "min", truncated, *[value(at[f"p{p}"]).alias(f"p{p}") for p in percents], "max")


def option_permutations(manifest: DataFrame, seed: int = 20260705, count: int = 5) -> DataFrame:
    """Permuted orders of labels, reproducible from the seed: labels in order of a digest."""
    perm = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("permutation")
    rows = manifest.select("sample_id", "gold_label", perm)
    key = lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("sample_id"), x)).alias("k"), x.alias("l"))
    order = F.transform(F.array_sort(F.array(*[key(F.lit(x)) for x in "ABCD"])), lambda s: s["l"])
    place = F.array_position(order, F.col("gold_label"))
    return rows.select("sample_id", "permutation", F.array_join(order, ",").alias("label_order"), F.when(place > 0, F.substring(F.lit("ABCD"), place.cast("int"), F.lit(1))).alias("new_gold_label"))
