"""Commands over files: download, audit, build, validate, release (the three before), run and preflight.

    python -m polyscope build --root data/raw --out data/manifests/manifest.jsonl ...

Artifacts are directories or files of JSON Lines, the parallel index included; reports are single documents. A command that finds
something wrong prints it and exits with 1.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.constants import LANGUAGES
from .operators import audit, manifest, models, runs, validate
from .sources import files, report, runlog, snapshot, store
from .sources.shared import written

DATA = "data/manifests"


def session() -> SparkSession:
    return SparkSession.builder.appName("polyscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def images_root(root: str) -> str:
    return f"{root.rstrip('/')}/images"


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a release: question files in ``root``/qas and images below ``root``/images."""
    rows = manifest.row_asset(files.read_question_files(spark, f"{root}/qas/*.jsonl"))
    return manifest.build_manifest(rows, files.list_files(spark, images_root(root)), images_root(root))


def read(spark: SparkSession, path: str) -> DataFrame:
    """An artifact, with options as a map and lists of strings where it has none to show what they are."""
    df = spark.read.json(path)
    if "options" in df.columns and df.schema["options"].dataType.typeName() == "struct":
        names = df.schema["options"].dataType.names
        pairs = F.array_compact(F.array(*[F.when(F.col("options")[n].isNotNull(), F.struct(F.lit(n).alias("key"), F.col("options")[n].alias("value"))) for n in names]))
        df = df.withColumn("options", F.map_from_entries(pairs))
    return df


def there(path: str | None) -> bool:
    return bool(path) and Path(path).exists()


def build(args: argparse.Namespace, spark: SparkSession) -> int:
    m = manifest_of(spark, args.root).persist()
    index = manifest.parallel_index(m)
    for df, path in ((m, args.out), (index, args.parallel_out), (manifest.cross_locale_pairs(m), args.pairs_out), (manifest.canonical_inputs(m), args.canonical_inputs_out), (manifest.mismatch_inputs(m), args.mismatch_inputs_out)):
        files.write_json_lines(df, path)
    print(json.dumps(manifest.index_summary(index).first().asDict(), indent=2))
    m.unpersist()
    return 0


def audit_release(args: argparse.Namespace, spark: SparkSession) -> int:
    m = manifest_of(spark, args.root).persist()
    readme = Path(args.root, "README.md")
    license_name = files.license_line(spark, str(readme)) if readme.exists() else None
    levels = audit.levels(m).persist()  # some dozens of rows
    found = {
        "rows": m.count(), "license": license_name, "missing_assets": audit.missing_assets(m).count(), "malformed_answers": audit.malformed_answers(m).count(), "non_label_only_answers": audit.non_label_only_answers(m).count(),
        "rows_by_language": {r.language: r.rows for r in audit.rows_of(levels, "language", LANGUAGES).collect()}, "rows_by_dimension": {r.dimension: r.rows for r in audit.rows_of(levels, "dimension", audit.DIMENSIONS).collect()},
        "option_parse_status": {r.option_parse_status: r.rows for r in audit.option_status_counts(m).collect()}, "files": [r.asDict() for r in audit.file_profile(m).orderBy("qas_file").toLocalIterator()],
        "coverage": {r.dimension: r.asDict() for r in audit.coverage_of(levels).collect()},
    }
    files.write_json_document(found, args.json_out)
    report.write(report.audit_markdown(m, license_name), args.markdown_out)
    print(json.dumps({k: found[k] for k in ("rows", "license", "missing_assets", "malformed_answers")}, ensure_ascii=False, indent=2))
    m.unpersist()
    return 0


def verdict(spark: SparkSession, args: argparse.Namespace) -> tuple[bool, DataFrame, dict]:
    """Whether nothing is wrong, the errors in order, and how many rows each artifact has."""
    m, index, pairs = (read(spark, p) for p in (args.manifest, args.parallel, args.pairs))
    canonical, mismatch = (read(spark, p) if there(p) else None for p in (args.canonical_inputs, args.mismatch_inputs))
    asked = [df.select(F.explode("image_paths").alias("path")) for df in (canonical, mismatch) if df is not None]
    existing = None
    if asked:
        # each path is looked up where it lies; nothing else is listed
        top = args.repo_root.rstrip("/") or "."
        path = F.col("path")
        existing = written(store.existing(validate.union(asked).distinct().withColumn("at", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{top}/"), path)))), "existing")
    errors = validate.messages(validate.release_violations(m, index, pairs, canonical, mismatch, existing)).persist()
    return errors.isEmpty(), errors.orderBy("place"), validate.counts_of(m, index, pairs, canonical, mismatch).first().asDict()


def validate_files(args: argparse.Namespace, spark: SparkSession) -> int:
    ok, errors, counts = verdict(spark, args)
    print(json.dumps({"ok": ok, "summary": counts}, indent=2))
    for row in errors.select("message").toLocalIterator():
        print(row.message)
    return 0 if ok else 1


def planned(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    rows = runs.filter_rows(read(spark, args.inputs), ["input_id"], models.set_of(args.languages), models.set_of(args.dimensions), args.limit)
    return rows.withColumn("image_paths", paths.resolve_paths(F.col("image_paths"), F.lit(str(Path(args.repo_root).resolve()))))


LOG = "run_id string, input_id string, sample_id string, status string"


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    config, lock = files.load_config(args.model_config), files.load_config(args.source_lock) if there(args.source_lock) else {}
    for key, value in (("attn_implementation", args.attn_implementation), ("device_map", args.device_map)):
        if value:
            config[key] = value
    if args.max_new_tokens is not None:
        config["generation"] = {**(config.get("generation") or {}), "max_new_tokens": args.max_new_tokens}
    profile = args.prompt_profile or config.get("prompt_profile", "mpr_minimal_v1")
    rows = planned(args, spark)
    log_of_run = f"{args.output}/run_id={quote(args.run_id, safe='')}"
    runlog.recover(log_of_run)
    log = files.read_json_lines(spark, args.output, LOG) if args.resume and there(args.output) else spark.createDataFrame([], LOG)
    if args.dry_run:
        row = runs.dry_run_row(rows, log, args.run_id, config, profile)
        runlog.append(row.drop("run_id"), log_of_run)
        print(json.dumps(row.first().asDict(), indent=2))
        return 0
    todo = runs.pending(rows, log)
    results = runs.answered(todo, models.loader(config), args.run_id, config, lock, profile, runs.code_commit(), runs.software_versions())
    runlog.append(results.drop("run_id"), log_of_run)
    return 0


def preflight(args: argparse.Namespace, spark: SparkSession) -> int:
    config = files.load_config(args.model_config)
    rows = runs.sliced(read(spark, args.inputs), ["input_id"], args.limit).persist()
    rows = rows.withColumn("image_paths", paths.resolve_paths(F.col("image_paths"), F.lit(str(Path(args.repo_root).resolve()))))
    images = files.image_sizes(rows.select(F.explode("image_paths").alias("path")).distinct())
    records = runs.preflight_records(rows, models.loader({"adapter": "word_count", **config}, models.PROCESSORS), config, args.prompt_profile, images).persist()
    summary = report.preflight_summary(records)
    files.write_json_document({"summary": summary, "records": args.json_out + ".records"}, args.json_out)
    files.write_json_lines(records, args.json_out + ".records")
    report.write(report.preflight_markdown(summary), args.markdown_out)
    print(json.dumps(summary, ensure_ascii=False, indent=2))
    return 0


def download(args: argparse.Namespace, spark: SparkSession) -> int:
    """A release as its lock file pins it, from a mirror: nothing is kept whose digest is wrong."""
    if not (there(args.lock) and args.mirror):
        print("Give a mirror (--mirror) and the lock file that pins its files (--lock); hubs aren't asked from here.", file=sys.stderr)
        return 1
    copied = snapshot.fetch(spark, args.mirror, args.lock, args.root, args.allow).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    files.write_provenance(f"{args.root}/SOURCE.json", "qas and images", {"revision": snapshot.lock_of(args.lock)["revision"], "mirror": args.mirror})
    print(json.dumps({"files": copied.files, "bytes": copied.bytes}))
    return 0


def generate(args: argparse.Namespace, spark: SparkSession) -> int:
    print("Answers come from run, with an adapter for the model.", file=sys.stderr)
    return 1


def release(args: argparse.Namespace, spark: SparkSession) -> int:
    """Audit, build and validate, one after the other; ends with the first that finds something wrong."""
    return audit_release(args, spark) or build(args, spark) or validate_files(args, spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="polyscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, do, about: str, *options: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        for flag, default, kind in options:
            p.add_argument(flag, **({"action": "store_true"} if kind is bool else {"default": default, "type": kind}))
        p.set_defaults(do=do)
        return p

    root = ("--root", "data/raw/release", str)
    outs = (("--out", f"{DATA}/manifest.jsonl", str), ("--parallel-out", f"{DATA}/parallel_index.jsonl", str), ("--pairs-out", f"{DATA}/cross_locale_pairs.jsonl", str), ("--canonical-inputs-out", f"{DATA}/canonical_inputs.jsonl", str), ("--mismatch-inputs-out", f"{DATA}/mismatch_inputs.jsonl", str))
    reports = (("--json-out", f"{DATA}/release_audit.json", str), ("--markdown-out", "docs/RELEASE_AUDIT.md", str))
    checked = (("--manifest", f"{DATA}/manifest.jsonl", str), ("--parallel", f"{DATA}/parallel_index.jsonl", str), ("--pairs", f"{DATA}/cross_locale_pairs.jsonl", str), ("--canonical-inputs", f"{DATA}/canonical_inputs.jsonl", str), ("--mismatch-inputs", f"{DATA}/mismatch_inputs.jsonl", str), ("--repo-root", ".", str))
    command("build", build, "manifest, parallel index, pairs and model inputs of a release", root, *outs)
    command("audit", audit_release, "report on a release", root, *reports)
    command("validate", validate_files, "check the artifacts of a release", *checked)
    command("release", release, "audit, build and validate a release", root, *outs, *reports, *checked)
    model = (("--inputs", f"{DATA}/canonical_inputs.jsonl", str), ("--model-config", "configs/model.json", str), ("--repo-root", ".", str), ("--prompt-profile", None, str), ("--limit", None, int))
    command("run", run, "answers of a model to inputs", *model, ("--source-lock", f"{DATA}/source_lock.json", str), ("--output", "results/canonical.jsonl", str), ("--run-id", f"canonical-{uuid.uuid4().hex[:12]}", str), ("--languages", None, str), ("--dimensions", None, str), ("--max-new-tokens", None, int), ("--device-map", None, str), ("--attn-implementation", None, str), ("--resume", False, bool), ("--dry-run", False, bool))
    command("preflight", preflight, "how much of a model's context inputs take", *model, ("--json-out", f"{DATA}/preflight.json", str), ("--markdown-out", "docs/PREFLIGHT.md", str))
    command("download", download, "a pinned release from a mirror", root, ("--mirror", None, str), ("--lock", f"{DATA}/snapshot_lock.json", str), ("--allow", None, str))
    command("generate", generate, "says which command generates")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.do(args, spark or session())
