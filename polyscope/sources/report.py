"""The audit and preflight reports as Markdown, from small aggregates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LANGUAGES, PUBLISHED_ROWS_PER_LANGUAGE
from ..operators import audit, manifest, runs


def table(df: DataFrame, order: list[str], most: int | None = None) -> str:
    """A Markdown table of an aggregate; of long ones the first rows and how many more there are."""
    rows = df.orderBy(*order).limit(most + 1).collect() if most else df.orderBy(*order).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in (rows[:most] if most else rows)]
    if most and len(rows) > most:
        lines.append(f"\nThere are {df.count() - most} more.")
    return "\n".join(lines)


def audit_markdown(m: DataFrame, license_name: str | None = None) -> str:
    """All parts of the release audit; findings are computed, not fixed text."""
    index, levels = manifest.parallel_index(m), audit.levels(m).persist()  # some dozens of rows
    by_language = audit.rows_of(levels, "language", LANGUAGES)
    total, missing, malformed = m.count(), audit.missing_assets(m).count(), audit.malformed_answers(m).count()
    parts = [
        "# Release audit", f"Rows: {total}. License: {license_name or 'not found'}. Missing assets: {missing}. Malformed answers: {malformed}. Answers that are more than a label: {audit.non_label_only_answers(m).count()}.",
        "## Rows by language", table(by_language.select("language", "rows", (F.col("rows") - PUBLISHED_ROWS_PER_LANGUAGE).alias("delta")), ["language"]),
        "## Rows by dimension", table(audit.rows_of(levels, "dimension", audit.DIMENSIONS), ["dimension"]),
        "## Languages and dimensions", table(audit.matrix_of(levels), ["language"]),
        "## Files", table(audit.file_profile(m), ["qas_file"], 1000),
        "## Options", table(audit.option_status_counts(m), ["option_parse_status"]), table(audit.option_order_counts(m), ["option_order"]),
        "## Parallel coverage", table(manifest.index_summary(index), ["parallel_ids"]), table(audit.coverage_of(levels), ["dimension"]), table(levels.filter("level = 'coverage'").select("dimension", "languages", "states"), ["dimension", "languages"]), table(audit.incomplete_states(m), ["dimension", "state_key"], 50),
        "## Malformed answers", table(audit.malformed_answers(m), ["qas_file", "qas_line"], 50),
        "## Missing assets", table(audit.missing_assets(m), ["qas_file", "qas_line"], 50),
        "## Episode frames", table(audit.episode_frame_histogram(m), ["frames"]),
    ]
    levels.unpersist()
    return "\n\n".join(parts) + "\n"


def preflight_summary(records: DataFrame) -> dict:
    """rows, statistics of each field (null without values), and rows by dimension and language, of preflight records."""
    found = {r.field: r.asDict() for r in runs.percentiles(records, list(runs.PREFLIGHT_FIELDS)).collect()}
    names = ("min", "p50", "p90", "p95", "p99", "max")
    fields = {f: {n: found.get(f, {}).get(n) for n in names} for f in runs.PREFLIGHT_FIELDS}
    by = lambda c: {r[c]: r["rows"] for r in records.groupBy(c).agg(F.count("*").alias("rows")).orderBy(c).collect()}  # noqa: E731  known values
    return {"rows": records.count(), **fields, "rows_by_dimension": by("dimension"), "rows_by_language": by("language")}


def preflight_markdown(summary: dict) -> str:
    """The report of a preflight: how many rows, and how long they are."""
    names = ("min", "p50", "p90", "p95", "p99", "max")
    listed = lambda of: ", ".join(f"{k} {v}" for k, v in of.items()) or "none"
    rows = ["| field | " + " | ".join(names) + " |", "|" + " - |" * (len(names) + 1)]
    rows += ["| " + " | ".join([f, *("" if summary[f][n] is None else str(summary[f][n]) for n in names)]) + " |" for f in runs.PREFLIGHT_FIELDS]
    return "\n\n".join(["# Preflight", f"Rows: {summary['rows']}. By dimension: {listed(summary['rows_by_dimension'])}. By language: {listed(summary['rows_by_language'])}.", "\n".join(rows)]) + "\n"


def write(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
