"""Aggregates of the release audit, over the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import DIMENSION_PREFIXES, LABELS, LANGUAGES, PUBLISHED_ROWS_PER_LANGUAGE
from .manifest import same_set

DIMENSIONS = tuple(DIMENSION_PREFIXES)


def with_zeros(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts by a column's known values, those without rows too."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.filter(F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("rows"))
    return known.join(counts, column, "left").select(column, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def rows_by_language(m: DataFrame) -> DataFrame:
    return with_zeros(m, "language", LANGUAGES)


def rows_by_dimension(m: DataFrame) -> DataFrame:
    return with_zeros(m, "dimension", DIMENSIONS)


def published_delta(m: DataFrame, published: int = PUBLISHED_ROWS_PER_LANGUAGE) -> DataFrame:
    return rows_by_language(m).select("language", "rows", (F.col("rows") - published).alias("delta"))


def language_dimension_matrix(m: DataFrame) -> DataFrame:
    """A row for each known language: rows by dimension, and their total."""
    cells = [F.count_if(F.col("dimension") == d).alias(d) for d in DIMENSIONS]
    return m.filter(F.col("language").isin(*LANGUAGES)).groupBy("language").agg(*cells, F.count("*").alias("total"))


def levels(m: DataFrame) -> DataFrame:
    """Counts of all levels of the report from one scan: level, language, dimension, languages, rows and states.

    Rows are counted by state and language first; what is left, at most six rows a state, gives rows by language, by dimension and by both, and, by dimension, how many states have how many
    languages (null where a level has none of it). Rows of unknown languages or dimensions count as null there; states are those of :func:`states`.
    """
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c))
    is_state = (F.col("dimension") != "unknown") & F.col("language").isin(*LANGUAGES) & (F.col("asset") != "")
    cells = m.groupBy("dimension", "state_key", "language").agg(F.count("*").alias("n"), F.max(is_state.cast("int")).alias("s"))
    state = Window.partitionBy("dimension", "state_key")
    of_state = F.sum("s").over(state)
    cells = cells.select(
        known("language", LANGUAGES).alias("language"), known("dimension", DIMENSIONS).alias("dimension"), "n", of_state.alias("languages"),
        # a state counts once, with its first cell
        (F.row_number().over(state.orderBy(F.desc("s"), "language")) == 1).cast("long").alias("first"),
    )
    sets = cells.groupingSets([[F.col("language")], [F.col("dimension")], [F.col("language"), F.col("dimension")], [F.col("dimension"), F.col("languages")]], "language", "dimension", "languages")
    counted = sets.agg(F.grouping_id().alias("g"), F.sum("n").alias("rows"), F.sum("first").alias("states"))
    # bits of columns that a set leaves out: language 4, dimension 2, languages 1
    name = F.when(F.col("g") == 3, "language").when(F.col("g") == 5, "dimension").when(F.col("g") == 1, "language_dimension").otherwise("coverage")
    told = counted.select(name.alias("level"), "language", "dimension", "languages", "rows", "states")
    is_coverage = F.col("level") == "coverage"
    told = told.filter(F.when(is_coverage, (F.col("languages") > 0) & F.col("dimension").isNotNull()).otherwise(True))
    return told.select("level", "language", "dimension", F.when(is_coverage, F.col("languages")).alias("languages"), F.when(~is_coverage, F.col("rows")).alias("rows"), F.when(is_coverage, F.col("states")).alias("states"))


def rows_of(found: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Of :func:`levels` the rows by language or by dimension, zeros included, as :func:`rows_by_language` and :func:`rows_by_dimension` count them."""
    known = found.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return known.join(found.filter(F.col("level") == column).select(column, "rows"), column, "left").select(column, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def matrix_of(found: DataFrame) -> DataFrame:
    """Of :func:`levels` what :func:`language_dimension_matrix` counts."""
    cells = [F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("rows"))), F.lit(0)).alias(d) for d in DIMENSIONS]
    return found.filter("level = 'language_dimension' and language is not null").groupBy("language").agg(*cells, F.sum("rows").alias("total"))


def coverage_of(found: DataFrame) -> DataFrame:
    """Of :func:`levels` what :func:`coverage_by_dimension` counts."""
    complete = F.coalesce(F.sum(F.when(F.col("languages") == len(LANGUAGES), F.col("states"))), F.lit(0))
    return found.filter("level = 'coverage'").groupBy("dimension").agg(F.sum("states").alias("unique_states"), complete.alias("complete_states"))


def label_counts_by_file(m: DataFrame) -> DataFrame:
    return m.groupBy("qas_file").agg(*[F.count_if(F.col("gold_label") == x).alias(f"n_{x.lower()}") for x in LABELS])


def duplicate_excess(m: DataFrame, by: str = "qas_file", question: str = "question_raw") -> DataFrame:
    """By how many rows a file's questions exceed its distinct ones; files without excess don't appear."""
    signatures = m.groupBy(by, text.question_signature(F.coalesce(question, F.lit(""))).alias("signature")).agg(F.count("*").alias("n"))
    return signatures.groupBy(by).agg(F.sum(F.col("n") - 1).alias("excess")).filter("excess > 0")


def option_status_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("option_parse_status").agg(F.count("*").alias("rows"))


def option_order_counts(m: DataFrame) -> DataFrame:
    return m.groupBy(F.array_join("option_order", ",").alias("option_order")).agg(F.count("*").alias("rows"))


def other_orders(m: DataFrame) -> DataFrame:
    return m.agg(F.count_if(F.array_join("option_order", ",") != ",".join(LABELS)).alias("rows"))


def states(m: DataFrame) -> DataFrame:
    """dimension, state_key, languages of assets in known dimensions and languages; a state has at most six."""
    known = m.filter((F.col("dimension") != "unknown") & F.col("language").isin(*LANGUAGES) & (F.col("asset") != ""))
    return known.groupBy("dimension", "state_key").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def coverage_by_dimension(m: DataFrame) -> DataFrame:
    return states(m).groupBy("dimension").agg(F.count("*").alias("unique_states"), F.count_if(same_set(F.col("languages"))).alias("complete_states"))


def coverage_histogram(m: DataFrame) -> DataFrame:
    return states(m).groupBy("dimension", F.size("languages").cast("long").alias("languages")).agg(F.count("*").alias("states"))


def incomplete_states(m: DataFrame, most: int = 50) -> DataFrame:
    """Of each dimension the first incomplete states by key: a report's list."""
    order = Window.partitionBy("dimension").orderBy("state_key")
    found = states(m).filter(~same_set(F.col("languages"))).withColumn("n", F.row_number().over(order))
    return found.filter(F.col("n") <= most).select("dimension", "state_key", F.array_join("languages", ",").alias("languages"))


def missing_assets(m: DataFrame) -> DataFrame:
    return m.filter(~F.col("asset_exists")).select("qas_file", "qas_line", "asset")


def missing_by_file(m: DataFrame) -> DataFrame:
    return missing_assets(m).groupBy("qas_file").agg(F.count("*").alias("missing"))


def malformed_answers(m: DataFrame) -> DataFrame:
    return m.filter(F.col("gold_label").isNull()).select("qas_file", "qas_line", F.col("answer_raw").alias("answer"))


def non_label_only_answers(m: DataFrame) -> DataFrame:
    return m.filter(F.col("gold_label").isNotNull() & ~text.label_only(F.col("answer_raw"), F.col("gold_label"))).select("qas_file", "qas_line", F.col("answer_raw").alias("answer"), "gold_label")


def first_items(items: DataFrame, most: int = 200) -> DataFrame:
    """A report's list: the first by file and line."""
    return items.orderBy("qas_file", "qas_line").limit(most)


def episode_rows(m: DataFrame) -> DataFrame:
    """frames, first and last frame of each episode whose folder exists."""
    name = lambda i: F.when(F.col("num_images") > 0, F.substring_index(F.try_element_at("image_paths", F.lit(i)), "/", -1))
    return m.filter("is_episode and asset_exists").select("qas_file", "qas_line", "asset", F.col("num_images").cast("long").alias("frames"), name(1).alias("first_frame"), name(-1).alias("last_frame"))


def episode_frame_histogram(m: DataFrame) -> DataFrame:
    return episode_rows(m).groupBy("frames").agg(F.count("*").alias("rows"))


def file_profile(m: DataFrame) -> DataFrame:
    """One pass over the rows, with the excess of duplicate questions joined in."""
    labels = [F.count_if(F.col("gold_label") == x).alias(f"n_{x.lower()}") for x in LABELS]
    profile = m.groupBy("qas_file", "language", "dimension").agg(F.count("*").alias("rows"), *labels, F.count_if(~F.col("asset_exists")).alias("missing_assets"), F.count_if(F.col("is_episode") & F.col("asset_exists")).alias("episode_rows"))
    return profile.join(duplicate_excess(m), "qas_file", "left").withColumn("excess", F.coalesce("excess", F.lit(0)).cast("long"))
