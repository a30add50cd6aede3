"""From question rows to the manifest, the index of parallel samples, language pairs and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.constants import LANGUAGES

SAMPLE_FIELDS = ("sample_id", "qas_file", "qas_line", "asset", "asset_path", "image_paths", "num_images", "gold_label", "asset_exists")


def row_asset(qa: DataFrame) -> DataFrame:
    """``asset`` and ``is_episode`` by which key a row has: a picture's path goes before a folder's, even if it is null."""
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    asset = F.when(F.col("has_image_path"), name("image_path")).when(F.col("has_folder"), name("image_folder_path")).otherwise("")
    return qa.withColumns({"asset": asset, "is_episode": ~F.col("has_image_path") & F.col("has_folder")})


def episode_frames(listing: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """folder, frames (names in natural order) of a listing of files by ``path``; of the folders that are ``wanted`` (folder) only, if given: one of single pictures may hold any number of them."""
    files = listing.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name")).filter(F.col("path").contains("/"))
    files = files if wanted is None else files.join(wanted, "folder", "left_semi")
    images = files.filter(paths.is_image(F.col("name")))
    ordered = F.array_sort(F.collect_list(F.struct(paths.natural_key(F.col("name")).alias("key"), "name")))
    return images.groupBy("folder").agg(F.transform(ordered, lambda x: x["name"]).alias("frames"))


def existing_paths(listing: DataFrame) -> DataFrame:
    """Files and all folders above them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return listing.select(F.explode(above).alias("path")).distinct()


def build_manifest(qa: DataFrame, listing: DataFrame, root: str = "data/images") -> DataFrame:
    """23 columns for each question row. ``qa``: qas_file, qas_line, question, answer, asset, is_episode; ``listing``: path, relative to ``root``."""
    asset = F.col("asset")
    rows = qa.withColumns({"__key": F.when(asset != "", paths.normalize_asset(asset)), "__opt": text.parse_options(F.coalesce("question", F.lit(""))), "__dimension": paths.file_dimension(F.col("qas_file")), "__language": paths.file_language(F.col("qas_file")), "__state": paths.state_key(asset)})
    there = existing_paths(listing).select(F.col("path").alias("__key"), F.lit(True).alias("__there"))
    frames = episode_frames(listing, rows.filter("is_episode").select(F.col("__key").alias("folder"))).select(F.col("folder").alias("__key"), F.col("frames").alias("__frames"))
    rows = rows.join(there, "__key", "left").join(frames, "__key", "left")
    path = F.when(asset != "", F.concat_ws("/", F.lit(root), F.col("__key"))).otherwise("")
    exists = F.coalesce("__there", F.lit(False))
    empty = F.array().cast("array<string>")
    framed = F.transform(F.coalesce("__frames", empty), lambda x: F.concat_ws("/", path, x))
    images = F.when(F.col("is_episode") & exists, framed).when(asset != "", F.array(path)).otherwise(empty)
    parallel = F.concat_ws("::", "__dimension", "__state")
    return rows.select(
        F.concat_ws("::", parallel, F.col("__language")).alias("sample_id"), parallel.alias("parallel_id"), F.col("__state").alias("state_key"), F.col("__dimension").alias("dimension"), F.col("__language").alias("language"),
        "qas_file", F.col("qas_line").cast("int").alias("qas_line"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("question", F.lit("")).alias("question_raw"), F.col("__opt.question_stem"), F.col("__opt.options"), F.col("__opt.option_order"), F.col("__opt.option_count"), F.col("__opt.option_parse_status"),
        F.col("answer").alias("answer_raw"), text.parse_label(F.coalesce("answer", F.lit("None"))).alias("gold_label"), "asset", path.alias("asset_path"), images.alias("image_paths"), F.size(images).alias("num_images"),
        F.when(F.col("is_episode"), "natural_sort").otherwise("single_image").alias("frame_order"), "is_episode", exists.alias("asset_exists"),
    )


def last_written(manifest: DataFrame) -> DataFrame:
    """The last row, in order of file and line, of each parallel_id and language."""
    order = Window.partitionBy("parallel_id", "language").orderBy(F.desc("qas_file"), F.desc("qas_line"))
    return manifest.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def same_set(languages: Column) -> Column:
    return F.array_sort(F.array_distinct(languages)) == F.array(*[F.lit(x) for x in sorted(LANGUAGES)])


def parallel_index(manifest: DataFrame) -> DataFrame:
    """Entries: parallel_id, languages, complete, gold_labels, gold_labels_consistent (null counts as a label), samples. A group has a row for each language at most."""
    rows = last_written(manifest)
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("language"), c))))
    grouped = rows.groupBy("parallel_id").agg(
        F.sort_array(F.collect_list("language")).alias("languages"),
        entry(F.col("gold_label")).alias("gold_labels"),
        (F.count_distinct("gold_label") + F.max(F.col("gold_label").isNull().cast("int")) == 1).alias("gold_labels_consistent"),
        F.map_from_entries(F.collect_list(F.struct(F.col("language"), F.struct(*SAMPLE_FIELDS)))).alias("samples"),
    )
    return grouped.select("parallel_id", "languages", same_set(F.col("languages")).alias("complete"), "gold_labels", "gold_labels_consistent", "samples")


def index_summary(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("parallel_ids"), F.count_if("complete").alias("complete_parallel_ids"), F.count_if(~F.col("gold_labels_consistent")).alias("gold_label_inconsistent_ids"))


def directed_language_pairs(spark, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    rows = [(a, b) for a in languages for b in languages if a != b]
    return spark.createDataFrame(rows, "question_language string, gui_language string")


def sided(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one parallel_id in different languages, as structs q and g. One shuffle by parallel_id; groups hold a row for each language."""
    q = rows.select("parallel_id", F.struct(*[c for c in rows.columns if c != "parallel_id"]).alias("q"))
    g = q.select(F.col("parallel_id"), F.col("q").alias("g"))
    return q.alias("a").join(g.alias("b"), "parallel_id").filter("q.language <> g.language")


def cross_locale_pairs(manifest: DataFrame) -> DataFrame:
    """Directed pairs of the complete parallel ids; the gold label is that of the question's side."""
    rows = last_written(manifest).select("parallel_id", "language", "sample_id", "gold_label", "asset")
    whole = rows.groupBy("parallel_id").agg(F.sort_array(F.collect_list("language")).alias("languages"), (F.count_distinct("gold_label") + F.max(F.col("gold_label").isNull().cast("int")) == 1).alias("consistent")).filter(same_set(F.col("languages"))).select("parallel_id", "consistent")
    pairs = sided(rows.join(whole, "parallel_id"))
    return pairs.select(
        F.concat("parallel_id", F.lit("::q="), "q.language", F.lit("::gui="), "g.language").alias("pair_id"), "parallel_id", F.col("q.language").alias("question_language"), F.col("g.language").alias("gui_language"), F.lit("raw_mismatch").alias("condition"),
        F.col("q.sample_id").alias("question_sample_id"), F.col("g.sample_id").alias("mismatch_gui_sample_id"), F.col("q.sample_id").alias("oracle_gui_sample_id"), F.col("q.gold_label").alias("gold_label"), F.col("q.consistent").alias("gold_label_consistent"),
        F.col("q.asset").alias("question_asset"), F.col("g.asset").alias("mismatch_gui_asset"), F.col("q.asset").alias("oracle_gui_asset"),
    )


def canonical_inputs(manifest: DataFrame) -> DataFrame:
    """An input for each row; a manifest without questions' texts and options, as validation takes it, gives inputs without them."""
    texts = [c for c in ("question_raw", "question_stem", "options", "option_order", "answer_raw") if c in manifest.columns]
    return manifest.select(F.concat(F.lit("canonical::"), "sample_id").alias("input_id"), F.lit("canonical_matched").alias("condition"), "sample_id", "parallel_id", F.col("language").alias("question_language"), F.col("language").alias("gui_language"), "dimension", *texts, "gold_label", "image_paths", "num_images", "frame_order")


def languages_present(manifest: DataFrame) -> DataFrame:
    """One row, wanted: the known languages that any row is in."""
    present = manifest.agg(*[F.max(F.col("language") == x).alias(x) for x in LANGUAGES])
    return present.select(F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in LANGUAGES])).alias("wanted"))


def incomplete_ids(manifest: DataFrame) -> DataFrame:
    """parallel_id and missing (the languages, in order) of ids that have a row in some known language but not in all that are present: mismatch inputs can't be built from them."""
    own = manifest.filter(F.col("language").isin(*LANGUAGES)).groupBy("parallel_id").agg(F.collect_set("language").alias("own"))
    return own.join(F.broadcast(languages_present(manifest))).select("parallel_id", F.array_except("wanted", "own").alias("missing")).filter(F.size("missing") > 0)


def mismatch_inputs(manifest: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Directed pairs over the known languages in the manifest. An id that lacks one of them is an error, raised when the rows are read.

    One shuffle, by parallel_id: its last row in each known language, then the pairs of those. ``wanted``: the manifest's :func:`languages_present`, where they are known, so that it isn't read for them each time that the inputs are.
    """
    fields = ("language", "sample_id", "dimension", "answer_raw", "gold_label", "image_paths", "num_images", "frame_order")
    last = [F.max_by(F.struct(*fields), F.when(F.col("language") == x, F.struct("qas_file", "qas_line"))) for x in LANGUAGES]
    # max_by gives a row's values even where no row is in the language
    there = [F.max(F.col("language") == x) for x in LANGUAGES]
    grouped = manifest.groupBy("parallel_id").agg(F.array_compact(F.array(*[F.when(t, r) for t, r in zip(there, last, strict=True)])).alias("rows")).filter(F.size("rows") > 0)
    checked = grouped.join(F.broadcast(languages_present(manifest) if wanted is None else wanted)).filter(F.assert_true(F.size("rows") == F.size("wanted"), F.concat(F.lit("no row in each language: "), "parallel_id")).isNull())
    # a row for each two places in rows, whose values are read from there: no pair of whole rows is made
    places = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(j).alias("g")) for i in range(len(LANGUAGES)) for j in range(len(LANGUAGES)) if i != j])
    pairs = checked.select("parallel_id", "rows", F.explode(places).alias("at")).filter(F.greatest("at.q", "at.g") < F.size("rows"))
    return pairs.select("parallel_id", F.get("rows", F.col("at.q")).alias("q"), F.get("rows", F.col("at.g")).alias("g")).select(
        F.concat(F.lit("mismatch::"), "parallel_id", F.lit("::q="), "q.language", F.lit("::gui="), "g.language").alias("input_id"), F.lit("raw_mismatch").alias("condition"), "parallel_id", F.col("q.sample_id").alias("question_sample_id"), F.col("g.sample_id").alias("gui_sample_id"), F.col("q.sample_id").alias("oracle_sample_id"),
        F.col("q.language").alias("question_language"), F.col("g.language").alias("gui_language"), F.col("q.dimension").alias("dimension"), F.lit("resolve_from_manifest.question_sample_id").alias("question_source"), F.col("q.answer_raw").alias("answer_raw"), F.col("q.gold_label").alias("gold_label"),
        F.col("g.image_paths").alias("image_paths"), F.col("g.num_images").alias("num_images"), F.col("g.frame_order").alias("frame_order"),
    )


def resolve_questions(mismatch: DataFrame, manifest: DataFrame) -> DataFrame:
    """The question that a mismatch input refers to."""
    questions = manifest.select(F.col("sample_id").alias("question_sample_id"), "question_raw", "question_stem", "options", "option_order")
    return mismatch.join(questions, "question_sample_id", "left")
