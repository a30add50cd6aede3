"""Column expressions for asset paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DIMENSION_PREFIXES, IMAGE_SUFFIXES, LANGUAGES

LANGUAGE = "|".join(LANGUAGES)


def posix(path: Column) -> Column:
    """The path without empty and "." parts; "." if nothing is left. Exactly two leading slashes stay."""
    root = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    joined = F.concat(root, F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def normalize_asset(path: Column) -> Column:
    """Relative to the folder of images: no leading "../", then no leading "images/"."""
    return F.regexp_replace(F.regexp_replace(posix(path), r"^(\.\./)+", ""), "^images/", "")


def state_key(path: Column) -> Column:
    """The asset's path without any sign of its language, so that parallel assets share it."""
    parts = F.filter(F.split(normalize_asset(path), "/"), lambda x: ~x.isin("images", "qas", *LANGUAGES))
    bare = F.regexp_replace(F.array_join(parts, "/"), rf"(^|[_/-])({LANGUAGE})(?=[_./-]|$)", "$1")
    return F.regexp_replace(F.regexp_replace(bare, "__+", "_"), r"^_+|_+\z", "")


def parallel_id(dimension: Column, path: Column) -> Column:
    return F.concat_ws("::", dimension, state_key(path))


def resolve_asset(root: Column, path: Column) -> Column:
    return F.concat_ws("/", root, normalize_asset(path))


def resolve_paths(paths: Column, root: Column) -> Column:
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", root, p)))


def file_language(qas_file: Column) -> Column:
    return F.substring_index(F.regexp_replace(qas_file, r"\.jsonl$", ""), "_", -1)


def file_dimension(qas_file: Column) -> Column:
    """The dimension of which the file's name is exactly prefix_language, or unknown."""
    stem = F.regexp_replace(qas_file, r"\.jsonl$", "")
    prefix = F.regexp_replace(stem, r"_[^_]*$", "")
    known = F.when(F.lit(False), "")
    for dimension, name in DIMENSION_PREFIXES.items():
        known = known.when((prefix == name) & stem.contains("_"), dimension)
    return known.otherwise("unknown")


def natural_key(name: Column) -> Column:
    """Sorts runs of digits as numbers and other text in lower case."""
    texts = F.transform(F.split(name, "[0-9]+", -1), F.lower)
    numbers = F.transform(F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))
    return F.arrays_zip(texts.alias("text"), numbers.alias("number"))


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).isin(*IMAGE_SUFFIXES)
