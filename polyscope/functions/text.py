"""Column expressions for questions, answers and prompts. White space means what it means to Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LABEL_INSTRUCTION, LABELS, TASK_INSTRUCTION

WS = r"[\s\x1c-\x1f]"
COLONS, OPENING, CLOSING = (":", "："), ("(", "["), (")", "]", ".", ":", "：")


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+", "")


def rest(c: Column, n: int = 1) -> Column:
    """What follows the first ``n`` characters."""
    return F.substr(c, F.lit(n + 1))


def first(c: Column) -> Column:
    return F.substr(c, F.lit(1), F.lit(1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def parse_label(c: Column) -> Column:
    """The answer's label, or null: a label alone or at the start, perhaps after "answer:" and in brackets."""

    def without_name(text: Column) -> Column:
        named = F.when(F.lower(F.substr(text, F.lit(1), F.lit(6))) == "answer", py_lstrip(rest(text, 6)))
        return let(named, lambda x: F.when(first(x).isin(*COLONS), py_lstrip(rest(x))).otherwise(text))

    def without_bracket(text: Column) -> Column:
        return F.when(first(text).isin(*OPENING), py_lstrip(rest(text))).otherwise(text)

    def label(text: Column) -> Column:
        ends = lambda x: (x == "") | x.rlike(rf"(?U)^{WS}")
        alone = let(rest(text), lambda x: ends(x) | first(x).isin(*CLOSING) & ends(rest(x)))
        return F.when(F.upper(first(text)).isin(*LABELS) & alone, F.upper(first(text)))

    return let(let(let(py_strip(c), without_name), without_bracket), label)


def label_only(c: Column, label: Column) -> Column:
    return F.upper(py_strip(c)) == label


def option_pieces(question: Column) -> Column:
    """An array of label and text: first the stem, without a label, then each option.

    The question is cut behind its colons. A cut whose last character before the colon is a label that no letter or digit precedes opens an option;
    what stands before that label, and all other cuts, belong to the text that is open.
    """
    cut = F.regexp_extract_all(question, F.lit("[^:：]*[:：]|[^:：]+$"), F.lit(0))

    def parts(x: Column) -> Column:
        def labelled(before: Column) -> Column:
            label, body = F.substr(before, F.length(before), F.lit(1)), F.substr(before, F.lit(1), F.length(before) - 1)
            opens = label.isin(*LABELS) & ~body.rlike(r"[A-Za-z0-9]\z")
            return F.when(opens, F.struct(label.alias("label"), body.alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("label"), x.alias("text")))

        # without a colon at its end a cut opens nothing: an empty text has no label
        colon = F.substr(x, F.length(x), F.lit(1)).isin(*COLONS)
        return let(F.when(colon, F.regexp_replace(F.substr(x, F.lit(1), F.length(x) - 1), rf"(?U){WS}+\z", "")).otherwise(""), labelled)

    def add(found: Column, x: Column) -> Column:
        open_ = F.element_at(found, -1)
        longer = F.struct(open_["label"].alias("label"), F.concat(open_["text"], x["text"]).alias("text"))
        grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(longer))
        return F.when(x["label"].isNull(), grown).otherwise(F.concat(grown, F.array(F.struct(x["label"].alias("label"), F.lit("").alias("text")))))

    empty = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("text")))
    return F.aggregate(F.transform(cut, parts), empty, add)


def parse_options(question: Column) -> Column:
    """A struct of question_stem, options, option_order, option_count, option_parse_status."""

    def parsed(found: Column) -> Column:
        pieces = F.transform(found, lambda x: py_strip(x["text"]))
        labels = F.transform(F.slice(found, F.lit(2), F.size(found)), lambda x: x["label"])
        return let(F.struct(pieces.alias("pieces"), labels.alias("labels"), F.array_distinct(labels).alias("distinct")), told)

    def told(x: Column) -> Column:
        texts = F.slice(x["pieces"], F.lit(2), F.size(x["pieces"]))
        repeated, missing = F.size(x["labels"]) > F.size(x["distinct"]), F.size(x["distinct"]) < len(LABELS)
        status = F.when(repeated, "failed_duplicate_label").when(missing, "failed_missing_label").when(F.exists(texts, lambda t: t == ""), "failed_empty_option").otherwise("ok")
        none = F.create_map().cast("map<string,string>")
        return F.struct(
            F.when(repeated | missing, py_strip(question)).otherwise(F.element_at(x["pieces"], 1)).alias("question_stem"),
            F.when(repeated | missing, none).otherwise(F.map_from_arrays(x["labels"], texts)).alias("options"),
            x["labels"].alias("option_order"),
            F.size(x["distinct"]).alias("option_count"),
            status.alias("option_parse_status"),
        )

    return let(option_pieces(question), parsed)


def question_signature(c: Column) -> Column:
    return F.regexp_replace(py_strip(c), rf"(?U){WS}+", " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    return py_strip(prediction) == py_strip(gold)


def prompt_text(question: Column, profile: Column) -> Column:
    """The prompt for a profile; an unknown profile is an error."""
    ask = F.concat(question, F.lit("\n\n" + LABEL_INSTRUCTION))
    return (
        F.when(profile == "mpr_minimal_v1", question)
        .when(profile == "mpr_label_only_v1", ask)
        .when(profile == "mpr_direct_v1", F.concat(F.lit(TASK_INSTRUCTION + "\n\n"), ask))
        .otherwise(F.raise_error(F.concat(F.lit("unknown prompt profile: "), F.coalesce(profile, F.lit("null")))))
    )


def messages(question: Column, image_paths: Column, profile: Column) -> Column:
    """One user message: a part for each image, then the prompt."""
    part = "struct<type:string,image:string,text:string>"
    null = F.lit(None).cast("string")
    images = F.transform(image_paths, lambda p: F.struct(F.lit("image").alias("type"), p.alias("image"), null.alias("text")).cast(part))
    text = F.array(F.struct(F.lit("text").alias("type"), null.alias("image"), prompt_text(question, profile).alias("text")).cast(part))
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(images, text).alias("content")))
