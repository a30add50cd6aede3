import math

import pytest
from pyspark.sql import functions as F

from polyscope.functions import measures, paths, text
from polyscope.functions.constants import LABELS, LANGUAGES


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_constants():
    assert LANGUAGES == ("en", "zh", "fr", "ru", "ja", "th") and LABELS == ("A", "B", "C", "D")


def test_parse_label(spark):
    cases = {"B": "B", "Answer: C": "C", "C. Tap the shutter button": "C", "The best answer is probably C": None, "A good choice": "A", " b ": "B", "(A).": None, "**A**": None, "A.Foo": None, "Answer：D": "D", "": None, "[B]": "B", "\x1cD　": "D", "E": None}
    assert values(spark, list(cases), text.parse_label) == list(cases.values())
    assert values(spark, [None], text.parse_label) == [None]


def test_parse_options(spark):
    cases = {
        "Q? A: one B: two C: three D: four": ("Q?", "ok", "ABCD"),
        "Q? C: x A: y B: z D: w": ("Q?", "ok", "CABD"),
        "Temp A: 5 (°C). B：b C: c D: d": ("Temp", "ok", "ABCD"),
        "Plan B: x A: a B: b C: c D: d": ("Plan B: x A: a B: b C: c D: d", "failed_duplicate_label", "BABCD"),
        "Q? A: a B: b": ("Q? A: a B: b", "failed_missing_label", "AB"),
        "Q? A: a B: b C: c D: ": ("Q?", "failed_empty_option", "ABCD"),
        "": ("", "failed_missing_label", ""),
    }
    got = values(spark, list(cases), text.parse_options)
    assert [(g.question_stem, g.option_parse_status, "".join(g.option_order)) for g in got] == list(cases.values())
    assert got[0].options == {"A": "one", "B": "two", "C": "three", "D": "four"} and got[3].options == {}
    assert got[3].option_count == 4


def test_paths(spark):
    same = ["../images/6/en/camera_en_8.jpg", "../images/6/ja/camera_ja_8.jpg", "../images/6/zh/camera_zh_8.jpg"]
    assert values(spark, same, paths.state_key) == ["6/camera_8.jpg"] * 3
    assert values(spark, ["camera-en.jpg", "", "../../images//a/./b/", "a__en__b.png"], paths.state_key) == ["camera-.jpg", ".", "a/b", "a_b.png"]
    assert values(spark, same[:1], lambda c: paths.parallel_id(F.lit("ap"), c)) == ["ap::6/camera_8.jpg"]
    assert values(spark, ["abs_el_en.jsonl", "wf_xx.jsonl", "other_en.jsonl", "wf.jsonl"], paths.file_dimension) == ["ael", "wf", "unknown", "unknown"]
    assert values(spark, ["//x", "/x", "///x"], paths.posix) == ["//x", "/x", "/x"]


def test_natural_order(spark):
    df = spark.createDataFrame([("frame_10.png",), ("frame_2.png",), ("Frame_1.png",)], "c string")
    got = df.orderBy(paths.natural_key(F.col("c"))).collect()
    assert [r.c for r in got] == ["Frame_1.png", "frame_2.png", "frame_10.png"]


def test_prompt(spark):
    assert values(spark, ["Q"], lambda c: text.prompt_text(c, F.lit("mpr_minimal_v1"))) == ["Q"]
    with pytest.raises(Exception, match="unknown prompt profile"):
        values(spark, ["Q"], lambda c: text.prompt_text(c, F.lit("nope")))


def test_measures(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5, 0.0, -1.0), (1, -1.0, -1.0, None, 0.0)], "i int, a double, b double, c double, d double")
    p = measures.normalized([F.col(x) for x in "abcd"])
    q = [F.lit(x) for x in (0.0, 0.0, 1.0, 0.0)]
    r = df.select("i", *[x.alias(n) for x, n in zip(p, "wxyz", strict=True)], measures.entropy(p).alias("e"), measures.js_divergence(p, q).alias("js"), measures.top_label(p).alias("t"), measures.margin(p).alias("m")).orderBy("i").collect()
    assert [r[0][n] for n in "wxyz"] == [0.5, 0.5, 0, 0] and [r[1][n] for n in "wxyz"] == [0.25] * 4
    assert math.isclose(r[0].e, math.log(2)) and math.isclose(r[0].js, math.log(2)) and r[0].t == "A" and r[0].m == 0
    maps = spark.sql("select map('A', 0.5D, 'B', 0.5D) p, map('C', 1D) q, map() e")
    m = maps.select(measures.js_divergence_maps(F.col("p"), F.col("q")).alias("js"), measures.top_label_map(F.col("p")).alias("t")).first()
    assert math.isclose(m.js, math.log(2)) and m.t == "A"


def test_vectors(spark):
    df = spark.sql("select array(3D, 4D) a, array(3D, 4D, 5D) b, array(0D, 0D) z")
    r = df.select(measures.cosine(F.col("a"), F.col("b")).alias("c"), measures.cosine(F.col("a"), F.col("z")).alias("n"), measures.norm(measures.norm_preserving_add(F.col("a"), F.col("b"), F.lit(2.0))).alias("k")).first()
    assert math.isclose(r.c, 25 / (5 * math.sqrt(50))) and r.n == 0 and math.isclose(r.k, 5)
