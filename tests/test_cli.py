"""The commands over a small release on disk, the model boundary and image headers."""

import json
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyscope import cli
from polyscope.functions.constants import DIMENSION_PREFIXES, LANGUAGES
from polyscope.operators import manifest, models, runs, validate
from polyscope.sources import files

STATES = 3


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(width, height, turn=1):
    tiff = b"MM\0\x2a" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, turn, 0)
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xdb\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\0\xff\xd9"


def webp(kind, width, height):
    body = {"VP8X": b"\0\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"), "VP8L": b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"\0" * 5, "VP8 ": b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height)}[kind]
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind.encode() + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def release(tmp_path_factory):
    root = tmp_path_factory.mktemp("release")
    (root / "qas").mkdir()
    (root / "README.md").write_text("---\nlicense: mit\n---\n")
    for prefix in DIMENSION_PREFIXES.values():
        for language in LANGUAGES:
            rows = []
            for i in range(STATES):
                question = f"What is {i}? A: one B: two C: three D: four"
                if prefix.startswith("knowledge"):
                    folder = root / "images" / "rich" / language / f"ep_{language}_{prefix}{i}"
                    folder.mkdir(parents=True)
                    for n in (10, 2, 1):
                        (folder / f"frame_{n}.png").write_bytes(png(4 * n, 30))
                    rows.append({"question": question, "answer": "B", "image_folder_path": f"../images/rich/{language}/ep_{language}_{prefix}{i}"})
                else:
                    path = root / "images" / "1" / language / f"{prefix}_{language}_{i}.jpg"
                    path.parent.mkdir(parents=True, exist_ok=True)
                    path.write_bytes(jpeg(56, 28, 6 if i == 0 else 1))
                    rows.append({"question": question, "answer": "Answer: A", "image_path": f"../images/1/{language}/{prefix}_{language}_{i}.jpg"})
            (root / "qas" / f"{prefix}_{language}.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return root


@pytest.fixture(scope="module")
def built(spark, release, tmp_path_factory):
    out = tmp_path_factory.mktemp("built")
    names = {"out": "m", "parallel-out": "index", "pairs-out": "pairs", "canonical-inputs-out": "canonical", "mismatch-inputs-out": "mismatch"}
    assert cli.main(["build", "--root", str(release), *[x for k, v in names.items() for x in (f"--{k}", str(out / v))]], spark) == 0
    return out


def checked(built):
    return [x for k, v in {"manifest": "m", "parallel": "index", "pairs": "pairs", "canonical-inputs": "canonical", "mismatch-inputs": "mismatch"}.items() for x in (f"--{k}", str(built / v))]


def test_build_and_validate(spark, built, capsys, monkeypatch):
    states = STATES * len(DIMENSION_PREFIXES)
    m = cli.read(spark, str(built / "m"))
    assert m.count() == 6 * states and cli.read(spark, str(built / "pairs")).count() == 30 * states == cli.read(spark, str(built / "mismatch")).count()
    frames = m.filter("is_episode").first().image_paths
    assert [x.rpartition("/")[2] for x in frames] == ["frame_1.png", "frame_2.png", "frame_10.png"]
    assert Counter(r.qas_line for r in m.filter("qas_file = 'wf_en.jsonl'").collect()) == {1: 1, 3: 1, 5: 1}
    capsys.readouterr()
    assert cli.main(["validate", *checked(built)], spark) == 1  # far fewer rows than the public release
    said = capsys.readouterr().out
    got = json.loads(said[: said.index("}\n}") + 3])
    assert got == {"ok": False, "summary": {"manifest_rows": 6 * states, "parallel_ids": states, "directed_mismatch_pairs": 30 * states, "canonical_inputs": 6 * states, "mismatch_inputs": 30 * states}}
    told = said[said.index("}\n}") + 4 :].splitlines()
    assert len(told) == 6 + 5 and told[0].startswith("manifest: unexpected number of rows in language en") and all("unexpected number" in x for x in told)
    expected = {"manifest_rows": 6 * states, "rows_per_language": states, "parallel_ids": states, "languages_per_parallel_id": 6, "directed_pairs": 30 * states, "canonical_inputs": 6 * states, "mismatch_inputs": 30 * states}
    for k, v in expected.items():
        monkeypatch.setitem(validate.RELEASE_COUNTS, k, v)
    assert cli.main(["validate", *checked(built)], spark) == 0
    parts = checked(built)
    assert cli.main(["validate", *parts[:-1], str(built / "nowhere")], spark) == 0  # inputs that aren't there aren't checked


def test_validate_names_what_is_wrong(spark, built):
    m = cli.read(spark, str(built / "m"))
    bad = m.withColumn("gold_label", F.when(F.col("qas_line") == 1, F.lit(None).cast("string")).otherwise(F.col("gold_label"))).filter("qas_file = 'wf_en.jsonl'")
    parts = {"manifest": validate.manifest_violations(bad, {**validate.RELEASE_COUNTS, "rows_per_language": STATES, "manifest_rows": STATES})}
    rows = validate.messages(parts).orderBy("place").collect()
    assert [r.rule for r in rows] == ["rows_per_language"] * 5 + ["gold_label"]
    assert rows[-1].message == f"{rows[-1].entity}: the gold label is none of A to D"


def test_mismatch_inputs_need_all_languages(spark, built):
    m = cli.read(spark, str(built / "m"))
    lacking = m.filter("not (qas_file = 'wf_fr.jsonl' and qas_line = 3)")
    assert [(r.missing) for r in manifest.incomplete_ids(lacking).collect()] == [["fr"]]
    with pytest.raises(Exception, match="no row in each language"):
        manifest.mismatch_inputs(lacking).count()
    some = m.filter("language in ('en', 'zh')")
    assert manifest.mismatch_inputs(some).count() == 2 * STATES * len(DIMENSION_PREFIXES) and manifest.incomplete_ids(some).isEmpty()
    assert manifest.mismatch_inputs(m.limit(0)).isEmpty()


def test_audit(spark, release, tmp_path, capsys):
    assert cli.main(["audit", "--root", str(release), "--json-out", str(tmp_path / "a.json"), "--markdown-out", str(tmp_path / "a.md")], spark) == 0
    found = json.loads((tmp_path / "a.json").read_text())
    assert (found["rows"], found["license"], found["missing_assets"], found["option_parse_status"]) == (6 * STATES * 8, "mit", 0, {"ok": 6 * STATES * 8})
    assert "# Release audit" in (tmp_path / "a.md").read_text()


def test_run_resumes(spark, built, tmp_path, capsys):
    config = tmp_path / "model.json"
    config.write_text(json.dumps({"adapter": "fixed_label", "model_id": "fixed", "label": "A", "generation": {"top_p": None}}))
    lock = tmp_path / "lock.json"
    lock.write_text(json.dumps({"huggingface": {"sha": "abc"}}))
    args = ["run", "--inputs", str(built / "canonical"), "--model-config", str(config), "--source-lock", str(lock), "--output", str(tmp_path / "log"), "--run-id", "r", "--languages", "en,zh", "--dimensions", "wf"]
    assert cli.main([*args, "--dry-run"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"run_id": "r", "status": "dry_run", "planned_rows": 2 * STATES, "pending_rows": 2 * STATES, "prompt_profile": "mpr_minimal_v1", "model_id": "fixed"}
    assert cli.main([*args, "--limit", "2"], spark) == 0
    assert cli.main([*args, "--resume"], spark) == 0
    rows = spark.read.json(str(tmp_path / "log")).filter("status = 'success'").collect()
    assert len(rows) == 2 * STATES and {r.dataset_hf_revision for r in rows} == {"abc"} and all(r.normalized_correct and not r.raw_string_exact for r in rows)
    assert all(r.software_versions["python"] and r.image_paths[0].startswith("/") for r in rows)
    with pytest.raises(SystemExit):
        cli.main(["run", "--no-such-option"], spark)


def test_preflight(spark, built, tmp_path, capsys):
    config = tmp_path / "model.json"
    config.write_text("{}")
    args = ["preflight", "--inputs", str(built / "canonical"), "--model-config", str(config), "--json-out", str(tmp_path / "p.json"), "--markdown-out", str(tmp_path / "p.md")]
    assert cli.main(args, spark) == 0
    summary = json.loads((tmp_path / "p.json").read_text())["summary"]
    assert summary["rows"] == 6 * STATES * 8 and summary["num_images"] == {"min": 1, "p50": 1, "p90": 3, "p95": 3, "p99": 3, "max": 3} and summary["rows_by_language"] == {x: STATES * 8 for x in sorted(LANGUAGES)}
    info = spark.read.json(str(tmp_path / "p.json.records")).filter("dimension = 'wf' and language = 'en'").orderBy("input_id").collect()
    assert [(x.image_info[0].width, x.image_info[0].height) for x in info] == [(28, 56), (56, 28), (56, 28)]
    assert "| num_images | 1 | 1 | 3 |" in (tmp_path / "p.md").read_text()
    assert cli.main([*args, "--limit", "0"], spark) == 0 and json.loads((tmp_path / "p.json").read_text())["summary"]["num_images"]["max"] is None
    with pytest.raises(ValueError, match="negative"):
        cli.main([*args, "--limit", "-1"], spark)


def test_image_headers():
    assert files.header_size(png(640, 480)) == (640, 480)
    assert files.header_size(jpeg(300, 200)) == (300, 200) and files.header_size(jpeg(300, 200, 8)) == (200, 300)
    assert all(files.header_size(webp(k, 321, 123)) == (321, 123) for k in ("VP8X", "VP8L", "VP8 "))
    assert all(files.header_size(x) is None for x in (b"", b"GIF89a", b"\xff\xd8", b"\x89PNG", b"RIFF    WEBP"))


def test_lines_of_files_in_splits(spark, tmp_path):
    """Numbers are right where a file is read in many splits."""
    for name, n, end in (("a.txt", 5000, "\n"), ("b.txt", 70, "\r\n"), ("c.txt", 1, "")):
        (tmp_path / name).write_bytes("".join(f"line {i}{end}" for i in range(1, n + 1)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5071 and all(r.line == f"line {r.qas_line}" for r in rows)


def test_model_settings():
    assert models.dtype_of("bf16") == "bfloat16" and models.given({"a": 0, "b": None}) == {"a": 0} and models.set_of("en, zh") == {"en", " zh"} and models.set_of("") is None
    with pytest.raises(KeyError):
        models.dtype_of("int4")
    assert models.hook_description(3) == "layer=3; location=block_output; positions=last_token"
    with pytest.raises(NotImplementedError):
        models.loader({"adapter": "showui", "model_id": "x"})()
    model, processor = models.parts({"dtype": "fp16", "min_pixels": 4, "max_pixels": None, "revision": None})
    assert model == {"dtype": "float16", "device_map": "auto"} and processor == {"min_pixels": 4}


def test_percentiles_of_spread_values(spark):
    values = [-(10**12), -3, -2, -2, 0, 5, 10**15, 10**15 + 1, 10**15 + 1]
    got = runs.percentiles(spark.createDataFrame([(v, None) for v in values], "a long, b long"), ["a", "b"]).collect()
    assert [(r.field, r.min, r.p50, r.p90, r.p95, r.p99, r.max) for r in got] == [("a", values[0], 0, 10**15 + 1, 10**15 + 1, 10**15 + 1, 10**15 + 1)]
