import json
import wave

import pytest
from pyspark.sql import functions as F

from conftest import base_row, manifest_of
from voxloom.operators import stats
from voxloom.sources import manifest, media, tables


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_strict_scan(spark, tmp_path):
    good = base_row(transcript="naïve 你好")
    short = {k: v for k, v in base_row().items() if k != "split"}
    lines = [json.dumps(good, ensure_ascii=False), "", "   ", json.dumps({**good, "extra": 1}), json.dumps(short), "[1]", "{broken"]
    path = write(tmp_path / "m.jsonl", "\n".join(lines))
    rows = manifest.scan_manifest(spark, path)
    assert sorted(str(r.problem) for r in rows.collect()) == ["None", "missing_field", "not_an_object", "not_an_object", "unknown_field"]
    bad = {r.problem: r.detail for r in manifest.quarantine(rows).collect()}
    assert bad["unknown_field"] == "extra" and bad["missing_field"] == "split"
    with pytest.raises(Exception, match="m.jsonl"):
        manifest.load_manifest(spark, path).collect()


def test_optional_fields_may_be_absent(spark, tmp_path):
    row = {k: v for k, v in base_row().items() if k not in ("country", "intensity")}
    path = write(tmp_path / "m.jsonl", json.dumps(row))
    assert manifest.load_manifest(spark, path).first().country is None


def test_empty_manifest_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        manifest.load_manifest(spark, write(tmp_path / "m.jsonl", "\n \n"))


def test_manifest_sink_is_sorted_and_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    df = manifest_of(spark, [base_row(sample_id="b"), base_row(sample_id="a", transcript="你好")])
    manifest.write_manifest(df, path)
    lines = [x.value for x in spark.read.text(path).collect()]
    first = json.loads(lines[0])
    assert list(first) == sorted(first) and first["country"] is None and "你好" in lines[0]
    assert [r.sample_id for r in manifest.load_manifest(spark, path).collect()] == ["a", "b"]


def test_dimension_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", "ActorID,Age,Sex\n1001,20,Male\n 1002 ,30,\n1001,20,Female\n", "utf-8-sig")
    got = tables.read_dimension(spark, path, "ActorID", "Sex", ["ActorID", "Age", "Sex"]).collect()
    assert {r.ActorID: r.Sex for r in got} == {"1001": "Female", "1002": "unknown"}
    bad = write(tmp_path / "e.csv", "ActorID,Age,Sex\n,20,Male\n")
    with pytest.raises(Exception, match="empty ActorID"):
        tables.read_dimension(spark, bad, "ActorID", "Sex", ["ActorID", "Age", "Sex"]).collect()


def test_key_list_csv(spark, tmp_path):
    path = write(tmp_path / "k.csv", "N,Filename\n1,1001_dfa_ang_xx\n2,1001_DFA_ANG_XX\n3, \n")
    assert [r.key for r in tables.read_key_list(spark, path, "Filename", ["N", "Filename"]).collect()] == ["1001_DFA_ANG_XX"]


def test_annotation_tree_one_document_per_file(spark, tmp_path):
    root = tmp_path / "json"
    doc = {
        "data": {"p1": {"emotion": "happy", "Confidence_degree": "3"}}, "speaker_id": "A", "emotion_result": "happy",
        "content": "你好", "paragraphs": {"startTime": 0.0, "endTime": 1.0, "duration": 1.0}, "file_path": "G1/D1/D1_A/x.wav",
    }
    write(root / "G1" / "D1" / "D1_A" / "x.json", json.dumps(doc, indent=2, ensure_ascii=False))
    write(root / "G1" / "D1" / "D1_A" / "notes.txt", "no")
    got = tables.read_annotations(spark, str(root)).collect()
    assert len(got) == 1 and got[0].relative_path == "G1/D1/D1_A/x.json"
    assert got[0].data["p1"].emotion == "happy" and got[0].paragraphs.duration == 1.0


def test_majority_accepts_ties_and_skips_records_without_votes(spark):
    votes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], ["r", "v"])
    finals = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a")], ["r", "f"])
    got = stats.majority_agreement(votes, "r", "v", finals, "f").first()
    assert (got.records_with_votes, got.in_majority, got.rate) == (2, 1, 0.5)


def wav(path, channels=1, rate=8000, frames=160, value=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(int(value).to_bytes(2, "little", signed=True) * frames * channels)


def test_wav_files(spark, tmp_path):
    wav(tmp_path / "a.wav")
    wav(tmp_path / "b.wav", 2, 44100, 882, 16384)
    (tmp_path / "c.wav").write_bytes(b"")
    (tmp_path / "d.wav").write_bytes(b"RIFFnope" * 10)
    files = media.read_media(spark, str(tmp_path), "*.wav").withColumn("path", F.element_at(F.split("path", "/"), -1))
    head = {r.path: r for r in media.wav_header(files).collect()}
    assert (head["b.wav"].channels, head["b.wav"].sample_rate, head["b.wav"].frames) == (2, 44100, 882)
    assert head["a.wav"].duration == pytest.approx(0.02) and head["b.wav"].duration == pytest.approx(0.02)
    problems = {r.path: r.problem for r in media.media_problem(files, "audio").collect()}
    assert problems == {"a.wav": None, "b.wav": None, "d.wav": "corrupt"}  # file sources skip empty files
    rows = [base_row(sample_id=x, audio_available=True, audio_path=f"{x}.wav") for x in "abcde"]
    found = media.media_issues(manifest_of(spark, rows), media.media_problem(files, "audio"), "audio", str(tmp_path))
    assert {r.sample_id: r.code for r in found.collect()} == {"c": "empty_audio", "d": "corrupt_audio", "e": "missing_audio"}
    profile = {r.path: r for r in media.audio_profile(files).collect()}
    assert profile["b.wav"].rms == pytest.approx(0.5) and profile["b.wav"].samples == 320
    assert profile["a.wav"].samples == 320 and profile["d.wav"].error
    present = {r.path: r.present for r in media.inventory(files, 44).collect()}
    assert present == {"a.wav": True, "b.wav": True, "d.wav": True}


def test_video_containers(spark, tmp_path):
    (tmp_path / "a.flv").write_bytes(b"FLV" + bytes(300))
    (tmp_path / "b.mp4").write_bytes(bytes(4) + b"ftypisom")
    (tmp_path / "c.avi").write_bytes(b"RIFF0000WAVE")
    (tmp_path / "d.txt").write_bytes(b"FLV")
    files = media.read_media(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {r.path: r.problem for r in media.media_problem(files, "video").collect()}
    assert got == {"a.flv": None, "b.mp4": None, "c.avi": "corrupt", "d.txt": "unsupported_container"}


def test_metric_records(spark, tmp_path):
    def record(value, **more):
        few = {k: {m: {"mean": value, "std": 0.0, "ci95_low": 0.0, "ci95_high": 1.0} for m in ("uar", "macro_f1", "accuracy")} for k in ("1", "5")}
        return json.dumps({"uar": value, "macro_f1": value, "accuracy": value, "paper_ready": True, "synthetic": False, "few_shot": few, **more})

    write(tmp_path / "ok" / "a.json", record(0.4))
    write(tmp_path / "ok" / "b.json", record(0.6))
    long = tables.long_metric_records(tables.read_metric_records(spark, str(tmp_path / "ok")))
    out = {(r.k, r.metric): r for r in stats.run_aggregate(long, "run", "zero-shot").collect()}
    assert out[(None, "uar")].mean == pytest.approx(0.5) and out[(5, "accuracy")].n == 2
    assert all(r.complete and r.protocol == "zero-shot" for r in out.values())
    write(tmp_path / "mix" / "a.json", record(0.4, protocol="x"))
    write(tmp_path / "mix" / "b.json", record(0.6, protocol="y"))
    mixed = tables.long_metric_records(tables.read_metric_records(spark, str(tmp_path / "mix")))
    with pytest.raises(Exception, match="several values of protocol"):
        stats.run_aggregate(mixed, "run").collect()
    with pytest.raises(Exception, match="conflicts"):
        stats.run_aggregate(mixed, "run", "x").collect()
