"""Inputs beyond the sizes of the tables: long ids, many components, odd headers, odd paths."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from voxloom.functions.hashing import hash_int, hash_uniform
from voxloom.functions.text import case_fold, zero_padded
from voxloom.operators import episodes, metrics, pooling, stats, store
from voxloom.sources import media, tables


def test_long_ids_are_not_cut(spark):
    df = spark.createDataFrame([(7,), (1234567890,), (12345678901234,)], ["i"])
    assert [r.p for r in df.select(zero_padded(F.col("i"), 8).alias("p")).collect()] == [
        "00000007", "1234567890", "12345678901234",
    ]


def test_case_folding_is_full(spark):
    words = ["Straße", "ΟΔΟΣ", "οδος", "ﬁn ﬂow", "ſo", "ΐ", "ŉ", "plain É"]
    got = spark.createDataFrame([(w,) for w in words], ["w"]).select(case_fold(F.col("w")).alias("f")).collect()
    assert [r.f for r in got] == [w.casefold() for w in words]


def test_hashes_use_sixty_bits(spark):
    row = spark.range(4096).select(F.max(hash_int("x", F.col("id"))).alias("m"), F.max(hash_uniform("x", F.col("id"))).alias("u")).first()
    assert 1 << 59 < row.m < 1 << 60 and 0.99 < row.u < 1


def test_labels_beyond_the_mask_are_refused(spark):
    rows = [(1, "s1", 64, "a"), (1, "s2", 0, "b")]
    df = spark.createDataFrame(rows, "task int, speaker_id string, label int, sample_id string")
    with pytest.raises(Exception, match="labels 0 to 62"):
        episodes.eligible_class_sets(df, 2, 2, 1, 1).collect()


def test_contract_check_keeps_unmatched_runs(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "f"])
    current = spark.createDataFrame([(1, "a"), (3, "c")], ["k", "f"])
    got = {r.k: (r.failing_fields, r.compatible) for r in store.contract_check(stored, current, "k", ["f"]).collect()}
    assert got == {1: ("", True), 2: ("missing_data", False), 3: ("missing_run", False)}


def test_replaced_vectors_are_read_once(spark):
    texts = spark.createDataFrame([("a", "one")], ["sample_id", "transcript"])
    digest = texts.select(F.sha2("transcript", 256)).first()[0]
    rows = [(digest, [1.0, 2.0]), (digest, [1.0, 2.0, 3.0, 4.0]), (digest, [float("nan")] * 4), (digest, [0.0] * 4)]
    stored = spark.createDataFrame(rows, "key_hash string, embedding array<float>")
    got = store.cache_index(texts, "transcript", stored, dim=4).collect()
    assert [(r.sample_id, r.embedding_dimension) for r in got] == [("a", 4)]


@pytest.mark.parametrize("pool", [pooling.statistics_pool, pooling.attentive_pool])
def test_variance_survives_an_offset(spark, pool):
    values = [1e6 - 0.01, 1e6, 1e6 + 0.01]
    steps = spark.createDataFrame([("o", [v], True) for v in values], "owner string, v array<double>, m boolean")
    mean, std = pool(steps, "owner", "v", "m").first().pooled
    energy = [v * v for v in values]
    weights = [1.0] * 3 if pool is pooling.statistics_pool else [math.exp(e - max(energy)) for e in energy]
    total = sum(weights)
    centre = sum(w * v for w, v in zip(weights, values)) / total
    spread = sum(w * (v - centre) ** 2 for w, v in zip(weights, values)) / total
    assert mean == pytest.approx(centre) and std == pytest.approx(max(spread, 1e-8) ** 0.5, rel=1e-6)


def test_runs_with_other_shot_counts_or_modes_are_refused(spark):
    schema = "run string, protocol string, training_mode string, synthetic boolean, paper_ready boolean, k int, metric string, value double"
    row = lambda run, k, mode=None: (run, "p", mode, False, True, k, "uar", 0.5)
    good = spark.createDataFrame([row("a", 1), row("b", 1), row("a", None), row("b", None)], schema)
    assert all(r.complete for r in stats.run_aggregate(good, "run").collect())
    for rows, what in (([row("a", 1), row("b", 5)], "shot counts"), ([row("a", 1), row("b", 1, "meta")], "training_mode")):
        with pytest.raises(Exception, match=f"several values of {what}"):
            stats.run_aggregate(spark.createDataFrame(rows, schema), "run").collect()


def riff(*chunks):
    body = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def form(tag=1, bits=16, more=b""):
    return b"fmt ", struct.pack("<HHIIHH", tag, 1, 8000, 16000, 2, bits) + more


def test_wav_chunks_and_formats(spark):
    data = (b"data", struct.pack("<4h", 0, 100, -100, 32767))
    extensible = struct.pack("<HHIH", 22, 16, 4, 1) + b"\0" * 14
    files = {
        "plain": riff(form(), data), "list": riff(form(), (b"LIST", b"data!"), data), "first": riff((b"junk", b"x" * 7), form(), data),
        "extensible": riff(form(0xFFFE, 16, extensible), data), "float": riff(form(3, 32), data), "odd": riff(form(1, 12), data),
        "no_format": riff(data), "short": b"RIFF", "empty_data": riff(form(), (b"data", b"")),
    }
    df = spark.createDataFrame([(f"{n}.wav", len(c), bytearray(c)) for n, c in files.items()], "path string, length long, content binary")
    head = {r.path[:-4]: r for r in media.wav_header(df).collect()}
    assert {n for n, r in head.items() if not r.decodable} == {"float", "no_format", "short"}
    assert head["odd"].sample_width == 2 and head["list"].frames == 4
    problems = {r.path[:-4] for r in media.media_problem(df, "audio").collect() if r.problem}
    assert problems == {"float", "no_format", "short", "empty_data"}
    profile = {r.path[:-4]: r for r in media.audio_profile(df, 8000).collect()}
    assert profile["list"].samples == 4 and profile["list"].peak == pytest.approx(32767 / 32768)
    assert profile["float"].error and profile["extensible"].error is None


def test_annotation_paths_are_decoded_and_cut_by_length(spark, tmp_path):
    root = tmp_path / "a+b [x]" / "json"
    for name in ("json/d 1/x.json", "é/100%25/y+z.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(json.dumps({"speaker_id": name}))
    link = tmp_path / "plain"
    link.symlink_to(root)
    got = {r.relative_path for r in tables.read_annotations(spark, str(link)).collect()}
    assert got == {"json/d 1/x.json", "é/100%25/y+z.json"}


def test_metrics_grid_grows_with_classes_only(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("b", 1, 1)], ["s", "t", "p"])
    plan = metrics.per_class_metrics(df, "t", "p", 500, ["s"])
    assert plan.count() == 1000 and plan.where("support > 0").count() == 3
