import itertools

import pytest
from pyspark.sql import functions as F

from voxloom.functions import vectors as V
from voxloom.operators import assemble, pooling, prototypes, records


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("count,k,want", [(67, 8, [0, 9, 19, 28, 38, 47, 57, 66]), (3, 8, [0, 1, 2]), (9, 1, [4]), (1, 8, [0])])
def test_uniform_indices(spark, count, k, want):
    assert one(spark.range(1).select(pooling.uniform_indices(F.lit(count), k))) == want


def test_weighted_segment_mean(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 3), (0, [5.0, 6.0], 1), (1, [20.0, 30.0], 2)], ["o", "v", "n"])
    got = {r.o: list(r.pooled) for r in pooling.weighted_segment_mean(df, "o", "v", "n").collect()}
    assert got == {0: [2.0, 3.0], 1: [20.0, 30.0]}


def test_masked_mean_ignores_padding(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], True), (0, [3.0, 4.0], True), (0, [100.0, 200.0], False)], ["o", "v", "m"])
    assert list(pooling.masked_mean(df, "o", "v", "m").first().pooled) == [2.0, 3.0]
    empty = df.withColumn("m", F.lit(False))
    with pytest.raises(Exception, match="no valid step"):
        pooling.masked_mean(empty, "o", "v", "m").collect()


def test_last_step_for_either_padding(spark):
    rows = [("left", p, f"v{p}", p >= 1) for p in range(3)] + [("right", p, f"v{p}", p <= 1) for p in range(3)]
    df = spark.createDataFrame(rows, ["o", "p", "v", "m"])
    got = {r.o: r.v for r in pooling.last_step(df, "o", "p", "m", ["v"]).collect()}
    assert got == {"left": "v2", "right": "v1"}


def test_segments(spark):
    df = spark.createDataFrame([("a", 25), ("b", 10), ("c", 0)], ["k", "n"])
    chunks = [(r.k, r.start, r.end) for r in pooling.segments(df, "k", "n", 10, 5, "chunk").orderBy("k", "start").collect()]
    assert chunks == [("a", 0, 10), ("a", 5, 15), ("a", 10, 20), ("a", 15, 25), ("a", 20, 25), ("b", 0, 10)]
    with pytest.raises(Exception, match="exceeds the maximum"):
        pooling.segments(df, "k", "n", 10, 0, "reject").collect()
    with pytest.raises(ValueError):
        pooling.segments(df, "k", "n", 10, 10, "chunk")


PATTERNS = [p for p in itertools.product([False, True], repeat=3) if any(p)]


@pytest.mark.parametrize("mask", PATTERNS)
def test_masked_softmax_and_equal_weights(spark, mask):
    m = F.array(*[F.lit(x) for x in mask])
    row = spark.range(1).select(
        pooling.masked_softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(50.0)), m).alias("s"), pooling.equal_weights(m).alias("e")
    ).first()
    for w in (row.s, row.e):
        assert sum(w) == pytest.approx(1.0)
        assert all(x == 0.0 for x, on in zip(w, mask) if not on)


def test_all_masked_is_an_error(spark):
    with pytest.raises(Exception, match="all modalities are masked"):
        spark.range(1).select(pooling.masked_softmax(F.array(F.lit(1.0)), F.array(F.lit(False)))).collect()


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99])
def test_dropout_never_adds_and_never_empties(spark, p):
    rows = [(f"s{i}", *m) for i, m in enumerate(PATTERNS * 20)]
    df = spark.createDataFrame(rows, ["sample_id", "audio_available", "text_available", "visual_available"])
    out = df.select(records.mask_column().alias("m"), assemble.modality_dropout(records.mask_column(), F.col("sample_id"), p).alias("k"))
    for r in out.collect():
        assert any(r.k) and all(m or not k for m, k in zip(r.m, r.k))
        if p == 0.0:
            assert r.k == r.m


def test_modality_names():
    assert assemble.stress_scenarios(["audio", "text", "visual"]) == [
        ("audio",), ("text",), ("visual",), ("text", "visual"), ("audio", "visual"), ("audio", "text"),
    ]
    assert assemble.stress_scenarios(["audio", "visual"]) == [("audio",), ("visual",)]
    for bad in ([], ["audio", "audio"], ["smell"]):
        with pytest.raises(ValueError):
            assemble.check_modalities(bad)


def test_nearest_prototype_and_loss(spark):
    support = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0])], ["label", "v"])
    query = spark.createDataFrame([(0, [1.0, 0.2]), (1, [0.1, 1.0])], ["label", "v"])
    protos = prototypes.class_prototypes(support, "label", "v")
    for distance in ("cosine", "squared_euclidean"):
        got = prototypes.nearest_prototype(query, protos, "label", "v", distance=distance)
        assert all(r.prediction == r.label and r.loss >= 0 for r in got.collect())
    stranger = query.withColumn("label", F.lit(7))
    with pytest.raises(Exception, match="absent from the support"):
        prototypes.prototype_loss(prototypes.nearest_prototype(stranger, protos, "label", "v")).collect()


def test_contrastive_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, "a", 0, [1.0, 0.0]), (0, "b", 1, [0.0, 1.0])], ["e", "id", "y", "v"])
    anchors = prototypes.contrastive_anchors(df, "e", "id", "y", "v", 0.1)
    assert prototypes.contrastive_loss(anchors, "e").first().contrastive_loss == 0.0


def test_normalize_and_distances(spark):
    row = spark.range(1).select(
        V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.l2_normalize(F.array(F.lit(0.0))).alias("z"),
        V.squared_euclidean(F.array(F.lit(1.0)), F.array(F.lit(3.0))).alias("d"),
    ).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0] and row.d == 4.0


def test_padding_per_batch(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0]), (1, [5.0])], ["b", "s"])
    got = sorted((r.b, list(r.s), list(r.step_mask)) for r in pooling.pad_sequences(df, "s", ["b"]).collect())
    assert got == [(0, [1.0, 0.0], [True, False]), (0, [1.0, 2.0], [True, True]), (1, [5.0], [True])]
