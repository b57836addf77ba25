from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import base_row, manifest_of
from voxloom.operators import assemble, episodes, graph, metrics, stats
from voxloom.schemas import EMOTION_LABELS


def preds(spark, targets, predictions):
    return spark.createDataFrame(list(zip(targets, predictions)), ["t", "p"])


def test_metrics(spark):
    got = metrics.classification_metrics(preds(spark, [0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 1, 2, 0, 3, 3]), "t", "p", 4).first()
    assert got.uar == pytest.approx(0.75) and got.accuracy == pytest.approx(0.75)


def test_absent_classes_count_as_zero(spark):
    got = metrics.classification_metrics(preds(spark, [0, 0], [0, 0]), "t", "p", 4).first()
    assert (got.uar, got.macro_f1, got.accuracy, got.n) == (0.25, 0.25, 1.0, 2)


def test_out_of_range_class(spark):
    with pytest.raises(Exception, match="outside the configured range"):
        metrics.classification_metrics(preds(spark, [0], [4]), "t", "p", 4).collect()


def test_association_of_tied_attributes(spark):
    df = spark.createDataFrame([("p", "happy", "train"), ("p", "happy", "test"), ("q", "sad", "train"), ("q", "sad", None)], ["r", "c", "s"])
    got = stats.association_audit(df, "r", "c", "s").first()
    assert got.cramers_v == pytest.approx(1.0) and got.mutual_information_bits == pytest.approx(1.0)
    assert got.rows_spanning_splits == 1 and got.unique_rows == 2


def test_association_counts_unlabelled_prompts_and_zero_cells(spark):
    rows = [("p", "a", "x"), ("p", "b", "x"), ("q", "a", "x"), ("z", None, "x")]
    got = stats.association_audit(spark.createDataFrame(rows, ["r", "c", "s"]), "r", "c", "s").first()
    # Grid by hand: p/a 1 (4/3), p/b 1 (2/3), q/a 1 (2/3), q/b 0 (1/3).
    chi2 = (1 / 3) ** 2 / (4 / 3) + 2 * (1 / 3) ** 2 / (2 / 3) + 1 / 3
    assert got.chi_square == pytest.approx(chi2) and got.unique_rows == 3
    assert got.cramers_v == pytest.approx((chi2 / 3) ** 0.5)


def test_mean_ci(spark):
    one = spark.createDataFrame([(0.4,)], ["v"]).agg(*stats.mean_ci95(F.col("v"))).first()
    assert (one["mean"], one["std"], one.ci95_low, one.ci95_high) == (0.4, 0.0, 0.4, 0.4)
    wide = spark.createDataFrame([(0.0,), (1.0,)], ["v"]).agg(*stats.mean_ci95(F.col("v"))).first()
    assert (wide.ci95_low, wide.ci95_high) == (0.0, 1.0)


def test_seed_aggregate_rejects_mixed_protocols(spark):
    rows = [("e", "p1", None, True, 0.1), ("e", "p2", None, True, 0.2)]
    df = spark.createDataFrame(rows, "e string, protocol string, training_mode string, paper_ready boolean, uar double")
    with pytest.raises(Exception, match="several values of protocol"):
        stats.seed_aggregate(df, "e", ["uar"]).collect()


def test_early_stopping_needs_strict_improvement(spark):
    scores = [0.1, 0.3, 0.3, 0.2, 0.9]
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], ["run", "epoch", "score"])
    got = stats.early_stopping(df, "run", "epoch", "score", 2).first()
    assert (got.best_epoch, got.last_epoch, got.stopped_early) == (2, 4, True)
    assert stats.early_stopping(df, "run", "epoch", "score", 3).first().best_epoch == 5


def test_unseen_domains(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], ["corpus", "split"])
    assert all(r.unseen_test_verified for r in stats.domain_overlap(df, "corpus", True).collect())
    with pytest.raises(Exception, match="disjoint"):
        stats.domain_overlap(df.unionByName(df.withColumn("split", F.lit("test"))), "corpus", True).collect()


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("t", label, f"sp{s}", f"{s}-{label}-{i:02}") for s in range(4) for label in range(4) for i in range(5)]
    return spark.createDataFrame(rows, ["task", "label", "speaker_id", "sample_id"])


def test_ordinary_episodes_are_balanced_and_repeatable(pool):
    a = episodes.ordinary_episodes(pool, 3, 2, 4, 15)
    audit = episodes.episode_audit(a, 3, 2, 4).collect()
    assert len(audit) == 15 and all(r.valid for r in audit)
    b = episodes.ordinary_episodes(pool.repartition(5), 3, 2, 4, 15)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    other = episodes.ordinary_episodes(pool, 3, 2, 4, 15, seed=18)
    assert sorted(a.collect()) != sorted(other.select(a.columns).collect())


def test_every_row_can_be_drawn(pool):
    drawn = episodes.ordinary_episodes(pool, 3, 2, 4, 60).select("sample_id").distinct().count()
    assert drawn == pool.count()


def test_disjoint_episodes(pool):
    audit = episodes.episode_audit(episodes.disjoint_episodes(pool, 4, 3, 2, 4, 15), 3, 2, 4).collect()
    assert len(audit) == 15 and all(r.valid and r.speaker_overlap == 0 for r in audit)


def test_disjoint_with_one_query_candidate(spark):
    rows = [("t", y, "rich", f"r{y}{i}") for y in (0, 1) for i in range(5)] + [("t", y, "poor", f"p{y}") for y in (0, 1)]
    df = spark.createDataFrame(rows, ["task", "label", "speaker_id", "sample_id"])
    got = episodes.disjoint_episodes(df, 2, 2, 1, 3, 4).collect()
    assert {(r.role, r.speaker_id) for r in got} == {("support", "poor"), ("query", "rich")}


def test_no_eligible_task(pool):
    with pytest.raises(Exception, match="no task can satisfy"):
        episodes.ordinary_episodes(pool, 3, 50, 4, 5).collect()
    lonely = pool.where("speaker_id = 'sp0'")
    assert episodes.eligible_class_sets(lonely, 4, 3, 2, 2).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = spark.range(1, 200).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    hub = spark.range(1001, 1400).select(F.col("id").alias("src"), F.lit(1000).cast("long").alias("dst"))
    nodes = spark.range(0, 1500).select(F.col("id").alias("v"))
    got = graph.connected_components(nodes, chain.unionByName(hub), "v")
    sizes = Counter(Counter(r.component for r in got.collect()).values())
    assert sizes == {200: 1, 400: 1, 1: 900}


def _sources(spark, ids):
    audio = spark.createDataFrame([(i, [0.1, 0.2], 0.1) for i in ids], ["sample_id", "vector", "clipping_fraction"])
    text = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in ids], ["sample_id", "vector"])
    visual = spark.createDataFrame([(i, [1.0], 6) for i in ids], ["sample_id", "vector", "valid_frame_count"])
    return {"audio": audio, "text": text, "visual": visual}


def test_assembled_quality(spark):
    row = base_row(audio_available=True, audio_path="a", visual_available=True, video_path="v")
    got = assemble.assemble_examples(manifest_of(spark, [row]), _sources(spark, ["a"]), {"audio": 2, "text": 3, "visual": 1}, EMOTION_LABELS).first()
    assert [round(q, 6) for q in got.quality] == [0.9, 1.0, 0.75] and got.modality_mask == [True] * 3 and got.label == 1


def test_only_enabled_modalities_are_needed(spark):
    row = base_row(audio_available=True, audio_path="a")
    got = assemble.assemble_examples(manifest_of(spark, [row]), {"audio": _sources(spark, ["a"])["audio"]}, {"audio": 2}, EMOTION_LABELS, ["audio"]).first()
    assert got.modality_mask == [True, False, False] and got.text_vector == [0.0]


def test_missing_vector_and_missing_modality(spark):
    dims = {"audio": 2, "text": 3, "visual": 1}
    with pytest.raises(Exception, match="invalid text vector: a"):
        assemble.assemble_examples(manifest_of(spark, [base_row()]), _sources(spark, ["b"]), dims, EMOTION_LABELS).collect()
    with pytest.raises(Exception, match="no enabled available modality"):
        assemble.assemble_examples(manifest_of(spark, [base_row()]), _sources(spark, ["a"]), dims, EMOTION_LABELS, ["audio"]).collect()


def test_index_alignment(spark):
    df = manifest_of(spark, [base_row(sample_id=f"s{i}") for i in range(8)])
    index = spark.createDataFrame([("s0",), ("x",)], ["sample_id"])
    got = {r.side: r for r in assemble.index_alignment(df, index, "text_available").collect()}
    assert got["missing"].n == 7 and got["missing"].first_ids == "s1,s2,s3,s4,s5" and got["extra"].first_ids == "x"


def test_three_splits_are_required(spark):
    with pytest.raises(ValueError, match="exactly train"):
        assemble.require_splits(manifest_of(spark, [base_row()]))
