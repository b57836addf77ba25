import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from voxloom.functions.hashing import hash_key, hash_ranked
from voxloom.operators import splits
from voxloom.schemas import SPLITS


@pytest.fixture(scope="module")
def actors(spark):
    rows = [(f"{1000 + i}", "Male" if i < 48 else "Female") for i in range(91)]
    return spark.createDataFrame(rows, ["actor", "sex"])


def test_stratified_counts(actors):
    got = Counter((r.split, r.sex) for r in splits.stratified_group_split(actors, "actor", "sex").collect())
    assert got == {
        ("train", "male"): 34, ("train", "female"): 30, ("validation", "male"): 7, ("validation", "female"): 7,
        ("test", "male"): 7, ("test", "female"): 6,
    }


def test_split_does_not_depend_on_partitioning(actors):
    a = splits.stratified_group_split(actors.repartition(1), "actor", "sex").collect()
    b = splits.stratified_group_split(actors.repartition(7), "actor", "sex").collect()
    assert sorted(a) == sorted(b)
    c = splits.stratified_group_split(actors, "actor", "sex", seed=18).collect()
    assert sorted(a) != sorted(c)


def test_balanced_pilot(actors):
    assigned = splits.stratified_group_split(actors, "actor", "sex")
    pilot = splits.balanced_pilot(assigned, "actor", "sex", {"train": 8, "validation": 2, "test": 2}).collect()
    assert Counter(r.split for r in pilot) == {"train": 8, "validation": 2, "test": 2}
    assert Counter((r.split, r.sex) for r in pilot)[("train", "male")] == 4


def test_empty_group_is_an_error(spark):
    df = spark.createDataFrame([("", "x")], ["actor", "sex"])
    with pytest.raises(Exception, match="group id cannot be empty"):
        splits.stratified_group_split(df, "actor", "sex").collect()


def test_hash_ranked_equals_a_window(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g")).withColumn("h", hash_key(1, F.col("id")))
    mine = hash_ranked(df, ["g"], "h", "id").select("g", "id", "rn", "n")
    w = Window.partitionBy("g")
    plain = df.select("g", "id", F.row_number().over(w.orderBy("h", "id")).alias("rn"), F.count("*").over(w).alias("n"))
    assert mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0


def test_topk_shortfall(spark):
    df = spark.createDataFrame([("train", "a", "1"), ("train", "b", "2"), ("train", "a", "3")], ["split", "label", "sample_id"])
    assert [r.label for r in splits.topk_shortfall(df, ["split", "label"], 2).collect()] == ["b"]
    assert splits.hash_topk(df, ["split", "label"], "sample_id", 2).count() == 3


def _brute(comps, ratios=(0.7, 0.15, 0.15)):
    """Plain enumeration over (speakers, counts per label)."""
    total = sum(sum(c) for _, c in comps)
    labels = range(len(comps[0][1]))
    overall = [sum(c[j] for _, c in comps) / total for j in labels]
    people = sum(s for s, _ in comps)
    best = None
    for a in itertools.product(range(3), repeat=len(comps)):
        cells = [[sum(c[j] for (_, c), x in zip(comps, a) if x == s) for j in labels] for s in range(3)]
        n = [sum(c) for c in cells]
        if set(a) != {0, 1, 2} or a[0] or n[0] < max(n) or any(v == 0 for c in cells for v in c):
            continue
        who = [sum(s for (s, _), x in zip(comps, a) if x == t) for t in range(3)]
        score = sum((n[i] / total - ratios[i]) ** 2 for i in range(3))
        score += 0.05 * sum((cells[i][j] / n[i] - overall[j]) ** 2 for i in range(3) for j in labels)
        score += 0.01 * sum((who[i] / people - ratios[i]) ** 2 for i in range(3))
        best = min(best, (round(score, 15), a)) if best else (round(score, 15), a)
    return best


def _components(spark, comps):
    rows = [(i, s, f"s{i:02}", *map(int, c)) for i, (s, c) in enumerate(comps)]
    cols = ["component", "speakers", "first_speaker", *[f"n_{j}" for j in range(len(comps[0][1]))]]
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("seed", [1, 2])
def test_component_split_is_optimal(spark, seed):
    rng = random.Random(seed)
    comps = [(9 - i, [rng.randint(1, 30) for _ in range(3)]) for i in range(6)]
    score, assignment = _brute(comps)
    got = {r.component: r for r in splits.component_split(_components(spark, comps), "component", 3).collect()}
    assert [SPLITS.index(got[i].split) for i in range(6)] == list(assignment)
    assert got[0].score == pytest.approx(score, abs=1e-12) and got[0].method == "exact"


def test_component_split_places_every_component_beyond_the_exact_ones(spark):
    rng = random.Random(3)
    comps = [(40 - i, [rng.randint(1, 9) for _ in range(3)]) for i in range(30)]
    got = splits.component_split(_components(spark, comps), "component", 3, method="hashed_tail", head_size=6).collect()
    with pytest.raises(ValueError, match="hashed_tail"):
        splits.component_split(_components(spark, comps), "component", 3)
    assert {r.component for r in got} == set(range(30)) and len(got) == 30
    assert {r.method for r in got} == {"hashed_tail"} and {r.split for r in got} == set(SPLITS)


def test_component_split_needs_three(spark):
    with pytest.raises(ValueError, match="three components"):
        splits.component_split(_components(spark, [(1, [1, 1]), (1, [1, 1])]), "component", 2)
