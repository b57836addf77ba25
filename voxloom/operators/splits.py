"""Leakage-safe splits and deterministic subsets."""

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.hashing import hash_key, hash_ranked, hash_uniform
from voxloom.schemas import SPLIT_RATIOS, SPLITS

EXACT_COMPONENTS = 13  # 3^13 assignments are enumerated by one small job


def _targets(ratios: Sequence[float]) -> list[float]:
    if len(ratios) != len(SPLITS) or any(r < 0 for r in ratios) or sum(ratios) <= 0:
        raise ValueError("three non-negative split ratios with a positive sum are required")
    total = sum(ratios)
    return [r / total for r in ratios]


def largest_remainder(total: Column, ratios: Sequence[float]) -> list[Column]:
    """Integer shares of ``total``: floors, then leftovers to the largest fractions.

    Equal fractions favour the earlier split.
    """
    shares = [total.cast("double") * F.lit(r) for r in _targets(ratios)]
    floors = [F.floor(s) for s in shares]
    fractions = [s - f for s, f in zip(shares, floors)]
    left = total - sum(floors[1:], floors[0])
    result = []
    for j, mine in enumerate(fractions):
        ahead = F.lit(0)
        for i, other in enumerate(fractions):
            if i != j:
                wins = (other >= mine) if i < j else (other > mine)
                ahead = ahead + wins.cast("int")
        result.append(floors[j] + (ahead < left).cast("int"))
    return result


def split_by_rank(rank: str, size: str, ratios: Sequence[float]) -> Column:
    """Split name of the ``rank``-th (1-based) of ``size`` groups."""
    train, validation, _ = largest_remainder(F.col(size), ratios)
    return (
        F.when(F.col(rank) <= train, SPLITS[0])
        .when(F.col(rank) <= train + validation, SPLITS[1])
        .otherwise(SPLITS[2])
    )


def stratified_group_split(
    groups: DataFrame, group: str, stratum: str, seed: int = 17,
    ratios: Sequence[float] = SPLIT_RATIOS,
) -> DataFrame:
    """Give every group to one split while keeping the stratum shares."""
    named = F.lower(F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("unknown")))
    present = F.coalesce(F.length(F.col(group).cast("string")) > 0, F.lit(False))
    guarded = groups.select(
        F.when(present, F.col(group)).otherwise(
            F.raise_error("group id cannot be empty").cast(groups.schema[group].dataType)
        ).alias(group),
        named.alias(stratum),
    )
    keyed = guarded.withColumn("_h", hash_key(seed, F.col(group)))
    ranked = hash_ranked(keyed, [stratum], "_h", group)
    return ranked.select(group, stratum, split_by_rank("rn", "n", ratios).alias("split"))


def balanced_pilot(
    assigned: DataFrame, group: str, stratum: str, counts: Mapping[str, int], seed: int = 17,
) -> DataFrame:
    """Per split, N groups taken in turn from the strata, the largest stratum first.

    Both ``row_number() <= N`` filters reach Spark's window group limit, so each task
    keeps at most N rows per stratum before anything is shuffled.
    """
    per_split = F.element_at(
        F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("split")
    )
    most = max(counts.values())
    wanted = assigned.where(F.col("split").isin(list(counts)))
    sizes = wanted.groupBy("split", stratum).agg(F.count(F.lit(1)).alias("_size"))
    in_stratum = Window.partitionBy("split", stratum).orderBy("_h", group)
    heads = (
        wanted.withColumn("_h", hash_key(seed + 1000, F.col(group)))
        .withColumn("_turn", F.row_number().over(in_stratum))
        .where(F.col("_turn") <= most)
        .join(sizes, ["split", stratum])
    )
    in_split = Window.partitionBy("split").orderBy("_turn", F.col("_size").desc(), stratum)
    return (
        heads.withColumn("_pick", F.row_number().over(in_split))
        .where(F.col("_pick") <= most)
        .where(F.col("_pick") <= per_split)
        .select(group, stratum, "split", F.col("_pick").alias("pick"))
    )


def hash_topk(df: DataFrame, keys: list[str], sample_id: str, k: int, seed: int = 17) -> DataFrame:
    """The k rows of every group with the smallest sha256("seed:id")."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(*keys).orderBy(hash_key(seed, F.col(sample_id)), sample_id)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_shortfall(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Groups that cannot supply k rows (the selection must then be refused)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``, with partial aggregation instead of a window."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*")


def component_table(
    members: DataFrame, component: str, speaker: str, label: str, labels: Sequence[str],
) -> DataFrame:
    """Per component: number of speakers, first speaker, rows of each approved label.

    Speakers without an approved row still count, like rows of excluded labels do not.
    """
    per_speaker = members.groupBy(component, speaker).agg(
        *[F.count(F.when(F.col(label) == v, 1)).alias(f"n_{i}") for i, v in enumerate(labels)]
    )
    return per_speaker.groupBy(component).agg(
        F.count(F.lit(1)).alias("speakers"),
        F.min(speaker).alias("first_speaker"),
        *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(labels))],
    )


def component_split(
    components: DataFrame, component: str, label_count: int,
    ratios: Sequence[float] = SPLIT_RATIOS, method: str = "exact", head_size: int = EXACT_COMPONENTS,
) -> DataFrame:
    """Assign whole components to three splits with the least balance error.

    ``components`` comes from :func:`component_table`.  ``exact`` enumerates all 3^n
    assignments in one Spark job and refuses more than ``EXACT_COMPONENTS`` components.
    ``hashed_tail`` does so for the ``head_size`` largest (by speakers, then first speaker);
    the others are placed by hash share first and enter the score as fixed counts.  The
    caller chooses; the number of components never does.
    """
    if method not in ("exact", "hashed_tail"):
        raise ValueError(f"unsupported method: {method}")
    most = EXACT_COMPONENTS + 1 if method == "exact" else head_size
    spark = components.sparkSession
    targets = _targets(ratios)
    counts = [f"n_{i}" for i in range(label_count)]
    order = [F.col("speakers").desc(), F.col("first_speaker").asc()]
    head = components.orderBy(*order).limit(most).collect()  # a few short rows
    if method == "exact" and len(head) > EXACT_COMPONENTS:
        raise ValueError(f"more than {EXACT_COMPONENTS} components: choose hashed_tail")
    if len(head) < len(SPLITS):
        raise ValueError("at least three components are required")
    head_ids = [r[component] for r in head]
    rest = components.where(~F.col(component).isin(head_ids))
    u = hash_uniform(17, F.col(component))
    rest = rest.withColumn(
        "_split", F.when(u < targets[0], 0).when(u < targets[0] + targets[1], 1).otherwise(2)
    )
    tail = {
        r["_split"]: r
        for r in rest.groupBy("_split")
        .agg(F.sum("speakers").alias("speakers"), *[F.sum(c).alias(c) for c in counts])
        .collect()
    }

    n = len(head)
    # One row per assignment with the totals of its three splits.  Counts per component are
    # literals (a few short rows), summed per split inside the row.
    fields = ["speakers", *counts]
    facts = F.array(*[F.array(*[F.lit(int(r[f])).cast("bigint") for f in fields]) for r in head])
    fixed = F.array(
        *[F.array(*[F.lit(int(tail[s][f] or 0) if s in tail else 0).cast("bigint") for f in fields]) for s in range(3)]
    )
    powers = F.array(*[F.lit(3 ** (n - 1 - i)).cast("bigint") for i in range(n)])
    digits = F.transform(powers, lambda p: (F.floor(F.col("id") / p) % 3).cast("int"))
    space = spark.range(3**n).select("id", digits.alias("d"))
    space = space.where((F.get("d", F.lit(0)) == 0) & (F.size(F.array_distinct("d")) == 3))

    def totals(split: int) -> Column:
        rows = F.filter(facts, lambda _, i: F.get("d", i) == split)
        return F.aggregate(rows, F.get(fixed, F.lit(split)), lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y))

    def added(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    sums = space.select("id", F.array(*[totals(s) for s in range(3)]).alias("t"))
    parts = sums.select(
        "id",
        F.transform("t", lambda x: x[0]).alias("people"),
        F.transform("t", lambda x: F.slice(x, 2, label_count)).alias("cells"),
    ).withColumn("rows", F.transform("cells", added))
    feasible = (F.get("rows", F.lit(0)) >= F.array_max("rows")) & F.forall(
        "cells", lambda c: F.forall(c, lambda x: x > 0)
    )
    valid = parts.where(feasible).withColumns(
        {
            "n_rows": added(F.col("rows")).cast("double"), "n_people": added(F.col("people")).cast("double"),
            "overall": F.aggregate(
                "cells", F.array_repeat(F.lit(0).cast("bigint"), label_count),
                lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y),
            ),
        }
    )

    def squares(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)

    goal = F.array(*[F.lit(t) for t in targets])
    sample_error = squares(F.zip_with("rows", goal, lambda x, t: x / F.col("n_rows") - t))
    speaker_error = squares(F.zip_with("people", goal, lambda x, t: x / F.col("n_people") - t))
    class_error = squares(
        F.flatten(
            F.zip_with(
                "cells", "rows",
                lambda c, m: F.zip_with(c, F.col("overall"), lambda x, o: x / m - o / F.col("n_rows")),
            )
        )
    )
    score = sample_error + F.lit(0.05) * class_error + F.lit(0.01) * speaker_error
    best = valid.agg(F.min(F.struct(F.round(score, 15).alias("score"), "id")).alias("best")).first()
    if best is None or best["best"] is None:
        raise ValueError("no three-way component split contains every label")
    chosen, value = best["best"]["id"], best["best"]["score"]
    placed = spark.createDataFrame(
        [(cid, SPLITS[chosen // 3 ** (n - 1 - i) % 3]) for i, cid in enumerate(head_ids)],
        [component, "split"],
    )
    names = F.array(*[F.lit(s) for s in SPLITS])
    others = rest.select(component, F.element_at(names, F.col("_split") + 1).alias("split"))
    return placed.unionByName(others).select(
        component, "split", F.lit(float(value)).alias("score"), F.lit(method).alias("method")
    )


def class_subsets(n_classes: int, n_way: int) -> list[tuple[int, ...]]:
    """All class combinations of one episode size, in lexicographic order."""
    return list(combinations(range(n_classes), n_way))
