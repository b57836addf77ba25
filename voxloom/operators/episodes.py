"""Deterministic N-way K-shot episodes.

Rows are ranked once per (task, class) by hash.  An episode then names the ranks it wants
by arithmetic, a start and a stride below the group size, so a sweep costs one ranking of
the data plus a join of a few rows per episode instead of re-sorting every group per episode.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.hashing import hash_int, hash_key, hash_ranked
from voxloom.operators.splits import class_subsets
from voxloom.scratch import cut_lineage

TASK_FIELDS = ("global", "language", "corpus", "language_corpus", "speaker")


def task_key(field: str) -> Column:
    if field == "global":
        return F.lit("global")
    if field == "language_corpus":
        return F.concat_ws("|", "language", "corpus")
    if field == "speaker":
        return F.col("speaker_id")
    if field in ("language", "corpus"):
        return F.col(field)
    raise ValueError(f"unsupported task field: {field}")


def _check(n_way: int, k_shot: int, query: int, episodes: int = 1) -> None:
    if n_way <= 1 or k_shot <= 0 or query <= 0 or episodes <= 0:
        raise ValueError("episode sizes must be positive and n_way above one")


def _slots(parts: list, n: Column, count: Column | int, most: int) -> Column:
    """``count`` distinct ranks in 1..n: a hashed start and stride around the circle."""
    start = hash_int(*parts, "start") % n
    room = F.greatest(F.lit(1), F.floor((n - 1) / F.lit(max(most - 1, 1))))
    stride = F.lit(1) + hash_int(*parts, "stride") % room
    return F.transform(
        F.sequence(F.lit(0), F.lit(count) - 1 if isinstance(count, int) else count - 1),
        lambda j: F.struct(j.alias("slot"), (F.lit(1) + (start + j * stride) % n).alias("rn")),
    )


def eligible_tasks(examples: DataFrame, n_way: int, k_shot: int, query: int) -> DataFrame:
    """Tasks with at least ``n_way`` classes of ``k_shot + query`` rows, and those classes."""
    _check(n_way, k_shot, query)
    counts = examples.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))
    rich = counts.where(F.col("n") >= k_shot + query)
    return rich.groupBy("task").agg(
        F.sort_array(F.collect_list(F.struct("label", "n"))).alias("classes")
    ).where(F.size("classes") >= n_way)


def _number_tasks(tasks: DataFrame, seed: int) -> DataFrame:
    keyed = tasks.withColumn("_h", hash_key(seed, F.col("task"))).withColumn("_all", F.lit(0))
    return hash_ranked(keyed, ["_all"], "_h", "task").withColumnRenamed("rn", "task_no").drop("_h", "_all", "n")


def _pick_tasks(tasks: DataFrame, episodes: int, seed: int) -> DataFrame:
    numbered = _number_tasks(tasks, seed)
    total = numbered.agg(F.count(F.lit(1)).alias("n"))
    drawn = (
        tasks.sparkSession.range(episodes).select(F.col("id").alias("episode"))
        .withColumn("_n", total.scalar())
        .where(F.col("_n") > 0)
        .withColumn("task_no", F.lit(1) + hash_int(seed, F.col("episode"), "task") % F.col("_n"))
    )
    return drawn.drop("_n").join(numbered, "task_no").drop("task_no")


def _ordinary_slots(
    examples: DataFrame, n_way: int, k_shot: int, query: int, episodes: int, seed: int,
) -> DataFrame:
    """The ranks each episode asks for: a few rows per episode."""
    size = k_shot + query
    tasks = _pick_tasks(eligible_tasks(examples, n_way, k_shot, query), episodes, seed)
    ordered = F.array_sort(
        F.transform(
            "classes",
            lambda c: F.struct(hash_key(seed, F.col("episode"), c["label"]).alias("h"), c["label"], c["n"]),
        )
    )
    chosen = tasks.select("episode", "task", F.explode(F.slice(ordered, 1, n_way)).alias("c"))
    chosen = chosen.select("episode", "task", "c.label", F.col("c.n").alias("n"))
    slots = _slots([seed, F.col("episode"), F.col("label")], F.col("n"), size, size)
    return chosen.select("episode", "task", "label", F.explode(slots).alias("s")).select(
        F.lit(k_shot).alias("k_shot"), "episode", "task", "label", F.col("s.rn").alias("rn"),
        F.when(F.col("s.slot") < k_shot, "support").otherwise("query").alias("role"),
    )


def episode_sweep(
    examples: DataFrame, n_way: int, k_shots: list[int], query: int, episodes: int, seed: int = 17,
) -> DataFrame:
    """Members of the episodes of several shot counts, long form, from one ranking.

    ``examples`` needs ``task, label, sample_id``; extra columns are carried along.
    """
    wanted = None
    for k in k_shots:
        _check(n_way, k, query, episodes)
        slots = _ordinary_slots(examples, n_way, k, query, episodes, seed)
        wanted = slots if wanted is None else wanted.unionByName(slots)
    ranked = hash_ranked(
        examples.withColumn("_h", hash_key(seed, F.col("sample_id"))), ["task", "label"], "_h", "sample_id"
    ).drop("_h", "n")
    # Shots x episodes x (n_way * (k + q)) rows, read several times by the evaluations.
    members = cut_lineage(ranked.join(wanted, ["task", "label", "rn"]).drop("rn"))
    if members.select("k_shot").distinct().count() < len(set(k_shots)):
        raise ValueError("no task can satisfy the requested episodes")
    return members


def ordinary_episodes(
    examples: DataFrame, n_way: int, k_shot: int, query: int, episodes: int, seed: int = 17,
) -> DataFrame:
    """Members of each episode of one shot count in long form."""
    return episode_sweep(examples, n_way, [k_shot], query, episodes, seed).drop("k_shot")


def _class_masks(n_classes: int, n_way: int) -> list[int]:
    return [sum(1 << c for c in subset) for subset in class_subsets(n_classes, n_way)]


def _has(mask: Column, wanted: Column) -> Column:
    return mask.bitwiseAND(wanted) == wanted


def _speaker_masks(examples: DataFrame, k_shot: int, query: int) -> DataFrame:
    """Per speaker the bit sets of classes it can support and query."""
    counts = examples.groupBy("task", "speaker_id", "label").agg(F.count(F.lit(1)).alias("n"))
    label = F.col("label").cast("int")
    inside = F.when(label.between(0, 62), label).otherwise(
        F.raise_error("speaker-disjoint episodes take labels 0 to 62").cast("int")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), inside)
    none = F.lit(0).cast("bigint")
    return counts.groupBy("task", "speaker_id").agg(
        F.bit_or(F.when(F.col("n") >= k_shot, bit).otherwise(none)).alias("s_mask"),
        F.bit_or(F.when(F.col("n") >= query, bit).otherwise(none)).alias("q_mask"),
    )


def eligible_class_sets(
    examples: DataFrame, n_classes: int, n_way: int, k_shot: int, query: int,
) -> DataFrame:
    """Class sets per task for which two different speakers can support and query.

    Speakers are first folded into a histogram of their masks, so class sets multiply the
    few distinct masks and not the speakers; a pair exists unless one speaker is the only
    candidate on both sides.
    """
    _check(n_way, k_shot, query)
    masks = F.array(*[F.lit(m).cast("bigint") for m in _class_masks(n_classes, n_way)])
    histogram = _speaker_masks(examples, k_shot, query).groupBy("task", "s_mask", "q_mask").agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = histogram.withColumn("class_set", F.explode(masks)).withColumns(
        {"_s": _has(F.col("s_mask"), F.col("class_set")), "_q": _has(F.col("q_mask"), F.col("class_set"))}
    )
    counted = sides.where("_s or _q").groupBy("task", "class_set").agg(
        F.sum(F.when(F.col("_s"), F.col("n")).otherwise(0)).alias("n_support"),
        F.sum(F.when(F.col("_q"), F.col("n")).otherwise(0)).alias("n_query"),
        F.sum(F.when(F.col("_s") & F.col("_q"), F.col("n")).otherwise(0)).alias("n_both"),
    )
    lone = (F.col("n_support") == 1) & (F.col("n_query") == 1) & (F.col("n_both") == 1)
    return counted.where((F.col("n_support") > 0) & (F.col("n_query") > 0) & ~lone)


def _rank_side(df: DataFrame, flag: str, rank: str, size: str, seed: int) -> DataFrame:
    side = df.where(flag).select("task", "class_set", "speaker_id").withColumn(
        "_h", hash_key(seed, F.col("speaker_id"), rank)
    )
    ranked = hash_ranked(side, ["task", "class_set"], "_h", "speaker_id")
    return ranked.select(
        "task", "class_set", "speaker_id", F.col("rn").alias(rank), F.col("n").alias(size)
    )


def disjoint_episodes(
    examples: DataFrame, n_classes: int, n_way: int, k_shot: int, query: int, episodes: int,
    seed: int = 17,
) -> DataFrame:
    """Episodes whose support and query come from two different speakers of one task.

    ``examples`` needs ``task, label (0..n_classes-1), speaker_id, sample_id``.
    """
    _check(n_way, k_shot, query, episodes)
    sets = eligible_class_sets(examples, n_classes, n_way, k_shot, query)
    per_task = sets.groupBy("task").agg(F.sort_array(F.collect_list("class_set")).alias("sets"))
    drawn = _pick_tasks(per_task, episodes, seed)
    pick = (hash_int(seed, F.col("episode"), "classes") % F.size("sets")).cast("int")
    # Every table cut here has one row per episode or per candidate speaker; the later steps
    # read them several times.
    drawn = cut_lineage(drawn.select("episode", "task", F.get("sets", pick).alias("class_set")))
    if drawn.isEmpty():
        raise ValueError("no task can satisfy the requested episodes")

    # Candidates of the chosen class sets only; a task's speakers meet at most C(K, n_way) sets.
    used = drawn.select("task", "class_set").distinct()
    candidates = cut_lineage(
        _speaker_masks(examples, k_shot, query).join(used, "task").select(
            "task", "class_set", "speaker_id",
            _has(F.col("s_mask"), F.col("class_set")).alias("_s"),
            _has(F.col("q_mask"), F.col("class_set")).alias("_q"),
        ).where("_s or _q")
    )
    keys = ["task", "class_set"]
    support = _rank_side(candidates, "_s", "s_rank", "n_s", seed)
    asked = _rank_side(candidates, "_q", "q_rank", "n_q", seed)
    ranks = cut_lineage(support.join(asked, [*keys, "speaker_id"], "full"))
    sizes = ranks.groupBy(*keys).agg(
        F.coalesce(F.max("n_s"), F.lit(0)).alias("n_s"), F.coalesce(F.max("n_q"), F.lit(0)).alias("n_q")
    )
    ranks = ranks.drop("n_s", "n_q")
    drawn = drawn.join(sizes, keys)

    def draw(rows: DataFrame, first: str, second: str, n_first: str, n_second: str) -> DataFrame:
        """First side freely, second side from the remaining speakers (skipping the first)."""
        one = rows.withColumn(
            f"{first}_rank", F.lit(1) + hash_int(seed, F.col("episode"), first) % F.col(n_first)
        ).join(
            ranks.select(
                *keys, f"{first}_rank", F.col("speaker_id").alias(f"{first}_speaker"),
                F.col(f"{second}_rank").alias("_skip"),
            ),
            [*keys, f"{first}_rank"],
        )
        left = F.col(n_second) - F.col("_skip").isNotNull().cast("int")
        position = F.lit(1) + hash_int(seed, F.col("episode"), second) % left
        shifted = position + F.coalesce((position >= F.col("_skip")).cast("int"), F.lit(0))
        return one.withColumn(f"{second}_rank", shifted).join(
            ranks.select(*keys, f"{second}_rank", F.col("speaker_id").alias(f"{second}_speaker")),
            [*keys, f"{second}_rank"],
        ).select("episode", *keys, "s_speaker", "q_speaker")

    # With a single query candidate that one is fixed first, else the support speaker is.
    drawn = cut_lineage(drawn)
    pairs = cut_lineage(
        draw(drawn.where("n_q > 1"), "s", "q", "n_s", "n_q").unionByName(
            draw(drawn.where("n_q = 1"), "q", "s", "n_q", "n_s")
        )
    )
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda b: F.col("class_set").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0,
    )
    roles = F.explode(
        F.array(
            F.struct(F.lit("support").alias("role"), F.col("s_speaker").alias("speaker_id"), F.lit(k_shot).alias("m")),
            F.struct(F.lit("query").alias("role"), F.col("q_speaker").alias("speaker_id"), F.lit(query).alias("m")),
        )
    )
    asks = pairs.select("episode", "task", F.explode(bits).alias("label"), "s_speaker", "q_speaker")
    asks = asks.select("episode", "task", "label", roles.alias("r")).select("episode", "task", "label", "r.*")
    cell = ["task", "speaker_id", "label"]
    ranked = hash_ranked(
        examples.withColumn("_h", hash_key(seed, F.col("sample_id"))), cell, "_h", "sample_id"
    ).drop("_h")
    sizes = examples.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    slots = _slots(
        [seed, F.col("episode"), F.col("label"), F.col("role")], F.col("n"), F.col("m"), max(k_shot, query)
    )
    wanted = asks.join(sizes, cell).select("episode", *cell, "role", F.explode(slots).alias("s"))
    return ranked.drop("n").join(
        wanted.select("episode", *cell, "role", F.col("s.rn").alias("rn")), [*cell, "rn"]
    ).drop("rn")


def episode_audit(members: DataFrame, n_way: int, k_shot: int, query: int) -> DataFrame:
    """Overlap and balance of every episode; all counts are 0 for a sound one but speakers."""
    per_sample = members.groupBy("episode", "sample_id").agg(
        F.count_if(F.col("role") == "support").alias("s"), F.count_if(F.col("role") == "query").alias("q")
    ).groupBy("episode").agg(
        F.count_if((F.col("s") > 0) & (F.col("q") > 0)).alias("sample_overlap"),
        F.count_if((F.col("s") > 1) | (F.col("q") > 1)).alias("repeated_samples"),
    )
    per_speaker = members.groupBy("episode", "speaker_id").agg(
        (F.bool_or(F.col("role") == "support") & F.bool_or(F.col("role") == "query")).alias("both")
    ).groupBy("episode").agg(F.count_if("both").alias("speaker_overlap"))
    per_class = members.groupBy("episode", "label").agg(
        F.count_if(F.col("role") == "support").alias("s"), F.count_if(F.col("role") == "query").alias("q")
    ).groupBy("episode").agg(
        F.count(F.lit(1)).alias("classes"),
        F.count_if((F.col("s") != k_shot) | (F.col("q") != query)).alias("unbalanced_classes"),
    )
    audit = per_sample.join(per_speaker, "episode").join(per_class, "episode")
    return audit.withColumn(
        "valid",
        (F.col("classes") == n_way) & (F.col("unbalanced_classes") == 0)
        & (F.col("sample_overlap") == 0) & (F.col("repeated_samples") == 0),
    )
