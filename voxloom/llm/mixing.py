"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt into blocks: ``2 ** BLOCK_BITS`` hash ranges per source.  A source's
target gives every block ``floor(target / size)`` whole passes and one more to the blocks
that still fit, in a permuted order; what then is left cuts the smallest other block
between two documents.  The numbers of block draws per source are the exact quotas at the
root of a binary tree over the output shards.  Each node splits its quotas between its two
children by one multivariate-hypergeometric draw, seeded by the node, so a shard finds its
own quotas by walking from the root.  A source's draws are then numbered and handed out in
disjoint runs, shard by shard, and each shard orders its documents by hash.

Everything is derived from hashes and seeds, so reruns agree.  Null and empty texts have
size 0 and follow their block; a null source is a source of its own, ordered last; an
empty table gives an empty mix.  Repeated rows are documents of their own.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from voxloom.llm.common import free_name, kept, raw

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3  # a source gives at most this many times its size
BLOCK_BITS = 10
SHARD_WORDS = 4_000_000
LEAST_SHARDS = 8
SEED = 20
MAX_SOURCES = 1_000_000  # sources are an aggregated dimension; beyond this the job refuses


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    return pa.array((len(t.as_py().split()) for t in text), pa.int64())


def _mixed_hash(*parts: Column | str) -> Column:
    """A non-negative long of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 1)


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, source, size and the document's block and place in it."""
    place = _mixed_hash("doc_id", "text_key")
    return kept(
        docs.select(
            "doc_id", F.xxhash64("text").alias("text_key"), "source", word_count(raw("text")).alias("size")
        ).withColumn("place", place).withColumn("block", F.shiftright("place", 63 - BLOCK_BITS)),
        "sized",
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target from one row per source.

    Targets share the total by weight under a cap of ``most`` sizes.  With sources in the
    order of cap by weight, the capped ones come first: the level at which the rest shares
    what is left is found by running sums, as resharing the excess would end.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    ranked = (
        sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    )
    # the level holds from the first source on whose cap reaches it
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))
    settled = ranked.withColumn("level", F.min(free).over(everything)["level"])
    return settled.select(
        "source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target")
    )


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int = SEED) -> np.ndarray:
    """Quotas of one of ``shards`` leaves, by the draws along its path from the root."""
    first, last, node = 0, shards, 1
    while last - first > 1:
        middle = (first + last) // 2
        total = int(quotas.sum())
        left_total = total * (middle - first) // (last - first)
        draws = np.random.default_rng([seed, node])
        left = draws.multivariate_hypergeometric(quotas, left_total, method="marginals")
        if shard < middle:
            quotas, last, node = left, middle, 2 * node
        else:
            quotas, first, node = quotas - left, middle, 2 * node + 1
    return quotas


def block_draws(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with targets; and the drawn blocks (source, block, passes, rest): ``rest`` is
    the part of the boundary block's words that its last pass takes, else null."""
    blocks = kept(
        sized.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn(
            "turn", _mixed_hash("source", "block")
        ),
        "mix-blocks",
    )
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = kept(source_targets(sizes), "targets")
    known = (
        blocks.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    return targets, known.groupBy("source").applyInPandas(
        _last_pass, "source string, block long, turn long, whole long, passes long, rest double"
    )


def _last_pass(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source (at most 2 ** BLOCK_BITS): in permuted order each joins the
    last pass if it still fits; the smallest of the others is the boundary block."""
    frame = frame.sort_values(["turn", "block"], kind="stable").reset_index(drop=True)
    left, extra = float(frame["left"].iloc[0]), np.zeros(len(frame), np.int64)
    rest = np.full(len(frame), np.nan)
    words = frame["words"].to_numpy(np.int64)
    for i, size in enumerate(words.tolist()):
        if 0 < size <= left:
            extra[i], left = 1, left - size
    open_blocks = np.flatnonzero((extra == 0) & (words > 0))
    if left > 0 and len(open_blocks):
        last = open_blocks[words[open_blocks].argmin()]
        extra[last], rest[last] = 1, left
    return frame.assign(
        passes=frame["whole"] + extra, rest=pd.Series(rest).astype(object).where(~np.isnan(rest), None)
    )[["source", "block", "turn", "whole", "passes", "rest"]]


def shard_of_draws(drawn: DataFrame, shards: int) -> DataFrame:
    """source, block and its passes with their shards (at most MOST_PASSES + 1 each)."""
    spark = drawn.sparkSession
    order = Window.partitionBy("source").orderBy("pass", "turn", "block")
    units = (
        drawn.where("passes > 0").withColumn("pass", F.explode(F.expr("sequence(1L, passes)")))
        .withColumn("draw", F.row_number().over(order) - 1)
    )
    quotas = kept(
        drawn.groupBy("source").agg(F.sum("passes").alias("quota"))
        .withColumn("n", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1),
        "quotas",
    )
    found = quotas.select("n", "quota").orderBy("n").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    root = np.array([r["quota"] for r in found], np.int64)

    def walk(frames):
        for frame in frames:
            for shard in frame["id"]:
                mine = split_quotas(root, shards, int(shard))
                got = np.flatnonzero(mine)
                yield pd.DataFrame({"shard": shard, "n": got, "share": mine[got]})

    shares = spark.range(shards).mapInPandas(walk, "shard long, n int, share long")
    upto = Window.partitionBy("n").orderBy("shard")
    places = (
        shares.withColumn("stop", F.sum("share").over(upto))
        .join(quotas, "n")
        .select(
            F.col("source").alias("s"), "shard",
            F.explode(F.sequence(F.col("stop") - F.col("share"), F.col("stop") - 1)).alias("d"),
        )
    )
    joined = units.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d")))
    return joined.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"),
        F.max("whole").alias("whole"), F.max("passes").alias("passes"), F.max("rest").alias("rest"),
    )


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies and ``draws``: pass and
    shard of each copy, and ``turn``, the order inside a shard."""
    sized = sized_documents(docs)
    targets, drawn = block_draws(sized)
    drawn = kept(drawn, "draws")
    if shards is None:
        words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()["words"]
        shards = max(LEAST_SHARDS, -(-words // SHARD_WORDS))
    plan = kept(shard_of_draws(drawn, shards), "plan").select(
        F.col("source").alias("s"), F.col("block").alias("b"), "draws", "whole", "passes", "rest"
    )
    mine = sized.join(
        plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left"
    ).drop("s", "b")
    # only documents of a boundary block are ordered; others form groups of their own
    inside = Window.partitionBy(
        "source", "block", F.when(F.col("rest").isNull(), F.col("place"))
    ).orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum("size").over(inside)
    fits = F.coalesce(ends - F.col("size") / 2 <= F.col("rest"), F.lit(False))
    copies = F.coalesce(F.col("passes") - (F.col("rest").isNotNull() & ~F.col("fits")).cast("long"), F.lit(0))
    placed = mine.withColumn("fits", fits).withColumn("copies", copies.cast("long"))
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    return placed.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "copies",
        F.coalesce(
            F.slice("draws", F.lit(1), F.col("copies").cast("int")),
            F.expr("cast(array() AS array<struct<pass: bigint, shard: bigint>>)"),
        ).alias("draws"),
        _mixed_hash(F.lit("turn"), "doc_id", "text_key").alias("turn"),
    )


def mixed_documents(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with its own columns; one
    partition per group of shards, a shard's documents together and in shuffled order."""
    key, nth, drawn, turn, m_id, m_key, m_nth = (
        free_name(docs, c) for c in ("_key", "_nth", "_draw", "_turn", "m_id", "m_key", "m_nth")
    )
    mixed = mix(docs, shards).where("copies > 0").select(
        F.col("doc_id").alias(m_id), F.col("text_key").alias(m_key), "draws", F.col("turn").alias(turn),
        F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("source")).alias(m_nth),
    )
    mixed = mixed.select(m_id, m_key, m_nth, turn, F.explode("draws").alias(drawn))
    numbered = docs.withColumn(key, F.xxhash64("text")).withColumn(
        nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy("source"))
    )
    same = F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(key) == F.col(m_key)) & (F.col(nth) == F.col(m_nth))
    shard = F.col(drawn)["shard"]
    return (
        numbered.join(mixed, same).repartition(shard)
        .sortWithinPartitions(shard, F.col(turn), F.col(drawn)["pass"])
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
