"""Co-occurrence graphs and their connected components."""

from pyspark.sql import DataFrame, functions as F

from voxloom.scratch import cut_lineage


def cooccurrence_edges(df: DataFrame, node: str, context: str) -> DataFrame:
    """Star edges: every node of a context to its smallest node.

    They connect the same components as all pairs would, with one edge per membership.
    """
    members = df.select(F.col(context).alias("_c"), F.col(node).alias("src")).distinct()
    centre = members.groupBy("_c").agg(F.min("src").alias("dst"))
    return members.join(centre, "_c").where("src <> dst").select("src", "dst").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, max_rounds: int = 60) -> DataFrame:
    """Smallest node of every component, by alternating large-star and small-star.

    (Kiveris et al., "Connected components in MapReduce and beyond", SoCC 2014.)  Both
    steps are a minimum per node (combined before the shuffle) joined back to the edges,
    so a hub is split by adaptive skew joins.  Each round is checkpointed reliably.
    """
    current = cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u <> v").distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_lows = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut_lineage(
            linked.unionByName(small_lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
        ).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("connected components did not converge")
    roots = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col(node).alias("u")).distinct().join(roots, "u", "left").select(
        F.col("u").alias(node), F.coalesce("component", "u").alias("component")
    )


def component_summary(
    rows: DataFrame, components: DataFrame, node: str, attributes: list[str],
) -> DataFrame:
    """Distinct values and row counts of each attribute per component, in long form."""
    entries = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]
    )
    return (
        rows.join(components, node)
        .select("component", F.explode(entries).alias("e"))
        .where("e.value is not null")
        .groupBy("component", "e.attribute", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
