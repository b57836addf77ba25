"""Deterministic choices: every seeded decision is an order on sha256("seed:key")."""

from pyspark.sql import Column, DataFrame, Window, functions as F

RANK_BUCKET_DIGITS = 3  # hex digits, so 4,096 buckets per group


def _str(value):
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def hash_key(*parts) -> Column:
    """sha256 of the parts joined by ':'; parts are columns or plain values."""
    return F.sha2(F.concat_ws(":", *[_str(p) for p in parts]), 256)


def hash_int(*parts) -> Column:
    """First 60 bits of the hash as a bigint in [0, 2^60)."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """52 bits of the hash as a double in [0, 1), exactly."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_ranked(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Exact ``row_number`` (``rn``) by a hash column, and the group size (``n``).

    A plain window would sort a whole group in one task.  Hash values spread evenly, so
    the group is cut into 4,096 hash ranges: rows are numbered inside their range and
    shifted by the size of the ranges before it (counted with map-side combine).
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(order), 1, RANK_BUCKET_DIGITS))
    bucket_keys = [*keys, "_bucket"]
    sizes = bucketed.groupBy(*bucket_keys).agg(F.count(F.lit(1)).alias("_size"))
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = sizes.select(
        *bucket_keys,
        (F.sum("_size").over(ordered) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy(*bucket_keys).orderBy(order, tie)
    numbered = bucketed.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, bucket_keys)
        .withColumn("rn", F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_inside", "_before")
    )
