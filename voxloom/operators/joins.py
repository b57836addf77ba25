"""Joins with a check: missing partners are reported, never lost."""

from pyspark.sql import DataFrame, functions as F


def dim_join(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact to dimension; a fact without its dimension row fails the job.

    No broadcast hint: the planner broadcasts when statistics show a small dimension.
    """
    joined = facts.join(dim.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{key} is absent from the dimension: "), F.col(key).cast("string")))
    return joined.where(F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))).drop("_found")


def pairing_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one check of two sides: paired, missing on one side, or repeated."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = sides.groupBy(key).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    status = (
        F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated")
        .when(F.col("n_right") == 0, "missing_media").when(F.col("n_left") == 0, "orphan_media")
        .otherwise("paired")
    )
    return counted.select(key, status.alias("status"))


def tolerance_reconcile(declared: DataFrame, measured: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Declared against measured values; a difference above the tolerance fails the check."""
    joined = declared.join(measured, key, "left")
    diff = F.abs(F.col("declared") - F.col("measured"))
    return joined.withColumn("difference", diff).withColumn(
        "ok", F.coalesce(diff <= tolerance, F.lit(False))
    )


def semi_subset(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose group was selected."""
    return rows.join(chosen.select(key), key, "left_semi")
