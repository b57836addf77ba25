"""Classification metrics over prediction tables, whole or per slice."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _cells(preds: DataFrame, target: str, prediction: str, k: int, by: Sequence[str]) -> DataFrame:
    """Counts per (slice, target, prediction); an index outside 0..k-1 fails the job."""
    if k <= 0:
        raise ValueError("the number of classes must be positive")
    t, p = F.col(target).cast("int"), F.col(prediction).cast("int")
    inside = F.coalesce(t.between(0, k - 1) & p.between(0, k - 1), F.lit(False))
    checked = F.when(inside, t).otherwise(
        F.raise_error("class index is outside the configured range").cast("int")
    )
    return preds.groupBy(*by, checked.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, target: str, prediction: str, k: int) -> DataFrame:
    """All k x k cells, zeros included."""
    cells = _cells(preds, target, prediction, k, [])
    grid = preds.sparkSession.range(k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("t"), (F.col("id") % k).cast("int").alias("p")
    )
    return grid.join(F.broadcast(cells), ["t", "p"], "left").select(  # k*k rows at most
        F.col("t").alias("target"), F.col("p").alias("prediction"), F.coalesce("n", F.lit(0)).alias("n")
    )


def per_class_metrics(
    preds: DataFrame, target: str, prediction: str, k: int, by: Sequence[str] = (),
) -> DataFrame:
    """Recall, precision, F1 and support of every configured class per slice.

    The first aggregation leaves at most k*k rows per slice; each of them then adds to
    its target and to its predicted class, and one empty row per slice and class keeps
    absent classes at zero.
    """
    by = list(by)
    cells = _cells(preds, target, prediction, k, by)
    n, zero = F.col("n"), F.lit(0).cast("bigint")

    def entry(cls: Column, support: Column, predicted: Column, tp: Column) -> Column:
        return F.struct(
            cls.cast("int").alias("class"), support.alias("support"),
            predicted.alias("predicted"), tp.alias("tp"),
        )

    entries = F.array(
        entry(F.col("t"), n, zero, F.when(F.col("t") == F.col("p"), n).otherwise(zero)),
        entry(F.col("p"), zero, n, zero),
    )
    classes = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c")
    grid = cells.select(*by, F.lit(True).alias("_s")).distinct().select(*by, classes)
    sums = (
        cells.select(*by, F.explode(entries).alias("_e"))
        .unionByName(grid.select(*by, entry(F.col("_c"), zero, zero, zero).alias("_e"))).groupBy(*by, "_e.class")
        .agg(*[F.sum(f"_e.{x}").alias(x) for x in ("support", "predicted", "tp")])
    )
    tp = F.col("tp").cast("double")
    recall = F.coalesce(F.try_divide(tp, F.col("support").cast("double")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(tp, F.col("predicted").cast("double")), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        F.lit(0.0),
    )
    return (
        sums.withColumn("recall", recall).withColumn("precision", precision).withColumn("f1", f1)
        .select(*by, "class", "support", "predicted", "tp", "recall", "precision", "f1")
    )


def classification_metrics(
    preds: DataFrame, target: str, prediction: str, k: int, by: Sequence[str] = (),
) -> DataFrame:
    """UAR and macro-F1 over all k classes (absent ones count as zero), and accuracy."""
    per_class = per_class_metrics(preds, target, prediction, k, by)
    sizes = [
        F.avg("recall").alias("uar"), F.avg("f1").alias("macro_f1"),
        F.coalesce(
            F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")), F.lit(0.0)
        ).alias("accuracy"),
        F.sum("support").alias("n"),
    ]
    return per_class.groupBy(*by).agg(*sizes)


def slices(df: DataFrame, dimensions: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, slice dimension); missing slice values become ``unknown``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("slice_dim"),
                F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown")).alias("slice_value"),
            )
            for name, value in dimensions.items()
        ]
    )
    return df.select(*keep, F.explode(entries).alias("_s")).select(*keep, "_s.*")


def sliced_metrics(
    preds: DataFrame, target: str, prediction: str, k: int, dimensions: Mapping[str, Column],
) -> DataFrame:
    """Metrics per slice; counts are combined before the shuffle, so slices cost no copy."""
    long = slices(preds, dimensions, [target, prediction])
    return classification_metrics(long, target, prediction, k, ["slice_dim", "slice_value"])


def fusion_weight_summary(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """Mean fusion weight per slice and modality, and the largest weight on a missing one.

    Needs ``w_audio, w_text, w_visual`` and ``modality_mask``.
    """
    weights = ["w_audio", "w_text", "w_visual"]
    long = slices(df, {**dimensions, "global": F.lit("all")}, [*weights, "modality_mask"])
    leak = F.greatest(
        *[
            F.when(~F.get("modality_mask", F.lit(i)), F.abs(F.col(w))).otherwise(0.0)
            for i, w in enumerate(weights)
        ]
    )
    return long.groupBy("slice_dim", "slice_value").agg(
        *[F.avg(w).alias(f"mean_{w}") for w in weights], F.max(leak).alias("unavailable_weight_max")
    )


def route_usage(
    df: DataFrame, route: Column, vector: Column, collapse: float = 1e-8,
) -> DataFrame:
    """Rows and mean output norm per route, and whether all routes have collapsed."""
    from voxloom.functions.vectors import norm

    per = df.select(route.alias("route"), norm(vector).alias("norm")).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.avg("norm").alias("mean_norm")
    )
    top = per.agg((F.max("mean_norm") < collapse).alias("c"))
    return per.withColumn("collapse_detected", top.scalar())


def diagnostic_flags(
    per_class: DataFrame, weights: DataFrame, enabled: Sequence[str], dominance: float = 0.7,
) -> DataFrame:
    """Classes that are never recalled, and a modality that dominates the fusion.

    ``weights`` has one row with ``w_<modality>`` means.
    """
    zero = per_class.where(F.col("recall") == 0.0).select(
        F.lit("zero_recall_class").alias("flag"), F.col("class").cast("string").alias("value"),
        F.col("recall").alias("measure"),
    )
    top = F.array_max(
        F.array(
            *[
                # Ties go to the first enabled modality, hence the negative position.
                F.struct(F.col(f"w_{m}").alias("w"), F.lit(-i).alias("o"), F.lit(m).alias("m"))
                for i, m in enumerate(enabled)
            ]
        )
    )
    dominant = weights.select(top.alias("t")).where(
        (F.lit(len(enabled)) > 1) & (F.col("t.w") > dominance)
    ).select(
        F.lit("dominant_modality").alias("flag"), F.col("t.m").alias("value"),
        F.col("t.w").alias("measure"),
    )
    return zero.unionByName(dominant)
