"""Label policy: explicit maps, contiguous indices, exclusion counts."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def lookup(col: Column, mapping: Mapping) -> Column:
    """Configuration-sized map applied as an expression; NULL when the key is unknown."""
    if not mapping:
        raise ValueError("mapping must not be empty")
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


def map_labels(df: DataFrame, source: str, mapping: Mapping[str, str], target: str) -> DataFrame:
    """Keep mapped rows only; unmapped labels are excluded without merging."""
    return df.withColumn(target, lookup(F.col(source), mapping)).where(F.col(target).isNotNull())


def label_exclusions(df: DataFrame, source: str, mapping: Mapping[str, str]) -> DataFrame:
    """How many rows each excluded source label costs."""
    excluded = df.where(lookup(F.col(source), mapping).isNull())
    return excluded.groupBy(F.concat(F.lit("source_emotion:"), F.col(source)).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def check_vocabulary(labels: Mapping[str, int]) -> Mapping[str, int]:
    """Label indices must be exactly 0..K-1."""
    if sorted(labels.values()) != list(range(len(labels))) or not labels:
        raise ValueError("label indices must be unique and contiguous from zero")
    return labels


def label_index(df: DataFrame, source: str, labels: Mapping[str, int], target: str) -> DataFrame:
    """Index labels; a label outside the vocabulary fails the job with its value."""
    check_vocabulary(labels)
    index = lookup(F.col(source), labels)
    message = F.concat(F.lit("unsupported label: "), F.coalesce(F.col(source), F.lit("NULL")))
    return df.withColumn(
        target, F.when(index.isNotNull(), index).otherwise(F.raise_error(message).cast("int"))
    )


def lookup_codes(df: DataFrame, code: str, table: Mapping[str, str], target: str) -> DataFrame:
    """Attach the text of each code and flag codes the table does not know."""
    text = lookup(F.col(code), table)
    return df.withColumn(target, text).withColumn("code_known", text.isNotNull())


def canonical_route(col: Column, vocabulary: list[str]) -> Column:
    """Values outside the vocabulary travel through the explicit ``unknown`` route."""
    return F.when(col.isin(list(vocabulary)), col).otherwise(F.lit("unknown"))


def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Balanced weights N / (K * n_c); a class without rows fails the job."""
    counts = df.where(F.col(label).isin(list(classes))).groupBy(label).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], [label])
    full = grid.join(F.broadcast(counts), label, "left")  # at most K rows on either side
    totals = counts.agg(F.sum("n").alias("total"))
    n = F.col("n").cast("double")
    empty = F.raise_error(F.concat(F.lit("empty class: "), F.col(label).cast("string")))
    return full.withColumn("total", totals.scalar()).select(
        label,
        F.when(n.isNull(), empty.cast("double"))
        .otherwise(F.col("total").cast("double") / (F.lit(float(len(classes))) * n))
        .alias("weight"),
    )
