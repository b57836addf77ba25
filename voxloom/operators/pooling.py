"""Pooling, padding, segmenting and masked fusion of vectors."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxloom.functions.vectors import as_double, let, zeros

VARIANCE_FLOOR = 1e-8


def _mean(vector: str, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean as a mergeable aggregate: one buffer per group and task."""
    v = array_to_vector(as_double(F.col(vector)))
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def masked_mean(steps: DataFrame, owner: str, vector: str, mask: str) -> DataFrame:
    """Mean of the valid steps per owner; an owner without valid steps fails the job."""
    per = steps.groupBy(owner).agg(
        _mean(vector, F.when(F.coalesce(F.col(mask), F.lit(False)), 1.0).otherwise(0.0)).alias("pooled"),
        F.count_if(mask).alias("steps"),
    )
    return per.select(
        owner, "steps",
        F.when(F.col("steps") > 0, F.col("pooled"))
        .otherwise(F.raise_error("a sequence has no valid step").cast("array<double>")).alias("pooled"),
    )


def _floored(mean: Column, variance: Column) -> Column:
    return F.concat(mean, F.transform(variance, lambda x: F.sqrt(F.greatest(x, F.lit(VARIANCE_FLOOR)))))


def statistics_pool(steps: DataFrame, owner: str, vector: str, mask: str) -> DataFrame:
    """Population mean and standard deviation (floored) of the valid steps, concatenated.

    The summarizer keeps centred sums, so a large offset costs no digits; its sample
    variance is scaled back to the population's.
    """
    v = array_to_vector(as_double(F.col(vector)))
    per = steps.where(mask).groupBy(owner).agg(
        _mean(vector).alias("_m"), vector_to_array(Summarizer.variance(v)).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    population = F.transform("_v", lambda x: x * (F.col("_n") - 1) / F.col("_n"))
    return per.select(owner, _floored(F.col("_m"), population).alias("pooled"))


def attentive_pool(steps: DataFrame, owner: str, vector: str, mask: str) -> DataFrame:
    """Like :func:`statistics_pool`, weighted by softmax of each step's mean energy.

    The softmax needs only the group maximum, and the variance is a second pass around the
    weighted mean: three mergeable aggregations; no group is gathered.
    """
    v = as_double(F.col(vector))
    energy = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(v)
    valid = steps.where(mask).withColumn("_e", energy)
    peak = valid.groupBy(owner).agg(F.max("_e").alias("_peak"))
    weighted = valid.join(peak, owner).withColumn("_w", F.exp(F.col("_e") - F.col("_peak")))
    means = weighted.groupBy(owner).agg(_mean(vector, F.col("_w")).alias("_m"))
    centred = weighted.join(means, owner).withColumn(
        "_sq", F.zip_with(v, F.col("_m"), lambda x, m: (x - m) * (x - m))
    )
    spread = centred.groupBy(owner).agg(_mean("_sq", F.col("_w")).alias("_v"))
    return means.join(spread, owner).select(owner, _floored(F.col("_m"), F.col("_v")).alias("pooled"))


def pool_hidden(steps: DataFrame, owner: str, vector: str, mask: str, pooling: str) -> DataFrame:
    kinds = {
        "masked_mean": masked_mean, "statistics": statistics_pool, "attentive_statistics": attentive_pool,
    }
    if pooling not in kinds:
        raise ValueError(f"unsupported pooling: {pooling}")
    return kinds[pooling](steps, owner, vector, mask)


def last_step(steps: DataFrame, owner: str, position: str, mask: str, columns: Sequence[str]) -> DataFrame:
    """The last valid step per owner; works for left and right padding alike."""
    best = F.max_by(F.struct(position, *columns), F.col(position))
    return steps.where(mask).groupBy(owner).agg(best.alias("_s")).select(owner, "_s.*")


def weighted_segment_mean(segments: DataFrame, owner: str, vector: str, length: str) -> DataFrame:
    """Duration-weighted mean of segment vectors per owner."""
    ok = F.coalesce(F.col(length) > 0, F.lit(False))
    weight = F.when(ok, F.col(length).cast("double")).otherwise(
        F.raise_error("segment lengths must be positive").cast("double")
    )
    return segments.groupBy(owner).agg(_mean(vector, weight).alias("pooled"))


def segments(df: DataFrame, key: str, size: str, maximum: int, overlap: int, policy: str) -> DataFrame:
    """Hopping windows over ``size`` samples: ``reject``, ``truncate`` or ``chunk`` long inputs.

    Every start below the size yields a chunk, also one that lies wholly in the overlap.
    """
    if maximum <= 0:
        raise ValueError("maximum must be positive")
    n = F.col(size).cast("bigint")
    short = n <= maximum
    if policy == "chunk":
        if not 0 <= overlap < maximum:
            raise ValueError("chunking needs 0 <= overlap < maximum")
        step = maximum - overlap
        starts = F.when(short, F.array(F.lit(0).cast("bigint"))).otherwise(
            F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(step).cast("bigint"))
        )
    elif policy == "truncate":
        starts = F.array(F.lit(0).cast("bigint"))
    elif policy == "reject":
        starts = F.array(
            F.when(short, F.lit(0).cast("bigint")).otherwise(
                F.raise_error("input exceeds the maximum under the reject policy").cast("bigint")
            )
        )
    else:
        raise ValueError(f"unsupported duration policy: {policy}")
    exploded = df.where(n > 0).select(key, n.alias("_n"), F.posexplode(starts).alias("segment", "start"))
    end = F.least(F.col("start") + maximum, F.col("_n"))
    return exploded.select(key, "segment", "start", end.alias("end"))


def uniform_indices(count: Column, wanted: int) -> Column:
    """Indices spread over 0..count-1 (half-even rounding); one index means the middle."""
    if wanted <= 0:
        raise ValueError("the number of frames must be positive")
    k = F.least(count, F.lit(wanted)).cast("int")
    step = (count - 1).cast("double") / (k - 1).cast("double")
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * step).cast("int"))
    return (
        F.when(count <= 0, F.raise_error("frame count must be positive").cast("array<int>"))
        .when(k == 1, F.array(F.floor(count / 2).cast("int")))
        .otherwise(spread)
    )


def pad_sequences(df: DataFrame, sequence: str, batch: Sequence[str] = ()) -> DataFrame:
    """Pad ragged sequences with zeros to the longest of the table (or of their batch).

    Steps are numbers or vectors; a padded vector step has the width of the table's first
    steps, and a step of another width fails the job.
    """
    nested = isinstance(df.schema[sequence].dataType.elementType, T.ArrayType)
    if batch:
        longest = df.groupBy(*batch).agg(F.max(F.size(sequence)).alias("_max"))
        sized = df.join(longest, list(batch))
    else:
        sized = df.withColumn("_max", df.agg(F.max(F.size(sequence)).alias("m")).scalar())
    gap = F.col("_max") - F.size(sequence)
    if nested:
        sized = sized.withColumn("_dim", df.agg(F.max(F.size(F.get(sequence, F.lit(0)))).alias("d")).scalar())
        wrong = F.raise_error("steps of different widths").cast("array<double>")
        steps = F.transform(sequence, lambda s: F.when(F.size(s) == F.col("_dim"), as_double(s)).otherwise(wrong))
        fill = F.array_repeat(F.array_repeat(F.lit(0.0), F.col("_dim")), gap)
    else:
        steps, fill = as_double(F.col(sequence)), F.array_repeat(F.lit(0.0), gap)
    return sized.select(
        *[c for c in df.columns if c != sequence],
        F.concat(steps, fill).alias(sequence),
        F.concat(
            F.array_repeat(F.lit(True), F.size(sequence)), F.array_repeat(F.lit(False), gap)
        ).alias("step_mask"),
    )


def _require_active(mask: Column, value: Column, dtype: str) -> Column:
    return F.when(F.exists(mask, lambda m: m), value).otherwise(
        F.raise_error("all modalities are masked").cast(dtype)
    )


def masked_softmax(scores: Column, mask: Column) -> Column:
    """Softmax over unmasked entries; masked ones are exactly zero, all-masked is an error."""
    peak = F.array_max(F.filter(scores, lambda s, i: F.get(mask, i)))
    raw = let(peak, lambda p: F.zip_with(scores, mask, lambda s, m: F.when(m, F.exp(s - p)).otherwise(0.0)))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x)
    soft = let(raw, lambda r: let(total(r), lambda t: F.transform(r, lambda x: x / t)))
    return _require_active(mask, soft, "array<double>")


def equal_weights(mask: Column) -> Column:
    """1 / number of available modalities, zero for the others."""
    available = F.size(F.filter(mask, lambda m: m)).cast("double")
    return _require_active(
        mask, F.transform(mask, lambda m: F.when(m, F.lit(1.0) / available).otherwise(0.0)), "array<double>"
    )


def masked_concat(vectors: Sequence[Column], mask: Column, dims: Sequence[int]) -> Column:
    """Concatenate modality vectors, zero-filling the masked ones."""
    parts = [
        F.when(F.get(mask, F.lit(i)), v).otherwise(zeros(d)) for i, (v, d) in enumerate(zip(vectors, dims))
    ]
    return F.concat(*parts)


def _scaled(vector: Column, weight: Column) -> Column:
    return let(weight, lambda w: F.transform(vector, lambda x: x * w))


def weighted_fusion(vectors: Sequence[Column], weights: Column) -> Column:
    """Sum of the modality vectors times their weights."""
    scaled = [_scaled(v, F.get(weights, F.lit(i))) for i, v in enumerate(vectors)]
    total = scaled[0]
    for part in scaled[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total
