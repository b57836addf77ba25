"""Manifest and embedding tables joined into model-ready examples."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.hashing import hash_uniform
from voxloom.functions.text import zero_padded
from voxloom.functions.vectors import as_double, is_finite_vector, zeros
from voxloom.operators.labels import lookup
from voxloom.operators.records import audio_quality, text_quality, visual_quality
from voxloom.schemas import MODALITIES


def check_modalities(names: Sequence[str]) -> tuple[str, ...]:
    """Non-empty, unique, known names in canonical order."""
    names = [str(n) for n in names]
    unknown = set(names) - set(MODALITIES)
    if not names or len(set(names)) != len(names) or unknown:
        raise ValueError(f"invalid modalities: {names}")
    return tuple(m for m in MODALITIES if m in names)


def index_alignment(manifest: DataFrame, index: DataFrame, flag: str, key: str = "sample_id") -> DataFrame:
    """Differences between available manifest rows and an index, both ways.

    One full join; per side the count and the five smallest ids (a report top-k).
    """
    left = manifest.where(flag).select(key, F.lit(True).alias("_m"))
    right = index.select(key, F.lit(True).alias("_i"))
    side = F.when(F.col("_i").isNull(), "missing").when(F.col("_m").isNull(), "extra")
    diff = left.join(right, key, "full").select(key, side.alias("side")).where("side is not null")
    counts = diff.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    heads = diff.withColumn("_r", F.row_number().over(Window.partitionBy("side").orderBy(key))).where("_r <= 5")
    shown = heads.groupBy("side").agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("first_ids"))
    return counts.join(shown, "side")


def assemble_examples(
    manifest: DataFrame, sources: Mapping[str, DataFrame], dims: Mapping[str, int],
    labels: Mapping[str, int], enabled: Sequence[str] = MODALITIES, frames_per_clip: int = 8,
) -> DataFrame:
    """Left joins of the enabled modalities only, with mask, quality and metadata.

    ``sources[m]`` has ``sample_id, vector`` and for audio ``clipping_fraction``, for
    visual ``valid_frame_count``.  Missing vectors, wrong shapes, rows without an active
    modality and unknown labels fail the job.
    """
    enabled = check_modalities(enabled)
    if set(enabled) - set(sources) or set(enabled) - set(dims):
        raise ValueError("every enabled modality needs a source and a dimension")
    joined = manifest
    for m in enabled:
        source = sources[m].select(
            "sample_id", F.col("vector").alias(f"_v_{m}"), F.lit(True).alias(f"_i_{m}"),
            *[F.col(c) for c in sources[m].columns if c in ("clipping_fraction", "valid_frame_count")],
        )
        joined = joined.join(source, "sample_id", "left")

    def active(m: str) -> Column:
        return F.coalesce(F.col(f"{m}_available"), F.lit(False)) if m in enabled else F.lit(False)

    def vector(m: str) -> Column:
        dim = int(dims.get(m, 1)) if m in enabled else 1
        if m not in enabled:
            return zeros(dim)
        v = as_double(F.col(f"_v_{m}"))
        broken = F.raise_error(F.concat(F.lit(f"missing or invalid {m} vector: "), "sample_id"))
        return F.when(
            active(m), F.when(is_finite_vector(v, dim), v).otherwise(broken.cast("array<double>"))
        ).otherwise(zeros(dim))

    def quality(m: str) -> Column:
        if m not in enabled:
            return F.lit(0.0)
        there = active(m) & F.coalesce(F.col(f"_i_{m}"), F.lit(False))
        if m == "audio":
            return audio_quality(there, F.col("clipping_fraction"))
        if m == "text":
            return text_quality(there, F.col("asr_confidence"), F.col("transcript_source"))
        return visual_quality(there, F.col("valid_frame_count"), frames_per_clip)

    mask = F.array(*[active(m) for m in MODALITIES])
    index = lookup(F.col("emotion"), labels)
    return joined.select(
        "sample_id", "split", "emotion", "language", "corpus", "speaker_id",
        F.when(index.isNotNull(), index).otherwise(F.raise_error("unsupported emotion").cast("int")).alias("label"),
        *[vector(m).alias(f"{m}_vector") for m in MODALITIES],
        F.when(F.exists(mask, lambda x: x), mask)
        .otherwise(F.raise_error("a sample has no enabled available modality").cast("array<boolean>"))
        .alias("modality_mask"),
        F.array(*[quality(m) for m in MODALITIES]).alias("quality"),
        F.create_map(
            *[
                x for c in ("transcript_source", "country", "region", "accent", "source_video_id")
                for x in (F.lit(c), F.col(c))
            ]
        ).alias("metadata"),
    )


def require_splits(df: DataFrame) -> None:
    """Training needs exactly the three splits; reads their names only."""
    found = {r["split"] for r in df.select("split").distinct().limit(10).collect()}
    if found != {"train", "validation", "test"}:
        raise ValueError(f"exactly train, validation and test are required, got {sorted(map(str, found))}")


def modality_dropout(mask: Column, sample_id: Column, probability: float, seed: int = 17) -> Column:
    """Drop available modalities at random, never all of them and never adding one.

    If every one would go, the available modality with the smallest hash survives.
    """
    if not 0.0 <= probability < 1.0:
        raise ValueError("dropout probability must be in [0, 1)")
    draws = F.array(*[hash_uniform(seed, sample_id, F.lit(m)) for m in MODALITIES])
    kept = F.zip_with(mask, draws, lambda m, u: m & (u >= probability))
    lowest = F.array_min(F.filter(draws, lambda u, i: F.get(mask, i)))
    survivor = F.zip_with(mask, draws, lambda m, u: m & (u == lowest))
    return (
        F.when(~F.exists(mask, lambda m: m), F.raise_error("an all-missing sample").cast("array<boolean>"))
        .when(F.exists(kept, lambda m: m), kept).otherwise(survivor)
    )


def modality_subset(mask: Column, names: Sequence[str] | None) -> Column:
    """Mask restricted to the named modalities."""
    if names is None:
        return mask
    allowed = check_modalities(names)
    return F.transform(
        mask, lambda m, i: m & F.get(F.array(*[F.lit(x in allowed) for x in MODALITIES]), i)
    )


def subset_violations(df: DataFrame, mask: str, names: Sequence[str]) -> DataFrame:
    """Rows a subset would leave without any input."""
    return df.where(~F.exists(modality_subset(F.col(mask), names), lambda m: m))


def stress_scenarios(enabled: Sequence[str]) -> list[tuple[str, ...]]:
    """Each single modality and, for three or more, each leave-one-out; never the full set."""
    enabled = check_modalities(enabled)
    candidates = [(m,) for m in enabled]
    if len(enabled) > 2:
        candidates += [tuple(m for m in enabled if m != gone) for gone in enabled]
    return [s for s in dict.fromkeys(candidates) if s != enabled]


def versioned_examples(df: DataFrame) -> DataFrame:
    """Read-side rules of the four example schema versions.

    Version 1 has no speaker and split, metadata exists from version 4 on; absent fields
    default to ``unknown``.  ``violation`` names the first broken rule.
    """
    v = F.col("schema_version")
    needs_speaker = (v >= 2) == (F.col("speaker_id").isNotNull() & F.col("split").isNotNull())
    neither = (v >= 2) | (F.col("speaker_id").isNull() & F.col("split").isNull())
    needs_metadata = (v >= 4) == F.col("metadata").isNotNull()
    rank_ok = (v >= 3) | (F.col("steps") == 0)
    violation = (
        F.when(~F.coalesce(v.between(1, 4), F.lit(False)), "unsupported_version")
        .when(~(needs_speaker & neither & needs_metadata), "field_set")
        .when(~rank_ok, "temporal_matrix_not_allowed")
        .when((F.size("modality_mask") != 3) | (F.size("quality") != 3), "mask_or_quality_shape")
        .when(~(is_finite_vector(F.col("embedding")) & is_finite_vector(F.col("quality"))), "non_finite")
    )
    unknown = F.lit("unknown")
    return df.select(
        "sample_id", "schema_version", F.coalesce("speaker_id", unknown).alias("speaker_id"),
        F.coalesce("split", unknown).alias("split"), "metadata", "embedding", "modality_mask", "quality",
        violation.alias("violation"),
    )


def synthetic_examples(
    df: DataFrame, index: str, dims: Mapping[str, int], n_labels: int = 4, seed: int = 17,
    split: str = "synthetic",
) -> DataFrame:
    """Learnable examples from a row index: cyclic labels, seven masks, class signal, noise."""
    i = F.col(index)
    label = (i % n_labels).cast("int")
    language = F.element_at(F.array(*[F.lit(x) for x in ("en", "zh", "unknown")]), (i % 3 + 1).cast("int"))
    corpus = F.element_at(
        F.array(*[F.lit(x) for x in ("synthetic_a", "synthetic_b", "unknown")]),
        (F.floor(i / 3) % 3 + 1).cast("int"),
    )
    patterns = [(1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    masks = F.array(*[F.array(*[F.lit(bool(x)) for x in p]) for p in patterns])
    base = df.select(
        F.concat(F.lit(f"synthetic-{seed}-"), zero_padded(i, 10)).alias("sample_id"),
        i.alias("_i"), label.alias("label"), language.alias("language"), corpus.alias("corpus"),
        F.element_at(masks, (i % 7 + 1).cast("int")).alias("modality_mask"),
        F.concat(F.lit(f"{split}-speaker-"), zero_padded(F.floor(i / n_labels), 10)).alias("speaker_id"),
        F.lit(split).alias("split"),
    )

    def vector(position: int, modality: str) -> Column:
        dim = int(dims[modality])

        def value(p: Column) -> Column:
            u1 = F.lit(1.0) - hash_uniform(seed, F.col("_i"), F.lit(modality), p, F.lit("r"))
            u2 = hash_uniform(seed, F.col("_i"), F.lit(modality), p, F.lit("a"))
            noise = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
            hit = lambda shift: p == (F.col("label") + shift) % dim
            return (
                F.lit(0.20) * noise
                + F.when(hit(0), 1.5).otherwise(0.0)
                + F.when(hit(4), F.when(F.col("language") == "zh", 0.3).otherwise(-0.3)).otherwise(0.0)
                + F.when(hit(7), F.when(F.col("corpus") == "synthetic_b", 0.2).otherwise(-0.2)).otherwise(0.0)
            )

        made = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)
        return F.when(F.get("modality_mask", F.lit(position)), made).otherwise(zeros(dim))

    quality = F.transform(
        F.array(*[hash_uniform(seed, F.col("_i"), F.lit(m), F.lit("quality")) for m in MODALITIES]),
        lambda u, p: F.when(F.get("modality_mask", p), F.lit(0.25) + F.lit(0.75) * u).otherwise(0.0),
    )
    return base.select(
        "sample_id", "label", "language", "corpus", "modality_mask", "speaker_id", "split",
        quality.alias("quality"),
        *[vector(n, m).alias(f"{m}_vector") for n, m in enumerate(MODALITIES)],
    )
