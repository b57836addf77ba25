"""Structural checks and small projections of raw records."""

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import is_safe_path
from voxloom.functions.vectors import clip01
from voxloom.schemas import MODALITIES, TRUSTED_TRANSCRIPT_SOURCES


def path_columns(path: Column) -> list[Column]:
    """source / dialogue / speaker turn = first three parts; speaker = last suffix."""
    parts = F.split(path, "/")
    turn = F.get(parts, F.lit(2))
    deep = F.size(parts) >= 4
    return [
        F.when(deep, F.get(parts, F.lit(0))).alias("source_id"),
        F.when(deep, F.get(parts, F.lit(1))).alias("dialogue_id"),
        F.when(deep, turn).alias("speaker_turn_id"),
        F.when(deep, F.substring_index(turn, "_", -1)).alias("speaker_id"),
    ]


def record_violations(
    speaker: Column, path_speaker: Column, emotion: Column, transcript: Column,
    duration: Column, file_path: Column, expected_path: Column, media_bytes: Column,
    minimum_bytes: int = 44,
) -> Column:
    """Codes of every structural rule a raw annotation record breaks."""

    def empty(c: Column) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    safe = F.coalesce(is_safe_path(file_path), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(empty(speaker), "missing_speaker"),
            F.when(~empty(speaker) & ~F.trim(speaker).eqNullSafe(path_speaker), "speaker_mismatch"),
            F.when(empty(emotion), "missing_emotion"),
            F.when(empty(transcript), "empty_transcript"),
            F.when(~F.coalesce(duration > 0, F.lit(False)), "invalid_duration"),
            F.when(~safe, "unsafe_path"),
            F.when(safe & ~file_path.eqNullSafe(expected_path), "path_mismatch"),
            F.when(
                safe & ~F.coalesce(media_bytes > minimum_bytes, F.lit(False)), "missing_or_empty_media"
            ),
        )
    )


def mask_column(prefix: str = "") -> Column:
    return F.array(*[F.coalesce(F.col(f"{prefix}{m}_available"), F.lit(False)) for m in MODALITIES])


def modality_pattern(mask: Column) -> Column:
    """Available modalities as a subset of the letters A, T, V."""
    return F.concat(*[F.when(F.get(mask, F.lit(i)), letter).otherwise("") for i, letter in enumerate("ATV")])


def select_available(df: DataFrame, flag: str, payload: str, limit: int, order: str) -> DataFrame:
    """First ``limit`` extraction inputs by id (a top-k, not a sort of the table)."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return df.where(F.col(flag) & F.col(payload).isNotNull()).orderBy(order).limit(limit)


def audio_quality(indexed: Column, clipping_fraction: Column) -> Column:
    return _quality(indexed, F.lit(1.0) - F.coalesce(clipping_fraction, F.lit(0.0)), "audio")


def text_quality(indexed: Column, asr_confidence: Column, transcript_source: Column) -> Column:
    trusted = F.lower(F.coalesce(transcript_source, F.lit(""))).isin(list(TRUSTED_TRANSCRIPT_SOURCES))
    return _quality(
        indexed, F.coalesce(asr_confidence, F.when(trusted, 1.0).otherwise(0.0)), "text"
    )


def visual_quality(indexed: Column, valid_frames: Column, frames_per_clip: int) -> Column:
    if frames_per_clip <= 0:
        raise ValueError("frames_per_clip must be positive")
    frames = F.coalesce(valid_frames, F.lit(0)).cast("double")
    return _quality(indexed, frames / F.lit(float(frames_per_clip)), "visual")


def _quality(indexed: Column, value: Column, modality: str) -> Column:
    broken = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    checked = F.when(broken, F.raise_error(f"non-finite {modality} quality").cast("double")).otherwise(value)
    return F.when(F.coalesce(indexed, F.lit(False)), clip01(checked)).otherwise(0.0)


def unpivot_quality(df: DataFrame, enabled=MODALITIES) -> DataFrame:
    """Quality and availability per enabled modality; inactive rows count as zero."""
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("modality"), F.col(f"q_{m}").alias("quality"),
                F.col(f"{m}_available").alias("available"),
            )
            for m in enabled
        ]
    )
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    return long.groupBy("modality").agg(
        F.count_if("available").alias("available"),
        F.min("quality").alias("min_quality"),
        F.avg("quality").alias("mean_quality"),
        F.max("quality").alias("max_quality"),
    )
