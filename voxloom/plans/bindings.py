"""Roles of the given tables: which columns play which part of a corpus."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions.hashing import hash_key, hash_ranked, hash_uniform
from voxloom.functions.text import zero_padded
from voxloom.operators.splits import split_by_rank
from voxloom.schemas import ANNOTATION_LABELS, SPLIT_RATIOS

SOURCE_EMOTIONS = ("angry", "happy", "neutral", "sad", "fearful", "disgusted", "surprised")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_split(key: Column) -> Column:
    """Row-wise 70/15/15 split by hash; deliberately ignores speakers."""
    u = hash_uniform(17, key)
    return F.when(u < 0.70, "train").when(u < 0.85, "validation").otherwise("test")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterance records, before the label policy is applied."""
    docs = table(spark, sf_dir, "documents")
    has_audio = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.lit(True).alias("_audio")
    )
    ratings = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.lit(True).alias("_visual"),
        ((F.col("quality") + F.col("toxic")).cast("double") / F.lit(2.0)).alias("asr_confidence"),
    )
    joined = docs.join(has_audio, "doc_id", "left").join(ratings, "doc_id", "left")
    audio = F.coalesce("_audio", F.lit(False))
    visual = F.coalesce("_visual", F.lit(False))
    emotions = F.array(*[F.lit(e) for e in SOURCE_EMOTIONS])
    null = F.lit(None).cast("string")
    return joined.select(
        "doc_id",
        F.concat(F.lit("doc-"), zero_padded(F.col("doc_id"), 8)).alias("sample_id"),
        F.when(
            audio, F.concat(F.lit("audio/"), F.sha2("text", 256), F.lit(".wav"))
        ).alias("audio_path"),
        F.when(
            visual, F.concat(F.lit("video/"), F.col("doc_id").cast("string"), F.lit(".mp4"))
        ).alias("video_path"),
        F.col("text").alias("transcript"),
        F.element_at(emotions, (F.col("doc_id") % 7 + 1).cast("int")).alias("source_emotion"),
        F.col("source").alias("speaker_id"),
        F.col("lang").alias("language"),
        F.concat(
            F.lit("corpus"), (F.substring("source", 4, 10).cast("int") % 4).cast("string")
        ).alias("corpus"),
        row_split(F.col("doc_id")).alias("split"),
        (F.col("n_chars").cast("double") / F.lit(15.0)).alias("duration"),
        F.when(F.col("doc_id") % 3 == 0, "gold")
        .when(F.col("doc_id") % 3 == 1, "asr")
        .alias("transcript_source"),
        "asr_confidence",
        audio.alias("audio_available"),
        (F.length(F.trim("text")) > 0).alias("text_available"),
        visual.alias("visual_available"),
        null.alias("country"),
        null.alias("region"),
        null.alias("accent"),
        F.concat(
            F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / 10).cast("string")
        ).alias("source_video_id"),
        null.alias("sentence_code"),
        null.alias("intensity"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-label utterance table; other source labels are excluded, never merged."""
    from voxloom.operators.labels import map_labels

    return map_labels(raw_records(spark, sf_dir), "source_emotion", ANNOTATION_LABELS, "emotion")


def speaker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage-free counterpart: whole speakers ranked by hash and cut at 70/15/15."""
    speakers = table(spark, sf_dir, "documents").select(F.col("source").alias("speaker_id")).distinct()
    keyed = speakers.withColumn("_h", hash_key(17, F.col("speaker_id")))
    ranked = hash_ranked(keyed.withColumn("_all", F.lit(0)), ["_all"], "_h", "speaker_id")
    return ranked.select("speaker_id", split_by_rank("rn", "n", SPLIT_RATIOS).alias("split_grp"))


def grouped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest whose ``split`` keeps every speaker whole."""
    splits = speaker_split(spark, sf_dir)
    return (
        manifest(spark, sf_dir).drop("split").join(splits, "speaker_id")
        .withColumnRenamed("split_grp", "split")
    )


def vector_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with label, split and the metadata of their document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("lang"), F.col("source")
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("vector"),
        row_split(F.col("vec_id")).alias("split"),
    )
    return vectors.join(docs, "sample_id", "left").select(
        "sample_id",
        "label",
        "vector",
        "split",
        F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.coalesce("source", F.lit("unknown")).alias("speaker_id"),
    )
