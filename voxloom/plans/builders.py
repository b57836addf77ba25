"""From raw corpus folders to manifests: the operators put together.

Both builders return lazy DataFrames; nothing is written before the caller has validated
them with :func:`voxloom.operators.rules.validate`.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions.text import filename_parts
from voxloom.operators import graph, joins, labels, records, splits
from voxloom.schemas import (
    ANNOTATION_LABELS, FILENAME_LABELS, MANIFEST, PROMPT_SENTENCES, SPLIT_RATIOS,
)
from voxloom.sources import media, tables

MIN_MEDIA_BYTES = 256
DURATION_TOLERANCE = 0.1


def _below(spark: SparkSession, path: Column, folder: str) -> Column:
    return tables.relative_path(path, tables.root_path(spark, folder))


def _manifest(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Manifest columns in order; unnamed ones are NULL."""
    types = {f.name: f.dataType for f in MANIFEST.fields}
    return df.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def filename_corpus(
    spark: SparkSession, root: str, corpus: str, language: str = "en", seed: int = 17,
    ratios: Sequence[float] = SPLIT_RATIOS, pilot: Mapping[str, int] | None = None,
    audio: str = "AudioWAV", video: str = "VideoFlash",
    keys: tuple[str, str, list[str]] = ("SentenceFilenames.csv", "Filename", ["Stimulus_Number", "Filename"]),
    actors: tuple[str, str, str, list[str]] = (
        "VideoDemographics.csv", "ActorID", "Sex", ["ActorID", "Age", "Sex", "Race", "Ethnicity"],
    ),
) -> dict[str, DataFrame]:
    """Corpus whose labels are in the file names and whose actors are in a CSV file."""
    file, column, columns = keys
    names = tables.read_key_list(spark, f"{root}/{file}", column, columns)
    parsed = names.select("key", *filename_parts(F.col("key")))
    parsed = parsed.withColumn(
        "actor", F.when(F.col("actor").isNotNull(), F.col("actor")).otherwise(
            F.raise_error(F.concat(F.lit("invalid file name: "), "key"))
        ),
    )
    file, actor, stratum, columns = actors
    people = tables.read_dimension(spark, f"{root}/{file}", actor, stratum, columns)
    assigned = splits.stratified_group_split(
        people.select(F.col(actor).alias("actor"), F.col(stratum).alias("stratum")), "actor", "stratum", seed, ratios
    )
    chosen = splits.balanced_pilot(
        assigned, "actor", "stratum", pilot or {"train": 8, "validation": 2, "test": 2}, seed
    )
    stem = lambda c: F.upper(F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1))
    clips = media.wav_header(media.read_media(spark, f"{root}/{audio}", "*.wav")).select(
        stem(F.col("path")).alias("key"), _below(spark, F.col("path"), f"{root}/{audio}").alias("audio_file"),
        F.col("duration").alias("wav_duration"),
        ((F.col("length") > MIN_MEDIA_BYTES) & F.coalesce(F.col("duration") > 0, F.lit(False))).alias("has_audio"),
    )
    # The content column is not selected, so only the listing is read.
    videos = media.read_media(spark, f"{root}/{video}").select(
        stem(F.col("path")).alias("key"), _below(spark, F.col("path"), f"{root}/{video}").alias("video_file"),
        (F.col("length") > MIN_MEDIA_BYTES).alias("has_video"),
    )
    kept = labels.map_labels(parsed, "emotion", FILENAME_LABELS, "label")
    kept = labels.lookup_codes(kept, "sentence", PROMPT_SENTENCES, "transcript")
    kept = joins.dim_join(kept, assigned.select("actor", "split"), "actor")
    rows = kept.join(clips, "key", "left").join(videos, "key", "left")
    heard, seen = F.coalesce("has_audio", F.lit(False)), F.coalesce("has_video", F.lit(False))
    transcript = F.when(F.col("code_known"), F.col("transcript")).otherwise(
        F.raise_error(F.concat(F.lit("unknown sentence code: "), "sentence"))
    )
    manifest = _manifest(
        rows,
        {
            "sample_id": F.concat(F.lit(f"{corpus}-"), "key"), "transcript": transcript, "emotion": F.col("label"),
            "audio_path": F.when(heard, F.concat(F.lit(f"{audio}/"), "audio_file")),
            "video_path": F.when(seen, F.concat(F.lit(f"{video}/"), "video_file")),
            "speaker_id": F.col("actor"), "language": F.lit(language), "corpus": F.lit(corpus), "split": F.col("split"),
            "duration": F.when(heard, F.col("wav_duration")), "transcript_source": F.lit("official_prompt"),
            "audio_available": heard, "text_available": F.lit(True), "visual_available": seen,
            "source_video_id": F.col("key"), "source_emotion": F.col("emotion"), "sentence_code": F.col("sentence"),
            "intensity": F.col("intensity"),
        },
    )
    picked = chosen.select(F.col("actor").alias("speaker_id"))
    problem = lambda kind, file, good: F.struct(
        F.lit(kind).alias("kind"), F.when(F.col(file).isNull(), "missing").when(~good, "unusable").alias("problem")
    )
    problems = rows.select(
        "key", F.explode(F.array(problem("audio", "audio_file", heard), problem("video", "video_file", seen))).alias("_p")
    ).where("_p.problem is not null").select("key", "_p.*")
    return {
        "manifest": manifest, "media_problems": problems, "pilot": joins.semi_subset(manifest, picked, "speaker_id"), "speakers": assigned,
        "exclusions": labels.label_exclusions(parsed, "emotion", FILENAME_LABELS),
    }


def annotation_corpus(
    spark: SparkSession, root: str, corpus: str, language: str, seed: int = 17,
    ratios: Sequence[float] = SPLIT_RATIOS, pilot_per_class: int = 16, annotations: str = "json", audio: str = "wav",
    split_method: str = "exact",
) -> dict[str, DataFrame]:
    """Corpus of one JSON annotation per WAV file; speakers who meet stay in one split."""
    docs = tables.read_annotations(spark, f"{root}/{annotations}")
    clips = media.wav_header(media.read_media(spark, f"{root}/{audio}", "*.wav")).select(
        _below(spark, F.col("path"), f"{root}/{audio}").alias("expected"), F.col("length").alias("bytes"),
        F.col("duration").alias("measured"),
    )
    located = docs.withColumn("expected", F.regexp_replace("relative_path", r"\.json$", ".wav")).select(
        *[F.col(c) for c in docs.columns if c != "speaker_id"], "expected", F.trim("speaker_id").alias("speaker"),
        *records.path_columns(F.col("relative_path")),
    ).join(clips, "expected", "left")
    duration = F.col("paragraphs.duration")
    broken = records.record_violations(
        F.col("speaker"), F.col("speaker_id"), F.col("emotion_result"), F.col("content"), duration,
        F.replace("file_path", F.lit("\\"), F.lit("/")), F.col("expected"), F.col("bytes"),
    )
    differs = ~F.coalesce(F.abs(duration - F.col("measured")) <= DURATION_TOLERANCE, F.lit(False))
    checked = located.withColumn(
        "violations", F.array_compact(F.array_append(broken, F.when(differs, "duration_mismatch")))
    )
    good = checked.where(F.size("violations") == 0).withColumn("raw", F.lower(F.trim("emotion_result")))

    edges = graph.cooccurrence_edges(good, "speaker_id", "dialogue_id")
    components = graph.connected_components(good, edges, "speaker_id")
    members = good.select("speaker_id", "raw").join(components, "speaker_id")
    stats = splits.component_table(members, "component", "speaker_id", "raw", list(ANNOTATION_LABELS))
    placed = splits.component_split(stats, "component", len(ANNOTATION_LABELS), ratios, split_method)
    speakers = components.join(placed, "component").select("speaker_id", "component", "split")
    rows = labels.map_labels(good, "raw", ANNOTATION_LABELS, "label").join(speakers, "speaker_id")
    stem = F.regexp_extract("relative_path", r"([^/]+)\.json$", 1)
    manifest = _manifest(
        rows,
        {
            "sample_id": F.concat(F.lit(f"{corpus}-"), stem), "audio_path": F.concat(F.lit(f"{audio}/"), "expected"),
            "transcript": F.trim("content"), "emotion": F.col("label"), "speaker_id": F.col("speaker_id"),
            "language": F.lit(language), "corpus": F.lit(corpus), "split": F.col("split"), "duration": duration,
            "transcript_source": F.lit("official_audio_transcript"), "audio_available": F.lit(True),
            "text_available": F.lit(True), "visual_available": F.lit(False), "source_video_id": F.col("source_id"),
            "source_emotion": F.col("raw"),
        },
    )
    return {
        "manifest": manifest, "speakers": speakers,
        "pilot": splits.hash_topk(manifest, ["split", "emotion"], "sample_id", pilot_per_class, seed).drop("rank"),
        "quarantine": checked.where(F.size("violations") > 0).select("relative_path", "violations"),
        "exclusions": labels.label_exclusions(good, "raw", ANNOTATION_LABELS),
    }
