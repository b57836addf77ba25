"""Explicit schemas and closed vocabularies."""

from pyspark.sql import types as T

MODALITIES = ("audio", "text", "visual")
SPLITS = ("train", "validation", "test")
SPLIT_RATIOS = (0.70, 0.15, 0.15)

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _fields(names, dtype, nullable=True):
    return [T.StructField(n, dtype, nullable) for n in names]


# --- Fixed values: they must equal the published corpora's definitions. ---
MANIFEST = T.StructType(
    [
        T.StructField("sample_id", _S),
        T.StructField("audio_path", _S),
        T.StructField("video_path", _S),
        T.StructField("transcript", _S),
        T.StructField("emotion", _S),
        T.StructField("speaker_id", _S),
        T.StructField("language", _S),
        T.StructField("corpus", _S),
        T.StructField("split", _S),
        T.StructField("duration", _D),
        T.StructField("transcript_source", _S),
        T.StructField("asr_confidence", _D),
        T.StructField("audio_available", _B),
        T.StructField("text_available", _B),
        T.StructField("visual_available", _B),
        T.StructField("country", _S),
        T.StructField("region", _S),
        T.StructField("accent", _S),
        T.StructField("source_video_id", _S),
        T.StructField("source_emotion", _S),
        T.StructField("sentence_code", _S),
        T.StructField("intensity", _S),
    ]
)
# The trailing seven columns may be absent from a manifest line.
OPTIONAL_COLUMNS = (
    "country", "region", "accent", "source_video_id",
    "source_emotion", "sentence_code", "intensity",
)
REQUIRED_COLUMNS = tuple(n for n in MANIFEST.fieldNames() if n not in OPTIONAL_COLUMNS)

ISSUE_COLUMNS = ("code", "severity", "subject", "sample_id")

ANNOTATION = T.StructType(
    [
        T.StructField(
            "data",
            T.MapType(_S, T.StructType(_fields(["emotion", "Confidence_degree"], _S))),
        ),
        T.StructField("speaker_id", _S),
        T.StructField("emotion_result", _S),
        T.StructField("content", _S),
        T.StructField("paragraphs", T.StructType(_fields(["startTime", "endTime", "duration"], _D))),
        T.StructField("file_path", _S),
    ]
)

EMBEDDING_INDEX = T.StructType(
    [
        T.StructField("sample_id", _S),
        T.StructField("cache_path", _S),
        T.StructField("embedding_dimension", T.IntegerType()),
        T.StructField("clipping_fraction", _D),
        T.StructField("valid_frame_count", T.IntegerType()),
    ]
)

EMOTION_LABELS = {"angry": 0, "happy": 1, "neutral": 2, "sad": 3}
FILENAME_LABELS = {"ANG": "angry", "HAP": "happy", "NEU": "neutral", "SAD": "sad"}
ANNOTATION_LABELS = {"angry": "angry", "happy": "happy", "neutral": "neutral", "sad": "sad"}
FILENAME_PATTERN = r"^([0-9]{4})_([A-Z]{3})_([A-Z]{3})_([A-Z]{2})$"
PROMPT_SENTENCES = {
    "IEO": "It's eleven o'clock.",
    "TIE": "That is exactly what happened.",
    "IOM": "I'm on my way to the meeting.",
    "IWW": "I wonder what this is about.",
    "TAI": "The airplane is almost full.",
    "MTI": "Maybe tomorrow it will be cold.",
    "IWL": "I would like a new alarm clock.",
    "ITH": "I think I have a doctor's appointment.",
    "DFA": "Don't forget a jacket.",
    "ITS": "I think I've seen this before.",
    "TSI": "The surface is slick.",
    "WSI": "We'll stop in a couple of minutes.",
}
TRUSTED_TRANSCRIPT_SOURCES = (
    "gold", "manual", "provided", "scripted", "official_prompt", "official_audio_transcript",
)
ERROR_CODES = frozenset(
    {
        "duplicate_sample_id", "duplicate_audio_across_splits", "duplicate_video_across_splits",
        "speaker_split_overlap", "speaker_train_test_overlap", "source_video_split_overlap",
        "no_available_modality", "unsupported_label", "missing_availability_metadata",
        "missing_required_value", "availability_path_mismatch", "availability_text_mismatch",
        "invalid_asr_confidence", "invalid_duration", "invalid_split", "path_outside_root",
        "missing_audio", "missing_video", "empty_audio", "empty_video",
        "corrupt_audio", "corrupt_video",
    }
)
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".flv", ".webm")
# --- End of fixed values. ---
