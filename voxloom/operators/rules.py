"""Manifest validation: one long issue table ``(code, severity, subject, sample_id)``.

A rule that concerns a group yields one row per member, so a speaker holding a third of
the corpus never has its ids gathered into one array.
"""

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import normalize_text, stays_inside_root
from voxloom.schemas import ERROR_CODES, SPLITS
from voxloom.scratch import new_folder

IMBALANCE_RATIO = 3.0


class ManifestValidationError(RuntimeError):
    """Serious schema or leakage problems must stop the pipeline."""


def severity(code: Column) -> Column:
    return F.when(code.isin(sorted(ERROR_CODES)), "error").otherwise("warning")


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _missing(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def row_rules(df: DataFrame, labels: Iterable[str], check_paths: bool = False) -> DataFrame:
    """Rules that need one row only; a single narrow pass, no shuffle.

    ``check_paths`` adds ``path_outside_root`` for available media that leave the root.
    """
    c = F.col
    flags = [c("audio_available"), c("text_available"), c("visual_available")]
    checks = [
        ("missing_required_value", name, _blank(c(name)))
        for name in ("sample_id", "speaker_id", "language", "corpus", "split")
    ]
    checks += [
        ("invalid_split", "split", ~_true(c("split").isin(list(SPLITS)))),
        ("unsupported_label", "emotion", ~_true(c("emotion").isin(list(labels)))),
        (
            "missing_availability_metadata", "availability",
            flags[0].isNull() | flags[1].isNull() | flags[2].isNull(),
        ),
        ("no_available_modality", "availability", ~(_true(flags[0]) | _true(flags[1]) | _true(flags[2]))),
        ("availability_path_mismatch", "audio_path", _true(flags[0]) & _missing(c("audio_path"))),
        ("availability_path_mismatch", "video_path", _true(flags[2]) & _missing(c("video_path"))),
        ("availability_text_mismatch", "transcript", _true(flags[1]) & _blank(c("transcript"))),
        (
            "invalid_asr_confidence", "asr_confidence",
            c("asr_confidence").isNotNull() & ~c("asr_confidence").between(0.0, 1.0),
        ),
        # NaN sorts above every number in Spark but is not "<= 0" either, as wanted.
        ("invalid_duration", "duration", _true(c("duration") <= 0)),
    ]
    if check_paths:
        checks += [
            (
                "path_outside_root", path,
                _true(c(flag)) & ~_missing(c(path)) & ~_true(stays_inside_root(c(path))),
            )
            for flag, path in (("audio_available", "audio_path"), ("visual_available", "video_path"))
        ]
    found = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(subject).alias("subject")))
                for code, subject, cond in checks
            ]
        )
    )
    issues = df.select(F.explode(found).alias("i"), "sample_id")
    return issues.select(
        "i.code", severity(F.col("i.code")).alias("severity"), "i.subject", "sample_id"
    )


_GROUP_KEYS = {
    "sample_id": lambda: F.col("sample_id"),
    "audio": lambda: F.col("audio_path"),
    "video": lambda: F.col("video_path"),
    "speaker": lambda: F.col("speaker_id"),
    "source": lambda: F.col("source_video_id"),
    # Texts travel as digests: the shuffle key stays 64 bytes long.
    "text": lambda: F.sha2(normalize_text(F.col("transcript")), 256),
}
_EMPTY_TEXT = hashlib.sha256(b"").hexdigest()


def _keyed(df: DataFrame, kinds: Iterable[str]) -> DataFrame:
    keys = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                _GROUP_KEYS[kind]().alias("key"),
            )
            for kind in kinds
        ]
    )
    exploded = df.select("sample_id", "split", F.explode(keys).alias("k"))
    return exploded.select("sample_id", "split", "k.kind", "k.key").where(
        F.col("key").isNotNull() & ~F.col("key").isin("", _EMPTY_TEXT)
    )


def group_profile(df: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Size and splits of every shared key, for all kinds in one aggregation.

    Only counts and booleans are aggregated, so a hot key costs one row per task.
    """
    return _profile(_keyed(df, kinds))


def _profile(keyed: DataFrame) -> DataFrame:
    split, folded = F.coalesce("split", F.lit("")), F.lower(F.coalesce("split", F.lit("")))
    return keyed.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(split) != F.max(split)).alias("spans"),
        (F.min(folded) != F.max(folded)).alias("spans_folded"),
        F.bool_or(folded == "train").alias("in_train"),
        F.bool_or(folded == "validation").alias("in_validation"),
        F.bool_or(folded == "test").alias("in_test"),
    )


def _group_codes() -> Column:
    kind, n, spans = F.col("kind"), F.col("n"), F.col("spans")
    within = ~spans & (n > 1)
    return F.array_compact(
        F.array(
            F.when((kind == "sample_id") & (n > 1), "duplicate_sample_id"),
            F.when((kind == "audio") & spans, "duplicate_audio_across_splits"),
            F.when((kind == "audio") & within, "duplicate_audio"),
            F.when((kind == "video") & spans, "duplicate_video_across_splits"),
            F.when((kind == "video") & within, "duplicate_video"),
            F.when((kind == "speaker") & F.col("spans_folded"), "speaker_split_overlap"),
            F.when(
                (kind == "speaker") & F.col("in_train") & F.col("in_test"),
                "speaker_train_test_overlap",
            ),
            F.when((kind == "source") & spans, "source_video_split_overlap"),
            F.when((kind == "text") & spans & (n > 1), "duplicate_transcript_across_splits"),
        )
    )


def group_issues(df: DataFrame, kinds: Iterable[str] = tuple(_GROUP_KEYS)) -> DataFrame:
    """Duplicate and leakage rules over shared ids, paths, speakers, sources and texts.

    The keyed rows, whose texts are normalised and hashed, are written once to shared
    scratch.  They are profiled with partial aggregation, then the flagged keys are joined
    back to their members; adaptive execution splits a hot key on the member side.
    """
    kinds = tuple(kinds)
    folder = new_folder(df.sparkSession, "keyed-rows")
    _keyed(df, kinds).write.parquet(folder)
    keyed = df.sparkSession.read.parquet(folder)
    flagged = _profile(keyed).select("kind", "key", F.explode(_group_codes()).alias("code"))
    members = keyed.where("kind <> 'sample_id'") if set(kinds) - {"sample_id"} else None
    ids = flagged.where(F.col("kind") == "sample_id").select(
        "code", severity(F.col("code")).alias("severity"), F.col("key").alias("subject"),
        F.col("key").alias("sample_id"),
    )
    if members is None:
        return ids
    rest = members.join(flagged, ["kind", "key"]).select(
        "code", severity(F.col("code")).alias("severity"), F.col("key").alias("subject"), "sample_id"
    )
    return rest.unionByName(ids) if "sample_id" in kinds else rest


def class_imbalance(df: DataFrame, label: str, ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """Largest over smallest class count among the labels present."""
    return _imbalance(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), ratio)


def _imbalance(counts: DataFrame, ratio: float) -> DataFrame:
    spread = counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
    share = F.col("largest").cast("double") / F.col("smallest")
    return spread.where(F.col("smallest") > 0).select(
        "largest", "smallest", share.alias("ratio"), (share >= ratio).alias("imbalanced")
    )


def confounding(df: DataFrame, language: str, corpus: str) -> DataFrame:
    """Whether several languages exist and each occurs in exactly one corpus."""
    per_language = df.groupBy(language).agg(
        (F.min(corpus).eqNullSafe(F.max(corpus))).alias("one_corpus")
    )
    return per_language.agg(
        F.count(F.lit(1)).alias("languages"),
        F.count_if("one_corpus").alias("single_corpus_languages"),
        ((F.count(F.lit(1)) > 1) & F.bool_and("one_corpus")).alias("confounded"),
    )


def dataset_issues(df: DataFrame) -> DataFrame:
    """Imbalance and confounding, both from one small contingency table."""
    cells = df.groupBy("emotion", "language", "corpus").agg(F.count(F.lit(1)).alias("n"))
    per_label = cells.groupBy("emotion").agg(F.sum("n").alias("n"))
    found = [
        (_imbalance(per_label, IMBALANCE_RATIO), "imbalanced", "class_imbalance"),
        (confounding(cells, "language", "corpus"), "confounded", "language_corpus_confounding"),
    ]
    issues = [
        facts.where(flag).select(
            F.lit(code).alias("code"), severity(F.lit(code)).alias("severity"),
            F.lit("dataset").alias("subject"), F.lit(None).cast("string").alias("sample_id"),
        )
        for facts, flag, code in found
    ]
    return issues[0].unionByName(issues[1])


def validate(
    df: DataFrame, labels: Iterable[str], media: DataFrame | None = None,
    near_duplicates: DataFrame | None = None,
) -> DataFrame:
    """All rules as one issue table.

    ``media`` is an optional issue table from :mod:`voxloom.sources.media`,
    ``near_duplicates`` the pair table of :mod:`voxloom.operators.neardup`.
    """
    parts = [row_rules(df, labels, check_paths=True), group_issues(df), dataset_issues(df)]
    if media is not None:
        parts.append(media)
    if near_duplicates is not None:
        pair = F.concat_ws("/", "left_id", "right_id")
        parts.append(
            near_duplicates.select(
                F.lit("near_duplicate_transcript").alias("code"), F.lit("warning").alias("severity"),
                pair.alias("subject"), F.explode(F.array("left_id", "right_id")).alias("sample_id"),
            )
        )
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues


def issue_counts(issues: DataFrame) -> DataFrame:
    """Affected rows and distinct subjects per code."""
    per_subject = issues.groupBy("code", "severity", "subject").agg(F.count(F.lit(1)).alias("rows"))
    return per_subject.groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("subjects"), F.sum("rows").alias("rows")
    )


def raise_for_errors(issues: DataFrame) -> None:
    """Fail fast when any error exists; reads at most five rows to the driver."""
    errors = issues.where(F.col("severity") == "error").limit(5).collect()
    if errors:
        raise ManifestValidationError("; ".join(f"{r.code}: {r.subject} ({r.sample_id})" for r in errors))
