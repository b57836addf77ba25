"""One positive and one negative row per validation code."""

import pytest

from conftest import base_row, manifest_of
from voxloom.operators import rules
from voxloom.schemas import EMOTION_LABELS

LABELS = list(EMOTION_LABELS)

ROW_CASES = [
    ("missing_required_value", {"speaker_id": "  "}, "error"),
    ("missing_required_value", {"language": None}, "error"),
    ("invalid_split", {"split": "dev"}, "error"),
    ("unsupported_label", {"emotion": "calm"}, "error"),
    ("missing_availability_metadata", {"audio_available": None}, "error"),
    ("no_available_modality", {"text_available": False}, "error"),
    ("availability_path_mismatch", {"audio_available": True}, "error"),
    ("availability_path_mismatch", {"visual_available": True, "video_path": ""}, "error"),
    ("availability_text_mismatch", {"transcript": " \t"}, "error"),
    ("invalid_asr_confidence", {"asr_confidence": 1.01}, "error"),
    ("invalid_duration", {"duration": 0.0}, "error"),
]


@pytest.mark.parametrize("code,changes,severity", ROW_CASES)
def test_row_rule(spark, code, changes, severity):
    found = rules.row_rules(manifest_of(spark, [base_row(**changes)]), LABELS).collect()
    assert [(r.code, r.severity) for r in found] == [(code, severity)]


def test_valid_row_has_no_issue(spark):
    rows = [base_row(asr_confidence=1.0, duration=None), base_row(sample_id="b", speaker_id="s2", transcript="other words")]
    assert rules.validate(manifest_of(spark, rows), LABELS).count() == 0


GROUP_CASES = [
    ("audio", {"audio_path": "x.wav"}, "duplicate_audio_across_splits"),
    ("video", {"video_path": "x.mp4"}, "duplicate_video_across_splits"),
    ("source", {"source_video_id": "v"}, "source_video_split_overlap"),
    ("text", {"transcript": "Hello, THERE!"}, "duplicate_transcript_across_splits"),
]


@pytest.mark.parametrize("kind,shared,code", GROUP_CASES)
def test_shared_across_splits(spark, kind, shared, code):
    rows = [base_row(**shared), base_row(sample_id="b", speaker_id="s2", **shared)]
    rows[1]["split"] = "validation"
    found = rules.group_issues(manifest_of(spark, rows), [kind]).collect()
    assert {(r.code, r.sample_id) for r in found} == {(code, "a"), (code, "b")}


@pytest.mark.parametrize("column,kind", [("audio_path", "audio"), ("video_path", "video")])
def test_shared_within_split_is_a_warning(spark, column, kind):
    rows = [base_row(**{column: "x"}), base_row(sample_id="b", **{column: "x"})]
    found = rules.group_issues(manifest_of(spark, rows), [kind]).collect()
    assert {(r.code, r.severity) for r in found} == {(f"duplicate_{kind}", "warning")}


def test_speaker_overlap_folds_case_and_names_train_test(spark):
    rows = [base_row(split="Train"), base_row(sample_id="b", split="train"), base_row(sample_id="c", split="TEST")]
    found = rules.group_issues(manifest_of(spark, rows), ["speaker"]).collect()
    assert {r.code for r in found} == {"speaker_split_overlap", "speaker_train_test_overlap"}
    assert len(found) == 6


def test_duplicate_ids_once_per_id(spark):
    rows = [base_row(), base_row(), base_row()]
    found = rules.group_issues(manifest_of(spark, rows), ["sample_id"]).collect()
    assert [(r.code, r.sample_id) for r in found] == [("duplicate_sample_id", "a")]


def test_empty_keys_are_skipped(spark):
    rows = [base_row(audio_path="", transcript="..."), base_row(sample_id="b", audio_path="", transcript="!", split="test", speaker_id="s2")]
    assert rules.group_issues(manifest_of(spark, rows)).count() == 0


def test_imbalance_and_confounding(spark):
    rows = [base_row(sample_id=str(i), speaker_id=str(i), transcript=f"text number {i}") for i in range(3)]
    rows += [base_row(sample_id="z", speaker_id="z", emotion="sad", language="de", corpus="c2", transcript="anders")]
    codes = {r.code for r in rules.validate(manifest_of(spark, rows), LABELS).collect()}
    assert codes == {"class_imbalance", "language_corpus_confounding"}


@pytest.mark.parametrize("path,bad", [("../x.wav", True), ("a/../../x.wav", True), ("/etc/x.wav", True), ("a/../x.wav", False), ("a/x.wav", False)])
def test_paths_stay_inside_root(spark, path, bad):
    df = manifest_of(spark, [base_row(audio_available=True, audio_path=path)])
    found = [r.code for r in rules.row_rules(df, LABELS, check_paths=True).collect()]
    assert found == (["path_outside_root"] if bad else [])


def test_gate(spark):
    good = rules.validate(manifest_of(spark, [base_row()]), LABELS)
    rules.raise_for_errors(good)
    with pytest.raises(rules.ManifestValidationError, match="invalid_split"):
        rules.raise_for_errors(rules.validate(manifest_of(spark, [base_row(split="x")]), LABELS))
