"""Whole builds on generated corpus folders."""

import json
from collections import Counter

from test_sources import wav, write
from voxloom.operators import rules
from voxloom.plans.builders import annotation_corpus, filename_corpus
from voxloom.schemas import EMOTION_LABELS


def test_filename_corpus(spark, tmp_path):
    people = [f"{1001 + i},30,{'Male' if i % 2 else 'Female'},x,y" for i in range(24)]
    write(tmp_path / "VideoDemographics.csv", "\n".join(["ActorID,Age,Sex,Race,Ethnicity", *people]), "utf-8-sig")
    names = [f"{1001 + i}_DFA_{e}_XX" for i in range(24) for e in ("ANG", "HAP", "NEU", "SAD")] + ["1001_IEO_DIS_HI"]
    write(tmp_path / "SentenceFilenames.csv", "\n".join(["N,Filename", *[f"{i},{n}" for i, n in enumerate(names)]]))
    (tmp_path / "VideoFlash").mkdir()
    for n in names:
        wav(tmp_path / "AudioWAV" / f"{n}.wav")
        (tmp_path / "VideoFlash" / f"{n}.flv").write_bytes(b"FLV" + bytes(300))
    (tmp_path / "VideoFlash" / f"{names[0]}.flv").write_bytes(b"tiny")
    built = filename_corpus(spark, str(tmp_path), "acted", pilot={"train": 4, "validation": 2, "test": 2})
    rows = built["manifest"].collect()
    assert len(rows) == 96 and sum(not r.visual_available for r in rows) == 1
    assert {r.duration for r in rows} == {0.02} and {r.transcript for r in rows} == {"Don't forget a jacket."}
    per_split = Counter(r.split for r in built["speakers"].collect())
    assert per_split == {"train": 16, "validation": 4, "test": 4}
    assert built["pilot"].count() == 8 * 4
    assert [(r.reason, r.n) for r in built["exclusions"].collect()] == [("source_emotion:DIS", 1)]
    assert [tuple(r) for r in built["media_problems"].collect()] == [(names[0], "video", "unusable")]
    rules.raise_for_errors(rules.validate(built["manifest"], EMOTION_LABELS))


def test_annotation_corpus(spark, tmp_path):
    def add(pair, speaker, i, emotion, **changes):
        rel = f"G{pair}/D{pair}/D{pair}_{speaker}/r{pair}{speaker}{i}"
        doc = {
            "data": {"x": {"emotion": emotion}}, "speaker_id": speaker, "emotion_result": emotion, "content": f"你好{pair}{speaker}{i}",
            "paragraphs": {"startTime": 0.0, "endTime": 0.02, "duration": 0.02}, "file_path": f"{rel}.wav", **changes,
        }
        write(tmp_path / "json" / f"{rel}.json", json.dumps(doc))
        wav(tmp_path / "wav" / f"{rel}.wav", 2, 44100, 882)

    for pair in range(3):
        for speaker in (f"A{pair}", f"B{pair}"):
            for i, emotion in enumerate(EMOTION_LABELS):
                add(pair, speaker, i, emotion)
    add(0, "A0", 8, "surprised")
    add(0, "A0", 9, "happy", speaker_id="Z")
    add(1, "A1", 9, "happy", paragraphs={"startTime": 0.0, "endTime": 9.0, "duration": 9.0})
    built = annotation_corpus(spark, str(tmp_path), "dialogues", "zh", pilot_per_class=1)
    assert built["manifest"].count() == 24 and built["pilot"].count() == 12
    split_of = {r.speaker_id: r.split for r in built["speakers"].collect()}
    assert all(split_of[f"A{p}"] == split_of[f"B{p}"] for p in range(3)) and len(set(split_of.values())) == 3
    bad = Counter(v for r in built["quarantine"].collect() for v in r.violations)
    assert bad == {"speaker_mismatch": 1, "duration_mismatch": 1}
    assert [(r.reason, r.n) for r in built["exclusions"].collect()] == [("source_emotion:surprised", 1)]
    rules.raise_for_errors(rules.validate(built["manifest"], EMOTION_LABELS))
