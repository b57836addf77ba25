"""What the generators of personal data propose, and what the fit learns from."""

import random

import pytest
from llm_helpers import by_id, docs, sentence

from voxloom.llm import pii


@pytest.mark.parametrize("written", [
    "carol [at] example.com", "carol(at)example.com", "carol{AT}mail.example.org", "carol at example.com", "carol at mail dot example dot com",
])
def test_spelt_at_signs_are_proposed(written):
    for text in (f"write {written}", f"write {written} or a@b.cc"):
        at = text.index("carol")
        assert any(a == at and text[a:b] == written for a, b, kind in pii.candidates(text) if kind == "email"), text


def test_spelt_at_sign_is_found(spark):
    rng, data = random.Random(6), []
    for i in range(250):
        mail = f" bob{i}.x@mail{i % 7}.example.com " if i % 2 else " 17 "
        data.append((i, sentence(rng, "en", 12) + mail + sentence(rng, "en", 8), "en", "s", 1))
    data += [(900, "carol [at] example.com wrote", "en", "s", 1), (901, "carol(at)example.com wrote", "en", "s", 1)]
    found = by_id(pii.find_personal(docs(spark, data)))
    assert found[900]["spans"] == "email:0:22" and found[901]["spans"] == "email:0:20"


def test_rare_kinds_get_a_threshold(spark, monkeypatch):
    """60 of 3,000 documents hold an ip, and a draw of 300 from all of them would see about 6."""
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 300)
    rng, data = random.Random(7), []
    for i in range(3000):
        own = f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.2.{rng.randint(0, 255)}" if i % 50 == 0 else f"{rng.randint(10**9, 10**11)}"
        data.append((i, f"{sentence(rng, 'en', 8)} {own} {sentence(rng, 'en', 5)}", "en", "s", 1))
    trees, thresholds = pii.fit(docs(spark, data))
    assert "ip" in thresholds
    chosen, stands = pii.draw(pii.kinds_of(docs(spark, data)))
    assert stands["ip", True] == 1 and 8 < stands["ip", False] < 12


def test_number_dense_text_still_gives_every_kind():
    text = " ".join(f"id 98765{n:05d}," for n in range(60)) + " then 1.2.3.4 and bob@mail.example.com"
    kinds = {k for _, y, k, _ in pii.examples(text) if y}
    assert {"ip", "email"} <= kinds
    from_candidates = [c for c in pii.candidates(text) if c[2] == "card"]
    cards = [w for _, _, k, w in pii.examples(text) if k == "card"]
    assert len(cards) <= pii.PER_KIND and abs(sum(cards) - len(from_candidates)) < 1e-6


def test_fit_takes_all_documents(spark, monkeypatch):
    """What a draw would take has no say in the fit."""
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(pii, "SAMPLE_KIND", 1)
    rng, data = random.Random(8), []
    for i in range(1200):
        own = f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.2.{rng.randint(0, 255)}" if i % 5 == 0 else f"{rng.randint(10**9, 10**11)}"
        data.append((i, f"{sentence(rng, 'en', 8)} {own} {sentence(rng, 'en', 5)}", "en", "s", 1))
    table = pii.example_table(docs(spark, data))
    assert table.where("kind = 'ip' and label = 1").count() >= 240 * 3 and table.agg({"weight": "max"}).first()[0] == 1
    trees, thresholds = pii.fit(docs(spark, data))
    assert "ip" in thresholds


def test_number_dense_text_gives_all_when_asked():
    text = " ".join(f"id 98765{n:05d}," for n in range(60)) + " then " + " ".join(f"1.2.3.{n}" for n in range(30))
    found = list(pii.examples(text, None, None))
    assert sum(k == "ip" and y for _, y, k, _ in found) == 30 * 3 and all(w == 1 for *_, w in found)
    assert sum(k == "card" for _, _, k, _ in found) == sum(c[2] == "card" for c in pii.candidates(text))


def test_documents_without_digit_or_base_span_give_examples(spark):
    """Addresses that only letters make up, and what merely looks like one, are candidates too."""
    texts = ["carol [at] example.com wrote", "we met at home. Later on", "no candidate", None, "of carol {AT} mail(dot)example [dot] com",
             "carol at mail dot example dot com wrote", "look at example.com soon"]
    found = pii.example_table(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    assert sorted((r["kind"], r["label"], r["weight"]) for r in found) == [("email", 0.0, 1.0)] * 2 + [("email", 1.0, 1.0)] * 3
