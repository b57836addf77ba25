"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from llm_helpers import clashing, docs, rows, words
from pyspark.sql import functions as F

from voxloom.llm import shingles


def slow_set(text, width=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def slow_kept(data, similarity=0.8):
    """Smallest doc_id of each component of pairs with the similarity or more."""
    sets, root = [slow_set(r[1]) for r in data], list(range(len(data)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(data):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(min(g) for g in groups.values())


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def stage(spark, data):
    return dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs(spark, data), "")


def test_one_changed_word_in_a_hundred(spark):
    rng, data = random.Random(3), []
    for i in range(40):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
        data += [(2 * i, text, "en", "s", 1), (2 * i + 1, changed(rng, text, 1), "en", "s", 1)]
    assert sorted(r["doc_id"] for r in stage(spark, data).collect()) == list(range(0, 80, 2))


def test_stage_matches_all_pairs(spark):
    """Around the bound, in chains, in crowds that share a passage, and the awkward rows."""
    rng, data = random.Random(8), [r for r in rows() if r[0] is not None]
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 120))) for _ in range(12)]
    for text in texts:
        for _ in range(8):
            text = changed(rng, text, rng.randint(1, max(1, len(text.split()) // 30)))
            data.append((1000 + len(data), text, "en", "s", 1))
    passage = texts[0]
    for _ in range(30):
        text = passage + " " + " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 60)))
        data.append((1000 + len(data), text, "en", "s", 1))
    assert sorted(r["doc_id"] for r in stage(spark, data).collect()) == slow_kept(data)


def test_shapes(spark):
    assert shingles.drop_near_duplicates(clashing(spark)).columns == clashing(spark).columns
    nulls = [(None, "nobody here", "en", "s", 1), (None, "nobody here", "en", "s", 1), (3, "Nobody here", "en", "s", 1)]
    assert [r["doc_id"] for r in stage(spark, nulls).collect()] == [3]
    assert stage(spark, []).count() == 0


def test_language_stage_without_labels(spark):
    data = [(1, "some clean text", None, "s", 1), (2, None, None, "s", 1), (3, "123 !!", None, "s", 1), (4, "noch einer", None, "s", 1)]
    out = dict(corpus_pipeline.STAGES)["language"](spark, docs(spark, data), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in out) == [(1, None), (4, None)]


def test_positional_filter_loses_no_pair():
    """Of all sets over a few shingles in one order, whatever is similar passes at its first common shingle."""
    rng, cut = random.Random(4), 0
    for _ in range(4000):
        n = rng.randint(1, 14)
        x = set(rng.sample(range(20), n))
        y = {s for s in x if rng.random() < 0.9} | {rng.randrange(20) for _ in range(rng.randint(0, 2))}
        first = min(x & y, default=None)
        if first is None:
            continue
        i, j = sorted(x).index(first), sorted(y).index(first)
        m, n = len(x), len(y)
        passes = 5 * min(m, n) >= 4 * max(m, n) and 9 * min(m - i, n - j) >= 4 * (m + n)
        assert passes or 5 * len(x & y) < 4 * len(x | y)
        cut += not passes
    assert cut > 100


def test_late_shingles_bring_no_candidates(spark):
    data = [(1, 100, 0), (2, 100, 0), (3, 100, 15), (4, 30, 0)]
    found = spark.createDataFrame(data, "row long, size int, at int").where(
        shingles.may_be_close(F.lit(100), F.col("size"), F.lit(0), F.col("at"), 0.8)
    )
    assert sorted(r["row"] for r in found.collect()) == [1, 2]


def test_fingerprints_propose_pairs(spark):
    """A text of two thousand words with one word changed keeps its fingerprint but for a bit or two."""
    rng, data = random.Random(9), []
    for i in range(6):
        text = " ".join(f"w{rng.randrange(9000)}" for _ in range(2000))
        data += [(2 * i, text, "en", "s", 1), (2 * i + 1, changed(rng, text, 1), "en", "s", 1)]
    prints = shingles.prefixes(docs(spark, data), 5, 0.8)
    ids = {r["row"]: r["doc_id"] for r in prints.collect()}
    found = {tuple(sorted((ids[r["src"]], ids[r["dst"]]))) for r in shingles.fingerprint_pairs(prints).collect()}
    assert found and found <= {(2 * i, 2 * i + 1) for i in range(6)}


def crowd(rng, n, least, most, length=150):
    """Texts that differ from one that is not among them in ``least`` to ``most`` of ``length`` words."""
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(length))
    return [changed(rng, base, rng.randint(least, most)) for _ in range(n)]


def test_crowd_costs_few_comparisons(spark, monkeypatch):
    """Copies of one text, which is among them; most are less similar to each other than the bound."""
    rng, asked = random.Random(6), []
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
    texts = [base if i == 300 else changed(rng, base, rng.randint(2, 5)) for i in range(400)]
    data = [(i, text, "en", "s", 1) for i, text in enumerate(texts)]
    similar = shingles.similar
    monkeypatch.setattr(shingles, "similar", lambda d, p, pairs, *more: asked.append(pairs.count()) or similar(d, p, pairs, *more))
    assert sorted(r["doc_id"] for r in stage(spark, data).collect()) == slow_kept(data)
    assert 0 < sum(asked) < 8 * len(data)


def test_parted_crowds_match_all_pairs(spark, monkeypatch):
    """Crowds with passages in common and crowds in crowds, parted down to single pairs."""
    rng, data = random.Random(7), []
    for k in range(3):
        passage = " ".join(f"p{k % 2}x{i}" for i in range(40))
        for text in crowd(rng, 25, 3, 7, 90):
            data.append((len(data), text + (" " + passage if rng.random() < 0.7 else ""), "en", "s", 1))
            if rng.random() < 0.3:
                data.append((len(data), changed(rng, data[-1][1], 2), "en", "s", 1))
    expected = slow_kept(data)
    assert 1 < len(expected) < len(data)
    for limit, levels in ((2, 3), (8, 2)):
        monkeypatch.setattr(shingles, "PAIR_LIMIT", limit)
        monkeypatch.setattr(shingles, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(shingles, "LEVELS", levels)
        assert sorted(r["doc_id"] for r in stage(spark, data).collect()) == expected


def test_differences_reach_their_first_in_common():
    """The first difference from a hub that two similar sets share stands in both prefixes and passes its positions."""
    rng, seen = random.Random(10), 0
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for _ in range(30000):
        n = rng.randint(1, 24)
        hub = set(rng.sample(range(40), n))
        x = {s for s in hub if rng.random() < 0.8} | {rng.randrange(40) for _ in range(rng.randint(0, 6))}
        y = {s for s in x if rng.random() < 0.95} | {rng.randrange(40) for _ in range(rng.randint(0, 2))}
        if not x or not y or not close(x, y) or close(x, hub) and close(y, hub):
            continue
        one, other = (sorted(a ^ hub, key=lambda s: (s * 7 % 11 if s in hub else s * 5 % 11, s)) for a in (x, y))
        first = next(s for s in one if s in set(other))
        i, j, d, e = one.index(first), other.index(first), len(one), len(other)
        near = [close(x, hub), close(y, hub)]
        kind = 1 if not any(near) else 0
        for at, own, size, is_near in ((i, d, len(x), near[0]), (j, e, len(y), near[1])):
            with_hub, apart = shingles.reach(size, len(hub), own, is_near, 0.8)
            assert at < (apart if kind or is_near else with_hub)
        assert 18 * min(d - i, e - j) >= 9 * (d + e) - (len(x) + len(y))
        seen += 1
    assert seen > 300
