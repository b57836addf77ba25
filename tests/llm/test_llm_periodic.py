"""Periodic runs against all pairs of equal words."""

import hashlib
import random
import zlib

import pytest
from llm_helpers import by_id, clashing, docs, rows, words

from voxloom.llm import periodic
from voxloom.llm import queries as Q


def slow_runs(ids):
    """Every period in turn: stretches of words that are equal to those a period on."""
    out = []
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i < len(ids) - q:
            start = i
            while i < len(ids) - q and ids[i] == ids[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(12, 2 * q):
                if not any(q % r == 0 and s <= start and end <= e for s, e, r in out):
                    out.append((start, end, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_words(text, doc_id):
    w = words(text)
    if doc_id is None or not w or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def slow_row(doc_id, text):
    w = slow_words(text, doc_id)
    runs = slow_runs(w)
    best = min(runs, key=lambda r: (-(r[1] - r[0]), r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs)]
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    start, length, period = (best[0], best[1] - best[0], best[2]) if best else (None, None, None)
    return (
        doc_id, len(runs), start, length, period, best and 1000 * length // period,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def made_ids(rng):
    n, kinds = rng.randint(0, 110), rng.choice([1, 2, 3, 6, 25])
    ids = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n + 1), rng.randint(1, max(1, n // 4))
        for i in range(a + p, min(n, a + rng.randint(1, 80))):
            ids[i] = ids[i - p]
    return ids


def fibonacci_word(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse_word(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_all_pairs(seed):
    rng = random.Random(seed)
    for _ in range(250):
        ids = made_ids(rng)
        assert periodic.word_runs([b"%d" % i for i in ids]) == slow_runs(ids), ids
    for n in (12, 34, 55, 89, 200):
        for ids in (fibonacci_word(n), thue_morse_word(n), [0] * n, [0, 0, 1] * (n // 3)):
            assert periodic.runs_of(ids) == slow_runs(ids)


def test_grammar_derives_the_words():
    rng = random.Random(9)
    for ids in [made_ids(rng) for _ in range(200)] + [[7] * 1000, []]:
        rules, left, first = periodic.re_pair(ids)
        derive = lambda x: [x] if x < first else derive(rules[x - first][0]) + derive(rules[x - first][1])
        assert [w for x in left for w in derive(x)] == ids
        pairs = {}
        for i, pair in enumerate(zip(left, left[1:])):
            assert i - pairs.setdefault(pair, i) <= 1  # no pair twice, overlaps aside


def test_long_runs_stay_cheap():
    assert periodic.runs_of([0] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of([0, 0, 1] * 50_000 + [5]) == [(0, 150_000, 3)]
    lines = [x for i in range(3000) for x in (*range(10), 100 + i)]
    assert periodic.runs_of(lines) == []


def test_query_matches_brute_force(spark, tmp_path):
    rng, data = random.Random(4), rows()
    for i in range(150):
        text = " ".join(f"w{x}" for x in made_ids(rng))
        data.append((1000 + i, text, "en", "s", 1))
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op13_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns[:8] == names
    none = lambda row: tuple((v is not None, v) for v in row)
    assert sorted([tuple(r)[:8] for r in got.collect()], key=none) == sorted([slow_row(r[0], r[1]) for r in data], key=none)


def test_shapes(spark):
    texts = [(1, None, "", "", 1), (2, "", "", "", 1), (None, "a " * 30, "", "", 1), (3, "a b " * 30, "", "", 1), (3, "a b " * 30, "", "", 1)]
    found = periodic.collapse_runs(docs(spark, texts)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 5 and by[1]["n_words"] == by[2]["n_words"] == 0 and by[1]["runs"] == []
    assert tuple(by[None]["runs"][0]) == (0, 30, 1) and by[None]["collapsed"] == b"a"
    assert tuple(by[3]["runs"][0]) == (0, 60, 2) and by[3]["collapsed"] == b"a b"
    assert periodic.collapse_runs(docs(spark, [])).count() == 0
    assert len(by_id(periodic.collapse_runs(clashing(spark)))) == len(by_id(docs(spark)))
