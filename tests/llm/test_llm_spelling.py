"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import clashing, docs, rows

from voxloom.llm import queries as Q
from voxloom.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(data):
    total = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def slow_variants(counts):
    form, many = {}, {}
    for w in counts:
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        many[w], form[w] = len(others), best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, many[w], form[w] and counts[form[w]]))
    return sorted(out)


def made_words(rng, letters, n, longest):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, longest))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abcé", 12), ("abcdefghijÿ×", 8), ("ab", 20)])
def test_both_halves_find_all_near_words(letters, longest):
    rng = random.Random(longest)
    for _ in range(12):
        words = made_words(rng, letters, rng.randint(1, 70), longest)
        indexed = words if rng.random() < 0.5 else words[::2]
        index, got = spelling.FMIndex(indexed), set()
        for side in ("right", "left"):
            asked, found = index.near(words, side)
            got |= {(words[a], index.words[b]) for a, b in zip(asked, found)}
        assert got == {(a, b) for a in words for b in indexed if near(a, b)}


def test_intervals_of_both_directions():
    """Patterns grown from a delimiter to the right, or to the left, have one rank an occurrence."""
    words = sorted({"banana", "bandana", "ananas", "cabana"})
    index, wrapped = spelling.FMIndex(words), [f"${w}$" for w in words]
    for word in words:
        for k in range(len(word) + 1):
            for pattern, side in ((f"${word[:k]}", "right"), (f"{word[k:]}$", "left")):
                at = index.delimiters(1)
                for c in pattern[1:] if side == "right" else pattern[-2::-1]:
                    at = index.extend(at, np.array([index.code[c]]), side)
                many = sum(w.startswith(pattern, i) for w in wrapped for i in range(len(w)))
                assert at.size[0] == (len(words) + 1 if pattern == "$" else many)
    at = index.delimiters(1)  # both ends in turn: $banana$ by its rank among the words
    for c in "banana":
        at = index.extend(at, np.array([index.code[c]]), "right")
    at = index.extend(at, np.array([0]), "right")
    assert at.size[0] == 1 and at.at["left"][0] == words.index("banana")


@pytest.mark.parametrize("shard", [spelling.SHARD, 300, 40])
def test_shards_lose_no_pair(spark, shard):
    """Also with one three-letter start in a third of the words, refined and split."""
    rng = random.Random(5)
    words = made_words(rng, "abcdef", 120, 9)
    words += ["pre" + w[3:] for w in made_words(rng, "ab", 60, 9)] + ["sameha" + c + d for c in "abcdefgh" for d in "abcdefgh"]
    counts = {w: rng.choice([5, 6, 30, 200, 1500]) for w in set(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(frame, shard=shard).collect())
    assert got == slow_variants(counts)


def test_chains_of_forms(spark):
    counts = {"a" * k + "b" * (20 - k): 5 * 5**k for k in range(9)} | {"zzzzzz": 7, "zzzzzy": 35, "zzzzzx": 35}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(frame).collect())
    assert got == slow_variants(counts)
    assert {r[2] for r in got if r[0].startswith(("a", "b"))} == {"a" * 8 + "b" * 12}
    assert [r[1] for r in got if r[0] == "zzzzzz"] == ["zzzzzx"]


def test_query_matches_brute_force(spark, tmp_path):
    rng, data = random.Random(6), rows()
    base = ["receive", "Separate", "definitely", "occurred", "Étérnel", "straßenbahn", "naïvely", "x" * 400]
    for i in range(400):
        out = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base)
            if rng.random() < 0.05:
                k = rng.randrange(len(w))
                w = w[:k] + w[k + 1 :]
            out.append(w)
        data.append((5000 + i, " ".join(out), "en", "s", 1))
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in Q.op12_spelling(spark, str(tmp_path)).collect())
    assert got == slow_variants(slow_words(data)) and any(r[1] for r in got)


def test_shapes(spark):
    assert spelling.vocabulary(docs(spark, [])).count() == 0
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).count() == 0
    alone = [(i, "single single", "en", "s", 1) for i in range(5)] + [(9, None, "en", "s", 1), (None, "", "en", "s", 1)]
    got = [tuple(r) for r in spelling.variants(spelling.vocabulary(docs(spark, alone))).collect()]
    assert got == [("single", None, "single", 10, 0, None)]
    assert spelling.vocabulary(clashing(spark), least_count=1).count() == spelling.vocabulary(docs(spark), least_count=1).count()
