"""Exact, near and substring deduplication against brute force."""

import hashlib

import pytest
import xxhash
from llm_helpers import DOCS, by_id, clashing, docs, rows, words
from pyspark.sql import functions as F

from voxloom.llm import common, exact, shingles, simhash, substrings
from voxloom.llm import queries as Q

NULL_ID = [(None, "nobody here", "en", "s", 1), (None, "nobody here", "en", "s", 1), (3, "Nobody here", "en", "s", 1)]


def lower(text):
    return (text or "").encode().lower()


def test_exact_matches_grouping(spark):
    data = rows()
    found = exact.exact_duplicates(docs(spark)).collect()
    assert len(found) == len(data)
    groups = {}
    for r in data:
        groups.setdefault(lower(r[1]), []).append(r[0])
    for r in data:
        mine = [f for f in found if f["doc_id"] == r[0]]
        ids = groups[lower(r[1])]
        assert {(f["keep_id"], f["group_size"], f["digest"].hex()) for f in mine} == {
            (max(ids), len(ids), hashlib.sha256(lower(r[1])).hexdigest())
        }
    kept = [f["doc_id"] for f in found if f["kept"]]
    assert sorted(kept) == sorted(max(ids) for ids in groups.values())


def test_exact_null_ids_and_empty(spark):
    found = exact.exact_duplicates(docs(spark, NULL_ID)).collect()
    assert [f["doc_id"] for f in found if f["kept"]] == [3]
    only = exact.exact_duplicates(docs(spark, NULL_ID[:2])).collect()
    assert sum(f["kept"] for f in only) == 1 and {f["group_size"] for f in only} == {2}
    assert exact.exact_duplicates(docs(spark, [])).count() == 0


def test_index_is_persistent(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact.drop_exact_duplicates(docs(spark), path, 4)
    assert first.count() == len({lower(r[1]) for r in rows()})
    again = exact.drop_exact_duplicates(docs(spark), path, 4)
    assert again.count() == 0
    more = exact.drop_exact_duplicates(docs(spark, [(7, "Brand NEW text", "en", "s", 1), rows()[0]]), path, 4)
    assert [r["doc_id"] for r in more.collect()] == [7]
    plan = spark.table(exact.open_index(spark, path, 4))
    assert plan.select("digest").distinct().count() == plan.count()


def test_hot_digest(spark):
    data = [(i, "same text" if i % 2 else f"text {i}", "en", "s", 1) for i in range(400)]
    found = by_id(exact.exact_duplicates(docs(spark, data)))
    assert found[1]["keep_id"] == 399 and found[1]["group_size"] == 200 and not found[1]["kept"]
    assert found[2]["keep_id"] == 2 and found[2]["kept"] and len(found) == 400


def test_small_batch_against_a_large_index(spark, tmp_path):
    """Only digests that are hot in the batch travel, never the whole index."""
    path = f"file://{tmp_path}/index"
    exact.exact_duplicates(docs(spark, [(i, f"text {i}", "en", "s", 1) for i in range(3000)]), path, 4).count()
    batch = [(5000 + i, f"TEXT {i}", "en", "s", 1) for i in range(10)] + [(6000, "new", "en", "s", 1), (6001, "NEW", "en", "s", 1)]
    found = by_id(exact.exact_duplicates(docs(spark, batch), path, 4))
    assert all(found[5000 + i]["keep_id"] == i and not found[5000 + i]["kept"] for i in range(10))
    assert (found[6000]["keep_id"], found[6001]["kept"], found[6001]["group_size"]) == (6001, True, 2)


@pytest.mark.parametrize("maps, bits", [(2, 1 << 15), (1, 8), (1, 1)])
def test_bitmaps_lose_and_add_nothing(spark, monkeypatch, maps, bits):
    """However many keys share a bit, the same rows come out."""
    monkeypatch.setattr(common, "MAPS", maps)
    monkeypatch.setattr(common, "MAP_BITS", bits)
    df = spark.range(-200, 200).withColumnRenamed("id", "x")
    keys = spark.range(-50, 60, 3).withColumnRenamed("id", "key")
    wanted = set(range(-50, 60, 3))
    marked = common.marked(df, "maybe", F.col("x"), keys)
    assert marked.columns == ["x", "maybe"] and wanted <= {r["x"] for r in marked.where("maybe").collect()}
    assert sorted(r["x"] for r in common.only(df, "x", keys).collect()) == sorted(wanted)
    assert sorted(r["x"] for r in common.without(df, "x", keys).collect()) == sorted(set(range(-200, 200)) - wanted)
    assert common.without(df, "x", keys.where("false")).count() == 400 and common.only(df, "x", keys.where("false")).count() == 0
    data, columns = rows(), clashing(spark).columns
    out = exact.drop_exact_duplicates(clashing(spark))
    assert out.columns == columns and out.count() == len({lower(r[1]) for r in data})
    out = shingles.drop_near_duplicates(clashing(spark))
    assert out.columns == columns and 0 < out.count() < len({lower(r[1]) for r in data})


def test_bitmaps_spare_the_texts(spark):
    """Told-apart rows are most of those that no key holds."""
    df, keys = spark.range(20000), spark.range(100).withColumnRenamed("id", "key")
    assert common.marked(df, "maybe", F.col("id"), keys).where("maybe").count() < 110


def test_exact_keeps_columns(spark):
    out = exact.drop_exact_duplicates(clashing(spark))
    assert out.columns == clashing(spark).columns


def slow_fingerprint(text, width=3):
    w = lower(text).split()
    parts = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=2):
    names, prints = sorted(prints), prints
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def test_simhash_matches_all_pairs(spark):
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows()}
    want = slow_components(prints)
    for r in simhash.near_duplicates(docs(spark)).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_crowded_blocks_lose_no_link(spark, limit):
    """Chains and crowds of fingerprints: both ways to link give the brute-force components."""
    import random

    rng, prints = random.Random(limit), {}
    for base in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(50):
            p = base
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints[len(prints)] = p
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    edges = simhash.links(df.select("fp").distinct(), limit).collect()
    by_fp = {}
    for i, p in signed:
        by_fp.setdefault(p, i)
    unsigned = {p: prints[i] for p, i in by_fp.items()}
    want = slow_components(unsigned)
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(p)
    got = {p: p for p in unsigned}

    def find(n):
        while got[n] != n:
            n = got[n]
        return n

    for e in edges:
        assert bin(unsigned[e["src"]] ^ unsigned[e["dst"]]).count("1") <= 2
        a, b = find(e["src"]), find(e["dst"])
        got[max(a, b)] = min(a, b)
    found = {}
    for p in unsigned:
        found.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates_keep_one(spark):
    want = slow_components({r[0]: slow_fingerprint(r[1]) for r in rows()})
    out = simhash.drop_near_duplicates(clashing(spark))
    assert out.columns == clashing(spark).columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))
    nulls = simhash.drop_near_duplicates(docs(spark, NULL_ID)).collect()
    assert [r["doc_id"] for r in nulls] == [3]
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def slow_repeats(data, length=13):
    first = {}
    for i, text, *_ in data:
        w = words(text)
        for a in range(len(w) - length + 1):
            key = b" ".join(w[a : a + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in data:
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if i is not None and first[b" ".join(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _repeats(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_substrings_match_brute_force(spark):
    assert _repeats(substrings.drop_repeats(docs(spark))) == slow_repeats(rows())


def test_substrings_across_homes(spark):
    """Documents that share seeds with their home but windows only with each other."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    pieces = [" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(6)]
    data = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))), "en", "s", 1) for i in range(60)]
    data += [(None, data[3][1], "en", "s", 1), (5, data[6][1], "en", "s", 1), (-4, data[9][1], "en", "s", 1)]
    assert _repeats(substrings.drop_repeats(docs(spark, data))) == slow_repeats(data)
    assert substrings.drop_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_automaton_matching_statistics():
    a = substrings.Automaton()
    a.add_text("a b c a b d".split())
    a.add_text("c a b c".split())
    assert a.matching("x c a b d a b c a b c c".split()) == [0, 1, 2, 3, 4, 1, 2, 3, 4, 5, 4, 1]


def test_queries_agree_with_brute_force(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert _repeats(Q.op7_substrings(spark, sf_dir)) == slow_repeats(data)
    want = slow_components({r[0]: slow_fingerprint(r[1]) for r in data})
    found = by_id(Q.op1_simhash(spark, sf_dir))
    assert {i: r["component_id"] for i, r in found.items()} == want
    shapes = Q.op9_exact(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k")).first()
    assert shapes["n"] == len(data) and shapes["k"] == len({lower(r[1]) for r in data})
