"""Near duplicates by shingle similarity: SimHash, a lossless set-similarity join for the rest, exact verification.

The first candidates are those of :mod:`voxloom.llm.simhash`: sets whose 64-bit fingerprints differ in
at most two bits, by joins on blocks.  Each is verified by the sets themselves.  A radius of two bits
cannot reach all pairs of the bound, so a second join finds what the fingerprints miss.

Two texts are near copies when the Jaccard similarity of their sets of word shingles (XXH64
values, as in :mod:`voxloom.llm.simhash`) reaches the bound t.  Such a pair shares at least
t |x| shingles of either text x, so when both texts put their shingles in one order, the first
|x| - ceil(t |x|) + 1 of each (the prefix) have a shingle in common (Chaudhuri et al., ICDE
2006).  The order is rare shingles first, by counts in a table of fixed size, which keeps
boilerplate out of the prefixes; any counts would do for the result.

A pair needs t / (1 + t) (|x| + |y|) shingles in common.  Before the first one there is none, so at
that one the shorter of the two rests must still hold as many (positional filter, Xiao et al., WWW
2008): a shingle that stands late in one of two prefixes brings no pair, and such are the frequent ones.

Texts with equal sets take part as one.  Of the texts that share a prefix shingle each is first
compared with one only, the hub: that where the shingle stands first, which has the least that is
rare, so a crowd of copies of one text meets at the copy nearest to it.  One comparison a member.
Pairs that share a prefix shingle and are not yet in one component are left.  Up to ``PAIR_LIMIT``
texts, all such pairs are compared; so are those of larger crowds, if they are not many for the number
of rows.  Otherwise such a crowd is parted by what tells its texts from the hub h:
with D = x without h and h without x, x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, of which
(1 - t) / (1 + t) (|x| + |y|) are allowed.  So similar texts share a part of their differences, and
these have prefixes and positions as sets have (:func:`differences`); the sets are the differences
from an empty hub.  The smaller crowds that share a difference get hubs of their own, and so on.  No
pair is left out, whatever the crowd.

What moves is small: hashes of prefix shingles to be counted, members of the shared ones, the
texts of candidates.  Rows that bitmaps of fixed size tell apart (:func:`common.marked`) stay in
place, also in the result: only rows of groups of two or more are shuffled.

Null text is empty; texts without words are one node.  A text of fewer words than a shingle
has one shingle, all its words.
"""

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import discard, kept, marked, only, pick_rows, raw, result, text_batches, without
from voxloom.llm.simhash import fingerprint_of, links, shingle_hashes
from voxloom.operators.graph import connected_components

WIDTH, SIMILARITY = 5, 0.8
CELLS = 1 << 20  # counts of shingles by hash, for the order only
CHUNK = 1 << 16  # cells whose counts travel as one row
PAIR_LIMIT = 64  # texts of one key that are compared in pairs
PAIRS_A_ROW = 16  # so many pairs of larger crowds, by the number of all rows, are compared as well
LEVELS = 3  # after so many hubs one in the other all pairs of a key are compared, however many
NEAR, FAR, ALL = 0, 1, 2  # under one key rows of the first two meet the other, or all meet all
EDGE = 2  # kind of a row of differences() that names a pair
ROUNDING = 1e-9


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def cell_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts hold a shingle of each cell."""

    def count(arrow):
        cells = np.zeros(CELLS, np.int64)
        for _, texts in text_batches(arrow):
            for text in texts:
                np.add.at(cells, (shingle_set(text, width) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        for i in range(0, CELLS, CHUNK):
            part = cells[i : i + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "sums"]
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in frame["sums"])
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "sums": [total.tobytes()]})

    parts = docs.select(raw("text").alias("text")).mapInArrow(count, "chunk int, sums binary")
    cells = np.zeros(CELLS, np.int64)
    for row in parts.groupBy("chunk").applyInPandas(add, "chunk int, sums binary").collect():
        cells[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], np.int64)
    return cells


def shared_counts(docs: DataFrame, width: int):
    """Broadcast of :func:`cell_counts`."""
    counts = np.minimum(cell_counts(docs, width), np.iinfo(np.int32).max).astype(np.int32)
    return docs.sparkSession.sparkContext.broadcast(counts)


def prefixes(docs: DataFrame, width: int, similarity: float, shared=None) -> DataFrame:
    """row (a number), doc_id, text_key, node (digest of the shingle set), its fingerprint fp, size and
    prefix of every row."""
    shared = shared or shared_counts(docs, width)

    def cut(arrow):
        cells = shared.value
        for batch, texts in text_batches(arrow):
            nodes, prints, sizes, firsts = [], [], [], []
            for text in texts:
                own = shingle_set(text, width)
                order = np.lexsort((own, cells[(own & np.uint64(CELLS - 1)).astype(np.int64)]))
                length = len(own) - math.ceil(similarity * len(own) - ROUNDING) + 1 if len(own) else 0
                nodes.append(xxhash.xxh128_digest(own.tobytes()))
                prints.append(fingerprint_of(own))
                sizes.append(len(own))
                firsts.append(own[order[:length]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                 pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "fp", "size", "prefix"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw("text").alias("text"))
    found = rows.mapInArrow(cut, "doc_id long, text_key long, node binary, fp long, size int, prefix array<long>")
    return kept(found.withColumn("row", F.monotonically_increasing_id()), "prefixes")


def ends(pairs: DataFrame) -> DataFrame:
    """key: every row number that stands in a pair."""
    return pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key"))).distinct()


def shingles_of(docs: DataFrame, prints: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """row, shingles of the row numbers ``keys(key)``; only the texts of these rows are read again."""
    asked = kept(only(prints.select("row", "doc_id", "text_key"), "row", keys), "asked-rows")

    def sets(arrow):
        for batch, texts in text_batches(arrow):
            own = [shingle_set(t, width).view(np.int64) for t in texts]
            yield result(batch, ["row"], shingles=pa.array(own, pa.list_(pa.int64())))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    told = marked(keyed, "maybe", F.xxhash64("doc_id", "text_key"), asked.select(F.xxhash64("doc_id", "text_key").alias("key")))
    one, other = F.struct("told.doc_id", "told.text_key"), F.struct("asked.doc_id", "asked.text_key")
    texts = told.where("maybe").alias("told").join(asked.alias("asked"), one.eqNullSafe(other)).select("row", raw("text").alias("text"))
    found = kept(texts.mapInArrow(sets, "row long, shingles array<long>").dropDuplicates(["row"]), "shingles")
    discard(asked)
    return found


def similar(docs: DataFrame, prints: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` of row numbers whose shingle sets are similar enough."""
    found = shingles_of(docs, prints, ends(pairs), width)
    left = found.select(F.col("row").alias("src"), F.col("shingles").alias("x"))
    right = found.select(F.col("row").alias("dst"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    close = kept(
        pairs.join(left, "src").join(right, "dst").where(both >= similarity * union - ROUNDING).select("src", "dst"),
        "similar",
    )
    discard(found)
    return close


def twins_of(prints: DataFrame) -> DataFrame:
    """row, rep: rows with the shingle set of an earlier row, and the first such row."""
    groups = prints.groupBy("node").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept(prints.select("row", "node").join(groups, "node").where("row <> rep").select("row", "rep"), "twins")


def fingerprint_pairs(whole: DataFrame) -> DataFrame:
    """src, dst: rows whose fingerprints are equal or linked; each to the first row of a fingerprint."""
    prints = kept(whole.groupBy("fp").agg(F.min("row").alias("first")), "distinct-fingerprints")
    one, other = (prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_row")) for end in ("src", "dst"))
    linked = links(prints.select("fp")).join(one, "src").join(other, "dst").select(
        F.greatest("src_row", "dst_row").alias("src"), F.least("src_row", "dst_row").alias("dst")
    )
    equal = whole.select("row", "fp").join(prints, "fp").where(F.col("row") != F.col("first"))
    return linked.unionByName(equal.select(F.col("row").alias("src"), F.col("first").alias("dst")))


def may_be_close(m: Column, n: Column, i: Column, j: Column, similarity: float, d: Column | None = None, e: Column | None = None) -> Column:
    """Whether sets of sizes m and n can be similar whose differences from a hub, of sizes d and e, have their
    first common shingle at i and j of their orders; without d and e the sets themselves, the hub being empty."""
    d, e = m if d is None else d, n if e is None else e
    return (F.least(m, n) >= similarity * F.greatest(m, n) - ROUNDING) & (
        F.least(d - i, e - j) >= (d + e - (1 - similarity) / (1 + similarity) * (m + n)) / 2 - ROUNDING
    )


def reach(m: int, h: int, d: int, near: bool, similarity: float) -> tuple[int, int]:
    """How many of the d differences of a set of size m from a hub of size h can hold the first that it
    shares with a similar set of another component: with a set of the hub's component, with another.

    Sizes of similar sets x and y have 1/t as their largest ratio and |Dy| >= |Dx| - |x ^ y|, so they share
    |Dx| - (1 - t) / t |x| differences at least.  If y is not similar to the hub, |Dy| > c (|y| + |h|) with
    c = (1 - t) / (1 + t), and they share more than (|Dx| + c (|h| - |x|)) / 2.  They share one in any
    case: with none, both would be similar to the hub.
    """
    c = (1 - similarity) / (1 + similarity)
    least = max(1, math.ceil(d - (1 - similarity) / similarity * m - ROUNDING))
    apart = max(least, math.floor((d + c * (h - m)) / 2 + ROUNDING) + 1)
    return (0 if near else max(0, d - least + 1)), max(0, d - apart + 1)


def differences(spokes: DataFrame, found: DataFrame, shared, similarity: float) -> DataFrame:
    """key, row, size, d, at, side: the first differences of each row from its hub, hashed with the hub;
    and row, hub alone, with kind ``EDGE``, of rows found to be similar to it.

    What the row has and the hub lacks comes first, rare shingles first; of what it lacks, that which
    most texts have.  ``spokes(row, hub, near)`` tells rows of the hub's component.  Rows of others (side
    ``FAR``) meet such rows (``NEAR``) under one key, and each other (``ALL``) under another, where shorter
    prefixes do.
    """

    def cut(arrow):
        cells = shared.value
        for batch in arrow:
            rows = [batch.column(c).to_pylist() for c in ("row", "hub", "near")]
            xs, hs = batch.column("x"), batch.column("y")
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])

            def add(length, line, at, shingle):
                for column, value in zip(out, line):
                    column.extend([value] * length)
                out[6].extend(at)
                out[7].extend(shingle)

            for k, (row, hub, near) in enumerate(zip(*rows)):
                x, h = (c[k].values.to_numpy(zero_copy_only=False) for c in (xs, hs))
                has, lacks = np.setdiff1d(x, h), np.setdiff1d(h, x)
                told = np.concatenate((has, lacks))
                many = cells[told & (CELLS - 1)].astype(np.int64)
                many[len(has) :] *= -1
                told = told[np.lexsort((told, many, np.arange(len(told)) >= len(has)))]
                if not near and len(x) - len(has) >= similarity * (len(h) + len(has)) - ROUNDING:
                    near = True
                    add(1, (row, hub, len(x), len(told), NEAR, EDGE), [None], [None])
                with_hub, apart = reach(len(x), len(h), len(told), near, similarity)
                # near rows meet only the others
                for kind, length in ((0, apart if near else with_hub), (1, 0 if near else apart)):
                    side = ALL if kind else NEAR if near else FAR
                    add(length, (row, hub, len(x), len(told), side, kind), range(length), told[:length].tolist())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            names = ["row", "hub", "size", "d", "side", "kind", "at", "shingle"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    sets = spokes.join(found.select("row", F.col("shingles").alias("x")), "row")
    sets = sets.join(found.select(F.col("row").alias("hub"), F.col("shingles").alias("y")), "hub")
    told = sets.select("row", "hub", "near", "x", "y").mapInArrow(
        cut, "row long, hub long, size int, d int, side int, kind int, at int, shingle long"
    )
    return told.select(F.xxhash64("hub", "kind", "shingle").alias("key"), "row", "size", "d", "at", "side", "kind", "hub")


def with_hubs(some: DataFrame) -> DataFrame:
    """``some(key, row, size, d, at, side)`` of keys that may bring a pair, with their number n and hub."""
    crowds = some.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "row", "size", "d", "side")).alias("hub"),
        F.bool_or(F.col("side") != FAR).alias("any"),
    )
    return some.join(crowds.where("n > 1 and any").drop("any"), "key")


def _meet(a: str, b: str) -> Column:
    return (F.col(a) != F.col(b)) | (F.col(a) == ALL)


def to_hubs(members: DataFrame, similarity: float) -> DataFrame:
    """src, dst: each member and the hubs it may be similar to."""
    close = may_be_close(
        F.col("size"), F.col("hub.size"), F.col("at"), F.col("hub.at"), similarity, F.col("d"), F.col("hub.d")
    )
    found = members.where(close & _meet("side", "hub.side") & (F.col("row") != F.col("hub.row")))
    return found.select(F.greatest("row", "hub.row").alias("src"), F.least("row", "hub.row").alias("dst"))


def in_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """src, dst: rows that share a key, are in different components and may be similar."""
    columns = ("row", "size", "d", "at", "component", "side")
    one = placed.select("key", *[F.col(c).alias(n) for c, n in zip(columns, ("src", "m", "d", "i", "p", "s"))])
    other = placed.select("key", *[F.col(c).alias(n) for c, n in zip(columns, ("dst", "n", "e", "j", "q", "t"))])
    pairs = one.join(other, "key").where((F.col("src") > F.col("dst")) & (F.col("p") != F.col("q")) & _meet("s", "t"))
    m, n, i, j, d, e = (F.col(c) for c in "mnijde")
    return pairs.where(may_be_close(m, n, i, j, similarity, d, e)).select("src", "dst")


def apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` that are in different components."""
    for end, name in (("src", "p"), ("dst", "q")):
        pairs = pairs.join(linked.select(F.col("row").alias(end), F.col("component").alias(name)), end, "left")
    return pairs.where(F.coalesce("p", "src") != F.coalesce("q", "dst")).select("src", "dst")


def components(docs: DataFrame, prints: DataFrame, twins: DataFrame, shared, width: int, similarity: float) -> DataFrame:
    """row, component of every row that is similar to another, twins aside."""
    whole = without(prints.select("row", "fp", "size", "prefix"), "row", twins.select(F.col("row").alias("key")))
    exploded = whole.select("row", "size", F.posexplode("prefix").alias("at", "key"))
    # most prefix shingles stand in one text: only their hashes travel to be counted
    common = kept(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    some = kept(marked(exploded, "maybe", F.col("key"), common).where("maybe").drop("maybe"), "members")
    members = kept(with_hubs(some.withColumn("d", F.col("size")).withColumn("side", F.lit(ALL))), "prefix-members")
    discard(some)
    discard(common)
    asked = kept(to_hubs(members, similarity).unionByName(fingerprint_pairs(whole)).distinct(), "star-pairs")
    rows, compared, edges = prints.count(), [asked], [similar(docs, prints, asked, width, similarity)]
    linked = _components(edges[0])
    for level in range(LEVELS):
        known = len(edges)
        # what the hubs left apart: pairs of one key in different components, not compared yet
        placed = members.join(linked, "row", "left").withColumn("component", F.coalesce("component", "row"))
        others = placed.where(F.col("row") != F.col("hub.row")).groupBy("key").agg(
            F.min("component").alias("a"), F.max("component").alias("b")
        )
        mixed = kept(placed.join(others.where("a <> b").select("key"), "key"), "mixed-members")
        discard(members)
        large = F.col("n") > PAIR_LIMIT
        crowded = mixed.where(large)
        work = crowded.agg(F.sum("n")).first()[0] or 0  # a crowd's members each meet all of it
        more = level + 1 < LEVELS and work > PAIRS_A_ROW * rows
        pairs = in_pairs(mixed.where(~large) if more else mixed, similarity)
        if more:
            spokes = crowded.where(F.col("row") != F.col("hub.row")).select("row", F.col("hub.row").alias("hub"), "component").distinct()
            roots = linked.select(F.col("row").alias("hub"), F.col("component").alias("root"))
            spokes = kept(spokes.join(roots, "hub", "left").select(
                "row", "hub", (F.col("component") == F.coalesce("root", "hub")).alias("near")
            ), "spokes")
            keys = spokes.select(F.col("row").alias("key")).unionByName(spokes.select(F.col("hub").alias("key"))).distinct()
            found = shingles_of(docs, prints, keys, width)
            told = kept(differences(spokes, found, shared, similarity), "differences")
            members = kept(with_hubs(told.where(F.col("kind") != EDGE).drop("kind", "hub")), "difference-members")
            edges.append(kept(told.where(F.col("kind") == EDGE).select(
                F.greatest("row", "hub").alias("src"), F.least("row", "hub").alias("dst")
            ), "hub-edges"))
            for used in (spokes, found, told):
                discard(used)
            pairs = pairs.unionByName(apart(to_hubs(members, similarity).distinct(), linked))
        for before in compared:
            pairs = pairs.join(before, ["src", "dst"], "left_anti")
        pairs = kept(pairs.distinct(), "other-pairs")
        discard(mixed)
        if not pairs.isEmpty():
            edges.append(similar(docs, prints, pairs, width, similarity))
        if any(not e.isEmpty() for e in edges[known:]):
            linked = _components(reduce(DataFrame.unionByName, edges))
        compared.append(pairs)
        if not more:
            break
    for used in (*compared, *edges):
        discard(used)
    return linked


def _components(edges: DataFrame) -> DataFrame:
    nodes = ends(edges).select(F.col("key").alias("row"))
    return kept(connected_components(nodes, edges, "row"), "shingle-components")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group that similar pairs connect: the one with the smallest doc_id
    (ids that are null come last, rows with that id by their text's hash)."""
    shared = shared_counts(docs, width)
    prints = prefixes(docs, width, similarity, shared)
    twins = twins_of(prints)
    linked = components(docs, prints, twins, shared, width, similarity)
    rows = prints.select("row", "doc_id", "text_key").join(twins, "row", "left")
    rows = rows.withColumn("row", F.coalesce("rep", "row")).join(linked, "row", "left")
    found = kept(rows.select(F.coalesce("component", "row").alias("group"), "doc_id", "text_key"), "shingle-groups")
    discard(prints)
    groups = found.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    groups = kept(groups.select("group", "n", F.col("first.doc_id").alias("win_id"), F.col("first.text_key").alias("win_key")), "near-groups")
    doubtful = found.join(groups.where("n > 1").select("group"), "group").select(F.xxhash64("doc_id", "text_key").alias("key"))
    return pick_rows(docs, groups.select("win_id", "win_key"), F.xxhash64("text"), doubtful=doubtful)
