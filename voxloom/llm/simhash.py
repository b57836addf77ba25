"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification.

A fingerprint has 64 bits over the XXH64 values of all word shingles of a text.  It is cut
into ``BLOCKS`` blocks; fingerprints that differ in at most ``DISTANCE`` bits agree in at
least ``BLOCKS - DISTANCE`` of them, so each choice of that many blocks is a join key and
no close pair is lost.  Copies fall together first: only distinct fingerprints are joined.

A key shared by more than ``PAIR_LIMIT`` distinct fingerprints would give too many pairs.
Its members are linked exactly by another route: two fingerprints differ in at most two
bits if and only if some word is within one bit of both, and at most 65 fingerprints are
within one bit of a word.  Every member therefore meets its partners at its 65 neighbour
words, in groups of bounded size; linear work, the same links.

Null text is empty; a text without words has fingerprint zero.  Rows with a null
``doc_id`` take part but never name a component unless all its ids are null.  Repeated
rows are members like others.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import kept, pick_rows, raw, result, text_batches, words_of
from voxloom.operators.graph import connected_components

WIDTH, SEED = 3, 42
BLOCKS, DISTANCE = 4, 2
PAIR_LIMIT = 64
CHUNK = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    words = words_of(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(line[c], SEED) for c in cuts], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprint_batches(arrow):
    for batch, texts in text_batches(arrow):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield result(batch, ["doc_id", "text_key"], fp=pa.array(values))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (tells rows with one id apart), fp: the fingerprint as a signed long."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw("text").alias("text"))
    return kept(rows.mapInArrow(_fingerprint_batches, "doc_id long, text_key long, fp long"), "fingerprints")


def _masks() -> list[int]:
    width = 64 // BLOCKS
    block = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    masks = [sum(block[i] for i in c) for c in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges src, dst between fingerprints ``fp`` of at most two differing bits, enough to
    connect all that are so linked."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])
    blocked = distinct.select("fp", F.posexplode(keys).alias("choice", "key"))
    crowds = blocked.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(blocked.join(crowds, ["choice", "key"]), "blocks")
    few = members.where(F.col("n") <= pair_limit)
    other = few.select("choice", "key", F.col("fp").alias("dst"))
    pairs = (
        few.select("choice", "key", F.col("fp").alias("src")).join(other, ["choice", "key"])
        .where("src > dst").where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE)
        .select("src", "dst")
    )
    flips = [0] + [1 << b for b in range(63)] + [-(1 << 63)]
    crowded = members.where(F.col("n") > pair_limit).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("word"))
    meets = near.groupBy("word").agg(F.min("fp").alias("dst"), F.collect_set("fp").alias("all"))
    stars = meets.where(F.size("all") > 1).select(F.explode("all").alias("src"), "dst").where("src <> dst")
    return pairs.unionByName(stars).distinct()


def components(prints: DataFrame) -> DataFrame:
    """fp, component_id: the smallest doc_id that links reach from each distinct fingerprint."""
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = kept(links(distinct.select("fp")), "links")
    linked = edges.select(F.col("src").alias("fp")).unionByName(edges.select(F.col("dst").alias("fp"))).distinct()
    roots = kept(connected_components(linked, edges, "fp"), "roots")
    names = (
        roots.join(distinct, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    )
    named = roots.join(names, "component").select("fp", F.col("component_id").alias("group_id"), F.lit(True).alias("linked"))
    return distinct.join(named, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("group_id")).otherwise(F.col("first_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits), component_id of every document."""
    prints = fingerprints(docs)
    named = prints.join(components(prints), "fp")
    return named.select(
        "doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (ids that are null come
    last, rows with that id by their text's hash)."""
    found = near_duplicates(docs)
    first = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    )
    winners = first.select(F.col("first.doc_id").alias("win_id"), F.col("first.text_key").alias("win_key"))
    return pick_rows(docs, winners, F.xxhash64("text"))
