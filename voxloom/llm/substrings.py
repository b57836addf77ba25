"""Substring deduplication with suffix automata of reference shards.

A window is ``LENGTH`` consecutive words.  A word goes if some window over it also starts
in a document with a smaller id.  Sending every document past the automaton of every shard
would grow with the square of the corpus, so documents first find the one shard that each
of their windows can be in:

1. The seed of a window is the least hash among its runs of ``RUN`` words; equal windows
   have equal seeds.  Per document the distinct seeds are kept, a fifth of the words.
2. The home of a seed is the smallest document that has it; seeds of one document only
   end here.
3. A document cuts out its stretches of windows with one home.  The home's own stretches
   are the reference shard, built into a suffix automaton that all stretches sent there
   are streamed past.  Where the matching statistics reach ``LENGTH`` words, the span goes.
   A shard that many documents ask is built by several tasks, each for some of them.
4. Windows that share a seed with their home but are not in it may repeat among the other
   documents of the seed: these few are compared by a 128-bit hash, which is exact for all
   that step 3 leaves.

Null texts have no words.  Rows with a null id are kept whole and are no reference.  Rows
that repeat an id count as parts of one document; texts under ``LENGTH`` words stay whole.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import discard, kept, raw, result, text_batches, words_of

LENGTH = 13
RUN = 4
HOT_SHARE = 1000  # a home asked by over 1/1000 of the stretches is built more than once
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio


class Automaton:
    """Suffix automaton over words, grown one word at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def add(self, word) -> None:
        edges, link, length = self.next, self.link, self.length
        state, at = self._state(length[self.last] + 1, 0, {}), self.last
        self.last = state
        while at >= 0 and word not in edges[at]:
            edges[at][word] = state
            at = link[at]
        if at < 0:
            return
        target = edges[at][word]
        if length[target] == length[at] + 1:
            link[state] = target
            return
        twin = self._state(length[at] + 1, link[target], dict(edges[target]))
        link[target] = link[state] = twin
        while at >= 0 and edges[at].get(word) == target:
            edges[at][word] = twin
            at = link[at]

    def add_text(self, words: list) -> None:
        """Texts are kept apart by a mark no text has."""
        for word in words:
            self.add(word)
        self.add(None)

    def matching(self, words: list) -> list[int]:
        """For each place the length of the longest run ending there that is in a text."""
        edges, link, length = self.next, self.link, self.length
        at, size, out = 0, 0, []
        for word in words:
            while at and word not in edges[at]:
                at = link[at]
                size = length[at]
            if word in edges[at]:
                at = edges[at][word]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def window_seeds(words: list[bytes]) -> np.ndarray:
    """The seed of every window, as signed longs."""
    count = len(words) - LENGTH + 1
    if count < 1:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    single = np.array([digest(w) for w in words], np.uint64)
    runs = np.zeros(len(words) - RUN + 1, np.uint64)
    for i in range(RUN):
        runs = runs * MULTIPLIER + single[i : i + len(runs)]
    runs ^= runs >> np.uint64(29)
    runs *= MULTIPLIER
    least, width = runs, 1
    while 2 * width <= LENGTH - RUN + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - RUN + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least.view(np.int64)


def _emit_seeds(arrow):
    for batch, texts in text_batches(arrow):
        ids = batch.column("doc_id").to_pylist()
        parts = [np.unique(window_seeds(words_of(t))) for t in texts]
        owners = np.repeat(np.array(ids, np.int64), [len(p) for p in parts])
        seeds = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(owners)], ["seed", "doc_id"])


def all_seeds(docs: DataFrame) -> DataFrame:
    """seed, doc_id: the distinct seeds of every document with an id."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", raw("text").alias("text"))
    return kept(texts.mapInArrow(_emit_seeds, "seed long, doc_id long"), "seeds")


def shared_seeds(seeds: DataFrame) -> DataFrame:
    """doc_id, shared: the seeds a document shares with others, and their homes."""
    homes = seeds.groupBy("seed").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last")
    return seeds.join(homes.select("seed", "home"), "seed").groupBy("doc_id").agg(
        F.collect_list(F.struct("seed", "home")).alias("shared")
    )


def _kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _home_stretches(words: list[bytes], shared) -> list[tuple[int, int, int]]:
    """Home, first and last word (exclusive) of the runs of windows with one home."""
    seeds = window_seeds(words)
    known = shared.values.field("seed").to_numpy()
    order = np.argsort(known, kind="stable")
    at = order[np.searchsorted(known, seeds, sorter=order).clip(max=len(known) - 1)]
    hit = known[at] == seeds
    home = np.where(hit, shared.values.field("home").to_numpy()[at], -1)
    cuts = np.flatnonzero((home[1:] != home[:-1]) | (hit[1:] != hit[:-1])) + 1
    bounds = zip([0, *cuts.tolist()], [*cuts.tolist(), len(home)])
    return [(int(home[a]), a, b - 1 + LENGTH) for a, b in bounds if b > a and hit[a]]


STRETCH = "array<struct<home: long, start: int, stop: int>>"


def _open_documents(arrow):
    """Answers documents without shared seeds; the others keep their text and stretches."""
    kind = pa.list_(pa.struct([("home", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch, texts in text_batches(arrow):
        stretches, digests, bodies, counts = [], [], [], []
        for text, shared in zip(texts, batch.column("shared")):
            words = words_of(text)
            found = _home_stretches(words, shared) if shared.is_valid else []
            counts.append(len(words))
            stretches.append([dict(zip(("home", "start", "stop"), f)) for f in found] if found else None)
            digests.append(None if found else _kept_digest(words))
            bodies.append(text if found else None)
        yield result(
            batch, ["doc_id", "text_key"], stretches=pa.array(stretches, kind), n_words=pa.array(counts, pa.int64()),
            digest=pa.array(digests, pa.string()), body=pa.array(bodies, pa.binary()),
        )


def _stretches(arrow):
    """Stretches of windows of one home, of the home itself or sent to it."""
    for batch, texts in text_batches(arrow):
        rows: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "stretches"))
        for text, doc, key, found in zip(texts, *columns):
            words = words_of(text)
            for f in found:
                part = b" ".join(words[f["start"] : f["stop"]])
                rows.append((f["home"], f["home"] != doc, doc, key, f["start"], part))
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["home", "sent", "doc_id", "text_key", "start", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _found(doc, key, start, words, lengths):
    """Spans of windows that the home has, and hashes of the windows it lacks."""
    ends = np.array(lengths) >= LENGTH
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(ends)
    np.add.at(covered, at - LENGTH + 1, 1)
    np.add.at(covered, at + 1, -1)
    inside = np.cumsum(covered)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield doc, key, start + a, start + b, None
    for e in np.flatnonzero(~ends[LENGTH - 1 :]).tolist():
        digest = xxhash.xxh128_digest(b" ".join(words[e : e + LENGTH]))
        yield doc, key, start + e, start + e + LENGTH, digest


def _stream(arrow):
    """Rows sorted by shard, its own stretches first: build the automaton, stream the rest."""
    shard, automaton, built = None, None, False
    for batch in arrow:
        rows: list[tuple] = []
        for home, salt, sent, doc, key, start, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (home, salt) != shard:
                shard, automaton = (home, salt), Automaton()
            words = words_of(text)
            if not sent:
                automaton.add_text(words)
            else:
                rows.extend(_found(doc, key, start, words, automaton.matching(words)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "text_key", "start", "stop", "digest"]
        )


def repeated_spans(opened: DataFrame) -> DataFrame:
    """doc_id, text_key, start, stop (words) of everything that goes."""
    stretches = kept(
        opened.select("doc_id", "text_key", F.col("body").alias("text"), "stretches").mapInArrow(
            _stretches, "home long, sent boolean, doc_id long, text_key long, start long, text binary"
        ),
        "stretches",
    )
    asked = kept(stretches.where("sent").groupBy("home").agg(F.count(F.lit(1)).alias("n")), "asked")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = asked.where(F.col("n") * HOT_SHARE > total).select(
        F.col("home"), F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("salts")
    )  # at most HOT_SHARE rows
    salts = F.coalesce("salts", F.lit(1))
    own = F.sequence(F.lit(0), salts - 1)
    one = F.array(F.pmod(F.xxhash64("doc_id", "text_key", "start"), salts).cast("int"))
    dealt = stretches.join(F.broadcast(hot), "home", "left").withColumn("salt", F.explode(F.when(F.col("sent"), one).otherwise(own)))
    sorted_rows = dealt.select("home", "salt", "sent", "doc_id", "text_key", "start", "text").repartition(
        F.col("home"), F.col("salt")
    ).sortWithinPartitions("home", "salt", "sent")
    found = kept(
        sorted_rows.mapInArrow(_stream, "doc_id long, text_key long, start long, stop long, digest binary"), "spans"
    )
    discard(stretches)
    discard(asked)
    open_windows = found.where(F.col("digest").isNotNull())
    first = open_windows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = open_windows.join(first, "digest").where(F.col("doc_id") > F.col("first"))
    columns = ["doc_id", "text_key", "start", "stop"]
    return found.where(F.col("digest").isNull()).select(columns).unionByName(later.select(columns))


def _without_spans(arrow):
    for batch in arrow:
        columns = [batch.column(c) for c in ("n_words", "digest", "body", "spans")]
        removed, digests = [], []
        for n, digest, body, spans in zip(*(c.to_pylist() for c in columns)):
            gone = 0
            if body is not None:
                words = words_of(body)
                away = np.zeros(len(words), bool)
                for s in spans or ():
                    away[s["start"] : s["stop"]] = True
                gone = int(away.sum())
                digest = _kept_digest([w for w, a in zip(words, away.tolist()) if not a])
            removed.append(gone)
            digests.append(digest)
        yield result(
            batch, ["doc_id", "n_words"], n_removed=pa.array(removed, pa.int64()), kept_sha256=pa.array(digests, pa.string())
        )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay, for every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw("text").alias("text"))
    seeds = all_seeds(docs)
    opened = kept(
        rows.join(shared_seeds(seeds), "doc_id", "left").mapInArrow(
            _open_documents, f"doc_id long, text_key long, stretches {STRETCH}, n_words long, digest string, body binary"
        ),
        "opened",
    )
    discard(seeds)
    spans = repeated_spans(opened.where(F.col("body").isNotNull())).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    return opened.drop("stretches").join(spans, ["doc_id", "text_key"], "left").mapInArrow(
        _without_spans, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
