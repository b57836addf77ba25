"""Byte-level BPE by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (as many slots as tokens) resolves a
whole pre-token with one probe and one comparison.  Tier two: a miss is merged over its
linked bytes with a heap of candidate pairs, lowest rank first, leftmost among equals; the
rank of two bytes comes from a table of all pairs of bytes, that of longer pieces from the
ranks themselves.  Results per pre-token are remembered while a worker lives, in two
generations of bounded size: when the younger is full the older is forgotten, so frequent
pre-tokens stay.

The work is one map over the documents and needs no shuffle.  The vocabulary is a file of
fixed size.  Null text is empty: no tokens, the digest of nothing.
"""

import base64
import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import raw, result, text_batches

REMEMBERED = 100_000  # pre-tokens a worker remembers in each generation
LONGEST = 64  # bytes of a remembered pre-token
MASK = (1 << 64) - 1
ODD, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers that mix 64-bit words

# The letters, numbers and white space among the first 256 code points.
LATIN_LETTERS = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = rb"\t-\r \x85\xa0"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of byte strings (hash, displace): n keys, n slots.

    Buckets are placed from the largest to the smallest; each tries displacements until
    its keys meet free slots only, and the single-key buckets take what is left.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)  # few keys a bucket: few displacements to try
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys repeat or their hashes collide")
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in hashes:
            groups[h % self.buckets].append(h)
        self.shift = [0] * self.buckets
        used, order = bytearray(n), sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            d = 0
            while True:
                slots = {self._place(h, d) for h in groups[b]}
                if len(slots) == len(groups[b]) and not any(used[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s in slots:
                used[s] = 1
        free = (s for s in range(n) if not used[s])
        for b in order:
            if len(groups[b]) == 1:
                self.shift[b] = -1 - next(free)
        self.keys: list[bytes] = [b""] * n
        for k in keys:
            self.keys[self.slot(k)] = k

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else self._place(h, d)

    def _place(self, h: int, d: int) -> int:
        """A slot that looks independent for every displacement ``d``."""
        return (((h + d * ODD) * SPREAD & MASK) >> 20) % self.n


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash, self.ranks = PerfectHash(list(ranks)), ranks
        self.pair_rank = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.rank_at = [ranks[k] for k in self.hash.keys]
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for k, r in ranks.items():
            self.token[r] = k
        self.text_of = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.latin = self._latin(pattern)
        self.memory: dict = {}
        self.older: dict = {}

    @staticmethod
    def _latin(pattern: str):
        """The known pattern over Latin-1 bytes, where each byte is one code point; else None."""
        if pattern != default_pattern():
            return None
        a, n, s = LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES
        other = b"[^" + s + a + n + b"]+"
        forms = [rb"'(?:[stmd]|re|ve|ll)", b" ?[" + a + b"]+", b" ?[" + n + b"]+", b" ?" + other]
        forms += [b"[" + s + b"]+(?![^" + s + b"])", b"[" + s + b"]+"]
        return re.compile(b"|".join(forms)).findall

    def rank(self, piece: bytes) -> int | None:
        at = self.hash.slot(piece)
        return self.rank_at[at] if self.hash.keys[at] == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Heap over linked bytes: entries whose pair has changed since are passed over.

        An entry is one number made of rank, left end and right end.
        """
        n, get, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        pairs, bits = self.pair_rank, n.bit_length()
        mask, wide = (1 << bits) - 1, 2 * bits
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap, i = [], 2
        for a, b in zip(piece, piece[1:]):
            r = pairs[a << 8 | b]
            if r >= 0:
                heap.append(r << wide | i - 2 << bits | i)
            i += 1
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            stop, left = entry & mask, entry >> bits & mask
            right = after[left]
            if right >= n or end[right] != stop:  # ``after`` of a merged byte is n
                continue
            end[left] = stop
            further = after[left] = after[right]
            after[right] = n
            if further < n:
                before[further] = left
                i = end[further]
                r = get(piece[left:i])
                if r is not None:
                    push(heap, r << wide | left << bits | i)
            i = before[left]
            if i >= 0:
                r = get(piece[i:stop])
                if r is not None:
                    push(heap, r << wide | i << bits | stop)
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : end[i]]))
            i = after[i]
        return tuple(ids)

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        r = self.rank(piece)
        return (r,) if r is not None else self.merge(piece)

    def _remember(self, key, piece: bytes) -> tuple[int, ...]:
        ids = self.older.get(key) or self.piece_ids(piece)
        if len(piece) <= LONGEST:
            if len(self.memory) >= REMEMBERED:
                self.older = dict(self.memory)
                self.memory.clear()
            self.memory[key] = ids
        return ids

    def encode(self, text: bytes) -> list[int]:
        """Token ids of a UTF-8 text."""
        chars = text.decode("utf-8", "replace")
        latin = None
        if self.latin:
            try:
                latin = chars.encode("latin-1")
            except UnicodeEncodeError:
                pass
        found = self.memory.get
        if latin is not None:
            parts = ((found(p) or self._remember(p, p.decode("latin-1").encode())) for p in self.latin(latin))
        else:
            parts = ((found(p) or self._remember(p, p.encode())) for p in self.split(chars))
        return list(chain.from_iterable(parts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_encoders: dict = {}


def encoder(name: str, ranks, pattern: str) -> Encoder:
    """One encoder per worker process, vocabulary and pattern; ``ranks`` is a broadcast."""
    if (name, pattern) not in _encoders:
        _encoders[name, pattern] = Encoder(ranks.value, pattern)
    return _encoders[name, pattern]


def _shared(docs: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and broadcast: its size is fixed."""
    path = path or vocabulary_path()
    return path, docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    pattern = pattern or default_pattern()
    name, ranks = _shared(docs, path)

    def encode(arrow):
        own = encoder(name, ranks, pattern)
        for batch, texts in text_batches(arrow):
            yield result(batch, ["doc_id"], ids=pa.array([own.encode(t) for t in texts], pa.list_(pa.int32())))

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text (the bytes) of rows with ids; null ids give null."""
    pattern = default_pattern()
    name, ranks = _shared(encoded, path)

    def decode(arrow):
        own = encoder(name, ranks, pattern)
        for batch in arrow:
            found = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield result(batch, ["doc_id"], text=pa.array(found, pa.binary()))

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text binary")


def round_trip_digests(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the bytes decoded from them; the
    ids themselves if asked for."""
    pattern, want_ids = pattern or default_pattern(), ids
    name, ranks = _shared(docs, path)

    def digests(arrow):
        own = encoder(name, ranks, pattern)
        number = own.text_of.__getitem__
        for batch, texts in text_batches(arrow, 1 << 20):
            all_ids, of_ids, of_bytes = [own.encode(t) for t in texts], [], []
            for found in all_ids:
                of_ids.append(hashlib.sha256(" ".join(map(number, found)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(found)).hexdigest())
            more = {"ids": pa.array(all_ids, pa.list_(pa.int32()))} if want_ids else {}
            yield result(
                batch, ["doc_id"], n_tokens=pa.array(map(len, all_ids), pa.int64()),
                ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_bytes, pa.string()), **more,
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        digests, schema + ", ids array<int>" * want_ids
    )
