"""Periodic runs of words in each document, found in a grammar of the document.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and two periods
long, that no neighbouring word extends.  Re-Pair turns the word ids into a grammar: the most
frequent pair of neighbours becomes a rule until no pair occurs twice; a balanced tree covers
the sequence that is left.  Every run crosses the boundary between the two parts of some node,
so each rule is looked at once, in its first derivation, for the periodic stretches across its
boundary.  These are carried to all positions where the rule is derived, and stretches of one
period that overlap by the period are merged into maximal ones.

Across a boundary b a run has the pair of equal words (b-q, b) or (b-1, b-1+q), inside at least
six such pairs in a row.  So the periods to try are the distances from the three words at b, or
ending there, to their other places within the node; the extent of each comes from comparing
slices of the ids.  For the same reason a document in which no six words in a row come twice
has no run, and gets no grammar.

The work is one map over the documents and needs no shuffle.  Null and empty texts have no
words and no run; whole texts are read; repeated rows are treated alike; an empty table gives
an empty table; only doc_id and text are read, whatever the other columns are called.
"""

import hashlib
import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import raw, result, text_batches, words_of

LEAST = 12
Run = tuple[int, int, int]  # start, end (exclusive), period


def re_pair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """Rules (pairs of symbols), the sequence left, and the number of the first rule's symbol.

    Symbols below that number are words.  Equal counts go by the pair, so the grammar depends on
    the words alone.
    """
    n, first = len(ids), max(ids, default=-1) + 1
    base = first + n + 1
    symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[ids[i] * base + ids[i + 1]].append(i)
    count = defaultdict(int, {pair: len(at) for pair, at in places.items()})
    heap = [(-c, pair) for pair, c in count.items() if c > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        c, pair = heapq.heappop(heap)
        now = count[pair]
        if now < 2:
            continue
        if now != -c:
            heapq.heappush(heap, (-now, pair))
            continue
        (a, b), new, fresh, used = divmod(pair, base), first + len(rules), set(), False
        for i in places.pop(pair):
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            left, right, used = before[i], after[j], True
            symbol[i], symbol[j], after[i] = new, -1, right
            count[pair] -= 1
            if left >= 0:
                count[symbol[left] * base + a] -= 1
                key = symbol[left] * base + new
                places[key].append(left)
                count[key] += 1
                fresh.add(key)
            if right < n:
                before[right] = i
                count[b * base + symbol[right]] -= 1
                key = new * base + symbol[right]
                places[key].append(i)
                count[key] += 1
                fresh.add(key)
        count[pair] = 0
        if used:
            rules.append((a, b))
        for key in fresh:
            if count[key] > 1:
                heapq.heappush(heap, (-count[key], key))
    left, i = [], 0
    while i < n:
        left.append(symbol[i])
        i = after[i]
    return rules, left, first


class Text:
    """Word ids of one document with what comparing its stretches needs."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.bytes = np.array(ids, np.int32).tobytes()
        self.threes: dict[tuple, list[int]] = defaultdict(list)
        for i, three in enumerate(zip(ids, ids[1:], ids[2:])):
            self.threes[three].append(i)

    def three(self, i: int) -> list[int]:
        """Places of the three words that start at i."""
        return self.threes.get(tuple(self.ids[i : i + 3]), []) if i >= 0 else []

    def forward(self, i: int, j: int, most: int) -> int:
        """How many words from i and from j on are equal, at most ``most``."""
        return self._common(most, lambda a, b: (4 * (i + a), 4 * (i + b), 4 * (j + a), 4 * (j + b)))

    def backward(self, i: int, j: int, most: int) -> int:
        """How many words before i and before j are equal."""
        return self._common(most, lambda a, b: (4 * (i - b), 4 * (i - a), 4 * (j - b), 4 * (j - a)))

    def _common(self, most: int, span) -> int:
        data, good, step = self.bytes, 0, 4
        while good < most:  # ever longer slices, then ever shorter ones
            end = min(good + step, most)
            a, b, c, d = span(good, end)
            if data[a:b] != data[c:d]:
                break
            good, step = end, 2 * step
        else:
            return most
        bad = min(good + step, most)
        while bad - good > 1:
            middle = (good + bad) // 2
            a, b, c, d = span(good, middle)
            if data[a:b] == data[c:d]:
                good = middle
            else:
                bad = middle
        return good

    def crossing(self, low: int, cut: int, high: int) -> list[Run]:
        """Stretches within [low, high) around the boundary before word ``cut``: at least
        ``LEAST`` words and two of their smallest period."""
        longest = (high - low) // 2
        back, on = set(), set()
        for at, shift in ((cut, 0), (cut - 2, 2)):
            found = self.three(at)
            for p in found[bisect_left(found, low) : bisect_left(found, at)]:
                back.add(at - p)
        for at, shift in ((cut - 1, 0), (cut - 3, 2)):
            found = self.three(at)
            for p in found[bisect_right(found, at) : bisect_left(found, high - shift)]:
                on.add(p - at)
        runs: list[Run] = []
        for q in sorted(back | on):
            if q > longest:
                break
            for i in ([cut - q] if q in back else []) + ([cut - 1] if q in on else []):
                j = i + q
                if i < low or j >= high or any(q % r == 0 and s <= i and j < e for s, e, r in runs):
                    continue  # a multiple of a period found, inside its stretch
                start = i - self.backward(i, j, i - low)
                end = j + self.forward(i, j, high - j)
                if end - start >= max(LEAST, 2 * q) and not any(
                    q % r == 0 and s <= start and end <= e for s, e, r in runs
                ):
                    runs.append((start, end, q))
        return runs


def runs_of(ids: list[int]) -> list[Run]:
    """All runs by start, then period."""
    if len(ids) < LEAST:
        return []
    rules, left, first = re_pair(ids)
    text = Text(ids)
    length = [1] * first
    for y, z in rules:
        length.append(length[y] + length[z])
    offsets, starts = [0], [[] for _ in rules]
    for x in left:
        if x >= first:
            starts[x - first].append(offsets[-1])
        offsets.append(offsets[-1] + length[x])
    found: set[Run] = set()
    for k in range(len(rules) - 1, -1, -1):  # a rule is used in later rules only
        y, z = rules[k]
        at = starts[k]
        if y >= first:
            starts[y - first] += at
        if z >= first:
            starts[z - first] += [a + length[y] for a in at]
        if length[first + k] >= LEAST and at:
            origin = at[0]
            for s, e, q in text.crossing(origin, origin + length[y], origin + length[first + k]):
                found.update((s + a - origin, e + a - origin, q) for a in at)
    nodes = [(0, len(left))]
    while nodes:
        a, b = nodes.pop()
        if b - a < 2 or offsets[b] - offsets[a] < LEAST:
            continue
        middle = (a + b) // 2
        found.update(text.crossing(offsets[a], offsets[middle], offsets[b]))
        nodes += [(a, middle), (middle, b)]
    return merged(found)


def merged(stretches: set[Run]) -> list[Run]:
    """Maximal stretches: those of one period that overlap by at least the period are one."""
    out: list[Run] = []
    for q, s, e in sorted((q, s, e) for s, e, q in stretches):
        if out and out[-1][2] == q and s + q <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), q)
        else:
            out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def may_have_runs(words: list[bytes]) -> bool:
    """Whether six words in a row come twice (equal hashes count as equal)."""
    n = len(words) - 5
    if n < 2:
        return False
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    six = np.zeros(n, np.uint64)
    for k in range(6):
        six = six * np.uint64(0x9E3779B97F4A7C15) + own[k : n + k]
    six.sort()
    return bool((six[1:] == six[:-1]).any())


def word_runs(words: list[bytes]) -> list[Run]:
    if not may_have_runs(words):
        return []
    number: dict[bytes, int] = {}
    return runs_of([number.setdefault(w, len(number)) for w in words])


def with_periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's words: a tenth of the documents, by hash, end in repetitions."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that are in no run beyond its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        drop[s + q] += 1
        drop[e] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def collapse_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and the
    collapsed words of every document, joined by one space.  ``prepare(words, doc_id)`` may
    change the words first."""

    def find(arrow):
        for batch, texts in text_batches(arrow):
            counts, all_runs, bodies = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                words = words_of(text)
                words = prepare(words, doc_id) if prepare else words
                runs = word_runs(words)
                counts.append(len(words))
                all_runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs])
                bodies.append(b" ".join(collapsed(words, runs)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield result(
                batch, ["doc_id"], n_words=pa.array(counts, pa.int64()), runs=pa.array(all_runs, kind),
                collapsed=pa.array(bodies, pa.binary()),
            )

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
