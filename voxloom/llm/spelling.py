"""Spelling variants: words one insertion, deletion or replacement apart, and their usual form.

The vocabulary is the table of distinct words with their counts.  A bidirectional FM-index of
words between delimiters keeps, for a pattern, its interval of suffix ranks in the index and that
of the reversed pattern in the index of reversed words, and lengthens it at either end.  A word
within one error of a query holds the query's first or its second half unchanged.  So the search
matches the first half from the left delimiter on, then goes on across the second with one error
allowed, up to the right delimiter; and the second half from the right delimiter back, then the
first with one error.  All queries of a shard take each step together, as arrays.

No index holds the whole vocabulary.  Halves have three letters at least (``HALF``), so a word
found by its first half shares its first three letters with the query and one found by its second
half its last three.  Words are indexed and asked by either key; keys are dealt to shards of about
``SHARD`` letters.  A key above that is refined: a word of length l is indexed under l and its
first (last) max(3, (l-1)//2) letters, which a query shares with every word of that length that it
can find by that half, and asked under the lengths next to its own.  What is still too large is
split by hash into parts of words indexed times parts of words asked.  Nothing is dropped.

A word's form is its near word with the largest count (ties: smallest in code-point order) if
that is ``TIMES`` its own count or more; its root is the end of the chain of forms, followed by
pointer doubling.

Null and empty texts have no words; whole texts are read; repeated rows count once each; a text
whose doc_id is null is counted without planted typing errors; an empty table, or one without a
word frequent enough, gives an empty table.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import kept, raw, text_batches
from voxloom.scratch import spread

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
HALF = LEAST_LENGTH // 2
SHARD = 1 << 19  # letters indexed together
ASKED = 1 << 14  # queries that search together
BLOCK = 64


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change=None) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of enough length and count.

    ``change(doc_id, word)`` may alter a word first, but not lengthen it.
    """

    def count(arrow):
        for batch, texts in text_batches(arrow):
            total: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                # bytes.lower changes A-Z only
                own = Counter(LETTERS.findall(text.lower().decode("utf-8", "replace")))
                for word, n in own.items():
                    if len(word) >= least_length:
                        if change:
                            word = change(doc_id, word)
                        total[word] += n
            words = [w for w in total if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"]
            )

    found = docs.select("doc_id", raw("text").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def with_typing_errors(doc_id: int | None, word: str) -> str:
    """The contract's change: one in 199 of a document's words loses a letter, by hash."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


class Ranks:
    """Suffix ranks of delimited words: counts of smaller and equal symbols before each rank.

    ``text`` is 0 w 0 w ... w 0 with the words in increasing order, so suffixes that agree up to
    their delimiter are in the order of their words, also from one delimiter to the next.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        n, self.width = len(text), symbols + 3  # past the symbols: no symbol before the text, unknown symbols
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + ends.sum())
        order, step = np.argsort(rank, kind="stable"), 1
        while step < n:  # prefix doubling; delimiters have ranks of their own
            key = rank * (n + ends.sum() + symbols + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.kind = np.uint8 if self.width < 256 else np.uint32
        before = text[order - 1].astype(self.kind)
        before[order == 0] = symbols + 1
        blocks = n // BLOCK + 1
        self.before = np.zeros(blocks * BLOCK, self.kind)
        self.before[:n] = before
        sums = np.bincount(np.arange(n) // BLOCK * self.width + before, minlength=blocks * self.width)
        sums = np.cumsum(sums.reshape(blocks, self.width), axis=0)
        self.equal = np.zeros((blocks, self.width), np.int32)
        self.equal[1:] = sums[:-1]
        self.smaller = np.zeros_like(self.equal)
        self.smaller[:, 1:] = np.cumsum(self.equal, axis=1)[:, :-1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.width))[:-1]])

    def count(self, symbol: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before the ranks are smaller than, and equal to, ``symbol``."""
        block, inside = rank // BLOCK, rank % BLOCK
        rows = self.before.reshape(-1, BLOCK)[block]
        here = np.arange(BLOCK, dtype=np.uint8) < inside[:, None].astype(np.uint8)
        wanted = symbol.astype(self.kind)[:, None]
        smaller = np.count_nonzero((rows < wanted) & here, axis=1) + self.smaller[block, symbol]
        return smaller, np.count_nonzero((rows == wanted) & here, axis=1) + self.equal[block, symbol]


class Intervals:
    """Rank intervals of patterns, in the index read leftwards and in the one read rightwards."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: np.ndarray):
        self.at, self.size = {"left": left, "right": right}, size

    def take(self, rows) -> "Intervals":
        return Intervals(self.at["left"][rows], self.at["right"][rows], self.size[rows])

    @staticmethod
    def joined(parts: list["Intervals"]) -> "Intervals":
        return Intervals(*[np.concatenate(x) for x in zip(*[(p.at["left"], p.at["right"], p.size) for p in parts])])


class FMIndex:
    """Bidirectional index of distinct words."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.code = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.words))))}
        self.unknown = len(self.code) + 2
        symbols = len(self.code)
        self.ranks = {
            "left": Ranks(self.coded(self.words), symbols),
            "right": Ranks(self.coded(sorted(w[::-1] for w in self.words)), symbols),
        }

    def coded(self, words: list[str]) -> np.ndarray:
        """0 w 0 w ... w 0 in symbol numbers."""
        joined = "\0" + "".join(w + "\0" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        table = np.full(max(256, int(points.max()) + 1), self.unknown, np.int64)
        for c, i in self.code.items():
            if ord(c) < len(table):
                table[ord(c)] = i
        table[0] = 0
        return table[points]

    def delimiters(self, n: int) -> Intervals:
        """The pattern of one delimiter, n times."""
        return Intervals(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.words) + 1))

    def extend(self, found: Intervals, symbol: np.ndarray, side: str) -> Intervals:
        """The patterns with one more symbol at that side; both intervals stay in step."""
        ranks, low = self.ranks[side], found.at[side]
        below, same = ranks.count(symbol, low)
        below_end, same_end = ranks.count(symbol, low + found.size)
        other = "right" if side == "left" else "left"
        at = {side: ranks.first[symbol] + same, other: found.at[other] + below_end - below}
        return Intervals(at["left"], at["right"], same_end - same)

    def symbols_beside(self, found: Intervals, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Row and symbol of every letter next to the patterns, which have one length: equal
        intervals are looked at once, and different ones share no rank."""
        low, first, row = np.unique(found.at[side], return_index=True, return_inverse=True)
        size = found.size[first]
        owner = np.repeat(np.arange(len(low)), size)
        rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        width = self.ranks[side].width
        pairs = np.unique(owner * width + self.ranks[side].before[rank])
        owner, symbol = pairs // width, pairs % width
        owner, symbol = (x[(symbol > 0) & (symbol <= len(self.code))] for x in (owner, symbol))
        start, end = np.searchsorted(owner, row, "left"), np.searchsorted(owner, row, "right")
        many = end - start
        rows = np.repeat(np.arange(len(row)), many)
        return rows, symbol[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)]

    def near(self, asked: list[str], side: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in ``asked``, number in ``self.words``) one error apart, the error in the
        second half of the query (``side`` right: read rightwards) or in the first (left)."""
        text = self.coded(asked if side == "right" else [w[::-1] for w in asked])
        length = np.array([len(w) for w in asked], np.int64)
        start = np.cumsum(length + 1) - length
        exact = length // 2 if side == "right" else length - length // 2
        query, zero = np.arange(len(asked)), self.delimiters(len(asked))
        pool_query, pool_at, pool = query[:0], query[:0], zero.take(query[:0])
        out_query, out_word, step = [], [], 0
        while len(query) or len(pool_query):
            # with one error the rest must follow as it is, up to the delimiter
            fresh: list[tuple[np.ndarray, np.ndarray, Intervals]] = []
            if len(pool_query):
                symbol = text[start[pool_query] + pool_at]
                pool = self.extend(pool, symbol, side)
                whole = (symbol == 0) & (pool.size > 0)
                out_query.append(pool_query[whole])
                out_word.append(pool.at["left"][whole])  # ranks of delimiters are numbers of words
                rows = np.flatnonzero((symbol > 0) & (pool.size > 0))
                fresh.append((pool_query[rows], pool_at[rows] + 1, pool.take(rows)))
            if len(query):
                free = np.flatnonzero(step >= exact[query])
                if len(free):
                    own, mine, left = query[free], zero.take(free), length[query[free]] - step
                    rows = np.flatnonzero(left > 0)  # the word found lacks the next letter
                    fresh.append((own[rows], np.full(len(rows), step + 1), mine.take(rows)))
                    rows, symbol = self.symbols_beside(mine, side)
                    longer = self.extend(mine.take(rows), symbol, side)
                    fresh.append((own[rows], np.full(len(rows), step), longer))  # has one letter more
                    other = np.flatnonzero((left[rows] > 0) & (symbol != text[start[own[rows]] + step]))
                    fresh.append((own[rows][other], np.full(len(other), step + 1), longer.take(other)))
                rows = np.flatnonzero(length[query] > step)
                query, zero = query[rows], zero.take(rows)
                zero = self.extend(zero, text[start[query] + step], side)
                rows = np.flatnonzero(zero.size > 0)
                query, zero = query[rows], zero.take(rows)
            pool_query, pool_at = (np.concatenate([f[i] for f in fresh]) if fresh else query[:0] for i in (0, 1))
            pool = Intervals.joined([f[2] for f in fresh]) if fresh else zero.take(query[:0])
            step += 1
        pairs = np.unique(np.concatenate([*out_query, query[:0]]) * (len(self.words) + 1) + np.concatenate([*out_word, query[:0]]))
        return pairs // (len(self.words) + 1), pairs % (len(self.words) + 1)


def near_in_shard(words: list[str], indexed: np.ndarray, asked: np.ndarray, side: str) -> tuple[list[str], list[str]]:
    """Pairs of words (asked, indexed) one error apart."""
    index = FMIndex([words[i] for i in np.flatnonzero(indexed)])
    queries = [words[i] for i in np.flatnonzero(asked)]
    one, two = [], []
    for i in range(0, len(queries), ASKED):
        q, w = index.near(queries[i : i + ASKED], side)
        one += [queries[i + k] for k in q.tolist()]
        two += [index.words[k] for k in w.tolist()]
    return one, two


def _end(word: Column | str, side: str, n: Column) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    return F.substring(word, F.lit(1), n) if side == "right" else F.substring(word, F.greatest(F.length(word) - n, F.lit(0)) + 1, n)


def shards(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, side, shard and parts, indexed, asked: every word where it is indexed or asked."""
    length = F.length("word")
    letters = (length + 1).cast("long")
    rows = []
    for side in ("right", "left"):
        keyed = words.select("word", "n", F.lit(side).alias("side"), _end("word", side, F.lit(HALF)).alias("key"))
        sizes = keyed.groupBy("key").agg((F.sum(letters) > shard).alias("hot"))
        keyed = keyed.join(sizes, "key")
        half = lambda l: F.greatest(F.lit(HALF), F.floor((l - 1) / 2).cast("int"))
        finer = lambda l: F.concat_ws(":", l.cast("string"), _end("word", side, half(l)))
        indexed = F.struct(F.when(F.col("hot"), finer(length)).otherwise(F.col("key")).alias("key"), F.lit(True).alias("indexed"))
        near = F.array(length - 1, length, length + 1)
        asked = F.when(F.col("hot"), F.transform(near, finer)).otherwise(F.array("key"))
        for what, place in (("indexed", F.array(indexed["key"])), ("asked", asked)):
            rows.append(keyed.select("word", "n", "side", F.explode(place).alias("key"), F.lit(what == "indexed").alias("indexed")))
    placed = rows[0]
    for more in rows[1:]:
        placed = placed.unionByName(more)
    placed = placed.groupBy("side", "key", "word", "n").agg(
        F.bool_or("indexed").alias("indexed"), F.bool_or(~F.col("indexed")).alias("asked")
    )
    sizes = placed.groupBy("side", "key").agg(
        F.sum(F.when(F.col("indexed"), letters).otherwise(0)).alias("own"),
        F.sum(F.when(F.col("asked"), letters).otherwise(0)).alias("others"),
    ).where("own > 0 and others > 0")
    sizes = sizes.select(
        "side", "key", F.ceil(F.col("own") / shard).cast("int").alias("own_parts"),
        F.ceil(F.col("others") / shard).cast("int").alias("other_parts"),
    )
    return placed.join(sizes, ["side", "key"])


def near_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, near, near_n: all pairs of ``words(word, n)`` one error apart, both ways."""
    bundles = max(1, int((words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // shard) + 1)
    placed = shards(words, shard)
    spot = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.when(F.col("indexed"), F.array(spot(F.col("own_parts")))).otherwise(F.array().cast("array<int>"))
    other = F.when(F.col("asked"), F.array(spot(F.col("other_parts")))).otherwise(F.array().cast("array<int>"))
    # an indexed word meets every part of those that ask, and the other way round
    indexed = placed.where("indexed").withColumn("i", F.explode(own)).withColumn("j", F.explode(numbers(F.col("other_parts"))))
    asked = placed.where("asked").withColumn("j", F.explode(other)).withColumn("i", F.explode(numbers(F.col("own_parts"))))
    place = ["side", F.pmod(F.xxhash64("side", "key"), F.lit(bundles)).alias("bundle"), "i", "j"]
    rows = indexed.select(*place, "word", "n", F.lit(True).alias("indexed")).unionByName(
        asked.select(*place, "word", "n", F.lit(False).alias("indexed"))
    )
    keys = ["side", "bundle", "i", "j"]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["side"].iloc[0]
        counts = dict(zip(frame["word"], frame["n"]))
        words, indexed = frame["word"].tolist(), frame["indexed"].to_numpy(bool)
        one, two = near_in_shard(words, indexed, ~indexed, side) if indexed.any() else ([], [])
        return pd.DataFrame({
            "word": pd.Series(one, dtype=object), "n": pd.Series([counts[w] for w in one], dtype="int64"),
            "near": pd.Series(two, dtype=object), "near_n": pd.Series([counts[w] for w in two], dtype="int64"),
        })

    found = spread(rows, *keys).groupBy(*keys).applyInPandas(search, "word string, n long, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of ``forms(word, form)``, whose links have no circle."""
    links = kept(forms.select("word", F.col("form").alias("root")), "form-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = kept(
            links.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "form-links",
        )
        if not links.agg(F.max("moved")).first()[0]:
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words(word, n)``."""
    words = kept(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = near_pairs(words, shard).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    judged = words.join(best, "word", "left").withColumn("most", -F.col("best.order"))
    usual = F.col("most") >= times * F.col("n")
    judged = kept(
        judged.select(
            "word", F.when(usual, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(usual, F.col("most")).alias("form_n"),
        ),
        "judged-words",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
