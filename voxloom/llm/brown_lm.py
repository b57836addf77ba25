"""Language-model scoring with Brown classes found by exchange clustering.

Tokens are the lower-cased words of a text and one end token, which also stands before the
first word.  The model is P(word | previous) = P(class | previous class) P(word | class).

Counts cover every training text.  What exchange clustering moves between the ``CLASSES``
classes are units: each word with at least one token in ``UNIT_SHARE`` is a unit (so there
are at most that many), and the rarer words move together by the hash of their last three
characters, in ``ENDINGS`` units.  Spark counts, over all training texts, how often one unit
follows another (a matrix of bounded size); a sweep moves unit after unit to the class with the
largest gain in likelihood, every count following every move, until under ``SETTLED`` of them move.

Then the rarer words with at least one token in ``BROADCAST_SHARE`` leave their ending: with
the classes fixed, Spark sums how often each stands before and after each class, and each goes
to the class that makes its own contexts likeliest, ``REFINED`` times.  These words (so at most
that many, of at most ``LONGEST`` bytes) reach the tasks as a broadcast.

All other training words, however rare or long, get the class of their own contexts too, by a
shuffle: texts are written as chunks that name each such word once, the contexts of a word from
all chunks meet, and its count and class go back to the chunks by a join.  A context counts a rare
neighbour by its ending; the ending's class counts ``TRUST_ENDING`` nats, which few contexts
outweigh only if they agree.  A word brings at most one row a chunk, so no key is hot.  Class
bigrams and scores are then those of every word's own class.  Only words that no training text
holds, which have no contexts, have the class of their ending.

Null texts are empty: one end token.  Null ids never train on purpose (their fold is
unknown).  Repeated rows count as often as they stand.  Without training text every score
is that of an empty model.
"""

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import discard, kept, raw, text_batches, words_of
from voxloom.scratch import spread

FOLDS, HELD_OUT = 5, 1
CLASSES = 32
UNIT_SHARE = 2048
ENDINGS = 512
BROADCAST_SHARE = 400_000
LONGEST = 64
SWEEPS = 30  # at most
SETTLED = 0.01  # a sweep that moves a smaller share of the units is the last
REFINED = 2
TRUST_CLASSES = 20.0  # weight of the class frequencies when transitions are smoothed
TRUST_ENDING = 2.0
ADDED = 0.5
END = b""  # no word is empty
FLUSH = 400_000  # distinct words a task counts before it passes them on
CHUNK = 64  # units whose followers one task adds up
GROUP = 4096  # words that one task gives their classes
CHUNK_BYTES = 1 << 23  # of text; a longer text is a chunk
# chunks are long rows: row groups of few of them
CHUNK_FILES = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 4}
TRAINING = ("train", "lengths", "numbers", "endings")  # what training reads of a chunk
LOOKED_UP = 100_000  # words a driver remembers


def held_out(doc_id: Column) -> Column:
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def training(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def tokens_of(text: bytes) -> list[bytes]:
    return [*words_of(text.lower()), END]


class Slots(dict):
    """Numbers for words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


TEXTS = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
         ("lengths", pa.list_(pa.int32())), ("numbers", pa.binary()), ("words", pa.list_(pa.binary()))]
TEXTS_SQL = "chunk long, doc_ids array<long>, train array<boolean>, lengths array<int>, numbers binary, words array<binary>"


def text_chunks(docs: DataFrame) -> DataFrame:
    """The texts, a chunk of them a row: numbers stand for the chunk's ``words``, which occur ``counts``
    times in its training texts."""
    schema = pa.schema([*TEXTS, ("counts", pa.binary())])

    def number(arrow):
        part, i, size, ids, trains, numbers, slots = TaskContext.get().partitionId() << 32, 0, 0, [], [], [], Slots()

        def chunk():
            lengths = np.array(list(map(len, numbers)), np.int32)
            train, flat = np.concatenate(trains), np.concatenate(numbers)
            counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(slots))
            return _row(schema, part | i, ids, train, lengths, flat.tobytes(), list(slots), counts.tobytes())

        for batch, texts in text_batches(arrow, CHUNK_BYTES):
            for text in texts:
                tokens = tokens_of(text)
                numbers.append(np.fromiter(map(slots.__getitem__, tokens), np.int32, len(tokens)))
            ids += batch.column("doc_id").to_pylist()
            trains.append(batch.column("train").to_numpy(zero_copy_only=False))
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield chunk()
                i, size, ids, trains, numbers, slots = i + 1, 0, [], [], [], Slots()
        if numbers:
            yield chunk()

    texts = docs.select("doc_id", training(F.col("doc_id")).alias("train"), raw("text").alias("text"))
    return texts.mapInArrow(number, f"{TEXTS_SQL}, counts binary")


def _count_words(arrow):
    total: dict[bytes, int] = {}

    def passed_on():
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"]
        )
        total.clear()

    for batch in arrow:
        for words, counts in zip(batch.column("words"), batch.column("counts")):
            counts = np.frombuffer(counts.as_py(), np.int64)
            at = np.flatnonzero(counts)
            for word, n in zip(words.values.take(pa.array(at)).to_pylist(), counts[at].tolist()):
                total[word] = total.get(word, 0) + n
            if len(total) > FLUSH:
                yield from passed_on()
    yield from passed_on()


def word_counts(texts: DataFrame) -> DataFrame:
    partial = texts.select("words", "counts").mapInArrow(_count_words, "word binary, n long")
    return kept(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def ending(word: bytes) -> int:
    last = word[-12:]  # three characters are 12 bytes at most
    last = last[-3:] if last.isascii() else last.decode("utf-8", "ignore")[-3:].encode()
    return zlib.crc32(last) & (ENDINGS - 1)


class Units(dict):
    """Word to number: frequent words have their own, others one of ``ENDINGS`` after them."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + ending(word)


class Words(Units):
    """Numbers of all words; after the endings' come ``CLASSES`` numbers, one a class, for the words
    in ``table(word, n, class)``, which are looked up one by one."""

    def __init__(self, units: Units, table: DataFrame):
        super().__init__(units)
        self.table, self.seen = table, {}

    def __missing__(self, word: bytes) -> int:
        if word not in self.seen:
            if len(self.seen) >= LOOKED_UP:
                self.seen.clear()
            row = self.table.where(F.col("word") == F.lit(bytearray(word))).first()
            self.seen[word] = super().__missing__(word) if row is None else len(self) + ENDINGS + row["class"]
        return self.seen[word]


def numbered(texts: DataFrame, units) -> DataFrame:
    """Chunks in the numbers of ``units``, written once.

    Numbers from ``len(units)`` on stand for the chunk's own ``words``, now the rare ones; ``endings``
    has the unit of each.
    """
    schema = pa.schema([*TEXTS, ("endings", pa.binary())])

    def number(arrow):
        of = units.value
        for batch in arrow:
            for i in range(batch.num_rows):
                column = batch.column("words")[i].values
                words = column.to_pylist()
                found = np.fromiter(map(of.get, words, repeat(-1)), np.int32, len(words))
                rare = np.flatnonzero(found < 0)
                found[rare] = len(of) + np.arange(len(rare))
                endings = np.fromiter((of.__missing__(words[at]) for at in rare.tolist()), np.int32, len(rare))
                numbers = found[np.frombuffer(batch.column("numbers")[i].as_py(), np.int32)]
                chunk, ids, train, lengths = (batch.column(c)[i].as_py() for c in ("chunk", "doc_ids", "train", "lengths"))
                yield _row(schema, chunk, ids, train, lengths, numbers.tobytes(), column.take(pa.array(rare)), endings.tobytes())

    return kept(texts.drop("counts").mapInArrow(number, f"{TEXTS_SQL}, endings binary"), "numbered", **CHUNK_FILES)


def chunk_numbers(batch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a chunk's tokens, the units of its own words, and the lengths of its texts."""
    numbers, endings = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("numbers", "endings"))
    return numbers, endings, np.array(batch.column("lengths")[i].as_py(), np.int64)


def units_of(numbers: np.ndarray, endings: np.ndarray, first: int) -> np.ndarray:
    units, rare = numbers.astype(np.int64), numbers >= first
    units[rare] = endings[numbers[rare] - first]
    return units


def training_numbers(arrow):
    """Chunk by chunk its batch and place, the numbers of the training tokens and the units of the rare words."""
    for batch in arrow:
        for i in range(batch.num_rows):
            numbers, endings, lengths = chunk_numbers(batch, i)
            train = np.array(batch.column("train")[i].as_py(), bool)
            yield batch, i, numbers[np.repeat(train, lengths)], endings


def neighbours(arrow, first: int, end: int):
    """Arrays of units and of the units right before them."""
    for _, _, numbers, endings in training_numbers(arrow):
        if len(numbers):
            # every text ends with the end unit, so the unit before a text's first is the end
            flat = units_of(numbers, endings, first)
            yield flat, np.concatenate(([end], flat[:-1]))


def summed_codes(chunks: DataFrame, codes_of, width: int, first: int, end: int) -> DataFrame:
    """chunk, codes, counts: how often ``codes_of(units, units before)`` gives each code, by task
    and chunk of ``width`` codes."""

    def summed(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(codes), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

    def rows(keys: np.ndarray, n: np.ndarray):
        chunks = keys // width
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunks[a]], pa.int64()), pa.array([keys[a:b].tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())],
                    ["chunk", "codes", "counts"],
                )

    def count(arrow):
        codes, counts, pending = [], [], 0
        for here, left in neighbours(arrow, first, end):
            for part in codes_of(here, left):
                keys, n = np.unique(part, return_counts=True)
                codes.append(keys)
                counts.append(n)
                pending += len(keys)
            if pending > FLUSH * 5:
                keys, n = summed(codes, counts)
                codes, counts, pending = [keys], [n], len(keys)
                if pending > FLUSH * 2:
                    yield from rows(keys, n)
                    codes, counts, pending = [], [], 0
        if codes:
            yield from rows(*summed(codes, counts))

    return chunks.select(*TRAINING).mapInArrow(count, "chunk long, codes binary, counts binary")


def added_up(parts: DataFrame, width: int, found_of) -> DataFrame:
    """chunk, found: what ``found_of`` makes of a chunk's counts, code by code.

    A task adds up its chunks row by row, so that what it holds does not grow with the tasks that counted.
    """

    def add(arrow):
        totals: dict[int, np.ndarray] = {}
        for batch in arrow:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                codes, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("codes", "counts"))
                if chunk not in totals:
                    totals[chunk] = np.zeros(width, np.int64)
                totals[chunk][codes - chunk * width] += counts
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([found_of(total).tobytes()], pa.binary())], ["chunk", "found"]
            )

    return spread(parts, "chunk").mapInArrow(add, "chunk long, found binary")


def unit_pairs(chunks: DataFrame, coarse: np.ndarray, first: int, end: int) -> np.ndarray:
    """pairs[u, v]: how often unit v stands right after unit u; ``coarse`` gives the unit that
    clustering moves for each unit in ``chunks``."""
    shared, n = chunks.sparkSession.sparkContext.broadcast(coarse.astype(np.int64)), int(coarse.max()) + 1
    rows, width = CHUNK, CHUNK * n

    found = summed_codes(chunks, lambda here, left: [shared.value[left] * n + shared.value[here]], width, first, end)
    pairs = np.zeros((-(-n // rows) * rows, n))
    for row in added_up(found, width, lambda total: total).collect():  # units x units
        pairs[row["chunk"] * rows : (row["chunk"] + 1) * rows] = np.frombuffer(row["found"], np.int64).reshape(rows, n)
    return pairs[:n]


def likeliest(
    left: np.ndarray, right: np.ndarray, follow: np.ndarray, expected: np.ndarray | None = None, trust: float = 0.0,
) -> np.ndarray:
    """Class of each word by its counts after (``left``) and before (``right``) each class, with
    ``follow[c, d]`` fixed: what makes the word and its neighbours likeliest.  The ``expected``
    class is ahead by ``trust``."""
    to = np.log((follow + ADDED) / (follow.sum(axis=1, keepdims=True) + ADDED * len(follow)))
    own = np.log(follow.sum(axis=0) + ADDED * len(follow))  # the word's share of its class falls with the class
    gain = right @ to.T + left @ (to - own)
    if expected is not None:
        gain[np.arange(len(gain)), expected] += trust
    return gain.argmax(axis=1)


def own_classes(chunks: DataFrame, classes: np.ndarray, follow: np.ndarray, words: range, end: int) -> np.ndarray:
    """Classes of the words with these numbers by their own contexts; ``classes`` has the class of every number."""
    shared, k = chunks.sparkSession.sparkContext.broadcast((classes.astype(np.int64), follow)), CLASSES
    first, last, group = words.start, words.stop, GROUP
    width = group * 2 * k  # of each word the classes before it, then those after it

    def codes_of(here, left):
        for own, beside, way in ((here, left, 0), (left, here, 1)):
            mine = (own >= first) & (own < last)
            yield ((own[mine] - first) * 2 + way) * k + shared.value[0][beside[mine]]

    def choose(total: np.ndarray) -> np.ndarray:
        both = total.reshape(group, 2, k).astype(float)
        return likeliest(both[:, 0], both[:, 1], shared.value[1]).astype(np.int64)

    found = classes[first:last].copy()
    for row in added_up(summed_codes(chunks, codes_of, width, last, end), width, choose).collect():  # a number a word
        at = row["chunk"] * group
        found[at : at + group] = np.frombuffer(row["found"], np.int64)[: len(found) - at]
    return found


def class_bigrams(chunks: DataFrame, classes: np.ndarray, first: int, end: int) -> np.ndarray:
    """follow[c, d]: how often a unit of class d stands right after one of class c."""
    shared = chunks.sparkSession.sparkContext.broadcast(classes.astype(np.int64))
    pairs = lambda arrow: ((shared.value[here], shared.value[left]) for here, left in neighbours(arrow, first, end))
    return counted_pairs(chunks.select(*TRAINING), pairs)


def counted_pairs(rows: DataFrame, pairs_of) -> np.ndarray:
    """follow[c, d] of the arrays of classes, and of the classes before them, that ``pairs_of`` finds."""
    k = CLASSES

    def count(arrow):
        total = np.zeros(k * k, np.int64)
        for here, left in pairs_of(arrow):
            total += np.bincount(left * k + here, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k)), pa.array(total)], ["pair", "n"])

    follow = np.zeros(k * k)
    for row in rows.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        follow[row["pair"]] = row["n"]
    return follow.reshape(k, k)


def _slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: ``data`` cut at ``cuts``."""
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def rare_contexts(chunks: DataFrame, classes: np.ndarray, first: int, end: int) -> DataFrame:
    """word, codes: between which classes a rare word of a chunk stands in training texts, and how often;
    a code is the times, the class before and the class after as one number."""
    shared, k = chunks.sparkSession.sparkContext.broadcast(classes.astype(np.int64)), CLASSES

    def count(arrow):
        for batch, i, numbers, endings in training_numbers(arrow):
            at = np.flatnonzero(numbers >= first)
            if not len(at):
                continue
            of = shared.value[units_of(numbers, endings, first)]
            # a text ends with the end, so a rare word is never last
            left = np.where(at > 0, of[at - 1], shared.value[end])
            keys, n = np.unique(((numbers[at] - first).astype(np.int64) * k + left) * k + of[at + 1], return_counts=True)
            slots = keys // (k * k)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(slots)) + 1))
            cuts = np.concatenate((starts, [len(keys)]))
            words = batch.column("words")[i].values.take(pa.array(slots[starts]))
            yield pa.RecordBatch.from_arrays([words, _slices(n * (k * k) + keys % (k * k), cuts)], ["word", "codes"])

    return chunks.select(*TRAINING, "words").mapInArrow(count, "word binary, codes binary")


def rare_words(chunks: DataFrame, classes: np.ndarray, follow: np.ndarray, first: int, end: int) -> DataFrame:
    """word, n, class of every training word that is not among the first, by its own contexts."""
    shared, k, trust = chunks.sparkSession.sparkContext.broadcast((classes.astype(np.int64), follow)), CLASSES, TRUST_ENDING

    def choose(words: list[bytes], total: np.ndarray):
        units = np.fromiter((first + ending(w) for w in words), np.int64, len(words))
        found = likeliest(total[:, 0], total[:, 1], shared.value[1], shared.value[0][units], trust)
        n = total[:, 0].sum(axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(found.astype(np.int32))], ["word", "n", "class"])

    def meet(arrow):
        last, total = [], np.zeros((1, 2, k))  # of the word that may go on in the next batch
        for batch in arrow:
            column = batch.column("word")
            if not len(column):
                continue
            starts = np.concatenate(([True], pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)))
            sizes = pc.binary_length(batch.column("codes")).to_numpy(zero_copy_only=False) // 8
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int64)
            words = column.filter(pa.array(starts)).to_pylist()
            own = np.repeat(np.cumsum(starts) - 1, sizes) * k
            sums = [np.bincount(own + side, weights=codes // (k * k), minlength=len(words) * k).reshape(-1, k) for side in (codes // k % k, codes % k)]
            sums = np.stack(sums, axis=1)
            if last == words[:1]:
                sums[0] += total[0]
            elif last:
                yield choose(last, total)
            if len(words) > 1:
                yield choose(words[:-1], sums[:-1])
            last, total = words[-1:], sums[-1:].copy()
        if last:
            yield choose(last, total)

    sorted_words = rare_contexts(chunks, classes, first, end).repartition("word").sortWithinPartitions("word")
    return kept(sorted_words.mapInArrow(meet, "word binary, n long, class int"), "rare-words")


def class_arrays(chunks: DataFrame, table: DataFrame, classes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, train, n_tokens, n_known, logs, classes of every text: the class of each token, a byte,
    and the sum of log10(count + ``ADDED``).  ``counts`` are those of the first numbers."""
    shared, first = chunks.sparkSession.sparkContext.broadcast((classes.astype(np.int64), counts.astype(np.int64))), len(counts)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.table({n: pa.array([], t) for n, t in kinds.items()})]
        for i in range(left.num_rows):  # one
            numbers, endings, lengths = chunk_numbers(left, i)
            of, n = shared.value[0][endings], np.zeros(len(endings), np.int64)  # an unknown word's
            slots = right.column("slot").to_numpy()
            of[slots], n[slots] = right.column("class").to_numpy(), right.column("n").to_numpy()
            rare = numbers >= first
            own, times = np.empty(len(numbers), np.uint8), np.empty(len(numbers), np.int64)
            own[rare], times[rare] = of[numbers[rare] - first], n[numbers[rare] - first]
            own[~rare], times[~rare] = shared.value[0][numbers[~rare]], shared.value[1][numbers[~rare]]
            cuts = np.concatenate(([0], np.cumsum(lengths)))
            parts.append(pa.table([
                pa.array(left.column("doc_ids")[i].as_py(), pa.int64()), pa.array(left.column("train")[i].as_py(), pa.bool_()), pa.array(lengths),
                pa.array(np.add.reduceat((times > 0).astype(np.int64), cuts[:-1])),
                pa.array(np.add.reduceat(np.log10(times + ADDED), cuts[:-1])), _slices(own, cuts),
            ], names=list(kinds)))
        return pa.concat_tables(parts)

    kinds = {"doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "classes": pa.binary()}
    slots = chunks.select("chunk", F.posexplode("words").alias("slot", "word"))
    known = slots.join(table, "word").select(F.col("chunk").alias("of"), "slot", "n", "class")
    texts = chunks.select("chunk", "doc_ids", *TRAINING)
    filled = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(
        fill, "doc_id long, train boolean, n_tokens long, n_known long, logs double, classes binary"
    )
    return kept(filled, "class-arrays")


def class_pairs_of(arrow, end: int):
    """Arrays of the classes of whole texts and of the classes before them, and where texts start."""
    for batch in arrow:
        column = batch.column("classes")
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
        here = np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64)
        if len(here):
            yield batch, here, np.concatenate(([end], here[:-1])), np.cumsum(lengths) - lengths


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def class_pairs(classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """follow[c, d]: how often a unit of class d stands right after one of class c."""
    one = np.eye(CLASSES)[classes]
    return one.T @ (pairs @ one)


def likelihood(follow: np.ndarray) -> float:
    """What the classes contribute to the log likelihood of the training tokens."""
    return float(_xlogx(follow).sum() - _xlogx(follow.sum(axis=0)).sum() - _xlogx(follow.sum(axis=1)).sum())


def exchange(classes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """One sweep: each unit, frequent ones first, goes where the class bigrams gain most."""
    k, classes, moved = CLASSES, classes.copy(), 0
    follow, before_of = class_pairs(classes, pairs), np.ascontiguousarray(pairs.T)
    for u in np.argsort(-pairs.sum(axis=1), kind="stable").tolist():
        if not pairs[u].any() and not before_of[u].any():
            continue
        old, twice = int(classes[u]), pairs[u, u]
        right = np.bincount(classes, weights=pairs[u], minlength=k)
        left = np.bincount(classes, weights=before_of[u], minlength=k)
        right[old] -= twice
        left[old] -= twice
        follow[old] -= right
        follow[:, old] -= left
        follow[old, old] -= twice
        # tokens of each class without this unit: its neighbours count wherever it goes
        rows, columns, now = follow.sum(axis=1) + left, follow.sum(axis=0) + right, _xlogx(follow)
        by_row, by_column = _xlogx(follow + right) - now, _xlogx(follow + left[:, None]) - now
        gain = by_row.sum(axis=1) + by_column.sum(axis=0) - np.diagonal(by_row) - np.diagonal(by_column)
        gain += _xlogx(np.diagonal(follow) + right + left + twice) - np.diagonal(now)
        gain -= _xlogx(rows + right.sum() + twice) - _xlogx(rows) + _xlogx(columns + left.sum() + twice) - _xlogx(columns)
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9 * (1 + abs(gain[old])):
            new = old
        moved += new != old
        classes[u] = new
        follow[new] += right
        follow[:, new] += left
        follow[new, new] += twice
    return classes, moved


class Model:
    """Bounded parts of the model: units, classes, transitions and the frequent words' counts."""

    def __init__(self, units: Units, classes: np.ndarray, follow: np.ndarray, tokens: int, words: int,
                 class_words: np.ndarray, counts: np.ndarray):
        self.units, self.classes, self.tokens, self.words, self.counts = units, classes, tokens, words, counts
        class_tokens = follow.sum(axis=0)
        self.room = class_tokens + ADDED * (class_words + 1)
        share = self.room / self.room.sum()
        smooth = (follow + TRUST_CLASSES * share) / (follow.sum(axis=1, keepdims=True) + TRUST_CLASSES)
        self.transition = np.log10(smooth)
        self.base_room = tokens + ADDED * (words + 1)
        self.read: tuple[DataFrame, DataFrame] | None = None  # the texts it learnt from, and their class arrays


def train_model(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of the rarer words' counts and classes."""
    spark = docs.sparkSession
    texts = kept(text_chunks(docs), "texts", **CHUNK_FILES)
    counts = word_counts(texts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    tokens, words = total["tokens"], total["words"]
    short = counts.where(F.length("word") <= LONGEST)
    frequent = short.where(F.col("n") * BROADCAST_SHARE >= tokens).orderBy(F.desc("n"), "word").collect()
    frequent = {bytes(r["word"]): r["n"] for r in frequent}
    frequent.setdefault(END, 0)
    discard(counts)
    common = len(frequent)
    units = Units((w, i) for i, w in enumerate(frequent))
    # numbers of the words that clustering moves one by one, then of the endings
    alone = np.array([n * UNIT_SHARE >= tokens or w == END for w, n in frequent.items()])
    coarse = np.empty(common + ENDINGS, np.int64)
    coarse[:common][alone] = np.arange(alone.sum())
    coarse[common:] = alone.sum() + np.arange(ENDINGS)
    coarse[:common][~alone] = [coarse[units.__missing__(w)] for w, a in zip(frequent, alone) if not a]
    size, end = int(alone.sum()) + ENDINGS, units[END]
    moving = np.arange(size) % CLASSES  # units by falling frequency, dealt round
    chunks = numbered(texts, spark.sparkContext.broadcast(units))
    discard(texts)
    pairs = unit_pairs(chunks, coarse, common, end)
    for _ in range(SWEEPS):
        moving, moved = exchange(moving, pairs)
        if moved <= SETTLED * size:
            break
    classes = moving[coarse]
    follow = class_bigrams(chunks, classes, common, end)
    if not alone.all():  # the rarer of the frequent words come last
        rarer = range(int(np.flatnonzero(~alone)[0]), common)
        for _ in range(REFINED):
            chosen = own_classes(chunks, classes, follow, rarer, end)
            at = np.flatnonzero(~alone[rarer.start :])  # the end has its class already
            classes[rarer.start + at] = chosen[at]
            follow = class_bigrams(chunks, classes, common, end)
    table = rare_words(chunks, classes, follow, common, end)
    n = np.array(list(frequent.values()), np.int64)
    read = class_arrays(chunks, table, classes, n)
    discard(chunks)
    before = int(classes[end])
    follow = counted_pairs(
        read.where("train").select("classes"), lambda arrow: ((here, left) for _, here, left, _ in class_pairs_of(arrow, before))
    )
    class_words = np.bincount(classes[:common][n > 0], minlength=CLASSES).astype(float)
    for row in table.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect():
        class_words[row["class"]] += row["words"]
    every = np.concatenate((classes, np.arange(CLASSES)))
    model = Model(Words(units, table), every, follow, tokens, words, class_words, n)
    model.read = docs, read
    return model, table


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (both log10) of every row of ``docs``;
    ``counts`` is the table that came with the model."""
    spark = docs.sparkSession
    if model.read and model.read[0] is docs:
        read = model.read[1]
    else:
        chunks = numbered(text_chunks(docs), spark.sparkContext.broadcast(Units(model.units)))
        read = class_arrays(chunks, counts, model.classes, model.counts)
        discard(chunks)
    before, base_room = int(model.classes[model.units[END]]), math.log10(model.base_room)
    transition, room = model.transition, np.log10(model.room)

    def score(arrow):
        for batch, here, left, starts in class_pairs_of(arrow, before):
            logs, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("logs", "n_tokens"))
            steps = np.add.reduceat(transition[left, here] - room[here], starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), batch.column("n_known"), pa.array(logs - n * base_room), pa.array(logs + steps)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return read.drop("train").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)
