"""Language ID by a string kernel: Nyström features and one-versus-rest kernel ridge.

The kernel of two texts is the cosine of their presence sets of character n-grams, n from 1
to ``ORDERS`` (a blended spectrum), over the n-grams that some landmark holds.  Landmarks
are a bounded sample of labelled texts, ``LANDMARKS`` per language.  A text's kernel values
against all landmarks come from one product of its presence row with the landmarks'
presence matrix; the inverse root of the landmarks' own kernel turns them into Nyström
features, on which ridge regression is solved in closed form, one column per language.

The classifier is fitted on at most ``SAMPLE`` labelled rows per language, those with the
smallest hashed ids, for at most ``MAX_LANGUAGES`` languages.  Every text is predicted
whole.  Null texts and texts without a letter get ``und`` with score 0; so does every text
when nothing could be learned.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voxloom.llm.common import free_name, kept, raw, result, text_batches

ORDERS = 3
LANDMARKS = 24
SAMPLE = 400
MAX_LANGUAGES = 500
RIDGE = 1e-3
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
CHUNK = 64  # texts whose presence rows stand in memory at once
TABLE_CELLS = 1 << 24  # a trie layer of up to so many cells is looked up in a table


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


class Spectrum:
    """Trie of the landmarks' n-grams: layer n maps (number of the first n - 1 characters,
    last character) to an n-gram number.  Characters no landmark has match nothing."""

    def __init__(self, texts: list[str]):
        codes = [code_points(t) for t in texts]
        self.alphabet = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint32)
        self.size, self.layers, self.first = len(self.alphabet) + 1, [], [0]
        marks = [self._letters(c) for c in codes]
        runs = marks
        for order in range(1, ORDERS + 1):
            keys = [self._keys(r, m, order) for r, m in zip(runs, marks)]
            known = np.unique(np.concatenate([k[k >= 0] for k in keys])) if keys else np.zeros(0, np.int64)
            self.layers.append(self._layer(known))
            runs = [self._number(k, order) for k in keys]
            self.first.append(self.first[-1] + len(known))
        self.width = self.first[-1]

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """1 for the first character of the alphabet and so on; 0 for characters outside it."""
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.searchsorted(self.alphabet, codes).clip(max=len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int64)

    def _keys(self, runs: np.ndarray, letters: np.ndarray, order: int) -> np.ndarray:
        """Keys of the n-grams that start at each place, -1 where there is none."""
        if order == 1:
            return np.where(letters > 0, letters, -1)
        head, last = runs[: len(letters) - order + 1], letters[order - 1 :]
        if len(letters) < order:
            return np.zeros(0, np.int64)
        return np.where((head >= 0) & (last > 0), head * self.size + last, -1)

    def _layer(self, known: np.ndarray):
        cells = int(known[-1]) + 1 if len(known) else 0
        if cells > TABLE_CELLS:
            return known, None
        lookup = np.full(cells, -1, np.int64)
        lookup[known] = np.arange(len(known))
        return known, lookup

    def _number(self, keys: np.ndarray, order: int) -> np.ndarray:
        known, lookup = self.layers[order - 1]
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        if lookup is not None:
            inside = (keys >= 0) & (keys < len(lookup))
            return np.where(inside, lookup[np.where(inside, keys, 0)], -1)
        at = np.searchsorted(known, keys).clip(max=len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row per text, scaled to length 1; a text that shares nothing gives zeros."""
        rows = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(rows, texts):
            letters = self._letters(code_points(text))
            runs = letters
            for order in range(1, ORDERS + 1):
                runs = self._number(self._keys(runs, letters, order), order)
                row[self.first[order - 1] + runs[runs >= 0]] = 1
        norms = np.sqrt(rows.sum(axis=1, dtype=np.float64))
        return rows / np.maximum(norms, 1)[:, None].astype(np.float32)


class Features:
    def __init__(self, landmarks: list[str]):
        self.spectrum = Spectrum(landmarks)
        self.marks = self.spectrum.presence(landmarks)
        kernel = self.marks.astype(np.float64) @ self.marks.T.astype(np.float64)
        values, vectors = np.linalg.eigh(kernel)
        good = values > 1e-6
        self.root = vectors[:, good] / np.sqrt(values[good])

    def of(self, texts: list[str]) -> np.ndarray:
        parts = [self.spectrum.presence(texts[i : i + CHUNK]) @ self.marks.T for i in range(0, len(texts), CHUNK)]
        kernel = np.concatenate(parts) if parts else np.zeros((0, len(self.marks)))
        return np.hstack([kernel.astype(np.float64) @ self.root, np.ones((len(texts), 1))])


def _chosen(docs: DataFrame) -> DataFrame:
    """The bounded sample: text, lang and its place among the language's rows by hashed id."""
    folded = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(folded != HELD_OUT, F.lit(False))
        & F.col("text").rlike(r"\p{L}")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    names = usable.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1)
    if names.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    numbered = usable.select("doc_id", F.xxhash64("text").alias("key"), "lang").distinct().withColumn(
        "n", F.row_number().over(order)
    ).where(F.col("n") <= SAMPLE)
    # a small side with a proven bound: SAMPLE rows per language
    picked = usable.withColumn("key", F.xxhash64("text")).join(F.broadcast(numbered), ["doc_id", "key", "lang"])
    picked = picked.dropDuplicates(["doc_id", "key", "lang"])  # repeated rows count once
    return kept(picked.select("text", "lang", "n"), "language-sample")


def fit(docs: DataFrame) -> tuple[list[str], Features, np.ndarray] | None:
    """Languages, Nyström features and the ridge weights; None if nothing is labelled."""
    sample = _chosen(docs)
    marks = sample.where(F.col("n") <= LANDMARKS).select("text").orderBy("lang", "n", "text").collect()
    languages = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    features = Features([r["text"] for r in marks])
    shared = docs.sparkSession.sparkContext.broadcast(features)
    place = {name: i for i, name in enumerate(languages)}
    wide = features.root.shape[1] + 1

    def sums(arrow):
        gram, right = np.zeros((wide, wide)), np.zeros((wide, len(languages)))
        for batch, texts in text_batches(arrow):
            x = shared.value.of([t.decode("utf-8", "replace") for t in texts])
            y = np.zeros((len(texts), len(languages)))
            y[np.arange(len(texts)), [place[v] for v in batch.column("lang").to_pylist()]] = 1
            gram += x.T @ x
            right += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    parts = sample.select(raw("text").alias("text"), "lang").mapInArrow(sums, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(wide, wide) for r in parts)
    right = sum(np.frombuffer(r["right"]).reshape(wide, -1) for r in parts)
    count = max(gram[-1, -1], 1.0)
    return languages, features, np.linalg.solve(gram + RIDGE * count * np.eye(wide), right)


def predictions(docs: DataFrame, text: str, columns: list[str], model) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred and score for the text column."""
    spark = docs.sparkSession
    schema = [f for c in columns for f in docs.select(c).schema]
    out = StructType([*schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def predict(arrow):
        for batch, texts in text_batches(arrow):
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            strings = [t.decode("utf-8", "replace") for t in texts]
            some = [i for i, t in enumerate(strings) if has_letter(t)]
            if shared.value and some:
                languages, features, weights = shared.value
                values = features.of([strings[i] for i in some]) @ weights
                for i, best, value in zip(some, values.argmax(axis=1), values.max(axis=1)):
                    found[i], scores[i] = languages[best], min(max(float(value), 0.0), 1.0)
            yield result(
                batch, columns, lang_pred=pa.array(found, pa.string()), score=pa.array(scores, pa.float64())
            )

    # columns other than the text are carried along, never looked at
    return docs.select(*columns, raw(text).alias("text")).mapInArrow(predict, out)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    return predictions(docs, "text", ["doc_id"], fit(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language was recognised; a missing ``lang`` is filled in.

    Without a usable label there is no model: every text with a letter stays as it is.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("string")
    def language(texts: pa.Array) -> pa.Array:
        found = []
        for start in range(0, len(texts), CHUNK):  # never a whole batch as Python strings
            strings = [t.decode("utf-8", "replace") for t in texts.slice(start, CHUNK).to_pylist()]
            some = [i for i, t in enumerate(strings) if has_letter(t)]
            names = [UNKNOWN] * len(strings)
            if not model.value:
                for i in some:
                    names[i] = None
            elif some:
                known, features, weights = model.value
                best = (features.of([strings[i] for i in some]) @ weights).argmax(axis=1)
                for i, b in zip(some, best):
                    names[i] = known[b]
            found += names
        return pa.array(found, pa.string())

    guess = free_name(docs, "_lang")
    # called nondeterministic, or the filter would get a second evaluation with workers of its own
    return (
        docs.withColumn(guess, language.asNondeterministic()(raw("text"))).where(~F.col(guess).eqNullSafe(UNKNOWN))
        .withColumn("lang", F.coalesce(F.col("lang"), F.col(guess))).drop(guess)
    )
