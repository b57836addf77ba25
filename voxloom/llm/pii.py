"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always stay.  Beyond them, generators propose
overlapping candidates: runs of digits with any usual separators (as card, phone and
address of a machine) and addresses of mail written around the at sign and the dots.
Boosted trees score a candidate by its format and its surroundings; each kind has the
lowest threshold whose precision on held-out candidates reaches ``PRECISION``, or accepts
nothing.  Accepted candidates never overlap a base span or each other; the likelier wins.

The trees are fitted on the candidates of all documents, labelled by the base spans: a candidate that
a base span covers, or that is one once what it spells out (``[at]``, ``[.]``, ``at`` next to ``dot``) is a
sign again, is personal, other candidates are not.  Each base span is also written in
other ways (without the plus, with dots for spaces, with the at sign spelt out) as further positive
examples, and with its structure broken as negative ones.  Documents of a quarter of the hashes are
held out; all their examples are scored, and Spark adds up positives by kind and score, in ``CELLS``
steps of the score.  A kind with fewer than ``LEAST_POSITIVES`` held-out positives, or that reaches
``PRECISION`` nowhere, keeps its base spans alone.  Repeated rows count as often as they stand.

``fit(docs, drawn=True)`` is for a caller who wants a fit of bounded cost: a full scan finds the
documents with a base span, or with a digit and a candidate; drawn are, by smallest hash,
``SAMPLE_DOCS`` of them all and for each kind ``SAMPLE_KIND`` of those with a base span of that kind,
each giving ``PER_KIND`` candidates of a kind; precision weighs every example by how many the draw
leaves out for it.

Offsets count code points, ends are exclusive.  Null texts are empty and have no span;
whole texts are read; repeated rows are judged alike; without anything to learn from only
base spans remain.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import kept, raw, result, text_batches

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
SAMPLE_DOCS, SAMPLE_KIND = 3000, 1000
PER_KIND = 10  # candidates of a kind that a drawn document gives to the fit
BASE_PER_KIND = 4  # base spans of a kind that it gives in other spellings
ANY = 1 << len(KINDS)  # the bit of documents drawn from all
PRECISION = 0.98
CELLS = 4096  # steps of the score that thresholds are sought in
ROWS = 5000  # examples that travel as one batch
LEAST_POSITIVES = 20
TREES, DEPTH = 12, 4
AROUND = 24

# The runs before a fixed character are found from that character; a look-behind keeps a
# long run of digits from being tried at each of its places.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

NUMBER_LIKE = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,24}(?![0-9])")
ADDRESS_LIKE = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.|,) ?[0-9]{1,3}){3}(?![0-9])")
SPELT_AT = re.compile(r"[\[({]at[\])}]| at ", re.I)  # one of these, or @, is in every SPELT_MAIL
SPELT_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:[\[({]at[\])}]|@| at ) ?[A-Za-z0-9-]{1,64}"
    r"(?: ?(?:[\[({]dot[\])}]|\.| dot ) ?[A-Za-z0-9-]{1,64}){1,6}", re.I,
)
BRACKETS = re.compile(r" ?[\[({](at|@|dot|\.)[\])}] ?", re.I)
SIGN_WORDS = re.compile(r" (at|dot) ", re.I)
HINTS = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|iban|account", re.I), "phone": re.compile(r"tel|phone|call|fax|mobile", re.I),
}
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain: each at sign decides by the run before it."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            spans.append((start, end, "email"))
        at = text.find("@", at + 1)
    return spans


def base_spans(text: str) -> list[Span]:
    spans = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping and more than are personal."""
    found: list[Span] = []
    if DIGIT.search(text):
        for m in NUMBER_LIKE.finditer(text):
            found += [(m.start(), m.end(), "card"), (m.start(), m.end(), "phone")]
        found += [(m.start(), m.end(), "ip") for m in ADDRESS_LIKE.finditer(text)]
    if "@" in text or SPELT_AT.search(text):
        found += [(m.start(), m.end(), "email") for m in SPELT_MAIL.finditer(text)]
    return found


FEATURES = 24


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    start, end, kind = span
    own, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = NOT_DIGITS.sub("", own)
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    parts = [int(g[:6]) for g in re.findall("[0-9]+", own)] or [0]
    return [
        *(float(kind == k) for k in KINDS), float(len(own)), float(len(digits)), float(len(groups)),
        float(max(groups)), float(min(groups)), float(max(parts)), float(luhn(digits)) if digits else 0.0,
        float(own.startswith("+")), float("(" in own), float(own.count(" ")), float(own.count("-")),
        float(own.count(".")), float("@" in own), float(bool(re.search(r"[\[({]", own))),
        float(sum(c.isalpha() for c in own)), float(bool(re.search(r"\W(?:at|dot)\W", own, re.I))),
        float(bool(HINTS[kind].search(left))), float(left[-1:].isalnum()), float(right[:1].isalnum()),
        float(sum(c.isdigit() for c in left + right)),
    ]


def _rewritten(own: str, kind: str) -> list[tuple[str, int]]:
    """Other ways to write a personal span (label 1) and near misses (label 0)."""
    if kind == "email":
        local, _, domain = own.partition("@")
        plain = [re.sub("[0-9]", "", x).strip(".") or "x" for x in (local, domain)]
        return [
            (f"{plain[0]}@{plain[1]}", 1), (f"{plain[0]} at {plain[1].replace('.', ' dot ')}", 1),
            (f"{plain[0]} [at] {plain[1].replace('.', ' [dot] ')}", 1), (f"{plain[0]} at {plain[1].split('.')[0]}.", 0),
            (f"{local} at {domain.replace('.', ' dot ')}", 1), (f"{local} [at] {domain.replace('.', ' [dot] ')}", 1),
            (f"{local} [at] {domain}", 1), (f"{plain[0]} [at] {plain[1]}", 1), (f"{plain[0]}(at){plain[1]}", 1),
            (f"{local}(at){domain.replace('.', '(dot)')}", 1), (f"{domain.split('.')[0]} at the. end", 0),
        ]
    if kind == "ip":
        return [(own.replace(".", "[.]"), 1), (own.replace(".", "(.)"), 1), (re.sub(r"[0-9]+\.", "999.", own, count=1), 0)]
    if kind == "phone":
        bare = own.lstrip("+")
        return [(bare.replace(" ", "-"), 1), (bare.replace(" ", "."), 1), (NOT_DIGITS.sub("", own)[:7], 0)]
    digits = NOT_DIGITS.sub("", own)
    spaced = " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    return [(spaced.replace(" ", "."), 1), (spaced.replace(" ", "/"), 1), (wrong, 0)]


def _spelt_out(own: str, kind: str) -> bool:
    """Whether a span is a whole base span but for spelling out its at sign and dots.  Without a
    ``dot`` the word ``at`` is no sign: "look at example.com" names no address of mail."""
    sign = lambda m: "@" if m[1].lower() in ("at", "@") else "."
    plain = BRACKETS.sub(sign, own)
    if " dot " in own.lower():
        plain = SIGN_WORDS.sub(sign, plain)
    return plain != own and (0, len(plain), kind) in base_spans(plain)


def _some(text: str, spans: list[Span], kind: str, most: int | None) -> tuple[list[Span], float]:
    """At most ``most`` spans of the kind, by hash, and how many each stands for; all without ``most``."""
    mine = [s for s in spans if s[2] == kind]
    if most is None:
        return mine, 1.0
    taken = sorted(mine, key=lambda s: xxhash.xxh64_intdigest(f"{s[0]}:{text[s[0]:s[1]]}"))[:most]
    return taken, len(mine) / max(len(taken), 1)


def examples(
    text: str, per_kind: int | None = PER_KIND, base_per_kind: int | None = BASE_PER_KIND,
) -> Iterator[tuple[list[float], int, str, float]]:
    """Features, label, kind and weight of what a document gives to the fit."""
    base, proposed = base_spans(text), candidates(text)
    for kind in KINDS:
        own = [b for b in base if b[2] == kind]  # one after another, so each question is for one of them
        starts = [b[0] for b in own]
        taken, weight = _some(text, proposed, kind, per_kind)
        for c in taken:
            inside, before = bisect_right(starts, c[0] + 1) - 1, bisect_left(starts, c[1]) - 1
            covered = inside >= 0 and c[1] - 1 <= own[inside][1]
            if covered or before < 0 or c[0] >= own[before][1]:
                yield features(text, c), int(covered or _spelt_out(text[c[0] : c[1]], kind)), kind, weight
        taken, weight = _some(text, base, kind, base_per_kind)
        for start, end, _ in taken:
            left, right = text[max(0, start - 2 * AROUND) : start], text[end : end + 2 * AROUND]
            for written, label in _rewritten(text[start:end], kind):
                place = (len(left), len(left) + len(written), kind)
                yield features(left + written + right, place), label, kind, weight


def kinds_of(docs: DataFrame) -> DataFrame:
    """a, b (hashes of id and text), kinds (bits of the base spans' kinds) of every distinct
    document that has a base span, or a digit and a candidate."""

    def scan(arrow):
        for batch, texts in text_batches(arrow):
            masks = []
            for text in (t.decode("utf-8", "replace") for t in texts):
                mask = sum({1 << ORDER[s[2]] for s in base_spans(text)})
                masks.append(mask if mask or DIGIT.search(text) and candidates(text) else None)
            rows = np.flatnonzero([m is not None for m in masks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(rows), batch.column("b").take(rows), pa.array([masks[i] for i in rows], pa.int32())],
                ["a", "b", "kinds"],
            )

    rows = docs.select(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"), raw("text").alias("text"))
    return kept(rows.mapInArrow(scan, "a long, b long, kinds int").distinct(), "document-kinds")


def draw(found: DataFrame) -> tuple[DataFrame, dict[tuple[str, bool], float]]:
    """a, b, kinds, drawn (bits of the kinds, or ``ANY``, that a document was drawn for), and by
    kind how many documents with (True) and without (False) its base spans each drawn one stands for."""
    parts = [found.orderBy("a", "b").limit(SAMPLE_DOCS).withColumn("bit", F.lit(ANY))]
    for i in range(len(KINDS)):
        own = found.where(F.col("kinds").bitwiseAND(1 << i) != 0)
        parts.append(own.orderBy("a", "b").limit(SAMPLE_KIND).withColumn("bit", F.lit(1 << i)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    chosen = kept(every.groupBy("a", "b", "kinds").agg(F.bit_or("bit").alias("drawn")), "drawn-documents")
    has = [F.col("kinds").bitwiseAND(1 << i) != 0 for i in range(len(KINDS))]
    asked = [F.col("drawn").bitwiseAND(ANY | 1 << i) != 0 for i in range(len(KINDS))]
    whole = found.agg(F.count(F.lit(1)), *[F.count_if(h) for h in has]).first()
    with_kind = chosen.agg(*[F.count_if(h & q) for h, q in zip(has, asked)]).first()
    without = chosen.agg(*[F.count_if(~h & (F.col("drawn").bitwiseAND(ANY) != 0)) for h in has]).first()
    stands = {}
    for i, kind in enumerate(KINDS):
        stands[kind, True] = whole[i + 1] / max(with_kind[i], 1)
        stands[kind, False] = (whole[0] - whole[i + 1]) / max(without[i], 1)
    return chosen, stands


class Trees:
    """A boosted ensemble as arrays: feature, threshold, children and value of every node."""

    def __init__(self, model):
        self.weights, self.trees = list(model.treeWeights), []
        for tree in model.trees:
            rows: list[list[float]] = []
            self._walk(tree._java_obj.rootNode(), rows)
            self.trees.append(np.array(rows))

    def _walk(self, node, rows) -> int:
        at = len(rows)
        rows.append([-1.0, 0.0, at, at, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][0], rows[at][1] = float(split.featureIndex()), float(split.threshold())
            rows[at][2] = self._walk(node.leftChild(), rows)
            rows[at][3] = self._walk(node.rightChild(), rows)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, tree in zip(self.weights, self.trees):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = tree[at]
                right = (node[:, 0] >= 0) & (x[np.arange(len(x)), node[:, 0].astype(int)] > node[:, 1])
                at = np.where(node[:, 0] < 0, at, np.where(right, node[:, 3], node[:, 2])).astype(int)
            total += weight * tree[at, 4]
        return 1 / (1 + np.exp(-2 * total))


def example_table(docs: DataFrame, drawn: bool = False) -> DataFrame:
    """x (features), label, kind, fold and weight of the examples of all documents, or of drawn ones."""
    fold = F.pmod(F.xxhash64("text"), F.lit(4)).cast("int").alias("fold")
    most, stands = (None, None), {(k, has): 1.0 for k in KINDS for has in (True, False)}
    source = docs.select(fold, F.lit(0).alias("kinds"), F.lit(ANY).alias("drawn"), raw("text").alias("text"))
    if drawn:
        chosen, stands = draw(kinds_of(docs))
        most, place = (PER_KIND, BASE_PER_KIND), (F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"))
        # the draw is made on keys alone, texts are read again for the chosen
        source = docs.select(*place, "text").join(F.broadcast(chosen), ["a", "b"]).dropDuplicates(["a", "b"])
        source = source.select(fold, "kinds", "drawn", raw("text").alias("text"))

    def packed(rows):
        columns = list(zip(*rows)) or [(), (), (), (), ()]
        kinds = (pa.list_(pa.float64()), pa.float64(), pa.string(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["x", "label", "kind", "fold", "weight"]
        )

    def label(arrow):
        rows = []
        for batch, texts in text_batches(arrow):
            for text, f, has, bits in zip(texts, *[batch.column(c).to_pylist() for c in ("fold", "kinds", "drawn")]):
                for x, y, k, w in examples(text.decode("utf-8", "replace"), *most):
                    bit = 1 << ORDER[k]
                    if bits & (ANY | bit):
                        rows.append((x, y, k, f, w * stands[k, bool(has & bit)]))
                    if len(rows) == ROWS:
                        yield packed(rows)
                        rows = []
        yield packed(rows)

    return kept(
        source.mapInArrow(label, "x array<double>, label double, kind string, fold int, weight double"), "examples"
    )


def precision_by_score(rest: DataFrame, trees: Trees) -> DataFrame:
    """kind, cell (step of the score), least (score in it), positives, weight and right (that of positives)."""
    shared = rest.sparkSession.sparkContext.broadcast(trees)

    def score(arrow):
        for batch in arrow:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield result(batch, ["kind", "label", "weight"], score=pa.array(shared.value.probability(x)))

    scored = rest.select("x", "kind", "label", "weight").mapInArrow(score, "kind string, label double, weight double, score double")
    return scored.groupBy("kind", F.floor(F.col("score") * CELLS).alias("cell")).agg(
        F.min("score").alias("least"), F.sum("label").alias("positives"), F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * F.col("label")).alias("right"),
    )


def fit(docs: DataFrame, drawn: bool = False) -> tuple[Trees, dict[str, float]] | None:
    """Trees and thresholds by kind; None when the examples lack either class."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    table = example_table(docs, drawn)
    fitting = table.where("fold <> 0").select(array_to_vector("x").alias("features"), "label")
    if fitting.select("label").distinct().count() < 2:
        return None
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=6, cacheNodeIds=False)
    trees = Trees(gbt.fit(fitting))
    cells = precision_by_score(table.where("fold = 0"), trees).collect()  # kinds x CELLS rows at most
    thresholds = {}
    for kind in KINDS:
        mine = sorted((r for r in cells if r["kind"] == kind), key=lambda r: -r["cell"])
        if sum(r["positives"] for r in mine) < LEAST_POSITIVES:
            continue
        right = np.cumsum([r["right"] for r in mine])
        precise = np.flatnonzero(right >= PRECISION * np.cumsum([r["weight"] for r in mine]))
        if len(precise):
            thresholds[kind] = float(max(mine[precise[-1]]["least"], 0.5))
    return trees, thresholds


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _accepted(text: str, base: list[Span], model) -> list[Span]:
    if not model:
        return []
    trees, thresholds = model
    open_spans = [
        c for c in candidates(text)
        if c[2] in thresholds and not any(b[0] < c[1] and c[0] < b[1] for b in base)
    ]
    if not open_spans:
        return []
    scores = trees.probability(np.array([features(text, c) for c in open_spans]))
    taken: list[Span] = []
    for score, c in sorted(zip(scores.tolist(), open_spans), key=lambda p: (-p[0], p[1])):
        if score >= thresholds[c[2]] and not any(t[0] < c[1] and c[0] < t[1] for t in taken):
            taken.append(c)
    return taken


def find_personal(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def find(arrow):
        for batch, texts in text_batches(arrow):
            bases, all_spans = [], []
            for text in (t.decode("utf-8", "replace") for t in texts):
                base = base_spans(text)
                more = _accepted(text, base, shared.value)
                bases.append(base)
                all_spans.append(sorted(base + more, key=lambda s: (s[0], ORDER[s[2]])) if more else base)
            counts = {
                f"n_{k}": pa.array([sum(s[2] == k for s in b) for b in bases], pa.int64()) for k in KINDS
            }
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in bases]
            yield result(
                batch, ["doc_id"], **counts, base_sha256=pa.array(digests, pa.string()),
                spans=pa.array([written(s) for s in all_spans], pa.string()),
            )

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])
