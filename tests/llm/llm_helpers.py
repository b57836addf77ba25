"""Tables with the awkward rows that every operator must take."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "x", "ing", "en"]) for _ in range(n))


def rows(n=60, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = sentence(rng, lang, rng.randint(1, 90))
        out.append((i, text, lang, f"src{i % 4}", len(text)))
    base = sentence(rng, "en", 60)
    passage = sentence(rng, "de", 20)
    more = [
        base, base, base.upper(), base + " tail", "start " + base, None, "", "   \t\n ", "12345 !!", None,
        "a" + base, passage + " one two", "three " + passage, passage, "long " * 3000 + base,
        "É" + base, "x" * 5000, "\u4f60\u597d \u2003 \u00a0 \x1c mixed \u00b2", "ends with space ", "it's  we'll\n\n  they'd",
    ]
    for text in more:
        i = len(out)
        out.append((i, text, None if i % 5 == 0 else "en", None if i % 4 == 0 else "src9", len(text or "")))
    out.append(out[-1])  # a repeated row
    out.append((10**12, base, "en", "src1", 1))
    return out


def docs(spark, data=None, parts=5):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(parts)


def clashing(spark):
    """The documents with extra columns whose names the operators might want for themselves."""
    from pyspark.sql import functions as F

    names = ["_key", "_rank", "digest", "fp", "size", "text_key", "row", "block", "_lang", "shared", "win_id", "_nth", "_draw", "_turn"]
    return docs(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return (text or "").encode().split()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
