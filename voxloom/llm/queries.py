"""The contract queries of the training-data operators."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm import (
    bpe, brown_lm, credentials, exact, hnsw, language, mixing, periodic, pii, simhash, spelling, substrings, urls,
)
from voxloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = brown_lm.train_model(docs)
    return brown_lm.score_documents(docs, model, counts).select(
        "doc_id", brown_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(language.FOLDS))
    return found.select(
        "doc_id", F.coalesce(fold == language.HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "draws"
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spelling.variants(spelling.vocabulary(docs, change=spelling.with_typing_errors))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(table(spark, sf_dir, "documents"), periodic.with_periodic_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    length, start, period = best["length"], -best["start"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_brown_lm": op2_brown_lm,
    "op3_bpe": op3_bpe,
    "op4_language": op4_language,
    "op5_urls": op5_urls,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_hnsw": op8_hnsw,
    "op9_exact": op9_exact,
    "op10_mix": op10_mix,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}
ORACLES = {"op9_exact": OP9_SQL}
