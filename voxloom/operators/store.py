"""Embedding store: content-addressed, contract-bound, resumable."""

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxloom.functions.vectors import is_finite_vector, l2_normalize
from voxloom.scratch import spread


def contract_hash(columns: Sequence[str]) -> Column:
    """sha256 of the settings as JSON with sorted keys, nulls kept, no spaces."""
    struct = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)


def settings_hash(spark: SparkSession, settings: Mapping[str, object]) -> str:
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()])
    return row.select(contract_hash(list(settings))).first()[0]


def contract_check(stored: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields in which a stored run and the current data disagree (NULL equals NULL).

    A run without current data fails with ``missing_data``, data without a run with
    ``missing_run``.
    """
    s = stored.select(key, F.lit(True).alias("_s"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    c = current.select(key, F.lit(True).alias("_c"), *[F.col(f).alias(f"_c_{f}") for f in fields])
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"_s_{f}").eqNullSafe(F.col(f"_c_{f}")), f) for f in fields])
    )
    failing = (
        F.when(F.col("_c").isNull(), F.array(F.lit("missing_data")))
        .when(F.col("_s").isNull(), F.array(F.lit("missing_run"))).otherwise(differing)
    )
    return s.join(c, key, "full").select(
        key, F.array_join(failing, ",").alias("failing_fields"), (F.size(failing) == 0).alias("compatible")
    )


def unique_payloads(inputs: DataFrame, payload: str) -> DataFrame:
    """One row per distinct content: ``key_hash`` and the payload.

    Only digests meet in the aggregation buffer's key; equal digests carry equal text.
    """
    return inputs.select(F.sha2(payload, 256).alias("key_hash"), payload).dropDuplicates(["key_hash"])


def valid_entries(store: DataFrame, contract: str, dim: int) -> DataFrame:
    """Hashes already stored under this contract with a finite vector of the right size.

    Rows written by :func:`materialize_embeddings` carry the size of their checked vector,
    so asking for them reads no vector; only rows without it are looked into.
    """
    mine = store.where(F.col("contract_sha256") == contract)
    looked_into = is_finite_vector(F.col("embedding"), dim)
    if "vector_dim" not in store.columns:
        return mine.where(looked_into).select("key_hash").distinct()
    recorded = mine.where(F.col("vector_dim") == dim).select("key_hash")
    other = mine.where(F.col("vector_dim").isNull()).where(looked_into).select("key_hash")
    return recorded.unionByName(other).distinct()


def resume_pending(unique: DataFrame, store: DataFrame, contract: str, dim: int) -> DataFrame:
    """What still has to be encoded."""
    return unique.join(valid_entries(store, contract, dim), "key_hash", "left_anti")


def content_hash_join(inputs: DataFrame, payload: str, store: DataFrame) -> DataFrame:
    """Every input with the one vector stored for its content."""
    return inputs.withColumn("key_hash", F.sha2(payload, 256)).join(store, "key_hash", "left")


def cache_index(
    inputs: DataFrame, payload: str, store: DataFrame, sample_id: str = "sample_id", dim: int | None = None,
) -> DataFrame:
    """One index row per input sample; an input without a valid stored vector fails the job.

    An invalid vector that a later run replaced stays in the store but is never read: only
    finite vectors count, of the wanted dimension where one is given, one per content.
    """
    valid = store.where(is_finite_vector(F.col("embedding"), dim)).groupBy("key_hash").agg(
        F.max(F.size("embedding")).alias("embedding_dimension")
    )
    joined = content_hash_join(inputs.select(sample_id, payload), payload, valid)
    missing = F.raise_error(F.concat(F.lit("no stored vector for "), F.col(sample_id).cast("string")))
    return joined.select(
        sample_id, "key_hash",
        F.when(F.col("embedding_dimension").isNotNull(), F.col("embedding_dimension"))
        .otherwise(missing.cast("int")).alias("embedding_dimension"),
    )


def dedup_savings(inputs: DataFrame, payload: str, store: DataFrame, contract: str, dim: int) -> DataFrame:
    """Run counters: selected, unique, already stored, to process, encoder calls saved."""
    counts = inputs.groupBy(F.sha2(payload, 256).alias("key_hash")).agg(F.count(F.lit(1)).alias("n"))
    done = valid_entries(store, contract, dim).withColumn("_done", F.lit(True))
    unique = F.count(F.lit(1))
    skipped = F.count_if("_done")
    return counts.join(done, "key_hash", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("selected"), unique.alias("unique_payloads"),
        skipped.alias("skipped"), (unique - skipped).alias("processed"),
        (F.coalesce(F.sum("n"), F.lit(0)) - unique).alias("calls_saved"),
    )


def dimension_check(df: DataFrame, vector: str, expected: int) -> DataFrame:
    """Rows per vector size and whether it is the expected one."""
    return df.groupBy(F.size(vector).alias("dimension")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "expected", F.col("dimension") == expected
    )


def validate_embeddings(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Adds ``status``: ok, wrong_dimension, non_finite or missing."""
    v = F.col(vector)
    status = (
        F.when(v.isNull(), "missing").when(F.size(v) != dim, "wrong_dimension")
        .when(~is_finite_vector(v, dim), "non_finite").otherwise("ok")
    )
    return df.withColumn("status", status)


def hashing_encoder(dim: int) -> Callable[[DataFrame], DataFrame]:
    """Default encoder: L2-normalised feature hashing of whitespace tokens, inside the JVM."""

    def encode(pending: DataFrame, payload: str) -> DataFrame:
        tokens = F.split(F.trim(F.lower(payload)), r"\s+")
        counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(
            pending.withColumn("_tokens", tokens)
        )
        vector = l2_normalize(vector_to_array("_tf")).cast("array<float>")
        return counted.select("key_hash", vector.alias("embedding"))

    return encode


def pandas_encoder(fn: Callable[[pd.Series], Sequence[Sequence[float]]]) -> Callable:
    """Encoder from a function over one batch of payloads (a model, a decoder plus a model)."""
    schema = T.StructType(
        [T.StructField("key_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def encode(pending: DataFrame, payload: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vectors = [list(map(float, v)) for v in fn(batch[payload])]
                yield pd.DataFrame({"key_hash": batch["key_hash"], "embedding": vectors})

        return spread(pending.select("key_hash", payload)).mapInPandas(run, schema)

    return encode


STORE_SCHEMA = T.StructType(
    [
        T.StructField("key_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("vector_dim", T.IntegerType()),
        T.StructField("modality", T.StringType()),
        T.StructField("contract_sha256", T.StringType()),
    ]
)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store; the contract is a partition column, so a contract filter prunes folders."""
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def ensure_store(spark: SparkSession, path: str) -> None:
    """Appending no rows creates the store folder when nothing has been written yet."""
    empty = spark.createDataFrame([], STORE_SCHEMA)
    empty.write.mode("append").partitionBy("modality", "contract_sha256").parquet(path)


def materialize_embeddings(
    inputs: DataFrame, payload: str, path: str, contract: str, dim: int, modality: str = "text",
    encoder: Callable | None = None,
) -> dict[str, int]:
    """Encode each distinct payload once and append it under its contract.

    A second run over the same inputs encodes nothing.  Wrong sizes and non-finite values
    fail the job before anything is committed.  Returns the run's counters.
    """
    spark = inputs.sparkSession
    ensure_store(spark, path)
    encode = encoder or hashing_encoder(dim)
    store = read_store(spark, path).where(F.col("modality") == modality)
    counters = dedup_savings(inputs, payload, store, contract, dim).first().asDict()
    if counters["processed"]:
        pending = resume_pending(unique_payloads(inputs, payload), store, contract, dim)
        encoded = encode(pending, payload)
        vector = F.when(is_finite_vector(F.col("embedding"), dim), F.col("embedding")).otherwise(
            F.raise_error("the encoder returned an invalid vector").cast("array<float>")
        )
        encoded.select(
            "key_hash", vector.alias("embedding"), F.lit(dim).alias("vector_dim"), F.lit(modality).alias("modality"),
            F.lit(contract).alias("contract_sha256"),
        ).write.mode("append").partitionBy("modality", "contract_sha256").parquet(path)
    return counters
