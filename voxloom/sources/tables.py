"""Dimension files, key lists, annotation trees, index files and embedding tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxloom.schemas import ANNOTATION, EMBEDDING_INDEX


def read_dimension(spark: SparkSession, path: str, key: str, attribute: str, columns: list[str]) -> DataFrame:
    """CSV dimension: trimmed, blank attribute = unknown, empty key = error, last row wins."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, encoding="UTF-8").select(
        F.trim(key).alias(key), F.coalesce(F.nullif(F.trim(attribute), F.lit("")), F.lit("unknown")).alias(attribute),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("_at"),
    )
    present = F.coalesce(F.col(key) != "", F.lit(False))
    checked = rows.withColumn(
        key, F.when(present, F.col(key)).otherwise(F.raise_error(f"empty {key} in the dimension"))
    )
    return checked.groupBy(key).agg(F.max_by(attribute, "_at").alias(attribute))


def key_list(rows: DataFrame, column: str) -> DataFrame:
    """Distinct, non-empty keys in upper case."""
    return rows.select(F.upper(F.trim(column)).alias("key")).where("key <> ''").distinct()


def read_key_list(spark: SparkSession, path: str, column: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return key_list(spark.read.csv(path, schema=schema, header=True, encoding="UTF-8"), column)


def read_annotations(
    spark: SparkSession, root: str, schema: T.StructType = ANNOTATION, one_document_per_file: bool = True,
) -> DataFrame:
    """Nested JSON below a folder, with each document's path relative to the root."""
    docs = (
        spark.read.schema(schema).option("recursiveFileLookup", True)
        .option("multiLine", one_document_per_file).option("pathGlobFilter", "*.json").json(root)
    )
    return docs.select("*", relative_path(F.url_decode(F.replace(
        F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")
    )), root_path(spark, root)).alias("relative_path"))


def root_path(spark: SparkSession, root: str) -> str:
    """The root's absolute path without scheme and authority."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return full.toUri().getPath().rstrip("/")


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``: the root's own length is cut off, whatever it contains."""
    local = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(local, F.lit(len(root) + 2), F.length(local))


CONTRACT = (
    "schema_version int, modality string, model_identifier string, resolved_revision string, cache_dtype string, "
    "embedding_dimension int, expected_embedding_dimension int, manifest_sha256 string, frames_per_clip int, "
    "stores_frame_embeddings boolean"
)


def read_contracts(spark: SparkSession, paths: str | list[str], one_document_per_file: bool = True) -> DataFrame:
    """Settings documents: one per file, or one per line of files that hold many."""
    return spark.read.schema(CONTRACT).option("multiLine", one_document_per_file).json(paths)


def contract_problems(
    contracts: DataFrame, modality: str, dim: int, manifest_sha256: str, summary_sha256: str | None = None,
    tensor_key: str = "embedding",
) -> DataFrame:
    """Adds ``problems``: why a contract does not fit the modality, dimension or manifest.

    A contract without a manifest hash takes the one of its run summary.
    """
    if tensor_key not in ("embedding", "frame_embeddings"):
        raise ValueError(f"unsupported tensor_key: {tensor_key}")
    declared = F.coalesce("embedding_dimension", "expected_embedding_dimension")
    source = F.coalesce(F.col("manifest_sha256"), F.lit(summary_sha256))
    frames = tensor_key == "frame_embeddings"
    problems = F.array(
        F.when(~F.col("modality").eqNullSafe(modality), "modality"),
        F.when(~F.col("cache_dtype").eqNullSafe("float32"), "cache_dtype"),
        F.when(
            F.lit(frames) & ~(F.lit(modality == "visual") & F.coalesce("stores_frame_embeddings", F.lit(False))),
            "tensor_key",
        ),
        F.when(declared.isNotNull() & (declared != dim), "dimension"),
        F.when(~source.eqNullSafe(manifest_sha256), "manifest"),
        F.when(F.lit(modality == "visual") & ~F.coalesce(F.col("frames_per_clip") > 0, F.lit(False)), "frames_per_clip"),
    )
    return contracts.withColumn("problems", F.array_compact(problems))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_INDEX).json(path)


def index_status(index: DataFrame) -> DataFrame:
    """Index rows with ``status``: ok, duplicate, missing_path or missing_id."""
    repeated = (
        index.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sample_id", "_n")
    )
    status = (
        F.when(F.col("sample_id").isNull(), "missing_id").when(F.col("_n").isNotNull(), "duplicate")
        .when(F.col("cache_path").isNull(), "missing_path").otherwise("ok")
    )
    return index.join(repeated, "sample_id", "left").withColumn("status", status).drop("_n")


def read_metric_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One metrics record per file; the file name identifies the run."""
    schema = (
        "protocol string, training_mode string, synthetic boolean, paper_ready boolean, uar double, "
        "macro_f1 double, accuracy double, few_shot map<string,map<string,struct<mean:double,std:double,"
        "ci95_low:double,ci95_high:double>>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(paths).select(
        F.col("_metadata.file_path").alias("run"), "*"
    )


def long_metric_records(records: DataFrame) -> DataFrame:
    """Headline and few-shot metrics as ``(run, protocol, ..., k, metric, value)``."""
    base = ["run", "protocol", "training_mode", "synthetic", "paper_ready"]
    head = records.select(
        *base, F.lit(None).cast("int").alias("k"),
        F.explode(F.create_map(*[x for m in ("uar", "macro_f1", "accuracy") for x in (F.lit(m), F.col(m))])).alias("metric", "value"),
    )
    shots = records.where("few_shot is not null").select(*base, F.explode("few_shot").alias("k", "m"))
    few = shots.select(*base, F.col("k").cast("int").alias("k"), F.explode("m").alias("metric", "s"))
    return head.unionByName(few.select(*base, "k", "metric", F.col("s.mean").alias("value")))


def read_embeddings(spark: SparkSession, path: str, modality: str, contract: str) -> DataFrame:
    """Vectors of one contract; the filter prunes the other contracts' folders."""
    from voxloom.operators.store import read_store

    return read_store(spark, path).where(
        (F.col("modality") == modality) & (F.col("contract_sha256") == contract)
    )


def read_versioned_examples(spark: SparkSession, path: str) -> DataFrame:
    """Example files of all schema versions merged; absent fields become NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)
