"""Manifest files: strict JSON-lines scan with quarantine, deterministic sink."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxloom.schemas import MANIFEST, REQUIRED_COLUMNS


def parse_strict(lines: DataFrame, value: str, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """Parse JSON lines against a closed field set.

    Adds the schema's columns and ``problem``: NULL, ``not_an_object``, ``unknown_field``,
    ``missing_field`` or ``malformed``, with the offending names in ``detail``.
    """
    raw = F.col(value)
    keys = F.json_object_keys(raw)
    unknown = F.array_except(keys, F.array(*[F.lit(c) for c in schema.fieldNames()]))
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), keys)
    corrupt = "_corrupt"
    read = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(raw, read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    with_row = lines.where(F.length(F.trim(raw)) > 0).withColumn("_row", parsed)
    problem = (
        F.when(keys.isNull(), "not_an_object").when(F.size(unknown) > 0, "unknown_field")
        .when(F.size(missing) > 0, "missing_field").when(F.col(f"_row.{corrupt}").isNotNull(), "malformed")
    )
    detail: Column = F.when(F.size(unknown) > 0, F.array_join(unknown, ",")).when(
        F.size(missing) > 0, F.array_join(missing, ",")
    )
    others = [c for c in lines.columns if c != value]
    return with_row.select(
        *others, problem.alias("problem"), detail.alias("detail"),
        F.when(problem.isNotNull(), raw).alias("raw"), *[F.col(f"_row.{c}").alias(c) for c in schema.fieldNames()],
    )


def scan_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines with their file and problem; blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_strict(lines, "value", MANIFEST, REQUIRED_COLUMNS)


def load_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Manifest rows; the first bad line fails the job and is named in the error."""
    rows = scan_manifest(spark, path)
    message = F.concat_ws(" ", F.col("file"), F.col("problem"), F.col("detail"), F.col("raw"))
    guard = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    manifest = rows.where(guard).select(*MANIFEST.fieldNames())
    if manifest.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    return manifest


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("problem is not null").select("file", "problem", "detail", "raw")


def write_manifest(df: DataFrame, path: str, key: str = "sample_id") -> None:
    """JSON lines with sorted keys and explicit nulls, globally ordered by id."""
    columns = [c for c in sorted(df.columns) if c in MANIFEST.fieldNames()]
    df.select(*columns).orderBy(key).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
