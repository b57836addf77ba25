"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct normalised text, bucketed and sorted by
its SHA-256 digest.  A batch is reduced to one row per digest (combined before the
shuffle), anti-joined with the index by sort and merge, which moves only the batch, and
the new digests are appended.  Running a batch again appends nothing.

Null and empty texts are equal texts.  Of equal texts in a batch the row with the largest
``doc_id`` stays (a null id ranks lowest; of repeated rows with that id one stays); a text
that the index knew before keeps its earlier owner.  An empty table gives an empty result.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.common import ascii_lower, kept, pick_rows
from voxloom.scratch import new_folder

BUCKETS = 64
HOT_SHARE = 1000  # a digest with over 1/1000 of a batch's rows is hot: under 1,000 digests are
INDEX_COLUMNS = ("digest", "keep_id", "keep_row", "group_size", "batch")


def digest_of(text):
    return F.unhex(F.sha2(ascii_lower(text), 256))


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """Name of the index table over ``path``; an index written earlier is found again."""
    name = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING) "
        f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def add_batch(rows: DataFrame, index: str, buckets: int = BUCKETS) -> str:
    """Append the digests of ``rows(doc_id, row, digest)`` that the index lacks; the batch's name."""
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    groups = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")
    )
    known = spark.table(index).select("digest")
    fresh = groups.join(known.hint("merge"), "digest", "left_anti").select(
        "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size",
        F.lit(batch).alias("batch"),
    )
    (
        fresh.repartition(buckets, "digest").select(*INDEX_COLUMNS).write.format("parquet").mode("append")
        .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index)
    )
    return batch


def numbered_digests(docs: DataFrame) -> DataFrame:
    return kept(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest")),
        "digests",
    )


def exact_duplicates(docs: DataFrame, index_path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    ``group_size`` counts the text's rows in the batch that brought it into the index.
    """
    spark = docs.sparkSession
    index = open_index(spark, index_path or new_folder(spark, "digest-index"), buckets)
    rows = numbered_digests(docs)
    batch = add_batch(rows, index, buckets)
    owners = spark.table(index)
    # The few digests that are hot in this batch travel to the rows; all other rows travel to
    # their digest.
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > rows.count())
    hot = owners.join(F.broadcast(hot.select("digest")), "digest", "left_semi").select(
        "digest", F.struct("keep_id", "keep_row", "group_size", "batch").alias("hot")
    )
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # a row that is already answered gets a key of its own, which no digest has
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.col("row"))))
    found = marked.withColumn("key", key).join(
        owners.select(F.col("digest").alias("key"), F.struct("keep_id", "keep_row", "group_size", "batch").alias("own")),
        "key", "left",
    ).withColumn("owner", F.coalesce("hot", "own"))
    return found.select(
        "doc_id", F.col("owner.keep_id").alias("keep_id"), F.col("owner.group_size").alias("group_size"),
        ((F.col("owner.batch") == batch) & (F.col("owner.keep_row") == F.col("row"))).alias("kept"), "digest",
    )


def drop_exact_duplicates(docs: DataFrame, index_path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    spark = docs.sparkSession
    index = open_index(spark, index_path or new_folder(spark, "digest-index"), buckets)
    rows = numbered_digests(docs)
    batch = add_batch(rows, index, buckets)
    own = spark.table(index).where(F.col("batch") == batch)
    winners = own.select(F.col("keep_id").alias("win_id"), F.col("digest").alias("win_key"))
    # texts that stand once and are new stay where they are; only the others move
    doubtful = rows.join(own.where("group_size = 1").select("digest"), "digest", "left_anti")
    return pick_rows(
        docs, winners, digest_of(F.col("text")), doubtful=doubtful.select(F.xxhash64("doc_id", "digest").alias("key"))
    )
