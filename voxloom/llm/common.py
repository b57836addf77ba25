"""Helpers shared by the training-data operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.scratch import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Arrow settings as Spark sets them, and for whole texts: a batch of 10,000 takes 25 MB or more,
# held several times between the executor and its Python workers.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def long_texts(docs: DataFrame) -> DataFrame:
    """``docs``; a session that left the sizes of Arrow batches alone gets sizes for long texts."""
    conf = docs.sparkSession.conf
    for key, (usual, ours) in BATCHES.items():
        if conf.get(key, None) == usual:
            conf.set(key, ours)
    return docs


def kept(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a checkpoint, survives lost executors and gives later jobs
    column statistics.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.kept_path = path
    return written


def discard(written: DataFrame) -> None:
    """Delete what :func:`kept` wrote, once all that reads it has been written itself."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def raw(text: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but space and the characters 9 to 13: what ``bytes.split`` cuts at."""
    return text.split()


def text_batches(arrow: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their ``text`` bytes as a list, cut near ``limit`` bytes a slice."""
    for batch in arrow:
        column = batch.column("text")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        whole = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def result(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The columns ``keep`` of a slice next to new ones."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *more.values()], [*keep, *more])


MAPS, MAP_BITS = 2048, 1 << 15  # bitmaps of marked(): 8 MiB, whatever the number of keys


def marked(df: DataFrame, name: str, own: Column, keys: DataFrame) -> DataFrame:
    """``df`` with a boolean column that is false only where the long ``own`` is not in ``keys(key)``.

    The keys' hashes are bits of a fixed number of bitmaps, so what is broadcast never grows with
    the data.  Rows told apart here need not be shuffled to meet the keys; true says nothing.
    """
    at, number, bits = (free_name(df, c) for c in ("_at", "_number", "_bits"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAPS * MAP_BITS)) + 1
    maps = keys.select(place(F.col("key")).alias(at)).groupBy(F.bitmap_bucket_number(F.col(at)).alias(number)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(at))).alias(bits)
    )
    bit = F.bitmap_bit_position(F.col(at))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = df.withColumn(at, place(own)).join(
        F.broadcast(maps), F.bitmap_bucket_number(F.col(at)) == F.col(number), "left"
    )
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return placed.withColumn(name, found).drop(at, number, bits)


def only(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose long ``column`` is in ``keys(key)``; few others are shuffled."""
    maybe = free_name(df, "_maybe")
    told = marked(df, maybe, F.col(column), keys).where(maybe).drop(maybe)
    return told.join(keys.select(F.col("key").alias(maybe)), F.col(column) == F.col(maybe), "left_semi")


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose long ``column`` is not in ``keys(key)``; most are not shuffled."""
    maybe = free_name(df, "_maybe")
    told = marked(df, maybe, F.col(column), keys)
    rest = told.where(maybe).drop(maybe).join(
        keys.select(F.col("key").alias(maybe)), F.col(column) == F.col(maybe), "left_anti"
    )
    return told.where(~F.col(maybe)).drop(maybe).unionByName(rest)


def pick_rows(
    docs: DataFrame, winners: DataFrame, identity: Column, id_col: str = "doc_id", doubtful: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``docs`` whose id and ``identity`` stand in ``winners(win_id, win_key)``.

    Both are unique there, so a hot text is spread by its ids.  Of rows equal in both,
    one stays.  All columns of ``docs`` come back, none added.

    ``doubtful(key)`` may hold ``xxhash64(id, identity)`` of all rows that do not stay and of all
    that stand more than once: then only rows it may hold are shuffled, the others stay as they are.
    """
    key, rank, maybe, win_id, win_key = (free_name(docs, c) for c in ("_key", "_rank", "_maybe", "win_id", "win_key"))
    named = winners.select(F.col("win_id").alias(win_id), F.col("win_key").alias(win_key))
    keyed = docs.withColumn(key, identity)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clear = None
    if doubtful is not None:
        keyed = marked(keyed, maybe, F.xxhash64(F.col(id_col), F.col(key)), doubtful)
        clear, keyed = keyed.where(~F.col(maybe)).select(*columns), keyed.where(maybe).drop(maybe)
    same = F.col(id_col).eqNullSafe(F.col(win_id)) & F.col(key).eqNullSafe(F.col(win_key))
    order = Window.partitionBy(F.col(id_col), F.col(key)).orderBy(F.lit(0))
    picked = (
        keyed.join(named, same).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*columns)
    )
    return picked if clear is None else clear.unionByName(picked)
