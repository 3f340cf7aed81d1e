"""What the operators share: scratch tables on the shared folder, blobs, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, and rows of one batch of a Parquet scan, so that
#: batches of very long texts stay small.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 2048, 4 << 20, 512


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that scans of texts make and Python workers get."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns what this process has freed to the system. Python workers stay for
    the next task, so what one task leaves would count beside what all later ones
    need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], done: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; after the last batch done(), which empties caches, and
    give_back()."""

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option = getattr(ctypes.CDLL(None), "mallopt", None)
        if option is not None:
            option(-3, 1 << 20)  # M_MMAP_THRESHOLD: what is larger goes back as soon as it is freed
        yield from run(batches)
        if done is not None:
            done()
        give_back()

    return all_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where
    that is unset a temporary one, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.tesserine.scratch", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tesserine-")
            spark.conf.set("spark.tesserine.scratch", base)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Rows of a small table that one task writes.
TASK_ROWS = 1 << 18


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends
    here, and a lost executor costs nothing that was computed before. Where about
    so many rows are expected, and these are few, few tasks write them."""
    path = scratch(df.sparkSession, name)
    if rows is not None and rows // TASK_ROWS + 1 < parallelism(df.sparkSession):
        df = df.coalesce(rows // TASK_ROWS + 1)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_output(uri: str):
    """A stream to a new file of the shared folder; runs on executors."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable file of the shared folder; runs on executors."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text of an Arrow column; null is empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(binary).to_pylist()]


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], binary: tuple[str, ...] = (), done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function of column lists; the columns named in binary
    arrive as UTF-8 bytes with null as empty. done() is called at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {n: bytes_of(batch.column(i)) if n in binary else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            made = fn(given)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(given_back(run, done), schema)


def row_key(id_column: str = "doc_id", *content: str) -> list[Column]:
    """Key of a row by its id and a hash of its content. Rows that agree on both
    are repeats of one row and get the same decision."""
    return [F.col(id_column).alias("__id"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content or ("text",)]).alias("__hash")]


def keep_rows(df: DataFrame, keys: DataFrame, id_column: str, *content: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose row_key is (left_semi) or isn't (left_anti) in keys, with
    df's own columns only, whatever their names."""
    names = df.columns
    left = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), *row_key(id_column, *content))
    right = keys.select(F.col("__id").alias("__rid"), F.col("__hash").alias("__rhash"))
    joined = left.join(right, left["__id"].eqNullSafe(right["__rid"]) & (left["__hash"] == right["__rhash"]), how)
    return joined.select(*[F.col("__row").getField(n).alias(n) for n in names])


#: Most 64-bit words of a bitmap of row keys; as a broadcast table a word takes about
#: 64 bytes.
BITMAP_WORDS = 1 << 20


def bitmap_words(keys: int, most: int) -> int:
    """Words of a bitmap with 16 bits for each key, as far as `most` goes."""
    return max(16, min(most, 1 << (keys // 4).bit_length()))


def drop_rows(df: DataFrame, keys: DataFrame, id_column: str, *content: str) -> DataFrame:
    """Rows of df whose row_key isn't in keys (a stored table), with df's own columns.

    A bitmap of the keys' hashes tells for most rows that they stay; only the
    others, keys' own rows and a few more, are shuffled to be compared exactly. It
    grows with the keys up to BITMAP_WORDS; beyond, more and more rows are compared.
    """
    names = df.columns
    bits = 64 * bitmap_words(keys.count(), BITMAP_WORDS)
    place = F.pmod(F.xxhash64("__id", "__hash"), F.lit(bits))
    at = [F.shiftright(place, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__id, __hash), {bits}) % 64 as int))").alias("__mask")]
    bitmap = keys.select(*at).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    rows = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), *row_key(id_column, *content))
    marked = rows.select("__row", "__id", "__hash", *at).join(F.broadcast(bitmap), "__word", "left")
    likely = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) != 0, F.lit(False))
    right = keys.select(F.col("__id").alias("__rid"), F.col("__hash").alias("__rhash"))
    compared = marked.filter(likely).join(right, F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__hash") == F.col("__rhash")), "left_anti")
    return marked.filter(~likely).select("__row").union(compared.select("__row")).select(*[F.col("__row").getField(n).alias(n) for n in names])
