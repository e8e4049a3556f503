"""Shared folder, staged tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch between the JVM and a Python worker may hold.
ARROW_BYTES = 8 << 20
#: Bits of a map of ids that is sent to the workers, and ids that are sent themselves.
ID_BITS, MOST_CHANCES = 1 << 24, 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small, so that very long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that are needed no more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a worker has freed back to the machine: workers live on between tasks, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over Arrow batches, releasing memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n + 1 offsets of its values (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about most bytes each, and a row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def settled(df: DataFrame, **columns) -> DataFrame:
    """df with further columns that are computed once a row: a generator of one row keeps later filters from being pushed into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _place(column: str, turn: int):
    return F.pmod(F.xxhash64(column, F.lit(turn)), F.lit(ID_BITS))


def marked(df: DataFrame, ids: DataFrame, column: str, flag: str, turn: int = 0) -> DataFrame:
    """df with a boolean flag: true where column is in ids (one column), and by chance for some others; false for nulls.

    ids go to the workers as a map of ID_BITS bits, ID_BITS / 64 rows at most; df is not shuffled.
    """
    place = _place(ids.columns[0], turn)
    words = ids.filter(F.col(ids.columns[0]).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    placed = df.withColumn("_p", F.when(F.col(column).isNotNull(), _place(column, turn)))
    found = placed.join(F.broadcast(words), F.shiftright("_p", 6) == F.col("_word"), "left")
    return found.withColumn(flag, F.coalesce(F.expr("getbit(_bits, cast(_p & 63 as int)) = 1"), F.lit(False))).drop("_p", "_word", "_bits")


def left_out(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in dropped (stored, one column); rows of a null doc_id stay.

    Texts stay where they are: a map of bits tells most of the rows that are kept, and the ids that it marks by chance are found from
    ids alone. Only if these are over MOST_CHANCES, as with a map that is nearly full, the marked rows are dealt out for a join.
    """
    gone = dropped.select(F.col(dropped.columns[0]).alias("_gone"))
    chance = staged(marked(docs.select("doc_id"), gone, "doc_id", "_hit").filter("_hit").select(F.col("doc_id").alias("_id")).distinct().join(gone, F.col("_id") == F.col("_gone"), "left_anti"), "chance")
    flagged = marked(docs.withColumn("_doc", F.struct(*docs.columns)).select("doc_id", "_doc"), gone, "doc_id", "_hit")
    if chance.count() <= MOST_CHANCES:
        return flagged.join(F.broadcast(chance), F.col("doc_id") == F.col("_id"), "left").filter(~F.col("_hit") | F.col("_id").isNotNull()).select("_doc.*")
    unsure = flagged.filter("_hit").join(chance, F.col("doc_id") == F.col("_id"), "left_semi")
    return flagged.filter(~F.col("_hit")).unionByName(unsure).select("_doc.*")
