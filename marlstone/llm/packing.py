"""Best-fit decreasing packing of token sequences into bins of fixed capacity.

Pieces of one length are interchangeable, so the packing is worked out exactly over the table of lengths, which has at most as many
rows as the capacity: lengths fall from long to short, a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and bins with the same history are held as one run of bins. What comes out is a table of runs, at most
3 * capacity * log2(capacity) rows, from which every executor reads the place of its own pieces. Nothing that grows with the
documents reaches the driver.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed as rows of their own; an empty
table gives no rows; columns other than doc_id and text are ignored; null doc_ids are carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, staged, table
from .tokens import crc, shared_encoder

CAPACITY = 2048
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over the capacities 0 to most: which hold open bins, and the tightest that holds a length."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.any = bytearray(2 * self.width)

    def mark(self, capacity: int, full: bool) -> None:
        at = self.width + capacity
        self.any[at] = full
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of least or more."""
        at = self.width + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    A run (length, lo, hi, sequence, each, offset): of the pieces of this length, those ranked lo to hi - 1 go to the bins from
    sequence on, each to a bin, the first of them at offset.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length must be from 1 to the capacity")
    tree, open_bins = CapacityTree(capacity), {}
    runs, fresh = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            open_bins.setdefault(room, []).append((first, bins))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                need = -(-left // (capacity // length))
                put(capacity, fresh, need)
                fresh += need
                continue
            first, bins = open_bins[room].pop()
            if not open_bins[room]:
                tree.mark(room, False)
            each = room // length
            full = min(bins, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                if left:
                    runs.append((length, rank, rank + left, first + full, each, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, bins - full)
    return runs


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The token pieces of each row of docs: doc_id, piece, start, length, ids_crc32; only the first piece may be short of a cut."""
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            where = []
            ids, offsets = encoder.documents(batch.column("text"))
            for k, (first, stop) in enumerate(itertools.pairwise(offsets.tolist())):
                n = stop - first
                begin, end = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    where.append(k)
                    for column, x in zip(rows[1:], (piece, begin, end - begin, crc(ids[first + begin : first + end])), strict=True):
                        column.append(x)
                    begin, end = end, end + capacity
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(where, pa.int32())), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECE.format(id=kind))


def best_fit_pack(cut: DataFrame, capacity: int = CAPACITY, rows_a_salt: int = 1024, salts: tuple[int, int] = (256, 1 << 16)) -> DataFrame:
    """Give every row of cut (with a length, and doc_id, piece, start to order by) its sequence_id and offset.

    Rows are ranked within a length by salt first, so that a length that holds most rows is ranked by many tasks. cut is read
    more than once: it must be a stored table.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    runs = spark.createDataFrame(best_fit_runs(counts, capacity), "length long, lo long, hi long, first long, each long, base long")
    n_salts = min(salts[1], max(salts[0], sum(counts.values()) // rows_a_salt))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("row", F.row_number().over(within)).join(bases, ["length", "salt"]).withColumn("rank", F.col("ranked") + F.col("row") - 1)
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    return placed.select(*cut.columns, (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenize whole documents, cut those over capacity, and pack all pieces."""
    return best_fit_pack(staged(pieces(docs, capacity, path), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


__all__ = ["CAPACITY", "CapacityTree", "best_fit_pack", "best_fit_runs", "op10_best_fit_packing", "pack_documents", "pieces"]
