"""Token ids in Arrow files of equal-length sequences.

A folder holds pairs of Arrow IPC files, numbered in the order of doc_id. NNNNN-*.arrow has record batches of three fixed-size-list
columns: ids (unsigned 16-bit), mask (true: a token, false: padding of the file's last sequence) and ends (true at a document's last
token). NNNNN-*.docs.arrow has doc_id, first and n_tokens in the same order. The documents of a file follow each other without gaps.
A reader maps a file into memory and reaches sequence k at batch k // rows, row k % rows, without copying.

Defined cases: a null or empty text is the end id alone; repeated doc_ids stay rows of their own, in any order among themselves;
null doc_ids come first; an empty table gives no files; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, new_path, staged, table
from .tokens import crc, shared_encoder

LENGTH, ROWS = 2048, 256


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


def fixed(values: np.ndarray, kind: pa.DataType, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length)


class SequenceWriter:
    """Appends documents to one file of sequences, holding a batch of them at most."""

    def __init__(self, sink, length: int = LENGTH, rows: int = ROWS):
        self.length, self.batch, self.n = length, length * rows, 0
        self.writer = pa.ipc.new_file(sink, schema(length))
        self.ids: list[np.ndarray] = []
        self.ends: list[int] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> int:
        """Append one document with its end id; returns its first token's place in the file."""
        first = self.n
        self.ids.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.batch:
            self._flush(self.held // self.batch * self.batch)
        return first

    def _flush(self, n: int, padding: int = 0) -> None:
        ids, ends = np.concatenate([*self.ids, np.zeros(padding, np.uint16)]), np.zeros(self.held + padding, bool)
        ends[self.ends] = True
        mask = np.arange(len(ids)) < self.held
        for at in range(0, n, self.batch):
            part = slice(at, min(n, at + self.batch))
            self.writer.write_batch(pa.record_batch([fixed(ids[part], pa.uint16(), self.length), fixed(mask[part], pa.bool_(), self.length), fixed(ends[part], pa.bool_(), self.length)], schema=schema(self.length)))
        self.ids, self.ends, self.held = [ids[n:]], [e - n for e in self.ends if e >= n], max(0, self.held - n)

    def close(self) -> None:
        if self.held:
            padding = -self.held % self.length
            self._flush(self.held + padding, padding)
        self.writer.close()


def write_sequences(docs: DataFrame, folder: str, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Write the files; returns the stored table of them: part, file, docs_file, n_docs, n_tokens."""
    bound_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, out = TaskContext.get().partitionId(), shared_encoder(path), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system, root = file_system(folder)
                system.create_dir(root, recursive=True)
                name = f"{part:05d}-{uuid.uuid4().hex}"
                sink, docs_sink = (system.open_output_stream(f"{root}/{name}{end}") for end in (".arrow", ".docs.arrow"))
                out, index, n_docs = SequenceWriter(sink, length), None, 0
            ids, offsets = encoder.documents(batch.column("text"))
            firsts = [out.add(ids[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
            told = pa.record_batch([batch.column("doc_id"), pa.array(firsts, pa.int64()), pa.array(np.diff(offsets), pa.int64())], names=["doc_id", "first", "n_tokens"])
            index = index or pa.ipc.new_file(docs_sink, told.schema)
            index.write_batch(told)
            n_docs += batch.num_rows
        if out is not None:
            out.close(), index.close(), sink.close(), docs_sink.close()
            yield pa.record_batch([[part], [f"{name}.arrow"], [f"{name}.docs.arrow"], [n_docs], [out.n]], names=["part", "file", "docs_file", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(ordered.mapInArrow(write, "part long, file string, docs_file string, n_docs long, n_tokens long"), "token_files")


def open_sequences(folder: str, file: str) -> pa.RecordBatchFileReader:
    """A reader over a file of sequences, mapped into memory where the folder is a local one."""
    system, root = file_system(folder)
    if system.type_name == "local":
        return pa.ipc.open_file(pa.memory_map(f"{root}/{file}"))
    return pa.ipc.open_file(system.open_input_file(f"{root}/{file}"))


def sequence(reader: pa.RecordBatchFileReader, k: int, rows: int = ROWS) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence k, by place. Both are views of the file: a mask stays packed, eight tokens a byte, until its bits are asked for."""
    batch = reader.get_batch(k // rows)
    return batch.column("ids")[k % rows].values.to_numpy(), batch.column("mask")[k % rows].values


def documents_in(folder: str, file: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The parts of documents in a file, in order: ids, and whether the document ends there."""
    reader = open_sequences(folder, file)
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("ids").flatten().to_numpy()
        n = pc.sum(batch.column("mask").flatten()).as_py() or 0
        at = 0
        for end in np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)[:n]) + 1:
            yield ids[at:end], True
            at = end
        if at < n:
            yield ids[at:n], False


def read_documents(files: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, sums, n, value = [], [], 0, 0
                for ids, ends in documents_in(folder, row["file"]):
                    n, value = n + len(ids), crc(ids, value)
                    if ends:
                        counts.append(n)
                        sums.append(value)
                        n = value = 0
                system, root = file_system(folder)
                with system.open_input_file(f"{root}/{row['docs_file']}") as f:
                    ids = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                starts = row["base"] + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                yield pa.record_batch([ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = based.repartition(max(1, files.count()), "part")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files, and read back from them."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "sequences")
    return read_documents(write_sequences(docs, folder), folder, docs.schema["doc_id"].dataType.simpleString())
