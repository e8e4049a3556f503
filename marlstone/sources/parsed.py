"""Objects of a tree of files, parsed once for each content.

Two tables grow in a folder: `files`, which says what content (a hash) a file of some path, time of change and length has, and `objects`, the statements of
each content. A read lists the tree without opening files, opens those that `files` does not know as they are (a file of one time and length is taken to
be one), parses the contents that `objects` does not know, and joins the rest; so a change of one file of many opens and parses that file. Rows are only ever added, by whole folders of
Parquet files, and what two runs have added both counts once; after MOST_PARTS of them they are written together.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import stored
from .scan import OBJECTS, TEST_MARK, read_files, statements_of, with_order

#: Parts of a table that are read as they are; paths that are opened by name (more are taken from a read of the whole tree).
MOST_PARTS, MOST_PATHS = 40, 2_000
FILES = "file string, modified timestamp, length bigint, content string"
PARSED = "content string, " + ", ".join(c for c in OBJECTS.split(", ") if not c.startswith("file "))


@dataclass
class Read:
    """What a read of the tree opened and parsed."""

    files: int = 0
    opened: int = 0
    parsed: int = 0


class ParsedStore:
    """The parsed objects of a tree, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.last = spark, folder.rstrip("/"), Read()

    def _parts(self, name: str) -> list[str]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in store.listStatus(top)] if store.exists(top) else []
        return [str(p) for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = self._parts(name)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{name}/{uuid.uuid4().hex}")

    def _together(self, name: str, schema: str, keys: list[str]) -> None:
        """Write the parts of a table as one, when there are many."""
        parts = self._parts(name)
        if len(parts) > MOST_PARTS:
            self._add(name, self.spark.read.schema(schema).parquet(*parts).dropDuplicates(keys))
            for p in parts:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def rows(self, folder: str) -> DataFrame:
        """The statements of a code tree without its tests, as scan_objects gives them."""
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").load(folder)
        listing = listing.select(F.col("_metadata.file_path").alias("file"), "path", F.col("modificationTime").alias("modified"), "length")  # contents are not read
        now = stored(listing.filter(~F.element_at(F.split("file", "/"), -1).contains(TEST_MARK)))
        keys = ["file", "modified", "length"]
        fresh = now.join(self._table("files", FILES), keys, "left_anti")
        paths = [r["path"] for r in fresh.select("path").limit(MOST_PATHS + 1).collect()]
        self.last = Read(now.count(), fresh.count() if len(paths) > MOST_PATHS else len(paths))
        if paths:
            texts = read_files(self.spark, folder if len(paths) > MOST_PATHS else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]).join(fresh.drop("path"), "file")
            texts = stored(texts.select("file", "text", "modified", "length", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")))
            unknown = texts.join(self._table("objects", PARSED).select("content").distinct(), "content", "left_anti").groupBy("content").agg(F.any_value("text").alias("text"))
            found = stored(statements_of(unknown.select(F.col("content").alias("file"), "text")))
            self.last.parsed = unknown.count()
            # a content without statements leaves a row too, so that it is known
            empty = unknown.select("content").join(found.select(F.col("file").alias("content")), "content", "left_anti")
            self._add("objects", found.withColumnRenamed("file", "content").unionByName(empty, allowMissingColumns=True))
            self._add("files", texts.select("file", "modified", "length", "content"))
            self._together("files", FILES, keys)
            self._together("objects", PARSED, ["content", "idx"])
        known = now.join(self._table("files", FILES).dropDuplicates(keys), keys).select("file", "content")
        objects = self._table("objects", PARSED).filter("idx is not null").dropDuplicates(["content", "idx"])
        return with_order(known.join(objects, "content").select([c.split(" ")[0] for c in OBJECTS.split(", ")]))
