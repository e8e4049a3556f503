"""Reading SQL trees: objects with their dependencies, migrations, seeds and tests, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dependencies import query_dependencies
from ..functions.identify import IdentificationError, SqlObject, identify
from ..functions.idents import Dependencies, Ident
from ..functions.sqltext import SqlSyntaxError, split_statements, tokens

OBJECTS = "file string, idx int, object_type string, schema string, name string, trigger_table string, state_name string, ddl string, ddl_hash string, start_line int, end_line int, deps array<struct<dep_class:string,dep_schema:string,dep_name:string>>, problem string"

#: Names that parse like functions and are part of the language: fixed values.
SPECIAL_FORMS = "coalesce nullif greatest least current_date current_time current_timestamp localtime localtimestamp current_user session_user user current_role current_catalog current_schema row array xmlelement xmlforest xmlconcat xmlparse xmlpi xmlroot xmlserialize grouping overlay position substring trim extract cast collation".split()
#: Bare names of built-in types: fixed values.
BUILTIN_TYPES = "text varchar bpchar char name int2 int4 int8 float4 float8 numeric bool date time timetz timestamp timestamptz interval uuid json jsonb bytea bit varbit money inet cidr macaddr xml oid regclass regproc regprocedure regtype void trigger record anyelement anyarray serial bigserial smallserial point line box path polygon circle tsvector tsquery".split()
#: Functions of test frameworks, left out of a test's dependencies: fixed values.
TEST_FUNCTIONS = frozenset("plan pass fail ok is isnt matches doesnt_match alike unalike cmp_ok isa_ok throws_ok lives_ok performs_ok finish no_plan skip todo todo_start todo_end diag note has_table has_view has_function has_type has_column has_index has_trigger has_schema has_role".split())
TEST_MARK = ".test."
#: The problem of a definition that would be lost without a word: fixed value.
UNREAD = "cannot be read"


def builtins(spark: SparkSession) -> DataFrame:
    """dep_class, dep_schema, dep_name of all built-in names, bare and under pg_catalog: a list of fixed size."""
    functions = {r[0].split(".")[-1] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect() if r[0].replace("_", "").isalnum()} | set(SPECIAL_FORMS)
    rows = [(c, s, n) for c, names in (("function", functions), ("type", set(BUILTIN_TYPES))) for n in sorted(names) for s in (None, "pg_catalog")]
    return spark.createDataFrame(rows, "dep_class string, dep_schema string, dep_name string")


def object_row(o: SqlObject, file: str, idx: int, start: int, end: int) -> dict:
    deps = [{"dep_class": c, "dep_schema": i.schema, "dep_name": i.name} for c, i in o.dependencies.rows()]
    return {"file": file, "idx": idx, "object_type": o.kind, "schema": o.ident.schema, "name": o.ident.name, "trigger_table": None if o.trigger_table is None else str(o.trigger_table), "state_name": o.key, "ddl": o.ddl, "ddl_hash": o.hash, "start_line": start, "end_line": end, "deps": deps, "problem": None}


def skipped_label(sql: str) -> str:
    """What kind of statement was passed over."""
    words = [t.lower for t in tokens(sql)][:2] or [""]
    head = words[0]
    if head in ("grant", "revoke"):
        return "permission"
    if head in ("vacuum", "analyze", "reindex", "cluster", "refresh"):
        return "maintenance"
    if head in ("begin", "commit", "rollback", "start", "savepoint", "release"):
        return "transaction"
    return head if head in ("update", "delete", "insert", "select", "alter", "drop", "set", "truncate") else "unsupported"


def file_rows(file: str, text: str) -> list[dict]:
    """The objects of a file. A syntax error loses the file, an identity that cannot be told the rest of it; both leave a row with the problem."""
    blank = dict.fromkeys(("object_type", "schema", "name", "trigger_table", "state_name", "ddl", "ddl_hash", "start_line", "end_line"))
    problem = lambda idx, what, **more: {**blank, "file": file, "idx": idx, "deps": [], "problem": what, **more}
    try:
        statements = split_statements(text)
    except SqlSyntaxError as e:
        return [problem(0, f"syntax error: {e}")]
    out = []
    for s in statements:
        try:
            found = identify(s.sql)
            row = object_row(found, file, s.idx, s.start_line, s.end_line) if found else problem(s.idx, f"skipped {skipped_label(s.sql)}: {s.sql[:80]}", start_line=s.start_line, end_line=s.end_line)
        except (IdentificationError, SqlSyntaxError) as e:
            return [*out, problem(s.idx, f"rest of the file left out: {e}", start_line=s.start_line, end_line=s.end_line)]
        except (AttributeError, IndexError) as e:  # a definition that ends early, or one that identify cannot follow: plans refuse it
            return [*out, problem(s.idx, f"{UNREAD}: {s.sql[:80]} ({e})", start_line=s.start_line, end_line=s.end_line)]
        out.append(row)
    return out


def read_files(spark: SparkSession, folder: str | list[str], pattern: str = "*.sql", recursive: bool = True) -> DataFrame:
    """file, text of the files of a tree, or of some paths."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def statements_of(files: DataFrame) -> DataFrame:
    """Every statement of files (file, text), in OBJECTS' columns: objects, and rows with a problem in their place."""
    schema = pa.schema([("file", pa.string()), ("idx", pa.int32()), *[(c, pa.string()) for c in ("object_type", "schema", "name", "trigger_table", "state_name", "ddl", "ddl_hash")], ("start_line", pa.int32()), ("end_line", pa.int32()), ("deps", pa.list_(pa.struct([(c, pa.string()) for c in ("dep_class", "dep_schema", "dep_name")]))), ("problem", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in file_rows(f, t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file", "text").mapInArrow(read, OBJECTS)


def with_order(rows: DataFrame) -> DataFrame:
    """rows with seq, a text by which statements stand in the order of their files and places."""
    return rows.withColumn("seq", F.concat("file", F.lit("\x01"), F.lpad(F.col("idx").cast("string"), 10, "0")))


def objects_of(files: DataFrame) -> DataFrame:
    """Every statement of files (file, text), in OBJECTS' columns and seq."""
    return with_order(statements_of(files))


def scan_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The statements of a code tree without its tests."""
    return objects_of(read_files(spark, folder).filter(~F.element_at(F.split("file", "/"), -1).contains(TEST_MARK)))


def dependencies_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """object_type, state_name, dep_class, dep_schema, dep_name of all objects, less built-in names (known)."""
    deps = rows.filter("object_type is not null").select("object_type", "state_name", F.explode("deps").alias("d")).select("object_type", "state_name", "d.*")
    k = F.broadcast(known.select(*[F.col(c).alias(f"_{c}") for c in known.columns]))
    return deps.join(k, (F.col("dep_class") == F.col("_dep_class")) & F.col("dep_schema").eqNullSafe(F.col("_dep_schema")) & (F.col("dep_name") == F.col("_dep_name")), "left_anti")


@dataclass(frozen=True)
class Migration:
    name: str
    text: str


def scan_migrations(spark: SparkSession, folder: str) -> DataFrame:
    """name (the file's stem), text of the migrations of a folder, by name."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.sql$", "")
    return read_files(spark, folder, recursive=False).select(stem.alias("name"), "text").orderBy("name")


def test_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_files(spark, folder, "*.test.sql").orderBy("file")


def test_dependencies(text: str) -> Dependencies:
    """What the statements of a test refer to, without the test framework's functions."""
    found = Dependencies()
    try:
        for s in split_statements(text):
            toks = list(tokens(s.sql))
            if toks and toks[0].lower not in ("begin", "commit", "rollback"):
                found |= query_dependencies(toks)
    except SqlSyntaxError:
        return Dependencies()
    return Dependencies(found.relations, frozenset(f for f in found.functions if f.name not in TEST_FUNCTIONS), found.types)


def as_object(row) -> SqlObject:
    """The object of a row's definition, with all details."""
    found = identify(row["ddl"])
    on = None if row["trigger_table"] is None else Ident.parse(row["trigger_table"])
    return SqlObject(found.kind, found.ident, row["ddl"], found.dependencies, on, row["file"] if "file" in row else None, row["start_line"] if "start_line" in row else None, details=found.details)
