"""Queries that write definitions from rows of the driver's tables, read them with the engine's SQL functions, and compare with what the rows say.

Each template is a definition with {n} for a row's number; what reading it gives is written beside it, so that DuckDB's SQL is the list of
templates joined with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identify import IdentificationError, identify
from ..functions.idents import from_state_key
from ..functions.sqltext import SqlSyntaxError, line_and_column, normalized, quoted, split_statements
from ..sources.catalog import catalog_of
from ..operators.severity import LABELS, altered_tables, enum_additions, rank_of_migration, rank_of_statement, rank_of_update
from .queries import query, read

#: Definition, kind, name, and the relations, functions and types it depends on, each sorted and joined by commas.
TEMPLATES = [
    ("CREATE VIEW s.v{n} AS SELECT a.x, f{n}(a.y) FROM s.t{n} a JOIN u{n} b ON a.k = b.k WHERE a.z > 1 AND EXISTS (SELECT 1 FROM w{n})", "view", "s.v{n}", "u{n},w{n},s.t{n}", "f{n}", ""),
    ("CREATE MATERIALIZED VIEW m{n} AS WITH c AS (SELECT * FROM base{n}) SELECT x, count(*) FROM c GROUP BY x HAVING g{n}(max(y)) > 0 ORDER BY h{n}(x)", "materialized_view", "m{n}", "base{n}", "count,g{n},h{n},max", ""),
    ("CREATE TABLE t{n} (id kind{n} PRIMARY KEY, ref int REFERENCES p{n}(id), made int DEFAULT d{n}())", "table", "t{n}", "p{n}", "d{n}", "kind{n},pg_catalog.int4"),
    ("CREATE FUNCTION f{n}(a dom{n}) RETURNS int LANGUAGE sql AS $$ SELECT g{n}(a) FROM t{n} $$", "function", "f{n}", "t{n}", "g{n}", "dom{n},pg_catalog.int4"),
    ("CREATE TYPE e{n} AS ENUM ('a', 'b')", "type", "e{n}", "", "", ""),
    ("CREATE DOMAIN d{n} AS base{n} CHECK (ok{n}(VALUE))", "domain", "d{n}", "", "ok{n}", "base{n}"),
    ("CREATE UNIQUE INDEX i{n} ON t{n} (lower_{n}(x))", "index", "i{n}", "t{n}", "lower_{n}", ""),
    ("CREATE TRIGGER tr{n} AFTER INSERT ON t{n} FOR EACH ROW EXECUTE FUNCTION fn{n}()", "trigger", "tr{n}", "t{n}", "fn{n}", ""),
    ("COMMENT ON COLUMN s.t{n}.c IS 'x; y'", "comment", "column:s.t{n}.c", "s.t{n}", "", ""),
    ("CREATE VIEW q{n} AS SELECT CASE WHEN a{n}(x) IS NULL THEN ARRAY[b{n}(y)] ELSE z::ty{n}[] END FROM (SELECT * FROM l{n} UNION ALL SELECT * FROM r{n}) k", "view", "q{n}", "l{n},r{n}", "a{n},b{n}", "ty{n}"),
]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(templates: list[tuple], columns: str, number: str = "c_custkey", rows: str = "customer") -> str:
    """The SQL of templates filled in for every row."""
    names = columns.split(", ")
    values = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in (k, *t)) + ")" for k, t in enumerate(templates))
    filled = ", ".join(f"replace({c}, '{{n}}', {number}::VARCHAR) AS {c}" if isinstance(v, str) else c for c, v in zip(names, templates[0], strict=True))
    return f"SELECT {number} AS n, k, {filled} FROM {rows} JOIN (VALUES {values}) AS t(k, {columns}) ON k = {number} % {len(templates)}"


def written(spark, d, templates: list[tuple]) -> DataFrame:
    """n and the text of one template for every customer."""
    texts = F.array(*[F.lit(t[0]) for t in templates])
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    return c.withColumn("text", F.replace(F.element_at(texts, (F.col("n") % len(templates) + 1).cast("int")), F.lit("{n}"), F.col("n").cast("string")))


def analysed(rows: DataFrame, read_one: Callable[[str], list], schema: str) -> DataFrame:
    """n and what read_one gives of each text, in Arrow batches."""
    names = [part.split(" ")[0] for part in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[part.split(" ")[1]] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(read_one, batch.column("text").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.record_batch([batch.column("n"), *[pa.array(c, k) for c, k in zip(got, kinds, strict=True)]], names=["n", *names])

    return rows.mapInArrow(work, f"n long, {schema}")


def read_definition(text: str) -> list:
    o = identify(text)
    by = {c: ",".join(str(i) for k, i in o.dependencies.rows() if k == c) for c in ("relation", "function", "type")}
    ident, on = from_state_key(o.kind, o.key)
    return [o.kind, str(o.ident), by["relation"], by["function"], by["type"], ident == o.ident and on == o.trigger_table]


@query(f"SELECT n, kind, name, relations, functions, types, true AS key_again FROM ({listed(TEMPLATES, 'ddl, kind, name, relations, functions, types')})")
def object_identity(spark, d):
    return analysed(written(spark, d, TEMPLATES), read_definition, "kind string, name string, relations string, functions string, types string, key_again boolean")


#: A file, and of its statements the number, the first line of the last, and the first words of the last.
FILES = [
    ("-- head\nSELECT 1;\n\nSELECT ';' /* ; */, {n};", 2, 4, "SELECT ';' /* ; */, {n}"),
    ("CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS $b$ SELECT 1; SELECT 2; $b$;\nDROP TABLE t{n}", 2, 2, "DROP TABLE t{n}"),
    ("SELECT \"a;b\" FROM x{n};;\n;", 1, 1, "SELECT \"a;b\" FROM x{n}"),
    ("INSERT INTO t VALUES (E'it\\'s; {n}');\nUPDATE t\nSET a = 1;\nDELETE FROM t{n}", 3, 4, "DELETE FROM t{n}"),
]


def read_file(text: str) -> list:
    found = split_statements(text)
    return [len(found), found[-1].start_line, found[-1].sql]


@query(f"SELECT n, statements::INT AS statements, line::INT AS line, last FROM ({listed(FILES, 'text, statements, line, last')})")
def statement_split(spark, d):
    return analysed(written(spark, d, FILES), read_file, "statements int, line int, last string")


#: A migration, its severity, the tables it alters, and how many labels it adds.
MIGRATIONS = [
    ("CREATE TABLE a{n} (x int); INSERT INTO a{n} VALUES (1)", "safe", "", 0),
    ("ALTER TABLE s.b{n} ADD COLUMN x int", "breaking", "s.b{n}", 0),
    ("ALTER TYPE e{n} ADD VALUE 'z'; ALTER TYPE e{n} ADD VALUE IF NOT EXISTS 'y'", "safe", "", 2),
    ("DROP TABLE c{n}; SELECT 1", "breaking", "", 0),
    ("-- nothing {n}", "safe", "", 0),
    ("CREATE TABLE g{n} (x int); DO $$ BEGIN NULL; END $$", "breaking", "", 0),
    ("TRUNCATE h{n}; DELETE FROM k{n}; ALTER TYPE e{n} ADD VALUE 'add value'", "safe", "", 1),
    ("ALTER TABLE IF EXISTS ONLY d{n} DROP COLUMN y; ALTER INDEX i{n} SET (fillfactor = 70)", "breaking", "d{n},i{n}", 0),
]


def read_migration(text: str) -> list:
    return [LABELS[rank_of_migration(text)], ",".join(sorted(altered_tables(text))), len(enum_additions(text))]


@query(f"SELECT n, severity, altered, added::INT AS added FROM ({listed(MIGRATIONS, 'text, severity, altered, added')})")
def migration_severity(spark, d):
    return analysed(written(spark, d, MIGRATIONS), read_migration, "severity string, altered string, added int")


#: Two definitions of one object, parted by ;; and the severity of the change.
UPDATES = [
    ("CREATE FUNCTION f{n}(a int) RETURNS int LANGUAGE sql AS 'SELECT 1';;CREATE FUNCTION f{n}(a int4) RETURNS integer LANGUAGE sql AS 'SELECT 2'", "transient"),
    ("CREATE FUNCTION f{n}(a int) RETURNS int LANGUAGE sql AS 'SELECT 1';;CREATE FUNCTION f{n}(a text) RETURNS int LANGUAGE sql AS 'SELECT 1'", "breaking"),
    ("CREATE TYPE e{n} AS ENUM ('a', 'b');;CREATE TYPE e{n} AS ENUM ('a', 'x', 'b')", "transient"),
    ("CREATE TYPE e{n} AS ENUM ('a', 'b');;CREATE TYPE e{n} AS ENUM ('b', 'a')", "breaking"),
    ("CREATE TYPE c{n} AS (x int, y text);;CREATE TYPE c{n} AS (x integer, y text)", "transient"),
    ("CREATE DOMAIN d{n} AS text;;CREATE DOMAIN d{n} AS int", "breaking"),
    ("CREATE AGGREGATE g{n}(int) (SFUNC = s{n}, STYPE = int8);;CREATE AGGREGATE g{n}(int) (SFUNC = z{n}, STYPE = int8)", "transient"),
    ("CREATE OPERATOR === (LEFTARG = int, RIGHTARG = int, PROCEDURE = p{n});;CREATE OPERATOR === (LEFTARG = int, RIGHTARG = text, PROCEDURE = p{n})", "breaking"),
    ("CREATE INDEX i{n} ON t (x);;CREATE INDEX i{n} ON t (y)", "safe"),
]


def read_update(text: str) -> list:
    old, new = (identify(part) for part in text.split(";;"))
    return [old.kind, LABELS[rank_of_update(old, new)]]


@query(f"SELECT n, CASE split_part(lower(text), ' ', 2) WHEN 'index' THEN 'index' ELSE split_part(lower(text), ' ', 2) END AS kind, severity FROM ({listed(UPDATES, 'text, severity')})")
def update_severity(spark, d):
    return analysed(written(spark, d, UPDATES), read_update, "kind string, severity string")


#: Statements of a migration and their severity.
STATEMENTS = [
    *[(t, "safe") for t in (
        "CREATE TABLE t{n} (x int)", "CREATE UNIQUE INDEX i{n} ON t (x)", "CREATE TEMP SEQUENCE s{n}", "COMMENT ON TABLE t{n} IS 'drop table'", "CREATE EXTENSION IF NOT EXISTS e{n}", "CREATE SCHEMA s{n}", "CREATE OR REPLACE VIEW v{n} AS SELECT 1",
        "CREATE MATERIALIZED VIEW m{n} AS SELECT 1", "CREATE TABLE c{n} AS SELECT 1", "CREATE OR REPLACE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'SELECT 1'", "CREATE PROCEDURE p{n}() LANGUAGE sql AS 'DROP TABLE x'", "CREATE CONSTRAINT TRIGGER g{n} AFTER INSERT ON t FOR EACH ROW EXECUTE FUNCTION f()",
        "CREATE TYPE e{n} AS ENUM ('a')", "CREATE TYPE c{n} AS (x int)", "CREATE DOMAIN d{n} AS int", "CREATE AGGREGATE a{n}(int) (SFUNC = f, STYPE = int)", "CREATE OPERATOR === (LEFTARG = int, RIGHTARG = int, PROCEDURE = p{n})", "INSERT INTO t VALUES ({n})", "UPDATE t SET x = {n}", "DELETE FROM t WHERE x = {n}",
        "WITH a AS (SELECT {n}) DELETE FROM t USING a", "(SELECT {n})", "COPY t{n} FROM STDIN", "SET search_path TO s{n}", "RESET ALL", "TRUNCATE t{n}", "CLUSTER t{n}", "VACUUM t{n}", "ANALYZE t{n}", "ALTER FUNCTION f{n}() OWNER TO r", "GRANT SELECT ON t{n} TO r", "ALTER TYPE s.t{n} ADD VALUE 'q' BEFORE 'p'",
    )],
    *[(t, "breaking") for t in (
        "DROP VIEW v{n}", "ALTER TABLE t{n} ADD COLUMN x int", "ALTER TABLE t{n} OWNER TO r", "ALTER TABLE t{n} RENAME TO u", "ALTER TYPE t{n} ADD ATTRIBUTE value int", "ALTER TYPE t{n} RENAME VALUE 'a' TO 'b'", "REVOKE SELECT ON t{n} FROM r", "GRANT admin{n} TO r", "DO $$ BEGIN NULL; END $$",
        "REFRESH MATERIALIZED VIEW m{n}", "REINDEX TABLE t{n}", "BEGIN", "COMMIT", "EXPLAIN SELECT {n}", "CHECKPOINT", "NOTIFY n{n}", "LISTEN n{n}", "LOCK TABLE t{n}", "SHOW search_path", "CREATE POLICY p{n} ON t", "CREATE ROLE r{n}", "CREATE RULE r{n} AS ON INSERT TO t DO NOTHING", "CREATE FOREIGN TABLE f{n} (x int) SERVER s",
        "CREATE OPERATOR CLASS c{n} FOR TYPE int USING btree AS STORAGE int", "CREATE TYPE r{n} AS RANGE (SUBTYPE = int)", "SET CONSTRAINTS ALL DEFERRED", "MERGE INTO t USING u ON a = b WHEN MATCHED THEN DELETE", "CALL p{n}()", "this is no SQL {n} '", "THIS IS NOT SQL {n}", "SELECT (({n})",
    )],
]


@query(f"SELECT n, severity FROM ({listed(STATEMENTS, 'text, severity')})")
def statement_severity(spark, d):
    return analysed(written(spark, d, STATEMENTS), lambda text: [LABELS[rank_of_statement(text)]], "severity string")


#: Definitions, and their kind, signature or operand types, result, and labels, fields or base.
DECLARED = [
    ("CREATE FUNCTION f{n}(a int, b text DEFAULT 'x', OUT c bool) RETURNS bool LANGUAGE sql AS 'SELECT true'", "function", "f{n}(pg_catalog.int4, text)", "bool", ""),
    ("CREATE PROCEDURE s.p{n}(INOUT a kind{n}) LANGUAGE sql AS 'SELECT 1'", "procedure", "s.p{n}(kind{n})", "", ""),
    ("CREATE TYPE e{n} AS ENUM ('a', 'b{n}')", "type", "", "", "a,b{n}"),
    ("CREATE TYPE c{n} AS (x int, y t{n})", "type", "", "", "x pg_catalog.int4,y t{n}"),
    ("CREATE DOMAIN d{n} AS base{n}", "domain", "", "", "base{n}"),
    ("CREATE OPERATOR === (LEFTARG = l{n}, RIGHTARG = r{n}, PROCEDURE = p{n})", "operator", "l{n} r{n}", "", "p{n}"),
]


@query(f"SELECT kind, signature, result, declared FROM ({listed(DECLARED, 'text, kind, signature, result, declared')})")
def catalog_rows(spark, d):
    rows = catalog_of(written(spark, d, DECLARED).withColumnRenamed("text", "ddl"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(" ", f["name"], f["type"])), ",")
    return rows.select(F.col("object_type").alias("kind"), empty(F.coalesce("signature", F.nullif(F.concat_ws(" ", "left_type", "right_type"), F.lit("")))).alias("signature"), empty(F.nullif("returns", F.lit(""))).alias("result"), empty(F.coalesce(F.array_join("labels", ","), fields, "base", "procedure")).alias("declared"))


#: Texts that cannot be read, and why.
BROKEN = [("SELECT 'open {n}", "unterminated string"), ("SELECT $a$ {n}", "unterminated dollar-quoted string"), ("/* {n}", "unterminated /* comment"), ("CREATE INDEX ON t{n} (x)", "an index without a name"), ("COMMENT ON SCHEMA s{n} IS 'x'", "comments on schema are not supported"), ("VACUUM t{n}", "not managed")]


def read_broken(text: str) -> list:
    try:
        return ["not managed" if identify(text) is None else "managed"]
    except (SqlSyntaxError, IdentificationError) as e:
        return [str(e)]


@query(f"SELECT n, problem FROM ({listed(BROKEN, 'text, problem')})")
def unreadable_definitions(spark, d):
    return analysed(written(spark, d, BROKEN), read_broken, "problem string")


@query("""SELECT c_custkey AS n, 3::INT AS line, (length('  , ') + length(c_custkey::VARCHAR) + 1)::INT AS col, '"' || replace('q"' || c_custkey, '"', '""') || '"' AS quoted_name, 'select 1,' || chr(10) || 'x' || c_custkey AS stored FROM customer""")
def places_and_spellings(spark, d):
    def one(text: str) -> list:
        n = text.strip()
        body = f"select 1,\n\n  , {n}!"
        return [*line_and_column(body, body.index("!")), quoted(f'q"{n}'), normalized(f"  select 1,  \n\n   x{n}  ")]

    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("text"))
    return analysed(rows, one, "line int, col int, quoted_name string, stored string")


@query("SELECT c_custkey AS n, (c_custkey % 5 = 0) AS doubled, CASE WHEN c_custkey % 5 = 0 THEN 'it''s ' || c_custkey ELSE 'x' || c_custkey END AS text FROM customer")
def literal_bodies(spark, d):
    from ..functions.sqltext import tokens

    def one(text: str) -> list:
        n = int(text)
        body = next(iter(tokens(f"'it''s {n}'" if n % 5 == 0 else f"$t$x{n}$t$"))).body
        return [n % 5 == 0, body]

    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("text"))
    return analysed(rows, one, "doubled boolean, text string")


@query("SELECT p_partkey, round(p_size * 2.5 + 1, 6)::DOUBLE AS scaled, power(p_size, 2)::DOUBLE AS squared, (SELECT count(*) FROM region WHERE r_regionkey < p_size % 5) AS below, abs(p_size - 25)::INT AS distance FROM part")
def functions_from_definitions(spark, d):
    """Scalar functions, one with a query inside, and an operator, made from their CREATE statements."""
    from .applying import Executor

    run = Executor(spark)
    read(spark, d, "region").createOrReplaceTempView("marlstone_region")
    for ddl in (
        "CREATE FUNCTION marlstone_scaled(x float8) RETURNS float8 LANGUAGE sql AS $$ SELECT x * 2.5 + 1 $$",
        "CREATE FUNCTION marlstone_squared(x float8) RETURNS float8 LANGUAGE sql AS $$ SELECT x ^ 2 $$",
        "CREATE FUNCTION marlstone_below(k int4) RETURNS int8 LANGUAGE sql AS $$ SELECT count(*) FROM marlstone_region WHERE r_regionkey < k $$",
        "CREATE FUNCTION marlstone_distance(a int4, b int4) RETURNS int4 LANGUAGE sql AS $$ SELECT abs(a - b) $$",
        "CREATE OPERATOR <-> (LEFTARG = int4, RIGHTARG = int4, PROCEDURE = marlstone_distance)",
    ):
        assert run.create(ddl), ddl
    size = F.col("p_size").cast("int")
    call = F.call_function
    made = read(spark, d, "part").select("p_partkey", size.alias("size"), F.round(call("marlstone_scaled", size.cast("double")), 6).alias("scaled"), call("marlstone_squared", size.cast("double")).alias("squared"), run.applied("<->", size, F.lit(25)).alias("distance"))
    made.createOrReplaceTempView("marlstone_sizes")
    return spark.sql("SELECT p_partkey, scaled, squared, marlstone_below(size % 5) AS below, distance FROM marlstone_sizes")
