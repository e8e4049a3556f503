"""Splitting, hashing, identifying and reading dependencies."""

import pytest

from marlstone.functions.idents import Ident, from_state_key, state_key
from marlstone.functions.identify import IdentificationError, identify
from marlstone.functions.sqltext import SqlSyntaxError, ddl_hash, hash_text, line_and_column, normalized, split_statements


def names(idents):
    return {str(i) for i in idents}


def test_split():
    text = "-- head\nSELECT 1;\n\nCREATE FUNCTION f() RETURNS int AS $x$ BEGIN; RETURN ';'; END $x$ LANGUAGE plpgsql;;\n/* a; /* b; */ */ SELECT 'x;''y', \"q;\";\n  -- only a comment\n"
    got = split_statements(text)
    assert [s.sql.split()[0] for s in got] == ["--", "CREATE", "/*"] and [s.idx for s in got] == [0, 1, 3]
    assert [(s.start_line, s.end_line) for s in got] == [(1, 2), (4, 4), (5, 5)]
    assert all(text[s.start_pos : s.end_pos] == s.sql for s in got)
    assert split_statements(" ; ;") == [] == split_statements("")
    with pytest.raises(SqlSyntaxError):
        split_statements("SELECT 'open")


def test_atomic_body_is_one_statement():
    assert len(split_statements("CREATE FUNCTION f() RETURNS int BEGIN ATOMIC SELECT CASE WHEN true THEN 1 END; SELECT 2; END; SELECT 3")) == 2


def test_hash_and_lines():
    assert hash_text("SELECT 1 -- c\n\n  FROM T -- '--'") == "select 1 from t"
    assert ddl_hash("a\n b") == ddl_hash("A  --x\nb") != ddl_hash("a  b")
    assert normalized("  a \n\n b") == "a\nb" and line_and_column("é\nab", 3) == (2, 2)


def test_keys():
    assert state_key("trigger", Ident(None, "t"), Ident("s", "x")) == "t:s.x" and from_state_key("trigger", "t:s.x") == (Ident(None, "t"), Ident("s", "x"))
    assert from_state_key("view", "a.b") == (Ident("a", "b"), None) and Ident.parse("a.b.c") == Ident(None, "a.b.c")
    assert sorted([Ident("a", "z"), Ident(None, "z")], key=Ident.sort_key)[0].schema is None


CASES = [
    ("CREATE TABLE s.t (id SERIAL PRIMARY KEY, a app.mood NOT NULL DEFAULT f(1), b int[] REFERENCES u(id), CHECK (g(a)))", "table", "s.t", {"u"}, {"f", "g"}, {"serial", "app.mood", "pg_catalog.int4"}),
    ("CREATE OR REPLACE VIEW v AS SELECT u.a, count(*) FROM s.users u LEFT JOIN posts p ON p.id = u.id, LATERAL gen(u.x) g(y) WHERE EXISTS (SELECT 1 FROM z) AND x::my.t IS NOT NULL", "view", "v", {"s.users", "posts", "z"}, {"count", "gen"}, {"my.t"}),
    ("CREATE MATERIALIZED VIEW m AS WITH a AS (SELECT * FROM base), b(x) AS (SELECT 1 FROM a) SELECT extract(year FROM d), row_number() OVER (ORDER BY q) FROM b JOIN other USING (id)", "materialized_view", "m", {"base", "other"}, {"extract", "row_number"}, set()),
    ("CREATE FUNCTION add(a int, b numeric DEFAULT h(2)) RETURNS SETOF app.row LANGUAGE sql AS $$ SELECT * FROM t1; INSERT INTO t2 (x) SELECT k(1) $$", "function", "add", {"t1", "t2"}, {"h", "k"}, {"pg_catalog.int4", "pg_catalog.numeric", "app.row"}),
    ("CREATE FUNCTION p() RETURNS void LANGUAGE plpgsql AS $$ DECLARE v app.kind; r record; BEGIN SELECT x INTO v FROM tab WHERE y = fn(z); UPDATE other SET a = 1; PERFORM go(v); END $$", "function", "p", {"tab", "other"}, {"fn", "go"}, {"app.kind", "void"}),
    ("CREATE PROCEDURE pr(INOUT x text) LANGUAGE plpgsql AS $$ BEGIN NULL; END $$", "procedure", "pr", set(), set(), {"text"}),
    ("CREATE TYPE mood AS ENUM ('a', 'b')", "type", "mood", set(), set(), set()), ("CREATE TYPE pt AS (x int, y app.z[])", "type", "pt", set(), set(), {"pg_catalog.int4", "app.z"}),
    ("CREATE DOMAIN email AS varchar(255) CHECK (ok(VALUE))", "domain", "email", set(), {"ok"}, {"pg_catalog.varchar"}),
    ("CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS i ON s.t (lower(a))", "index", "i", {"s.t"}, {"lower"}, set()),
    ("CREATE TRIGGER tr BEFORE UPDATE ON s.t FOR EACH ROW EXECUTE FUNCTION tf()", "trigger", "tr", {"s.t"}, {"tf"}, set()),
    ("COMMENT ON COLUMN s.t.c IS 'x'", "comment", "column:s.t.c", {"s.t"}, set(), set()), ("COMMENT ON FUNCTION f(int) IS 'x'", "comment", "function:f()", set(), {"f"}, set()),
    ("COMMENT ON TRIGGER tr ON s.t IS 'x'", "comment", "trigger:tr:s.t", {"s.t"}, set(), set()), ("COMMENT ON MATERIALIZED VIEW m IS 'x'", "comment", "materialized_view:m", {"m"}, set(), set()),
    ("SELECT cron.schedule('job', '* * * * *', $$DELETE FROM log$$)", "cron_job", "job", {"log"}, set(), set()),
    ("CREATE AGGREGATE agg(numeric) (SFUNC = step, STYPE = numeric, INITCOND = '0')", "aggregate", "agg", set(), {"step"}, {"pg_catalog.numeric"}),
    ("CREATE OPERATOR <-> (LEFTARG = point, RIGHTARG = point, PROCEDURE = dist)", "operator", "<->", set(), {"dist"}, {"point"}),
]


@pytest.mark.parametrize(("sql", "kind", "ident", "relations", "functions", "types"), CASES)
def test_identify(sql, kind, ident, relations, functions, types):
    o = identify(sql)
    assert (o.kind, str(o.ident)) == (kind, ident)
    d = o.dependencies
    assert (names(d.relations), names(d.functions), names(d.types)) == (relations, functions, types)


def test_not_managed():
    assert all(identify(s) is None for s in ("SELECT 1", "INSERT INTO t VALUES (1)", "CREATE TABLE t AS SELECT 1", "GRANT ALL ON t TO u", "SELECT cron.unschedule('x')", "DROP VIEW v", "CREATE EXTENSION e"))
    for bad in ("CREATE INDEX ON t (a)", "COMMENT ON SCHEMA s IS 'x'"):
        with pytest.raises(IdentificationError):
            identify(bad)


def test_self_references():
    assert names(identify("CREATE FUNCTION f(n int) RETURNS int LANGUAGE sql AS $$ SELECT f(n) $$").dependencies.functions) == set()
    assert names(identify("CREATE TRIGGER f AFTER INSERT ON t EXECUTE FUNCTION f()").dependencies.functions) == {"f"}
