"""Plans, applies and watching on small trees."""

import random
import time

import pytest

from marlstone.cli import main, new_migration, settings
from marlstone.functions.lint import lint
from marlstone.functions.identify import identify
from marlstone.functions.tap import parse_tap
from marlstone.operators import graph, severity
from marlstone.plans.applying import ApplyError, apply
from marlstone.plans.planning import PlanError, content_checksum, make_plan, pending_changes
from marlstone.sources.scan import read_files
from marlstone.sources.state import LockLost, LockTimeout, StateStore
from marlstone.sources.changes import compared, listed
from marlstone.streaming.watch import impacted_tests, process, routed, run_test


@pytest.fixture
def tree(tmp_path, spark):
    spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0)], "id int, name string, amount double").createOrReplaceTempView("items")
    code = tmp_path / "sql"
    code.mkdir()
    (code / "a_top.sql").write_text("CREATE VIEW top AS SELECT name, doubled FROM base WHERE doubled > 10;\nCOMMENT ON VIEW top IS 'x';")
    (code / "b_base.sql").write_text("CREATE VIEW base AS SELECT id, name, twice(amount) AS doubled FROM items;")
    (code / "c_fn.sql").write_text("CREATE FUNCTION twice(x float8) RETURNS float8 LANGUAGE sql AS $$ SELECT x * 2 $$;\nINSERT INTO log VALUES (1);")
    (code / "top.test.sql").write_text("SELECT CASE WHEN count(*) = 1 THEN 'ok 1 - one' ELSE 'not ok 1 - one' END FROM top;")
    return code, StateStore(spark, str(tmp_path / "state"))


def test_life_of_a_project(spark, tree):
    code, store = tree
    plan = make_plan(spark, store, str(code))
    assert [(c.type, c.object_type) for c in plan.changes] == [("create", "view"), ("create", "comment"), ("create", "view"), ("create", "function")]
    assert plan.worst == "safe" and len(plan.problems) == 1 and "skipped insert" in plan.problems[0]
    result = apply(spark, store, str(code), development=True)
    assert result.objects_created.index("twice") < result.objects_created.index("base") < result.objects_created.index("top")
    assert [tuple(r) for r in spark.table("top").collect()] == [("b", 14.0)]
    assert make_plan(spark, store, str(code)).changes == [] and "object_loaded" in [e["channel"] for e in store.emitted()]
    assert run_test(spark, (code / "top.test.sql").read_text()).passed == 1
    assert [f.rsplit("/", 1)[-1] for f in impacted_tests(spark, str(code), [("view", "top")])] == ["top.test.sql"]

    before = listed(str(code))
    (code / "b_base.sql").write_text("CREATE VIEW base AS SELECT id, name, twice(amount) + 100 AS doubled FROM items;")
    assert compared(before, listed(str(code))) == [(str(code / "b_base.sql"), "changed")]
    batch = process(spark, store, str(code), routed({str(code / "b_base.sql")}, "migrations"))
    assert {(c.name, c.reason) for c in batch.plan.changes} == {("base", None), ("top", "Dependency requires recreation"), ("view:top", "Dependency requires recreation")}
    assert batch.plan.worst == "transient" and len(batch.impacted) == 1 and spark.table("top").count() == 2

    (code / "b_base.sql").unlink()
    with pytest.raises(PlanError, match="view::base by view::top"):
        make_plan(spark, store, str(code))
    (code / "a_top.sql").unlink()
    assert sorted(apply(spark, store, str(code)).objects_deleted) == ["base", "top", "view:top"]
    assert not spark.catalog.tableExists("top") and make_plan(spark, store, str(code)).changes == []


def test_a_failed_apply_changes_nothing(spark, tree):
    code, store = tree
    apply(spark, store, str(code))
    published = store.current
    (code / "b_base.sql").write_text("CREATE VIEW base AS SELECT id, name, amount AS doubled FROM items;")
    (code / "d.sql").write_text("CREATE VIEW zz AS SELECT nothing FROM base;")
    with pytest.raises(ApplyError):
        apply(spark, store, str(code))
    assert store.current == published and [tuple(r) for r in spark.table("top").collect()] == [("b", 14.0)]
    assert store.emitted()[-1]["channel"] == "apply_failed"


def test_migrations_and_duplicates(spark, tree, tmp_path):
    code, store = tree
    folder = tmp_path / "migrations"
    new_migration(str(folder), "one").write_text("CREATE OR REPLACE TEMPORARY VIEW extra AS SELECT 1 AS x;")
    result = apply(spark, store, str(code), str(folder))
    assert len(result.migrations_applied) == 1 and make_plan(spark, store, str(code), str(folder)).changes == []
    new_migration(str(folder), "two").write_text("ALTER TABLE items ADD COLUMN y int;")
    plan = make_plan(spark, store, str(code), str(folder))
    assert ("base", "Migration alters dependent table") in {(c.name, c.reason) for c in plan.changes} and plan.changes[0].rank == severity.BREAKING
    (code / "e.sql").write_text("CREATE TABLE base (x int);")
    with pytest.raises(PlanError, match="more than once"):
        make_plan(spark, store, str(code))
    (code / "e.sql").write_text("CREATE PROCEDURE twice(x float8) LANGUAGE sql AS $$ SELECT 1 $$;")
    with pytest.raises(PlanError, match="more than once"):
        make_plan(spark, store, str(code), str(folder))
    assert pending_changes(spark, store, str(code), str(folder)) == (True, 2)  # a migration and a procedure
    before = content_checksum(read_files(spark, str(code)))
    (code / "e.sql").unlink()
    assert content_checksum(read_files(spark, str(code))) != before
    with pytest.raises(ValueError, match="letters"):
        new_migration(str(folder), "a b")


def test_lock(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    with store.lock():
        began = time.monotonic()
        with pytest.raises(LockTimeout), store.lock(0.3, 0.1):
            pass
        assert 0.3 <= time.monotonic() - began < 1
    with store.lock(0.1):
        pass
    (tmp_path / "LOCK").write_text("of a run on another machine")
    with pytest.raises(LockTimeout), store.lock(0.2, 0.05, lease=5):
        pass
    with store.lock(5, 0.05, lease=0.3):  # not renewed: taken over
        assert store.owned(store.held)
        other = StateStore(spark, str(tmp_path))
        with pytest.raises(LockTimeout), other.lock(1, 0.05, lease=0.3):  # renewed
            pass
        store.publish({})
        (tmp_path / "LOCK").unlink()
        (tmp_path / "LOCK").write_text("someone else")
        published = store.current
        with pytest.raises(LockLost):
            store.publish({})
    assert store.current == published and (tmp_path / "LOCK").read_text() == "someone else"


def test_the_gate_reads_what_was_made_and_its_callers(spark, tmp_path):
    code, store = tmp_path / "sql", StateStore(spark, str(tmp_path / "state"))
    code.mkdir()
    one = "CREATE FUNCTION gate_twice(x float8) RETURNS float8 LANGUAGE sql AS $$ SELECT x * 2 $$;"
    (code / "a.sql").write_text(one)
    (code / "b.sql").write_text("CREATE FUNCTION gate_quad(x float8) RETURNS float8 LANGUAGE sql AS $$ SELECT gate_twice(gate_twice(x)) $$;")
    assert len(apply(spark, store, str(code), development=True, gate=True).objects_created) == 2
    assert store.hash_of("function", "gate_twice") and store.hash_of("function", "nothing") is None
    published = store.current
    (code / "a.sql").write_text(one.replace("x float8", "x float8, y float8"))
    with pytest.raises(ApplyError, match="gate_quad"):  # a caller that is not made again
        apply(spark, store, str(code), development=True, gate=True)
    (code / "a.sql").write_text(one.replace("SELECT x * 2", "SELECT x * 2; SELECT nope"))
    with pytest.raises(ApplyError, match="nope"):
        apply(spark, store, str(code), development=True, gate=True)
    assert store.current == published and [r[0] for r in spark.sql("SELECT gate_quad(1.5D)").collect()] == [6.0]
    assert apply(spark, store, str(code), development=True).objects_updated == ["gate_twice"]


def test_severity_matrix():
    rank = lambda a, b: severity.rank_of_update(identify(a), identify(b))
    f = "CREATE FUNCTION f(a int, b int) RETURNS int LANGUAGE sql AS $$ SELECT 1 $$"
    assert rank(f, f.replace("SELECT 1", "SELECT 2")) == severity.TRANSIENT and rank(f, f.replace("integer", "int")) == severity.TRANSIENT
    assert rank(f, f.replace("RETURNS int", "RETURNS text")) == rank(f, f.replace("b int)", "b int, c int)")) == rank(f, f.replace("(a", "(z")) == severity.BREAKING
    assert rank("CREATE TYPE m AS ENUM ('a', 'b')", "CREATE TYPE m AS ENUM ('a', 'x', 'b')") == severity.TRANSIENT
    assert rank("CREATE TYPE m AS ENUM ('a', 'b')", "CREATE TYPE m AS ENUM ('b')") == severity.BREAKING
    assert rank("CREATE TYPE p AS (x int)", "CREATE TYPE p AS (x integer)") == severity.TRANSIENT and rank("CREATE TYPE p AS (x int)", "CREATE TYPE p AS (x int, y int)") == severity.BREAKING
    assert rank("CREATE DOMAIN d AS varchar(5)", "CREATE DOMAIN d AS varchar(9)") == severity.TRANSIENT
    assert severity.rank_of_migration("CREATE TABLE a (x int); ALTER TYPE m ADD VALUE 'c'; GRANT SELECT ON a TO b") == severity.SAFE
    assert severity.rank_of_migration("DROP TABLE a") == severity.rank_of_migration("SELECT 'x") == severity.BREAKING and severity.rank_of_migration("") == severity.SAFE
    assert severity.enum_additions("ALTER TYPE m ADD VALUE 'c';") == [("ALTER TYPE m ADD VALUE 'c'", "ALTER TYPE m ADD VALUE IF NOT EXISTS 'c'")]


def test_graphs_against_plain_python(spark):
    rng = random.Random(8)
    for acyclic in (True, False):
        pairs = {(a, b) for a, b in ((rng.randrange(15), rng.randrange(15)) for _ in range(28)) if a < b or not acyclic and a != b}
        edges = spark.createDataFrame([(a, b, "soft" if (a + b) % 4 == 0 else "hard") for a, b in sorted(pairs)], "src long, dst long, kind string")
        nodes = spark.range(15).withColumnRenamed("id", "node")
        seen, todo = {3}, [3]
        while todo:
            a = todo.pop()
            for x, y in pairs:
                if x == a and (x + y) % 4 and y not in seen:
                    seen.add(y)
                    todo.append(y)
        for most in (0, graph.FEW):
            assert {r.node for r in graph.closure(edges, nodes.filter("node = 3"), most_local=most).collect()} == seen - {3}
        if acyclic:
            level = {r.node: r.level for r in graph.levels(nodes, edges, most_local=0).collect()}
            assert level == {r.node: r.level for r in graph.levels(nodes, edges).collect()}
            assert all(level[a] < level[b] for a, b in pairs) and all(level[b] == max([level[a] + 1 for a, c in pairs if c == b], default=0) for b in range(15))
    ring = spark.createDataFrame([(1, 2, "hard"), (2, 1, "soft")], "src long, dst long, kind string")
    assert graph.has_cycle(spark.range(1, 3).withColumnRenamed("id", "node"), ring)


def test_small_parts(spark, tmp_path, monkeypatch, capsys):
    out = parse_tap(["1..4", "ok 1 - fine", "not ok 2 - bad\n# why\n# more", "ok 3 # SKIP later"])
    assert (out.run, out.passed, out.failed, out.skipped) == (3, 1, 1, 1) and out.failures == [{"description": "bad", "diagnostics": ["why", "more"]}]
    found = lint(spark, identify("CREATE FUNCTION f() RETURNS int LANGUAGE sql AS $$ SELECT nope FROM range(3) $$"))
    assert len(found) == 1 and found[0].level == "error"
    assert "dashed" in graph.dot(["view::a", "table::b"], [("table::b", "view::a", "soft")])
    monkeypatch.chdir(tmp_path)
    assert main(["init"]) == 0 and settings(code_dir="x")["code_dir"] == "x" and settings()["state_dir"] == ".marlstone"
