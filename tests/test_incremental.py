"""A changed file is the only one that is opened and parsed; changes and deletions arrive as a stream, also those made while it was down."""

import os
import time

import pytest

from marlstone.plans.applying import apply
from marlstone.plans.planning import PlanError, make_plan, pending_changes
from marlstone.sources import parsed as parsed_module
from marlstone.sources.changes import COLUMNS, Reader, TreeChanges, compared
from marlstone.sources.parsed import ParsedStore
from marlstone.sources.scan import scan_objects
from marlstone.sources.state import StateStore
from marlstone.streaming.watch import watched


@pytest.fixture
def tree(tmp_path):
    code = tmp_path / "sql"
    (code / "sub dir").mkdir(parents=True)
    for k in range(12):
        (code / f"v{k:02d}.sql").write_text(f"-- view {k}\nCREATE VIEW inc_v{k} AS SELECT {k} AS x FROM {'inc_v%d' % (k - 1) if k else 'inc_base'};\nCOMMENT ON VIEW inc_v{k} IS 'number {k}';")
    (code / "sub dir" / "f[1].sql").write_text("CREATE FUNCTION inc_f() RETURNS int LANGUAGE sql AS 'SELECT 1';")
    (code / "empty.sql").write_text("")
    (code / "broken.sql").write_text("SELECT 'open")
    (code / "x.test.sql").write_text("SELECT 'ok 1';")
    return code


def same(spark, store, code):
    """Rows of the store and of a whole scan are equal; what the store read."""
    columns = scan_objects(spark, str(code)).columns
    got, want = (sorted(map(str, df.select(columns).collect())) for df in (store.rows(str(code)), scan_objects(spark, str(code))))
    assert got == want
    return store.last.files, store.last.opened, store.last.parsed


def test_only_changes_are_parsed(spark, tree, tmp_path, monkeypatch):
    store = ParsedStore(spark, f"{tmp_path}/parsed")
    assert same(spark, store, tree) == (14, 14, 14)  # Spark lists no empty files
    assert same(spark, store, tree) == (14, 0, 0)
    (tree / "v03.sql").write_text("CREATE VIEW inc_v3 AS SELECT 'changed' AS x FROM inc_v2;")
    (tree / "copy.sql").write_text((tree / "v05.sql").read_text())  # opened, but its content is known
    (tree / "v11.sql").unlink()
    assert same(spark, store, tree) == (14, 2, 1)
    (tree / "v03.sql").rename(tree / "moved.sql")
    assert same(spark, ParsedStore(spark, f"{tmp_path}/parsed"), tree)[1:] == (1, 0)
    monkeypatch.setattr(parsed_module, "MOST_PARTS", 1)
    monkeypatch.setattr(parsed_module, "MOST_PATHS", 1)
    for k in range(3):
        (tree / "v00.sql").write_text(f"CREATE VIEW inc_v0 AS SELECT {100 + k} AS x FROM inc_base;")
        (tree / "v01.sql").write_text(f"CREATE VIEW inc_v1 AS SELECT {100 + k} AS x FROM inc_base;")
        assert same(spark, store, tree)[1:] == (2, 2)
    assert len(os.listdir(f"{tmp_path}/parsed/files")) == 1


def test_plans_are_equal(spark, tree, tmp_path):
    spark.range(1).createOrReplaceTempView("inc_base")
    state, store = StateStore(spark, f"{tmp_path}/state"), ParsedStore(spark, f"{tmp_path}/parsed")
    told = lambda p: ([c.json() for c in p.changes], p.problems, sorted(map(str, p.edges.collect())))
    assert told(make_plan(spark, state, str(tree), parsed=store)) == told(make_plan(spark, state, str(tree)))
    apply(spark, state, str(tree))
    (tree / "v04.sql").write_text("CREATE VIEW inc_v4 AS SELECT 44 AS x FROM inc_v3;")
    plan = make_plan(spark, state, str(tree), parsed=store)
    assert store.last.parsed == 1 and told(plan) == told(make_plan(spark, state, str(tree)))
    assert sorted(c.name for c in plan.changes if c.reason is None) == ["inc_v4", "view:inc_v4"] and pending_changes(spark, state, str(tree), parsed=store) == (True, 2)
    (tree / "cut.sql").write_text("CREATE VIEW fine AS SELECT 1;\nCREATE FUNCTION")
    with pytest.raises(PlanError, match="cannot be read: CREATE FUNCTION"):
        make_plan(spark, state, str(tree), parsed=store)


def settle(query, what, seconds=60):
    end = time.monotonic() + seconds
    while not what():
        if query.exception():
            raise query.exception()
        assert time.monotonic() < end, "nothing came"
        time.sleep(0.1)


def test_changes_arrive_and_survive_a_restart(spark, tree, tmp_path):
    spark.dataSource.register(TreeChanges)
    got = []

    def start():
        rows = spark.readStream.format("tree_changes").option("path", str(tree)).option("snapshots", f"{tmp_path}/snapshots").option("files_per_partition", 2).load()
        keep = lambda df, n: got.extend((r.path.rsplit("/", 1)[-1], r.change, r.text) for r in df.collect())
        return rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="100 milliseconds").start()

    query = start()
    settle(query, lambda: (tmp_path / "snapshots" / "snapshot-0000000000.json").exists())
    (tree / "v00.sql").write_text("SELECT 1")
    (tree / "new.sql").write_text("é")
    (tree / "note.txt").write_text("no")
    (tree / "v01.sql").unlink()
    settle(query, lambda: len(got) >= 3)
    query.stop()
    assert sorted(got) == [("new.sql", "created", "é"), ("v00.sql", "changed", "SELECT 1"), ("v01.sql", "deleted", None)]
    got.clear()
    (tree / "v02.sql").unlink()
    (tree / "v03.sql").write_text("")
    query = start()
    settle(query, lambda: len(got) >= 2)
    query.stop()
    assert sorted(got) == [("v02.sql", "deleted", None), ("v03.sql", "changed", "")]


def test_a_burst_is_one_snapshot(tree, tmp_path):
    reader = Reader({"path": str(tree), "snapshots": f"{tmp_path}/s", "debounce": "0.4"})
    assert reader.initialOffset() == {"n": 0} == reader.latestOffset()
    (tree / "v00.sql").write_text("a")
    assert reader.latestOffset() == {"n": 0}
    time.sleep(0.25)
    (tree / "v01.sql").write_text("b")
    assert reader.latestOffset() == {"n": 0}
    time.sleep(0.25)
    assert reader.latestOffset() == {"n": 0}  # it changed since
    time.sleep(0.25)
    assert reader.latestOffset() == {"n": 1} == reader.latestOffset()
    parts = reader.partitions({"n": 0}, {"n": 1})
    assert [r[:2] for p in parts for r in p.rows] == [(str(tree / "v00.sql"), "changed"), (str(tree / "v01.sql"), "changed")]
    (tree / "v01.sql").unlink()  # gone before it is read
    assert [(r[1], r[4]) for p in parts for r in reader.read(p)] == [("changed", "a"), ("deleted", None)]
    reader.commit({"n": 1})
    assert Reader({"path": str(tree), "snapshots": f"{tmp_path}/s"}).latestOffset() == {"n": 2}
    assert compared({}, {}) == [] and TreeChanges({}).schema() == COLUMNS


def test_watching_applies_what_changed(spark, tree, tmp_path):
    spark.range(1).createOrReplaceTempView("inc_base")
    store, batches = StateStore(spark, f"{tmp_path}/state"), []
    apply(spark, store, str(tree))
    query = watched(spark, store, str(tree), batches.append, "migrations", debounce=0.3)
    settle(query, lambda: (tmp_path / "state" / "watch" / "snapshots" / "snapshot-0000000000.json").exists())
    (tree / "v11.sql").write_text("CREATE VIEW inc_v11 AS SELECT 1111 AS x FROM inc_v10;")
    settle(query, lambda: len(batches) == 1)
    assert batches[0].error is None and sorted(batches[0].result.objects_updated) == ["inc_v11"] and batches[0].result.objects_deleted == ["view:inc_v11"]
    assert spark.table("inc_v11").first().x == 1111
    (tree / "v11.sql").unlink()
    settle(query, lambda: len(batches) == 2)
    query.stop()
    assert batches[1].result.objects_deleted == ["inc_v11"] and batches[1].error is None
