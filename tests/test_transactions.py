"""Migrations that fail leave tables as they were, those that do not leave what their statements say."""

import json

import pytest
from pyspark.errors import AnalysisException

from marlstone.plans.applying import ApplyError, apply
from marlstone.plans.transactions import CannotRun, Transaction, opened, recover
from marlstone.sources.state import LockLost, StateStore


@pytest.fixture
def shop(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for t in [r.tableName for r in spark.sql("SHOW TABLES IN shop").collect() if not r.isTemporary]:
        spark.sql(f"DROP TABLE IF EXISTS shop.{t}") if spark.catalog.getTable(f"shop.{t}").tableType != "VIEW" else spark.sql(f"DROP VIEW shop.{t}")
    rows = "(1, 'a', 10.0, 'x'), (2, 'b', 20.0, 'y'), (3, 'c', null, 'x'), (4, null, 40.0, 'y')"
    spark.sql("CREATE TABLE shop.items (id int, name string, amount double, part string) USING parquet PARTITIONED BY (part)")
    spark.sql(f"INSERT INTO shop.items VALUES {rows}")
    spark.sql(f"CREATE TABLE shop.apart (id int, name string, amount double, part string) USING parquet LOCATION '{tmp_path}/apart'")
    spark.sql(f"INSERT INTO shop.apart VALUES {rows}")
    spark.sql("CREATE VIEW shop.names AS SELECT id, name FROM shop.items")
    return spark


def content(spark):
    """Everything in the database: columns and rows of every table and view."""
    out = {}
    for r in spark.sql("SHOW TABLES IN shop").collect():
        if not r.isTemporary:
            try:
                df = spark.table(f"shop.{r.tableName}")
            except AnalysisException:  # a view of what is gone
                out[r.tableName] = "broken"
                continue
            out[r.tableName] = (sorted(df.dtypes), sorted(str(sorted(x.asDict().items())) for x in df.collect()))
    return out


STATEMENTS = [
    "INSERT INTO shop.{t} (id, name, amount, part) VALUES (5, 'e', 50.0, 'z')",
    "INSERT INTO shop.{t} SELECT id + 10, name, amount, part FROM shop.{t}",
    "UPDATE shop.{t} SET amount = amount + 1, name = upper(name) WHERE amount >= 20",
    "UPDATE shop.{t} AS i SET part = 'w' WHERE i.id IN (SELECT id FROM shop.names WHERE id = 2)",
    "UPDATE shop.{t} SET amount = 0",
    "DELETE FROM shop.{t} WHERE amount > 15",
    "DELETE FROM ONLY shop.{t} AS i USING shop.names n WHERE n.id = i.id AND n.name = 'a'",
    "DELETE FROM shop.{t}",
    "TRUNCATE TABLE shop.{t}",
    "INSERT OVERWRITE TABLE shop.{t} SELECT id, name, amount * 2, part FROM shop.{t} WHERE id < 3",
    "ALTER TABLE shop.{t} ADD COLUMN note text",
    "ALTER TABLE shop.{t} ADD COLUMN n int DEFAULT 7 NOT NULL, DROP COLUMN name",
    "ALTER TABLE shop.{t} RENAME COLUMN amount TO total",
    "ALTER TABLE shop.{t} ALTER COLUMN amount TYPE bigint USING id * 3",
    "ALTER TABLE shop.{t} RENAME TO other",
    "DROP TABLE shop.{t}",
    "DROP VIEW shop.names",
    "CREATE OR REPLACE VIEW shop.names AS SELECT 1 AS one",
    "CREATE TABLE shop.more USING parquet AS SELECT * FROM shop.{t}",
    "SET spark.sql.shuffle.partitions = 3",
    "CREATE OR REPLACE TEMPORARY VIEW passing AS SELECT 1 AS x",
]


@pytest.mark.parametrize("table", ["items", "apart"])
def test_each_statement_is_undone(shop, table):
    before, kept = content(shop), shop.conf.get("spark.sql.shuffle.partitions")
    for sql in STATEMENTS:
        work = Transaction(shop)
        work.run(sql.format(t=table))
        assert content(shop) != before or sql.startswith(("SET", "CREATE OR REPLACE TEMP")), sql
        work.rollback()
        assert content(shop) == before, sql
    assert shop.conf.get("spark.sql.shuffle.partitions") == kept and not shop.catalog.tableExists("passing")


@pytest.mark.parametrize("table", ["items", "apart"])
def test_all_at_once(shop, table, tmp_path):
    before = content(shop)
    chain = [s.format(t=table) for s in (*STATEMENTS[:4], STATEMENTS[10], "INSERT INTO shop.{t} (id, name, amount, note, part) VALUES (6, 'f', 60.0, 'new', 'q')", "DELETE FROM shop.{t} WHERE id = 11", *STATEMENTS[11:13], STATEMENTS[16], STATEMENTS[18])]
    for log in (False, True):
        work = opened(shop, tmp_path) if log else Transaction(shop)
        for sql in chain:
            work.run(sql)
        work.rollback()
        assert content(shop) == before
    work = opened(shop, tmp_path)
    for sql in chain:
        work.run(sql)
    work.commit()
    after = content(shop)
    assert set(after) == {"items", "apart", "more"} and list(tmp_path.glob("undo-*")) == []
    columns = ["id", "n", "note", "part", "total"]
    assert [c for c, _ in after[table][0]] == columns
    rows = sorted(tuple(r[c] for c in columns) for r in shop.table(f"shop.{table}").collect())
    # ids 1 to 5 and 11 to 15, amounts from 20 on plus 1, id 2 moved to part w; then 6 comes in and 11 goes
    amount = {1: 10.0, 2: 21.0, 3: None, 4: 41.0, 5: 51.0}
    part = {1: "x", 2: "y", 3: "x", 4: "y", 5: "z"}
    want = [(i + k, 7, None, part[i] if (i, k) != (2, 0) else "w", amount[i]) for i in part for k in (0, 10) if (i, k) != (1, 10)] + [(6, 7, "new", "q", 60.0)]
    assert rows == sorted(want)


def test_values_of_changes(shop):
    work = Transaction(shop)
    work.run("UPDATE shop.items SET amount = id WHERE amount IS NULL OR name IS NULL")
    work.run("DELETE FROM shop.items WHERE name > 'b'")  # null is not true: the row of a null name stays
    assert sorted((r.id, r.name, r.amount) for r in shop.table("shop.items").collect()) == [(1, "a", 10.0), (2, "b", 20.0), (4, None, 4.0)]
    work.commit()
    assert shop.table("shop.names").count() == 3
    for sql, why in (("UPDATE shop.items SET x = 1", "no column x"), ("DELETE FROM shop.items RETURNING id", "RETURNING"), ("UPDATE shop.items SET amount = n.id FROM shop.names n", "several"), ("DROP TABLE shop.nothing", "there is no"), ("ALTER TABLE shop.items ADD COLUMN id int", "already")):
        with pytest.raises(CannotRun, match=why):
            Transaction(shop).run(sql)
    work = Transaction(shop)
    work.run("DROP TABLE IF EXISTS shop.nothing")
    work.run("ALTER TABLE shop.items ADD COLUMN IF NOT EXISTS id int")
    work.run("CREATE TEMPORARY FUNCTION shop_one() RETURNS int RETURN 1")
    assert work.lasting == ["CREATE TEMPORARY FUNCTION"]


def test_a_lost_run_is_undone(shop, tmp_path):
    before = content(shop)
    work = opened(shop, tmp_path)
    for k in (0, 2, 5, 15):
        work.run(STATEMENTS[k].format(t="apart"))
    with work.log.open("a") as f:
        f.write('{"op": "swap", "na')  # cut off while writing
    assert recover(shop, tmp_path, "snapshot-0") == ["undone"] and content(shop) == before and recover(shop, tmp_path, None) == []
    work = opened(shop, tmp_path)
    work.run(STATEMENTS[5].format(t="apart"))
    work.publishing("snapshot-1")
    after = content(shop)
    assert recover(shop, tmp_path, "snapshot-1") == ["committed"]
    assert {k: v for k, v in after.items() if "__kept" not in k} == content(shop)
    # entries of statements that never ran
    work = opened(shop, tmp_path)
    work.note(op="swap", name="`shop`.`apart`", kept="`shop`.`apart__kept`", new="`shop`.`apart__new`", shared=False)
    work.note(op="made", kind="table", name="`shop`.`never`", data=f"{tmp_path}/never")
    assert json.loads(work.log.read_text().splitlines()[0])["op"] == "swap"
    assert recover(shop, tmp_path, None) == ["undone"]


def test_a_failed_migration_leaves_no_trace(shop, tmp_path):
    code, moves, store = tmp_path / "sql", tmp_path / "migrations", StateStore(shop, str(tmp_path / "state"))
    code.mkdir(), moves.mkdir()
    (code / "v.sql").write_text("CREATE VIEW shop_big AS SELECT id FROM shop.items WHERE amount > 15;")
    (moves / "1.sql").write_text("INSERT INTO shop.items VALUES (7, 'g', 70.0, 'x');")
    apply(shop, store, str(code), str(moves))
    before, published = content(shop), store.current
    (moves / "2.sql").write_text("UPDATE shop.items SET amount = 0;\nINSERT INTO shop.apart SELECT * FROM shop.items;\n\nINSERT INTO shop.missing VALUES (1);")
    with pytest.raises(ApplyError, match="migration 2, statement 3, line 4"):
        apply(shop, store, str(code), str(moves))
    assert content(shop) == before and store.current == published and list(store.folder.glob("undo-*")) == []
    (code / "w.sql").write_text("CREATE VIEW shop_wrong AS SELECT nothing FROM shop.items;")
    (moves / "2.sql").write_text("DELETE FROM shop.items WHERE id = 7; DROP TABLE shop.apart;")
    with pytest.raises(ApplyError, match="nothing"):  # an object that fails takes the migrations back too
        apply(shop, store, str(code), str(moves))
    assert content(shop) == before
    (code / "w.sql").unlink()
    assert apply(shop, store, str(code), str(moves)).migrations_applied == ["2"]
    assert set(content(shop)) == {"items", "names"} and shop.table("shop.items").count() == 4
    (moves / "3.sql").write_text("INSERT INTO shop.items VALUES (8, 'h', 80.0, 'x'); INSERT INTO shop.missing VALUES (1);")
    with pytest.raises(ApplyError):  # each statement by itself
        apply(shop, store, str(code), str(moves), transactional=False)
    assert shop.table("shop.items").count() == 5


def test_a_late_run_publishes_nothing(spark, tmp_path):
    first, second = StateStore(spark, str(tmp_path)), StateStore(spark, str(tmp_path))
    with first.lock():
        (tmp_path / "LOCK").unlink()  # taken over
        with second.lock(0.1):
            second.publish({})
            second.publish({})
        late, first.held = first.held, None  # between its look at the lock and the pointer
        with pytest.raises(LockLost, match="since"):
            first.publish({})
        first.held = late
    assert second.generation == 2 and first.current == second.current
