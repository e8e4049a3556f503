"""Catalog rows of recorded definitions, clones of states, and comments that go with what they are on."""

import pytest

from marlstone.operators import severity
from marlstone.plans.applying import apply, comment_keys
from marlstone.plans.planning import content_checksum, make_plan, prepared
from marlstone.sources import catalog
from marlstone.sources.scan import read_files
from marlstone.sources.state import StateStore

FILES = {
    "f.sql": "CREATE FUNCTION cat_sum(a int, b int DEFAULT 1) RETURNS int LANGUAGE sql AS $$ SELECT a + b $$;\nCREATE FUNCTION s.cat_other(x text) RETURNS text LANGUAGE sql AS $$ SELECT x $$;\nCREATE FUNCTION cat_text(a int, b int) RETURNS text LANGUAGE sql AS $$ SELECT 'x' $$;",
    "t.sql": "CREATE TYPE cat_mood AS ENUM ('low', 'high');\nCREATE TYPE cat_pair AS (x int, y text);\nCREATE DOMAIN cat_name AS varchar(20);\nCOMMENT ON COLUMN cat_pair.x IS 'first';\nCOMMENT ON TYPE cat_pair IS 'two';",
    "o.sql": "CREATE OPERATOR +++ (LEFTARG = int, RIGHTARG = int, PROCEDURE = cat_sum);\nCREATE AGGREGATE cat_agg(int) (SFUNC = cat_sum, STYPE = int);",
}


@pytest.fixture
def project(spark, tmp_path):
    code = tmp_path / "sql"
    code.mkdir()
    for name, text in FILES.items():
        (code / name).write_text(text)
    return code, StateStore(spark, f"{tmp_path}/state")


def test_lookups(spark, project):
    code, store = project
    apply(spark, store, str(code))
    rows = store.table("catalog")
    assert catalog.signatures(rows, "cat_sum") == ["cat_sum(pg_catalog.int4, pg_catalog.int4)"] and catalog.signatures(rows, "cat_agg") == ["cat_agg(pg_catalog.int4)"]
    assert catalog.signatures(rows, "cat_other", "s") == ["s.cat_other(text)"] and catalog.signatures(rows, "cat_other") == []
    assert catalog.result_type(rows, "cat_sum") == "pg_catalog.int4" and catalog.result_type(rows, "nothing") is None
    assert catalog.enum_labels(rows, "cat_mood") == ["low", "high"] and catalog.enum_labels(rows, "cat_pair") is None
    assert catalog.composite_fields(rows, "cat_pair") == [("x", "pg_catalog.int4"), ("y", "text")] and "varchar" in catalog.domain_base(rows, "cat_name")
    assert catalog.operator_signatures(rows, "+++") == [("pg_catalog.int4", "pg_catalog.int4", "pg_catalog.int4")]
    plan = catalog.entries(rows, ("function",), "cat_sum")._jdf.queryExecution().toString()
    assert "EqualTo(name,cat_sum)" in plan and "EqualTo(object_type,function)" in plan

    (code / "f.sql").write_text(FILES["f.sql"].replace("cat_sum(a int, b int DEFAULT 1)", "cat_sum(a int, b int, c int)"))
    (code / "o.sql").write_text(FILES["o.sql"].replace("PROCEDURE = cat_sum", "PROCEDURE = cat_text"))
    ranks = {c.name: c.rank for c in make_plan(spark, store, str(code)).changes}
    assert ranks["+++"] == severity.BREAKING  # another result
    apply(spark, store, str(code))
    assert catalog.signatures(store.table("catalog"), "cat_sum") == ["cat_sum(pg_catalog.int4, pg_catalog.int4, pg_catalog.int4)"]
    assert catalog.operator_signatures(store.table("catalog"), "+++")[0][2] == "text"

    keys = lambda: {r.object_name for r in store.table("state").filter("object_type = 'comment'").collect()}
    assert keys() == {"column:cat_pair.x", "type:cat_pair"}
    (code / "t.sql").write_text(FILES["t.sql"].split("CREATE TYPE cat_pair")[0])
    apply(spark, store, str(code))
    assert keys() == set() and catalog.composite_fields(store.table("catalog"), "cat_pair") is None and catalog.enum_labels(store.table("catalog"), "cat_mood") == ["low", "high"]


def test_clones_share_snapshots(spark, project, tmp_path):
    code, _ = project
    built = []

    def build(store):
        built.append(store)
        apply(spark, store, str(code))

    first, there = prepared(spark, f"{tmp_path}/templates", f"{tmp_path}/one", str(code), build)
    second, again = prepared(spark, f"{tmp_path}/templates", f"{tmp_path}/two", str(code), build)
    assert (there, again, len(built)) == (False, True, 1) and make_plan(spark, first, str(code)).changes == []
    (code / "more.sql").write_text("CREATE DOMAIN cat_more AS int;")
    apply(spark, second, str(code))
    assert second.hash_of("domain", "cat_more") and first.hash_of("domain", "cat_more") is None and built[0].hash_of("domain", "cat_more") is None
    assert not list((tmp_path / "one").glob("snapshot-*")) and len(list((tmp_path / "two").glob("snapshot-*"))) == 1
    with pytest.raises(ValueError, match="already"):
        first.clone(f"{tmp_path}/two")
    with pytest.raises(ValueError, match="no state"):
        StateStore(spark, f"{tmp_path}/none").clone(f"{tmp_path}/three")
    before = content_checksum(read_files(spark, str(code)))
    (code / "more.sql").rename(code / "other.sql")
    assert content_checksum(read_files(spark, str(code))) != before
    assert prepared(spark, f"{tmp_path}/templates", f"{tmp_path}/four", str(code), build)[1] is False and len(built) == 2


def test_comments_of_triggers():
    assert comment_keys("trigger", "trg:public.t") == [("trigger:trg:public.t",), ("trigger:trg:t",)] and comment_keys("trigger", "trg:t") == [("trigger:trg:t",), ("trigger:trg:public.t",)]
    assert comment_keys("trigger", "trg:s.t") == [("trigger:trg:s.t",)] and comment_keys("type", "a.b") == [("type:a.b",)]
