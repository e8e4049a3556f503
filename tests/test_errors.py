"""Errors with their place, a mark and a hint."""

import pytest
from pyspark.errors import AnalysisException

from marlstone.cli import seed
from marlstone.functions.errors import chain, excerpt, hint_of, offset_of, relative, told
from marlstone.plans.applying import MigrationError, migrate


def failed(spark, sql):
    with pytest.raises(AnalysisException) as e:
        spark.sql(sql)
    return e.value


def test_places(spark, tmp_path):
    sql = "SELECT id,\n  nothing_here\nFROM range(3)"
    e = failed(spark, sql)
    assert offset_of(e, sql) == sql.index("nothing_here") and "column" in hint_of(e)
    lines = told(e, sql, f"file://{tmp_path}/m/1.sql", 5, str(tmp_path)).split("\n")
    assert lines[0].startswith("m/1.sql:6:3: [UNRESOLVED_COLUMN") and lines[1:3] == ["    nothing_here", "    ^"] and lines[3].startswith("hint: ")
    assert offset_of(e, "SELECT nothing_here, nothing_here") is None and offset_of(ValueError("x"), "x") is None and hint_of(ValueError("x")) is None
    assert told(ValueError("plain\nmore"), "SELECT 1", None, 7) == "7: plain"
    assert excerpt("a" * 500 + "X" + "b" * 500, 500).split("\n")[0].strip()[79] == "X"
    assert relative("s3://a/b", "/x") == "s3://a/b" and relative("/y/z.sql", "/x") == "/y/z.sql" and relative("file:/x/y.sql", "/x") == "y.sql"
    try:
        try:
            raise ValueError("inner")
        except ValueError as inner:
            raise RuntimeError("outer\nmore") from inner
    except RuntimeError as outer:
        assert chain(outer) == "outer\n  caused by: inner"


def test_migrations_and_seeds_tell_where(spark, tmp_path):
    with pytest.raises(MigrationError) as e:
        migrate(spark, "m1", "SELECT 1;\n\nCREATE OR REPLACE TEMPORARY VIEW err_v AS\nSELECT id, missing_one FROM range(2);", None)
    assert (e.value.statement, e.value.line) == (2, 3) and "4:12: [UNRESOLVED_COLUMN" in str(e.value) and "           ^" in str(e.value)
    (tmp_path / "a.sql").write_text("SELECT 1;\nSELECT * FROM err_not_there;")
    with pytest.raises(RuntimeError, match=r"a\.sql:2:15: \[TABLE_OR_VIEW_NOT_FOUND"):
        seed(spark, str(tmp_path))
