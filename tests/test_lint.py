"""Checks of PL/pgSQL bodies: columns, types, variables and returns, with places in their files."""

from dataclasses import replace

from marlstone.cli import main
from marlstone.functions.identify import identify
from marlstone.functions.lint import lint, report
from marlstone.functions.routines import fragments


def found(spark, body, head="CREATE FUNCTION lint_f(n int, t text) RETURNS int LANGUAGE plpgsql AS $$", start=10, **kw):
    o = replace(identify(f"{head}\n{body}\n$$"), start_line=start)
    return [(f.level, f.line, f.source_line, f.message.split("]")[0].strip("[")) for f in lint(spark, o, **kw)]


GOOD = """DECLARE
  total int8 := 0; name text;
BEGIN
  FOR r IN SELECT id, id * 2 AS twice FROM lint_rows WHERE id > n LOOP
    total := total + r.twice;
  END LOOP;
  FOR i IN 1..n LOOP total := total + i; END LOOP;
  SELECT 'x' || t INTO name FROM lint_rows LIMIT 1;
  IF total > 5 AND name IS NOT NULL THEN RETURN total; END IF;
  INSERT INTO lint_rows_there VALUES (total);
  RETURN n;
EXCEPTION WHEN OTHERS THEN RAISE EXCEPTION 'bad: %', sqlerrm;
END;"""


def test_bodies(spark):
    spark.range(3).createOrReplaceTempView("lint_rows")
    assert found(spark, GOOD) == []
    assert found(spark, GOOD.replace("r.twice", "r.thrice"))[0][:3] == ("error", 6, 15)
    assert found(spark, GOOD.replace("id > n", "missing > n"))[0][:3] == ("error", 5, 14)
    assert found(spark, GOOD.replace("'x' || t", "upper(t, 1)"))[0] == ("error", 9, 18, "WRONG_NUM_ARGS.WITHOUT_SUGGESTION")
    assert found(spark, GOOD.replace("INTO name FROM lint_rows", "INTO name FROM lint_gone"))[0][0] == "warning"
    assert found(spark, GOOD.replace("total > 5 AND", "total > > 5 AND"))[0][:2] == ("error", 10)
    assert found(spark, GOOD.replace("total int8 := 0;", "total int8 := 0; idle int;")) == [("warning extra", 2, 11, "unused variable idle")]
    assert found(spark, "BEGIN IF n > 1 THEN RETURN 1; END IF; END;")[0][0] == "error" and "without RETURN" in found(spark, "BEGIN IF n > 1 THEN RETURN 1; END IF; END;")[0][3]
    assert found(spark, "BEGIN OPEN c; RETURN 1; END;")[0][0] == "warning" and found(spark, "BEGIN RETURN nope; END;", analyse=False) == []
    assert found(spark, "BEGIN RETURN nope; END;", head="CREATE FUNCTION _hidden() RETURNS int LANGUAGE plpgsql AS $$") == []
    assert [f.kind for f in fragments(identify(f"CREATE PROCEDURE p(n int) LANGUAGE plpgsql AS $$ BEGIN PERFORM f(n); UPDATE t SET x = n; WHILE n > 0 LOOP n := n - 1; EXIT WHEN n = 3; END LOOP; END; $$"))] == ["query", "statement", "expression", "expression", "expression"]


def test_check_command(spark, tmp_path, monkeypatch, capsys):
    code = tmp_path / "sql"
    code.mkdir()
    (code / "a.sql").write_text("CREATE VIEW lint_top AS SELECT x FROM lint_base;")
    (code / "b.sql").write_text("CREATE VIEW lint_base AS SELECT id AS x FROM range(4);")
    monkeypatch.chdir(tmp_path)
    assert main(["check", "--code-dir", str(code)]) == 0 and "nothing found" in capsys.readouterr().out
    (code / "c.sql").write_text("-- c\nCREATE FUNCTION lint_c() RETURNS int8 LANGUAGE plpgsql AS $$\nBEGIN\n  RETURN (SELECT max(y) FROM lint_base);\nEND; $$;")
    assert main(["check", "--code-dir", str(code)]) == 1
    told = capsys.readouterr().out
    assert "error: function lint_c (line 4)" in told and "UNRESOLVED_COLUMN" in told
    assert report([]) == ""
