"""PL/pgSQL bodies as expressions and scripts, aggregates of any state function, and what is dropped with a routine."""

import pytest

from marlstone.functions.identify import identify
from marlstone.functions.routines import Untranslated, expression, replaced, script
from marlstone.operators import folding
from marlstone.plans.applying import Executor


def function(spark, body, args="n int", returns="int", declare=""):
    ddl = f"CREATE FUNCTION routine_f({args}) RETURNS {returns} LANGUAGE plpgsql AS $$ {declare} BEGIN {body} END; $$"
    return Executor(spark).create(ddl)


def values(spark, what, over="range(-3, 8)"):
    return [r[0] for r in spark.sql(f"SELECT {what} FROM {over}").collect()]


def test_bodies_that_are_expressions(spark):
    n = list(range(-3, 8))
    cases = [
        ("RETURN n * 2 + 1;", "", lambda x: 2 * x + 1),
        ("IF n > 3 THEN RETURN 1; ELSIF n < 0 THEN RETURN -1; END IF; RETURN 0;", "", lambda x: 1 if x > 3 else -1 if x < 0 else 0),
        ("y := n + 1; IF y % 2 = 0 THEN y := y * 10; n := 5; ELSE y := y - 1; END IF; RETURN y + n;", "DECLARE y int := 7;", lambda x: (x + 1) * 10 + 5 if (x + 1) % 2 == 0 else x + x),
        ("CASE n WHEN 1 THEN RETURN 11; WHEN 2 THEN y := 22; ELSE NULL; END CASE; RETURN coalesce(y, CASE WHEN n > 5 THEN 6 END, 0);", "DECLARE y int;", lambda x: 11 if x == 1 else 22 if x == 2 else 6 if x > 5 else 0),
        ("IF n > 0 THEN IF n > 5 THEN RETURN 100; END IF; y := 1; BEGIN y := y + n; END; ELSE RETURN -5; END IF; RETURN y;", "DECLARE y int DEFAULT 0;", lambda x: 100 if x > 5 else 1 + x if x > 0 else -5),
        ("IF n IS NULL OR NULL THEN RETURN 1; ELSE RETURN 2; END IF;", "", lambda x: 2),
        ("RAISE NOTICE 'n is %', n; PERFORM abs(n); SELECT n + 1, n + 2 INTO STRICT a, b; RETURN a * b;", "DECLARE a int; b int;", lambda x: (x + 1) * (x + 2)),
    ]
    for body, declare, want in cases:
        assert function(spark, body, declare=declare)
        assert values(spark, "routine_f(cast(id AS int))") == [want(x) for x in n], body
    assert function(spark, "IF n > 6 THEN RAISE EXCEPTION '% is 100%% too much', n; END IF; RETURN n;")
    with pytest.raises(Exception, match="7 is 100% too much"):
        values(spark, "routine_f(cast(id AS int))")
    assert function(spark, "RETURN n || mark;", "n int, mark text DEFAULT '!'", "text") and values(spark, "routine_f(1), routine_f(2, '?')", "range(1)") == ["1!"]
    spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", 4.0)], "category string, amount double").createOrReplaceTempView("routine_source")
    assert function(spark, "RETURN COALESCE((SELECT SUM(amount) FROM routine_source WHERE category = cat), 0);", "cat text", "numeric")
    assert sorted((r[0], float(r[1])) for r in spark.sql("SELECT DISTINCT category, routine_f(category) FROM (SELECT category FROM routine_source UNION ALL SELECT 'c')").collect()) == [("a", 3.5), ("b", 4.0), ("c", 0.0)]
    assert replaced("n + t.n + n(n) AS n, 'n'", {"n": "(x)"}) == "n + t.n + n((x)) AS n, 'n'".replace("n +", "(x) +", 1)


def test_bodies_that_are_scripts(spark):
    run = Executor(spark)
    loops = """DECLARE total int := 0; k int := 0;
    BEGIN
      FOR i IN 1..n LOOP CONTINUE WHEN i % 2 = 0; total := total + i; END LOOP;
      FOR i IN REVERSE 10..8 LOOP total := total + 100 * i; EXIT WHEN i = 9; END LOOP;
      FOR i IN 5..1 LOOP total := -1; END LOOP;
      WHILE k < 3 LOOP k := k + 1; total := total + 10000; END LOOP;
      <<outer_loop>> LOOP LOOP k := k + 1; EXIT outer_loop WHEN k > 6; END LOOP; END LOOP outer_loop;
      FOR r IN SELECT id, id * 2 AS twice FROM range(4) LOOP total := total + 1000000 * r.twice; END LOOP;
      IF total > 0 THEN RETURN total + k; END IF;
      RETURN 0;
    END;"""
    ddl = f"CREATE FUNCTION routine_loops(n int) RETURNS int LANGUAGE plpgsql AS $$ {loops} $$"
    assert run.create(ddl)
    assert run.call("CALL routine_loops(5)").collect()[0][0] == 9 + 1900 + 30000 + 12 * 1000000 + 7
    with pytest.raises(Untranslated, match="no expression"):
        expression(identify(ddl))
    assert run.create("CREATE FUNCTION routine_safe(a int, b int) RETURNS int LANGUAGE plpgsql AS $$ BEGIN RETURN a / b; EXCEPTION WHEN division_by_zero THEN RETURN -1; WHEN OTHERS THEN RETURN -2; END; $$")
    assert run.call("CALL routine_safe(8, 2)").first()[0] == 4 and run.call("CALL routine_safe(1, 0)").first()[0] == -1
    assert run.create("CREATE PROCEDURE routine_out(a int, OUT b int, INOUT c int) LANGUAGE plpgsql AS $$ BEGIN b := a + 1; c := c * 2; EXECUTE 'SELECT ' || a INTO a; IF a = 3 THEN RETURN; END IF; c := 0; END; $$")
    assert tuple(run.call("CALL routine_out(3, c => 5)").first()) == (4, 10) and tuple(run.call("CALL routine_out(4, 5)").first()) == (5, 0)
    for bad in ("CALL routine_out(1)", "CALL routine_out(1, 2, 3)", "CALL routine_nothing(1)", "CALL routine_out(1, x => 2)"):
        with pytest.raises(Untranslated):
            run.call(bad)
    for body in ("RETURN QUERY SELECT 1;", "OPEN c;", "IF true THEN", "INSERT INTO t VALUES (1) RETURNING id INTO n;"):
        assert not function(spark, body)


def test_a_procedure_writes_rows(spark, tmp_path):
    run = Executor(spark)
    spark.sql(f"CREATE TABLE routine_log (message string) USING parquet LOCATION '{tmp_path}/log'")
    head = "CREATE OR REPLACE PROCEDURE log_message(msg TEXT{}) LANGUAGE plpgsql AS $$ BEGIN INSERT INTO routine_log (message) VALUES ({}); END; $$"
    assert run.create(head.format("", "msg")) and run.create(head.format(", severity TEXT DEFAULT 'INFO'", "'[' || severity || '] ' || msg"))
    run.call("CALL log_message('Test message')")
    run.call("CALL log_message('Error; occurred', 'ERROR');")
    assert sorted(r.message for r in spark.table("routine_log").collect()) == ["[ERROR] Error; occurred", "[INFO] Test message"]
    assert run.create("CREATE PROCEDURE log_two() LANGUAGE sql AS $$ INSERT INTO routine_log VALUES ('one'); INSERT INTO routine_log VALUES ('two'); $$")
    run.call("CALL log_two()")
    assert spark.table("routine_log").count() == 4
    run.drop("procedure", "log_message")
    with pytest.raises(Untranslated):
        run.call("CALL log_message('x')")
    spark.sql("DROP TABLE routine_log")
    assert "routine_main: BEGIN" in script(identify(head.format("", "msg")), {"msg": "'x'"})


def test_aggregates_of_any_state_function(spark, monkeypatch):
    run = Executor(spark)
    state = "CREATE OR REPLACE FUNCTION fold_state(state {0}, value {0}) RETURNS {0} LANGUAGE sql AS $$ SELECT COALESCE(state, 0) + value $$"
    assert run.create(state.format("numeric")) and run.create(state.format("double precision"))
    assert run.create("CREATE AGGREGATE fold_sum(DOUBLE PRECISION) (SFUNC = fold_state, STYPE = DOUBLE PRECISION, INITCOND = '0', COMBINEFUNC = fold_state)")
    assert run.create("CREATE FUNCTION fold_far(s int8, v int8) RETURNS int8 LANGUAGE plpgsql AS $$ BEGIN IF v IS NULL THEN RETURN s; END IF; IF s IS NULL OR abs(v) > abs(s) THEN RETURN v; END IF; RETURN s; END; $$")
    assert run.create("CREATE FUNCTION fold_text(s int8) RETURNS text LANGUAGE sql AS $$ SELECT 'far ' || s $$")
    assert run.create("CREATE AGGREGATE fold_farthest(int8) (SFUNC = fold_far, STYPE = int8, COMBINEFUNC = fold_far, FINALFUNC = fold_text)")
    assert run.create("CREATE FUNCTION fold_chain(s int8, v int8) RETURNS int8 LANGUAGE sql AS $$ SELECT (s * 31 + v) % 1000003 $$")
    assert run.create("CREATE AGGREGATE fold_hash(int8) (SFUNC = fold_chain, STYPE = int8, INITCOND = '7')")
    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", (k * 7919) % 1000 - 500, float(k % 10), k) for k in range(900)] + [("nulls", None, 1.0, 5000)]
    df = spark.createDataFrame(rows, "g string, v long, x double, at long")
    groups = {g: [r for r in rows if r[0] == g] for g in {r[0] for r in rows}}

    def chain(g):
        s = 7
        for r in sorted(groups[g], key=lambda r: -r[3] if False else r[3]):
            s = None if s is None or r[1] is None else (s * 31 + r[1]) % 1000003 if (s * 31 + r[1]) >= 0 else -((-(s * 31 + r[1])) % 1000003)
        return s

    for chunk in (10_000, 16):
        monkeypatch.setattr(folding.folded, "__defaults__", (*folding.folded.__defaults__[:-1], chunk))
        monkeypatch.setattr(folding, "FAN", 3)
        assert {r.g: r.s for r in run.aggregated(df, ["g"], "fold_sum", "x", "s").collect()} == {g: sum(r[2] for r in rs) for g, rs in groups.items()}
        far = {r.g: r.s for r in run.aggregated(df, ["g"], "fold_farthest", "v", "s").collect()}
        assert {g: None if s is None else abs(int(s[4:])) for g, s in far.items()} == {g: max((abs(r[1]) for r in rs if r[1] is not None), default=None) for g, rs in groups.items()}
        assert {r.g: r.s for r in run.aggregated(df, ["g"], "fold_hash", "v", "s", order=["at"]).collect()} == {g: chain(g) for g in groups}
    assert [r.s for r in run.aggregated(df, [], "fold_sum", "x", "s").collect()] == [sum(r[2] for r in rows)]
    assert run.aggregated(df.limit(0), ["g"], "fold_sum", "x", "s").collect() == []
    run.drop("aggregate", "fold_sum")
    assert "fold_sum" not in run.aggregates() and "fold_hash" in run.aggregates()
