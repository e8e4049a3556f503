"""The driver's walk and the joined rounds give the same, nulls included; what is deleted leaves no comment or dependency."""

import random

import pytest

from marlstone.functions.idents import Ident
from marlstone.operators import graph
from marlstone.plans.applying import Executor, as_spark, comment_keys


@pytest.mark.parametrize("most_local", [0, 1000])
def test_nulls_are_no_nodes(spark, most_local):
    edges = spark.createDataFrame([("a", "b", "hard"), ("b", None, "hard"), (None, "x", "hard"), ("b", "c", "soft"), ("b", "d", "hard"), ("a", "b", "hard")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert {r.node for r in graph.closure(edges, seeds, most_local=most_local).collect()} == {"b", "d"}
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "x", None)], "node string")
    assert {r.node: r.level for r in graph.levels(nodes, edges, most_local=most_local).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2, "x": 0}
    circle = edges.union(spark.createDataFrame([("d", "a", "hard")], edges.schema))
    with pytest.raises(graph.CycleError):
        graph.levels(nodes, circle, most_local=most_local)


def test_comment_keys_are_whole():
    assert comment_keys("view", "s.user_stats") == [("view:s.user_stats",)] and comment_keys("function", "f") == [("function:f()",)] and comment_keys("index", "i") == []
    assert Ident.parse("s.user_stats") == Ident("s", "user_stats")


def test_spelling_leaves_literals_alone():
    assert as_spark("SELECT 'x::text', a::text") == "SELECT 'x::text', a::string"
    assert as_spark("SELECT props->>'k', b ~ '^a'") == "SELECT get_json_object(props, '$.k'), b RLIKE '^a'"
    assert as_spark("SELECT x ^ 2, '2 ^ 3', \"a b\"") == "SELECT power(x, 2), '2 ^ 3', `a b`"
    assert as_spark("SELECT generate_series(1, n)") == "SELECT explode(sequence(1, n))"


def test_definitions_run(spark):
    run = Executor(spark)
    assert run.create("CREATE FUNCTION marl_sum(a int4, b int4) RETURNS int4 LANGUAGE sql AS 'SELECT a + b'")
    assert run.create("CREATE OPERATOR +++ (LEFTARG = int4, RIGHTARG = int4, PROCEDURE = marl_sum)")
    assert run.create("CREATE AGGREGATE marl_top(int8) (SFUNC = int8larger, STYPE = int8)")
    assert not run.create("CREATE AGGREGATE marl_odd(int8) (SFUNC = own_function, STYPE = int8)")
    df = spark.createDataFrame([(1, 5), (1, 9), (2, None)], "k int, v long")
    assert {r.k: r.top for r in run.aggregated(df, ["k"], "marl_top", "v", "top").collect()} == {1: 9, 2: None}
    assert sorted(r.s for r in df.select(run.applied("+++", df.k, df.k).alias("s")).collect()) == [2, 2, 4]
    assert run.create("CREATE FUNCTION marl_rows(least int8) RETURNS TABLE (x int8) LANGUAGE sql AS $$ SELECT id FROM range(5) WHERE id >= least $$")
    assert sorted(r.x for r in spark.sql("SELECT * FROM marl_rows(3)").collect()) == [3, 4]
    assert run.create("CREATE FUNCTION marl_pl() RETURNS int4 LANGUAGE plpgsql AS $$ BEGIN RETURN 1; END $$") and spark.sql("SELECT marl_pl()").first()[0] == 1
    assert not run.create("CREATE FUNCTION marl_py() RETURNS int4 LANGUAGE plpython AS $$ return 1 $$")


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    jumped = graph._jumped

    def counted(chain):
        rounds.append(chain.count().bit_length())
        return jumped(chain)

    monkeypatch.setattr(graph, "_jumped", counted)
    ids = spark.range(n)
    edges = ids.filter("id > 0").selectExpr("id - 1 AS src", "id AS dst", "'hard' AS kind").union(spark.createDataFrame([(5, 9_000, "hard"), (3, n + 1, "hard")], "src long, dst long, kind string"))
    nodes = ids.withColumnRenamed("id", "node").union(spark.createDataFrame([(n + 1,)], "node long"))
    found = graph.levels(nodes, edges)
    assert found.filter("node <= 10000 and level = node").count() == n and found.filter("node = 10001").first().level == 4
    assert sum(rounds) < 40 and len(rounds) <= 3
    reached = graph.closure(edges, spark.createDataFrame([(7_000,)], "node long"))
    assert (reached.count(), reached.agg({"node": "min"}).first()[0]) == (2_999, 7_001)


def test_graphs_by_joins_against_plain_python(spark):
    rng = random.Random(11)
    for turn in range(2):
        n = 30
        pairs = {(a, a + 1) for a in range(0, 18) if rng.random() < 0.85}  # chains, with leaps, and circles in every other turn
        pairs |= {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(5, 30))}
        if turn % 2:
            pairs |= {tuple(sorted(rng.sample(range(n), 2), reverse=True)) for _ in range(3)}
        edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", "hard") for a, b in sorted(pairs)], "src string, dst string, kind string")
        nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(n)], "node string")
        below = {a: [y for x, y in pairs if x == a] for a in range(n)}

        def reach(a, below=below):
            seen, todo = set(), [a]
            while todo:
                for y in below[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        ways = {a: reach(a) for a in range(n)}
        start = rng.randrange(8)
        assert {int(r.node[1:]) for r in graph.closure(edges, spark.createDataFrame([(f"n{start:02d}",)], "node string")).collect()} == ways[start] - {start}
        on = {a: max(b for b in range(n) if b in ways[a] and a in ways[b]) for a in range(n) if a in ways[a]}
        for most in (0, 1000):
            assert {int(r.node[1:]): int(r.component[1:]) for r in graph.cycles(edges, most).collect()} == on
            if on:
                with pytest.raises(graph.CycleError) as e:
                    graph.levels(nodes, edges, most)
                assert {int(x[1:]) for x in str(e.value).partition(": ")[2].split(", ")} <= set(on)
            else:
                level = {int(r.node[1:]): r.level for r in graph.levels(nodes, edges, most).collect()}
                assert level == {b: level[b] for b in range(n)} and all(level[b] == max([level[a] + 1 for a, c in pairs if c == b], default=0) for b in range(n))
