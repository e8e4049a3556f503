"""Queries over routines that are made from their CREATE statements: PL/pgSQL functions inside queries, procedures, aggregates of any state function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.storage import stored
from .applying import Executor
from .queries import query, read


def made(run: Executor, *definitions: str) -> None:
    for ddl in definitions:
        assert run.create(ddl), ddl


@query("SELECT category, round(sum(amount), 2) AS total FROM (SELECT o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS amount FROM orders) GROUP BY 1")
def plpgsql_totals(spark, d):
    run = Executor(spark)
    read(spark, d, "orders").selectExpr("o_orderpriority AS category", "o_orderstatus AS status", "o_totalprice AS amount").createOrReplaceTempView("marlstone_data_source")
    made(run, """CREATE OR REPLACE FUNCTION marlstone_sum_by_category(cat TEXT) RETURNS float8 AS $$
        BEGIN
            RETURN COALESCE((SELECT SUM(amount) FROM marlstone_data_source WHERE category = cat AND status <> 'P'), 0);
        END;
        $$ LANGUAGE plpgsql""")  # fmt: skip
    return spark.sql("SELECT category, round(marlstone_sum_by_category(category), 2) AS total FROM (SELECT DISTINCT category FROM marlstone_data_source)")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt of ' || floor(-c_acctbal)::BIGINT WHEN c_acctbal * 2 + c_nationkey > 15000 THEN 'gold' WHEN c_acctbal * 2 + c_nationkey > 8000 AND c_nationkey % 2 = 0 THEN 'silver' ELSE 'none' END AS tier FROM customer""")
def plpgsql_branches(spark, d):
    run = Executor(spark)
    made(run, """CREATE FUNCTION marlstone_tier(balance float8, nation int, rate int DEFAULT 2) RETURNS text LANGUAGE plpgsql AS $$
        DECLARE
            points float8 := balance * rate;
            tier text := 'none';
        BEGIN
            IF balance < 0 THEN
                RETURN 'debt of ' || floor(-balance)::int8;
            END IF;
            points := points + nation;
            IF points > 15000 THEN tier := 'gold';
            ELSIF points > 8000 THEN
                CASE WHEN nation % 2 = 0 THEN tier := 'silver'; ELSE NULL; END CASE;
            END IF;
            RETURN tier;
        END; $$""")  # fmt: skip
    return read(spark, d, "customer").select("c_custkey", F.expr("marlstone_tier(c_acctbal, c_nationkey)").alias("tier"))


@query("""WITH n AS (SELECT n_regionkey, count(c_custkey) AS customers, coalesce(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 0) AS negative FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT r_name AS region, customers::BIGINT AS customers, CASE WHEN negative * 11 > customers THEN 'many' ELSE 'few' END AS debts FROM region JOIN n ON n_regionkey = r_regionkey WHERE r_regionkey <> 2
UNION ALL SELECT 'all', sum(customers)::BIGINT, NULL FROM n WHERE n_regionkey <> 2""")
def procedure_calls(spark, d):
    """A procedure that walks the regions, leaves one out, and writes a row of counts for each and one in the end."""
    run, name = Executor(spark), f"marlstone_report_{uuid.uuid4().hex}"
    read(spark, d, "region").createOrReplaceTempView("marlstone_region")
    read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).createOrReplaceTempView("marlstone_homes")
    spark.sql(f"CREATE TABLE {name} (region string, customers bigint, debts string) USING parquet")
    made(run, f"""CREATE PROCEDURE marlstone_report(skip int, share int DEFAULT 11) LANGUAGE plpgsql AS $$
        DECLARE
            whole int8 := 0; own int8; negative int8;
        BEGIN
            FOR r IN SELECT r_regionkey AS key, r_name AS title FROM marlstone_region ORDER BY r_regionkey LOOP
                CONTINUE WHEN r.key = skip;
                SELECT count(*), count_if(c_acctbal < 0) INTO own, negative FROM marlstone_homes WHERE n_regionkey = r.key;
                whole := whole + own;
                IF negative * share > own THEN
                    INSERT INTO {name} VALUES (r.title, own, 'many');
                ELSE
                    INSERT INTO {name} VALUES (r.title, own, 'few');
                END IF;
            END LOOP;
            INSERT INTO {name} VALUES ('all', whole, NULL);
        END; $$""")  # fmt: skip
    try:
        run.call("CALL marlstone_report(skip => 2)")
        return stored(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE {name}")


@query("""WITH f AS (SELECT l_returnflag || l_linestatus AS flags, max_by(l_extendedprice, struct_pack(a := abs(l_extendedprice - 40000), v := l_extendedprice)) AS v FROM lineitem GROUP BY 1),
c AS (SELECT o_custkey, list_reduce(list(o_orderkey ORDER BY o_orderkey), lambda s, v: (s * 31 + v) % 1000003, 7) AS v FROM orders GROUP BY 1)
SELECT 'far' AS kind, flags AS key, 'at ' || round(v, 2) AS value FROM f UNION ALL SELECT 'chain', o_custkey::VARCHAR, v::VARCHAR FROM c""")
def user_state_functions(spark, d):
    """One aggregate whose states are combined, with a final function, and one that has to follow the order of its rows."""
    run = Executor(spark)
    made(
        run,
        "CREATE FUNCTION marlstone_far(s float8, v float8) RETURNS float8 LANGUAGE plpgsql AS $$ BEGIN IF s IS NULL THEN RETURN v; END IF; IF abs(v - 40000) > abs(s - 40000) OR (abs(v - 40000) = abs(s - 40000) AND v > s) THEN RETURN v; END IF; RETURN s; END; $$",
        "CREATE FUNCTION marlstone_told(s float8) RETURNS text LANGUAGE sql AS $$ SELECT 'at ' || round(s, 2) $$",
        "CREATE AGGREGATE marlstone_farthest(float8) (SFUNC = marlstone_far, STYPE = float8, COMBINEFUNC = marlstone_far, FINALFUNC = marlstone_told)",
        "CREATE FUNCTION marlstone_next(s int8, v int8) RETURNS int8 LANGUAGE sql AS $$ SELECT (s * 31 + v) % 1000003 $$",
        "CREATE AGGREGATE marlstone_chain(int8) (SFUNC = marlstone_next, STYPE = int8, INITCOND = '7')",
    )
    lines = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("key"), "l_extendedprice")
    far = run.aggregated(lines, ["key"], "marlstone_farthest", "l_extendedprice", "value").select(F.lit("far").alias("kind"), "key", "value")
    chain = run.aggregated(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "marlstone_chain", "o_orderkey", "value", order=["o_orderkey"])
    return far.union(chain.select(F.lit("chain"), F.col("o_custkey").cast("string"), F.col("value").cast("string")))
