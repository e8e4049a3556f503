"""Further queries over the driver's tables: subqueries, aggregates, limits, strings, dates and numbers, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locks
from .queries import query, read


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def exists_semi(spark, d):
    big = read(spark, d, "lineitem").filter("l_quantity > 45")
    return read(spark, d, "part").join(big, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name")


@query("SELECT o_orderkey, coalesce(c_name, 'nobody') AS customer, coalesce(n_name, 'nowhere') AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def two_left_joins(spark, d):
    rich = read(spark, d, "customer").filter("c_acctbal > 0")
    j = read(spark, d, "orders").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.lit("nobody")).alias("customer"), F.coalesce("n_name", F.lit("nowhere")).alias("nation"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal::DECIMAL(18, 2))::DOUBLE FROM supplier) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def scalar_and_in_subquery(spark, d):
    s = read(spark, d, "supplier")
    s.createOrReplaceTempView("marlstone_supplier")
    read(spark, d, "nation").createOrReplaceTempView("marlstone_nation")
    return spark.sql("SELECT s_suppkey, s_acctbal FROM marlstone_supplier WHERE s_acctbal > (SELECT cast(avg(cast(s_acctbal AS decimal(18,2))) AS double) FROM marlstone_supplier) AND s_nationkey IN (SELECT n_nationkey FROM marlstone_nation WHERE n_regionkey = 2)")


@query("SELECT v.kind, v.rank::INT AS rank, count(o_orderkey) AS n FROM (VALUES ('F', 1), ('O', 2), ('X', 3)) AS v(kind, rank) LEFT JOIN orders ON o_orderstatus = v.kind GROUP BY 1, 2")
def values_list(spark, d):
    kinds = spark.sql("SELECT * FROM VALUES ('F', 1), ('O', 2), ('X', 3) AS v(kind, rank)")
    n = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("n"))
    return kinds.join(n, F.col("kind") == F.col("o_orderstatus"), "left").select("kind", "rank", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT r_regionkey, g::BIGINT AS k, r_regionkey * g AS product FROM region, generate_series(0, 4) AS t(g) WHERE g <= r_regionkey")
def series_per_row(spark, d):
    return read(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_regionkey").cast("long"))).alias("k")).withColumn("product", F.col("r_regionkey") * F.col("k"))


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, avg(l_quantity::DECIMAL(18, 2))::DOUBLE AS mean FROM lineitem")
def global_average(spark, d):
    return read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.avg(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("mean"))


@query("SELECT c_custkey, coalesce(sum((o_totalprice::DECIMAL(18, 2) * 100)::BIGINT), 0)::BIGINT AS cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def sum_or_zero(spark, d):
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")
    p = read(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.sum(cents).alias("cents"))
    return read(spark, d, "customer").join(p, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("cents", F.lit(0).cast("long")).alias("cents"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_row(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 7)")
def bare_limit(spark, d):
    return spark.sql("SELECT count(*) AS n FROM (SELECT 1 FROM {o} LIMIT :most)", args={"most": 7}, o=read(spark, d, "orders"))


@query(r"""SELECT p_partkey, upper(p_name) AS name, substring(p_type, 2, 4) AS part, position('a' IN p_name)::INT AS at, overlay(p_brand, '-', 6) AS brand, trim(BOTH 'B' FROM p_brand) AS bare FROM part WHERE p_name LIKE '%\_%' ESCAPE '\' OR p_name LIKE '%e%'""".replace("overlay(p_brand, '-', 6)", "left(p_brand, 5) || '-' || substring(p_brand, 7)"))
def string_forms(spark, d):
    p = read(spark, d, "part").filter(r"p_name like '%\\_%' or p_name like '%e%'")
    return p.select("p_partkey", F.upper("p_name").alias("name"), F.substring("p_type", 2, 4).alias("part"), F.position(F.lit("a"), F.col("p_name")).alias("at"), F.overlay("p_brand", F.lit("-"), 6).alias("brand"), F.btrim("p_brand", F.lit("B")).alias("bare"))


@query("SELECT event_id, ts::DATE AS day, (ts < now()::TIMESTAMP) AS past, (CURRENT_DATE >= ts::DATE) AS today_or_before, extract(year FROM ts)::INT AS year FROM events")
def date_forms(spark, d):
    return read(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("ts") < F.current_timestamp()).alias("past"), (F.current_date() >= F.to_date("ts")).alias("today_or_before"), F.year("ts").alias("year"))


@query("SELECT p_partkey, round(sqrt(p_size::DOUBLE), 9) AS root, round(pow(p_size::DOUBLE, 2), 3) AS square, (p_size + 3) * 2 - p_size % 5 AS mixed, round(sqrt(pow(p_size - 10.0::DOUBLE, 2) + pow(p_retailprice / 100, 2)), 6) AS distance FROM part")
def number_forms(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select(
        "p_partkey", F.round(F.sqrt(size.cast("double")), 9).alias("root"), F.round(F.pow(size.cast("double"), F.lit(2)), 3).alias("square"), ((size + 3) * 2 - size % 5).alias("mixed"),
        F.round(F.sqrt(F.pow(size - 10.0, F.lit(2)) + F.pow(price / 100, F.lit(2))), 6).alias("distance"))


@query("SELECT c_custkey, ('0x' || left(sha256(c_name || ':' || c_nationkey || '/' || c_mktsegment), 15))::BIGINT AS lock_key FROM customer")
def lock_key(spark, d):
    return read(spark, d, "customer").select("c_custkey", locks.lock_key(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("lock_key"))


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS parties FROM nation""")
def sum_of_scalar_counts(spark, d):
    both = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(read(spark, d, "supplier").select("s_nationkey")).groupBy("k").count()
    return read(spark, d, "nation").join(both, F.col("k") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("count", F.lit(0).cast("long")).alias("parties"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_orders, count(*) FILTER (o_orderstatus = 'F') AS done_orders FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') >= (SELECT min(r_regionkey) FROM region)")
def filtered_counts(spark, d):
    least = read(spark, d, "region").agg(F.min("r_regionkey").alias("least"))
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done_orders"))
    return counts.filter(F.col("open_orders") >= least.scalar())


@query("SELECT c_custkey, x.n AS n, x.total AS total FROM customer, LATERAL (SELECT count(*) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS total FROM orders WHERE o_custkey = c_custkey) AS x")
def function_per_row(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("marlstone_orders_by")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION marlstone_totals(k BIGINT) RETURNS TABLE (n BIGINT, total BIGINT) RETURN SELECT count(*), coalesce(sum(o_orderkey), 0) FROM marlstone_orders_by WHERE o_custkey = k")
    read(spark, d, "customer").createOrReplaceTempView("marlstone_customer")
    return spark.sql("SELECT c_custkey, x.n, x.total FROM marlstone_customer, LATERAL marlstone_totals(c_custkey) AS x")
