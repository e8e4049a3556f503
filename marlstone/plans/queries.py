"""Queries over the driver's tables, one for each operator that SQL can express, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sqltext import hash_column, line_column
from ..operators import diff, graph, severity
from .project import flagship

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def keep(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderkey, c_name, o_orderdate, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '2001-01-01' - INTERVAL 30 DAY")
def view_recent_join(spark, d):
    o = read(spark, d, "orders").filter("o_orderdate > timestamp_ntz '2001-01-01' - interval '30' day")
    return o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate", F.round("o_totalprice", 2).alias("total"))


@query("SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def view_user_stats(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey", "c_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.max("o_orderdate").alias("last_order"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers, max(c_acctbal) AS top_balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def view_activity_fanout(spark, d):
    # each side is summed before it joins: the product of the two sides is never made
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("n_customers"), F.max("c_acctbal").alias("top_balance"))
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("n_suppliers"))
    j = read(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    zero = F.lit(0).cast("long")
    return j.select("n_name", F.coalesce("n_customers", zero).alias("n_customers"), F.coalesce("n_suppliers", zero).alias("n_suppliers"), "top_balance")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def correlated_count(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").count()
    return read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


@query("SELECT o_orderkey, row_number() OVER w AS row_no, lag(o_totalprice) OVER w AS before, sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 300000 AS busy FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_rownum_lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("row_no"), F.lag("o_totalprice").over(w).alias("before"), (F.sum("o_totalprice").over(w.rowsBetween(-2, 0)) > 300000).alias("busy"))


SNAPSHOTS = """f AS (SELECT c_custkey AS id, sha256(c_name || CASE WHEN c_custkey % 5 = 0 THEN '!' ELSE '' END) AS ddl_hash FROM customer WHERE c_custkey % 7 <> 0),
s AS (SELECT c_custkey AS id, sha256(c_name) AS ddl_hash FROM customer WHERE c_custkey % 11 <> 0)"""


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    mark = F.when(F.col("c_custkey") % 5 == 0, "!").otherwise("")
    return c.filter("c_custkey % 7 != 0").select(F.col("c_custkey").alias("id"), F.sha2(F.concat("c_name", mark), 256).alias("ddl_hash")), c.filter("c_custkey % 11 != 0").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("ddl_hash"))


@query(f"""WITH {SNAPSHOTS} SELECT coalesce(f.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'create' WHEN f.id IS NULL THEN 'delete' ELSE 'update' END AS type, s.ddl_hash AS old_hash, f.ddl_hash AS new_hash
FROM f FULL JOIN s ON f.id = s.id WHERE f.ddl_hash IS DISTINCT FROM s.ddl_hash""")
def change_detection(spark, d):
    return diff.changes(*snapshots(spark, d), ["id"])


RANKED = "SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS severity_rank FROM orders"


@query(f"WITH r AS ({RANKED}) SELECT count(*) FILTER (severity_rank = 0) AS n_safe, count(*) FILTER (severity_rank = 1) AS n_transient, count(*) FILTER (severity_rank = 2) AS n_breaking, max(severity_rank) AS worst_rank, CASE max(severity_rank) WHEN 0 THEN 'safe' WHEN 1 THEN 'transient' ELSE 'breaking' END AS worst FROM r")
def severity_rollup(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return severity.rollup(read(spark, d, "orders").select(rank.alias("severity_rank")))


@query("""WITH RECURSIVE h AS (SELECT n_nationkey, n_name, 0 AS depth, n_name AS path FROM nation WHERE n_nationkey = 0
UNION ALL SELECT n.n_nationkey, n.n_name, depth + 1, path || '/' || n.n_name FROM h JOIN nation n ON n.n_nationkey = h.n_nationkey + 3 WHERE depth < 6) SELECT n_nationkey, depth, path FROM h""")
def recursive_hierarchy(spark, d):
    return spark.sql(
        """WITH RECURSIVE h AS (SELECT n_nationkey, n_name, 0 AS depth, n_name AS path FROM {n} WHERE n_nationkey = 0
        UNION ALL SELECT n.n_nationkey, n.n_name, depth + 1, path || '/' || n.n_name FROM h JOIN {n} n ON n.n_nationkey = h.n_nationkey + 3 WHERE depth < 6) SELECT n_nationkey, depth, path FROM h""",
        n=read(spark, d, "nation"),
    )


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, avg(length(event_type)) AS mean_length, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def daily_stats(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("event_type")).alias("mean_length"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract(spark, d):
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, generate_subscripts(string_split(n_name, 'A'), 1)::INT - 1 AS pos, unnest(string_split(n_name, 'A')) AS part FROM nation")
def unnest_ordinality(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.posexplode(F.split("n_name", "A")).alias("pos", "part"))


@query("SELECT n_regionkey AS name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS places FROM nation GROUP BY 1 HAVING count(*) > 1")
def duplicate_definitions(spark, d):
    return diff.duplicates(read(spark, d, "nation"), "n_regionkey", "n_name").withColumnRenamed("n_regionkey", "name")


@query("SELECT r_name, n_name, count(*) AS n, grouping(n_name)::INT AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
def grouping_sets(spark, d):
    return spark.sql("SELECT r_name, n_name, count(*) AS n, cast(grouping(n_name) AS int) AS total FROM {n} JOIN {r} ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())", n=read(spark, d, "nation"), r=read(spark, d, "region"))


@query("SELECT doc_id, (length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) + 1)::INT AS line FROM documents")
def line_of_offset(spark, d):
    return read(spark, d, "documents").select("doc_id", line_column(F.col("text"), F.lit(500)).alias("line"))


@query("SELECT doc_id, sha256(lower(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(string_split(x, '--')[1])), lambda x: x <> ''), ' '))) AS hash FROM documents")
def ddl_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", hash_column(F.col("text")).alias("hash"))


#: Every order hangs on its customer, every customer on a nation, and one order in three on the order 96 before it: long chains and fans over whole tables.
EDGES = """SELECT o_custkey * 10 + 1 AS src, o_orderkey * 10 + 2 AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'soft' ELSE 'hard' END AS kind FROM orders
UNION SELECT (c_nationkey + 1) * 10, c_custkey * 10 + 1, 'hard' FROM customer
UNION SELECT (o_orderkey - 96) * 10 + 2, o_orderkey * 10 + 2, 'hard' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey > 96"""


def edge_table(spark, d) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    node, hard = F.col("o_orderkey") * 10 + 2, F.lit("hard")
    owned = o.select((F.col("o_custkey") * 10 + 1).alias("src"), node.alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, "soft").otherwise("hard").alias("kind"))
    homes = c.select(((F.col("c_nationkey") + 1) * 10).cast("long"), F.col("c_custkey") * 10 + 1, hard)
    chains = o.filter("o_orderkey % 3 = 1 and o_orderkey > 96").select((F.col("o_orderkey") - 96) * 10 + 2, node, hard)
    return owned.union(homes).union(chains).distinct()


#: Hard edges from the first two nations on.
CLOSURE = f"WITH RECURSIVE e AS ({EDGES}), c AS (SELECT 10::BIGINT AS node UNION SELECT 20::BIGINT UNION SELECT dst FROM c JOIN e ON src = node WHERE kind = 'hard')"


def seeds(spark) -> DataFrame:
    return spark.range(10, 30, 10).withColumnRenamed("id", "node")


@query(f"{CLOSURE} SELECT node FROM c WHERE node NOT IN (10, 20)")
def affected_closure(spark, d):
    return graph.closure(edge_table(spark, d), seeds(spark))


@query(f"{CLOSURE} SELECT node FROM c WHERE node NOT IN (10, 20)")
def affected_closure_joined(spark, d):
    """The same by joins, under the name that it had when affected_closure walked small graphs on the driver."""
    return graph.closure(edge_table(spark, d), seeds(spark))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|red) [a-z]+$')")
def regex_domain(spark, d):
    return read(spark, d, "part").filter(F.col("p_name").rlike("^(small|red) [a-z]+$")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_in_anti(spark, d):
    o = read(spark, d, "orders").filter("o_orderstatus = 'P'")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT name FROM (SELECT 'm' || c_custkey AS name FROM customer) WHERE name NOT IN (SELECT 'm' || c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def pending_migrations(spark, d):
    names = read(spark, d, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("name"), "c_custkey")
    return diff.pending(names.select("name"), names.filter("c_custkey % 4 != 0"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_brand LIKE 'Brand#1%')")
def builtin_filter(spark, d):
    p = read(spark, d, "part")
    return diff.without_builtins(p.select("p_partkey", "p_brand"), p.filter("p_brand like 'Brand#1%'"), ["p_brand"]).select("p_partkey", "p_brand")


OBJECTS = "SELECT n_nationkey AS seq, CASE n_nationkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 2 THEN 'function' ELSE 'type' END AS object_type, n_name AS name FROM nation"


@query(f"""WITH o AS ({OBJECTS}), d AS (SELECT s.seq, s.object_type, s.name, CASE t.seq % 3 WHEN 0 THEN 'relation' WHEN 1 THEN 'function' ELSE 'type' END AS dep_class, t.name AS dep_name FROM o s JOIN o t ON (s.seq + t.seq) % 5 = 0 AND s.seq <> t.seq)
SELECT t.object_type || '::' || t.name AS src, d.object_type || '::' || d.name AS dst, CASE WHEN d.dep_class = 'function' AND d.object_type = 'function' THEN 'soft' ELSE 'hard' END AS kind FROM d JOIN o t ON t.name = d.dep_name
AND CASE d.dep_class WHEN 'relation' THEN t.object_type IN ('table', 'view') WHEN 'function' THEN t.object_type = 'function' ELSE t.object_type IN ('type', 'view', 'table') END""")
def dependency_edges(spark, d):
    n = read(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("table", "view", "function", "type"))), F.col("n_nationkey") % 4 + 1)
    o = n.select(F.col("n_nationkey").alias("seq"), kind.alias("object_type"), F.col("n_name").alias("state_name"), F.lit(None).cast("string").alias("schema"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("trigger_table"))
    t = o.select(F.col("seq").alias("t"), F.col("name").alias("dep_name"))
    pairs = o.withColumn("rest", F.pmod(-F.col("seq"), F.lit(5))).join(t.withColumn("rest", F.col("t") % 5), "rest").filter("seq != t")
    deps = pairs.select("object_type", "state_name", F.element_at(F.array(*map(F.lit, ("relation", "function", "type"))), F.col("t") % 3 + 1).alias("dep_class"), F.lit(None).cast("string").alias("dep_schema"), "dep_name")
    return graph.edges_of(o, deps)


@query("SELECT DISTINCT o_orderpriority AS dependent_type, 'c' || (o_custkey % 50) AS dependent_name FROM orders WHERE o_orderkey % 100 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def dependents_of_relations(spark, d):
    deps = read(spark, d, "orders").select(F.col("o_orderpriority").alias("dependent_type"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("dependent_name"), (F.col("o_orderkey") % 100).alias("dependency_name"))
    return diff.dependents_of(deps, read(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("dependency_name")))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({EDGES})), w AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) UNION SELECT dst, level + 1 FROM w JOIN e ON src = node) SELECT node, max(level)::INT AS level FROM w GROUP BY 1")
def topo_levels(spark, d):
    e = edge_table(spark, d).select("src", "dst").distinct()
    return graph.levels(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


@query(f"WITH e AS ({EDGES}) SELECT dst AS node, kind FROM e WHERE src = 11")
def hard_soft_split(spark, d):
    e = edge_table(spark, d)
    return graph.neighbours(e, 11, kind="hard").withColumn("kind", F.lit("hard")).union(graph.neighbours(e, 11, kind="soft").withColumn("kind", F.lit("soft")))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT src, dst FROM e WHERE src % 4 = 1 AND dst % 4 <> 1 AND dst % 7 <> 0")
def deletion_safety(spark, d):
    e = edge_table(spark, d)
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.unsafe_deletions(e, n.filter("node % 4 = 1"), n.filter("node % 7 != 0"))


@query(f"{CLOSURE} SELECT node, 'update' AS type, 'Dependency requires recreation' AS reason FROM c WHERE node NOT IN (10, 20) AND node % 6 <> 0")
def cascade_changes(spark, d):
    e = edge_table(spark, d)
    listed = e.select(F.col("dst").alias("node")).distinct().filter("node % 6 = 0")
    return graph.closure(e, seeds(spark)).join(listed, "node", "left_anti").withColumn("type", F.lit("update")).withColumn("reason", F.lit("Dependency requires recreation"))


@query("""WITH l AS (SELECT p_brand AS name, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (p_size > 47), '') AS labels FROM part GROUP BY 1)
SELECT name, regexp_matches(',' || labels || ',', ',ECONOMY,(.*,)?PROMO,') AS kept FROM l""")
def enum_subsequence(spark, d):
    # labels are a type's own, a few: distinct ones are gathered, whatever the number of rows
    labels = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 47, F.col("p_type")))).alias("labels"))
    return labels.select("name", severity.is_ordered_subsequence(F.array(F.lit("ECONOMY"), F.lit("PROMO")), F.col("labels")).alias("kept"))


@query("SELECT p_partkey, [p_brand || ':' || p_type, 'size:int'] = [CASE WHEN p_size > 25 THEN p_brand ELSE 'Brand#11' END || ':' || p_type, 'size:int'] AS same FROM part")
def shape_compare(spark, d):
    shape = lambda brand: F.array(F.struct(brand.alias("name"), F.col("p_type").alias("type")), F.struct(F.lit("size").alias("name"), F.lit("int").alias("type")))
    return read(spark, d, "part").select("p_partkey", severity.same_shape(shape(F.col("p_brand")), shape(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("Brand#11"))).alias("same"))


@query(f"WITH {SNAPSHOTS} SELECT id, ddl_hash FROM s WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, ddl_hash FROM f")
def state_upsert(spark, d):
    new, old = snapshots(spark, d)
    return diff.upsert(old, new, ["id"])


@query(f"WITH {SNAPSHOTS} SELECT id, ddl_hash FROM s UNION ALL SELECT id, ddl_hash FROM f WHERE id NOT IN (SELECT id FROM s)")
def insert_if_absent(spark, d):
    new, old = snapshots(spark, d)
    return diff.insert_if_absent(old, new, ["id"])


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'trigger' ELSE 'view' END AS object_type, 'o' || (c_custkey % 60) || CASE WHEN c_custkey % 2 = 0 THEN ':t' ELSE '' END AS object_name, c_custkey AS id FROM customer),
d AS (SELECT DISTINCT 'o' || (o_custkey % 60) AS object_name, 't' || (o_orderkey % 3) AS dependency_name FROM orders)
SELECT object_type, object_name, id FROM s WHERE NOT (object_type = 'trigger' AND position(':' IN object_name) = 0) UNION ALL
SELECT object_type, s.object_name || ':' || dependency_name, id FROM s JOIN d ON s.object_name = d.object_name WHERE object_type = 'trigger' AND position(':' IN s.object_name) = 0""")
def legacy_key_upgrade(spark, d):
    c = read(spark, d, "customer")
    s = c.select(F.when(F.col("c_custkey") % 3 == 0, "trigger").otherwise("view").alias("object_type"), F.concat(F.lit("o"), F.col("c_custkey") % 60, F.when(F.col("c_custkey") % 2 == 0, ":t").otherwise("")).alias("object_name"), F.col("c_custkey").alias("id"))
    o = read(spark, d, "orders")
    deps = o.select(F.lit("trigger").alias("dependent_type"), F.concat(F.lit("o"), F.col("o_custkey") % 60).alias("dependent_name"), F.lit("relation").alias("dependency_type"), F.concat(F.lit("t"), F.col("o_orderkey") % 3).alias("dependency_name")).distinct()
    return diff.upgraded_trigger_keys(s, deps)


@query("SELECT 'nation' AS source, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def union_all_catalog(spark, d):
    return read(spark, d, "nation").select(F.lit("nation").alias("source"), F.col("n_name").alias("name")).unionAll(read(spark, d, "region").select(F.lit("region"), "r_name"))


@query("SELECT p_partkey, coalesce(s_name, 'NONE') AS side FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def left_join_default(spark, d):
    return read(spark, d, "part").join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("s_name", F.lit("NONE")).alias("side"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size,
coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, greatest(o_orderkey % 7, o_custkey % 5) AS hi, least(o_orderkey % 7, o_custkey % 5) AS lo FROM orders""")
def case_coalesce_greatest(spark, d):
    a, b, price = F.col("o_orderkey") % 7, F.col("o_custkey") % 5, F.col("o_totalprice")
    return read(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").alias("state"), F.when(price > 200000, "big").when(price > 100000, "middle").otherwise("small").alias("size"),
        F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"), F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))


@query("SELECT l_suppkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 100 AND count(*) > 20")
def having_filter(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).filter("quantity > 100 and n > 20")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber * 2 AS twice FROM lineitem")
def distinct_project(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_linenumber") * 2).alias("twice")).distinct()


@query("SELECT s_suppkey, struct_pack(amount := round(s_acctbal, 2), code := 'USD').amount AS amount, struct_pack(x := s_nationkey, y := 1).x AS x FROM supplier")
def struct_field(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", F.struct(F.round("s_acctbal", 2).alias("amount"), F.lit("USD").alias("code")).getField("amount").alias("amount"), F.struct(F.col("s_nationkey").alias("x"), F.lit(1).alias("y")).getField("x").alias("x"))


@query("SELECT c_custkey, (nullif(c_nationkey, 3) IS NULL) AS missing, (nullif(c_acctbal > 0, false)) IS NOT TRUE AS not_true, (c_acctbal > 5000) IS FALSE AS low FROM customer")
def null_bool_tests(spark, d):
    rich = F.col("c_acctbal") > 0
    return read(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).isNull().alias("missing"), (~F.when(rich, rich).eqNullSafe(F.lit(True))).alias("not_true"), (F.col("c_acctbal") > 5000).eqNullSafe(F.lit(False)).alias("low"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'small')")
def prefix_cleanup(spark, d):
    return read(spark, d, "part").filter(~F.startswith("p_name", F.lit("small"))).select("p_partkey", "p_name")


TAP = "SELECT CASE WHEN l_linenumber = 7 THEN 'ok ' || l_orderkey || ' # SKIP later' WHEN l_linenumber % 3 = 0 THEN 'not ok ' || l_orderkey || ' - case' WHEN l_linenumber = 1 THEN '# note' ELSE 'ok ' || l_orderkey || ' - fine' END AS line FROM lineitem"


@query(f"WITH t AS ({TAP}) SELECT CASE WHEN line LIKE '%# SKIP%' THEN 'skip' WHEN line LIKE 'ok %' THEN 'pass' WHEN line LIKE 'not ok %' THEN 'fail' END AS status, count(*) AS n FROM t WHERE line NOT LIKE '#%' GROUP BY 1")
def tap_counts(spark, d):
    from ..functions.tap import status

    key, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    line = F.when(n == 7, F.concat(F.lit("ok "), key, F.lit(" # SKIP later"))).when(n % 3 == 0, F.concat(F.lit("not ok "), key, F.lit(" - case"))).when(n == 1, "# note").otherwise(F.concat(F.lit("ok "), key, F.lit(" - fine")))
    return read(spark, d, "lineitem").select(status(line).alias("status")).filter("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'f' || (o_orderkey % 90) AS file, unnest(['table', 'view', 'materialized_view']) AS kind, 'n' || (o_custkey % 70) AS name FROM orders), c AS (SELECT 'view' AS kind, 'n' || n_nationkey AS name FROM nation WHERE n_regionkey = 2)
SELECT DISTINCT file FROM t WHERE (kind, name) IN (SELECT kind, name FROM c)""")
def test_impact(spark, d):
    from ..functions.tap import impacted, touched

    deps = read(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 90).alias("file"), F.lit("relation").alias("dep_class"), F.concat(F.lit("n"), F.col("o_custkey") % 70).alias("name"))
    changed = read(spark, d, "nation").filter("n_regionkey = 2").select(F.lit("view").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return impacted(touched(deps), changed)


test_impact.__test__ = False


@query("SELECT o_custkey, sum((o_totalprice::DECIMAL(18, 2) * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1")
def user_aggregate(spark, d):
    # CREATE AGGREGATE with SFUNC int8pl, STYPE int8 and INITCOND 0: its state is summed on both sides of the shuffle, no list is made
    from .applying import Executor

    Executor(spark).create("CREATE AGGREGATE marlstone_cents(int8) (SFUNC = int8pl, STYPE = int8, INITCOND = '0')")
    return Executor(spark).aggregated(read(spark, d, "orders").withColumn("c", (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")), ["o_custkey"], "marlstone_cents", "c", "cents")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000")
def table_udf(spark, d):
    from .applying import Executor

    read(spark, d, "orders").createOrReplaceTempView("marlstone_orders")
    made = Executor(spark).create("""CREATE FUNCTION marlstone_orders_over(least float8) RETURNS TABLE (o_custkey int8, o_orderkey int8, o_totalprice float8)
        LANGUAGE sql AS $$ SELECT o_custkey, o_orderkey, o_totalprice FROM marlstone_orders WHERE o_totalprice > least; $$""")
    assert made
    return spark.sql("SELECT * FROM marlstone_orders_over(50000D)")


@query("SELECT l_orderkey, l_linenumber, (l_orderkey + 3 + l_linenumber - 1)::BIGINT AS source_line FROM lineitem")
def lint_line(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + 3 + F.col("l_linenumber") - 1).alias("source_line"))


@query("SELECT n_name, n_orders, total FROM (SELECT c_nationkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey")
def managed_views(spark, d):
    return flagship(spark, d)


def queries() -> dict[str, Query]:
    from . import ddlqueries, migrationqueries, routinequeries, sqlqueries  # noqa: F401  they register themselves

    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
