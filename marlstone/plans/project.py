"""A small managed project over the driver's tables: views whose files stand against the order of their dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import builtins, dependencies_of, objects_of
from ..operators import graph
from ..operators.storage import stored
from .applying import Executor

FILES = {
    "a_top.sql": "-- totals of nations, by name\nCREATE VIEW nation_report AS\nSELECT n_name, n_orders, total FROM nation_totals JOIN nation ON n_nationkey = c_nationkey;\nCOMMENT ON VIEW nation_report IS 'orders of nations';",
    "b_middle.sql": "CREATE VIEW nation_totals AS SELECT c_nationkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer_orders GROUP BY c_nationkey;",
    "c_base.sql": "CREATE VIEW customer_orders AS SELECT c_nationkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey;",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read the project's files, order its views by their dependencies, make them, and query the topmost."""
    for name in ("nation", "customer", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    rows = stored(objects_of(spark.createDataFrame(list(FILES.items()), "file string, text string")))
    objects = rows.filter("object_type is not null")
    edges = graph.edges_of(objects, dependencies_of(rows, builtins(spark)))
    found = {f"{r['object_type']}::{r['state_name']}": r for r in objects.collect()}
    level = {r["node"]: r["level"] for r in graph.levels(spark.createDataFrame([(n,) for n in found], "node string"), edges, graph.FEW).collect()}
    run = Executor(spark)
    for n in sorted(found, key=lambda n: (level[n], found[n]["seq"])):
        run.create(found[n]["ddl"])
    return spark.table("nation_report")
