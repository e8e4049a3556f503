"""Queries that run migrations over a catalog table of all orders: one that is committed, and one that fails and is undone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.storage import stored
from .applying import MigrationError, migrate
from .queries import query, read
from .transactions import Transaction

STEPS = """UPDATE {t} SET o_totalprice = o_totalprice * 2, o_orderstatus = lower(o_orderstatus) WHERE o_orderstatus = 'F';
DELETE FROM {t} USING marlstone_customers c WHERE c.c_custkey = o_custkey AND c.c_nationkey = 3;
INSERT INTO {t} SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM {t} WHERE o_orderstatus = 'P';
ALTER TABLE {t} ADD COLUMN origin text DEFAULT 'web', RENAME COLUMN o_totalprice TO total;
INSERT INTO {t} (o_orderkey, o_custkey, o_orderstatus, total, origin) SELECT -o_orderkey, o_custkey, 'N', 0, NULL FROM {t} WHERE total > 400000;"""
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def moved(spark, d, text: str, fails: bool = False) -> DataFrame:
    """The table of orders after a migration; it has a name of its own and is dropped at the end."""
    read(spark, d, "customer").select("c_custkey", "c_nationkey").createOrReplaceTempView("marlstone_customers")
    name = f"marlstone_orders_{uuid.uuid4().hex}"
    read(spark, d, "orders").select(*COLUMNS).write.saveAsTable(name)
    work, result = Transaction(spark), None
    try:
        try:
            migrate(spark, "orders", text.replace("{t}", name), work)
        except MigrationError:
            if not fails:
                raise
            work.rollback()
        result = stored(spark.table(name))
    finally:
        work.run(f"DROP TABLE {name}")
        work.commit()
    return result


@query("""WITH updated AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'f' ELSE o_orderstatus END AS o_orderstatus, CASE o_orderstatus WHEN 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS total FROM orders),
kept AS (SELECT * FROM updated WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3)),
grown AS (SELECT *, 'web' AS origin FROM kept UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, total, 'web' FROM kept WHERE o_orderstatus = 'P')
SELECT * FROM grown UNION ALL SELECT -o_orderkey, o_custkey, 'N', 0, NULL FROM grown WHERE total > 400000""")
def committed_migration(spark, d):
    return moved(spark, d, STEPS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def undone_migration(spark, d):
    return moved(spark, d, STEPS + "\nTRUNCATE {t};\nINSERT INTO {t} SELECT * FROM marlstone_is_not_there;", fails=True)
