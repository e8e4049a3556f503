"""Comparing snapshots: what is new, changed and gone, and what state becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(new: DataFrame, old: DataFrame, keys: list[str], hash_column: str = "ddl_hash") -> DataFrame:
    """keys, type, old_hash, new_hash of what differs: create, update or delete. Keys are unique on both sides."""
    a, b = new.select(*keys, F.col(hash_column).alias("new_hash")), old.select(*keys, F.col(hash_column).alias("old_hash"))
    kind = F.when(F.col("old_hash").isNull(), "create").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") != F.col("new_hash"), "update")
    return a.join(b, keys, "full_outer").withColumn("type", kind).filter("type is not null").select(*keys, "type", "old_hash", "new_hash")


def pending(files: DataFrame, applied: DataFrame, key: str = "name") -> DataFrame:
    """Rows of files whose key is not applied."""
    return files.join(applied.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it does not have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_of(old: DataFrame, new: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """old without all rows of the owners, and new."""
    return old.join(owners.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def duplicates(objects: DataFrame, key: str = "name", location: str = "file") -> DataFrame:
    """Names that are defined more than once, with the sorted places of all definitions."""
    return objects.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(location)), ",").alias("places")).filter("n > 1")


def without_builtins(deps: DataFrame, builtins: DataFrame, keys: list[str]) -> DataFrame:
    """deps less built-in names; the list of those is of fixed size."""
    return deps.join(F.broadcast(builtins.select(*keys).distinct()), keys, "left_anti")


def dependents_of(deps: DataFrame, relations: DataFrame, name: str = "dependency_name") -> DataFrame:
    """The distinct dependents of some relations."""
    return deps.join(relations.select(name), name, "left_semi").select("dependent_type", "dependent_name").distinct()


def upgraded_trigger_keys(state: DataFrame, deps: DataFrame) -> DataFrame:
    """state with name:table for triggers recorded by name alone, a row for each table that they depend on; upgrading again changes nothing."""
    old = F.expr("object_type = 'trigger' and position(':' in object_name) = 0")
    tables = deps.filter("dependent_type = 'trigger' and dependency_type = 'relation'").select(F.col("dependent_name").alias("object_name"), "dependency_name")
    moved = state.filter(old).join(tables, "object_name").withColumn("object_name", F.concat_ws(":", "object_name", "dependency_name"))
    return state.filter(~old).unionByName(moved.select(state.columns))
