"""What recorded definitions declare, as rows: signatures and results of routines, labels, fields and base types, operand types.

Rows are read from definitions once, when these are recorded, and stand in every snapshot ordered by kind and name; a lookup is a filter that reaches the Parquet
scan, and reads the row groups that may hold the name. Nothing is parsed to answer it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identify import SqlObject, identify

CATALOG = (
    "object_type string, schema string, name string, signature string, arguments array<struct<mode:string,name:string,type:string>>, returns string, returns_set boolean, "
    "labels array<string>, fields array<struct<name:string,type:string>>, base string, left_type string, right_type string, procedure string"
)
ROW = pa.schema([
    *[(c, pa.string()) for c in ("object_type", "schema", "name", "signature")], ("arguments", pa.list_(pa.struct([(c, pa.string()) for c in ("mode", "name", "type")]))), ("returns", pa.string()), ("returns_set", pa.bool_()),
    ("labels", pa.list_(pa.string())), ("fields", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))), *[(c, pa.string()) for c in ("base", "left_type", "right_type", "procedure")],
])


def row_of(o: SqlObject) -> dict:
    """What a definition declares; what its kind has not is null."""
    d = o.details
    args = d.get("args") if o.kind in ("function", "procedure", "aggregate") else None
    taken = [a for a in args or [] if a["mode"] in ("in", "inout", "variadic")]
    plain = lambda t: None if t is None else str(t)
    return {
        "object_type": o.kind, "schema": o.ident.schema, "name": o.ident.name, "signature": None if args is None else f"{o.ident}({', '.join(a['text'] for a in taken)})",
        "arguments": None if args is None else [{"mode": a["mode"], "name": a["name"], "type": a["text"]} for a in args],
        "returns": plain(d.get("returns") if o.kind != "aggregate" else d.get("state") if d.get("final") is None else None), "returns_set": d.get("set"),
        "labels": d.get("labels"), "fields": [{"name": f["name"], "type": f["text"]} for f in d["fields"]] if "fields" in d else None, "base": plain(d.get("base")),
        "left_type": plain(d.get("left")), "right_type": plain(d.get("right")), "procedure": plain(d.get("procedure")),
    }


def catalog_of(definitions: DataFrame) -> DataFrame:
    """The catalog rows of definitions (a column ddl)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify(t) for t in batch.column("ddl").to_pylist() if t]
            yield pa.RecordBatch.from_pylist([row_of(o) for o in found if o is not None], schema=ROW)

    return definitions.select("ddl").mapInArrow(read, CATALOG)


def entries(catalog: DataFrame, kinds: tuple[str, ...], name: str, schema: str | None = None) -> DataFrame:
    """The rows of a name: filters that are pushed to the scan."""
    found = catalog.filter(F.col("object_type").isin(*kinds) & (F.col("name") == name))
    return found.filter(F.col("schema").isNull() if schema is None else F.col("schema") == schema)


def signatures(catalog: DataFrame, name: str, schema: str | None = None) -> list[str]:
    """Signatures of all routines and aggregates of a name."""
    return sorted(r["signature"] for r in entries(catalog, ("function", "procedure", "aggregate"), name, schema).select("signature").collect())


def result_type(catalog: DataFrame, name: str, schema: str | None = None) -> str | None:
    row = entries(catalog, ("function",), name, schema).select("returns").first()
    return None if row is None else row["returns"]


def enum_labels(catalog: DataFrame, name: str, schema: str | None = None) -> list[str] | None:
    row = entries(catalog, ("type",), name, schema).filter("labels is not null").select("labels").first()
    return None if row is None else row["labels"]


def composite_fields(catalog: DataFrame, name: str, schema: str | None = None) -> list[tuple[str, str]] | None:
    row = entries(catalog, ("type",), name, schema).filter("fields is not null").select("fields").first()
    return None if row is None else [tuple(f) for f in row["fields"]]


def domain_base(catalog: DataFrame, name: str, schema: str | None = None) -> str | None:
    row = entries(catalog, ("domain",), name, schema).select("base").first()
    return None if row is None else row["base"]


def operator_signatures(catalog: DataFrame, name: str, schema: str | None = None) -> list[tuple[str | None, str | None, str | None]]:
    """(left type, right type, result) of the operators of a name; the result is that of the function behind one."""
    own = entries(catalog, ("operator",), name, schema).select("left_type", "right_type", F.split("procedure", r"\.").alias("p"))
    behind = catalog.filter("object_type = 'function'").select(F.col("schema").alias("_s"), F.col("name").alias("_n"), "returns")
    met = own.join(behind, (F.element_at("p", -1) == F.col("_n")) & F.when(F.size("p") > 1, F.col("p")[0]).eqNullSafe(F.col("_s")), "left")
    return sorted((tuple(r) for r in met.select("left_type", "right_type", "returns").collect()), key=str)
