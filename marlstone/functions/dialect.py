"""PostgreSQL's spelling of queries and types in Spark's dialect."""

from __future__ import annotations

import re

from .dependencies import TYPE_NAMES
from .sqltext import tokens

#: Spark's names of the catalog's types: fixed values.
SPARK_TYPES = {"int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "numeric": "decimal(38,10)", "bool": "boolean", "text": "string", "varchar": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"}


def spark_type(text: str) -> str:
    """Spark's name of a type, as written or as the catalog has it; a name that is not known stays."""
    name = " ".join(text.lower().split()).removeprefix("pg_catalog.")
    base, _, rest = name.partition("(")
    known = SPARK_TYPES.get(TYPE_NAMES.get(base.strip(), base.strip()))
    if rest:  # a length or precision
        return f"decimal({rest}" if known and known.startswith("decimal") else f"varchar({rest}" if known == "string" else known or text
    return known or text


def as_spark(body: str) -> str:
    """A PostgreSQL query in Spark's dialect, as far as spelling goes: JSON arrows, regular expressions, powers, series, casts to text.

    What stands in literals and quoted names stays as it is.
    """
    kept: list[str] = []

    def put(text: str) -> str:
        kept.append(text)
        return f"\x01{len(kept) - 1}\x01"

    out, at = [], 0
    for t in tokens(body):
        if t.kind in ("string", "quoted", "dollar"):
            out += [body[at : t.start], put(t.text if t.kind != "quoted" else "`" + t.name.replace("`", "``") + "`")]
            at = t.end
    body = "".join(out) + body[at:]
    body = re.sub(r"([\w.]+)\s*->>\s*\x01([0-9]+)\x01", lambda m: f"get_json_object({m[1]}, {put(chr(39) + '$.' + kept[int(m[2])][1:-1] + chr(39))})", body)
    body = re.sub(r"([\w.]+)\s*~\s*(\x01[0-9]+\x01)", r"\1 RLIKE \2", body)
    body = re.sub(r"(?i)::\s*(double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|[a-z_]\w*)(\s*\([0-9, ]+\))?", lambda m: f"::{spark_type(m[1] + (m[2] or ''))}", body)
    body = re.sub(r"([\w.]+|\([^()]*\))\s*\^\s*([\w.]+|\([^()]*\))", r"power(\1, \2)", body)
    body = re.sub(r"\bgenerate_series\s*\(\s*([^,()]+),\s*([^,()]+)\)", r"explode(sequence(\1, \2))", body, flags=re.I)
    return re.sub(r"\x01([0-9]+)\x01", lambda m: kept[int(m[1])], body)
