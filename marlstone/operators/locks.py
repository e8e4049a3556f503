"""Names of locks: a number for each place that state is kept in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lock_key(host: Column, port: Column, name: Column) -> Column:
    """A positive 60-bit number of host:port/name, equal on all machines; null where a part is null."""
    return F.conv(F.left(F.sha2(F.concat(host, F.lit(":"), port.cast("string"), F.lit("/"), name), 256), F.lit(15)), 16, 10).cast("long")
