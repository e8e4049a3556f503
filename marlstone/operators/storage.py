"""Frames that loops keep between rounds, in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """df computed once and cut off from its lineage by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="marlstone-"))
    # new names of the columns, so that what Spark keeps of the partitioning does not speak of columns that are gone
    return df.select([F.col(f"`{c}`").alias(c) for c in df.columns]).checkpoint(eager=True)
