"""Dealing rows out for grouped Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to spark.sql.shuffle.partitions tasks, which stay as many however few bytes they hold.

    A grouped function costs time by group, not by byte: without this, adaptive execution joins small partitions and runs most groups in one task. A
    groupBy on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
