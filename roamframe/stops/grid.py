"""Stops as runs of pings in one cell: window functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_minutes


def _runs(pings: DataFrame, time_thresh: float, keys: Sequence[str], time: str, location: str, tiebreak: Sequence[str]) -> DataFrame:
    """Pings with the number of their run; a run ends where the cell changes or a gap exceeds time_thresh minutes. Null cells are in no run."""
    w = Window.partitionBy(*keys).orderBy(time, *tiebreak)
    gap = F.col(time) - F.lag(time).over(w)
    new = ~F.col(location).eqNullSafe(F.lag(location).over(w)) | gap.isNull()
    if time_thresh != float("inf"):
        new |= gap > F.lit(time_thresh * 60)
    return pings.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w))


def _kept(size, first, last, location, min_cluster_size: int, dur_min: float):
    return location.isNotNull() & (size >= min_cluster_size) & (floor_minutes(last - first) >= dur_min)


def grid_labels(pings: DataFrame, time_thresh: float = float("inf"), min_cluster_size: int = 1, dur_min: float = 0, keys: Sequence[str] = ("user_id",), time: str = "timestamp", location: str = "location_id", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Pings with a cluster: runs that are kept are numbered from 0 per key in time order, other pings are -1."""
    runs = _runs(pings, time_thresh, keys, time, location, tiebreak)
    over = Window.partitionBy(*keys, "__run")
    runs = runs.withColumn("__keep", _kept(F.count("*").over(over), F.min(time).over(over), F.max(time).over(over), F.col(location), min_cluster_size, dur_min))
    w = Window.partitionBy(*keys).orderBy(time, *tiebreak)
    # A kept run adds one at its first ping.
    number = F.sum(F.col("__keep").cast("int") * F.col("__new")).over(w) - 1
    return runs.withColumn("cluster", F.when(F.col("__keep"), number).otherwise(F.lit(-1).cast("long"))).drop("__new", "__run", "__keep")


def grid_stops(pings: DataFrame, time_thresh: float = 120, min_cluster_size: int = 2, dur_min: float = 5, keys: Sequence[str] = ("user_id",), time: str = "timestamp", location: str = "location_id", tiebreak: Sequence[str] = ()) -> DataFrame:
    """A stop per kept run: one shuffle by the keys; runs are summed within their partition."""
    runs = _runs(pings, time_thresh, keys, time, location, tiebreak)
    gap = F.when(F.col("__new") == 0, F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time, *tiebreak)))
    sums = runs.withColumn("__gap", gap).groupBy(*keys, "__run").agg(
        F.min(time).alias("start_timestamp"), F.max(time).alias("end_timestamp"), F.count("*").alias("n_pings"), F.first(location).alias(location), F.coalesce(floor_minutes(F.max("__gap")), F.lit(0).cast("long")).alias("max_gap")
    )
    kept = sums.where(_kept(F.col("n_pings"), F.col("start_timestamp"), F.col("end_timestamp"), F.col(location), min_cluster_size, dur_min))
    return kept.withColumn("duration", floor_minutes(F.col("end_timestamp") - F.col("start_timestamp"))).drop("__run")
