"""Coverage of time buckets by user."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnMap
from ..functions import time as t
from .filters import seconds


def _hits(df: DataFrame, periods: int, freq: str, start, end, relative: bool, traj_cols, given) -> tuple[DataFrame, DataFrame, ColumnMap, int]:
    """(distinct user and bucket, each user's window as first bucket and end, names, seconds of a bucket).

    Buckets go from the one that holds start up to end, exclusive; a numeric time's last bucket takes all later records.
    """
    cols = ColumnMap.resolve(df.columns, traj_cols, **given).require(user=True)
    user, step = cols["user_id"], t.step_seconds(periods, freq)
    numeric = cols.time() in ("timestamp", "start_timestamp")
    s = seconds(df, cols)
    local = s + F.coalesce(F.col(cols["tz_offset"]), F.lit(0)) if cols.has("tz_offset") else s
    rows = df.select(F.col(user), local.alias("__s")).where("__s is not null")
    first = F.lit(t.literal_seconds(start)) if start is not None else F.min("__s")
    last = F.lit(t.literal_seconds(end)) if end is not None else F.max("__s")
    window = rows.groupBy(user).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"))
    if relative:
        span = window.select(user, (F.lit(t.literal_seconds(start)) if start is not None else F.col("__lo")).alias("__start"), (F.lit(t.literal_seconds(end)) if end is not None else F.col("__hi")).alias("__end"))
    else:
        shared = window.agg((first if start is not None else F.min("__lo")).alias("__start"), (last if end is not None else F.max("__hi")).alias("__end"))
        span = window.select(user).join(F.broadcast(shared))
    span = span.withColumn("__first", t.bin_of(F.col("__start"), step) * step).withColumn("__n", F.greatest(F.lit(0), F.ceil((F.col("__end") - F.col("__first")) / step)).cast("long"))
    place = t.bin_of(F.col("__s") - F.col("__first"), step)
    if numeric:
        place = F.least(place, F.col("__n") - 1)
    hits = rows.join(span, user).withColumn("__k", place).where("__k >= 0 and __k < __n").select(user, (F.col("__first") + F.col("__k") * step).alias("bucket")).distinct()
    return hits, span, cols, step


def coverage_matrix(df: DataFrame, periods: int = 1, freq: str = "h", start=None, end=None, relative: bool = False, traj_cols: Mapping[str, str] | None = None, wide: bool = False, **given: str) -> DataFrame:
    """(user, bucket, hit) for every bucket of every user's window; wide: a map from bucket to hit per user."""
    hits, span, cols, step = _hits(df, periods, freq, start, end, relative, traj_cols, given)
    user = cols["user_id"]
    spine = span.where("__n > 0").select(user, F.explode(F.sequence("__first", F.col("__first") + (F.col("__n") - 1) * step, F.lit(step).cast("long"))).alias("bucket"))
    out = spine.join(hits.withColumn("__hit", F.lit(1)), [user, "bucket"], "left").select(user, "bucket", F.coalesce("__hit", F.lit(0)).alias("hit"))
    if wide:
        return out.groupBy(user).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "hit")))).alias("hits"))
    return out


def completeness(df: DataFrame, periods: int = 1, freq: str = "h", agg_freq: str | None = None, start=None, end=None, relative: bool = False, traj_cols: Mapping[str, str] | None = None, **given: str) -> DataFrame:
    """Share of buckets hit per user, or per user and agg_freq bucket. Without agg_freq no spine of buckets is built."""
    if agg_freq is None:
        hits, span, cols, _ = _hits(df, periods, freq, start, end, relative, traj_cols, given)
        user = cols["user_id"]
        counted = hits.groupBy(user).agg(F.count("*").alias("__hits"))
        return span.where("__n > 0").join(counted, user, "left").select(user, (F.coalesce("__hits", F.lit(0)) / F.col("__n")).alias("completeness"))
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    big = t.step_seconds(1, agg_freq)
    matrix = coverage_matrix(df, periods, freq, start, end, relative, traj_cols, **given)
    return matrix.groupBy(cols["user_id"], (t.bin_of(F.col("bucket"), big) * big).alias("period")).agg(F.avg("hit").alias("completeness"))


def approximate_counts(df: DataFrame, user_id: str = "user_id", rsd: float = 0.05) -> DataFrame:
    """One row: the number of rows, and of users within a relative standard deviation, from a sketch of constant size."""
    return df.agg(F.count("*").alias("n_rows"), F.approx_count_distinct(user_id, rsd).alias("n_users"))


def pings_per_hour(df: DataFrame, user_id: str = "user_id", time: str = "timestamp", wide: bool = False) -> DataFrame:
    """Pings by user and hour of the record (Unix hour); wide: by user, a column for each hour of the day, 0 where there are none."""
    hours = df.select(user_id, F.floor(F.col(time) / 3600).cast("long").alias("hour"))
    if not wide:
        return hours.groupBy(user_id, "hour").agg(F.count("*").alias("n"))
    return hours.groupBy(user_id).agg(*[F.count(F.when(F.pmod("hour", F.lit(24)) == h, 1)).alias(f"h{h:02d}") for h in range(24)])
