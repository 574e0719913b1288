"""Row and user filters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ColumnMap
from ..functions import geo
from ..functions import time as t

# The comparison operators of filters.
_OPERATORS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def compile_filters(filters, cols: ColumnMap) -> Column:
    """One or several (column, operator, value) or Columns, all of which must hold. Columns stay raw, so that scans can use them."""
    if isinstance(filters, Column) or (isinstance(filters, tuple) and len(filters) == 3 and isinstance(filters[1], str)):
        filters = [filters]
    parts = []
    for f in filters:
        if isinstance(f, Column):
            parts.append(f)
            continue
        name, op, value = f
        if op not in _OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        parts.append(_OPERATORS[op](F.col(cols[name] if name in cols.names and name not in cols.present else name), F.lit(value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def seconds(df: DataFrame, cols: ColumnMap, key: str | None = None) -> Column:
    """Unix seconds of the table's time."""
    key = key or cols.time()
    name = cols[key]
    offset = F.col(cols["tz_offset"]) if cols.has("tz_offset") else None
    return t.unix_of(F.col(name), dict(df.dtypes)[name], offset)


def within(df: DataFrame, polygon, traj_cols: Mapping[str, str] | None = None, **given: str) -> DataFrame:
    """Rows strictly inside a polygon; its box is tested with range predicates first."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    a, b = cols.spatial()
    return df.where(geo.is_within(F.col(cols[a]), F.col(cols[b]), polygon))


def downsample(df: DataFrame, periods: int = 1, freq: str = "min", keep: str | bool = "first", traj_cols: Mapping[str, str] | None = None, tiebreak: str | None = None, **given: str) -> DataFrame:
    """At most one row per user and bin of local time: the first, the last, or, with keep False, only rows alone in their bin."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    s = seconds(df, cols)
    if cols.has("tz_offset"):
        s = s + F.coalesce(F.col(cols["tz_offset"]), F.lit(0))
    by = ([F.col(cols["user_id"])] if cols.has("user_id") else []) + [t.bin_of(s, t.step_seconds(periods, freq))]
    if keep is False:
        return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n = 1").drop("__n")
    order = [s] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*by).orderBy(*[c.desc() if keep == "last" else c for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def filter_users(df: DataFrame, start, end, polygon=None, min_active_days: int = 1, min_pings_per_day: int = 1, return_inside_only: bool = False, traj_cols: Mapping[str, str] | None = None, **given: str) -> DataFrame:
    """Rows in [start, end) of users with enough pings on enough local days, counted in the polygon."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given).require(user=True)
    user = cols["user_id"]
    s = seconds(df, cols)
    offset = F.col(cols["tz_offset"]) if cols.has("tz_offset") else None
    rows = df.where((s >= t.literal_seconds(start)) & (s < t.literal_seconds(end)))
    inside = rows
    if polygon is not None:
        a, b = cols.spatial()
        inside = rows.where(geo.is_within(F.col(cols[a]), F.col(cols[b]), polygon))
    days = inside.groupBy(user, t.yyyymmdd(s, offset).alias("__day")).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pings_per_day)
    users = days.groupBy(user).agg(F.count("*").alias("__days")).where(F.col("__days") >= min_active_days).select(user)
    return (inside if return_inside_only else rows).join(users, user, "left_semi")


def q_filter(df: DataFrame, qbar: float, traj_cols: Mapping[str, str] | None = None, **given: str) -> DataFrame:
    """Rows of users whose share of hours with a ping, of the hours of all data, is over qbar."""
    from .completeness import completeness

    cols = ColumnMap.resolve(df.columns, traj_cols, **given).require(user=True)
    users = completeness(df, 1, "h", traj_cols=traj_cols, **given).where(F.col("completeness") > qbar).select(cols["user_id"])
    return df.join(users, cols["user_id"], "left_semi")


def clip_spatial_outliers(df: DataFrame, lower_q: float = 0.01, upper_q: float = 0.99, traj_cols: Mapping[str, str] | None = None, approximate: bool = True, **given: str) -> DataFrame:
    """Rows inside the box of coordinate quantiles; one row of bounds is broadcast.

    Quantiles are off by at most one rank in 10,000; exact ones gather all distinct coordinates in one task, and are for tables of known size.
    """
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    a, b = (cols[k] for k in cols.spatial())
    of = F.percentile_approx if approximate else F.percentile
    q = df.agg(*[of(c, v).alias(n) for c, v, n in ((a, lower_q, "__a0"), (a, upper_q, "__a1"), (b, lower_q, "__b0"), (b, upper_q, "__b1"))])
    boxed = df.join(F.broadcast(q))
    return boxed.where(F.col(a).between(F.col("__a0"), F.col("__a1")) & F.col(b).between(F.col("__b0"), F.col("__b1"))).select(*df.columns)
