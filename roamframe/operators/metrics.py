"""Mobility metrics of stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .stop_tables import START, explode_stops


def period(freq: str | None, start: str = START) -> Column:
    """The first second of the day, the week from Monday, or the month."""
    if freq is None:
        return F.lit(0).cast("long")
    unit = {"d": "day", "w": "week", "m": "month"}[freq.lower()]
    return F.unix_seconds(F.date_trunc(unit, F.timestamp_seconds(F.col(start))))


def centroid(a: Column, b: Column, w: Column, geographic: bool) -> tuple[Column, Column]:
    """Aggregates: the weighted mean, of longitude and latitude as directions in space."""
    if not geographic:
        return F.sum(a * w) / F.sum(w), F.sum(b * w) / F.sum(w)
    lon, lat = F.radians(a), F.radians(b)
    x, y, z = F.sum(w * F.cos(lat) * F.cos(lon)), F.sum(w * F.cos(lat) * F.sin(lon)), F.sum(w * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.hypot(x, y)))


def radius_of_gyration(stops: DataFrame, freq: str = "d", weighted: bool = True, coords: tuple[str, str] = ("x", "y"), geographic: bool = False, exploded: bool = False, time_weights: str | None = None) -> DataFrame:
    """Per user and period the root of the mean squared distance from the weighted centroid: two aggregations over one shuffle's keys."""
    rows = explode_stops(stops, freq) if exploded else stops
    w = (F.col("duration") if weighted else F.lit(1)).cast("double")
    if time_weights:
        w = w * F.col(time_weights)
    keys = ["user_id", "period"]
    rows = rows.withColumn("period", period(freq)).withColumn("__w", w)
    a, b = (F.col(c) for c in coords)
    over = Window.partitionBy(*keys)
    if geographic:
        lon, lat = F.radians(a), F.radians(b)
        rows = rows.withColumns({"__x": F.sum(F.col("__w") * F.cos(lat) * F.cos(lon)).over(over), "__y": F.sum(F.col("__w") * F.cos(lat) * F.sin(lon)).over(over), "__z": F.sum(F.col("__w") * F.sin(lat)).over(over)})
        rows = rows.withColumns({"__a": F.degrees(F.atan2("__y", "__x")), "__b": F.degrees(F.atan2(F.col("__z"), F.hypot("__x", "__y")))})
    else:
        rows = rows.withColumn("__t", F.sum("__w").over(over))
        rows = rows.withColumns({"__a": F.try_divide(F.sum(a * F.col("__w")).over(over), F.col("__t")), "__b": F.try_divide(F.sum(b * F.col("__w")).over(over), F.col("__t"))})
    d = geo.distance((a, b), (F.col("__a"), F.col("__b")), geographic)
    return rows.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col("__w") * d * d), F.sum("__w"))).alias("rog"))


def self_containment(stops: DataFrame, threshold: float, freq: str | None = None, weighted: bool = True, coords: tuple[str, str] = ("x", "y"), geographic: bool = False, activity: str = "location_id", home: str = "home", start: str = START) -> DataFrame:
    """Share of stops away from home, by time or number, within threshold of the period's first home stop.

    Without home 0, with home alone 1, with weight 0 NaN.
    """
    rows = stops.withColumn("period", period(freq))
    over = Window.partitionBy("user_id", "period")
    is_home = F.coalesce(F.col(activity) == home, F.lit(False))
    place = F.min_by(F.struct(*coords), F.when(is_home, F.struct(F.col(start), *coords))).over(over)
    rows = rows.withColumn("__home", F.when(F.max(is_home).over(over), place))
    w = (F.col("duration") if weighted else F.lit(1)).cast("double")
    near = geo.distance([F.col(c) for c in coords], [F.col("__home")[c] for c in coords], geographic) <= threshold
    away = ~is_home
    out = rows.groupBy("user_id", "period").agg(F.max(is_home).alias("__h"), F.sum(away.cast("int")).alias("__n"), F.sum(F.when(away, w)).alias("__w"), F.coalesce(F.sum(F.when(away & near, w)), F.lit(0.0)).alias("__near"))
    share = F.when(~F.col("__h"), 0.0).when(F.col("__n") == 0, 1.0).when(F.col("__w") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("__near"), F.col("__w")))
    return out.select("user_id", "period", share.alias("self_containment"))


def social_interaction_potential(contacts: DataFrame, weight: str = "duration", users: Sequence[str] = ("user_id_1", "user_id_2")) -> DataFrame:
    """Summed weights of both users of each contact."""
    both = contacts.select(F.explode(F.array(*users)).alias("user_id"), F.col(weight).alias("__w"))
    return both.groupBy("user_id").agg(F.sum("__w").alias("sip"))
