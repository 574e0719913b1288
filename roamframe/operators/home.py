"""Nights, workdays, homes and workplaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_minutes
from .intervals import daily_windows
from .stop_tables import END, START


def _local(df: DataFrame, name: str) -> Column:
    return F.col(name) + F.coalesce(F.col("tz_offset"), F.lit(0)) if "tz_offset" in df.columns else F.col(name)


def _date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def nocturnal_stops(stops: DataFrame, dusk_hour: float = 19, dawn_hour: float = 6) -> DataFrame:
    """Stops clipped to nights [day + dusk, next day + dawn), local; w_start, w_end, minutes, and the date the night begins on."""
    out = daily_windows(stops, _local(stops, START), _local(stops, END), dusk_hour, 24 - dusk_hour + dawn_hour, -1)
    out = out.withColumn("duration", floor_minutes(F.col("w_end") - F.col("w_start"))).where("duration > 0")
    return out.withColumn("date", _date(F.col("__day"))).drop("__day")


def workday_stops(stops: DataFrame, start_hour: float = 9, end_hour: float = 17, include_weekends: bool = False) -> DataFrame:
    """Stops clipped to working hours of local days."""
    if end_hour <= start_hour:
        raise ValueError("work ends after it begins, on the same day")
    out = daily_windows(stops, _local(stops, START), _local(stops, END), start_hour, end_hour - start_hour)
    out = out.withColumn("duration", floor_minutes(F.col("w_end") - F.col("w_start"))).where("duration > 0")
    out = out.withColumn("date", _date(F.col("__day"))).drop("__day")
    return out if include_weekends else out.where(F.weekday("date") < 5)


def _candidates(parts: DataFrame, days: str, iso_year_week: bool, min_dwell: int) -> DataFrame:
    week = F.weekofyear("date")
    if iso_year_week:
        week = F.extract(F.lit("YEAROFWEEK"), F.col("date")) * 100 + week
    daily = parts if not min_dwell else parts.groupBy("user_id", "location_id", "date").agg(F.sum("duration").alias("duration")).where(F.col("duration") >= min_dwell)
    return daily.where("location_id is not null").groupBy("user_id", "location_id").agg(F.countDistinct("date").alias(days), F.countDistinct(week).alias("num_weeks"), F.sum("duration").alias("total_duration"))


def candidate_homes(stops: DataFrame, dusk_hour: float = 19, dawn_hour: float = 6, iso_year_week: bool = False, min_dwell: int = 0) -> DataFrame:
    """Nights, weeks and minutes by user and place."""
    return _candidates(nocturnal_stops(stops, dusk_hour, dawn_hour), "num_nights", iso_year_week, min_dwell)


def candidate_workplaces(stops: DataFrame, start_hour: float = 9, end_hour: float = 17, include_weekends: bool = False, iso_year_week: bool = False) -> DataFrame:
    """Workdays, weeks and minutes by user and place."""
    return _candidates(workday_stops(stops, start_hour, end_hour, include_weekends), "num_work_days", iso_year_week, 0)


def _select(candidates: DataFrame, days: str, min_days: int, min_weeks: int, last_date) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc(days), F.desc("total_duration"), "location_id")
    best = candidates.where((F.col(days) >= min_days) & (F.col("num_weeks") >= min_weeks)).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return best.select("user_id", "location_id", days, "num_weeks", "total_duration", F.lit(last_date).cast("date").alias("date"))


def select_home(candidates: DataFrame, min_days: int = 1, min_weeks: int = 1, last_date: str | None = None) -> DataFrame:
    """The place of most nights, then minutes, then smallest id, per user."""
    return _select(candidates, "num_nights", min_days, min_weeks, last_date)


def select_workplace(candidates: DataFrame, min_days: int = 1, min_weeks: int = 1, last_date: str | None = None) -> DataFrame:
    return _select(candidates, "num_work_days", min_days, min_weeks, last_date)


def night_minutes(stops: DataFrame, dusk_hour: float = 19, dawn_hour: float = 6) -> DataFrame:
    """Minutes of each stop at night."""
    return nocturnal_stops(stops, dusk_hour, dawn_hour).groupBy("user_id", START, END).agg(F.sum("duration").alias("night_minutes"))
