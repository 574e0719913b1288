"""Stop tables: from labels to stops, splitting, merging, filling, padding. Times are Unix seconds, durations minutes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_minutes

START, END = "start_timestamp", "end_timestamp"
#: Columns of labelled pings that already say the gap to the stop's ping before, which ping is its medoid, and the diameter beside it.
SHAPES = ("__gap", "__medoid", "__diameter")


def summarize_stops(labelled: DataFrame, keys: Sequence[str] = ("user_id",), time: str = "timestamp", label: str = "cluster", dur_min: int = 0, coords: tuple[str, str] | None = None, geographic: bool = False, passthrough: Sequence[str] = (), passthrough_agg: Mapping[str, Column] | None = None) -> DataFrame:
    """A stop per key and label; noise (-1) and null labels are dropped.

    Start, end, duration, n_pings, max_gap (minutes), first of passthrough columns in time, mean ha if there is one; with coords also the medoid
    and the diameter (whole metres, half to even). Medoid and diameter come from the distances within a stop, in a grouped function, unless the labelled
    pings have them.
    """
    known = bool(coords) and set(SHAPES) <= set(labelled.columns)
    rows = labelled.where((F.col(label) != -1) & F.col(label).isNotNull())
    by = [*keys, label]
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    firsts = [F.min_by(c, time).alias(c) for c in passthrough]
    named = [a.alias(c) for c, a in (passthrough_agg or {}).items()]
    means = [F.avg("ha").alias("ha")] if "ha" in labelled.columns else []
    if known:
        named += [*[F.max(F.when(F.col("__medoid"), F.col(c))).alias(c) for c in coords], F.max("__diameter").alias("diameter")]
    out = (rows if known else rows.withColumn("__gap", gap)).groupBy(*by).agg(
        F.min(time).alias(START), F.max(time).alias(END), F.count("*").alias("n_pings"), F.coalesce(floor_minutes(F.max("__gap")), F.lit(0).cast("long")).alias("max_gap"), *firsts, *named, *means
    )
    out = out.withColumn("duration", floor_minutes(F.col(END) - F.col(START))).where(F.col("duration") >= dur_min)
    if known:
        return out.select(*[c for c in out.columns if c not in (*coords, "diameter")], *coords, "diameter")
    if coords:
        from ..stops.shapes import medoid_and_diameter

        out = out.join(medoid_and_diameter(rows, by, coords, geographic, time), by)
    return out


def explode_stops(stops: DataFrame, freq: str = "d", start: str = START, end: str = END) -> DataFrame:
    """Split stops at days, or at weeks from Monday; parts under a minute go, and columns that describe a whole stop too."""
    day = 86400
    if freq == "d":
        first, last, step, base = F.floor(F.col(start) / day), F.floor(F.col(end) / day), day, 0
    elif freq == "w":
        # 1970-01-05 was a Monday.
        step, base = 7 * day, 4 * day
        first, last = F.floor((F.col(start) - base) / step), F.floor((F.col(end) - base) / step)
    else:
        raise ValueError("freq is d or w")
    out = stops.withColumn("__k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    a = F.greatest(F.col(start), F.col("__k") * step + base)
    b = F.least(F.col(end), (F.col("__k") + 1) * step + base)
    out = out.withColumns({"__a": a, "__b": b}).withColumn("duration", floor_minutes(F.col("__b") - F.col("__a"))).where("duration > 0")
    dropped = [c for c in ("n_pings", "diameter", "max_gap", "identifier") if c in stops.columns]
    return out.withColumns({start: F.col("__a"), end: F.col("__b")}).drop("__a", "__b", "__k", *dropped)


def merge_stops(stops: DataFrame, max_gap_min: float, key: Sequence[str] = ("user_id",), location: str = "location_id", start: str = START, end: str = END) -> DataFrame:
    """Merge consecutive stops of one location, apart by at most max_gap_min from all earlier ends of the run; null places stay apart."""
    w = Window.partitionBy(*key).orderBy(start, end)
    changed = F.coalesce(F.col(location) != F.lag(location).over(w), F.lit(True))
    runs = stops.withColumn("__run", F.sum(changed.cast("int")).over(w))
    before = Window.partitionBy(*key, "__run").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    late = F.col(start) - F.max(end).over(before) > max_gap_min * 60
    runs = runs.withColumn("__new", F.coalesce(late, F.lit(True)).cast("int"))
    runs = runs.withColumn("__visit", F.sum("__new").over(Window.partitionBy(*key, "__run").orderBy(start, end)))
    extra = [F.sum("n_pings").alias("n_pings")] if "n_pings" in stops.columns else []
    out = runs.groupBy(*key, "__run", "__visit").agg(F.min(location).alias(location), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"), *extra)
    return out.withColumn("duration", floor_minutes(F.col(end) - F.col(start))).drop("__run", "__visit")


def fill_gaps(stops: DataFrame, first: int | None = None, last: int | None = None, key: Sequence[str] = ("user_id",), location: str = "location_id", start: str = START, end: str = END) -> DataFrame:
    """Stops and, between, before and after them, the gaps as rows of location 'None'."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cols = [*key, start, end, location]
    rows = stops.select(*cols).withColumns({"__reach": reach, "__next": F.lead(start).over(w), "__n": F.row_number().over(w)})
    part = lambda a, b, c: F.struct(a.cast("long").alias(start), b.cast("long").alias(end), c.alias(location))
    until = F.coalesce("__next", F.lit(last))
    parts = [part(F.col(start), F.col(end), F.col(location)), F.when(until > F.col("__reach"), part(F.col("__reach"), until, F.lit("None")))]
    if first is not None:
        parts.append(F.when((F.col("__n") == 1) & (F.col(start) > first), part(F.lit(first), F.col(start), F.lit("None"))))
    out = rows.select(*key, F.explode(F.array_compact(F.array(*parts))).alias("__p")).select(*key, "__p.*")
    return out.withColumn("duration", floor_minutes(F.col(end) - F.col(start)))


def overlapping_stops(stops: DataFrame, key: Sequence[str] = ("user_id",), start: str = START, end: str = END) -> DataFrame:
    """Per key whether a stop begins before the one before it ended."""
    w = Window.partitionBy(*key).orderBy(start, end)
    return stops.withColumn("__o", F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False))).groupBy(*key).agg(F.max("__o").alias("has_overlap"))


def pad_short_stops(stops: DataFrame, pad: int = 5, dur_min: int = 5, key: Sequence[str] = ("user_id",), start: str = START, end: str = END) -> DataFrame:
    """Lengthen stops of at most dur_min minutes by pad minutes, or half the gap to the next if that is less."""
    w = Window.partitionBy(*key).orderBy(start, end)
    nxt = F.coalesce(F.lead(start).over(w), F.col(end) + 3 * pad * 60)
    grow = F.least(F.floor((nxt - F.col(end)) / 2).cast("long"), F.lit(pad * 60).cast("long"))
    short = floor_minutes(F.col(end) - F.col(start)) <= dur_min
    out = stops.withColumn("__end", F.when(short & (grow > 0), F.col(end) + grow).otherwise(F.col(end)))
    return out.withColumn(end, F.col("__end")).drop("__end").withColumn("duration", floor_minutes(F.col(end) - F.col(start)))
