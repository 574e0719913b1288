"""Interval joins and interval slicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_S = 3600
#: Blocks of joins that have other keys too: rows are dealt by those already, so intervals are cut less.
KEYED_BLOCK_S = 4 * 3600


def _blocks(df: DataFrame, start: str, end: str, block: int) -> DataFrame:
    """A row per time block that an interval touches; empty intervals touch none."""
    span = F.sequence(F.floor(F.col(start) / block).cast("long"), F.floor((F.col(end) - 1) / block).cast("long"))
    return df.where(F.col(end) > F.col(start)).withColumn("__block", F.explode(span))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str] = (), start: tuple[str, str] = ("l_start", "r_start"), end: tuple[str, str] = ("l_end", "r_end"), block: int | None = None, condition: Column | None = None) -> DataFrame:
    """Pairs of rows whose [start, end) overlap; other columns must not clash.

    Rows meet in time blocks, with the same keys if there are any, so a busy key forms pairs within a block alone; a pair counts in the block of the
    later start, so that none comes twice. Sizes are known only after the explosion, so the join is a merge, never a broadcast by an estimate.
    """
    (s1, s2), (e1, e2) = start, end
    overlap = (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))
    if condition is not None:
        overlap &= condition
    block = block or (KEYED_BLOCK_S if on else BLOCK_S)
    a, b = _blocks(left, s1, e1, block), _blocks(right, s2, e2, block)
    joined = a.join(b.hint("merge"), [*on, "__block"]).where(overlap & (F.col("__block") == F.floor(F.greatest(s1, s2) / block).cast("long")))
    return joined.drop("__block")


def overlap_pairs(df: DataFrame, start: str = "start", end: str = "end", block: int = BLOCK_S) -> DataFrame:
    """(block, n): how many pairs of [start, end) overlap, by the time block of the later start; no pair is formed.

    A start meets all intervals that are going on then, so it is enough to keep count of them: within a block by a running sum, from block to block by
    the sum of what each block adds. Empty intervals meet none.
    """
    edge = lambda c, step: F.struct(F.col(c).alias("t"), F.lit(step).cast("long").alias("d"))
    edges = df.where(F.col(end) > F.col(start)).select(F.explode(F.array(edge(start, 1), edge(end, -1))).alias("e")).select("e.*").withColumn("block", F.floor(F.col("t") / block).cast("long"))
    earlier = Window.partitionBy("block").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, -1)
    met = edges.withColumn("on", F.coalesce(F.sum("d").over(earlier), F.lit(0))).groupBy("block").agg(F.sum("d").alias("net"), F.sum(F.when(F.col("d") > 0, F.col("on"))).alias("inner"), F.count(F.when(F.col("d") > 0, 1)).alias("starts"))
    # One row a block from here on.
    going = F.coalesce(F.sum("net").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("going", going).where("starts > 0").select("block", (F.col("inner") + F.col("starts") * F.col("going")).alias("n"))


def overlap_counts(left: DataFrame, right: DataFrame, by: Sequence[str], start: tuple[str, str] = ("l_start", "r_start"), end: tuple[str, str] = ("l_end", "r_end"), block: int = BLOCK_S) -> DataFrame:
    """(by, n): how many pairs of [start, end) of left and right overlap, by columns of left; no pair is formed.

    An interval meets those of right that begin before its end, but for those that ended by its start: both numbers are running sums over right's edges, within
    a block of seconds and from block to block. Edges of one second are summed first, so a block has at most its seconds times the groups. Empty intervals
    meet none.
    """
    (s1, s2), (e1, e2) = start, end

    def edges(df: DataFrame, s: str, e: str, names: tuple[str, str], cols: list[Column]) -> DataFrame:
        edge = lambda c, k: F.struct(F.col(c).cast("long").alias("t"), F.lit(int(k == 0)).cast("long").alias(names[0]), F.lit(int(k == 1)).cast("long").alias(names[1]))
        return df.where(F.col(e) > F.col(s)).select(*cols, F.explode(F.array(edge(s, 0), edge(e, 1))).alias("e")).select(*[f"__k{i}" for i in range(len(by))], "__right", "e.*")

    none = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).schema
    mine = edges(left, s1, e1, ("a0", "a1"), [*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.lit(False).alias("__right")])
    theirs = edges(right, s2, e2, ("b0", "b1"), [*[F.lit(None).cast(f.dataType).alias(f.name) for f in none.fields], F.lit(True).alias("__right")])
    keys = [f.name for f in none.fields]
    rows = mine.unionByName(theirs, allowMissingColumns=True).groupBy(*keys, "__right", "t").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("a0", "a1", "b0", "b1")])
    rows = rows.withColumn("block", F.floor(F.col("t") / block).cast("long"))
    w = Window.partitionBy("block").orderBy("t")
    # Starts of right before t, ends of right up to t.
    begun = F.coalesce(F.sum("b0").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("b1").over(w.rangeBetween(Window.unboundedPreceding, 0))
    inner = F.col("a1") * F.col("begun") - F.col("a0") * F.col("over")
    per = rows.withColumns({"begun": begun, "over": over}).groupBy("block", "__right", *keys).agg(F.sum(inner).alias("inner"), *[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])
    # One row a block and group from here on.
    before = Window.orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("b0", "b1")}
    whole = per.withColumns({"begun": carried["b0"], "over": carried["b1"]}).where("not __right")
    return whole.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)]).agg(F.sum(F.col("inner") + inner).alias("n")).where("n > 0")


def point_in_interval(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, on: Sequence[str] = (), block: int = BLOCK_S) -> DataFrame:
    """Pairs of a point and a [start, end) that holds it, by time block and keys."""
    p = points.withColumn("__block", F.floor(F.col(time) / block).cast("long"))
    q = _blocks(intervals, start, end, block)
    return p.join(q.hint("merge"), ["__block", *on]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__block")


def daily_windows(df: DataFrame, start: Column, end: Column, from_h: float, hours: float, first_day: int = 0) -> DataFrame:
    """A row per day whose window [day + from_h, + hours) meets [start, end], clipped: columns w_start and w_end, local seconds."""
    day = 86400
    lo, hi = F.floor(start / day).cast("long") + first_day, F.floor(end / day).cast("long")
    w0 = F.col("__day") * day + F.lit(int(from_h * 3600))
    w1 = w0 + F.lit(int(hours * 3600))
    out = df.withColumns({"__s": start, "__e": end}).withColumn("__day", F.explode(F.sequence(lo, hi)))
    return out.withColumns({"w_start": F.greatest("__s", w0), "w_end": F.least("__e", w1)}).where("w_end > w_start").drop("__s", "__e")
