"""How well detected stops match the truth, and summaries of such measures."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import floor_minutes
from .contacts import overlapping_visits, precision_recall_f1
from .stop_tables import END, START

STREET = "Street"


def visitation_errors(overlaps: DataFrame, truth: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Per user shares of true visits that are missed, merged (a stop that overlaps them spans another place) or split (by several stops of their place).

    overlaps: as overlapping_visits gives them, detected left, truth right. Starts of a user's true visits are distinct.
    """
    key = [*by, "right_start"]
    real = overlaps.where("right_location is not null and left_location is not null")
    spans = real.groupBy(*by, "left_start").agg(F.countDistinct("right_location").alias("__places"))
    joined = real.join(spans, [*by, "left_start"])
    per = joined.groupBy(*key).agg(F.max((F.col("__places") > 1).cast("int")).alias("merged"), (F.countDistinct(F.when(F.col("left_location") == F.col("right_location"), F.col("left_start"))) > 1).cast("int").alias("split"))
    visits = truth.where("location_id is not null").select(*by, F.col(START).alias("right_start"))
    all_ = visits.join(per, key, "left")
    return all_.groupBy(*by).agg(F.avg(F.col("merged").isNull().cast("int")).alias("missed_fraction"), F.avg(F.coalesce("merged", F.lit(0))).alias("merged_fraction"), F.avg(F.coalesce("split", F.lit(0))).alias("split_fraction"))


def stop_detection_metrics(stops: DataFrame, truth: DataFrame, prf_only: bool = True) -> DataFrame:
    """Per user precision, recall and F1 of minutes at the right place; null places are the street. Without predictions all are 0, all visits missed."""
    named = lambda df: df.withColumn("location_id", F.coalesce("location_id", F.lit(STREET)))
    minutes = lambda df, n: df.groupBy("user_id").agg(F.sum(floor_minutes(F.col(END) - F.col(START))).alias(n))
    shared = overlapping_visits(named(stops), named(truth), match_location=True).groupBy("user_id").agg(F.sum("overlap").alias("__shared"))
    out = minutes(truth, "__truth").join(minutes(stops, "__pred"), "user_id", "left").join(shared, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    measures = precision_recall_f1(zero("__pred"), zero("__truth"), zero("__shared"))
    names = ("precision", "recall", "f1")
    out = out.select("user_id", *[F.when(F.col("__pred").isNull(), 0.0).otherwise(m).alias(n) for m, n in zip(measures, names, strict=True)])
    if prf_only:
        return out
    return out.join(visitation_errors(overlapping_visits(stops, truth), truth), "user_id", "left")


def bootstrap_summary(data: DataFrame, metrics: Sequence[str], group: Sequence[str], unit: str, n_boot: int = 200, interval: float = 0.95, seed: int = 0) -> DataFrame:
    """Per group and metric the median of units' medians and a quantile interval of it over draws of units with replacement.

    A unit's weight in a draw is Poisson(1), from a hash of unit and draw, which needs no gathering of units.
    """
    long = data.unpivot([*group, unit], list(metrics), "metric", "value")
    units = long.groupBy(*group, "metric", unit).agg(F.median("value").alias("value"))
    draws = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(unit), F.col("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The distribution function of Poisson(1).
    cdf = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759]
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    drawn = draws.withColumn("__w", weight).where("__w > 0")
    medians = drawn.groupBy(*group, "metric", "draw").agg(F.percentile("value", F.lit(0.5), F.col("__w")).alias("m"))
    tail = (1 - interval) / 2
    spread = medians.groupBy(*group, "metric").agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))
    middle = units.groupBy(*group, "metric").agg(F.median("value").alias("median"), F.count("*").alias("n_units"))
    return middle.join(spread, [*group, "metric"])


def timing_summary(timings: DataFrame) -> DataFrame:
    """Number and mean seconds of runs by family."""
    return timings.groupBy("family").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"))


@dataclass
class AlgorithmRegistry:
    """Named algorithms with grids of parameters: a list gives its values, a tuple (low, high, n) as many even steps."""

    entries: list[dict] = field(default_factory=list)
    timings: list[dict] = field(default_factory=list)

    def add_algorithm(self, fn: Callable, family: str | None = None, granularity: str = "user", **params) -> None:
        family = family or f"{fn.__name__}_{len({e['family'] for e in self.entries})}"
        names, values = list(params), [self._values(v) for v in params.values()]
        for combination in itertools.product(*values):
            own = dict(zip(names, combination, strict=True))
            code = "_".join(f"{k}={v:g}" if isinstance(v, (int, float)) else f"{k}={v}" for k, v in own.items())
            self.entries.append({"id": f"{family}_{code}" if code else family, "family": family, "fn": fn, "granularity": granularity, "params": own})

    @staticmethod
    def _values(v) -> list:
        if isinstance(v, tuple):
            low, high, n = v
            return [low + (high - low) * i / max(n - 1, 1) for i in range(int(n))]
        return list(v) if isinstance(v, list) else [v]

    def __iter__(self) -> Iterator[dict]:
        return iter(self.entries)

    def __len__(self) -> int:
        return len(self.entries)

    def time_call(self, entry: Mapping, *args):
        began = time.perf_counter()
        out = entry["fn"](*args, **entry["params"])
        self.timings.append({"id": entry["id"], "family": entry["family"], "seconds": time.perf_counter() - began})
        return out

    def timing_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(x["id"], x["family"], x["seconds"]) for x in self.timings], "id string, family string, seconds double")
