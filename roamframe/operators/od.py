"""Origin and destination tables and their noisy shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import share


def laplace(scale: Column, seed: int, *keys: str) -> Column:
    """Laplace noise from a hash of row keys, so that it does not depend on partitions; the least share, which has no logarithm, counts as the next one."""
    u = F.greatest(share(seed, *keys), F.lit(2.0**-52)) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def flows(od: DataFrame, origin: str = "origin", dest: str = "dest", weight: str = "weight", eps: float | None = None, seed: int = 0) -> DataFrame:
    """Percentage of the total weight; with eps, shares get Laplace(1 / (N eps)) noise, are cut at 0 and normalised again."""
    total = F.broadcast(od.agg(F.sum(weight).alias("__t")))
    out = od.select(origin, dest, weight).join(total).withColumn("__p", F.try_divide(F.col(weight), F.col("__t")))
    if eps is not None:
        noisy = F.greatest(F.lit(0.0), F.col("__p") + laplace(1 / (F.col("__t") * eps), seed, origin, dest))
        out = out.withColumn("__p", noisy)
        out = out.join(F.broadcast(out.agg(F.sum("__p").alias("__s")))).withColumn("__p", F.try_divide(F.col("__p"), F.col("__s")))
    return out.select(origin, dest, weight, (F.col("__p") * 100).alias("pct"))


def remained(od: DataFrame, origin: str = "origin", dest: str = "dest", weight: str = "weight", eps: float | None = None, seed: int = 0) -> DataFrame:
    """Per origin the percentage of its weight that stays; noise has each row's own scale and is not normalised."""
    grouped = od.groupBy(origin).agg(F.sum(weight).alias("__t"), F.sum(F.when(F.col(origin) == F.col(dest), F.col(weight))).alias("__r")).where("__r is not null")
    part = F.try_divide(F.col("__r"), F.col("__t"))
    if eps is not None:
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), part + laplace(1 / (F.col("__t") * eps), seed, origin)))
    return grouped.select(origin, F.col("__r").alias(weight), (part * 100).alias("pct"))


def moved(od: DataFrame, origin: str = "origin", dest: str = "dest", weight: str = "weight", eps: float | None = None, seed: int = 0) -> DataFrame:
    """Flows between different places as percentages of all that moved."""
    return flows(od.where(F.col(origin) != F.col(dest)), origin, dest, weight, eps, seed)


def top_k(od: DataFrame, k: int, by: str = "dest", weight: str = "weight") -> DataFrame:
    """The k destinations or origins of largest weight, with their share; ties by name."""
    sums = od.groupBy(by).agg(F.sum(weight).alias(weight))
    total = F.broadcast(sums.agg(F.sum(weight).alias("__t")))
    return sums.join(total).select(by, weight, F.try_divide(F.col(weight), F.col("__t")).alias("share")).orderBy(F.desc(weight), by).limit(k)


def tally(homes: DataFrame, workplaces: DataFrame) -> DataFrame:
    """Users by home and workplace."""
    h = homes.select("user_id", F.col("location_id").alias("origin"))
    return h.join(workplaces.select("user_id", F.col("location_id").alias("dest")), "user_id").groupBy("origin", "dest").agg(F.count("*").alias("weight"))


def map_layers(od: DataFrame, w_min: float = 0, origin: str = "origin", dest: str = "dest", weight: str = "weight") -> DataFrame:
    """What a flow map draws: flows of at least w_min, their destination's inflow, and a line width from 0 to 1."""
    kept = od.where((F.col(weight) >= w_min) & (F.col(origin) != F.col(dest)))
    inflow = F.sum(weight).over(Window.partitionBy(dest))
    top = F.broadcast(kept.agg(F.max(weight).alias("__m")))
    return kept.withColumn("inflow", inflow).join(top).withColumn("width", F.try_divide(F.col(weight), F.col("__m"))).drop("__m")
