"""Places of pings and stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .intervals import point_in_interval


def poi_layer(spark, polygons: dict[str, str]) -> DataFrame:
    """(location_id, part, ring, holes) from WKT; rings are closed."""
    closed = lambda ring: [{"x": float(x), "y": float(y)} for x, y in (ring if ring[0] == ring[-1] else [*ring, ring[0]])]
    rows = [(name, k, closed(shell), [closed(h) for h in holes]) for name, wkt in polygons.items() for k, (shell, *holes) in enumerate(geo.parse_wkt(wkt))]
    return spark.createDataFrame(rows, "location_id string, part int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


#: Cells with their polygons that are sent to every executor; more are joined by shuffle.
MAX_CELLS = 100_000


def poi_map(points: DataFrame, pois: DataFrame, max_distance: float = 0.0, coords: tuple[str, str] = ("x", "y"), cell: float | None = None) -> DataFrame:
    """points with the location_id of the polygon that strictly contains each (holes are outside), the smallest if several do, null if none.

    With max_distance the nearest polygon within it, in units of the coordinates, ties by id. Each square cell holds the polygons whose boxes, padded by the distance,
    touch it; a point is looked up in its cell by one left join. Cells are as large as a polygon's box is on average, so degrees and metres both do.
    """
    xs, ys = (lambda f: f(F.transform("ring", lambda p: p["x"]))), (lambda f: f(F.transform("ring", lambda p: p["y"])))
    pad = float(max_distance)
    holes = F.col("holes") if "holes" in pois.columns else F.array().cast(pois.select(F.array("ring")).dtypes[0][1])
    boxed = pois.select("location_id", "ring", holes.alias("holes"), (xs(F.array_min) - pad).alias("x0"), (xs(F.array_max) + pad).alias("x1"), (ys(F.array_min) - pad).alias("y0"), (ys(F.array_max) + pad).alias("y1"))
    size = float(cell or boxed.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0)
    placed = boxed.withColumn("__cx", F.explode(_cells(F.col("x0"), F.col("x1"), size))).withColumn("__cy", F.explode(_cells(F.col("y0"), F.col("y1"), size)))
    cells = placed.groupBy("__cx", "__cy").agg(F.collect_list(F.struct("location_id", "ring", "holes", "x0", "x1", "y0", "y1")).alias("__near"))
    if cells.count() <= MAX_CELLS:
        cells = F.broadcast(cells)
    x, y = (F.col(c).cast("double") for c in coords)
    out = points.drop("location_id").withColumns({"__cx": F.floor(x / size).cast("long"), "__cy": F.floor(y / size).cast("long")}).join(cells, ["__cx", "__cy"], "left")
    boxes = F.filter("__near", lambda p: x.between(p["x0"], p["x1"]) & y.between(p["y0"], p["y1"]))
    inside = lambda p: geo.polygon_contains(x, y, p["ring"], p["holes"])
    if max_distance <= 0:
        found = F.array_min(F.transform(F.filter(boxes, inside), lambda p: p["location_id"]))
    else:
        edge = lambda p: F.array_min(F.transform(F.concat(F.array(p["ring"]), p["holes"]), lambda r: geo.ring_distance(x, y, r)))
        far = F.transform(boxes, lambda p: F.struct(F.when(inside(p), 0.0).otherwise(edge(p)).alias("d"), p["location_id"].alias("l")))
        found = F.array_min(F.filter(far, lambda m: m["d"] <= pad))["l"]
    return out.withColumn("location_id", found).select(*[c for c in points.columns if c != "location_id"], "location_id")


def cluster_locations(labelled: DataFrame, pois: DataFrame, method: str = "centroid", coords: tuple[str, str] = ("x", "y"), keys: tuple[str, ...] = ("user_id",), label: str = "cluster") -> DataFrame:
    """Pings with one place per cluster: that of its mean point, or its pings' most frequent one (ties: the smallest). Noise has none."""
    by = [*keys, label]
    own = labelled.where(F.col(label) != -1)
    if method == "centroid":
        means = own.groupBy(*by).agg(*[F.avg(c).alias(c) for c in coords])
        placed = poi_map(means, pois, 0.0, coords).select(*by, "location_id")
    elif method == "majority":
        counts = poi_map(own, pois, 0.0, coords).where("location_id is not null").groupBy(*by, "location_id").agg(F.count("*").alias("__n"))
        placed = counts.groupBy(*by).agg(F.min(F.struct(-F.col("__n"), F.col("location_id"))).alias("__m")).select(*by, F.col("__m.location_id").alias("location_id"))
    else:
        raise ValueError(method)
    return labelled.drop("location_id").join(placed, by, "left")


def oracle_map(pings: DataFrame, visits: DataFrame, point_id: str = "ping_id", time: str = "timestamp", start: str = "start_timestamp", end: str = "end_timestamp", on: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Pings with the place of the true visit [start, end) that holds them; the visit that begins last wins, places that are null are travel."""
    known = visits.where("location_id is not null").select(*on, start, end, F.col("location_id").alias("__loc"))
    met = point_in_interval(pings.select(*on, point_id, time), known, time, start, end, on)
    found = met.groupBy(point_id).agg(F.max(F.struct(start, end, "__loc")).alias("__m")).select(point_id, F.col("__m.__loc").alias("location_id"))
    return pings.drop("location_id").join(found, point_id, "left")


def summarize_locations(points: DataFrame, location: str = "location_id", coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Per place the number of points and their mean; a convex hull comes from stops.shapes."""
    return points.where(F.col(location).isNotNull()).groupBy(location).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in coords])


def condense_destinations(diary: DataFrame, keys: tuple[str, ...] = ("user_id",), time: str = "timestamp", location: str = "location", duration: str = "duration", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Condense a diary: consecutive entries of one place (two nulls too) become one, durations summed.

    Entries of one time are compared in the order of tiebreak columns, but are one entry, of the smallest of their places.
    """
    w = Window.partitionBy(*keys).orderBy(time, *tiebreak)
    new = (~F.col(location).eqNullSafe(F.lag(location).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    upto = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = diary.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto))
    return runs.groupBy(*keys, "__run").agg(F.min(time).alias(time), F.sum(duration).alias(duration), F.min(location).alias(location)).drop("__run")


def box_overlap(polygons: DataFrame, size: float = 100.0) -> DataFrame:
    """Remove repeated boxes and boxes inside others: (location_id, x0, y0, x1, y1); of equal ones the smallest id stays. Ids are distinct.

    Equal boxes become one before boxes meet in square cells, so copies of a box form no pairs.
    """
    sides = ["x0", "y0", "x1", "y1"]
    first = polygons.groupBy(*sides).agg(F.min("location_id").alias("__first"))
    cells = first.select(*sides, F.explode(_cells(F.col("x0"), F.col("x1"), size)).alias("__cx")).withColumn("__cy", F.explode(_cells(F.col("y0"), F.col("y1"), size)))
    # An inner box lies in the outer one's cells, so the cell of its corner is enough.
    inner = first.select(*[F.col(c).alias(f"i_{c}") for c in sides], F.floor(F.col("x0") / size).cast("long").alias("__cx"), F.floor(F.col("y0") / size).cast("long").alias("__cy"))
    inside = (F.col("i_x0") >= F.col("x0")) & (F.col("i_y0") >= F.col("y0")) & (F.col("i_x1") <= F.col("x1")) & (F.col("i_y1") <= F.col("y1"))
    equal = (F.col("i_x0") == F.col("x0")) & (F.col("i_y0") == F.col("y0")) & (F.col("i_x1") == F.col("x1")) & (F.col("i_y1") == F.col("y1"))
    covered = inner.join(cells, ["__cx", "__cy"]).where(inside & ~equal).select(*[F.col(f"i_{c}") for c in sides]).distinct()
    same = lambda other, names: F.lit(True) if not names else F.col(names[0]).eqNullSafe(F.col(f"{other}{names[0]}")) & same(other, names[1:])
    kept = first.join(covered, same("i_", sides), "left_anti").select(F.col("__first").alias("k_location_id"), *[F.col(c).alias(f"k_{c}") for c in sides])
    return polygons.join(kept, same("k_", ["location_id", *sides]), "left_semi")


def blocks_in_boxes(boxes: DataFrame, block: float = 1.0) -> DataFrame:
    """(location_id, coord_x, coord_y): grid blocks that a box covers with some area."""
    last = lambda c: (F.ceil(F.col(c) / block) - 1).cast("long")
    first = lambda c: F.floor(F.col(c) / block).cast("long")
    out = boxes.where("x1 > x0 and y1 > y0").withColumn("coord_x", F.explode(F.sequence(first("x0"), last("x1"))))
    return out.withColumn("coord_y", F.explode(F.sequence(first("y0"), last("y1")))).select("location_id", "coord_x", "coord_y")


def raster_blocks(layers: DataFrame, priority: Sequence[str], block: float = 1.0, kind: str = "kind") -> DataFrame:
    """(coord_x, coord_y, kind, location_id) of the blocks that boxes (location_id, x0, y0, x1, y1) of several kinds touch.

    A block is of the kind that comes first in priority, kinds that are not in it last and by name; of boxes of one kind the smallest id has it. So equal boxes
    of a kind are one before they are cut into blocks, and blocks are summed by kind before kinds are compared: both by hashes, without sorting all blocks.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)).cast("int"), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(priority) + 1)
    scaled = layers.select("location_id", F.col(kind).alias("kind"), rank.alias("__rank"), *[(F.col(c) / block).alias(c) for c in ("x0", "y0", "x1", "y1")])
    xs = F.sequence(F.floor("x0").cast("long"), F.greatest(F.floor("x0").cast("long"), F.ceil("x1").cast("long") - 1))
    ys = F.sequence(F.floor("y0").cast("long"), F.greatest(F.floor("y0").cast("long"), F.ceil("y1").cast("long") - 1))
    boxes = scaled.groupBy("x0", "y0", "x1", "y1", "__rank", "kind").agg(F.min("location_id").alias("location_id"))
    cells = boxes.withColumn("coord_x", F.explode(xs)).withColumn("coord_y", F.explode(ys))
    kinds = cells.groupBy("coord_x", "coord_y", "__rank", "kind").agg(F.min("location_id").alias("location_id"))
    best = kinds.groupBy("coord_x", "coord_y").agg(F.min(F.struct("__rank", "kind", "location_id")).alias("__b"))
    return best.select("coord_x", "coord_y", "__b.kind", "__b.location_id")
