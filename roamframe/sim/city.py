"""Grid cities: blocks, buildings and streets; distances and gravity."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut_lineage

KINDS = ("home", "workplace", "retail", "park")


@dataclass
class Building:
    id: str
    kind: str
    blocks: list[tuple[int, int]]
    door: tuple[int, int]


@dataclass
class City:
    """width by height blocks; a block is a street, part of a building, or free."""

    width: int
    height: int
    streets: set[tuple[int, int]] = field(default_factory=set)
    buildings: dict[str, Building] = field(default_factory=dict)
    at: dict[tuple[int, int], str] = field(default_factory=dict)

    def add_street(self, x: int, y: int) -> None:
        if (x, y) in self.at:
            raise ValueError("the block has a building")
        self.streets.add((x, y))

    def add_building(self, kind: str, door: tuple[int, int], blocks: list[tuple[int, int]]) -> Building:
        """door: the street block that the building opens to; one of the blocks lies beside it."""
        if door not in self.streets:
            raise ValueError("a door is on a street")
        if any(b in self.at or b in self.streets or not (0 <= b[0] < self.width and 0 <= b[1] < self.height) for b in blocks):
            raise ValueError("a block is taken or outside")
        if not any(adjacent(b, door) for b in blocks):
            raise ValueError("no block lies beside the door")
        b = Building(f"{kind[0]}-x{blocks[0][0]}-y{blocks[0][1]}", kind, list(blocks), door)
        self.buildings[b.id] = b
        self.at.update(dict.fromkeys(blocks, b.id))
        return b

    def neighbours(self, block: tuple[int, int]) -> list[tuple[int, int]]:
        x, y = block
        return [q for q in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if q in self.streets]

    def path(self, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
        """A shortest way on streets, empty if there is none; breadth first."""
        came, todo = {start: start}, deque([start])
        while todo and end not in came:
            block = todo.popleft()
            for q in self.neighbours(block):
                if q not in came:
                    came[q] = block
                    todo.append(q)
        if end not in came:
            return []
        out = [end]
        while out[-1] != start:
            out.append(came[out[-1]])
        return out[::-1]

    def connected(self) -> bool:
        if not self.streets:
            return True
        first = min(self.streets)
        seen, todo = {first}, [first]
        while todo:
            for q in self.neighbours(todo.pop()):
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return len(seen) == len(self.streets)


def adjacent(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1


def random_city(width: int, height: int, spacing: int = 5, seed: int = 0) -> City:
    """Streets every spacing blocks; kinds by distance from the middle; buildings of one to three blocks beside streets."""
    rng, city = np.random.default_rng(seed), City(width, height)
    for x in range(width):
        for y in range(height):
            if x % spacing == 0 or y % spacing == 0:
                city.add_street(x, y)
    middle = np.array([width, height]) / 2
    for x in range(width):
        for y in range(height):
            block = (x, y)
            if block in city.streets or block in city.at:
                continue
            door = next(iter(city.neighbours(block)), None)
            if door is None:
                continue
            near = 1 - np.abs(np.array(block) - middle).max() / middle.max()
            kind = str(rng.choice(KINDS, p=np.array([0.55 - 0.3 * near, 0.2 + 0.2 * near, 0.15 + 0.1 * near, 0.1])))
            blocks = [block]
            for _ in range(int(rng.integers(0, 3))):
                free = [q for q in ((blocks[-1][0], blocks[-1][1] + 1), (blocks[-1][0] + 1, blocks[-1][1])) if q not in city.streets and q not in city.at and q not in blocks and q[0] < width and q[1] < height]
                if free:
                    blocks.append(free[0])
            city.add_building(kind, door, blocks)
    return city


def to_frames(spark: SparkSession, city: City) -> dict[str, DataFrame]:
    """blocks, buildings and streets as DataFrames."""
    blocks = [(x, y, city.at.get((x, y)), "street" if (x, y) in city.streets else city.buildings[city.at[x, y]].kind if (x, y) in city.at else None) for x in range(city.width) for y in range(city.height)]
    buildings = [(b.id, b.kind, b.door[0], b.door[1], len(b.blocks), [{"x": x, "y": y} for x, y in b.blocks]) for b in city.buildings.values()]
    return {
        "blocks": spark.createDataFrame(blocks, "coord_x int, coord_y int, building_id string, kind string"),
        "buildings": spark.createDataFrame(buildings, "id string, building_type string, door_cell_x int, door_cell_y int, size int, blocks array<struct<x:int,y:int>>"),
        "streets": spark.createDataFrame(sorted(city.streets), "coord_x int, coord_y int"),
    }


def adjacency(streets: DataFrame) -> DataFrame:
    """(src_x, src_y, dst_x, dst_y) of street blocks side by side: an equi-join with shifted blocks."""
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    a = streets.select(F.col("coord_x").alias("src_x"), F.col("coord_y").alias("src_y"), shifts.alias("s"))
    a = a.select("src_x", "src_y", (F.col("src_x") + F.col("s.i")).alias("dst_x"), (F.col("src_y") + F.col("s.j")).alias("dst_y"))
    return a.join(streets.select(F.col("coord_x").alias("dst_x"), F.col("coord_y").alias("dst_y")), ["dst_x", "dst_y"]).select("src_x", "src_y", "dst_x", "dst_y")


def components(streets: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(coord_x, coord_y, component) by spreading the smallest block number until nothing changes; an error if max_rounds are too few for that."""
    number = lambda x, y: F.col(x).cast("long") * (1 << 20) + F.col(y)
    edges = adjacency(streets).select(number("src_x", "src_y").alias("a"), number("dst_x", "dst_y").alias("b"))
    edges = cut_lineage(edges)
    labels = streets.select("coord_x", "coord_y", number("coord_x", "coord_y").alias("n")).withColumn("component", F.col("n"))
    before = None
    for _ in range(max_rounds):
        least = edges.join(labels.select(F.col("n").alias("b"), "component"), "b").groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
        labels = labels.join(least, "n", "left").select("coord_x", "coord_y", "n", F.least("component", F.coalesce("m", "component")).alias("component"))
        # Jump to the component of the component.
        up = labels.select(F.col("n").alias("component"), F.col("component").alias("c2"))
        labels = cut_lineage(labels.join(up, "component").select("coord_x", "coord_y", "n", F.col("c2").alias("component")))
        now = labels.agg(F.sum("component")).first()[0]
        if now == before:
            return labels.select("coord_x", "coord_y", "component")
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def largest_component(streets: DataFrame) -> DataFrame:
    """The street blocks of the largest component (the smallest number of equal ones), which a city keeps."""
    found = components(streets)
    top = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(top.select("component")), "component", "left_semi").select("coord_x", "coord_y")


def gravity(buildings: DataFrame, exponent: float = 2.0, n_hubs: int | None = None) -> DataFrame:
    """(origin, dest, gravity): 1 / distance ** exponent of doors, Manhattan, at least 1; 0 to itself.

    With hubs the distance is to the nearest hub, between hubs, and on; the hub table has n_hubs rows and is broadcast, all pairs are made only on reading.
    """
    a = buildings.select(F.col("id").alias("origin"), F.col("door_cell_x").alias("ax"), F.col("door_cell_y").alias("ay"))
    b = buildings.select(F.col("id").alias("dest"), F.col("door_cell_x").alias("bx"), F.col("door_cell_y").alias("by"))
    direct = F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))
    if n_hubs is None:
        pairs = a.crossJoin(b).withColumn("d", direct)
    else:
        hubs = buildings.orderBy(F.xxhash64("id")).limit(n_hubs).select(F.col("door_cell_x").alias("hx"), F.col("door_cell_y").alias("hy"))

        def nearest(side: DataFrame, key: str, x: str, y: str, p: str) -> DataFrame:
            d = F.abs(F.col(x) - F.col("hx")) + F.abs(F.col(y) - F.col("hy"))
            return side.join(F.broadcast(hubs)).groupBy(key, x, y).agg(F.min(F.struct(d.alias("d"), "hx", "hy")).alias(p))

        pairs = nearest(a, "origin", "ax", "ay", "p").crossJoin(nearest(b, "dest", "bx", "by", "q"))
        via = F.col("p.d") + F.abs(F.col("p.hx") - F.col("q.hx")) + F.abs(F.col("p.hy") - F.col("q.hy")) + F.col("q.d")
        pairs = pairs.withColumn("d", F.when(direct <= F.col("p.d"), direct).otherwise(via))
    value = F.when(F.col("origin") == F.col("dest"), 0.0).otherwise(1 / F.pow(F.greatest(F.col("d"), F.lit(1)).cast("double"), F.lit(exponent)))
    return pairs.select("origin", "dest", value.alias("gravity"))
