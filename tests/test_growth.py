"""Steps whose work or memory must not outgrow the input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamframe.operators import contacts, stop_tables, visits
from roamframe.operators.intervals import overlap_counts
from roamframe.plans import queries
from roamframe.sim import agents, city
from roamframe.stops import kernels, runner

STOPS = "user_id string, location_id string, start_timestamp long, end_timestamp long, x double, y double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_stops(n=150, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-50_000, 50_000)
        out.append(("%03d" % rng.randrange(40), rng.choice("ab"), start, start + rng.randrange(1, 40_000), float(rng.randrange(-9, 9)) / 2, float(rng.randrange(-9, 9)) / 2))
    return out


def test_radius_contacts_in_half_the_squares(spark):
    rows = random_stops()
    got = sorted(tuple(r) for r in contacts.radius_contacts(spark.createDataFrame(rows, STOPS), 1.5).select("user_id_1", "user_id_2", "start_timestamp", "end_timestamp").collect())
    want = [(a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in rows for b in rows if a[0] < b[0] and a[2] < b[3] and b[2] < a[3] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 <= 2.25]
    assert got == sorted(want) and want


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """An explosion makes many rows of a table that seems small enough for the driver."""
    spark.createDataFrame(random_stops(), STOPS).write.parquet(f"{tmp_path}/stops")
    s = spark.read.parquet(f"{tmp_path}/stops")
    for df in (contacts.radius_contacts(s, 1.5), contacts.estimate_contacts(s)):
        assert "Broadcast" not in plan(df)
        df.count()
        assert "Broadcast" not in plan(df)


def test_diary_entries_of_one_time(spark):
    """As in the query's SQL, entries of one time are one, of the smallest of their places; their order is the tiebreak's."""
    rows = [(1, "u", 10, "c", 1), (3, "u", 20, "b", 3), (2, "u", 20, "d", 2), (4, "u", 30, "b", 4), (5, "u", 40, "a", 5)]
    for order in (rows, rows[::-1]):
        diary = spark.createDataFrame(order, "ping_id long, user_id string, timestamp long, location string, duration long")
        got = visits.condense_destinations(diary, tiebreak=["ping_id"]).select("timestamp", "location", "duration")
        assert sorted(map(tuple, got.collect())) == [(10, "c", 1), (20, "b", 9), (40, "a", 5)]


def plain_diary(town, rng, start, days, rho=0.4, gamma=0.3):
    """A step and a number at a time."""
    names = sorted(town.buildings)
    doors, kinds = np.array([town.buildings[n].door for n in names]), [town.buildings[n].kind for n in names]
    here = int(rng.choice([i for i, k in enumerate(kinds) if k == "home"]))
    visits_, out = {here: 1}, []
    for now in range(start, start + days * 86400, 900):
        is_open = [agents.OPEN[k][0] <= now // 3600 % 24 < agents.OPEN[k][1] for k in kinds]
        if not (is_open[here] and rng.random() < agents.STAY[kinds[here]]):
            known = [i for i in visits_ if is_open[i] and i != here]
            new = [i for i in range(len(names)) if is_open[i] and i not in visits_]
            if new and (not known or rng.random() < rho * len(visits_) ** -gamma):
                w = 1.0 / np.abs(doors[new] - doors[here]).sum(axis=1).clip(1) ** 2
                here = new[int(rng.choice(len(new), p=w / w.sum()))]
            elif known:
                w = np.array([visits_[i] for i in known], float)
                here = known[int(rng.choice(len(known), p=w / w.sum()))]
            visits_[here] = visits_.get(here, 0) + 1
        if out and out[-1][2] == names[here]:
            out[-1][1] += 15
        else:
            out.append([now, 15, names[here]])
    return [tuple(x) for x in out]


def test_diaries_of_many_agents_at_once(spark):
    town = city.random_city(12, 12, seed=1)
    ids = spark.range(40).select(F.col("id").alias("agent_id")).coalesce(1)
    df = agents.diaries(ids, town, 0, 2, 5)
    assert df.rdd.getNumPartitions() > 1
    got = sorted(map(tuple, df.collect()))
    want, ends = [], []
    for a in range(40):
        rng = agents._rng(a, 5)
        want += [(a, *x) for x in plain_diary(town, rng, 0, 2)]
        ends.append(rng.random())
    assert got == sorted(want)
    rngs = [agents._rng(a, 5) for a in range(40)]
    agents.diary_arrays(town, rngs, 0, 2)
    assert [r.random() for r in rngs] == ends


def test_steps_drawn_ahead_are_those_drawn_one_by_one(spark):
    one, two = np.random.default_rng(1), np.random.default_rng(1)
    steps = agents._Steps(one)
    n = agents.AHEAD + 7
    assert [steps.next() for _ in range(n)] == [tuple(two.normal(0, 0.1, 2).tolist()) for _ in range(n)]
    steps.done()
    assert one.random() == two.random()
    pings = agents.trajectories(spark.range(3).select(F.col("id").alias("agent_id")).coalesce(1), city.random_city(12, 12, seed=1))
    assert pings.rdd.getNumPartitions() > 1
    assert pings.count() == 3 * 1440


def test_overlaps_counted_without_pairs(spark):
    rows = random_stops(120, 3) + [("x", "a", 5, 5, 0.0, 0.0), ("x", None, 0, 9, 0.0, 0.0)]
    s = spark.createDataFrame(rows, STOPS)
    want = {}
    for a in rows:
        n = sum(a[2] < b[3] and b[2] < a[3] for b in rows if b[2] < b[3]) if a[2] < a[3] else 0
        want[a[1]] = want.get(a[1], 0) + n
    df = overlap_counts(s, s, ["location_id"], (contacts.START, contacts.START), (contacts.END, contacts.END))
    assert {r.location_id: r.n for r in df.collect()} == want
    assert "Join" not in plan(df)


@pytest.mark.parametrize("name", ["hdbscan_stops", "ta_dbscan_stops", "dbstop_stops", "seqscan_stops", "lachesis_stops", "density_cores"])
def test_stops_take_one_pass(name, spark, sf):
    p = plan(queries.QUERIES[name](spark, sf))
    assert p.count("MapInArrow") == 1 and "InPandas" not in p and "Join" not in p


def test_neighbours_and_shapes_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    t, p = np.sort(rng.integers(0, 9000, 90)), rng.integers(0, 9, (90, 2)).astype(float)
    near = [[j for j in range(90) if j != i and abs(t[i] - t[j]) <= 600 and np.hypot(*(p[i] - p[j])) <= 3] for i in range(90)]
    d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    for cells in (1, 500, 1 << 20):
        monkeypatch.setattr(kernels, "CELLS", cells)
        assert [x.tolist() for x in kernels.neighbours(t, p, False, 3, 10)] == near
        assert kernels.medoid_and_diameter(p, False) == (int(np.argmin(np.round(d.sum(axis=1), 9))), d.max())


def test_users_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(u, t, 0.0, 0.0) for u in ("a", "b", None, "c") for t in range({"b": 30}.get(u, 3))]
        df = runner.per_user(spark.createDataFrame(rows, "user_id string, timestamp long, x double, y double").repartition(3), lambda t, p, g: np.full(len(t), len(t)))
        assert sorted((r.user_id or "", r.timestamp, r.cluster) for r in df.collect()) == sorted((u or "", t, 30 if u == "b" else 3) for u, t, *_ in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_boxes_are_rastered_once(spark):
    boxes = [(i, 0.0, 0.0, 2.0, 1.0, "ab"[i % 2]) for i in range(20)]
    got = visits.raster_blocks(spark.createDataFrame(boxes, "location_id long, x0 double, y0 double, x1 double, y1 double, kind string"), ["b"])
    assert sorted(map(tuple, got.collect())) == [(0, 0, "b", 1), (1, 0, "b", 1)]
    p = plan(got)
    assert p.rindex("Generate") < p.rindex("HashAggregate")


def test_gaps_are_filled_in_one_pass(spark):
    s = spark.createDataFrame([("u", 10, 20, "a"), ("u", 30, 40, "b"), ("u", 35, 38, "c")], "user_id string, start_timestamp long, end_timestamp long, location_id string")
    df = stop_tables.fill_gaps(s, 0, 100)
    assert "Union" not in plan(df)
    assert sorted(map(tuple, df.select("start_timestamp", "end_timestamp", "location_id").collect())) == [(0, 10, "None"), (10, 20, "a"), (20, 30, "None"), (30, 40, "b"), (35, 38, "c"), (40, 100, "None")]
