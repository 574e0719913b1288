import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamframe.columns import ColumnMap, is_stop_df, is_traj_df
from roamframe.functions import geo
from roamframe.functions import time as t
from roamframe.operators import completeness, contacts, home, metrics, od, stop_tables, validation, visits
from roamframe.sim import agents, city
from roamframe.sources import io
from roamframe.stops import kernels, runner, shapes
from roamframe.stops.hdbscan import st_hdbscan


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_column_rules(spark):
    m = ColumnMap.resolve(["uid", "x", "y", "longitude", "latitude", "timestamp"], {"user_id": "uid"})
    assert m["user_id"] == "uid" and m.spatial() == ("x", "y") and m.time() == "timestamp"
    with pytest.raises(ValueError):
        ColumnMap.resolve(["a"], {"x": "a"}, x="b")
    with pytest.raises(ValueError):
        ColumnMap.resolve(["x", "y", "longitude", "latitude"], {"x": "x", "y": "y", "longitude": "longitude", "latitude": "latitude"}).spatial()
    df = spark.createDataFrame([(1, 1.0, 2.0)], "timestamp long, x double, y double")
    assert is_traj_df(df) and not is_stop_df(df)


def test_offsets_and_strings(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00-04:00",), ("2024-01-01 10:00:00Z",), ("2024-01-01 10:00:00",), (None,)], "s string")
    got = [tuple(r) for r in df.select(t.offset_of(F.col("s")), t.unix_of(F.col("s"), "string")).collect()]
    assert got == [(-14400, 1704117600), (0, 1704103200), (None, 1704103200), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(-1800,), (19800,), (0,)], "o long").select(t.offset_string(F.col("o"))).collect()] == ["-00:30", "+05:30", "+00:00"]
    typed = io.cast_traj_cols(df.withColumnRenamed("s", "datetime"))
    assert dict(typed.dtypes)["datetime"] == "timestamp_ntz" and "tz_offset" in typed.columns


CONTACTS = "user_id string, start_timestamp long, end_timestamp long"


def test_contacts(spark):
    s = spark.createDataFrame([("a", 0, 600, "cafe"), ("b", 300, 900, "cafe"), ("c", 0, 600, "park")], f"{CONTACTS}, location_id string")
    assert rows(contacts.estimate_contacts(s), "user_id_1", "user_id_2", "duration") == [("a", "b", 5)]
    with pytest.raises(Exception, match="no location_id"):
        contacts.estimate_contacts(spark.createDataFrame([("a", 0, 600, None)], f"{CONTACTS}, location_id string")).collect()
    s = spark.createDataFrame([("a", 0, 600, 0.0, 0.0), ("b", 0, 600, 3.0, 4.0), ("c", 0, 600, 30.0, 0.0)], f"{CONTACTS}, x double, y double")
    got = contacts.contact_weights(contacts.radius_contacts(s, 10.0), "linear", 10.0)
    assert rows(got, "user_id_1", "user_id_2", "distance", "duration", "weight") == [("a", "b", 5.0, 10, 5.0)]
    s = spark.createDataFrame([("a", 0, 10800, 0.0, 0.0), ("b", 1800, 9000, 0.0, 0.0)], f"{CONTACTS}, x double, y double")
    assert rows(contacts.radius_contacts(s, 1.0), "duration") == [(120,)]


def test_geographic_contacts_meet_across_rows_and_antimeridian(spark):
    rng = np.random.default_rng(0)
    pts = [("%04d" % i, 0, 600, float((rng.uniform(179.99, 180.01) + 180) % 360 - 180), float(rng.uniform(70.0, 70.01))) for i in range(120)]
    s = spark.createDataFrame(pts, f"{CONTACTS}, longitude double, latitude double")
    got = rows(contacts.radius_contacts(s, 100.0, ("longitude", "latitude"), True), "user_id_1", "user_id_2")
    p = np.array([[x[3], x[4]] for x in pts])
    want = [(pts[i][0], pts[j][0]) for i in range(120) for j in range(i + 1, 120) if kernels.distances(p[i], p[j], True) <= 100]
    assert got == sorted(want) and want


def test_sip_and_gyration(spark):
    c = spark.createDataFrame([("a", "b", 2), ("b", "c", 3)], "user_id_1 string, user_id_2 string, duration long")
    assert rows(metrics.social_interaction_potential(c), "user_id", "sip") == [("a", 2), ("b", 5), ("c", 3)]
    s = spark.createDataFrame([("u", 1704063600, 1704070800, 120, 0.0, 0.0)], "user_id string, start_timestamp long, end_timestamp long, duration long, x double, y double")
    assert metrics.radius_of_gyration(s, "d", exploded=True).count() == 2


def test_self_containment(spark):
    schema = "user_id string, start_timestamp long, duration long, location_id string, x double, y double"
    s = spark.createDataFrame([("u", 0, 60, "home", 0.0, 0.0), ("u", 60, 30, "work", 10.0, 0.0), ("u", 90, 30, "shop", 20.0, 0.0), ("u", 120, 30, "food", 30.0, 0.0), ("v", 0, 5, "work", 0.0, 0.0), ("w", 0, 5, "home", 0.0, 0.0)], schema)
    got = dict(rows(metrics.self_containment(s, 15.0), "user_id", "self_containment"))
    assert got["u"] == pytest.approx(30 / 90) and got["v"] == 0.0 and got["w"] == 1.0


def test_merge_and_fill(spark):
    s = spark.createDataFrame([("u", 0, 1800, "a"), ("u", 2100, 3300, "a"), ("u", 9000, 9600, None)], "user_id string, start_timestamp long, end_timestamp long, location_id string")
    got = rows(stop_tables.merge_stops(s, 10), "start_timestamp", "end_timestamp", "duration")
    assert got == [(0, 3300, 55), (9000, 9600, 10)]
    s = spark.createDataFrame([("u", 600, 1200, "a"), ("u", 1800, 2400, "b")], "user_id string, start_timestamp long, end_timestamp long, location_id string")
    filled = rows(stop_tables.fill_gaps(s, 0, 3000), "start_timestamp", "duration", "location_id")
    assert filled == [(0, 10, "None"), (600, 10, "a"), (1200, 10, "None"), (1800, 10, "b"), (2400, 10, "None")]


def test_completeness_last_bucket(spark):
    p = spark.createDataFrame([("u", x) for x in (0, 3600, 7200, 10800)], "user_id string, timestamp long")
    assert rows(completeness.completeness(p, 1, "h"), "completeness") == [(1.0,)]


def test_home_across_midnight(spark):
    # Monday 20:00 to Wednesday 07:00: two nights, two working days.
    s = spark.createDataFrame([("u", 1704139200, 1704265200, "h")], "user_id string, start_timestamp long, end_timestamp long, location_id string")
    assert rows(home.candidate_homes(s), "num_nights", "num_weeks", "total_duration") == [(2, 1, 1260)]
    assert rows(home.workday_stops(s), "date", "duration")[0][1] == 480


def test_flow_noise_is_reproducible(spark):
    d = spark.createDataFrame([("a", "b", 5), ("a", "a", 5), ("b", "a", 10)], "origin string, dest string, weight long")
    one, two = (rows(od.flows(d.repartition(n), eps=1.0, seed=1), "origin", "dest", "pct") for n in (1, 3))
    assert one == two and sum(x[2] for x in one) == pytest.approx(100)


def test_polygons(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 5.0, 5.0), (4, 3.0, 3.0)], "ping_id long, x double, y double")
    wkt = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    assert [r.ping_id for r in p.where(geo.is_within(F.col("x"), F.col("y"), wkt)).collect()] == [1]
    layer = visits.poi_layer(spark, {"sq": "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"})
    assert dict(rows(visits.poi_map(p, layer, 1.5), "ping_id", "location_id")) == {1: "sq", 2: "sq", 3: None, 4: "sq"}


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine(F.lit(40.0), F.lit(0.0), F.lit(40.0), F.lit(0.01))).first()[0]
    assert d == pytest.approx(851.8, abs=0.1)


def test_roaming_and_lachesis():
    t_ = np.array([0, 60, 120, 180, 240, 300, 900])
    p = np.repeat(np.arange(7.0)[:, None], 2, axis=1)
    assert kernels.roaming(t_, p, False, 100, 5, 3).tolist() == [0] * 6 + [-1]
    assert kernels.lachesis(np.array([0, 300, 600]), np.zeros((3, 2)), False, 5, 100, 5).tolist() == [0, 0, 0]


def two_stops():
    t_ = np.concatenate([np.arange(20) * 30, 20 * 30 + 1800 + np.arange(20) * 30])
    rng = np.random.default_rng(1)
    return t_, np.concatenate([rng.normal(0, 5, (20, 2)), rng.normal(1000, 5, (20, 2))])


@pytest.mark.parametrize(
    "label",
    [
        lambda t_, p: kernels.lachesis(t_, p, False, 10, 60, 5),
        lambda t_, p: kernels.ta_dbscan(t_, p, False, 50, 3, 60)[0],
        lambda t_, p: kernels.dbstop(t_, p, False, 50, 3, 60)[0],
        lambda t_, p: kernels.seqscan(t_, p, False, 50, 3, 60, 5)[0],
        lambda t_, p: st_hdbscan(t_, p, False, 60, 3, 3, 5)[0],
    ],
)
def test_two_stops(label):
    found = label(*two_stops())
    assert len(set(found[:20]) - {-1}) == 1 and len(set(found[20:]) - {-1}) == 1 and found[5] != found[30]


def test_density_stops_do_not_overlap():
    rng = np.random.default_rng(4)
    for _ in range(20):
        t_ = np.sort(rng.choice(20000, 80, replace=False))
        p = rng.integers(0, 4, (80, 2)) * 40.0
        found = kernels.ta_dbscan(t_, p, False, 60, 2, 30)[0]
        spans = sorted((t_[found == c].min(), t_[found == c].max()) for c in set(found) - {-1})
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_labels_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    data = [(int(u), int(x), float(a), float(b)) for u in range(4) for x, a, b in zip(np.sort(rng.choice(9000, 60, replace=False)), rng.integers(0, 5, 60), rng.integers(0, 5, 60), strict=True)]
    df = spark.createDataFrame(data, "user_id long, timestamp long, x double, y double")
    one, two = (rows(runner.ta_dbscan_labels(df.repartition(n), 2.0, 2, 20), "user_id", "timestamp", "cluster") for n in (1, 5))
    assert one == two
    empty = runner.stops_of(runner.lachesis_labels(df.limit(0)))
    assert empty.count() == 0 and {"start_timestamp", "diameter", "n_pings"} <= set(empty.columns)


def test_location_clusters(spark):
    df = spark.createDataFrame([("u", 0, 0.0, 0.0), ("u", 1, 1.0, 1.0), ("u", 2, 20.0, 20.0)], "user_id string, timestamp long, x double, y double")
    assert rows(runner.detect_locations(df, 2.0), "timestamp", "location_id") == [(0, "0"), (1, "0"), (2, "1")]


def test_registry():
    r = validation.AlgorithmRegistry()
    r.add_algorithm(max, "m", a=(0, 1, 3), b=["x", "y"])
    assert len(r) == 6 and len({e["id"] for e in r}) == 6


def test_city_and_agents(spark):
    town = city.random_city(15, 15, seed=3)
    assert town.connected()
    way = town.path((0, 0), (10, 10))
    assert len(way) == 21 and all(city.adjacent(a, b) for a, b in zip(way, way[1:], strict=False))
    entries = agents.diary(town, np.random.default_rng(0), 0, 2)
    assert sum(e[1] for e in entries) == 2 * 24 * 60
    ids = spark.range(3).withColumnRenamed("id", "agent_id")
    one, two = (rows(agents.diaries(ids.repartition(n), town, days=1), "agent_id", "timestamp", "location") for n in (1, 3))
    assert one == two
    layers = city.to_frames(spark, town)
    g = city.gravity(layers["buildings"].limit(5), 2.0)
    assert g.where("origin = dest and gravity <> 0").count() == 0 and math.isfinite(g.agg(F.sum("gravity")).first()[0])


def test_components_settle_or_fail(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    # Two rows of blocks, joined at the far end alone, and one block apart.
    streets = spark.createDataFrame([(x, y) for x in range(12) for y in (0, 2)] + [(11, 1), (20, 20)], "coord_x int, coord_y int")
    found = rows(city.components(streets), "coord_x", "component")
    assert len(found) == 26 and len({c for x, c in found if x < 20}) == 1 and len({c for _, c in found}) == 2
    with pytest.raises(RuntimeError):
        city.components(streets, max_rounds=2)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", 1704067200, 1.0, 2.0, "2024-01-01"), ("v", 1704153600, 3.0, 4.0, "2024-01-02")], "user_id string, timestamp long, x double, y double, date string")
    io.to_file(df, str(tmp_path / "p"), partition_by=["date"])
    back = io.from_file(spark, str(tmp_path / "p"), filters=("timestamp", ">", 1704100000))
    assert rows(back, "user_id", "x") == [("v", 3.0)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThan(timestamp" in plan
    assert set(io.table_columns(spark, str(tmp_path / "p"))) == set(df.columns)


def test_clip_ring(spark):
    ring = "array<struct<x:double,y:double>>"
    shapes_ = {
        "inside": [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], "across": [(-2, 1), (2, 1), (2, 3), (-2, 3), (-2, 1)], "outside": [(11, 11), (12, 11), (12, 12), (11, 11)],
        "around": [(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)], "corner": [(-4, 2), (4, 10), (-4, 18), (-4, 2)],
    }
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in shapes_.items()], f"id string, ring {ring}")
    got = {r.id: r.ring for r in df.select("id", geo.clip_ring(F.col("ring"), (0, 0, 10, 10)).alias("ring")).collect()}

    def area(points):
        return abs(sum(a.x * b.y - b.x * a.y for a, b in zip(points, points[1:], strict=False))) / 2

    assert got["outside"] is None and all(r[0] == r[-1] for r in got.values() if r)
    assert {k: area(r) for k, r in got.items() if r} == pytest.approx({"inside": 4, "across": 4, "around": 100, "corner": 8})


def test_tags(spark):
    from roamframe.operators import tags

    subtypes = {"building": {"house": "residential", "yes": "never"}, "amenity": {"cafe": "food", "school": "education", "bar": "food", "parking": "parking"}, "leisure": {"park": "park"}, "tourism": {"hotel": "lodging"}, "shop": {"bakery": "food"}}
    categories = {"residential": "home", "food": "retail", "education": "school", "park": "open", "parking": "transport"}
    cols = ["building", "amenity", "leisure", "tourism", "shop", "height", "landuse"]
    cases = [
        ((" House ", "cafe", None, None, None, None, None), ("house", "residential", "home", "food", None)),
        (("parking", "cafe", None, None, None, None, None), ("parking", "parking", "transport", "food", None)),
        (("yes", "parking; Cafe|school,bar", None, None, None, None, None), ("cafe", "food", "retail", "education", None)),
        (("yes", "parking", "park", None, None, None, None), ("parking", "parking", "transport", None, None)),
        ((None, "unheard", "pitch", "hotel", None, None, None), ("pitch", "unknown", "other", None, None)),
        ((None, None, None, "zoo", "bakery", None, None), ("bakery", "food", "retail", None, None)),
        ((None, None, None, "hotel", "bakery", None, None), ("hotel", "lodging", "other", None, None)),
        ((None,) * 7, ("unknown", "unknown", "other", None, None)),
        (("yes", None, None, None, None, "9.5", None), ("unknown", "unknown", "other", None, None)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "id int, " + ", ".join(f"{c} string" for c in cols))
    got = tags.classify(df, subtypes, categories).orderBy("id").select("osm_type", "subtype", "category", "subtype_2", "subtype_3").collect()
    assert [tuple(r) for r in got] == [want for _, want in cases]
    homes = spark.createDataFrame([("yes", "9.5", "x"), ("yes", "30", "x"), ("yes", "tall", "x"), ("yes", "5", None)], "building string, height string, `addr:unit` string")
    assert [r.subtype for r in tags.classify(homes, subtypes, categories, infer_homes=True).collect()] == ["residential", "unknown", "unknown", "unknown"]
    assert rows(tags.summary(tags.classify(df, subtypes, categories)), "category", "n")[0] == ("home", 1)


def test_geojson_keeps_every_feature(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    features = [("Polygon", [square(0, 9), square(2, 3)]), ("MultiPolygon", [[square(0, 1)], [square(5, 8), square(6, 7)]]), ("Point", [1, 2]), ("LineString", [[0, 0], [1, 1]])]
    text = json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": k}, "geometry": {"type": k, "coordinates": c}} for k, c in features]})
    (tmp_path / "x.geojson").write_text(text)
    got = io.read_geojson(spark, str(tmp_path / "x.geojson")).collect()
    found = sorted((r.geometry_type, r.part, r.ring and len(r.ring), r.holes and len(r.holes)) for r in got if r.ring)
    assert found == [("MultiPolygon", 0, 5, []), ("MultiPolygon", 1, 5, 1), ("Polygon", 0, 5, 1)]
    assert sorted(r.geometry_type for r in got if not r.ring) == ["LineString", "Point"]


def test_hulls_of_hulls(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 60, (3000, 2)).astype(float)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(p)] + [("c", 1.0, 1.0), ("c", 1.0, 1.0), (None, 0.0, 0.0)], "location_id string, x double, y double").repartition(7)
    got = {r.location_id: [(q.x, q.y) for q in r.ring] for r in shapes.location_hulls(df).collect()}
    assert got == {"a": shapes.hull(p[np.arange(3000) % 3 > 0]), "b": shapes.hull(p[np.arange(3000) % 3 == 0]), "c": [(1.0, 1.0)]}


def test_places_and_streets(spark):
    points = spark.createDataFrame([("u", k, x, 0.0) for k, x in enumerate((0.0, 3.0, 100.0))], "user_id string, timestamp long, x double, y double")
    found = runner.location_summary(runner.detect_locations(points, 5.0))
    assert rows(found, "location_id", "n", "center_x", "extent") == [("0", 2, 1.5, 1.5), ("1", 1, 100.0, 0.0)]
    streets = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (9, 9), (9, 8)], "coord_x int, coord_y int")
    assert rows(city.largest_component(streets), "coord_x", "coord_y") == [(0, 0), (1, 0), (2, 0)]


def test_degrees_and_many_polygons(spark):
    """Places a few hundredths of a degree wide get cells of their own size."""
    boxes = {f"p{i}": f"POLYGON(({i / 100} 50, {i / 100 + 0.008} 50, {i / 100 + 0.008} 50.01, {i / 100} 50.01, {i / 100} 50))" for i in range(200)}
    points = spark.createDataFrame([(i, i / 100 + 0.004, 50.005) for i in range(200)] + [(999, 7.0, 7.0), (1000, None, 1.0)], "ping_id long, x double, y double")
    for most in (visits.MAX_CELLS, 0):
        visits.MAX_CELLS, kept = most, visits.MAX_CELLS
        got = dict(rows(visits.poi_map(points, visits.poi_layer(spark, boxes)), "ping_id", "location_id"))
        visits.MAX_CELLS = kept
        assert got == {i: f"p{i}" for i in range(200)} | {999: None, 1000: None}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("user_id"), "id")
    one, two = (rows(io.sample_from(df.repartition(n), frac_users=0.5, frac_records=0.3, seed=2), "user_id", "id") for n in (1, 6))
    assert one == two and 300 < len(one) < 600
    assert len(rows(io.sample_users(df, 7), "user_id")) == 7
