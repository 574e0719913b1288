"""Ping, stop and flow views of the test tables, in Spark and in SQL. Coordinates are whole hundreds of metres, so both engines give equal sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stop_tables import summarize_stops
from ..stops.grid import grid_labels, grid_stops

THRESH, MIN_PINGS, MIN_MINUTES = 1440, 2, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ping_id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), k.alias("k"),
        F.pmod(k, F.lit(10)).cast("double").__mul__(100.0).alias("x"), (F.floor(k / 10) * 100).cast("double").alias("y"), F.col("event_type").alias("location_id"), F.col("value").alias("ha"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_stops(pings(spark, sf_dir), THRESH, MIN_PINGS, MIN_MINUTES, tiebreak=["ping_id"])


def placed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with the mean place of their pings."""
    labelled = grid_labels(pings(spark, sf_dir), THRESH, MIN_PINGS, MIN_MINUTES, tiebreak=["ping_id"])
    return summarize_stops(labelled, passthrough=["location_id"], passthrough_agg={"x": F.avg("x"), "y": F.avg("y")})


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by the nations of customer and supplier."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dest"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("origin", "dest").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
PINGS = f"""pings AS (SELECT event_id AS ping_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, {_K} AS k,
 CAST(({_K} % 10) * 100 AS DOUBLE) AS x, CAST(({_K} // 10) * 100 AS DOUBLE) AS y, event_type AS location_id, value AS ha FROM events)"""
RUNS = f"""{PINGS}, runs0 AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR location_id IS DISTINCT FROM lag(location_id) OVER w
 OR timestamp - lag(timestamp) OVER w > {THRESH * 60} THEN 1 ELSE 0 END AS nw FROM pings WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, ping_id)),
 runs AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY timestamp, ping_id) AS run, timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, ping_id) AS step FROM runs0)"""
STOPS = f"""{RUNS}, stops AS (SELECT user_id, run, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS n_pings, min(location_id) AS location_id,
 coalesce(max(CASE WHEN nw = 0 THEN step END) // 60, 0) AS max_gap, (max(timestamp) - min(timestamp)) // 60 AS duration, avg(x) AS x, avg(y) AS y
 FROM runs WHERE location_id IS NOT NULL GROUP BY user_id, run HAVING count(*) >= {MIN_PINGS} AND (max(timestamp) - min(timestamp)) // 60 >= {MIN_MINUTES})"""
FLOWS = """flows AS (SELECT c_nationkey AS origin, s_nationkey AS dest, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
CONTACTS = f"""{STOPS}, contacts AS (SELECT a.user_id AS user_id_1, b.user_id AS user_id_2, a.location_id, greatest(a.start_timestamp, b.start_timestamp) AS start_timestamp,
 least(a.end_timestamp, b.end_timestamp) AS end_timestamp, (least(a.end_timestamp, b.end_timestamp) - greatest(a.start_timestamp, b.start_timestamp)) // 60 AS duration
 FROM stops a JOIN stops b ON a.location_id = b.location_id AND a.user_id < b.user_id AND a.start_timestamp < b.end_timestamp AND b.start_timestamp < a.end_timestamp)"""
