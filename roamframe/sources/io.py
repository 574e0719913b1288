"""Read, cast, sample and write ping and stop tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import CANONICAL, ColumnMap
from ..functions import geo
from ..functions import time as t
from ..functions.chance import share
from ..operators.filters import compile_filters


def read(spark: SparkSession, path: str | Sequence[str], format: str = "parquet", sep: str = ",") -> DataFrame:
    """A file, directory (with Hive partitions) or list of them; columns that some paths lack are null there."""
    paths = [path] if isinstance(path, str) else list(path)
    if format == "csv":
        frames = [spark.read.csv(p, header=True, inferSchema=True, sep=sep) for p in paths]
    else:
        frames = [spark.read.format(format).load(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_columns(spark: SparkSession, path, format: str = "parquet", include_schema: bool = False, sep: str = ","):
    """Column names of a stored table, or its schema. Only metadata is read."""
    df = read(spark, path, format, sep)
    return df.schema if include_schema else df.columns


def cast_traj_cols(df: DataFrame, traj_cols: Mapping[str, str] | None = None, parse_dates: bool = True, mixed_timezone_behavior: str = "naive", **given: str) -> DataFrame:
    """Cast canonical columns. Time strings: naive keeps local time and adds tz_offset, utc converts."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    kinds = dict(df.dtypes)
    out: dict[str, Column] = {}
    for k, want in CANONICAL.items():
        name = cols[k]
        if name not in kinds:
            continue
        c, have = F.col(name), kinds[name]
        if want == "timestamp":
            if have == "string" and parse_dates:
                if mixed_timezone_behavior == "utc":
                    out[name] = F.timestamp_seconds(t.unix_of(c, "string"))
                elif mixed_timezone_behavior == "naive":
                    out[name] = t.naive_of(c)
                    if not cols.has("tz_offset") and k in ("datetime", "start_datetime"):
                        out.setdefault(cols["tz_offset"], t.offset_of(c))
                else:
                    raise ValueError("a column of mixed zones has no Spark type: use naive or utc")
        elif want == "bigint" and have in ("string", "double", "float", "int", "decimal"):
            out[name] = c.try_cast("double").cast("bigint") if have == "string" else c.cast("bigint")
        elif want == "date" and have == "string":
            out[name] = F.to_date(c) if parse_dates else c
        elif want in ("double", "string") and have != want:
            out[name] = c.try_cast(want) if have == "string" else c.cast(want)
    return df.withColumns(out) if out else df


def warn_on_units(df: DataFrame, column: str) -> None:
    """Warn if the first value has the digits of milli- or nanoseconds. Reads one row."""
    row = df.select(column).where(F.col(column).isNotNull()).first()
    digits = len(str(abs(int(row[0])))) if row else 0
    if digits in (13, 19):
        warnings.warn(f"{column} looks like {'milli' if digits == 13 else 'nano'}seconds; seconds are expected", stacklevel=2)


def from_df(df: DataFrame, traj_cols: Mapping[str, str] | None = None, filters=None, sort_times: bool = False, parse_dates: bool = True, mixed_timezone_behavior: str = "naive", **given: str) -> DataFrame:
    """Validate, filter on stored values, cast, and, if asked, sort by user and time within partitions of users."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given).require(spatial=True)
    if filters is not None:
        df = df.where(compile_filters(filters, cols))
    df = cast_traj_cols(df, traj_cols, parse_dates, mixed_timezone_behavior, **given)
    return sort_trajectory(df, traj_cols, **given) if sort_times else df


def from_file(spark: SparkSession, path, format: str = "parquet", sep: str = ",", **options) -> DataFrame:
    """read, then from_df. Filters reach the scan."""
    return from_df(read(spark, path, format, sep), **options)


def sort_trajectory(df: DataFrame, traj_cols: Mapping[str, str] | None = None, total: bool = False, **given: str) -> DataFrame:
    """By user and time: within partitions of users, or in total."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    time = next(cols[k] for k in ("timestamp", "start_timestamp", "datetime", "start_datetime") if cols.has(k))
    user = cols.get("user_id")
    keys = [user, time] if user else [time]
    if total:
        return df.orderBy(*keys)
    return (df.repartition(user) if user else df).sortWithinPartitions(*keys)


def sample_users(df: DataFrame, size: float, user_id: str = "user_id", seed: int = 0, within=None, coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Distinct users: a share below 1 by a hash threshold, which needs no shuffle before the distinct; a number by hash order."""
    if within is not None:
        df = df.where(geo.is_within(F.col(coords[0]), F.col(coords[1]), within))
    users = df.select(user_id).where(F.col(user_id).isNotNull())
    if 0 < size < 1:
        return users.where(share(seed, user_id) < size).distinct()
    return users.distinct().orderBy(share(seed, user_id), user_id).limit(int(size))


def sample_from(df: DataFrame, users: DataFrame | Iterable | None = None, frac_users: float | None = None, frac_records: float | None = None, seed: int = 0, user_id: str = "user_id", within=None, coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Rows of given or sampled users, in a polygon, then a share of the records: by a hash of all columns, so equal rows stay or go together."""
    if users is not None:
        known = users if isinstance(users, DataFrame) else df.sparkSession.createDataFrame([(u,) for u in users], [user_id])
        df = df.join(known.select(user_id).distinct(), user_id, "left_semi")
    if within is not None:
        df = df.where(geo.is_within(F.col(coords[0]), F.col(coords[1]), within))
    if frac_users is not None:
        df = df.where(share(seed, user_id) < frac_users)
    if frac_records is not None:
        df = df.where(share(seed, *(F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in df.columns)) < frac_records)
    return df


def to_file(df: DataFrame, path: str, format: str = "parquet", output_cols: Mapping[str, str] | None = None, partition_by: Sequence[str] = (), use_offset: bool = False, mode: str = "overwrite", tz_offset: str = "tz_offset") -> None:
    """Rename, write times as text (with their offset if asked), partition Hive-style."""
    kinds = dict(df.dtypes)
    for name, kind in kinds.items():
        if kind.startswith("timestamp"):
            text = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
            df = df.withColumn(name, F.concat(text, t.offset_string(F.col(tz_offset))) if use_offset and tz_offset in kinds else text)
    df = df.withColumnsRenamed(dict(output_cols or {}))
    writer = df.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.format(format).save(path)


def table_head(spark: SparkSession, name: str, n: int = 10) -> DataFrame:
    return spark.table(name).limit(n)


def table_column_unique(spark: SparkSession, name: str, column: str) -> DataFrame:
    return spark.table(name).select(column).distinct().dropna()


def table_column_filtered(spark: SparkSession, name: str, column: str, value) -> DataFrame:
    return spark.table(name).where(F.col(column) == F.lit(value))


def save_layers(layers: Mapping[str, DataFrame], path: str) -> None:
    """A city or geodata set: a Parquet directory per layer."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_layers(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, a row per polygon: properties as a map, part (number within its feature), ring and holes as array<struct<x,y>>.

    A feature of another geometry, or of none, keeps one row without ring; geometry_type names its kind.
    """
    raw = spark.read.text(path, wholetext=True)
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    feature = raw.select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    one, many = F.from_json("c", "array<array<array<double>>>"), F.from_json("c", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("geometry_type") == "Polygon", F.array(one)).when(F.col("geometry_type") == "MultiPolygon", many)
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = feature.select("properties", "geometry_type", F.posexplode_outer(polygons).alias("part", "rings"))
    return rows.select("properties", "geometry_type", "part", points(F.col("rings")[0]).alias("ring"), F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), points).alias("holes"))
