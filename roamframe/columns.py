"""Names of columns: canonical names, what a table calls them, and which representation is used."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Canonical column names, default actual names and types.
CANONICAL = {
    "user_id": "string", "latitude": "double", "longitude": "double", "x": "double", "y": "double",
    "datetime": "timestamp", "start_datetime": "timestamp", "end_datetime": "timestamp",
    "timestamp": "bigint", "start_timestamp": "bigint", "end_timestamp": "bigint", "tz_offset": "bigint",
    "duration": "bigint", "date": "date", "utc_date": "date", "ha": "double", "distance": "double",
    "geohash": "string", "h3_cell": "string", "location_id": "string", "diameter": "bigint", "n_pings": "bigint", "max_gap": "bigint", "label": "bigint",
}
SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86400, "w": 604800}
EARTH_RADIUS_M = 6_371_000.0


@dataclass(frozen=True)
class ColumnMap:
    """Canonical name to actual name, resolved against the columns of one table."""

    names: Mapping[str, str]
    present: frozenset
    mapped: frozenset

    @classmethod
    def resolve(cls, columns: Iterable[str], traj_cols: Mapping[str, str] | None = None, **given: str) -> ColumnMap:
        """Explicit names win and may not disagree; others fall back to the canonical name."""
        for k, v in given.items():
            if traj_cols and k in traj_cols and traj_cols[k] != v:
                raise ValueError(f"conflicting names for {k}: {traj_cols[k]!r} and {v!r}")
        own = {k: v for k, v in {**(traj_cols or {}), **given}.items() if k in CANONICAL}
        columns = set(columns)
        for k, v in own.items():
            if v not in columns:
                warnings.warn(f"column {v!r} given for {k} is not in the table", stacklevel=2)
        return cls({k: own.get(k, k) for k in CANONICAL}, frozenset(columns), frozenset(own))

    def __getitem__(self, name: str) -> str:
        return self.names[name]

    def has(self, *names: str) -> bool:
        return all(self.names[n] in self.present for n in names)

    def get(self, name: str) -> str | None:
        return self.names[name] if self.has(name) else None

    def spatial(self) -> tuple[str, str]:
        """The keys in use: a mapped pair, else x and y, else longitude and latitude."""
        projected = {"x", "y"} <= self.mapped and self.has("x", "y")
        geographic = {"longitude", "latitude"} <= self.mapped and self.has("longitude", "latitude")
        if projected and geographic:
            raise ValueError("too many spatial columns: map x and y or longitude and latitude")
        if projected or (not geographic and self.has("x", "y")):
            return "x", "y"
        if self.has("longitude", "latitude"):
            return "longitude", "latitude"
        raise ValueError("no spatial columns: x and y, or longitude and latitude")

    def time(self) -> str:
        """The key of the time column in use."""
        order = ["datetime", "start_datetime", "timestamp", "start_timestamp"]
        if {"timestamp", "start_timestamp"} & self.mapped and not {"datetime", "start_datetime"} & self.mapped:
            order = order[2:] + order[:2]
        for k in sorted(order, key=lambda k: k not in self.mapped):
            if self.has(k):
                return k
        raise ValueError("no time column")

    def require(self, *, user: bool = False, end: bool = False, spatial: bool = False) -> ColumnMap:
        self.time()
        if user and not self.has("user_id"):
            raise ValueError("no user column")
        if end and not (self.has("end_timestamp") or self.has("end_datetime") or self.has("duration")):
            raise ValueError("no end or duration column")
        if spatial and not (self.has("x", "y") or self.has("longitude", "latitude") or self.has("geohash")):
            raise ValueError("no spatial columns")
        return self


_KINDS = {"string": T.StringType, "double": T.DoubleType, "bigint": (T.LongType, T.IntegerType), "date": (T.DateType, T.StringType), "timestamp": (T.TimestampType, T.TimestampNTZType)}


def _typed(df: DataFrame, cols: ColumnMap) -> bool:
    return all(isinstance(df.schema[cols[k]].dataType, _KINDS[t]) for k, t in CANONICAL.items() if cols.has(k))


def is_traj_df(df: DataFrame, traj_cols: Mapping[str, str] | None = None, **given: str) -> bool:
    """Whether a table has a time, a place, and canonical types."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    try:
        cols.require(spatial=True)
    except ValueError:
        return False
    return _typed(df, cols)


def is_stop_df(df: DataFrame, traj_cols: Mapping[str, str] | None = None, **given: str) -> bool:
    """Whether a table has a start, an end or duration, and canonical types."""
    cols = ColumnMap.resolve(df.columns, traj_cols, **given)
    try:
        cols.require(end=True)
    except ValueError:
        return False
    return _typed(df, cols)
