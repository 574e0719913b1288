"""Run a kernel per user with one shuffle; labels or stops come out as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ColumnMap
from ..functions.spread import spread
from ..operators.stop_tables import SHAPES, merge_stops, summarize_stops
from . import hdbscan, kernels


#: Columns that per_user adds with shapes: seconds since the stop's ping before, whether a ping is the stop's medoid, and the diameter beside the medoid.
GAP, MEDOID, DIAMETER = SHAPES


def per_user(pings: DataFrame, label: Callable, extra: Sequence[tuple[str, T.DataType]] = (), traj_cols: Mapping[str, str] | None = None, tiebreak: Sequence[str] = (), shapes: bool = False, **given: str) -> DataFrame:
    """pings with cluster and extra columns. label(t, p, geographic) gives the labels, or a tuple of labels and the extra columns, masked where they are null.

    A user's pings are sorted by time, then tiebreak columns, so that the result does not depend on partitions. Users come one after another in Arrow batches,
    of which only the user, time and coordinates are turned into arrays. With shapes the pass also gives what stops_of needs of each stop.
    """
    cols = ColumnMap.resolve(pings.columns, traj_cols, **given).require(user=True, spatial=True)
    a, b = cols.spatial()
    user, time = cols["user_id"], cols[cols.time()]
    stamps = dict(pings.dtypes)[time].startswith("timestamp")
    added = [("cluster", T.LongType()), *extra, *(((GAP, T.LongType()), (MEDOID, T.BooleanType()), (DIAMETER, T.LongType())) if shapes else ())]
    schema = T.StructType([*pings.schema.fields, *[T.StructField(n, t) for n, t in added]])
    names, geographic = [cols[a], cols[b]], a == "longitude"

    def of(batches):
        import pyarrow as pa

        for table in _whole_users(batches, user):
            stamp = table.column(time)
            t = stamp.to_numpy().astype("datetime64[s]").astype(np.int64) if stamps else stamp.to_numpy().astype(np.int64)
            p = np.column_stack([table.column(c).to_numpy().astype(float) for c in names])
            starts = _starts(table.column(user))
            parts = []
            for i, j in zip(starts, [*starts[1:], len(t)], strict=True):
                found = label(t[i:j], p[i:j], geographic)
                found = found if isinstance(found, tuple) else (found,)
                parts.append((*found, *_shapes(t[i:j], p[i:j], geographic, found[0])) if shapes else found)
            for (name, kind), pieces in zip(added, zip(*parts, strict=True), strict=True):
                column = np.ma.concatenate(pieces) if any(isinstance(x, np.ma.MaskedArray) for x in pieces) else np.concatenate(pieces)
                mask = np.ma.getmaskarray(column) if isinstance(column, np.ma.MaskedArray) else None
                table = table.append_column(name, pa.array(np.ma.getdata(column), pa.bool_() if kind == T.BooleanType() else pa.int64(), mask=mask))
            yield from table.to_batches()

    last = lambda c: F.col(c).asc_nulls_last()
    return spread(pings, user).sortWithinPartitions(F.col(user), last(time), *map(last, tiebreak)).mapInArrow(of, schema)


def _starts(users) -> list[int]:
    """Rows at which another user begins."""
    code = users.combine_chunks().dictionary_encode(null_encoding="encode")
    code = (code.combine_chunks() if hasattr(code, "chunks") else code).indices.to_numpy()
    return [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]


def _whole_users(batches, user: str):
    """Tables of all rows of users, from batches in which they lie one after another."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pa.chunked_array([batch.column(batch.schema.get_field_index(user))])
        cut = _starts(keys)[-1]
        if cut or (held and held[-1].column(held[-1].schema.get_field_index(user))[-1] != keys[0]):
            ready = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(ready).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shapes(t, p, geographic, labels):
    gap, medoid, diameter = np.ma.masked_all(len(t), np.int64), np.zeros(len(t), bool), np.ma.masked_all(len(t), np.int64)
    order = np.argsort(labels, kind="stable")
    order = order[labels[order] >= 0]
    if len(order):
        for rows in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            gap[rows[1:]] = np.diff(t[rows])
            at, far = kernels.medoid_and_diameter(p[rows], geographic)
            medoid[rows[at]], diameter[rows[at]] = True, int(np.rint(far))
    return gap, medoid, diameter


def stops_of(labelled: DataFrame, dur_min: int = 0, shapes: bool = True, traj_cols: Mapping[str, str] | None = None, passthrough: Sequence[str] = (), **given: str) -> DataFrame:
    """The stop table of labelled pings with Unix seconds."""
    cols = ColumnMap.resolve(labelled.columns, traj_cols, **given)
    a, b = cols.spatial()
    return summarize_stops(labelled, (cols["user_id"],), cols[cols.time()], "cluster", dur_min, (cols[a], cols[b]) if shapes else None, a == "longitude", passthrough)


def roaming_labels(pings: DataFrame, delta_roam: float = 100, dt_max: float = 15, dur_min: float = 5, method: str = "sliding", **names) -> DataFrame:
    return per_user(pings, lambda t, p, g: kernels.roaming(t, p, g, delta_roam, dt_max, dur_min, method), **names)


def lachesis_labels(pings: DataFrame, dt_max: float = 60, delta_roam: float = 100, dur_min: float = 5, return_anchors: bool = False, postprocessing: str | None = None, eps: float | None = None, **names) -> DataFrame:
    """postprocessing 'dbscan' clusters the stops' medoids within eps and merges consecutive ones of a place that are at most dt_max apart."""
    if postprocessing not in (None, "dbscan"):
        raise NotImplementedError(postprocessing)

    def label(t, p, g):
        labels = kernels.lachesis(t, p, g, dt_max, delta_roam, dur_min)
        if postprocessing and labels.max(initial=-1) > 0:
            labels = _merge_places(t, p, g, labels, dt_max, eps if eps is not None else delta_roam)
        return (labels, kernels.anchors(t, p, labels, g)) if return_anchors else labels

    return per_user(pings, label, [("anchor_time", T.LongType())] if return_anchors else (), **names)


def _merge_places(t, p, geographic, labels, dt_max, eps):
    n = labels.max() + 1
    rows = [np.flatnonzero(labels == c) for c in range(n)]
    centres = np.array([p[r[kernels.medoid(p[r], geographic)]] for r in rows])
    place = dbscan(centres, geographic, eps, 2)
    place = np.where(place < 0, n + np.arange(n), place)
    number = np.zeros(n, np.int64)
    for c in range(1, n):
        joins = place[c] == place[c - 1] and t[rows[c][0]] - t[rows[c - 1][-1]] <= dt_max * 60
        number[c] = number[c - 1] + (not joins)
    return np.where(labels < 0, -1, number[np.maximum(labels, 0)])


#: With cores: the stop that a ping is a core of (-1: none), and when it became a member, in Unix seconds.
_CORES = [("core", T.LongType()), ("promotion_time", T.LongType())]


def _with_promotion(t, p, g, dist_thresh, time_thresh, found, near):
    since = kernels.promotion(t, p, g, dist_thresh, time_thresh, *found, near=near)
    return (*found, np.ma.masked_less(since, 0))


def ta_dbscan_labels(pings: DataFrame, dist_thresh: float, min_pts: int, time_thresh: float, return_cores: bool = False, remove_overlaps: bool = True, **names) -> DataFrame:
    def label(t, p, g):
        near = kernels.neighbours(t, p, g, dist_thresh, time_thresh)
        found = kernels.ta_dbscan(t, p, g, dist_thresh, min_pts, time_thresh, remove_overlaps, near=near)
        return _with_promotion(t, p, g, dist_thresh, time_thresh, found, near) if return_cores else found[0]

    return per_user(pings, label, _CORES if return_cores else (), **names)


def dbstop_labels(pings: DataFrame, dist_thresh: float, min_pts: int, time_thresh: float, return_cores: bool = False, **names) -> DataFrame:
    def label(t, p, g):
        near = kernels.neighbours(t, p, g, dist_thresh, time_thresh)
        found = kernels.dbstop(t, p, g, dist_thresh, min_pts, time_thresh, near=near)
        return _with_promotion(t, p, g, dist_thresh, time_thresh, found, near) if return_cores else found[0]

    return per_user(pings, label, _CORES if return_cores else (), **names)


def seqscan_labels(pings: DataFrame, dist_thresh: float, min_pts: int = 3, time_thresh: float = 90, dur_min: float = 5, back_merge: bool = False, return_cores: bool = False, **names) -> DataFrame:
    def label(t, p, g):
        near = kernels.neighbours(t, p, g, dist_thresh, time_thresh)
        found = kernels.seqscan(t, p, g, dist_thresh, min_pts, time_thresh, dur_min, back_merge, near=near)
        return _with_promotion(t, p, g, dist_thresh, time_thresh, found, near) if return_cores else found[0]

    return per_user(pings, label, _CORES if return_cores else (), **names)


def hdbscan_labels(pings: DataFrame, time_thresh: float, min_pts: int = 2, min_cluster_size: int = 1, dur_min: float = 5, delta_roam: float | None = None, dist_thresh: float | None = None, return_cores: bool = False, **names) -> DataFrame:
    def label(t, p, g):
        found = hdbscan.st_hdbscan(t, p, g, time_thresh, min_pts, min_cluster_size, dur_min, delta_roam, dist_thresh)
        return found if return_cores else found[0]

    return per_user(pings, label, _CORES[:1] if return_cores else (), **names)


def dbscan(p: np.ndarray, geographic: bool, epsilon: float, min_pts: int) -> np.ndarray:
    """Density clusters of points; a point counts among its own neighbours. A point is compared with those in nearby rows of a grid."""
    n = len(p)
    key = np.floor((p[:, 1] * (np.pi / 180 * kernels.R) if geographic else p[:, 1]) / max(epsilon, 1e-9)).astype(np.int64)
    rows: dict[int, list[int]] = {}
    for i, k in enumerate(key.tolist()):
        rows.setdefault(k, []).append(i)

    def near(i):
        c = np.array([j for k in (key[i] - 1, key[i], key[i] + 1) for j in rows.get(int(k), ())])
        return c[kernels.distances(p[c], p[i], geographic) <= epsilon]

    labels, c = np.full(n, -1, np.int64), 0
    around = [near(i) for i in range(n)]
    for seed in range(n):
        if labels[seed] >= 0 or len(around[seed]) < min_pts:
            continue
        labels[seed] = c
        todo = [seed]
        while todo:
            for j in around[todo.pop()]:
                if labels[j] < 0:
                    labels[j] = c
                    if len(around[j]) >= min_pts:
                        todo.append(j)
        c += 1
    return labels


def detect_locations(points: DataFrame, epsilon: float = 100, min_pts: int = 1, method: str = "dbscan", algorithm: Callable | None = None, traj_cols: Mapping[str, str] | None = None, **given: str) -> DataFrame:
    """points with location_id: density clusters per user, numbered by first appearance; noise points are places of their own.

    method 'custom' takes algorithm(p, geographic) -> one label per row.
    """
    if method not in ("dbscan", "custom"):
        raise NotImplementedError(method)

    def label(t, p, g):
        found = np.asarray(algorithm(p, g)) if method == "custom" else dbscan(p, g, epsilon, min_pts)
        if len(found) != len(p):
            raise ValueError("an algorithm gives one label per row")
        own = np.where(found < 0, found.max(initial=-1) + 1 + np.arange(len(p)), found)
        _, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        return np.argsort(np.argsort(first))[inverse]

    out = per_user(points.drop("location_id"), label, traj_cols=traj_cols, **given)
    return out.withColumn("location_id", out["cluster"].cast("string")).drop("cluster").select(*[c for c in points.columns if c != "location_id"], "location_id")


def location_summary(located: DataFrame, by: Sequence[str] = ("user_id", "location_id"), coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Of each place that detect_locations found: number of rows, centre, and extent, the largest distance of a row from the centre."""
    x, y = coords
    centre = located.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("center_x"), F.avg(y).alias("center_y"))
    away = F.hypot(F.col(x) - F.col("center_x"), F.col(y) - F.col("center_y"))
    return located.join(centre, list(by)).groupBy(*by, "n", "center_x", "center_y").agg(F.max(away).alias("extent"))


def merge(stops_or_pings: DataFrame, max_gap_min: float, method: str = "stops", algorithm: Callable | None = None, **kwargs) -> DataFrame:
    """Merge stops, or run a custom function over the table."""
    if method == "custom":
        return algorithm(stops_or_pings, **kwargs)
    return merge_stops(stops_or_pings, max_gap_min, **kwargs)
