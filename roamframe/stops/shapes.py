"""Medoid, diameter and hull of groups of points, in grouped functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spread import spread
from .kernels import diameter, medoid


def medoid_and_diameter(rows: DataFrame, by: Sequence[str], coords: tuple[str, str], geographic: bool, time: str) -> DataFrame:
    """Per group the point of least summed distance (the first in time) and the diameter, whole units, half to even.

    The last of by is the label: all labels of the other keys are met in one call.
    """
    keep = rows.select(*by, time, *coords)
    schema = T.StructType([*[keep.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in coords], T.StructField("diameter", T.LongType())])

    def of(pdf):
        pdf = pdf.sort_values([by[-1], time], kind="stable")
        label = pdf[by[-1]].to_numpy()
        p = pdf[list(coords)].to_numpy(float)
        starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        parts = [p[a:b] for a, b in zip(starts, [*starts[1:], len(p)], strict=True)]
        at = starts + np.array([medoid(q, geographic) for q in parts])
        out = pdf.iloc[at][list(by)].copy()
        out[coords[0]], out[coords[1]] = p[at, 0], p[at, 1]
        out["diameter"] = [int(np.rint(diameter(q, geographic)[0])) for q in parts]
        return out

    return spread(keep, *by[:-1]).groupBy(*by[:-1]).applyInPandas(of, schema)


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """The convex hull of points, counter-clockwise from the smallest; both chains are built by turns to the left."""
    p = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(p) < 3:
        return p

    def chain(q):
        out = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return chain(p) + chain(p[::-1])


#: Parts of a place whose hulls are taken apart from each other.
PARTS = 32


def location_hulls(points: DataFrame, location: str = "location_id", coords: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Per place the convex hull of its points.

    Hulls are taken of what each batch of rows has of a place, then of those by parts of a place, then of the parts, so that no task gathers all points of a place.
    """
    rows = points.where(F.col(location).isNotNull()).select(location, *coords)

    def corners(pdf):
        import pandas as pd

        parts = [(k, np.array(hull(x[list(coords)].to_numpy(float)), float).reshape(-1, 2)) for k, x in pdf.groupby(location, sort=False)]
        out = pd.DataFrame(np.concatenate([h for _, h in parts]) if parts else np.empty((0, 2)), columns=list(coords))
        out.insert(0, location, pd.Series([k for k, h in parts for _ in range(len(h))], dtype=pdf[location].dtype))
        return out

    kind = T.StructType([rows.schema[location], *[T.StructField(c, T.DoubleType()) for c in coords]])
    batches = rows.mapInPandas(lambda batches: (corners(b) for b in batches), kind)
    part = F.pmod(F.xxhash64(*coords), F.lit(PARTS))
    distinct = batches.withColumn("__part", part).groupBy(location, "__part").applyInPandas(corners, kind)

    def of(pdf):
        import pandas as pd

        ring = hull(pdf[list(coords)].to_numpy(float))
        return pd.DataFrame({location: [pdf[location].iloc[0]], "ring": [[{"x": a, "y": b} for a, b in ring]]})

    schema = T.StructType([distinct.schema[location], T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
    return distinct.groupBy(location).applyInPandas(of, schema)
