"""Incremental forms for streams of pings: event time in column ts, late rows dropped by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def downsample_stream(pings: DataFrame, step_s: int, watermark: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """The first ping seen of each user and bin."""
    binned = pings.withColumn("bin", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / step_s))
    return binned.withWatermark(time, watermark).dropDuplicatesWithinWatermark([user, "bin"])


def coverage_stream(pings: DataFrame, bucket: str = "1 hour", period: str = "1 day", watermark: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """Per user and period the number of buckets with a ping, from two chained windows."""
    hits = pings.withWatermark(time, watermark).groupBy(F.window(time, bucket), user).agg(F.count("*").alias("n"))
    return hits.groupBy(F.window(F.window_time("window"), period), user).agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_pings"))


def session_stream(pings: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("user_id", "location_id")) -> DataFrame:
    """Runs of pings of a user in a cell with gaps under gap."""
    return pings.withWatermark(time, watermark).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n_pings"), F.min(time).alias("start"), F.max(time).alias("end"))


def grid_stop_stream(pings: DataFrame, time_thresh_min: float, min_cluster_size: int = 2, dur_min: float = 5, watermark: str = "1 hour", time: str = "ts", user: str = "user_id", location: str = "location_id") -> DataFrame:
    """Stops of users as their runs of equal cells end; a run open for time_thresh_min of event time ends by a timer.

    Rows of a batch are sorted by time before they meet the state; the watermark bounds how late one may be.
    """
    schema = f"{user} long, {location} string, start_timestamp long, end_timestamp long, n_pings long, duration long"
    state_schema = "cell string, first long, last long, n long"
    limit = int(time_thresh_min * 60)

    def finished(key, cell, first, last, n):
        import pandas as pd

        minutes = (last - first) // 60
        rows = [(key, cell, first, last, n, minutes)] if cell is not None and n >= min_cluster_size and minutes >= dur_min else []
        return pd.DataFrame(rows, columns=[user, location, "start_timestamp", "end_timestamp", "n_pings", "duration"])

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            out = finished(key[0], *state.get)
            state.remove()
            yield out
            return
        rows = pd.concat(list(frames))
        rows = rows.assign(s=rows[time].astype("datetime64[s]").astype("int64")).sort_values("s", kind="stable")
        run = state.get if state.exists else None
        for cell, s in zip(rows[location], rows["s"].tolist(), strict=True):
            cell = None if pd.isna(cell) else cell
            if run and cell == run[0] and s - run[2] <= limit:
                run = (cell, run[1], max(run[2], s), run[3] + 1)
            else:
                if run:
                    yield finished(key[0], *run)
                run = (cell, s, s, 1)
        state.update(run)
        state.setTimeoutTimestamp(max((run[2] + limit + 1) * 1000, state.getCurrentWatermarkMs() + 1))

    return pings.withWatermark(time, watermark).groupBy(user).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
