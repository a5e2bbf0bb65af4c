"""Timelines over streams of labelled segments. These go beyond batch timelines: late rows within the watermark count."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_runs(events: DataFrame, gap: str = "120 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of rows (user_id, ts) of which each starts within the gap after the one before: start, end of the session and its rows."""
    runs = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("w.start").alias("run_start"), F.col("w.end").alias("run_end"), "n")


OUT = "user_id long, label int, start_s double, end_s double, n_segments long"
STATE = "label int, start double, end double, n long"


def stream_intervals(events: DataFrame, max_gap_s: float = 120.0, seconds: float = 4.0, late: str = "1 hour") -> DataFrame:
    """Intervals of rows (user_id, ts, y): an interval is given out when a row of another label, or one beyond the gap, follows it, or
    when the watermark has passed its end by the gap. Times are seconds since the epoch; rows of one batch are put in order,
    rows before the open interval's end (late ones) only widen it if they have its label."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, cur = [], list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], int(cur[0]), cur[1], cur[2], int(cur[3]))], columns=["user_id", "label", "start_s", "end_s", "n_segments"])
            return
        rows = pd.concat(list(frames)).sort_values("t")
        for t, y in zip(rows.t, rows.y, strict=True):
            if cur is not None and y == cur[0] and t - cur[2] <= max_gap_s:
                cur = [cur[0], min(cur[1], t), max(cur[2], t + seconds), cur[3] + 1]
            elif cur is None or t >= cur[1]:
                if cur is not None:
                    out.append((key[0], int(cur[0]), cur[1], cur[2], int(cur[3])))
                cur = [int(y), float(t), float(t + seconds), 1]
        state.update((int(cur[0]), float(cur[1]), float(cur[2]), int(cur[3])))
        state.setTimeoutTimestamp(max(int((cur[2] + max_gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "label", "start_s", "end_s", "n_segments"])

    rows = events.withWatermark("ts", late).select("user_id", "ts", F.col("ts").cast("double").alias("t"), "y")
    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
