"""Structured Streaming over journals: arriving files, windowed statistics, and
reclamation policies as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.policy import EVENTS, Gate
from tidemark.sources import journal


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of the journals that arrive in a folder."""
    return journal.register(spark).readStream.format("framed").options(**options).load(path)


def windowed(df: DataFrame, time: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, sum, least, greatest and mean of a field in tumbling windows; batch or stream."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.window(time, width)).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), "n", "total", "least", "most", "mean")


def policy_events(df: DataFrame, make_policy, side: str = "writer", clock: str | None = None) -> DataFrame:
    """Reclaim events of each journal of a stream; the policy's counters are the
    state.  ``clock`` names a column of seconds (or a time) for cooldowns."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, rows = Gate(make_policy(), side), []
        held = list(vars(gate.policy))
        if state.exists:
            gate.capacity, gate.pending, *values = state.get
            for name, value in zip(held, values, strict=True):
                setattr(gate.policy, name, type(getattr(gate.policy, name))(value) if getattr(gate.policy, name) is not None else (None if value < 0 else value))
        frames = pd.concat(list(batches)).sort_values("frame_no")
        for number, n, now in zip(frames["frame_no"], frames["payload_len"], frames["now"], strict=True):
            event = gate.message(int(n), float(now))
            if event:
                rows.append((key[0], int(number), event[0], int(n), *event[1:]))
        state.update((gate.capacity, gate.pending, *[-1.0 if getattr(gate.policy, h) is None else float(getattr(gate.policy, h)) for h in held]))
        yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in EVENTS.split(", ")])

    fields = ", ".join(["capacity bigint", "pending boolean", *(f"{h} double" for h in vars(make_policy()))])
    now = F.col(clock).cast("double") if clock else F.lit(0.0)
    return df.select("path", "frame_no", "payload_len", now.alias("now")).groupBy("path").applyInPandasWithState(run, EVENTS, fields, "append", GroupStateTimeout.NoTimeout)
