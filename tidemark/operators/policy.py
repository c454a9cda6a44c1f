"""Reclamation policies as folds over a journal's message sizes, in order.

A policy sees (size, capacity, now) and says whether a buffer would be given
back.  Capacity is modelled as the largest size since the last reclaim, and at
least the baseline.  A writer shrinks at once, a reader at its next message.
Rows are streamed in order, so a journal of any length takes constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINE = 16 << 10
COUNT, COOLDOWN, THRESHOLD = "MessageCount", "TimeCooldown", "SizeThreshold"
EVENTS = "path string, frame_no bigint, reason string, last_message_size bigint, capacity_before bigint, capacity_after bigint"


@dataclass
class NoOp:
    baseline: int = BASELINE

    def decide(self, size: int, capacity: int, now: float) -> str | None:
        return None


@dataclass
class Adaptive:
    """Over-provisioned (capacity >= size * ratio) for ``wait`` messages in a row, or for ``cooldown`` since the run's first."""

    ratio: int = 4
    wait: int = 5
    cooldown: float | None = None
    baseline: int = BASELINE
    run: int = field(default=0, init=False)
    since: float | None = field(default=None, init=False)

    def decide(self, size: int, capacity: int, now: float) -> str | None:
        over = size > 0 and capacity >= size * self.ratio
        if not over:
            self.run, self.since = 0, None
            return None
        self.run += 1
        if self.since is None:
            self.since = now
        late = self.cooldown is not None and now - self.since >= self.cooldown
        if not late and self.run < self.wait:
            return None
        self.run, self.since = 0, None
        return COOLDOWN if late else COUNT


@dataclass
class SizeThreshold:
    """A message above ``grow`` arms it; then ``wait`` in a row below ``shrink`` fire."""

    grow: int = 1 << 20
    shrink: int = 1 << 10
    wait: int = 8
    baseline: int = BASELINE
    armed: bool = field(default=False, init=False)
    run: int = field(default=0, init=False)

    def decide(self, size: int, capacity: int, now: float) -> str | None:
        if size > self.grow:
            self.armed, self.run = True, 0
        elif self.armed:
            self.run = self.run + 1 if size < self.shrink else 0
            if self.run >= self.wait:
                self.armed, self.run = False, 0
                return THRESHOLD
        return None


class Gate:
    """Consults the policy only above its baseline; keeps the buffer's capacity."""

    def __init__(self, policy, side: str = "writer"):
        if side not in ("writer", "reader"):
            raise ValueError(f"side {side!r} is neither writer nor reader")
        self.policy, self.side, self.capacity, self.pending = policy, side, policy.baseline, False

    def message(self, size: int, now: float = 0.0, capacity: int | None = None) -> tuple[str, int, int] | None:
        """(reason, capacity before, capacity after) if the buffer is given back."""
        if self.pending:
            self.capacity, self.pending = self.policy.baseline, False
        self.capacity = max(self.capacity, size) if capacity is None else capacity
        if self.capacity <= self.policy.baseline:
            return None
        reason = self.policy.decide(size, self.capacity, now)
        if reason is None:
            return None
        out = (reason, self.capacity, self.policy.baseline)
        if self.side == "reader":
            self.pending = True
        else:
            self.capacity = self.policy.baseline
        return out


def replay(df: DataFrame, make_policy, side: str = "writer", size: str = "payload_len", clock: str | None = None) -> DataFrame:
    """The reclaim events of each journal (columns path, frame_no and ``size`` of ``df``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gate = None, None
        for batch in batches:
            rows = []
            for path, number, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gate is None or path != now:
                    now, gate = path, Gate(make_policy(), side)
                event = gate.message(n, t)
                if event:
                    rows.append((path, number, event[0], n, *event[1:]))
            names = [f.split(" ")[0] for f in EVENTS.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    time = F.col(clock).cast("double") if clock else F.lit(0.0)
    ordered = df.select("path", "frame_no", F.col(size).cast("bigint").alias("n"), time.alias("t")).repartition("path").sortWithinPartitions("path", "frame_no")
    return ordered.mapInArrow(run, EVENTS)


def size_threshold_events(df: DataFrame, grow: int = 1 << 20, shrink: int = 1 << 10, wait: int = 8, size: str = "payload_len") -> DataFrame:
    """SizeThreshold without a gate, in window functions alone: the runs of small
    messages after each large one; the first run that reaches ``wait`` fires."""
    order = Window.partitionBy("path").orderBy("frame_no")
    armed = df.withColumn("arm", F.count(F.when(F.col(size) > grow, 1)).over(order)).where(F.col("arm") > 0)
    inside = Window.partitionBy("path", "arm").orderBy("frame_no")
    broken = armed.withColumn("run", F.count(F.when(F.col(size) >= shrink, 1)).over(inside))
    small = broken.where(F.col(size) < shrink).withColumn("k", F.row_number().over(Window.partitionBy("path", "arm", "run").orderBy("frame_no")))
    hit = small.where(F.col("k") == wait).withColumn("nth", F.row_number().over(inside))
    return hit.where("nth = 1").select("path", "frame_no", F.lit(THRESHOLD).alias("reason"), F.col(size).alias("last_message_size"))
