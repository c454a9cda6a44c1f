"""Batches of bounded size: how many bytes a Python worker gets and handles at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Bytes of a batch; a longer row is one alone.
BATCH_BYTES = 4 << 20
#: Ranges of so many bytes are copied one at a time; of shorter ones so many by index arrays at once (1 MB of bytes at most).
LONG, RANGES = 256, 4096


def small_batches(spark: SparkSession) -> SparkSession:
    """The session hands rows to Python workers in batches of at most
    :data:`BATCH_BYTES`, unless it has been told otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)
    return spark


def parts(sizes: np.ndarray, most: int | None = None) -> Iterator[slice]:
    """Consecutive rows of at most ``most`` bytes (:data:`BATCH_BYTES`), or single longer ones."""
    ends, at, before, most = np.cumsum(sizes), 0, 0, most or BATCH_BYTES
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, to)
        at, before = to, int(ends[to - 1])


def copy_ranges(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """``out[to : to + size] = data[start : start + size]`` of every range, with little beside the bytes themselves."""
    long = size >= LONG
    if long.any():
        for a, b, n in zip(to[long].tolist(), start[long].tolist(), size[long].tolist(), strict=True):
            out[a : a + n] = data[b : b + n]
        to, start, size = to[~long], start[~long], size[~long]
    for k in range(0, len(size), RANGES):
        n = size[k : k + RANGES]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[k : k + RANGES], n) + inside] = data[np.repeat(start[k : k + RANGES], n) + inside]
