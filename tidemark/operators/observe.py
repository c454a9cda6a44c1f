"""Observation and the fluent chain of a journal's stages.

Before the check, an observer also sees what the check rejects (a writer's);
after it, only what passed (a reader's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators import validation


def observed(df: DataFrame, name: str, payload: str = "payload") -> tuple[DataFrame, Observation]:
    """Count messages and payload bytes as rows pass; no extra job."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias("bytes")), seen


class Stages:
    """``Stages(df).bounded(n).observed("w").with_validator(v).df``: the outermost stage is the last added."""

    def __init__(self, df: DataFrame, payload: str = "payload"):
        self.df, self.payload, self.observations = df, payload, {}

    def bounded(self, most: int, mode: str = "failfast") -> Stages:
        self.df = validation.validate(self.df, validation.bound(most), self.payload, mode)
        return self

    def with_validator(self, validator: validation.Validator, mode: str = "failfast") -> Stages:
        self.df = validation.validate(self.df, validator, self.payload, mode)
        return self

    def observed(self, name: str) -> Stages:
        self.df, self.observations[name] = observed(self.df, name, self.payload)
        return self
