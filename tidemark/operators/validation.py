"""Validators as columns: each gives an ``error`` struct, null for a good payload."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ERROR_TYPE, PAYLOAD_OVER_LIMIT
from tidemark.functions.flatbuf import Descriptor, decode_batch, verify_root

#: A validator: payload column -> error column.
Validator = Callable[[Column], Column]


def failure(kind: str, message: Column | str, validator: str | None = None, **fields) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    given = {"kind": F.lit(kind), "message": text, "validator": F.lit(validator), "reason": text if validator else F.lit(None)} | fields
    names = [p.split(":")[0].strip() for p in ERROR_TYPE[len("struct<") : -1].split(",")]
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(ERROR_TYPE)


def none() -> Validator:
    return lambda payload: F.lit(None).cast(ERROR_TYPE)


def size(least: int = 0, most: int = 2**31 - 1, name: str = "SizeValidator") -> Validator:
    """Lengths from ``least`` to ``most``, both included."""

    def check(payload: Column) -> Column:
        n = F.octet_length(payload)
        said = F.concat(F.lit("size "), n.cast("string"), F.lit(f" is not within {least} to {most}"))
        return F.when(~n.between(least, most), failure("ValidationFailed", said, name, buffer_len=n.cast("bigint")))

    return check


def bound(most: int) -> Validator:
    """The bound of a framer, as a check before any byte is written."""
    return lambda payload: F.when(F.octet_length(payload) > most, failure("InvalidFrame", PAYLOAD_OVER_LIMIT, declared_len=F.octet_length(payload).cast("bigint"), limit=F.lit(most).cast("bigint")))


def _python(name: str, why) -> Validator:
    @F.pandas_udf("string")
    def reason(payloads: pd.Series) -> pd.Series:
        return pd.Series(why(pa.array(payloads, pa.binary())), dtype=object)

    def check(payload: Column) -> Column:
        r = reason(payload)
        return F.when(r != "", failure("ValidationFailed", r, name))

    return check


def table_root(name: str = "TableRootValidator") -> Validator:
    """A sound root table; child tables are not walked, whatever the nesting."""
    return _python(name, verify_root)


def typed(what: Descriptor, name: str = "TypedValidator") -> Validator:
    """A payload that decodes as ``what``, all of whose fields lie inside."""
    return _python(name, lambda payloads: decode_batch(payloads, what)[1])


def composite(*validators: Validator) -> Validator:
    """All must pass, in order; the first failure wins, under its own validator's name."""
    return lambda payload: reduce(lambda a, b: F.coalesce(a, b), [v(payload) for v in validators], F.lit(None).cast(ERROR_TYPE))


def validate(df: DataFrame, validator: Validator, payload: str = "payload", mode: str = "failfast") -> DataFrame:
    """Permissive: an ``error`` column (an earlier error stays).  Failfast: the first failure raises."""
    error = validator(F.col(payload))
    if mode == "permissive":
        earlier = F.col("error") if "error" in df.columns else F.lit(None).cast(ERROR_TYPE)
        return df.withColumn("error", F.coalesce(earlier, error))
    checked = F.when(error.isNotNull(), F.raise_error(F.concat_ws(": ", error["kind"], error["validator"], error["message"])).cast("binary")).otherwise(F.col(payload))
    return df.withColumn(payload, checked)
