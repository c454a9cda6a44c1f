"""FlatBuffers payloads: descriptors, and batch-wise encoding, verifying and decoding.

A descriptor lists a table's fields (name, vtable slot, type, default) or names
another root (string, bytes, vector of doubles).  Whole Arrow batches are
handled with array operations: positions of tables, vtables and fields are
gathered for all payloads at once and checked against each payload's bounds
before anything is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import FlatbuffersFailure, ValidationFailed
from tidemark.functions.batches import copy_ranges, parts, small_batches
from tidemark.sources.codec import binary_buffers, cut

#: FlatBuffers type -> (numpy type, Arrow type, Spark type).
SCALARS = {
    "bool": ("<u1", pa.bool_(), "boolean"),
    "byte": ("<i1", pa.int8(), "tinyint"),
    "ubyte": ("<u1", pa.int16(), "smallint"),
    "short": ("<i2", pa.int16(), "smallint"),
    "ushort": ("<u2", pa.int32(), "int"),
    "int": ("<i4", pa.int32(), "int"),
    "uint": ("<u4", pa.int64(), "bigint"),
    "long": ("<i8", pa.int64(), "bigint"),
    "ulong": ("<u8", pa.decimal128(20, 0), "decimal(20,0)"),
    "float": ("<f4", pa.float32(), "float"),
    "double": ("<f8", pa.float64(), "double"),
}
ROOTS = {"string": (pa.string(), "string"), "bytes": (pa.binary(), "binary"), "doubles": (pa.list_(pa.float64()), "array<double>")}


@dataclass(frozen=True)
class Field:
    """``kind``: a scalar, ``string``, or ``[struct]`` with ``members`` (name, scalar kind)."""

    name: str
    slot: int
    kind: str
    default: float = 0
    members: tuple[tuple[str, str], ...] = ()

    @property
    def arrow(self) -> pa.DataType:
        if self.kind == "string":
            return pa.string()
        if self.kind == "[struct]":
            return pa.list_(pa.struct([(n, SCALARS[k][1]) for n, k in self.members]))
        return SCALARS[self.kind][1]

    @property
    def spark(self) -> str:
        if self.kind == "[struct]":
            return "array<struct<" + ", ".join(f"{n}: {SCALARS[k][2]}" for n, k in self.members) + ">>"
        return "string" if self.kind == "string" else SCALARS[self.kind][2]


@dataclass(frozen=True)
class Descriptor:
    name: str
    fields: tuple[Field, ...] = ()
    root: str = "table"

    @property
    def arrow(self) -> pa.Schema:
        return pa.schema([(f.name, f.arrow) for f in self.fields] if self.root == "table" else [("value", ROOTS[self.root][0])])

    @property
    def ddl(self) -> str:
        return ", ".join(f"{f.name} {f.spark}" for f in self.fields) if self.root == "table" else f"value {ROOTS[self.root][1]}"


# The message schemas in use, by vtable slot.
TELEMETRY = Descriptor("TelemetryEvent", (Field("message", 4, "string"), Field("timestamp", 6, "ulong")))
MESSAGE = Descriptor("MessageEvent", (Field("timestamp", 4, "double"), Field("event_type", 6, "ubyte"), Field("order_id", 8, "ulong"), Field("size", 10, "uint"), Field("price", 12, "long"), Field("direction", 14, "byte")))
_LEVEL = (("price", "long"), ("size", "ulong"))
ORDER_BOOK = Descriptor("OrderBookSnapshot", (Field("timestamp", 4, "double"), Field("asks", 6, "[struct]", members=_LEVEL), Field("bids", 8, "[struct]", members=_LEVEL)))
STRING, BYTES, DOUBLES = Descriptor("string", root="string"), Descriptor("bytes", root="bytes"), Descriptor("doubles", root="doubles")


class _Batch:
    """Payloads of one batch as a flat buffer with each one's bounds."""

    def __init__(self, payloads: pa.Array):
        offsets, self.data = binary_buffers(payloads)
        self.lo, self.hi, self.n = offsets[:-1], offsets[1:], len(payloads)
        self.why = np.full(self.n, "", dtype=object)

    def fail(self, where: np.ndarray, reason: str) -> None:
        self.why[where & (self.why == "")] = reason

    @property
    def good(self) -> np.ndarray:
        return self.why == ""

    def take(self, at: np.ndarray, dtype: str, ok: np.ndarray, fill=0) -> np.ndarray:
        """Values at absolute positions ``at`` where ``ok``."""
        kind = np.dtype(dtype)
        out = np.full(self.n, fill, kind)
        k = np.flatnonzero(ok)
        if len(k):
            out[k] = np.ascontiguousarray(self.data[at[k][:, None] + np.arange(kind.itemsize)]).view(kind).ravel()
        return out

    def inside(self, at: np.ndarray, size) -> np.ndarray:
        return (at >= self.lo) & (at + size <= self.hi)

    def root(self) -> np.ndarray:
        self.fail(self.hi - self.lo < 4, "buffer too small for FlatBuffer")
        at = self.lo + self.take(self.lo, "<u4", self.good).astype(np.int64)
        self.fail(self.good & ~self.inside(at, 4), "root lies outside the buffer")
        return at

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of root tables and vtables, and the vtables' sizes; only the root is looked at."""
        at = self.root()
        self.fail(self.good & ((at - self.lo) % 4 != 0), "table is not aligned")
        vt = at - self.take(at, "<i4", self.good).astype(np.int64)
        self.fail(self.good & ~self.inside(vt, 4), "vtable lies outside the buffer")
        size = self.take(vt, "<u2", self.good).astype(np.int64)
        self.fail(self.good & ((size < 4) | (size % 2 != 0) | ~self.inside(vt, size)), "vtable is broken")
        own = self.take(vt + 2, "<u2", self.good).astype(np.int64)
        self.fail(self.good & ~self.inside(at, own), "table lies outside the buffer")
        return at, vt, size

    def vector(self, at: np.ndarray, width: int, has: np.ndarray, reason: str, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of vectors at ``at``."""
        self.fail(has & ~self.inside(at, 4), reason)
        n = self.take(at, "<u4", has & self.good).astype(np.int64)
        self.fail(has & self.good & ~self.inside(at, 4 + n * width + extra), reason)
        return at + 4, np.where(has & self.good, n, 0)


def _values(values: np.ndarray, kind: str) -> pa.Array:
    arrow = SCALARS[kind][1]
    if kind == "ulong":
        return pa.array(values.tolist(), arrow)
    return pa.array(values.astype(bool) if kind == "bool" else values).cast(arrow)


def _spread(start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Positions of all elements of vectors."""
    first = np.cumsum(n) - n
    return np.repeat(start, n) + width * (np.arange(int(n.sum())) - np.repeat(first, n))


def decode_batch(payloads: pa.Array, what: Descriptor) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of the descriptor, and for each payload why it is not one ('' if it is)."""
    b = _Batch(payloads)
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    if what.root != "table":
        at = b.root()
        width = 8 if what.root == "doubles" else 1
        start, n = b.vector(at, width, b.good, "vector lies outside the buffer", int(what.root == "string"))
        n = np.where(b.good, n, 0)
        if what.root == "doubles":
            flat = b.data[_spread(start, n, 8)[:, None] + np.arange(8)] if n.sum() else np.zeros((0, 8), np.uint8)
            return [pa.ListArray.from_arrays(offsets(n), pa.array(np.ascontiguousarray(flat).view("<f8").ravel()))], b.why
        return [_text(cut(b.data, np.where(n > 0, start, 0), n), b) if what.root == "string" else cut(b.data, np.where(n > 0, start, 0), n)], b.why
    at, vt, size = b.table()
    out = []
    for f in what.fields:
        listed = b.good & (f.slot + 2 <= size)
        off = b.take(vt + f.slot, "<u2", listed).astype(np.int64)
        has = listed & (off > 0)
        if f.kind in SCALARS:
            kind = np.dtype(SCALARS[f.kind][0])
            b.fail(has & ~b.inside(at + off, kind.itemsize), f"field {f.name} lies outside the buffer")
            out.append(_values(b.take(at + off, SCALARS[f.kind][0], has & b.good, f.default), f.kind))
            continue
        b.fail(has & ~b.inside(at + off, 4), f"field {f.name} lies outside the buffer")
        to = at + off + b.take(at + off, "<u4", has & b.good).astype(np.int64)
        width = 1 if f.kind == "string" else sum(np.dtype(SCALARS[k][0]).itemsize for _, k in f.members)
        start, n = b.vector(to, width, has & b.good, f"field {f.name} lies outside the buffer", int(f.kind == "string"))
        none = ~(has & b.good)
        if f.kind == "string":
            got = _text(cut(b.data, np.where(n > 0, start, 0), n), b)
            out.append(pa.compute.if_else(pa.array(none), pa.scalar(None, pa.string()), got))
            continue
        spots, columns, shift = _spread(start, n, width), [], 0
        for _, k in f.members:
            kind = np.dtype(SCALARS[k][0])
            raw = b.data[(spots + shift)[:, None] + np.arange(kind.itemsize)] if len(spots) else np.zeros((0, kind.itemsize), np.uint8)
            columns.append(_values(np.ascontiguousarray(raw).view(kind).ravel(), k))
            shift += kind.itemsize
        flat = pa.StructArray.from_arrays(columns, [m for m, _ in f.members])
        out.append(pa.ListArray.from_arrays(offsets(n), flat, mask=pa.array(none)) if len(none) else pa.array([], f.arrow))
    return out, b.why


def _text(raw: pa.Array, b: _Batch) -> pa.Array:
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        out = []
        for k, x in enumerate(raw.to_pylist()):
            try:
                out.append(x.decode())
            except UnicodeDecodeError:
                out.append(None)
                b.fail(np.arange(b.n) == k, "string is not UTF-8")
        return pa.array(out, pa.string())


def verify_root(payloads: pa.Array) -> np.ndarray:
    """Why each payload has no sound root table ('' if it has); child tables are not walked."""
    b = _Batch(payloads)
    b.table()
    return b.why


def _pad(n: np.ndarray | int, to: int):
    return -n % to


def encode_batch(columns: list[pa.Array], what: Descriptor) -> pa.Array:
    """Payloads of rows; fields at their default are written too, which readers cannot tell apart."""
    n = len(columns[0])
    if what.root in ("string", "bytes"):
        data, tail = columns[0].cast(pa.string()).cast(pa.binary()) if what.root == "string" else columns[0], int(what.root == "string")
        off, raw = binary_buffers(data)
        size = np.diff(off)
        total = 8 + size + tail + _pad(size + tail, 4)
        return _assemble(n, total, [(np.zeros(n, np.int64), np.full(n, 4, "<u4")), (np.full(n, 4), size.astype("<u4"))], [(np.full(n, 8), off[:-1], size, raw)])
    if what.root == "doubles":
        lists = columns[0].cast(pa.large_list(pa.float64()))
        off, raw = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<f8").view(np.uint8)
        size = np.diff(off)
        # the length stands 4 bytes before data aligned to 8
        return _assemble(n, 8 + 8 * size, [(np.zeros(n, np.int64), np.full(n, 4, "<u4")), (np.full(n, 4), size.astype("<u4"))], [(np.full(n, 8), off[:-1] * 8, size * 8, raw)])
    last = max(f.slot for f in what.fields) + 2
    inline = sorted(what.fields, key=lambda f: -(np.dtype(SCALARS[f.kind][0]).itemsize if f.kind in SCALARS else 4))
    at, place = 4, {}
    for f in inline:
        w = np.dtype(SCALARS[f.kind][0]).itemsize if f.kind in SCALARS else 4
        at += _pad(at + 4, w) if w == 8 else _pad(at, w)
        place[f.name] = at
        at += w
    own = at + _pad(at, 4)
    # root offset, vtable, then the table at a position of 4 more than a multiple of 8
    table = 4 + last
    table += (4 - table) % 8
    head = [(np.zeros(n, np.int64), np.full(n, table, "<u4")), (np.full(n, table), np.full(n, table - 4, "<i4")), (np.full(n, 4), np.full(n, last, "<u2")), (np.full(n, 6), np.full(n, own, "<u2"))]
    total, tails = np.full(n, table + own, np.int64), []
    for f, column in zip(what.fields, columns, strict=True):
        spot = np.full(n, table + place[f.name])
        held = ~np.asarray(column.is_null()) if column.null_count else np.ones(n, bool)
        slot = np.where(held | (f.kind in SCALARS), place[f.name], 0)
        head.append((np.full(n, 4 + f.slot), slot.astype("<u2")))
        if f.kind in SCALARS:
            kind = np.dtype(SCALARS[f.kind][0])
            raw = np.array([int(x) if x is not None else 0 for x in column.to_pylist()], kind) if f.kind == "ulong" else column.fill_null(f.default).to_numpy(zero_copy_only=False).astype(kind)
            head.append((spot, raw))
            continue
        if f.kind == "string":
            off, raw = binary_buffers(column.fill_null("").cast(pa.binary()))
            width, size, tail = 1, np.diff(off), 1
        else:
            lists = column.fill_null([]) if column.null_count else column
            flat, off = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            parts = []
            for k, (_, m) in enumerate(f.members):
                kind = np.dtype(SCALARS[m][0])
                values = np.array([int(x) for x in flat.field(k).to_pylist()], kind) if m == "ulong" else flat.field(k).to_numpy(zero_copy_only=False).astype(kind)
                parts.append(values.view(np.uint8).reshape(len(values), kind.itemsize))
            rows = np.concatenate(parts, axis=1) if len(flat) else np.zeros((0, 16), np.uint8)
            width, size, tail, raw = rows.shape[1], np.diff(off), 0, rows.ravel()
        total += _pad(total + 4, 8) if f.kind != "string" else _pad(total, 4)  # the data after the length is aligned
        head.append((spot, np.where(held, total - spot, 0).astype("<u4")))
        head.append((total.copy(), size.astype("<u4")))
        tails.append((total + 4, off[:-1] * width, size * width, raw))
        total = total + 4 + size * width + tail
    return _assemble(n, total + _pad(total, 4), head, tails)


def _assemble(n: int, total: np.ndarray, fixed: list, ranges: list) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    out = np.zeros(int(offsets[-1]), np.uint8)
    for at, values in fixed:
        w = values.dtype.itemsize
        out[(offsets[:-1] + at)[:, None] + np.arange(w)] = np.ascontiguousarray(values).view(np.uint8).reshape(n, w)
    for at, start, size, raw in ranges:
        copy_ranges(out, offsets[:-1] + at, raw, start, size)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded size, whatever the session hands over."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                sizes += 8 * np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
            elif any(kind(column.type) for kind in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
                sizes += np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        for s in parts(sizes + 8 * batch.num_columns):
            yield batch.slice(s.start, s.stop - s.start)


def decode(df: DataFrame, what: Descriptor, payload: str = "payload", keep: tuple[str, ...] = (), verify: bool = True) -> DataFrame:
    """The descriptor's columns of each row's payload, beside the columns ``keep``;
    a payload that is none raises, or with ``verify=False`` gives nulls and defaults."""
    small_batches(df.sparkSession)
    out = df.select(*keep).schema
    names = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            columns, why = decode_batch(batch.column(batch.num_columns - 1), what)
            bad = np.flatnonzero(why != "")
            if verify and len(bad):
                raise FlatbuffersFailure(str(why[bad[0]]), validator=what.name, reason=str(why[bad[0]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *what.arrow.names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), what.ddl])
    return df.select(*keep, F.col(payload).alias("__payload")).mapInArrow(run, ddl)


def encode(df: DataFrame, what: Descriptor, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``payload`` made of the descriptor's columns, beside the columns ``keep``."""
    small_batches(df.sparkSession)
    columns = columns or what.arrow.names
    kept = df.select(*keep).schema
    types = [f.spark for f in what.fields] if what.root == "table" else [ROOTS[what.root][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], encode_batch(batch.columns[len(keep) :], what)], [*keep, "payload"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "payload binary"])
    return df.select(*keep, *[F.col(c).cast(t).alias(f"__{k}") for k, (c, t) in enumerate(zip(columns, types, strict=True))]).mapInArrow(run, ddl)


def root_failure(payload: bytes, name: str = "TableRootValidator") -> ValidationFailed | None:
    why = verify_root(pa.array([payload], pa.binary()))[0]
    return ValidationFailed(f"{name}: {why}", validator=name, reason=str(why)) if why else None
