import tracemalloc
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidemark.functions import flatbuf as fb
from tidemark.operators import validation

LEVELS = fb.ORDER_BOOK.fields[1].arrow


def book():
    return [pa.array([1.0, 2.0]), pa.array([[{"price": 1, "size": Decimal(5)}], None], LEVELS), pa.array([[], [{"price": -9999999999, "size": Decimal(0)}]], LEVELS)]


def test_tables():
    rows = [pa.array([0.0, 36023.5]), pa.array([1, 7], pa.int16()), pa.array([Decimal(42), Decimal(2**64 - 1)], pa.decimal128(20, 0)), pa.array([1, 2**32 - 1]), pa.array([100, -1]), pa.array([1, -1], pa.int8())]
    payloads = fb.encode_batch(rows, fb.MESSAGE)
    columns, why = fb.decode_batch(payloads, fb.MESSAGE)
    assert [c.to_pylist() for c in columns] == [r.to_pylist() for r in rows] and not any(why)
    columns, why = fb.decode_batch(fb.encode_batch(book(), fb.ORDER_BOOK), fb.ORDER_BOOK)
    assert [c.to_pylist() for c in columns] == [r.to_pylist() for r in book()] and not any(why)


def test_absent_fields_take_defaults():
    empty = b"\x08\0\0\0" + b"\x04\0\x04\0" + b"\x04\0\0\0"  # a table without fields
    columns, why = fb.decode_batch(pa.array([empty], pa.binary()), fb.MESSAGE)
    assert not any(why) and [c[0].as_py() for c in columns] == [0, 0, 0, 0, 0, 0]
    columns, _ = fb.decode_batch(pa.array([empty], pa.binary()), fb.TELEMETRY)
    assert [c[0].as_py() for c in columns] == [None, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_string_roots(texts):
    payloads = fb.encode_batch([pa.array(texts)], fb.STRING)
    assert [len(p) for p in payloads.to_pylist()] == [8 + 4 * -(-(len(t.encode()) + 1) // 4) for t in texts]
    assert fb.decode_batch(payloads, fb.STRING)[0][0].to_pylist() == texts


def test_vectors_and_bytes():
    rows = pa.array([[1.0, 2.5], [], [3.0]], pa.list_(pa.float64()))
    assert fb.decode_batch(fb.encode_batch([rows], fb.DOUBLES), fb.DOUBLES)[0][0].to_pylist() == rows.to_pylist()
    assert fb.encode_batch([pa.array([bytes(1024)], pa.binary())], fb.BYTES)[0].as_py() == bytes.fromhex("0400000000040000") + bytes(1024)


def test_root_verification():
    why = fb.verify_root(pa.array([b"", b"abc", b"not a flatbuffer table", *fb.encode_batch(book(), fb.ORDER_BOOK).to_pylist()], pa.binary()))
    assert why[0] == why[1] == "buffer too small for FlatBuffer" and why[2] and not why[3] and not why[4]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_broken_payloads_are_caught_or_decoded(data):
    base = bytearray(fb.encode_batch(book(), fb.ORDER_BOOK)[data.draw(st.integers(0, 1))].as_py())
    for _ in range(data.draw(st.integers(0, 5))):
        base[data.draw(st.integers(0, len(base) - 1))] = data.draw(st.integers(0, 255))
    cut = bytes(base[: data.draw(st.integers(0, len(base)))])
    for what in (fb.ORDER_BOOK, fb.TELEMETRY, fb.MESSAGE, fb.STRING, fb.DOUBLES):
        fb.decode_batch(pa.array([cut], pa.binary()), what)


def test_decode_in_spark(spark):
    rows = spark.createDataFrame([("hello", 123), (None, 0)], "message string, timestamp bigint")
    back = fb.decode(fb.encode(rows, fb.TELEMETRY), fb.TELEMETRY).collect()
    assert sorted((r.message or "", int(r.timestamp)) for r in back) == [("", 0), ("hello", 123)]
    with pytest.raises(PythonException, match="FlatbuffersFailure"):
        fb.decode(spark.createDataFrame([(bytearray(b"xy"),)], "payload binary"), fb.TELEMETRY).collect()


def test_validators(spark):
    good = fb.encode(spark.createDataFrame([("m", 1)], "message string, timestamp bigint"), fb.TELEMETRY).collect()[0].payload
    df = spark.createDataFrame([(0, good), (1, bytearray(b"abc")), (2, bytearray(b"not a flatbuffer table"))], "k int, payload binary")
    check = validation.composite(validation.size(4, 1000), validation.table_root(), validation.typed(fb.TELEMETRY))
    got = {r.k: r.error for r in validation.validate(df, check, mode="permissive").collect()}
    assert got[0] is None and got[1].validator == "SizeValidator" and got[2].validator == "TableRootValidator"
    with pytest.raises(Exception, match="ValidationFailed: (Size|TableRoot)Validator"):
        validation.validate(df, check).collect()
    assert [r.error for r in validation.validate(df, validation.none(), mode="permissive").collect()] == [None] * 3
    assert validation.validate(df, validation.bound(22), mode="permissive").where("error is not null").count() == (len(good) > 22)


def peak(run):
    """What ``run`` gives, and the bytes of Python and NumPy it held at most."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_encoding_holds_little_beside_the_bytes(spark):
    texts = [("ä" if k % 2 else "b") * (k % 3000) for k in range(4000)]
    column = pa.array(texts)
    payloads, most = peak(lambda: fb.encode_batch([column], fb.STRING))
    assert most < 3 * payloads.nbytes
    (back,), why = fb.decode_batch(payloads, fb.STRING)
    assert back.to_pylist() == texts and not any(why)
    batch = pa.record_batch([pa.array(range(4000)), column], ["k", "v"])
    some = [*fb.in_parts([batch])]
    assert len(some) > 1 and max(x.nbytes for x in some) < 5 << 20
    assert pa.Table.from_batches(some).combine_chunks() == pa.Table.from_batches([batch])
    doubles = pa.record_batch([pa.array([[1.0, k] * 600 for k in range(1000)])], ["v"])
    parts = [fb.encode_batch(x.columns, fb.DOUBLES) for x in fb.in_parts([doubles])]
    assert len(parts) > 1 and pa.concat_arrays(parts).equals(fb.encode_batch(doubles.columns, fb.DOUBLES))


def test_sink_lays_out_parts_of_a_batch(tmp_path, monkeypatch):
    from pyspark import TaskContext

    from tidemark.sources import journal

    data = pa.record_batch([pa.array([bytes([k % 256]) * (k % 5000) for k in range(8000)], pa.binary())], ["payload"])
    task = type("Task", (), {"partitionId": lambda _: 3, "taskAttemptId": lambda _: 7})
    monkeypatch.setattr(TaskContext, "get", staticmethod(task))
    sink = journal.JournalWriter({"path": str(tmp_path), "checksum": "crc32"}, False, 0)
    done, most = peak(lambda: sink.write(iter([data])))
    assert most < 1.5 * data.nbytes  # one part's layout, not the batch's
    assert (tmp_path / done.temp.rpartition("/")[2]).read_bytes() == b"".join(map(sink.form.encode_one, data.column(0).to_pylist()))
    ends = np.cumsum([8 + len(p) for p in data.column(0).to_pylist()])
    assert done.frames == 8000 and done.bytes == ends[-1] > journal.INDEX_BYTES and done.marks and all(at == ends[n - 1] for at, n in done.marks)


def test_sessions_hand_over_small_batches(spark):
    from tidemark.functions.batches import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own, want in ((None, str(BATCH_BYTES)), ("12345678", "12345678")):
        session = spark.newSession()
        session.conf.unset(name)
        if own:
            session.conf.set(name, own)
        rows = session.range(3000).select(F.repeat(F.lit("long text "), 500).alias("value"))
        sizes = fb.encode(rows.coalesce(1), fb.STRING).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in bs), "n bigint").collect()
        assert session.conf.get(name) == want and (own or max(r.n for r in sizes) < 2 * BATCH_BYTES)
