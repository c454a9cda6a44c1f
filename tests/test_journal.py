import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import observe, policy, recovery
from tidemark.sources.codec import format_of
from tidemark.sources.files import listing, publish
from tidemark.streaming import journals


def write(path, payloads, checksum="none"):
    publish(str(path), format_of(checksum).encode(pa.array(payloads, pa.binary())))


def load(spark, path, **options):
    return spark.read.format("framed").options(**options).load(str(path))


@pytest.mark.parametrize("checksum", ["none", "crc16", "crc32", "xxh3"])
def test_round_trip(spark, tmp_path, checksum):
    df = spark.range(500).select(F.encode(F.concat(F.lit("message "), F.col("id").cast("string")), "UTF-8").alias("payload")).coalesce(1)
    df.write.format("framed").option("checksum", checksum).mode("append").save(f"{tmp_path}/j")
    got = load(spark, f"{tmp_path}/j", checksum=checksum, splitBytes="999").orderBy("frame_no").collect()
    assert [bytes(r.payload) for r in got] == [f"message {k}".encode() for k in range(500)]
    assert [r.frame_no for r in got] == [*range(500)]
    head = load(spark, f"{tmp_path}/j", checksum=checksum, headerOnly="true")
    assert head.agg(F.sum("payload_len")).first()[0] == sum(r.payload_len for r in got)
    assert not [p for p, _ in listing(f"{tmp_path}/j") if "/_" in p]


def test_bounded_sink_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"x" * 10),)], "payload binary")
    with pytest.raises(Exception, match="payload is longer than the limit"):
        df.write.format("framed").option("maxPayloadLen", "9").mode("append").save(f"{tmp_path}/j")
    assert listing(f"{tmp_path}/j") == []


def test_modes(spark, tmp_path):
    write(tmp_path / "a.journal", [b"one", b"two", b"three"], "crc32")
    data = bytearray((tmp_path / "a.journal").read_bytes())
    data[19] ^= 1  # inside the second payload
    (tmp_path / "a.journal").write_bytes(data)
    with pytest.raises(Exception, match="ChecksumMismatch"):
        load(spark, tmp_path, checksum="crc32").collect()
    rows = load(spark, tmp_path, checksum="crc32", mode="permissive").orderBy("frame_no").collect()
    assert [(r.frame_no, r.error.kind if r.error else None) for r in rows] == [(0, None), (1, "ChecksumMismatch"), (2, None)]
    (tmp_path / "a.journal").write_bytes(data[:-1])
    rows = load(spark, tmp_path, checksum="crc32", mode="permissive").orderBy("frame_no").collect()
    assert [r.error.kind if r.error else None for r in rows] == [None, "ChecksumMismatch", "UnexpectedEof"]


def test_recover_repair_append(spark, tmp_path):
    for name, payloads in (("a", [b"1", b"22"]), ("b", [b"333"]), ("c", [])):
        write(tmp_path / f"{name}.journal", payloads, "xxh3")
    whole = (tmp_path / "a.journal").read_bytes()
    (tmp_path / "a.journal").write_bytes(whole + b"\x05\0\0\0torn")
    broken = bytearray((tmp_path / "b.journal").read_bytes())
    broken[-1] ^= 1
    (tmp_path / "b.journal").write_bytes(broken)
    got = {os.path.basename(r.path): r for r in recovery.recover(spark, str(tmp_path), "xxh3").collect()}
    assert (got["a.journal"].frames, got["a.journal"].last_good_offset, got["a.journal"].end) == (2, len(whole), "TornTail")
    assert got["b.journal"].end is None and got["b.journal"].error.kind == "ChecksumMismatch"
    assert (got["c.journal"].frames, got["c.journal"].end) == (0, "CleanEof")
    assert recovery.repair(str(tmp_path / "a.journal"), "xxh3")["last_good_offset"] == len(whole)
    recovery.append(str(tmp_path / "a.journal"), pa.array([b"4"], pa.binary()), "xxh3")
    assert (tmp_path / "a.journal").read_bytes() == format_of("xxh3").encode(pa.array([b"1", b"22", b"4"], pa.binary()))


def test_observers_around_a_bound(spark):
    df = spark.createDataFrame([(bytearray(b"x" * n),) for n in (1, 5, 9)], "payload binary")
    stages = observe.Stages(df).observed("before").bounded(5, mode="permissive")
    stages.df = stages.df.where("error is null")
    stages.observed("after").df.collect()
    assert stages.observations["before"].get == {"messages": 3, "bytes": 15}
    assert stages.observations["after"].get == {"messages": 2, "bytes": 6}


def test_overwrite_and_index(spark, tmp_path, monkeypatch):
    from tidemark.sources import journal

    save = lambda df, **o: df.write.format("framed").options(checksum="crc32", **o).mode("overwrite").save(f"{tmp_path}/j")
    some = spark.range(300).select(F.encode(F.concat(F.lit("message "), F.col("id").cast("string")), "UTF-8").alias("payload")).coalesce(1)
    save(some)
    with pytest.raises(Exception, match="longer than the limit"):
        save(some, maxPayloadLen="3")
    assert load(spark, f"{tmp_path}/j", checksum="crc32").count() == 300
    save(some.limit(200).coalesce(1))
    ((path, size),) = listing(f"{tmp_path}/j")
    form = format_of("crc32")
    monkeypatch.setattr(journal, "SPLIT_BYTES", 100)
    assert journal.read_index(path, size, form) is None and len(journal.pieces(path, size, form, 1000)) > 3
    assert journal.build_index(spark, f"{tmp_path}/j", checksum="crc32") == 1
    assert journal.read_index(path, size, form) == []  # shorter than the index's step
    want = [*journal.boundaries(path, size, form, 100)]
    publish(journal.index_name(path), journal._index(size, form, want))
    cuts = journal.pieces(path, size, form, 1000)
    assert 3 <= len(cuts) and all((p.start, p.first) in [(0, 0), *want] for p in cuts) and journal.read_index(path, size + 1, form) is None
    got = load(spark, f"{tmp_path}/j", checksum="crc32", splitBytes="1000").orderBy("frame_no").collect()
    assert [r.frame_no for r in got] == [*range(200)] and [bytes(r.payload) for r in got] == [f"message {k}".encode() for k in range(200)]


def decide(p, sizes, capacity=1000, times=None):
    return [p.decide(s, capacity, t) for s, t in zip(sizes, times or [0.0] * len(sizes), strict=True)]


def test_policies():
    assert decide(policy.Adaptive(10, 3), [150, 90, 80, 200, 50, 50, 50]) == [None] * 6 + [policy.COUNT]
    cool = lambda: policy.Adaptive(10, 100, 0.05)
    assert decide(cool(), [50, 50, 50], times=[0, 0, 0.06]) == [None, None, policy.COOLDOWN]
    assert decide(cool(), [50, 50], times=[0.06, 0.12]) == [None, policy.COOLDOWN]
    assert decide(policy.SizeThreshold(1000, 200, 2), [100, 100, 100, 5000, 100, 500, 100, 100]) == [None] * 7 + [policy.THRESHOLD]
    assert decide(policy.Adaptive(1, 1), [0]) == [None] and decide(policy.NoOp(), [1] * 5) == [None] * 5


def test_replay(spark):
    rows = spark.createDataFrame([("j", k, n) for k, n in enumerate([10_240, 100, 100, 100, 100])], "path string, frame_no bigint, payload_len bigint")
    for side in ("writer", "reader"):
        got = policy.replay(rows, lambda: policy.Adaptive(2, 3, baseline=1024), side).collect()
        assert [(r.frame_no, r.reason, r.capacity_before, r.capacity_after) for r in got] == [(3, policy.COUNT, 10_240, 1024)]


def test_streams(spark, tmp_path):
    write(tmp_path / "in/1.journal", [b"x" * 5000, b"1"])
    write(tmp_path / "in/2.journal", [b"2", b"3"])

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = journals.stream(spark, str(tmp_path / "in"))
    assert run(stream.groupBy().count(), "counted", "complete")[0][0] == 4
    events = run(journals.policy_events(stream, lambda: policy.SizeThreshold(1000, 200, 1, baseline=10)), "events", "append")
    assert [(os.path.basename(r.path), r.frame_no) for r in events] == [("1.journal", 1)]


def test_stream_takes_names_in_any_order(spark, tmp_path):
    from tidemark.sources.journal import JournalStreamReader

    form = format_of("none")
    add = lambda name: publish(f"{tmp_path}/in/{name}.journal", form.encode(pa.array([name.encode()], pa.binary()), None))
    seen = []
    for names in (["m", "p"], ["a"], ["n", "z"], []):
        for name in names:
            add(name)
        query = spark.readStream.format("framed").load(f"{tmp_path}/in").writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        query = query.foreachBatch(lambda df, _: seen.extend(bytes(r.payload).decode() for r in df.collect())).start()
        query.awaitTermination(60)
        query.stop()
        assert sorted(seen[-len(names) :] if names else []) == names
    assert sorted(seen) == ["a", "m", "n", "p", "z"]
    reader = JournalStreamReader({"path": f"{tmp_path}/in"})
    paths = lambda start, end: [p.path.rsplit("/", 1)[1][0] for p in reader.partitions(start, end)]
    assert paths({"last": f"{tmp_path}/in/n.journal"}, reader.latestOffset()) == ["p", "z"]


def test_permissive_rows_come_in_few_batches(tmp_path):
    from tidemark.sources import journal

    payloads = [b"message %d" % k for k in range(7000)]
    write(tmp_path / "a.journal", payloads, "crc32")
    data, at = bytearray((tmp_path / "a.journal").read_bytes()), 0
    for k, p in enumerate(payloads):
        at += 8 + len(p)
        if k % 7 == 0:
            data[at - 1] ^= 255
    (tmp_path / "a.journal").write_bytes(data + b"\x09\0\0\0torn")
    piece = journal.Piece(f"{tmp_path}/a.journal", 0, None, 5)
    got = [*journal.read_piece(piece, format_of("crc32"), {"mode": "permissive"})]
    assert len(got) == 2  # the frames, and the torn end
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["frame_no"] for r in rows] == [*range(5, 7006)]
    assert [r["error"] and r["error"]["kind"] for r in rows] == [None if k % 7 else "ChecksumMismatch" for k in range(7000)] + ["UnexpectedEof"]
    form = format_of("crc32")
    for k in (0, 1, 6993):
        sound = form.checksum.of(payloads[k])
        spoilt = payloads[k][:-1] + bytes([payloads[k][-1] ^ 255])
        assert rows[k]["checksum"] == sound and rows[k]["payload"] == (payloads[k] if k % 7 else spoilt)
        if k % 7 == 0:
            assert (rows[k]["error"]["expected"], rows[k]["error"]["calculated"]) == (str(sound), str(form.checksum.of(spoilt)))


def test_journal_of_faults_has_an_index(spark, monkeypatch):
    from tidemark.plans import catalogue
    from tidemark.functions.checksum import framed
    from tidemark.sources import journal

    monkeypatch.setattr(journal, "SPLIT_BYTES", 1000)
    make = lambda: spark.range(500, numPartitions=1).select(framed(F.encode(F.col("id").cast("string"), "UTF-8"), "crc32").alias("frame"))
    ((path, size),) = listing(catalogue.raw_journal(spark, "of faults", "faults", make, checksum="crc32"))
    assert journal.read_index(path, size, format_of("crc32")) is not None
