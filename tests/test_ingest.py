import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import flatbuf
from tidemark.operators import ingest

KINDS = {"message": "message", "orderbook": "orderbook"}


def archive(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(f"{name}_1.csv", text)
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_pairs(spark, tmp_path):
    good = archive(tmp_path / "AAA.zip", message="36023.5,1,42,1,100,1\n36024,7,0,0,-1,-1\n", orderbook="10,1,9,2,9999999999,0,-9999999999,0,5\n11,3,8,4,12,1,7,1\n")
    archive(tmp_path / "BBB.zip", message="1,1,1,1,1,1\n", orderbook="1,1,1,1\n")
    listed = ingest.verified_archives(spark, str(tmp_path), {"AAA.zip": good, "BBB.zip": "0" * 64})
    assert [(r.path.split("/")[-1], r.ok) for r in listed.collect()] == [("AAA.zip", True), ("BBB.zip", False)]
    lines = ingest.csv_lines(listed.where("ok"), KINDS)
    paired = ingest.pair(ingest.messages(lines), ingest.snapshots(lines)).orderBy("line_no")
    a, b = paired.collect()
    assert (a.timestamp, len(a.asks), a.bids[1].price) == (36023.5, 2, -9999999999) and b.timestamp == 36024.0
    halts = paired.where(ingest.is_halt(F.col("event_type"), F.col("price"))).count()
    real = paired.select(F.size(ingest.real_levels(F.col("asks"))).alias("n")).collect()
    assert halts == 1 and [r.n for r in real] == [1, 2]
    assert ingest.counts(paired).first()[1:] == (2, 2)
    assert [r.skipped for r in listed.collect()] == [None, "BBB.zip differs from its listed sum"]
    assert ingest.verified_archives(spark, str(tmp_path), {"BBB.zip": "0"}).first().skipped == "AAA.zip is not listed"
    ingest.journals(paired, f"{tmp_path}/out", "crc32")
    assert (tmp_path / "out/AAA/counts.txt").read_text() == "messages: 2\norderbook: 2\n"
    back = flatbuf.decode(spark.read.format("framed").option("checksum", "crc32").load(f"{tmp_path}/out/AAA/orderbook"), flatbuf.ORDER_BOOK, keep=("frame_no",))
    assert [r.timestamp for r in back.orderBy("frame_no").collect()] == [36023.5, 36024.0]


def test_faults(spark, tmp_path):
    archive(tmp_path / "C.zip", message="1,1,1,1,1,1\n2,1,1,1,1,1\n", orderbook="1,1,1,1\n")
    archive(tmp_path / "D.zip", message="1,1,1\n")
    paths = lambda n: spark.createDataFrame([(f"{tmp_path}/{n}.zip",)], "path string")
    uneven = ingest.csv_lines(paths("C"), KINDS)
    with pytest.raises(Exception, match="LengthMismatch"):
        ingest.pair(ingest.messages(uneven), ingest.snapshots(uneven)).collect()
    assert [r.timestamp for r in ingest.pair_lenient(ingest.messages(uneven), ingest.snapshots(uneven)).collect()] == [1.0]
    short = ingest.csv_lines(paths("D"), KINDS)
    assert ingest.missing_pairs(short).count() == 1
    with pytest.raises(Exception, match="MissingPair: D has only message"):
        ingest.require_pairs(short).collect()
    with pytest.raises(Exception, match="too few fields"):
        ingest.messages(short).collect()
