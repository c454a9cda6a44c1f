import contextlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def rows(df):
    def cell(x):
        if x is None or x is pd.NaT:
            return "null"
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        try:
            return "null" if float(x) != float(x) else f"{float(x):.7g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_known_checksums(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.checksum import checksum

    row = spark.createDataFrame([(bytearray(b"123456789"),)], "p binary").select(*[checksum(F.col("p"), c).alias(c) for c in ("crc16", "crc32", "xxh3")]).first()
    assert [int(x) for x in row] == [0x31C3, 0xCBF43926, 0x72DCB18B67A17DFF]


def test_entry(spark):
    assert catalogue.flagship(spark, SF).count() > 0


@pytest.fixture
def many_parts(spark, tmp_path):
    """A copy of the small tables whose parts are read by several tasks."""
    con = duckdb.connect()
    for t in ("documents", "events", "customer"):
        (tmp_path / f"{t}.parquet").mkdir()
        for k in range(6):
            con.sql(f"copy (select * exclude place from (select *, row_number() over () as place from '{SF}/{t}.parquet') where place % 6 = {k}) to '{tmp_path}/{t}.parquet/{k}.parquet' (format parquet)")
    old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.openCostInBytes", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def check(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "events", "customer"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert rows(catalogue.queries()[name](spark, folder).toPandas()) == rows(con.sql(catalogue.oracle_sql()[name]).df())


def journals(folder, name):
    from tidemark.sources.files import listing

    (path,) = (p for key, p in catalogue._written.items() if key[1:3] == (folder, name))
    return listing(path)


def test_ranges_are_written_by_several_tasks(spark, many_parts):
    check(spark, many_parts, "scan_split_ranges")
    sizes = [n for _, n in journals(many_parts, "ranges")]
    assert len(sizes) == 6 and max(sizes) < sum(sizes) / 2


@pytest.mark.parametrize(("name", "made"), [("first_match", "ordered"), ("frame_layout", "layout")])
def test_order_goes_over_several_journals(spark, many_parts, name, made):
    if name == "first_match":  # the first match lies beyond the first journals
        con = duckdb.connect()
        con.sql(f"copy (select * replace (if(event_id < 700, 1.0, value) as value) from '{many_parts}/events.parquet/*.parquet') to '{many_parts}/new.parquet' (format parquet)")
        for k in range(6):
            con.sql(f"copy (select * from '{many_parts}/new.parquet' where event_id % 6 = {5 - k}) to '{many_parts}/events.parquet/{k}.parquet' (format parquet)")
    check(spark, many_parts, name)
    sizes = [n for _, n in journals(many_parts, made)]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2


def workers_peak(spark, run):
    """What ``run`` gives, and the most memory in MB that one of Spark's Python processes had meanwhile."""
    jvm, most = spark.sparkContext._jvm, 0
    pids = lambda: [p.pid() for p in jvm.java.lang.ProcessHandle.current().descendants().toArray()]
    for p in pids():
        with contextlib.suppress(OSError):  # it has ended
            Path(f"/proc/{p}/clear_refs").write_text("5")  # from here on
    got = run()
    for p in pids():
        with contextlib.suppress(OSError):
            most = max([most, *(int(line.split()[1]) >> 10 for line in Path(f"/proc/{p}/status").read_text().splitlines() if line.startswith("VmHWM"))])
    return got, most


def test_bound_by_length_holds_no_more_of_a_longer_table(spark, tmp_path):
    peaks = []
    for n in (500, 10_000):
        folder = tmp_path / str(n)
        folder.mkdir()
        con = duckdb.connect()
        con.sql(f"copy (select range as doc_id, if(range % 9 = 0, null, repeat('text ', (range % 1200)::int)) as text from range({n})) to '{folder}/documents.parquet' (format parquet)")
        con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
        got, most = workers_peak(spark, lambda: catalogue.queries()["bound_by_length"](spark, str(folder)).toPandas())  # noqa: B023
        assert rows(got) == rows(con.sql(catalogue.oracle_sql()["bound_by_length"]).df())
        peaks.append(most)
    assert 0 < peaks[1] < peaks[0] + 100
