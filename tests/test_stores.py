"""Stores: all of a job or nothing, written once; row groups chosen by a zone map."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import buckets, contents, zones
from lodestone.sources.snapshots import row_groups
from lodestone.sources.stores import opened_store


def files(root):
    return sorted(os.path.basename(f) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f) and not f.endswith(".crc"))


def test_contents_are_written_once_and_read_by_digest(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"text {i % 50}".encode(),) for i in range(200)] + [(b"",), (None,), (b"\x00" * 3_000_000,)]
    frame = spark.createDataFrame(rows, "content binary").repartition(5)
    contents.put(frame, root)
    want = sorted({hashlib.sha256(r[0]).hexdigest() for r in rows if r[0] is not None})
    assert files(tmp_path) == want
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/objects/*/*/*")}
    contents.put(spark.createDataFrame([(b"text 7",), (b"new",)], "content binary"), root)
    assert len(files(tmp_path)) == len(want) + 1
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    assert all(r.intact for r in contents.read(spark, root).collect())
    one = contents.read(spark, root, hashlib.sha256(b"new").hexdigest()).collect()
    assert [(bytes(r.content), r.intact) for r in one] == [(b"new", True)]
    assert contents.read(spark, root, "0" * 64).count() == 0


def test_a_failing_task_leaves_no_object(spark, tmp_path):
    spark.dataSource.register(contents.Contents)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), str(i).encode()) for i in range(100)] + [("f" * 64, b"not that")]
    frame = spark.createDataFrame(rows, "digest string, content binary").repartitionByRange(4, "digest").sortWithinPartitions("digest")
    with pytest.raises(Exception, match="not that of digest"):
        frame.write.format(contents.FORMAT).mode("append").save(f"file://{tmp_path}")
    assert not os.path.exists(tmp_path / "objects")
    spark.sparkContext.cancelAllJobs()
    contents.sweep(f"file://{tmp_path}")  # Spark tells a job's tasks to end, and doesn't wait until they have
    assert files(tmp_path) == []


def test_a_damaged_content_is_told(spark, tmp_path):
    contents.put(spark.createDataFrame([(b"a",), (b"b",)], "content binary"), f"file://{tmp_path}")
    path = glob.glob(f"{tmp_path}/objects/*/*/{hashlib.sha256(b'a').hexdigest()}")[0]
    for crc in glob.glob(f"{os.path.dirname(path)}/.*.crc"):
        os.remove(crc)
    with open(path, "wb") as file:
        file.write(b"c")
    assert sorted(r.intact for r in contents.read(spark, f"file://{tmp_path}").collect()) == [False, True]


def test_names_of_stores():
    for name in ("/tmp/x", "file:/tmp/x", "file:///tmp/x"):
        assert opened_store(name)[1] == "/tmp/x"


@pytest.mark.parametrize("conditions", [[("k", ">=", 900), ("k", "<", 905)], [("t", "in", ["t0003", "t0999"])], [("x", "<=", 1.5)], [("x", "null", None)], [("k", "==", -5)], [("k", ">", 2.5), ("t", "<", "t0010")], []])
def test_only_row_groups_that_may_match_are_read(spark, tmp_path, conditions):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.mkdir(tmp_path / "d")
    for part in range(2):
        ids = range(part * 500, part * 500 + 500)
        pq.write_table(pa.table({"k": list(ids), "t": [f"t{i:04}" for i in ids], "x": [None if i // 50 == 3 else i / 2 for i in ids]}), tmp_path / "d" / f"{part}.parquet", row_group_size=50)
    path = f"file://{tmp_path}/d"
    zone = zones.zone_map(spark, path).cache()
    plain = spark.read.parquet(path)
    for c, op, v in conditions:
        plain = plain.where(zones._OPS[op](F.col(c), v))
    want = sorted(map(tuple, plain.select("k", "t").collect()))
    assert sorted(map(tuple, zones.read_where(zone, path, ["k", "t"], conditions).collect())) == want
    groups = {(f"{i // 500}", i % 500 // 50) for i, _ in want}
    assert zones.choose(zone, conditions).count() == (len(groups) if conditions else row_groups(spark, path).count())


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b long")


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    buckets.create(keyed(spark, [(i, f"a{i}", i) for i in range(1000)] + [(None, "none", 0)]), root, ["k"], 32)
    first = buckets._state(root, 1)["of"]
    new = [(5, "x", 1), (5, "z", 1), (5, "y", 9), (2000, "n", 1), (None, "null", 1)]
    assert buckets.upsert(keyed(spark, new), root) == 2
    second = buckets._state(root, 2)["of"]
    touched = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(touched) <= 3
    got = {r.k: (r.a, r.b) for r in buckets.read(spark, root).collect()}
    assert got == {i: (f"a{i}", i) for i in range(1000)} | {5: ("z", 1), 2000: ("n", 1), None: ("null", 1)}
    assert buckets.read(spark, root, 1).count() == 1001
    assert [r.a for r in buckets.lookup(spark, root, keyed(spark, [(2000, "", 0), (9999, "", 0)])).collect()] == ["n"]
    assert buckets.delete(keyed(spark, [(7, "", 0), (8888, "", 0)]), root) == 3
    assert buckets.read(spark, root).where("k = 7").count() == 0
    assert buckets.read(spark, root).count() == 1001
    buckets.vacuum(root)
    assert buckets.read(spark, root).count() == 1001
    buckets.delete(buckets.read(spark, root), root)
    assert buckets.read(spark, root).count() == 0


def test_a_failed_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    buckets.create(keyed(spark, [(i, "a", i) for i in range(50)]), root, ["k"], 4)
    bad = keyed(spark, [(1, "b", 1)]).withColumn("a", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        buckets.upsert(bad, root)
    assert buckets.version(root) == 1
    put = buckets._put
    monkeypatch.setattr(buckets, "_put", lambda r, name, text: put(r, name, text) if name != "current" else (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        buckets.upsert(keyed(spark, [(1, "b", 1)]), root)
    assert buckets.read(spark, root).where("a = 'b'").count() == 0
    monkeypatch.setattr(buckets, "_put", put)
    monkeypatch.setattr(buckets, "version", lambda r, seen=iter([1, 1, 1, 2]): next(seen))
    with pytest.raises(buckets.Conflict):
        buckets.upsert(keyed(spark, [(1, "b", 1)]), root)


def test_names_of_contents_stay_in_tasks(spark, tmp_path):
    """No listing of files on the driver, and no digests sent there for a broadcast."""
    root = f"file://{tmp_path}"
    contents.put(spark.range(300).select(F.col("id").cast("string").alias("content")), root)
    for own in (contents.stored(spark, root), contents.read(spark, root)):
        assert own.count() == 300 and own.inputFiles() == []
    fresh = contents.documents.put(spark.range(9).selectExpr("sha2(cast(id AS string), 256) AS digest"), contents.stored(spark, root).hint("merge"))
    assert "Broadcast" not in fresh._jdf.queryExecution().toString() and fresh.count() == 0


def test_sorted_lines_get_more_files_as_they_grow(spark, monkeypatch):
    from lodestone.plans import store_queries

    monkeypatch.setattr(store_queries, "LINES", 500)
    path = store_queries._sorted_lines(spark, "/root/testdata/sf0.001")
    assert len([f for f in os.listdir(path.removeprefix("file:").replace("///", "/")) if f.endswith(".parquet")]) > 8
