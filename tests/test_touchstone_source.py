"""The data source of Touchstone files gives the rows of the plain reader, and opens only files that filters leave."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from lodestone.sources import touchstone, touchstone_source


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    for k in range(6):
        lines = "\n".join(f"{f} " + " ".join(f"{k + f / 10 + c} {c}" for c in range(4)) for f in range(1, 9))
        (tmp_path / ("deep" if k % 2 else ".") / f"n{k}.s2p").write_text(f"# GHZ MA R 50\n{lines}\n")
    (tmp_path / "notes.txt").write_text("no network")
    return tmp_path


def test_same_rows_as_the_plain_reader(spark, folder):
    plain = touchstone.read(spark, f"file://{folder}/*.s2p").union(touchstone.read(spark, f"file://{folder}/deep/*.s2p"))
    own = touchstone_source.read(spark, f"file://{folder}")
    for where in ("true", "network_id = 'n3'", "network_id IN ('n1', 'n4', 'zz') AND freq_hz >= 3e9 AND freq_hz < 6e9", "freq_hz = 2e9 AND i = j", "network_id = 'none'", "network_id LIKE '%2'"):
        assert sorted(map(tuple, own.where(where).collect())) == sorted(map(tuple, plain.where(where).collect()))


def test_filters_choose_files(spark, folder):
    for name in ("n0", "n2"):  # never opened by the query below
        (folder / f"{name}.s2p").write_text("# GHZ MA R 50\nbroken")
    own = touchstone_source.read(spark, f"file://{folder}").where("network_id IN ('n1', 'n4') AND freq_hz > 4e9")
    assert own.count() == 2 * 4 * 4
    reader = touchstone_source.Reader(f"file://{folder}")
    left = list(reader.pushFilters([EqualTo(("network_id",), "n1"), In(("network_id",), ("n1", "n4")), GreaterThanOrEqual(("freq_hz",), 1.0), LessThan(("re",), 2.0), StringContains(("network_id",), "n")]))
    assert [type(f) for f in left] == [LessThan, StringContains]
    assert [p.network for p in reader.partitions()] == ["n1"]


def test_files_that_cannot_be_parsed(spark, folder):
    (folder / "n0.s2p").write_text("# GHZ MA R 50\n1 2 3")
    with pytest.raises(Exception, match="incomplete data"):
        touchstone_source.read(spark, f"file://{folder}").count()
    assert touchstone_source.read(spark, f"file://{folder}", "skip").select("network_id").distinct().count() == 5
