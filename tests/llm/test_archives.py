"""Operator 8: exact round trips, damage, and the choice of revisits."""

import hashlib
import random

import pytest

from lodestone.llm import archives

SCHEMA = "page_id long, url string, html string, records int"


def test_round_trip_and_revisits(spark):
    big, small = "é" * 60 + "<p>\r\n\r\n</p>\n", "x" * 99
    rows = [(5, "http://a b/", big, 1), (3, "http://c/", big, 1), (9, None, small, 1), (8, "http://d\n/", small, 1), (7, "http://e/", None, 1), (6, "http://f/", "", 1), (None, "http://g/", big, 1)]
    got = {r.page_id: tuple(r)[1:] for r in archives.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {k: (len((h or "").encode()), digest(h), "response", None) for k, _, h, _ in rows}
    want[5] = (*want[5][:2], "revisit", 3)
    assert got == want
    assert archives.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_keys_are_separate_records(spark):
    a, b, c = (x * 200 for x in "abc")
    for rows, want in (
        ([(1, a), (5, a), (5, c)], [(1, a, None), (5, a, 1), (5, c, None)]),
        ([(1, a), (2, b), (5, a), (5, b), (5, b)], [(1, a, None), (2, b, None), (5, a, 1), (5, b, 2), (5, b, 2)]),
    ):
        got = archives.round_trip(spark.createDataFrame([(k, "http://a/", h, 1) for k, h in rows], SCHEMA)).collect()
        kind = {True: "response", False: "revisit"}
        assert sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted((k, hashlib.sha256(h.encode()).hexdigest(), kind[to is None], to or 0) for k, h, to in want)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_damage(version):
    records = [("http://a b/c", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n1"), ("http://x/", "text/plain", b"")]
    data = archives.arc_file("one.arc", version, records)
    got = list(archives.parse_arc(data))
    assert [(f["URL"], f["Content-type"], b) for f, b in got] == records
    fields, body = got[0]
    ((head, block),) = archives.parse_warc(archives.warc_record(fields, body, "1", None))
    assert head["WARC-Date"] == "2024-01-01T00:00:00Z" and block == body and head["WARC-Type"] == "response"
    for broken in (data[:-1], data[5:], data.replace(b"body", b"bodyy")):
        if broken != data and not (broken == data[:-1] and not records[-1][2]):
            with pytest.raises(ValueError):
                list(archives.parse_arc(broken))


def test_random_pages_with_repeated_keys(spark, monkeypatch):
    """Against a plain version, with archives of both versions and both ways of reading them."""
    rnd = random.Random(4)
    monkeypatch.setattr(archives, "FILE_BYTES", 2000)
    texts = ["x" * 99, "y" * 100, "é" * 50, "", None, "<p>" * 70, "q" * 300]
    rows = [(rnd.choice([None, *range(25)]), "http://a/", rnd.choice(texts), 1) for _ in range(300)]
    payload = lambda h: (h or "").encode()
    first = {}
    for k, _, h, _ in rows:
        if k is not None and len(payload(h)) >= 100:
            first[payload(h)] = min(k, first.get(payload(h), k))
    want = sorted(((k, len(payload(h)), hashlib.sha256(payload(h)).hexdigest(), *(("revisit", first[payload(h)]) if k is not None and first.get(payload(h), k) != k else ("response", None))) for k, _, h, _ in rows), key=repr)
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, archives.round_trip(pages).collect()), key=repr) == want
    folder = archives.new_folder(spark, "warc")
    names = [r.file for r in archives.write(pages, folder).collect()]
    assert {int(n.split("/")[1].split("-")[0], 16) % 2 for n in names} == {0, 1}
    assert sorted(map(tuple, archives.read_back(spark, folder).collect()), key=repr) == want


def test_files_are_bounded_whatever_pages_hold(spark, monkeypatch):
    monkeypatch.setattr(archives, "FILE_RECORDS", 1000)
    pages = spark.createDataFrame([(i, None, None, 1) for i in range(4500)], SCHEMA).coalesce(1)
    folder = archives.new_folder(spark, "warc")
    assert sorted(r.records for r in archives.write(pages, folder).collect()) == [500, 1000, 1000, 1000, 1000]
    assert archives.read_back(spark, folder).count() == 4500


def test_members_are_read_in_linear_time():
    """Ten times the members take about ten times as long, not a hundred times."""
    import time

    one = archives._packed(b"x" * 300)

    def took(n):
        data = one * n
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            assert sum(1 for _ in archives.members(data)) == n
            best = min(best, time.process_time() - began)
        return best

    assert took(48_000) < 30 * took(4_800)
    with pytest.raises(ValueError, match="cut off"):
        list(archives.members(one[:-4]))


def test_identifiers_digests_and_damaged_heads(spark):
    fields = {"URL": "http://a/", "Archive-date": "20240101000000", "IP-address": "0.0.0.0"}
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    ((first, _),) = archives.parse_warc(archives.warc_record(fields, body, "1", None))
    again = archives.warc_record(fields | {"URL": "http://b/"}, body, "2", "1", "http://a/")
    ((second, _),) = archives.parse_warc(again)
    assert second["WARC-Refers-To"] == first["WARC-Record-ID"] != second["WARC-Record-ID"]
    assert second["WARC-Refers-To-Target-URI"] == "http://a/"
    assert first["WARC-Payload-Digest"] == second["WARC-Payload-Digest"]
    damaged = archives.warc_record(fields, body, "1", None).replace(b"200 OK", b"404 NO")
    with pytest.raises(ValueError, match="block's digest"):
        archives._records(archives._packed(damaged))
    assert archives._records(archives._packed(archives.warcinfo_record("a.warc.gz"))).num_rows == 0
