import base64
import gzip
import hashlib

import pytest

from logweir.llm import warc
from logweir.session import scratch

SCHEMA = "page_id long, url string, html string, id string, payload string, digest string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_both_arc_versions_by_their_own_layout():
    docs = [(warc.arc_url("http://a b/c#d", 7), b"HTTP/1.1 200 OK\r\n\r\nx\n\nhttp://fake 0.0.0.0 1 t 3\n"), (warc.arc_url(None, None), b"")]
    for version in (1, 2):
        read = list(warc.arc_records(warc.arc_archive(version, "1997", docs)))
        assert [b for _, b in read] == [b for _, b in docs]
        assert [f["URL"] for f, _ in read] == ["http://a%20b/c%23d#7", "urn:none#"]
        assert ("Result-code" in read[0][0]) == (version == 2)
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert warc.warc_date("19970203040506") == "1997-02-03T04:05:06Z"


def test_a_cut_archive_is_an_error():
    archive = warc.arc_archive(1, "1997", [(b"u#1", b"0123456789")])
    with pytest.raises(ValueError):
        list(warc.arc_records(archive[:-5]))


def test_reader_takes_members_and_lengths():
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 20_000]
    records = [warc.warc_record([("WARC-Type", "response")], b) + b"\r\n\r\n" for b in bodies]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [b for _, b in warc.warc_records(packed)] == bodies
    with pytest.raises(ValueError):
        list(warc.warc_records(gzip.compress(records[2][:-100])))


def test_odd_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    rows = [
        (1, "http://x/1", None), (2, None, ""), (3, "http://x/3 \n y#z", "same\r\n\r\nWARC/1.1"),
        (4, "http://x/4", "same\r\n\r\nWARC/1.1"), (5, "http://x/5", "é漢" * 50_000), (6, "u", "once"),
        (6, "u", "once"), (None, "u", "same\r\n\r\nWARC/1.1"), (None, "u", "alone"),
    ]
    df = spark.createDataFrame([(*r, "i", "p", "d") for r in rows], SCHEMA).repartition(2)
    out = warc.round_trip(df).collect()
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        first = last[html or ""]
        response = i == first or first == -1
        want.append((i, len((html or "").encode()), sha(html), "response" if response else "revisit", None if response else first))
    got = [(r.row_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.intact for r in out)
    html = {i: h for i, _, h in rows}
    assert all(r.payload.decode() == (html[r.row_key] or "") for r in out if r.record_type == "response" and r.row_key)
    assert len({r.record_id for r in out}) == len(out) - 1  # equal rows have equal identifiers
    assert warc.round_trip(df.where("page_id > 99")).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch(spark)
    warc.write_warc(warc.arc_archives(df), path, least=3)
    kinds = {r.row_key: (r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
