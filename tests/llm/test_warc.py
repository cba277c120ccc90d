import base64
import hashlib
import struct

import pytest
import zstandard

from graphloom.llm import warc as W
from graphloom.session import shared_path


def page(i, body):
    return W.page_record(i, f"http://h/{i}", body, None, "2024-01-01T00:00:00Z")


def test_round_trip_as_brute_force(spark):
    bodies = {5: "a", 3: "b", 9: "a", 1: None, 7: "", 2: "ü" * 5000, 4: "a"}
    df = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\r\nEvil: 1", b, 1) for i, b in bodies.items()], "page_id long, url string, html string, payload int")
    first = {}
    for i in sorted(bodies):
        first.setdefault(bodies[i] or "", i)
    want = {i: (len((b or "").encode()), base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode(), "response" if first[b or ""] == i else "revisit", None if first[b or ""] == i else first[b or ""]) for i, b in bodies.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.round_trip(df).collect()} == want
    small = {r.page_id: r.record_type for r in W.round_trip(df, min_payload=1).collect()}
    assert small[7] == "response" and small[9] == "revisit"


def test_payloads_many_files_and_dictionary(spark):
    df = spark.range(500).selectExpr("id AS page_id", "concat('u', id) AS url", "concat(repeat(concat('<p>', id % 7, '</p>'), 30), id) AS html")
    folder = shared_path(spark, "warc")
    archives = W.write_archives(df.repartition(3), folder, roll_bytes=60_000).collect()
    assert len(archives) > 3 and sum(a.records for a in archives) == 500
    got = {r.page_id: bytes(r.payload).decode() for r in W.read_archives(spark, folder).collect()}
    assert got == {r.page_id: r.html for r in df.collect()}


def test_empty_table_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (1, "u", "x"), (None, "u", "y")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in W.round_trip(df).collect())
    assert got == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
    assert W.round_trip(df.limit(0)).count() == 0


def test_frames_one_by_one():
    records = [page(i, b"<html>" + bytes([97 + i % 26]) * (i * 50)) for i in range(40)]
    data = W.archive(records)
    assert struct.unpack_from("<I", data)[0] == W.DICTIONARY_FRAME
    assert list(W.read_frames(data)) == records
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.compress(data[8 : 8 + size])
    assert list(W.read_frames(struct.pack("<II", W.DICTIONARY_FRAME, len(packed)) + packed + data[8 + size :])) == records
    assert list(W.read_frames(b"".join(map(zstandard.compress, records)))) == records
    for bad in (data[:-1], data[:6], data + b"xxxxxxxxx", data[: 8 + size // 2]):
        with pytest.raises(W.BadRecord):
            list(W.read_frames(bad))


@pytest.mark.parametrize("n", [1, 2, 15, 16])
def test_every_archive_has_a_dictionary(n):
    records = [page(i, b"") for i in range(n)]
    data = W.archive(records)
    assert struct.unpack_from("<I", data)[0] == W.DICTIONARY_FRAME and struct.unpack_from("<I", data, 4)[0] > 0
    assert list(W.read_frames(data)) == records


def test_a_file_that_a_lost_task_left_is_replaced(spark):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    folder = shared_path(spark, "warc")
    names = [r.archive for r in W.write_archives(df, folder).collect()]
    assert [r.archive for r in W.write_archives(df, folder).collect()] == names
    assert W.read_archives(spark, folder).count() == 1


def test_a_record_above_the_limit_is_refused():
    with pytest.raises(W.BadRecord):
        list(W.read_frames(W.archive([page(1, b"x" * 5000)]), most=1000))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9"), (b"WARC-Type: response\r\n", b""), (b"WARC-Date", b"WARC Date"), (b"Content-Length: ", b"Content-Length: 9"), (b"<html>", b"<HTML>"), (b"Content-Length: ", b"Content-Length: x"), (b"WARC-Record-ID: <", b"<"), (b"WARC-Date: ", b"WARC-Date: \xff"), (b"WARC-Date", b"WARC-D\xe9te")],
)
def test_broken_records_are_refused(old, new):
    good = page(1, b"<html>x</html>")
    assert W._page(good)[3] == b"<html>x</html>"
    with pytest.raises(W.BadRecord):
        W._page(good.replace(old, new, 1))
