import gzip
import hashlib
import io

import pytest

from lodestrata.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, id long, payload string"


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    return sorted(warc.round_trip(df).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, r.record_type))


def test_round_trip_and_revisits(spark):
    long, short = "p" * 1200 + "\u00e9", "s" * 999
    pages = [(1, "http://a/\r\nx y", long), (2, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (None, "u", long), (6, "u", "WARC/1.1\r\n\r\n" * 200)]
    found = rows_of(spark, pages)
    by = {r.page_id: r for r in found}
    assert len(found) == len(pages)
    for page_id, _, html in pages:
        payload = (html or "").encode()
        assert by[page_id].payload_bytes == len(payload)
        assert by[page_id].payload_digest == hashlib.sha1(payload).hexdigest()
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, None)] == [
        ("revisit", 2), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None), ("revisit", 2)]


def test_repeated_rows_are_all_responses(spark):
    assert [r.record_type for r in rows_of(spark, [(1, "u", "y" * 1000)] * 2)] == ["response"] * 2


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_normalise_rewrites_each_record_as_a_member():
    records = [warc.record(i, "u", b"<p>%d</p>" % i * 400_000 if i == 1 else b"x", "d", None) for i in range(3)]
    sink, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), sink, index) == 3
    data = sink.getvalue()
    for line, whole in zip(index.getvalue().splitlines(), records):
        offset, length = map(int, line.split(b"\t")[:2])
        assert gzip.decompress(data[offset : offset + length]) == whole


def test_a_truncated_archive_is_an_error():
    data = gzip.compress(warc.record(1, "u", b"x" * 100_000, "d", None))
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(data[:-20]), io.BytesIO(), io.BytesIO())
