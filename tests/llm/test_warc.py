import gzip
import hashlib
import io

import pytest
from compare import assert_same

from quaylight.llm import queries, warc


def archive(spark, tmp_path, rows):
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    return path


def test_op4_against_sql(spark, tiny):
    assert_same(warc.op4(spark, tiny), queries.ORACLES["op4_warc"], tiny)


def test_round_trip_and_revisits(spark, tmp_path):
    body = "é\r\n\r\nWARC/1.1\r\n" + "x" * 100
    rows = [(3, "u", body), (1, None, body), (2, "a\r\nb", None), (5, "u", ""), (None, "u", body), (7, "u", "short"), (8, "u", "short"), (1, "v", body)]
    path = archive(spark, tmp_path, rows)
    got = warc.read_warc(spark, path, "bytes").collect()
    assert len(got) == len(rows)
    own = [r for r in got if r.record_type == "response" and r.payload]
    assert sorted(bytes(r.payload).decode() for r in own) == sorted([body, body, "short", "short"])
    assert {r.record_id: r.refers_to for r in got if r.record_type == "revisit"} == {"<urn:page:3>": "<urn:page:1>", "<urn:page:null>": "<urn:page:1>"}


def test_filters_are_pushed_and_payloads_passed_over(spark, tmp_path):
    path = archive(spark, tmp_path, [(i, "u", "p" * 200 if i < 3 else str(i)) for i in range(6)])
    df = warc.read_warc(spark, path, "none")
    assert all(r.payload_bytes is None for r in df.collect())
    assert df.where("record_type = 'revisit'").count() == 2
    assert df.where("record_id IN ('<urn:page:5>', '<urn:page:1>') AND length > 0").count() == 1
    reader = warc.WarcReader(df.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("length",), 1)])) == [GreaterThan(("length",), 1)]


def test_gzip_members_and_truncation():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    raw = io.BytesIO(b"".join(gzip.compress(record) for _ in range(3)))
    assert [p for _, p in warc.records(warc.Payload(raw), lambda h: True)] == [b"hello"] * 3
    raw = io.BytesIO(record + record)
    assert [p for _, p in warc.records(warc.Payload(raw), lambda h: False)] == [None] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(warc.Payload(io.BytesIO(record[:-7])), lambda h: True))


def test_no_pages(spark, tmp_path):
    path = archive(spark, tmp_path, [])
    assert warc.read_warc(spark, path).count() == 0


def test_op4_where_a_page_id_repeats(spark, tmp_path):
    a, b = "A" * 200, "B" * 200
    rows = [(5, "u", a), (5, "u", b), (7, "u", a), (9, "v", b), (9, "v", b), (3, "u", "x"), (4, "u", "x"), (None, None, a), (6, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4(spark, str(tmp_path)).collect()), key=str)
    want = [(5, 200, sha(a), "response", None), (5, 200, sha(b), "response", None), (7, 200, sha(a), "revisit", 5), (9, 200, sha(b), "revisit", 5), (9, 200, sha(b), "revisit", 5)]
    want += [(3, 1, sha("x"), "response", None), (4, 1, sha("x"), "response", None), (None, 200, sha(a), "revisit", 5), (6, 0, sha(""), "response", None)]
    assert got == sorted(want, key=str)
