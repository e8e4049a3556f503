"""Archives written and read back."""

import gzip
import hashlib

from pyspark.sql import functions as F

from marlstone.llm.common import new_path
from marlstone.llm.token_files import file_system
from marlstone.llm.warc import RecordStream, archived, member, record, register, response_block


def test_round_trip_and_pushdown(spark):
    long, other = "<p>é" * 400, "<b>" * 500
    rows = [(1, "http://a/1%\r\nX: y", long, "x"), (2, None, long, "x"), (7, "http://b", long, "x"), (3, "http://c", other, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"), (6, "u", None, "x"), (None, "n", long, "x")]
    folder = new_path(spark, "warc")
    archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), folder)
    back = {r.record_id: r for r in spark.read.format("warc").load(folder).collect()}
    assert len(back) == 8
    for k, url, html, _ in rows:
        r = back[f"<urn:x-page:{'null' if k is None else k}>"]
        raw = (html or "").encode()
        assert (r.target_uri, r.payload_bytes, r.payload_digest) == (url, len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == long and k != 7
        assert (r.record_type, r.refers_to) == (("revisit", "<urn:x-page:7>") if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    some = spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [(r.record_id, r.payload) for r in some.collect()] == [("<urn:x-page:1>", None)]
    assert spark.read.format("warc").option("bundle_bytes", "1").load(folder).filter(F.col("record_type").isin("response", "x")).count() == 5


def test_archives_of_others(spark, tmp_path):
    text = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>")], response_block(b"x" * 200_000)) + b""
    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>")], b"software: none\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(text) + member(info) + gzip.compress(text))
    register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert [(r.record_type, r.payload and len(r.payload)) for r in got] == [("warcinfo", None), ("response", 200_000), ("warcinfo", None), ("response", 200_000)]


def test_unwanted_payloads_are_not_inflated(tmp_path):
    path = tmp_path / "b.warc.gz"
    path.write_bytes(b"".join(member(record([("WARC-Type", "response")], response_block(bytes(range(256)) * 4000))) for _ in range(3)))
    system, root = file_system(f"file://{path}")
    with system.open_input_file(root) as stream:
        records, n = RecordStream(stream), 0
        while records.next_headers() is not None:
            n += 1
            assert len(records.whole) <= 1 << 16
    assert n == 3


def test_empty(spark):
    folder = new_path(spark, "warc")
    archived(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert spark.read.format("warc").load(folder).count() == 0
