import gzip
import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lattica.llm import warc


def test_archives(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/3\r\nX: y", big), (2, None, "short"), (4, "http://a/4", "short"), (6, "u", None), (7, "u", other), (7, "u", other), (None, "n", big), (8, "u", "WARC/1.1\r\n\r\n<x>\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    index = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w", file_bytes=500)
    assert index.select("path").distinct().count() > 1
    got = sorted((tuple(r) for r in warc.read_records(index).drop("url").collect()), key=repr)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, html in rows:
        size = len((html or "").encode())
        keeper = max((x[0] for x in rows if x[2] == html and x[0] is not None), default=None) if size >= 1000 else i
        again = size >= 1000 and i != keeper
        want.append((i, size, digest(html), "revisit" if again else "response", keeper if again else None))
    assert got == sorted(want, key=repr)
    one = warc.read_records(index.filter("page_id = 8"), with_payload=True).collect()
    assert [r["payload"] for r in one] == ["WARC/1.1\r\n\r\n<x>\r\n\r\n"]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type") == len(rows) == len(set(re.findall(rb"WARC-Record-ID: \S+", raw)))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(none, f"file://{tmp_path}/e")).count() == 0


def test_selected_records_come_by_coalesced_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(rng.choice([0, 30, 5000])))) for i in range(300)] + [(400, "long", "".join(map(chr, range(0x4E00, 0x9000))) * 90)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert len(rows[-1][2].encode()) > warc.RUN and index.count() == len(rows)
    some = warc.read_records(index.filter("page_id % 7 = 1 or page_id = 400"), with_payload=True).collect()
    assert {(r["page_id"], r["url"], r["payload"]) for r in some} == {r for r in rows if r[0] % 7 == 1 or r[0] == 400}


def test_many_repeats_are_joined_without_a_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, "u", str(i // 3) * 1200) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = {r["page_id"]: r["refers_to"] for r in warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/a")).collect()}
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    large = {r["page_id"]: r["refers_to"] for r in warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/b")).collect()}
    assert small == large == {i: None if i % 3 == 2 else i // 3 * 3 + 2 for i in range(30)}


def test_files_that_the_index_does_not_name_do_not_count(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    (tmp_path / "w" / f"{uuid.uuid4().hex}.warc.gz").write_bytes(b"half a record of a lost attempt")
    assert [r["payload_bytes"] for r in warc.read_records(index).collect()] == [2000]


def test_damaged_archives_fail(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    file = next((tmp_path / "w").glob("*.warc.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"xx", b"xy", 1), 1, mtime=0))
    with pytest.raises(Exception, match="damaged|Error"):
        warc.read_records(index.withColumn("length", F.lit(file.stat().st_size).cast("long"))).collect()


def test_the_query_on_whole_tables(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i % 40} " * 200) for i in range(120)] + [(200, None, None)]
    spark.createDataFrame([(*r, "extra", 1.5) for r in rows], "page_id long, url string, html string, path string, length double").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op4_warc(spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        r, body = got[i], (html or "").encode()
        keeper = 80 + i % 40 if i < 80 else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(body), hashlib.sha1(body).hexdigest(), keeper, "response" if keeper is None else "revisit")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op4_warc(spark, f"{tmp_path}/none").collect() == []
