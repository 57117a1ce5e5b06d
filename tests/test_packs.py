"""Packs are written as blocks of lines and read in splits."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.sources import pack

NOTE = "id string, title string, type string, tags array<string>, body string, value int, verified boolean, summary string, author string, compacts array<string>, custom string, created timestamp, updated timestamp, sources array<struct<url:string,title:string,accessed:string>>"
EDGE = "src string, dst string, link_type string, inline boolean"


def notes(spark):
    rows = [(f"qp-{i:02d}", f'Title "{i}" of\nit', "fleeting", ["a", "b"][: i % 3], "line\n" * i + "é END\nN qp-99 x", i, bool(i % 2), None if i % 3 else f"Sum of {i}", "A. N. Other" if i % 4 == 0 else None, ["qp-01", "qp-02"] if i == 7 else [], json.dumps({"k": i, "s": "x y=z"}) if i % 5 == 0 else None, None, None, [("https://x.example/?a=1", "The title=x of it", "2024-01-15"), ("https://y.example", None, None)] if i % 6 == 0 else []) for i in range(40)]
    rows.append(("qp-98", None, "moc", None, None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, NOTE).withColumn("created", F.when(F.col("value") > 3, F.make_timestamp(F.lit(2024), F.lit(1), F.col("value") % 28 + 1, F.lit(3), F.lit(4), F.lit(5))))


@pytest.mark.parametrize("split", ["64", "300", "1m"])
def test_round_trip_in_splits(spark, tmp_path, split):
    want, edges = notes(spark), spark.createDataFrame([(f"qp-{i:02d}", "qp-01", ["supports", None][i % 2], i % 3 == 0) for i in range(2, 40)], EDGE)
    files = spark.createDataFrame([("attachments/a.png", "a.png", "image/png", bytearray(range(256)) * 40), ("attachments/b", "b", None, bytearray(b""))], "path string, name string, content_type string, data binary")
    pack.write_all(want, edges, str(tmp_path / "p"), "here", files, "[store]\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = pack.read_lines(spark, str(tmp_path / "p"))
        got = {r["id"]: r for r in pack.whole_notes(lines).collect()}
        links = sorted(map(tuple, pack.read_links(lines).select("src", "dst", "link_type", "inline").collect()), key=repr)
        data = {r["path"]: (r["content_type"], bytes(r["data"])) for r in pack.attachments(lines).collect()}
        faults = pack.faults(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 41 and not faults
    for r in want.collect():
        x = got[r["id"]]
        assert x["title"] == (r["title"] or "").replace("\n", " ") and x["body"] == (r["body"] or "") and x["tags"] == (r["tags"] or [])
        assert all(x[c] == r[c] for c in ("type", "value", "verified", "summary", "author", "custom", "created")) and x["compacts"] == (r["compacts"] or [])
        assert sorted(map(repr, map(tuple, x["sources"] or []))) == sorted(map(repr, map(tuple, r["sources"] or [])))
    assert links == sorted(map(tuple, edges.collect()), key=repr)
    assert data == {"attachments/a.png": ("image/png", bytes(range(256)) * 40), "attachments/b": (None, b"")}


def test_a_pack_that_was_cut_off_is_told(spark, tmp_path):
    (tmp_path / "x.pack").write_text('H pack=1 version=1.0 store=s notes=2 links=0 attachments=0 config=0\nN qp-1 fleeting "A" tags=- created=- updated=-\nC Ym9keQ==\nC-END\n')
    lines = pack.read_lines(spark, str(tmp_path / "x.pack"))
    assert {tuple(r) for r in pack.faults(lines).collect()} == {("notes", 2, 1), ("end", 1, 0)}
    assert pack.whole_notes(lines).first()["body"] == "body"


def test_no_notes(spark, tmp_path):
    pack.write_all(notes(spark).limit(0), spark.createDataFrame([], EDGE), str(tmp_path / "p"))
    lines = pack.read_lines(spark, str(tmp_path / "p"))
    assert pack.whole_notes(lines).count() == 0 and pack.faults(lines).count() == 0
