"""Combined results, summary lines, orders and scratch tables."""

import json
import os

from pyspark.sql import functions as F

from paperloom import session
from paperloom.operators import images as im, lines as ln, tables as tb
from paperloom.sinks import files


def test_combined_json_is_nested(spark):
    rows = [("b", "d1", "x", '{"n":1}'), ("b", "d2", "x", '{"n":2}'), ("b", "d3", 'a "q" \\ ä', '{"m":{"k":[1]}}'), ("b", "d4", "none", None), ("c", "d5", "y", "{}")]
    got = {r.batch: json.loads(r.json) for r in files.combined_json(spark.createDataFrame(rows, "batch string, doc_id string, stem string, structured string"), "batch").collect()}
    assert got == {"b": {"batch": True, "files": {"x": {"n": 2}, 'a "q" \\ ä': {"m": {"k": [1]}}, "none": None}}, "c": {"batch": True, "files": {"y": {}}}}


def test_summary_line(spark):
    d = spark.createDataFrame([((5, 2, 3, 9),)], "stats struct<total_sections:int,headings:int,paragraphs:int,tables:int>")
    assert d.select(files.summary_line(F.col("stats"))).first()[0] == "Total Sections: 5 · Headings: 2 · Paragraphs: 3"


def test_scratch_tables_go(spark):
    before = len(session._written)
    with session.scratch():
        df = session.materialise(spark.range(3))
        path = session._written[-1][1].removeprefix("file://")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path) and len(session._written) == before


def test_reading_order(spark):
    b = lambda y: None if y is None else {"x0": 0.0, "y0": y, "x1": 1.0, "y1": y and y + 1}
    t = spark.createDataFrame([("d", 1, 0, b(50.0)), ("d", 1, 1, b(10.0)), ("d", 1, 2, None), ("d", 0, 3, b(90.0)), ("e", 0, 0, b(None))], "doc_id string, page int, table_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted((r.doc_id, r.place, r.table_no) for r in tb.in_reading_order(t).collect()) == [("d", 1, 3), ("d", 2, 2), ("d", 3, 1), ("d", 4, 0), ("e", 1, 0)]
    assert sorted((r.page, r.a.table_no, r.b.table_no) for r in tb.page_pairs(t).collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 2)]


def test_image_names(spark):
    rows = [("d", 1, 2, "page 2", "png"), ("d", 3, None, "word/media/a.emf", None), ("d", 1, 1, "source_image.jpg", "jpg")]
    x = spark.createDataFrame(rows, "doc_id string, idx int, page int, source string, extension string")
    assert sorted(r.filename for r in im.named(x).collect()) == ["image_003.png", "page002_img001.png", "source_image.jpg"]


def test_tagged_lines(spark):
    text = ["12", "A head", "Body of it", "Body of it", "", "A head", "12", "# kept", "# kept", "Sample", "x", "Sample 2", "x", "Contents .... 4"]
    d = spark.createDataFrame([("d", i, t, "clash") for i, t in enumerate(text)] + [("e", 0, "", "clash")], "doc_id string, line_no int, line string, _n string")
    got = [r.reason for r in ln.tagged(d).where("doc_id = 'd'").orderBy("line_no").collect()]
    assert got == ["page_number", "repeated", "repeated", "repeated", None, "repeated", "page_number", None, None, "artifact", "repeated", "artifact", "repeated", "leader_dots"]
    runs = spark.createDataFrame([("d", 0, "a b"), ("d", 1, "Draft"), ("d", 2, " a b"), ("d", 3, "a b ")], "doc_id string, line_no int, line string")
    assert [r.reason for r in ln.tagged(runs).orderBy("line_no").collect()] == [None, "artifact", "run", "run"]
