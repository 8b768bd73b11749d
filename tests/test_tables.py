"""Table operators on small cases, nulls, empty and ragged tables among them."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import tables as tb

SCHEMA = "doc_id string, page int, table_no int, headers array<string>, rows array<array<string>>"


def frame(spark, *tables):
    return spark.createDataFrame([("d", 0, i, h, r) for i, (h, r) in enumerate(tables)], SCHEMA)


def scores(spark, *tables):
    rows = tb.facts(frame(spark, *tables)).select("table_no", tb.score().alias("s"), tb.garbage_reason().alias("g")).collect()
    return [(r.s, r.g) for r in sorted(rows, key=lambda r: r.table_no)]


def test_single_column_is_rebuilt_and_scores_higher(spark):
    t = (["Item  Year1  Year2  Total"], [["Labor  10  20  30"], ["Travel  1  2  3"], ["Total  11  22  33"]])
    r = tb.reconstruct(frame(spark, t)).first()
    assert len(r.headers) == 4 and [len(x) for x in r.rows] == [4, 4, 4]
    before, after = scores(spark, t, (r.headers, r.rows))
    assert after[0] > before[0]


def test_best_candidate_wins_and_none_below_zero(spark):
    good = (["Name", "Value", "Unit"], [["a gain", "20", "dB"], ["b noise", "3", "dB"]])
    one = (["everything in one"], [["x"], ["y"], ["z"]])
    assert tb.best_per(frame(spark, one, good), ["doc_id"], "table_no").first().table_no == 1
    assert tb.best_per(frame(spark, ([], [])), ["doc_id"], "table_no").count() == 0


def test_known_scores(spark):
    (s, g), (s2, g2) = scores(spark, (["Parameter", "Min", "Typ", "Max", "Unit"], [["Gain", "", "20", "", "dB"], ["Noise figure", "", "3", "", "dB"], ["Supply", "4.5", "5", "5.5", "V"]]), (["A", "B"], [["1", "2"], ["3", "4"]]))
    assert g is None and s >= 8
    # by hand: 2.5 x 2 columns + 0.2 x 2 rows + 4 for even rows + 8 for full cells, no label of two letters
    assert s2 == pytest.approx(17.4) and g2 is None


def test_garbage_reasons(spark):
    soup = ([c for c in "ABCDEFGHIJKL"], [["x"] * 12])
    shreds = ([""] * 12, [["tight", "ly"] * 6, ["cou", "pled"] * 6])
    letters = (["A", "B", "C", "D"], [["one two", "three", "four five", "six"]] * 3)
    got = [g for _, g in scores(spark, soup, shreds, letters, ([], []), (None, None), (["only"], []))]
    assert got[:2] == ["wide_short", "wide_short"] and got[2] in ("fragments", "spaced_headers") and got[3:] == ["empty", "empty", "empty"]


def test_filter_keeps_the_good_table(spark):
    assert tb.kept(frame(spark, (["Name", "Value"], [["Alpha", "10"], ["Beta", "20"]]), ([c for c in "ABCDEFGHIJKL"], [["x"] * 12]))).count() == 1


def test_normalize(spark):
    x = spark.createDataFrame([(1, [[None, ""], None]), (2, [["a ", "b\n c"], ["1"], ["", None]]), (3, [["one"]]), (4, None)], "k int, m array<array<string>>")
    r = {v.k: v.t for v in x.select("k", tb.normalize(F.col("m")).alias("t")).collect()}
    assert r[1] is None and r[3] is None and r[4] is None
    assert r[2].headers == ["a", "b c"] and r[2].rows == [["1", ""]]


def test_dedupe_is_greedy_and_keeps_the_first(spark):
    a = (["H", "K"], [["1", "2"], ["3", "4"]])
    b = (["h", "k"], [["1", "2"], ["3", "4"]])
    c = (["H", "K"], [["9", "9"]])
    assert sorted(r.table_no for r in tb.dedupe_list(frame(spark, a, b, c, (["H", "K"], None), (["H", "K"], []))).collect()) == [0, 2, 3]


def test_headers_merge_with_text_row(spark):
    x = spark.createDataFrame([([["Gain", ""], ["(typ)", "unit"], ["1", "2"]],), ([["a", "b"], ["1", "2"]],)], "m array<array<string>>")
    r = [v.t for v in x.select(tb.merge_headers(F.col("m")).alias("t")).collect()]
    assert (r[0].headers, r[0].rows) == (["Gain (typ)", "unit"], [["1", "2"]])
    assert (r[1].headers, r[1].rows) == (["a", "b"], [["1", "2"]])


def test_expand_multiline():
    assert tb.expand_rows([["p", "v", "u"], ["a\nb\nc", "1\n2\n3", "x\ny\nz\nlost"]]) == [["p", "v", "u"], ["a", "1", "x"], ["b", "2", "y"], ["c", "3", "z"]]
    assert tb.expand_rows([["p"], ["a\nb"]]) == [["p"], ["a\nb"]] and tb.expand_rows([]) == []


def test_cells_are_repaired(spark):
    x = spark.createDataFrame([([["P )", "T A", "TA≥", None]],)], "m array<array<string>>")
    assert x.select(tb.repair_cells(F.col("m")).alias("m")).first().m == [["P_OUT)", "T_A", "TA≥", ""]]


def test_merge_extractors_incumbent_wins_ties(spark):
    schema = "doc_id string, page int, table_no int, headers array<string>, rows array<array<string>>, bbox struct<x0:double,y0:double,x1:double,y1:double>, score double"
    h = ["alpha beta", "gamma"]
    x = spark.createDataFrame([("d", 0, 0, h, [["q", "w"]], None, 0.5), ("d", 0, 1, h, [["q", "w"]], None, 0.5), ("d", 0, 2, h, [["q", "w"], ["e", "r"]], None, 0.5), ("d", 1, 0, ["zz"], [], (0.0, 0.0, 9.0, 9.0), 0.9), ("d", 1, 1, ["yy"], [], (1.0, 1.0, 9.0, 9.0), 0.8)], schema)
    assert sorted((r.page, r.table_no) for r in tb.merge_extractors(x).collect()) == [(0, 2), (1, 0)]


def test_ocr_rows_anchor_is_the_first_word(spark):
    x = spark.createDataFrame([("d", i, t, 10 * i, y) for i, (t, y) in enumerate([("a", 0), ("b", 8), ("c", 16), (" ", 0)])], "doc_id string, word_no int, text string, x int, y int")
    assert [(r.row_no, r.words) for r in tb.ocr_rows(x).orderBy("row_no").collect()] == [(0, ["a", "b"]), (1, ["c"])]
    assert tb.ocr_tables(x).count() == 0


def test_markdown_rows_have_equal_width(spark):
    x = frame(spark, (["a", None], [["1"], ["x\ny", "z", "w"]]), ([], []), (None, [["q"]]))
    md = [r.m for r in x.select(tb.table_markdown(F.col("headers"), F.col("rows")).alias("m")).collect()]
    assert {line.count("|") for line in md[0].split("\n")} == {4} and "x y" in md[0] and md[1] == "" and md[2].endswith("| q |")


def test_boxes(spark):
    x = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 9.0, 9.0)), ((0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 3.0, 3.0)), ((0.0, 0.0, 1.0, 1.0), None)], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.o for r in x.select(tb.bboxes_overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [True, False, False]
