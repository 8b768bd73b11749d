from paperloom.operators import packed_cells as pc

SCHEMA = "doc_id string, page int, table_no int, headers array<string>, rows array<array<string>>, extra string"


def test_pieces():
    assert pc.pieces('a; b;"c; d" ;e;') == ["a", "b", "c; d", "e"]
    assert pc.pieces('"5"" hose",gasket set|grease tub') == ['5" hose', "gasket set", "grease tub"]
    assert pc.pieces("brass\t\tcork") == ["brass", "", "cork"] and pc.pieces("") == [] and pc.pieces("a;;") == ["a", ""]
    assert pc.pieces("  a    b c  d", [pc.WIDE_GAP]) == ["a", "b c", "d"]


def test_split(spark):
    t = spark.createDataFrame([
        ("d", 1, 0, ["Materials ", "Remarks"], [["a, b", "x, y"], ["a", None], [None], ["b;;a;", "q", "long row"], ["b"], ["a"]], "e"),
        ("d", 1, 0, ["Materials ", "Remarks"], [["a, b", "x, y"], ["a", None], [None], ["b;;a;", "q", "long row"], ["b"], ["a"]], "e"),
        ("d", 2, 0, ["Item;Supply AC/DC"], [['x;"1;2"'], ["y;"], [""]], None),
        ("d", 3, 0, None, [["a, b"]], None), ("d", 4, 0, ["Materials"], None, None), ("d", 5, 0, ["Item  Remarks"], [["p  q r"]], None),
    ], SCHEMA)
    k = spark.createDataFrame([("materials", "list"), ("Remarks", "single"), ("Item", "single"), ("Supply AC/DC", "single")], "header string, holds string")
    got = sorted((r.page, r.row_no, r.col_no, r.pos, r.value) for r in pc.split_packed(t, k).collect())
    assert got == [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 3, 0, 0, "b"), (1, 3, 0, 2, "a"), (2, -1, 0, 0, "Item"), (2, -1, 0, 1, "Supply AC/DC"), (2, 0, 0, 0, "x"), (2, 0, 0, 1, "1;2"),
        (5, -1, 0, 0, "Item"), (5, -1, 0, 1, "Remarks"), (5, 0, 0, 0, "p"), (5, 0, 0, 1, "q r")]
    assert pc.split_packed(t.limit(0), k).count() == 0


def _chosen(spark, cells):
    d = spark.createDataFrame(cells, "source_key string, cell string")
    return {(r.source_key, r.delimiter) for r in pc.infer_delimiters(d).where("used").collect()}


def test_delimiters_need_consistency_and_regularity(spark):
    plain = [("m", x) for x in ("felt", "cork", "brass", "AC/DC", "AC/DC")]
    cells = plain + [("m", "felt; cork"), ("m", "cork;brass;felt"), ("m", "brass|felt"), ("m", "AC/DC; felt")]
    # "/" cuts evenly, but its pieces are no values
    assert _chosen(spark, cells) == {("m", ";"), ("m", "|")}
    # "," makes known pieces only, so regularity alone would take it, but cuts no cell evenly
    cells = plain[:3] * 3 + [("m", "felt; cork")] * 9 + [("m", x) for x in (",, felt", ",,cork,,", ", , brass ,", ",,,felt") for _ in range(9)]
    d = spark.createDataFrame(cells, "source_key string, cell string")
    by = {r.delimiter: r for r in pc.infer_delimiters(d).collect()}
    assert by[","].regularity == 1 and by[","].consistency == 0 and not by[","].used and by[";"].used


def test_a_list_column_always_has_a_delimiter(spark):
    # no value stands alone and none comes twice
    assert _chosen(spark, [("open", f"a{i}x; b{i}y; c{i}z") for i in range(40)] + [("single", "x"), ("none", "")]) == {("open", ";")}
    assert _chosen(spark, [("few", "p q; r s"), *[("many", x) for x in ("a;b", "b", "a", "c;a", "c", "b;c")]]) == {("few", ";"), ("many", ";")}
    assert pc.infer_delimiters(spark.createDataFrame([], "source_key string, cell string")).count() == 0
