"""Text functions, line filters and blocks on small cases and properties."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import blocks as bl, chunking, images, lines as ln


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_words_are_repaired_in_their_case():
    assert tx.repair_words("SLENT and electried") == "SILENT and electrified"
    assert tx.repair_words("the ﬁrst Clalm, freqnency") == "the first Claim, frequency"
    assert tx.repair_words("rst", lost_letters=False, misread=False) == "rst"


def test_spaced_letters():
    assert tx.join_spaced_letters("P r o p o s a l   S u m m a r y") == "Proposal Summary"
    assert tx.join_spaced_letters("1 2 3 4") == "1234"


def test_bold_spans_merge():
    assert tx.merge_bold("**a** **b** **c****,**").startswith("**a b c**")


def test_reflow():
    a, b = "This is a wrapped line of some prose that", "goes on in the next line of the text"
    assert tx.reflow(f"{a}\n{b}\n\n# Heading") == f"{a} {b}\n\n# Heading"
    assert tx.reflow("a line that ends in a tightly-\ncoupled system of two parts") == "a line that ends in a tightly-coupled system of two parts"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab *\n.-|#A", max_size=80))
def test_fixpoints(t):
    assert tx.merge_bold(tx.merge_bold(t)) == tx.merge_bold(t) or "*" in t
    assert tx.reflow(t).replace("\n", " ").split() == t.replace("\n", " ").split() or "-" in t


def test_null_and_empty(spark):
    for f in (tx.clean_whitespace, tx.fix_words, tx.collapse_spaced, tx.defragment_bold, tx.reflow_hard_wraps, tx.truncate, tx.escape_html, tx.final_cleanup):
        assert one(spark, f, None) is None and one(spark, f, "") == ""


def test_scalars(spark):
    assert one(spark, tx.final_cleanup, "x^2 and y_1") == "x^{2} and y_{1}"
    assert one(spark, tx.escape_markdown, "# a |b c#") == "\\# a \\|b c#"
    assert one(spark, tx.sanitize_filename, "a/b: c--d") == "a_b__c_d" and one(spark, tx.sanitize_filename, "//") == "untitled"
    assert one(spark, tx.strip_model_fence, "```\nx\n```") == "x" and one(spark, tx.strip_model_fence, "```python\nx\n```") == "python\nx"
    assert one(spark, lambda c: tx.human_size(F.lit(2048.0)), "") == "2.0 KB"
    assert tx.host_url("0.0.0.0:11434/") == "http://127.0.0.1:11434"


def test_patent_print_is_cleaned(spark):
    lines = ["Patent title", "US1234567B2", "Download PDF", "Claim text that stays here.", "patents.google.com/x", "Find Prior Art", "Similar", "https://patents.google.com/patent", "", "| a | b |\n| --- | --- |\n| 1 | 2 |", "", "More words of the claim.", "Similar", "5 of 9", "", "| a | b |\n| --- | --- |\n| 1 | 2 |"]
    x = spark.createDataFrame([("d", "\n".join(lines)), ("e", None), ("f", "")], "doc_id string, markdown string")
    r = {v.doc_id: v.markdown for v in ln.remove_artifacts(x).collect()}
    assert "Claim text that stays here." in r["d"] and "Download PDF" not in r["d"] and "https://" not in r["d"] and r["d"].count("| 1 | 2 |") == 1
    assert r["f"] == "" and "e" not in r


def test_line_rules(spark):
    x = spark.createDataFrame([("5 /10",), ("5/ 10",), ("- 3 -",), ("Page 4",), ("[ 7 ]",), ("text 5",)], "line string")
    assert [r.p for r in x.select(ln.is_page_number(F.col("line")).alias("p")).collect()] == [True, False, True, True, True, False]
    y = spark.createDataFrame([("d", i, s) for i, s in enumerate(["a b", "x", "x", "", "x", "| r |", "| r |", "a b"])], "doc_id string, line_no int, line string")
    assert [r.line for r in ln.collapse_runs(y).orderBy("line_no").collect()] == ["a b", "x", "", "x", "| r |", "| r |", "a b"]
    assert [r.line for r in ln.drop_repeated(y).orderBy("line_no").collect()] == ["", "| r |", "| r |"]
    assert [r.line for r in ln.drop_repeated(y.repartition(7)).orderBy("line_no").collect()] == ["", "| r |", "| r |"]


def test_blocks(spark):
    def code(t, mono):
        return one(spark, lambda c: bl.looks_like_code(c, F.lit(mono)), t)

    assert one(spark, bl.looks_like_drawing_label, "OUTPUT BANDPASS FILTER") and not code("OUTPUT BANDPASS FILTER", True)
    assert code("def f(x):\n    return x + 1", True) and not code("", True)
    r = spark.createDataFrame([("Subtitle", False), ("No Spacing", False), ("Heading 9", False), ("heading x", False), (None, True), ("List Bullet", True)], "s string, m boolean").select(bl.docx_type(F.col("s"), F.lit("text"), F.col("m")).alias("t")).collect()
    assert [(v.t.type, v.t.level) for v in r] == [("heading", 1), ("code", None), ("heading", 6), ("heading", 2), ("code", None), ("list_item", None)]


def test_heading_levels(spark):
    spans = [("d", 0, b, 0, 0, "word " * 3, size, 0, "Times") for b, size in enumerate([14.0, 16.0, 18.0, 10.0])]
    spans += [("d", 0, 4 + k, 0, 0, "body text", 9.2, 0, "Times") for k in range(200)]
    x = spark.createDataFrame(spans, "doc_id string, page int, block_no int, line_no int, span_no int, text string, size double, flags int, font string")
    assert [r.level for r in bl.page_blocks(x).where("block_no < 4").orderBy("block_no").collect()] == [3, 2, 1, None]


def test_chunks():
    text = "x" * 29_400
    assert [s for s, _ in chunking.chunk(text, 15_000, 500)] == [0, 14_500, 29_000]
    assert chunking.chunk("") == [(0, "")]
    t = "a" * 80 + "\n\n" + "b" * 50
    assert [c for _, c in chunking.chunk(t, 100, 10)][0] == "a" * 80 + "\n\n"


def test_images(spark):
    x = spark.createDataFrame([("d", 1, "word/media/a.emf", b"x" * 600), ("d", 2, "word/media/b.png", b"x" * 600), ("d", 3, "c", b"y" * 10), ("e", 1, "word/media/n", b"x" * 600)], "doc_id string, idx int, source string, data binary")
    assert sorted((r.doc_id, r.filename) for r in images.office_names(images.dedupe_images(x)).collect()) == [("d", "image_001.png"), ("e", "image_001.png")]


def test_titles_and_headings_of_all_scripts(spark, tmp_path):
    import re

    from paperloom.queries import document

    titles = ["Prüfbericht: Übersicht", "Relevé d'état -- été", "Plain title", "//", "测试 报告"]
    spark.createDataFrame([(str(i), (t,)) for i, t in enumerate(titles)], "doc_id string, metadata struct<title:string>").write.parquet(f"{tmp_path}/conversion_results.parquet")
    heads = ["Prüfbericht der Pumpe", "ÜBERSICHT", "état", "Plain", "12 figures"]
    spark.createDataFrame([("d", i, "heading", t) for i, t in enumerate(heads)], "doc_id string, seq int, type string, content string").write.parquet(f"{tmp_path}/sections.parquet")
    want = {t: re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "_", t)).strip("_")[:50] or "untitled" for t in titles}
    assert {r.title: r.file_name for r in document.filename_sanitize_all(spark, str(tmp_path)).collect()} == want
    assert {r.sample: r.cased for r in document.match_case_all(spark, str(tmp_path)).collect()} == {"Prüfbericht": "Replacement", "ÜBERSICHT": "REPLACEMENT", "état": "replacement", "Plain": "Replacement"}
