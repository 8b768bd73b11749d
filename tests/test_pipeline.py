"""Files in, results out: small Word and slide archives made here."""

import json
import os
import zipfile

from pyspark.sql import functions as F

from paperloom import enhance as en
from paperloom.config import Config
from paperloom.plans import pipeline
from paperloom.sinks import files as sink
from paperloom.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CORE = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A title</dc:title><dc:creator>Someone</dc:creator></c>'


def docx(path):
    p = lambda style, runs: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{runs}</w:p>'
    run = lambda t, pr="": f"<w:r><w:rPr>{pr}</w:rPr><w:t>{t}</w:t></w:r>"
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body = p("Heading1", run("Report")) + p("Normal", run("Some ") + run("bold", "<w:b/>") + run(" text of the report.")) + p("ListNumber", run("first step"))
    body += f"<w:tbl><w:tr>{cell('Name')}{cell('Value')}</w:tr><w:tr>{cell('Alpha')}{cell('10')}</w:tr><w:tr>{cell('Beta')}{cell('20')}</w:tr></w:tbl><w:sectPr/>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Heading1", "heading 1"), ("ListNumber", "List Number"), ("Normal", "Normal")))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("docProps/core.xml", CORE)
        z.writestr("word/media/image1.png", b"i" * 600)
        z.writestr("word/media/image2.png", b"i" * 600)


def pptx(path):
    sp = lambda ph, text, lvl=0: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{ph}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda x: f"<p:sld {A}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {A}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<R><x Id="r1" Target="slides/slide1.xml"/><x Id="r2" Target="slides/slide2.xml"/></R>')
        z.writestr("ppt/slides/slide1.xml", slide(sp("body", "point", 1)))
        z.writestr("ppt/slides/slide2.xml", slide(sp("title", "Opening") + f"<p:grpSp>{sp('body', 'words in a group')}</p:grpSp>"))


def test_folder(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    docx(folder / "a.docx")
    pptx(folder / "b.pptx")
    (folder / "c.docx").write_bytes(b"not an archive")
    (folder / "d.txt").write_text("no supported file")
    r = {v.doc_id: v for v in pipeline.convert_folder(spark, str(folder), Config(extract_tables=True)).collect()}
    assert set(r) == {"a.docx", "b.pptx", "c.docx"} and r["c.docx"].status == "failed" and r["c.docx"].error.startswith("Error")
    a = r["a.docx"]
    assert a.markdown.startswith("# Report") and "Some **bold** text" in a.markdown and "1. first step" in a.markdown and "| Alpha | 10 |" in a.markdown
    assert [i.filename for i in a.images] == ["image_001.png"] and a.metadata.title == "A title" and json.loads(a.structured)["stats"]["tables"] == 1
    b = r["b.pptx"]
    assert "### Opening" in b.markdown and "words in a group" in b.markdown and b.markdown.index("Opening") < b.markdown.index("- point") and b.metadata.slide_count == 2
    done = spark.createDataFrame([("a_docx", a.markdown, a.structured)], "path string, markdown string, structured string")
    sink.save(done, str(out))
    assert (out / "a_docx" / "output.md").read_text() == a.markdown and os.path.exists(out / "a_docx" / "output.json")
    assert len(sink.zip_results(done.withColumn("stem", F.lit("a")))) > 100


def test_tables_are_dropped_by_default(spark):
    x = spark.createDataFrame([("d", "Some text **a** **b** here.\n\n| x | y |\n| --- | --- |\n| 1 | 2 |")], "doc_id string, markdown string")
    md = pipeline.clean_corpus(x).first().markdown
    assert "|" not in md and "**a b**" in md


def test_decoder_plugin(spark):
    x = spark.createDataFrame([("p", "pdf", b"%PDF")], "doc_id string, file_type string, content binary")
    assert office.decode(x).first().error == "Error: no decoder for pdf"

    def pdf(data):
        yield {"run": {"part_no": 0, "para_no": 0, "run_no": 0, "style": "Normal", "level": None, "is_title": False, "text": "hello", "bold": None, "italic": None, "font": None}}

    assert office.decode(x, {"pdf": pdf}).first().run.text == "hello"


def test_enhancement_keeps_the_text(spark):
    md = "Words before.\n\n| a | b |\n| - | - |\n\nx_1 after\n" * 3
    assert en.enhanced(en.Echo(), md).strip() == md.strip()

    class Broken(en.Echo):
        def generate(self, prompt):
            raise OSError("down")

    assert en.enhanced(Broken(), "x_1").startswith("x_1\n\n<!--") and en.enhanced(Broken(), "") == ""
    x = spark.createDataFrame([("d", "x_1")], "doc_id string, markdown string")
    assert en.enhance(x, en.provider("echo")).first().markdown == "x_1"


def test_combined(spark):
    x = spark.createDataFrame([("b", "2", "two"), ("b", "1", "one")], "batch string, doc_id string, markdown string").withColumn("stem", F.col("doc_id"))
    assert sink.combined(x, "batch").first().markdown == "# 1\n\none\n\n---\n\n# 2\n\ntwo"
    p = spark.createDataFrame([("x/a.pdf",), ("x/a.docx",)], "p string")
    assert [r.o for r in p.select(sink.output_path(F.col("p")).alias("o")).collect()] == ["x/a_pdf", "x/a_docx"]


def test_stream(spark, tmp_path):
    from paperloom.streaming.watch import watch

    (tmp_path / "in").mkdir()
    docx(tmp_path / "in" / "a.docx")
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'ok'").count() == 1
