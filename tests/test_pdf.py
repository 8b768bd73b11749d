"""PDF files and recognised images end to end: files made here, by hand."""

import json
import random
import zlib


from paperloom.config import Config
from paperloom.operators import lines as ln
from paperloom.plans import pipeline
from paperloom.sources import scan as sc
from paperloom.sources.pdf import Document, Reader, decode_pdf


def pdf(pages, title="A manual", image=b"", packed=False, widths=False):
    """A file of ``pages``, each a content stream; fonts F1 (plain), F2 (bold), F3 (fixed width)."""
    n = 8
    kids = " ".join(f"{n + 2 * i} 0 R" for i in range(len(pages)))
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <0042> endbfrange"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> /XObject << /Im1 6 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [128 /fi /adieresis] >> >>",
        4: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold /ToUnicode 900 0 R >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
        6: b"<< /Type /XObject /Subtype /Image /Width 20 /Height 20 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length %d >>\nstream\n%s\nendstream" % (len(image), image),
        7: f"<< /Title ({title}) /Author <FEFF00C40062> >>".encode(),
        900: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    }
    for i, c in enumerate(pages):
        body = zlib.compress(c) if packed else c
        objects[n + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {n + 2 * i + 1} 0 R >>".encode()
        objects[n + 2 * i + 1] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" if packed else b"", body)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"


def grid(x, y, cells, w=150, h=20):
    out = [f"{x + w * j} {y - h * i} {w} {-h} re S" for i, row in enumerate(cells) for j in range(len(row))]
    out += [f"BT /F1 10 Tf {x + w * j + 5} {y - h * i - 14} Td ({t}) Tj ET" for i, row in enumerate(cells) for j, t in enumerate(row)]
    return "\n".join(out)


ROWS = [["Parameter", "Typical value", "Maximum value"], ["Supply voltage", "3.30", "3.60"], ["Supply current", "45.0", "60.0"], ["Output power", "12.5", "15.5"]]
PAGE = f"""BT /F1 24 Tf 50 750 Td (Pump manual) Tj ET
BT /F1 10 Tf 50 700 Td 12 TL (The pump is greased by the fitter and the) Tj T* (casing is closed at once, as the \\200gure says.) Tj ET
BT /F2 10 Tf 50 650 Td <010203> Tj ET
BT /F3 10 Tf 50 600 Td 12 TL (int main\\(void\\) {{) Tj T* (  return start\\(\\);) Tj T* (}}) Tj T* (// end of it) Tj ET
{grid(50, 500, ROWS)}
q 100 0 0 100 50 50 cm /Im1 Do Q""".encode()


def test_objects():
    assert Reader(b"<< /A [1 -2.5 (x\\)\\101(y)) <4142> /N#20m true null 7 0 R] >>").value() == {"A": [1, -2.5, b"x)A(y)", b"AB", "N m", True, None, Reader(b"7 0 R").value()]}
    for bad in (b"", b"no file", b"%PDF-1.4\n1 0 obj << /Type /Catalog", b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"):
        try:
            assert [r for r in decode_pdf(bad) if "meta" not in r] == []
        except ValueError:
            assert b"Encrypt" in bad or b"%PDF" not in bad
    assert len(list(Document(pdf([b"", b""])).pages())) == 2


def test_page_of_a_file():
    image = bytes(range(200)) * 6
    for packed in (False, True):
        got = list(decode_pdf(pdf([PAGE, b"BT /F1 10 Tf 10 10 Td [(se) -20 (cond) -400 (page)] TJ ET", b"broken ( BT"], image=image, packed=packed)))
        meta = [r["meta"] for r in got if "meta" in r][0]
        assert (meta["title"], meta["author"], meta["page_count"]) == ("A manual", "Äb", 3)
        spans = [r["span"] for r in got if "span" in r]
        assert "as the ﬁgure says." in " ".join(s["text"] for s in spans) and any(s["text"] == "ABC" and s["flags"] == 2 for s in spans)
        assert [s["text"] for s in spans if s["page"] == 1] == ["second page"] and spans[0]["size"] == 24
        assert [r["raw"]["matrix"] for r in got if "raw" in r] == [ROWS]
        pics = [r["image"] for r in got if "image" in r]
        assert len(pics) == 1 and pics[0]["extension"] == "png" and pics[0]["data"].startswith(b"\x89PNG") and pics[0]["page"] == 1


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, file_type string, content binary")


def test_pdf_conversion(spark):
    data = pdf([PAGE, b"BT /F1 10 Tf 10 700 Td (Sheet 2 of 9) Tj 0 -40 Td (The second page ends here.) Tj ET"], image=random.Random(0).randbytes(1200))
    x = files(spark, [("m.pdf", "pdf", bytearray(data)), ("bad.pdf", "pdf", bytearray(b"%PDF /Encrypt 1 0 R")), ("none.pdf", "pdf", None), ("empty.pdf", "pdf", bytearray(pdf([b""])))])
    r = {v.doc_id: v for v in pipeline.convert_files(x, Config(extract_tables=True)).collect()}
    assert {k: v.status for k, v in r.items()} == {"m.pdf": "ok", "bad.pdf": "failed", "none.pdf": "failed", "empty.pdf": "ok"}
    m = r["m.pdf"]
    assert m.markdown.startswith("# Pump manual") and "**ABC**" in m.markdown and "```\nint main(void) {" in m.markdown and "as the figure says." in m.markdown
    assert "| Supply voltage | 3.30 | 3.60 |" in m.markdown and "Sheet 2" not in m.markdown and m.markdown.endswith("The second page ends here.")
    s = json.loads(m.structured)
    assert [t["headers"] for t in s["sections"] if t["type"] == "table"] == [ROWS[0]] and s["stats"]["code_blocks"] == 1 and s["sections"][0]["level"] == 1
    assert [t["source"] for t in s["sections"] if t["type"] == "table"] == ["ruled"] and [i.filename for i in m.images] == ["page001_img001.png"]
    plain = pipeline.convert_files(x, Config(extract_images=False)).where("doc_id = 'm.pdf'").first()
    assert "|" not in plain.markdown and "table" not in plain.structured.replace('"tables"', "") and plain.images is None


def test_decoders_take_part(spark, monkeypatch):
    """A library's passes: tables found twice are merged, text strategies fill uncovered pages, OCR gives tables."""
    box = {"x0": 0.0, "y0": 10.0, "x1": 100.0, "y1": 90.0}
    more = [[c.replace("pump", "x") for c in r] for r in ROWS]
    late = [["Parameter", "Typical value"], ["valve", "100"], ["gasket", "200"]]

    def library(data):
        yield {"span": {"page": 0, "block_no": 0, "line_no": 0, "span_no": 0, "text": "Some words of the first page.", "size": 10.0, "flags": 0, "font": "Times"}}
        yield {"span": {"page": 0, "block_no": 1, "line_no": 0, "span_no": 0, "text": "A   B", "size": 10.0, "flags": 0, "font": "Courier"}}
        yield {"raw": {"page": 0, "table_no": 0, "matrix": ROWS, "source": "lines", "bbox": box}}
        yield {"raw": {"page": 0, "table_no": 1, "matrix": [["0", "1", "2"], *more], "source": "camelot-lattice", "bbox": None}}
        yield {"raw": {"page": 0, "table_no": 2, "matrix": late, "source": "pdfplumber-text-text", "bbox": None}}
        yield {"raw": {"page": 1, "table_no": 3, "matrix": late, "source": "pdfplumber-lines-text", "bbox": None}}
        yield {"raw": {"page": 1, "table_no": 4, "matrix": [["a", ""], ["", ""]], "source": "pdfplumber-text-text", "bbox": None}}

    def ocr(data):
        yield {"ocr": {"text": "Report on pumps\n\nThe pump is greased by the fitter.\n\n"}}
        for i, (t, x, y) in enumerate((t, 100 * j, 40 * i) for i, row in enumerate([["Part", "Count"], ["valve", "3"], ["gasket", "5"]]) for j, t in enumerate(row)):
            yield {"word": {"word_no": i, "text": t, "x": x, "y": y, "w": 9, "h": 9, "conf": 90}}
        yield {"image": {"idx": 1, "source": "source_image.png", "data": b"p" * 600, "extension": "png", "page": 1, "width": 1, "height": 1}}

    monkeypatch.setattr(sc, "_plugins", {"pdf": library, "image": ocr})
    x = files(spark, [("a.pdf", "pdf", bytearray(b"1")), ("b.png", "image", bytearray(b"2"))])
    r = {v.doc_id: v for v in pipeline.convert_files(x, Config(extract_tables=True)).collect()}
    tables = [t for t in json.loads(r["a.pdf"].structured)["sections"] if t["type"] == "table"]
    assert [(t["source"], len(t["rows"])) for t in tables] == [("lines", 3), ("pdfplumber-lines-text", 2)]
    # single letters in a fixed-width font are no section
    assert "A   B" not in [s.get("content") for s in json.loads(r["a.pdf"].structured)["sections"]] and "A   B" in r["a.pdf"].markdown
    assert r["b.png"].markdown.startswith("### Report on pumps") and "| gasket | 5 |" in r["b.png"].markdown and r["b.png"].markdown.endswith("![Source Image](images/source_image.png)")
    assert [s["type"] for s in json.loads(r["b.png"].structured)["sections"]] == ["heading", "heading", "paragraph", "image"] and [i.filename for i in r["b.png"].images] == ["source_image.png"]


def test_garbage_tables_go(spark):
    good = "| Parameter | Typical value | Maximum value |\n| --- | --- | --- |\n| Supply voltage | 3.3 volt | 3.6 volt |\n| Output power | 12 watt | 15 watt |"
    soup = "| a- | led | ola | x | kt | y- |\n| - | - | - | - | - | - |\n| b | wq | en | ab | z | qq |"
    text = f"Text before.\n{good}\nbetween\n{soup}\nafter\n| one | two words |\n\n|---|---|\nend\n| a | b | c | d | e | f |"
    d = spark.createDataFrame([("d", text, 1), ("e", None, 2), ("f", "", 3), ("g", soup, 4), ("h", "no bars", 5)], "doc_id string, markdown string, is_row int")
    got = {r.doc_id: r.markdown for r in pipeline.without_garbage_tables(d).collect()}
    assert got == {"d": f"Text before.\n{good}\nbetween\nafter\n| one | two words |\n\nend", "e": None, "f": "", "g": "", "h": "no bars"}
    assert ln.drop_garbage_tables(ln.explode_lines(d.limit(0))).count() == 0
