"""Word and slide files, decoded with the standard library: runs, tables, images, metadata.

One file is one row of a ``binaryFile`` scan; each gives many rows.  A file
that cannot be read gives one row with its error, and the others go on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from paperloom.sources.decode import decode as run_decoders

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CORE = {
    "title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "subject": "{http://purl.org/dc/elements/1.1/}subject",
    "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified",
}
#: Placeholders that hold a slide's title.
_TITLES = {"title", "ctrTitle"}
#: An archive member larger than this is not read; it guards executors against archive bombs.
MAX_MEMBER = 512 * 1024 * 1024


def _read(z: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MAX_MEMBER:
        raise ValueError(f"{name} is larger than {MAX_MEMBER} bytes")
    return z.read(info)


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    data = _read(z, "docProps/core.xml")
    root = ET.fromstring(data) if data else None
    return {k: (root.findtext(tag) or "") if root is not None else "" for k, tag in _CORE.items()}


def _on(el: ET.Element | None) -> bool | None:
    """Tri-state of a run property: absent means as inherited."""
    return None if el is None else el.get(f"{_W}val", "true") not in ("0", "false", "none", "off")


def _text(run: ET.Element) -> str:
    out = []
    for x in run:
        tag = x.tag.rpartition("}")[2]
        out.append(x.text or "" if tag == "t" else "\t" if tag == "tab" else "\n" if tag in ("br", "cr") else "")
    return "".join(out)


def _media(z: zipfile.ZipFile, folder: str) -> Iterator[dict]:
    names = [n for n in z.namelist() if n.startswith(folder) and not n.endswith("/")]
    for idx, name in enumerate(names, 1):
        yield {"image": {"idx": idx, "source": name, "data": _read(z, name)}}


def decode_docx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        styles = {}
        if s := _read(z, "word/styles.xml"):
            for st in ET.fromstring(s).iter(f"{_W}style"):
                name = st.find(f"{_W}name")
                styles[st.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else st.get(f"{_W}styleId")
        body = ET.fromstring(_read(z, "word/document.xml") or b"<x/>").find(f"{_W}body")
        parts = list(body) if body is not None else []
        n_sections = sum(1 for _ in body.iter(f"{_W}sectPr")) if body is not None else 0
        yield {"meta": {**_core(z), "page_count": n_sections, "slide_count": None}}
        tables = 0
        for no, el in enumerate(parts):
            if el.tag == f"{_W}p":
                style = el.find(f"{_W}pPr/{_W}pStyle")
                sid = style.get(f"{_W}val") if style is not None else None
                name = _style_name(styles.get(sid, sid or "Normal"))
                for k, r in enumerate(el.iter(f"{_W}r")):
                    p = r.find(f"{_W}rPr")
                    fonts = p.find(f"{_W}rFonts") if p is not None else None
                    yield {"run": {"part_no": 0, "para_no": no, "run_no": k, "style": name, "level": None, "is_title": False, "text": _text(r),
                        "bold": _on(p.find(f"{_W}b")) if p is not None else None, "italic": _on(p.find(f"{_W}i")) if p is not None else None,
                        "font": fonts.get(f"{_W}ascii") if fonts is not None else None}}
            elif el.tag == f"{_W}tbl":
                matrix = [["\n".join("".join(_text(r) for r in p.iter(f"{_W}r")) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")] for row in el.findall(f"{_W}tr")]
                yield {"raw": {"page": no, "table_no": tables, "matrix": matrix}}
                tables += 1
        yield from _media(z, "word/media/")


def _style_name(name: str) -> str:
    return re.sub(r"^heading (\d)$", r"Heading \1", name)


def decode_pptx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(_read(z, "ppt/_rels/presentation.xml.rels") or b"<x/>")}
        order = [s.get(f"{_R}id") for s in ET.fromstring(_read(z, "ppt/presentation.xml") or b"<x/>").iter(f"{_P}sldId")]
        yield {"meta": {**_core(z), "page_count": None, "slide_count": len(order)}}
        tables = 0
        for slide_no, rid in enumerate(order, 1):
            target = rels.get(rid) or ""
            name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("ppt", target))
            tree = ET.fromstring(_read(z, name) or b"<x/>").find(f"{_P}cSld/{_P}spTree")
            para = 0
            # a slide without any text still has its heading
            yield {"run": {"part_no": slide_no, "para_no": -2, "run_no": 0, "style": None, "level": 0, "is_title": False, "text": "", "bold": None, "italic": None, "font": None}}
            for shape in _shapes(tree):
                kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                title = kind is not None and kind.get("type") in _TITLES
                for p in shape.findall(f"{_P}txBody/{_A}p"):
                    pr = p.find(f"{_A}pPr")
                    for k, r in enumerate(p.findall(f"{_A}r")):
                        rp = r.find(f"{_A}rPr")
                        font = rp.find(f"{_A}latin") if rp is not None else None
                        flag = lambda n, rp=rp: None if rp is None or rp.get(n) is None else rp.get(n) in ("1", "true")
                        yield {"run": {"part_no": slide_no, "para_no": para, "run_no": k, "style": None, "level": int(pr.get("lvl", 0)) if pr is not None else 0, "is_title": title, "text": r.findtext(f"{_A}t") or "",
                            "bold": flag("b"), "italic": flag("i"), "font": font.get("typeface") if font is not None else None}}
                    para += 1
                for t in shape.iter(f"{_A}tbl"):
                    matrix = [["\n".join("".join(x.text or "" for x in p.iter(f"{_A}t")) for p in c.iter(f"{_A}p")) for c in row.findall(f"{_A}tc")] for row in t.findall(f"{_A}tr")]
                    yield {"raw": {"page": slide_no, "table_no": tables, "matrix": matrix}}
                    tables += 1
        yield from _media(z, "ppt/media/")


def _shapes(tree: ET.Element | None) -> Iterator[ET.Element]:
    """Shapes in order, those of groups among them."""
    for el in tree if tree is not None else ():
        if el.tag == f"{_P}grpSp":
            yield from _shapes(el)
        elif el.tag in (f"{_P}sp", f"{_P}graphicFrame"):
            yield el


#: Decoders by file type; others can be added, see sources.scan.register.
DECODERS = {"docx": decode_docx, "pptx": decode_pptx}


def decode(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """``files`` (doc_id, file_type, content) to rows of schema.DECODED, by these decoders and those given."""
    return run_decoders(files, {**DECODERS, **(decoders or {})})
