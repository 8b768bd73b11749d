"""Typed blocks: what spans, runs and text make of a block, and its Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import rules
from paperloom.functions.text import is_math, strip
from paperloom.operators.tables import in_reading_order, table_markdown

_LINES = r"\n|\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _LINES), strip), lambda x: x != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def looks_like_drawing_label(text: Column) -> Column:
    """Callouts and labels: few short lines, mostly capitals, or mostly single letters, and no sign of code."""
    lines, words = _lines(text), _words(text)
    code = text.rlike(rules.LABEL_CODE)
    short = F.forall(lines, lambda x: F.length(x) <= 48)
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z]", "")
    caps = F.filter(lines, lambda x: (letters(x) != "") & (((letters(x) == F.upper(letters(x))) & (F.length(letters(x)) >= 2)) | x.rlike(rules.LABEL_CAPITALS)))
    mostly_caps = (F.size(caps) >= F.greatest(F.lit(1.0), F.size(lines) * 0.6)) & (F.length(text) < 200)
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    scattered = (F.size(words) > 0) & (F.length(text) < 60) & (single / F.greatest(F.size(words), F.lit(1)) >= 0.5)
    return (F.size(lines) > 0) & (F.size(lines) <= 12) & ~code & short & (mostly_caps | scattered)


def code_score(text: Column, mono: Column) -> Column:
    """Points for what is typical of code; ``text`` without white space at its ends."""
    lines = F.filter(F.split(text, _LINES), lambda x: strip(x) != "")
    n, k = F.length(text), F.size(lines)
    indented = F.size(F.filter(lines, lambda x: x.startswith(" ") | x.startswith("\t")))
    signs = F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", ""))
    point = lambda c, p: F.when(c, p).otherwise(0)
    score = sum(point(text.rlike(p), n_points) for p, n_points in rules.CODE_POINTS)
    score = score + point((k >= 3) & (indented >= 2), 1) + point((n > 20) & (signs / F.greatest(n, F.lit(1)) > 0.18), 1)
    return score + F.when(mono & (k >= 4) & (n >= 40), 1).when(mono & (k >= 2) & (score >= 1), 1).otherwise(0)


def looks_like_code(text: Column, mono: Column) -> Column:
    """Enough points, no drawing label, and not one or two lines of plain words in a fixed-width font."""
    s = strip(text)
    score = code_score(s, mono)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    k = F.size(F.filter(F.split(s, _LINES), lambda x: strip(x) != ""))
    plain = mono & (k <= 2) & (score < 2) & (letters / F.greatest(F.length(s), F.lit(1)) > 0.7)
    return (s != "") & ~looks_like_drawing_label(s) & ~plain & (score >= F.when(mono, 2).otherwise(3))


def page_font_size(spans: DataFrame) -> DataFrame:
    """Spans with ``page_size``, the mean size of the page's spans that are not blank, 12 if there are none."""
    inked = F.when(strip(F.col("text")) != "", F.col("size"))
    return spans.withColumn("page_size", F.coalesce(F.avg(inked).over(Window.partitionBy("doc_id", "page")), F.lit(12.0)))


def is_mono_font(font: Column, fonts: list[str] = rules.MONO_FONTS) -> Column:
    return F.coalesce(F.lower(font).rlike("|".join(fonts)), F.lit(False))


def span_markdown(text: Column, flags: Column, font: Column, bold_bit: int = 2, italic_bit: int = 1) -> Column:
    bold, italic = flags.bitwiseAND(bold_bit) > 0, flags.bitwiseAND(italic_bit) > 0
    return _marked(text, is_mono_font(font), bold, italic)


def _marked(text: Column, mono: Column, bold: Column, italic: Column) -> Column:
    wrap = lambda m: F.concat(F.lit(m), text, F.lit(m))
    return F.when(strip(text) == "", text).when(mono, wrap("`")).when(bold & italic, wrap("***")).when(bold, wrap("**")).when(italic, wrap("*")).otherwise(text)


def run_markdown(text: Column, bold: Column, italic: Column, font: Column) -> Column:
    """A Word or slide run; bold and italic may be null, which means as inherited."""
    no = F.lit(False)
    wrap = lambda m: F.concat(F.lit(m), text, F.lit(m))
    b, i = F.coalesce(bold, no), F.coalesce(italic, no)
    return F.when(text == "", text).when(is_mono_font(font, rules.MONO_RUN_FONTS), wrap("`")).when(b & i, wrap("***")).when(b, wrap("**")).when(i, wrap("*")).otherwise(text)


def ordered_join(order: list[str], text: str, sep: str) -> Column:
    """Aggregate: the texts of a group in the order of the columns, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), sep)


def page_blocks(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, type, level, content, markdown) of the blocks of decoded pages."""
    s = page_font_size(spans)
    inked = strip(F.col("text")) != ""
    mono = F.avg(F.when(inked & (F.coalesce("font", F.lit("")) != ""), is_mono_font(F.col("font")).cast("double")))
    by = s.groupBy("doc_id", "page", "block_no").agg(
        F.coalesce(F.avg(F.when(inked, F.col("size"))), F.first("page_size")).alias("size"), F.first("page_size").alias("page_size"),
        F.coalesce(mono >= 0.6, F.lit(False)).alias("mono"), F.countDistinct("line_no").alias("n_lines"))
    t = s.drop("size", "page_size").join(by.select("doc_id", "page", "block_no", "mono"), ["doc_id", "page", "block_no"])
    t = t.withColumn("_md", F.when(F.col("mono"), F.col("text")).otherwise(span_markdown(F.col("text"), F.col("flags"), F.col("font"))))
    line = t.groupBy("doc_id", "page", "block_no", "line_no").agg(ordered_join(["span_no"], "_md", "").alias("_line"))
    block = line.groupBy("doc_id", "page", "block_no").agg(strip(ordered_join(["line_no"], "_line", "\n")).alias("content")).where("content <> ''")
    return classify_blocks(block.join(by, ["doc_id", "page", "block_no"])).select("doc_id", "page", "block_no", "type", "level", "content", "markdown")


def layout_sections(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, part_no, para_no, type, level, content, prefix, headers, rows, source, score, markdown) of decoded pages.

    Blocks come in their order, the page's tables (doc_id, page, table_no,
    bbox, headers, rows, source, score) after them, from the top.
    """
    none = lambda t: F.lit(None).cast(t)
    b = page_blocks(spans).select(
        "doc_id", F.col("page").alias("part_no"), F.col("block_no").alias("para_no"), "type", "level", "content", none("string").alias("prefix"),
        none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"), none("string").alias("source"), none("double").alias("score"), "markdown")
    if tables is None:
        return b
    t = in_reading_order(tables).select(
        "doc_id", F.col("page").alias("part_no"), (1_000_000 + F.col("place")).cast("int").alias("para_no"), F.lit("table").alias("type"), none("int").alias("level"), none("string").alias("content"),
        none("string").alias("prefix"), "headers", "rows", "source", "score", table_markdown(F.col("headers"), F.col("rows")).alias("markdown"))
    return b.unionByName(t.where("trim(markdown) <> ''"))


def heading_level(size: Column, page_size: Column, n_chars: Column) -> Column:
    ratio_ok = (size >= page_size * 1.4) & (n_chars < 200)
    return F.when(ratio_ok & (size >= page_size * 1.8), 1).when(ratio_ok & (size >= page_size * 1.6), 2).when(ratio_ok, 3)


def classify_blocks(blocks: DataFrame) -> DataFrame:
    c, mono = F.col("content"), F.col("mono")
    level = heading_level(F.col("size"), F.col("page_size"), F.length(c))
    code = looks_like_code(c, mono) & (mono | (F.col("n_lines") >= 2))
    kind = F.when(level.isNotNull(), "heading").when(code, "code").when(looks_like_drawing_label(c) & mono, "paragraph").when(is_math(c), "math").otherwise("paragraph")
    return blocks.withColumn("level", level).withColumn("type", kind).withColumn("markdown", block_markdown(F.col("type"), F.col("level"), c))


def block_markdown(kind: Column, level: Column, content: Column) -> Column:
    fence = F.concat(F.lit("```\n"), content, F.lit("\n```"))
    display = F.concat(F.lit("$$\n"), content, F.lit("\n$$"))
    math = F.when(F.contains(content, F.lit("\n")), display).otherwise(F.concat(F.lit("$"), content, F.lit("$")))
    quote = F.concat(F.lit("> "), F.replace(content, F.lit("\n"), F.lit("\n> ")))
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), content)).when(kind == "code", fence).when(kind == "math", math).when(kind == "quote", quote).otherwise(content)


def docx_type(style: Column, text: Column, mono: Column) -> Column:
    """struct(type, level) of a Word paragraph by its style, then its font, then its text."""
    s = F.lower(F.coalesce(style, F.lit("")))
    number = strip(F.replace(s, F.lit("heading"), F.lit("")))
    level = F.when(number.rlike(r"^\d{1,9}$"), F.greatest(F.lit(1), F.least(F.lit(6), number.cast("int")))).otherwise(2)
    kind = (
        F.when(s.startswith("heading"), "heading").when(F.contains(s, F.lit("title")), "heading").when(s.startswith("list"), "list_item")
        .when(s.rlike("|".join(rules.CODE_STYLES)) | mono, "code").when(F.contains(s, F.lit("quote")), "quote").when(is_math(text), "math").otherwise("paragraph")
    )
    lvl = F.when(s.startswith("heading"), level).when(F.contains(s, F.lit("title")), 1)
    return F.struct(kind.alias("type"), lvl.alias("level"))


def list_prefix(style: Column, text: Column) -> Column:
    n = F.regexp_extract(strip(text), r"^(\d+)[.)]", 1)
    return F.when(F.contains(F.lower(F.coalesce(style, F.lit(""))), F.lit("number")), F.when(n != "", F.concat(n, F.lit("."))).otherwise("1.")).otherwise("-")


def paragraphs_from_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, part_no, para_no, style, level, is_title, text, formatted, mono) of each paragraph of runs."""
    r = runs.withColumn("_md", run_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("font")))
    mono = F.avg(F.when(strip(F.col("text")) != "", is_mono_font(F.col("font"), rules.MONO_RUN_FONTS).cast("double")))
    return r.groupBy("doc_id", "part_no", "para_no").agg(
        F.first("style").alias("style"), F.first("level").alias("outline"), F.max("is_title").alias("is_title"),
        strip(ordered_join(["run_no"], "text", "")).alias("text"), ordered_join(["run_no"], "_md", "").alias("formatted"),
        F.coalesce(mono >= 0.8, F.lit(False)).alias("mono"))


def docx_sections(runs: DataFrame) -> DataFrame:
    """(doc_id, part_no, para_no, type, level, content, prefix, markdown) of Word paragraphs; empty ones are left out."""
    p = paragraphs_from_runs(runs).where("text <> ''")
    p = p.withColumn("t", docx_type(F.col("style"), F.col("text"), F.col("mono"))).select("*", "t.type", "t.level")
    prefix = F.when(F.col("type") == "list_item", list_prefix(F.col("style"), F.col("text")))
    content = F.when(F.col("type").isin("list_item", "paragraph"), F.col("formatted")).otherwise(F.col("text"))
    md = F.when(F.col("type") == "list_item", F.concat(prefix, F.lit(" "), F.col("formatted"))).otherwise(block_markdown(F.col("type"), F.col("level"), content))
    return p.select("doc_id", "part_no", "para_no", "type", "level", content.alias("content"), prefix.alias("prefix"), md.alias("markdown"))


def pptx_sections(runs: DataFrame) -> DataFrame:
    """The same for slides: part_no is the slide, from 1; each slide begins with a heading of its number."""
    p = paragraphs_from_runs(runs).where("text <> ''")
    lvl = F.coalesce("outline", F.lit(0))
    title = F.coalesce("is_title", F.lit(False)) & (lvl == 0)
    kind = F.when(title, "heading").when(lvl > 0, "list_item").when(is_math(F.col("formatted")), "math").otherwise("paragraph")
    f = F.col("formatted")
    md = F.when(title, F.concat(F.lit("### "), f)).when(lvl > 0, F.concat(F.repeat(F.lit("  "), (lvl - 1).cast("int")), F.lit("- "), f)).when(kind == "math", F.concat(F.lit("$"), f, F.lit("$"))).otherwise(f)
    body = p.select("doc_id", "part_no", "para_no", kind.alias("type"), F.when(title, 3).when(lvl > 0, lvl).alias("level"), f.alias("content"), F.lit(None).cast("string").alias("prefix"), md.alias("markdown"))
    name = F.concat(F.lit("Slide "), F.col("part_no").cast("string"))
    heads = runs.select("doc_id", "part_no").distinct().select("doc_id", "part_no", F.lit(-1).alias("para_no"), F.lit("heading").alias("type"), F.lit(2).alias("level"), name.alias("content"), F.lit(None).cast("string").alias("prefix"), F.concat(F.lit("## "), name).alias("markdown"))
    return heads.unionByName(body)


def ocr_paragraphs(docs: DataFrame, text: str = "ocr_text") -> DataFrame:
    """(doc_id, seq, type, level, content, markdown) of recognised text, cut at blank lines."""
    parts = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")).alias("seq", "content"))
    c = F.col("content")
    head = ~F.contains(c, F.lit("\n")) & (F.length(c) < 100) & c.rlike(r"^[\p{Lu}\p{Nd}]")
    kind = F.when(head, "heading").when(ocr_code(c), "code").when(is_math(c), "math").otherwise("paragraph")
    level = F.when(head, 3)
    return parts.select("doc_id", "seq", kind.alias("type"), level.alias("level"), "content", block_markdown(kind, level, c).alias("markdown"))


def ocr_code(text: Column) -> Column:
    """Weighted signs of code over the lines reach 0.4 for each line plus 2."""
    lines = F.split(text, "\n", -1)
    points = lambda x: sum(F.when(x.rlike(p), n).otherwise(0) for p, n in rules.OCR_CODE_POINTS)
    return F.aggregate(lines, F.lit(0), lambda acc, x: acc + points(x)) >= F.size(lines) * 0.4 + 2


def section_stats(sections: DataFrame) -> DataFrame:
    """(doc_id, total_sections, headings, paragraphs, tables, code_blocks, math_blocks) of each document."""
    n = lambda t: F.sum((F.col("type") == t).cast("bigint"))
    return sections.groupBy("doc_id").agg(
        F.count("*").alias("total_sections"), n("heading").alias("headings"), n("paragraph").alias("paragraphs"), n("table").alias("tables"),
        n("code").alias("code_blocks"), n("math").alias("math_blocks"))


def merge_paragraphs(sections: DataFrame) -> DataFrame:
    """Consecutive paragraphs of a document as one, their contents joined by line feeds."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    p = F.coalesce(F.col("type") == "paragraph", F.lit(False))
    begins = ~(p & F.coalesce(F.lag(p).over(w), F.lit(False)))
    grouped = sections.withColumn("_b", begins.cast("int")).withColumn("_g", F.sum("_b").over(w))
    return grouped.groupBy("doc_id", "_g").agg(F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), ordered_join(["seq"], "content", "\n").alias("content")).drop("_g")
