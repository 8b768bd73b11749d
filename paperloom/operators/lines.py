"""Filters on lines.  A line is a row (doc_id, line_no, line); null documents have no lines.

The order of the rules carries meaning: page numbers go before repeats are
counted, runs are collapsed after artifact lines are gone.  Rules that look at
one line only are Columns; the others use windows on doc_id, so one shuffle by
doc_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import rules
from paperloom.functions.text import any_of, collapse_newlines, strip
from paperloom.operators import tables


def explode_lines(docs: DataFrame, text: str = "markdown") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def assemble(lines: DataFrame, text: str = "markdown") -> DataFrame:
    """Lines back to one text per document, in the order of line_no."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias(text))


def is_page_number(line: Column) -> Column:
    return line.rlike(any_of(rules.PAGE_NUMBER))


def is_structural(line: Column) -> Column:
    return line.rlike("|".join(rules.STRUCTURAL))


def is_artifact(line: Column) -> Column:
    s = strip(line)
    return s.rlike(any_of(rules.ARTIFACT_ANY_CASE)) | s.rlike("|".join(rules.ARTIFACT_THIS_CASE))


def is_leader(line: Column) -> Column:
    return line.rlike(rules.LEADER_DOTS)


def is_chrome(line: Column) -> Column:
    return strip(line).rlike(any_of(rules.CHROME))


def looks_like_patent_print(text: Column) -> Column:
    """At least two of the signs of a printed patent page."""
    low = F.lower(text)
    return sum(F.contains(low, F.lit(s.lower())).cast("int") for s in rules.PATENT_PRINT) >= 2


def drop_repeated(lines: DataFrame, threshold: int = 2) -> DataFrame:
    """Without every copy of short lines that occur ``threshold`` times in their document, structural lines aside."""
    s = strip(F.col("line"))
    n = F.count("*").over(Window.partitionBy("doc_id", "line"))
    counted = lines.withColumn("n_copies", n)
    gone = (F.col("n_copies") >= threshold) & (F.length(s) < 100) & (s != "") & ~is_structural(s)
    return counted.where(~gone).drop("n_copies")


def collapse_runs(lines: DataFrame) -> DataFrame:
    """Without lines equal, blanks aside, to the line before; a blank line ends a run, structural lines stay."""
    s = strip(F.col("line"))
    before = F.lag(s).over(Window.partitionBy("doc_id").orderBy("line_no"))
    marked = lines.withColumn("before", before)
    return marked.where(~((s != "") & F.coalesce(s == F.col("before"), F.lit(False)) & ~is_structural(s))).drop("before")


def drop_reason(line: Column) -> Column:
    """The first single-line rule that drops a line, or null."""
    return F.when(is_page_number(line), "page_number").when(is_artifact(line), "artifact").when(is_leader(line), "leader_dots")


def tagged(lines: DataFrame, threshold: int = 2) -> DataFrame:
    """Lines with ``reason``: the first rule that drops each, page_number, repeated, artifact, leader_dots or run; null if it stays.

    All rules in one shuffle by doc_id: a line's copies, and the line before it
    that was left, are windows on the same partitions.  Repeats are counted
    after page numbers are gone, runs after all else is.
    """
    s = strip(F.col("line"))
    t = lines.repartition("doc_id").withColumn("_one", drop_reason(F.col("line")))
    # page numbers are not counted, so they form groups of their own
    number = F.coalesce(F.col("_one") == "page_number", F.lit(False))
    n = F.count("*").over(Window.partitionBy("doc_id", "line", number))
    t = t.withColumn("_n", n)
    many = (F.col("_n") >= threshold) & (F.length(s) < 100) & (s != "") & ~is_structural(s)
    t = t.withColumn("_why", F.when(number, "page_number").when(many, "repeated").otherwise(F.col("_one")))
    left = F.when(F.col("_why").isNull(), s)
    before = F.last(left, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    run = (s != "") & F.coalesce(s == before, F.lit(False)) & ~is_structural(s)
    return t.withColumn("reason", F.coalesce("_why", F.when(run, "run"))).drop("_one", "_n", "_why")


def table_blocks(lines: DataFrame, second_bar: bool = False) -> DataFrame:
    """Lines with ``is_row`` and ``block``, a number that all lines of one run of table lines share."""
    s = strip(F.col("line"))
    row = s.startswith("|") & (F.instr(s.substr(F.lit(2), F.length(s)), "|") > 0 if second_bar else F.lit(True))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("is_row", row).withColumn("block", F.sum((~row).cast("int")).over(w))


def drop_table_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~strip(F.col("line")).startswith("|"))


def drop_garbage_tables(lines: DataFrame) -> DataFrame:
    """Lines without the Markdown tables that are none: (doc_id, line_no, line).

    A block of table lines is read into cells, rules left out.  A block of one
    row goes by its width and fragments, another by what ``tables.garbage_reason``
    says, and one of rules only goes.  Other lines stay as they are.
    """
    marked = table_blocks(lines)
    s = strip(F.col("line"))
    cells = F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|", -1), strip)
    row = F.when(~s.rlike(r"(?U)^\|[\s\-:|]+\|$"), cells)
    m = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("cells")))), lambda x: x["cells"]), lambda x: x.isNotNull())
    blocks = marked.where("is_row").groupBy("doc_id", "block").agg(m.alias("m"))
    t = tables.facts(blocks.select("doc_id", "block", "m", F.coalesce(F.get("m", F.lit(0)), F.array().cast("array<string>")).alias("headers"), F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))).alias("rows")))
    width, shards = F.size("headers"), F.round(F.col("_frag") * F.size("_text"))
    lone = (width >= 6) | (shards >= F.greatest(F.lit(2), F.floor(width / 3))) | ((width >= 4) & (shards >= 2))
    gone = F.when(F.size("m") == 0, F.lit(True)).when(F.size("m") == 1, lone).otherwise(tables.garbage_reason().isNotNull())
    bad = t.where(gone).select("doc_id", "block", F.lit(True).alias("is_row"))
    return marked.join(bad, ["doc_id", "block", "is_row"], "left_anti").select("doc_id", "line_no", "line")


def table_offsets(lines: DataFrame) -> DataFrame:
    """(doc_id, table_no, start, end): where the Markdown tables of each text lie, as character offsets."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    b = table_blocks(at, second_bar=True).where("is_row")
    t = b.groupBy("doc_id", "block").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.length("line")).alias("end"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return t.select("doc_id", no.cast("int").alias("table_no"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def dedupe_tables(docs: DataFrame, text: str = "markdown", gap: str = r"\n{2,}") -> DataFrame:
    """Texts in which the second and later copies of a table block are gone; the gaps around them stay."""
    marked = F.regexp_replace(F.col(text), f"({gap})", "\x01$1\x01")
    parts = docs.select("doc_id", F.posexplode(F.split(marked, "\x01", -1)).alias("line_no", "line"))
    table = F.col("line").startswith("|") & F.contains(F.col("line"), F.lit("\n|"))
    sig = F.md5(F.lower(F.regexp_replace(strip(F.col("line")), r"\s+", " ")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("line_no"))
    kept = parts.withColumn("sig", F.when(table, sig).otherwise(F.col("line_no").cast("string"))).withColumn("nth", nth).where("nth = 1")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return kept.groupBy("doc_id").agg(whole.alias(text))


def remove_artifacts(docs: DataFrame, text: str = "markdown", min_repetition: int = 2) -> DataFrame:
    """All line rules in their order, then repeated tables, then blank lines: (doc_id, text)."""
    x = docs.select("doc_id", F.col(text).alias("markdown")).where("markdown IS NOT NULL")
    # every document has a line, so one of which none is left comes back as an empty text
    kept = F.when(F.col("reason").isNull(), F.struct("line_no", "line"))
    parts = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"])
    made = tagged(explode_lines(x), min_repetition).groupBy("doc_id").agg(F.array_join(parts, "\n").alias("markdown"))
    made = dedupe_tables(made)
    return made.select("doc_id", collapse_newlines(F.col("markdown")).alias(text))


def is_noise_section(kind: Column, content: Column, label: Column) -> Column:
    """Code that is no code, and paragraphs of single letters; ``label`` says whether it looks like a drawing label."""
    c = strip(content)
    n = F.length(c)
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    signs = F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]", ""))
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    mostly = (F.size(words) > 0) & (single / F.greatest(F.size(words), F.lit(1)) >= 0.5)
    code = label | ((n < 15) & (alnum / F.greatest(n, F.lit(1)) < 0.5)) | ((n < 40) & mostly) | ((n > 0) & (signs / F.greatest(n, F.lit(1)) > 0.6) & (n < 100))
    return F.when(kind == "code", code).when(kind == "paragraph", label & mostly).otherwise(F.lit(False))


def is_section_artifact(kind: Column, content: Column) -> Column:
    """Paragraphs that are empty, a number, or one of three marks."""
    c = strip(F.coalesce(content, F.lit("")))
    return (kind == "paragraph") & ((c == "") | c.rlike(r"(?U)^\s*\d+\s*$") | c.rlike(r"(?i)^\s*(draft|confidential|watermark)\s*$"))
