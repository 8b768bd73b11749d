"""Table operators.  A table has headers ARRAY<STRING> and rows ARRAY<ARRAY<STRING>>; a raw
table is a matrix ARRAY<ARRAY<STRING>>.  Null arrays count as empty, null cells as "".

What needs no order of tables is a Column; greedy removal of duplicates, which
depends on what was kept before, is a fold over the tables of one page or
document.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import rules
from paperloom.functions.text import strip

import pyarrow as pa

_KNOWN = ", ".join(f"'{w}'" for w in rules.KNOWN_SHORT)


def clean_cell(cell: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _rows(x: Column) -> Column:
    return F.transform(F.coalesce(x, F.array().cast("array<array<string>>")), _list)


def _plain(x: Column) -> Column:
    return F.transform(_list(x), lambda c: F.coalesce(c, F.lit("")))


def normalize(matrix: Column) -> Column:
    """struct(headers, rows) of a raw table: cells cleaned, empty rows gone, rows padded to the widest; null if nothing is left."""
    m = F.filter(F.transform(_rows(matrix), lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(m, lambda r: F.size(r))), F.lit(0))
    p = F.transform(m, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    head = F.get(p, F.lit(0))
    lone = (F.size(p) == 1) & (F.size(F.filter(head, lambda c: c != "")) < 2)
    return F.when((F.size(p) > 0) & ~lone, F.struct(head.alias("headers"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))).alias("rows")))


def facts(tables: DataFrame) -> DataFrame:
    """``tables`` with what the scores and checks look at, in columns that begin with an underscore."""
    t = tables.withColumn("_h", _plain(F.col("headers"))).withColumn("_r", F.transform(_rows(F.col("rows")), _plain))
    t = t.withColumn("_cells", F.concat("_h", F.flatten("_r"))).withColumn("_sizes", F.concat(F.array(F.size("_h")), F.transform("_r", lambda r: F.size(r))))
    t = t.withColumn("_text", F.filter(F.transform("_cells", strip), lambda c: c != ""))
    t = t.withColumn("_width", F.array_max("_sizes")).withColumn("_n", F.size("_r"))
    frag = F.expr(f"""size(filter(_text, c -> NOT c RLIKE '^[-+]?[0-9]+([.][0-9]+)?%?$' AND NOT lower(c) IN ({_KNOWN}) AND (
        c LIKE '%-' OR (c LIKE '-%' AND length(c) <= 4) OR c RLIKE '^[\\\\p{{Ll}}]{{1,3}}$' OR c RLIKE '^\\\\p{{Lu}}$'
        OR (c RLIKE '^\\\\p{{L}}{{2,4}}$' AND NOT lower(c) RLIKE '[aeiou]'))))""")
    t = t.withColumn("_frag", F.when(F.size("_text") == 0, 1.0).otherwise(frag / F.size("_text")))
    t = t.withColumn("_empty", F.when(F.size("_cells") == 0, 1.0).otherwise((F.size("_cells") - F.size("_text")) / F.size("_cells")))
    return t.withColumn("_fill", F.when(F.size("_cells") == 0, 0.0).otherwise(F.size(F.filter("_cells", lambda c: c != "")) / F.size("_cells")))


def without_facts(t: DataFrame) -> DataFrame:
    return t.drop("_h", "_r", "_cells", "_sizes", "_text", "_width", "_n", "_frag", "_empty", "_fill")


def score() -> Column:
    """The layout score over ``facts``: higher is better, -100 to -50 for tables that are none."""
    w, n = F.col("_width"), F.col("_n")
    columns = F.when(w.between(2, 8), w * 2.5).when(w == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 12.0 - (w - 8) * 1.5))
    even = 1.0 - (F.array_max("_sizes") - F.array_min("_sizes")) / F.greatest(w, F.lit(1))
    labels = F.size(F.filter("_h", lambda h: (F.length(h).between(1, 40) & F.contains(h, F.lit(" "))) | F.length(h).between(2, 24)))
    bonus = F.least(labels, w) * 0.5
    narrow = F.when((w == 1) & (n >= 2), 12.0 + F.least(n, F.lit(20)) * 0.5).otherwise(0.0)
    shredded = F.col("_frag") * F.when(w >= 6, 30.0).otherwise(10.0)
    hollow = F.when((w >= 8) & (F.col("_fill") < 0.40), 15.0).otherwise(0.0)
    total = columns + F.least(n, F.lit(40)) * 0.2 + even * 4.0 + F.col("_fill") * 8.0 + bonus - narrow - shredded - hollow
    return F.when(w == 0, -100.0).when(w >= 16, -80.0).when(F.col("_fill") < 0.15, -50.0).when((w >= 6) & (F.col("_frag") >= 0.45), -60.0).otherwise(total)


def prose_shred() -> Column:
    """Running text forced into columns: many cells that end inside a word, or many single letters."""
    k = F.size("_text")
    mid = F.size(F.filter("_text", lambda c: (F.length(c) >= 3) & c.rlike(r"\p{Ll}$") & ~F.contains(c, F.lit(" "))))
    tokens = F.filter(F.split(F.array_join("_text", " "), r"(?U)\s+"), lambda x: x != "")
    single = F.size(F.filter(tokens, lambda x: x.rlike(r"^\p{L}$")))
    return (F.col("_width") >= 6) & (k >= 8) & ((mid / F.greatest(k, F.lit(1)) >= 0.35) | (single / F.greatest(F.size(tokens), F.lit(1)) >= 0.25))


def garbage_reason(min_score: float = 8.0) -> Column:
    """Why a table is to be discarded: the first rule that says so, or null; over ``facts``."""
    w, n, e, f = F.col("_width"), F.col("_n"), F.col("_empty"), F.col("_frag")
    named = F.size(F.filter("_h", lambda h: strip(h) != ""))
    title, first = F.array_join("_h", " "), F.coalesce(F.array_join(F.get("_r", F.lit(0)), " "), F.lit(""))
    return (
        F.when((w == 0) | ((n == 0) & (named < 2)), "empty").when((w >= 12) & (n <= 4), "wide_short").when(w >= 18, "too_wide")
        .when((e >= 0.65) & (w >= 4), "hollow").when(e >= 0.80, "very_hollow")
        .when((f >= 0.25) & (w >= 8), "shredded_wide").when((f >= 0.38) & (w >= 5), "shredded").when(f >= 0.55, "fragments")
        .when(prose_shred(), "prose").when(title.rlike(r"(?:\b[A-Z]\b\s*){4,}"), "spaced_headers").when(first.rlike(r"(?:\b[A-Z]\b\s*){5,}"), "spaced_row")
        .when(score() < min_score, "low_score")
    )


def kept(tables: DataFrame, min_score: float = 8.0) -> DataFrame:
    return without_facts(facts(tables).where(garbage_reason(min_score).isNull()))


def quality(matrix: Column) -> Column:
    """0 to 1: filled cells, cells of some length, real headers, rows of full width; 0 below two rows."""
    m = F.transform(_rows(matrix), _plain)
    cells = F.flatten(m)
    total = F.greatest(F.size(cells), F.lit(1))
    fill = F.size(F.filter(cells, lambda c: strip(c) != "")) / total
    long = F.size(F.filter(cells, lambda c: F.length(strip(c)) > 2)) / total
    head = F.get(m, F.lit(0))
    real = F.when(F.size(head) > 0, real_headers(head) / F.size(head)).otherwise(0.0)
    widest = F.array_max(F.transform(m, lambda r: F.size(r)))
    full = F.size(F.filter(m, lambda r: F.size(r) == widest)) / F.greatest(F.size(m), F.lit(1))
    return F.when((F.size(m) < 2) | (F.size(cells) == 0), 0.0).otherwise(fill * 0.30 + long * 0.30 + real * 0.20 + full * 0.20)


def real_headers(head: Column) -> Column:
    return F.size(F.filter(head, lambda h: (F.length(strip(h)) > 2) & ~strip(h).rlike(r"^\p{Nd}+$")))


def garbled(text: Column) -> Column:
    """Too many words that no header usually has: more than a quarter, and two at least, of four or more."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]{2,})"), F.lit(1))
    common = F.array(*map(F.lit, rules.COMMON_WORDS))
    odd = F.filter(words, lambda w: ~F.array_contains(common, F.lower(w)) & ~F.lower(w).rlike("^ppm$") & ((F.length(w) <= 7) | ((w == F.upper(w)) & (F.length(w) <= 6))))
    return (F.size(words) >= 4) & (F.size(odd) >= 2) & (F.size(odd) / F.greatest(F.size(words), F.lit(1)) > 0.25)


def invalid_reason(matrix: Column, source: Column, min_score: float = 0.45) -> Column:
    """Why a raw table is not accepted from its source, or null."""
    m = F.transform(_rows(matrix), _plain)
    head, rest = F.get(m, F.lit(0)), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1)))
    family = F.substring_index(source, "-", 1)
    least = F.when(family == "pdfplumber", 0.65).when(family == "camelot", 0.50).otherwise(min_score)
    joined = lambda cells: F.array_join(F.transform(F.filter(cells, lambda c: c != ""), strip), " ")
    words = F.filter(F.split(joined(F.flatten(m)), r"(?U)\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: (F.length(w) <= 2) & ~w.rlike(r"^[±−+\d.]+$")))
    parts = F.concat(joined(F.flatten(rest)), F.lit(" "), joined(head))
    drawing = F.size(F.regexp_extract_all(parts, F.lit(r"(?iu)(\d+\.\d+mm|PIN\s*\d+|EXPOSE|PAD\b)"), F.lit(1)))
    content = F.size(F.filter(F.get(m, F.lit(1)), lambda c: F.length(strip(c)) > 1))
    n = real_headers(head)
    return (
        F.when(F.size(m) < 2, "too_small").when(quality(matrix) < least, "low_quality").when(n == 0, "no_header")
        .when(source.startswith("pdfplumber") & (n < 2), "few_headers").when(garbled(joined(head)), "garbled")
        .when((F.size(words) > 5) & (short / F.greatest(F.size(words), F.lit(1)) > 0.5), "short_words")
        .when((F.size(m) <= 2) & (F.size(head) <= 3) & (drawing >= 2), "drawing").when((content == 0) & (F.size(head) > 1), "empty_first_row")
    )


def repair_cells(matrix: Column) -> Column:
    """Null cells as "", and two broken subscripts put right."""
    fix = lambda c: F.regexp_replace(F.regexp_replace(c, r"\bP\s*\)", "P_OUT)"), r"\bT\s*A\b(?!≥|≤)", "T_A")
    return F.transform(_rows(matrix), lambda r: F.transform(_plain(r), fix))


def merge_headers(matrix: Column) -> Column:
    """struct(headers, rows): a first data row with more text than numbers joins the headers."""
    m = F.transform(_rows(matrix), _plain)
    head, first = F.get(m, F.lit(0)), F.get(m, F.lit(1))
    number = lambda c: strip(c).rlike(r"(?U)^[±−+\d.,\s°µ%VΩW]+$")
    inked = F.filter(first, lambda c: strip(c) != "")
    text = F.size(F.filter(inked, lambda c: ~number(c)))
    numbers = F.size(F.filter(inked, number))
    both = F.zip_with(head, F.slice(first, 1, F.size(head)), lambda a, b: F.when(F.coalesce(strip(b), F.lit("")) == "", a).when(strip(a) == "", b).otherwise(strip(F.concat_ws(" ", a, b))))
    merge = (F.size(m) >= 2) & (text > numbers)
    tail = lambda k: F.slice(m, k, F.greatest(F.size(m), F.lit(1)))
    none = F.array().cast("array<array<string>>")
    return F.struct(F.when(merge, both).otherwise(F.coalesce(head, F.array().cast("array<string>"))).alias("headers"), F.when(merge, tail(3)).when(F.size(m) > 0, tail(2)).otherwise(none).alias("rows"))


def drop_number_headers(matrix: Column) -> Column:
    """Without a first row whose cells, blank ones aside, are all whole numbers."""
    m = _rows(matrix)
    head = _plain(F.get(m, F.lit(0)))
    numbers = F.forall(head, lambda c: (strip(c) == "") | strip(c).rlike(r"^\d+$"))
    return F.when((F.size(m) >= 2) & numbers, F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(m)


def expand_rows(matrix: list[list[str]], min_common: int = 3) -> list[list[str]]:
    """Rows whose cells hold equally many lines become that many rows; further lines are lost."""
    if len(matrix) < 2:
        return matrix
    out = [matrix[0]]
    for row in matrix[1:]:
        counts = [c.count("\n") + 1 for c in row if c.strip()]
        # the first of equally frequent counts wins
        common = Counter(counts).most_common(1)[0][0] if counts else 0
        if common < min_common or sum(abs(n - common) <= 1 for n in counts) / len(counts) < 0.6:
            out.append(row)
            continue
        split = [c.split("\n") for c in row]
        out += [[s[k] if k < len(s) else "" for s in split] for k in range(common)]
    return out


def split_aligned_cell(cell: Column) -> Column:
    """A cell that holds several columns: at tabs, else at runs of blanks, else at bars."""
    s = strip(cell)
    return (
        F.when(cell == "", F.array(F.lit(""))).when(F.contains(cell, F.lit("\t")), F.transform(F.split(cell, "\t", -1), strip))
        .when(s.rlike(" {2,}"), F.split(s, " {2,}", -1)).when(F.contains(cell, F.lit(" | ")), F.transform(F.split(cell, r" \| ", -1), strip)).otherwise(F.array(s))
    )


def rebuild_column(headers: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]] | None:
    """A table of one column cut into the number of columns most of its cells agree on; None if they do not."""
    if max([len(headers), *map(len, rows)], default=0) != 1:
        return None
    head = headers[0] if headers else ""
    cut = [_aligned(c) for c in ([head] if head else []) + [r[0] if r else "" for r in rows]]
    many = [len(c) for c in cut if len(c) >= 2]
    if len(many) < max(2, len(cut) // 2):
        return None
    n = Counter(many).most_common(1)[0][0]
    full = [c[: n - 1] + [" ".join(c[n - 1 :])] if len(c) > n else c + [""] * (n - len(c)) for c in cut]
    return (full[0], full[1:]) if head else ([f"Col{i + 1}" for i in range(n)], full)


def _aligned(cell: str) -> list[str]:
    if "\t" in cell:
        return [p.strip() for p in cell.split("\t")]
    parts = re.split(" {2,}", cell.strip())
    return parts if len(parts) > 1 else [p.strip() for p in cell.split(" | ")] if " | " in cell else parts




def _udf(f, schema: str):
    return F.udf(f, schema, useArrow=True)


def expand_multiline(matrix: Column) -> Column:
    return _udf(lambda m: expand_rows([[c or "" for c in r or []] for r in m]) if m is not None else None, "array<array<string>>")(matrix)


def reconstruct(tables: DataFrame) -> DataFrame:
    """Tables of one column rebuilt where that raises the layout score."""

    def rebuilt(h, r):
        t = rebuild_column([c or "" for c in h or []], [[c or "" for c in x or []] for x in r or []])
        return None if t is None else {"headers": t[0], "rows": t[1]}

    names = tables.columns
    t = tables.withColumn("_new", _udf(rebuilt, "struct<headers: array<string>, rows: array<array<string>>>")(F.col("headers"), F.col("rows")))
    t = facts(t).withColumn("_old_score", score())
    new = facts(without_facts(t).withColumn("_headers", F.col("headers")).withColumn("_rows", F.col("rows")).withColumn("headers", F.col("_new.headers")).withColumn("rows", F.col("_new.rows"))).withColumn("_new_score", score())
    better = F.col("_new").isNotNull() & (F.col("_new_score") > F.col("_old_score"))
    out = new.withColumn("headers", F.when(better, F.col("headers")).otherwise(F.col("_headers"))).withColumn("rows", F.when(better, F.col("rows")).otherwise(F.col("_rows")))
    return out.select(*names)


def best_per(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The candidate of the highest layout score for each key, the first of equals; none below zero."""
    s = facts(candidates).withColumn("score", score())
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))
    return without_facts(s.withColumn("_nth", nth).where("_nth = 1 AND score >= 0").drop("_nth"))


def top_per(tables: DataFrame, keys: list[str], by: list, most: int = 6) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return tables.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def uncovered(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """``first`` and, for pages it has nothing on, the best of ``fallback``: by score, then order."""
    rest = fallback.join(first.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("score"), "table_no"))
    return first.unionByName(rest.withColumn("_nth", nth).where("_nth = 1").drop("_nth"))


def bboxes_overlap(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Whether the intersection is more than this share of the smaller box; false for null boxes."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = F.least((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    # least and greatest leave nulls out, so null boxes are named
    known = a.isNotNull() & b.isNotNull()
    for k in ("x0", "y0", "x1", "y1"):
        known = known & a[k].isNotNull() & b[k].isNotNull()
    return F.coalesce(known & (w > 0) & (h > 0) & (area > 0) & (w * h > threshold * area), F.lit(False))


def _signatures(rows: Column) -> Column:
    return F.array_distinct(F.transform(_rows(rows), lambda r: F.array_join(F.transform(_plain(r), F.lower), "|")))


def row_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of rows; 1 if both are empty."""
    x, y = _signatures(a), _signatures(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def same_table(ha: Column, ra: Column, hb: Column, rb: Column, threshold: float = 0.85) -> Column:
    """Equal headers, case and empty ones aside, and similar rows; a table without rows equals only another such."""
    low = lambda h: F.transform(_plain(h), F.lower)
    named = lambda h: F.filter(low(h), lambda x: x != "")
    heads = (low(ha) == low(hb)) | (named(ha) == named(hb))
    none = (F.size(_rows(ra)) == 0) | (F.size(_rows(rb)) == 0)
    return heads & F.when(none, (F.size(_rows(ra)) == 0) & (F.size(_rows(rb)) == 0)).otherwise(row_jaccard(ra, rb) >= threshold)


def word_overlap(a: Column, b: Column, stop: list[str] = ()) -> Column:
    """Common words of two lists of cells, as a share of the larger set of words; 0 if either is empty."""
    drop = F.array(*[F.lit(w) for w in (*stop, "")])
    words = lambda c: F.array_except(F.split(F.lower(F.array_join(F.transform(F.filter(_plain(c), lambda x: x != ""), strip), " ")), r"(?U)\s+"), drop)
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def same_extraction(ha: Column, ra: Column, hb: Column, rb: Column) -> Column:
    """Two extractors' views of one table of a page: about as many columns, and common words in the first row or the headers."""
    first = word_overlap(F.get(_rows(ra), F.lit(0)), F.get(_rows(rb), F.lit(0))) > 0.3
    heads = word_overlap(ha, hb, rules.HEADER_STOP_WORDS) > 0.3
    return (F.abs(F.size(_list(ha)) - F.size(_list(hb))) <= 1) & (F.coalesce(first, F.lit(False)) | F.coalesce(heads, F.lit(False)))


def page_pairs(tables: DataFrame) -> DataFrame:
    """(doc_id, page, a, b): each two tables of one page, a before b, as structs of all other columns."""
    rest = F.struct(*[c for c in tables.columns if c not in ("doc_id", "page")])
    x = tables.select("doc_id", "page", rest.alias("a"))
    return x.join(x.withColumnRenamed("a", "b"), ["doc_id", "page"]).where("a.table_no < b.table_no")


def dedupe_list(tables: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Without tables that repeat one kept before them in their document (order: page, table_no).

    The exact copies go first, by a window; what is left is folded per
    document, which is short.  Columns as given.
    """
    names = tables.columns
    order = [c for c in ("page", "table_no", "part_no", "para_no", "seq") if c in names]
    low = F.concat_ws("\x02", F.concat_ws("\x01", F.transform(_plain(F.col("headers")), F.lower)), F.concat_ws("\x03", F.transform(_rows(F.col("rows")), lambda r: F.concat_ws("\x01", F.transform(_plain(r), F.lower)))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_sig").orderBy(*order))
    t = tables.withColumn("_sig", F.sha2(low, 256)).withColumn("_nth", nth).where("_nth = 1").drop("_sig", "_nth")
    schema = t.schema

    def fold(x: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        take = []
        rows = x.to_pylist()
        for i in sorted(range(len(rows)), key=lambda i: tuple(rows[i][c] for c in order)):
            heads = [(h or "").lower() for h in rows[i]["headers"] or []]
            sig = {"|".join((c or "").lower() for c in r or []) for r in rows[i]["rows"] or []}
            me = (heads, [h for h in heads if h], sig)
            if not any((me[0] == k[0] or me[1] == k[1]) and (bool(sig) == bool(k[2])) and (not sig or len(sig & k[2]) >= threshold * len(sig | k[2])) for k in kept):
                kept.append(me)
                take.append(i)
        return x.take(sorted(take))

    return t.groupBy("doc_id").applyInArrow(fold, schema)


def merge_extractors(tables: DataFrame) -> DataFrame:
    """Per page, of tables that are one (by words, else by place) the one worth more; the one before wins a tie.

    ``tables`` has doc_id, page, table_no (the order of the passes), headers,
    rows, bbox, score.  Worth is rows times score for equal words, columns
    times score for equal places.
    """
    schema = tables.schema

    def words(cells, stop=()):
        return set(" ".join((c or "").strip().lower() for c in cells or [] if c).split()) - set(stop)

    def alike(a, b):
        if abs(len(a["headers"] or []) - len(b["headers"] or [])) > 1:
            return False
        pairs = [(words(a["headers"], rules.HEADER_STOP_WORDS), words(b["headers"], rules.HEADER_STOP_WORDS))]
        if a["rows"] and b["rows"]:
            pairs.append((words(a["rows"][0]), words(b["rows"][0])))
        return any(x and y and len(x & y) / max(len(x), len(y)) > 0.3 for x, y in pairs)

    def over(a, b):
        p, q = a["bbox"], b["bbox"]
        if not p or not q or None in (*p.values(), *q.values()):
            return False
        w, h = min(p["x1"], q["x1"]) - max(p["x0"], q["x0"]), min(p["y1"], q["y1"]) - max(p["y0"], q["y0"])
        area = min((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (p, q))
        return w > 0 and h > 0 and area > 0 and w * h > 0.5 * area

    def fold(x: pa.Table) -> pa.Table:
        rows = x.to_pylist()
        have: list[int] = []
        for i in sorted(range(len(rows)), key=lambda i: rows[i]["table_no"]):
            me, out = rows[i], None
            for j in have:
                what = "rows" if alike(me, rows[j]) else "headers" if over(me, rows[j]) else None
                if what:
                    worth = [len(r[what] or []) * (r["score"] or 0.0) for r in (me, rows[j])]
                    out = j if worth[0] > worth[1] else -1
                    break
            if out is None or out >= 0:
                have = [j for j in have if j != out] + [i]
        return x.take(have)

    return tables.groupBy("doc_id", "page").applyInArrow(fold, schema)


def in_reading_order(tables: DataFrame) -> DataFrame:
    """``tables`` with ``place``, their number in their document from 1: by page, then from the top; no place counts as the top."""
    order = Window.partitionBy("doc_id").orderBy("page", F.coalesce(F.col("bbox.y0"), F.lit(0.0)), "table_no")
    return tables.withColumn("place", F.row_number().over(order))


def _cell_text(c: Column) -> Column:
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def table_markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; rows are padded to the widest, line feeds in cells become blanks.  "" for no table at all."""
    h, r = _list(headers), _rows(rows)
    width = F.greatest(F.size(h), F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0)))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(x, _cell_text), F.array_repeat(F.lit(""), width - F.size(x))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    return F.when((F.size(h) == 0) & (F.size(r) == 0), "").otherwise(F.array_join(F.concat(F.array(line(h), rule), F.transform(r, line)), "\n"))


def table_json(headers: Column, rows: Column) -> Column:
    """struct(type, headers, rows) with the same cleaning of cells and no padding."""
    return F.struct(F.lit("table").alias("type"), F.transform(_list(headers), _cell_text).alias("headers"), F.transform(_rows(rows), lambda r: F.transform(r, _cell_text)).alias("rows"))


def first_row_headers(matrix: Column) -> Column:
    """struct(headers, rows) of a Word or slide table: its first row is the header."""
    m = F.transform(_rows(matrix), lambda r: F.transform(r, _cell_text))
    return F.struct(F.coalesce(F.get(m, F.lit(0)), F.array().cast("array<string>")).alias("headers"), F.when(F.size(m) > 1, F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(F.array().cast("array<array<string>>")).alias("rows"))


def accept(raw: DataFrame) -> DataFrame:
    """Raw tables (matrix, source, …) through checks and repairs: headers, rows, score; refused ones are gone.

    The score is that of the table before headers are merged and rows expanded.
    """
    plain = F.transform(_rows(F.col("matrix")), _plain)
    t = raw.withColumn("matrix", F.when(F.col("source").startswith("camelot"), drop_number_headers(plain)).otherwise(plain))
    t = t.where(invalid_reason(F.col("matrix"), F.col("source")).isNull()).withColumn("score", quality(F.col("matrix")))
    t = t.withColumn("_m", merge_headers(repair_cells(F.col("matrix"))))
    t = t.withColumn("_full", expand_multiline(F.concat(F.array(F.col("_m.headers")), F.col("_m.rows"))))
    return t.withColumn("headers", F.get("_full", F.lit(0))).withColumn("rows", F.slice("_full", 2, F.greatest(F.size("_full"), F.lit(1)))).drop("_m", "_full", "matrix")


def vetted(raw: DataFrame) -> DataFrame:
    """Raw tables of all passes as the tables of their pages: (doc_id, page, table_no, bbox, headers, rows, source, score).

    Accepted tables of the first passes are merged per page; tables found by a
    text strategy (source pdfplumber) count only on pages without any, the best
    one of each page, the first of equals.
    """
    t = accept(raw).select("doc_id", "page", "table_no", "source", "bbox", "headers", "rows", "score")
    late = F.col("source").startswith("pdfplumber")
    return uncovered(merge_extractors(t.where(~late)), t.where(late))


def ocr_rows(words: DataFrame, tolerance: int = 10) -> DataFrame:
    """(doc_id, row_no, words): words whose top is within ``tolerance`` of the first word of their row, from left to right."""
    sorted_ = F.array_sort(F.collect_list(F.struct("y", "x", "word_no", "text")))
    by = words.where(strip(F.col("text")) != "").groupBy("doc_id").agg(sorted_.alias("w"))
    folded = F.expr(
        "aggregate(w, named_struct('anchor', -2147483648L, 'row', -1, 'out', cast(array() as array<struct<row:int,x:int,word_no:int,text:string>>)), "
        f"(a, v) -> named_struct('anchor', if(abs(v.y - a.anchor) <= {tolerance}, a.anchor, cast(v.y as bigint)), "
        f"'row', if(abs(v.y - a.anchor) <= {tolerance}, a.row, a.row + 1), "
        f"'out', concat(a.out, array(named_struct('row', if(abs(v.y - a.anchor) <= {tolerance}, a.row, a.row + 1), 'x', v.x, 'word_no', v.word_no, 'text', trim(v.text))))), a -> a.out)"
    )
    flat = by.select("doc_id", F.inline(folded))
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))), lambda v: v["text"])
    return flat.groupBy("doc_id", F.col("row").alias("row_no")).agg(line.alias("words"))


def ocr_tables(words: DataFrame) -> DataFrame:
    """(doc_id, headers, rows): all rows of a page of six words or more, if half of its rows are about as long as the longest."""
    enough = words.where(strip(F.col("text")) != "").groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 6").select("doc_id")
    r = ocr_rows(words.join(enough, "doc_id", "left_semi")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "words"))), lambda x: x["words"]).alias("m"))
    longest = F.array_max(F.transform("m", lambda x: F.size(x)))
    even = F.size(F.filter("m", lambda x: (F.size(x) >= 2) & (F.size(x) >= longest - 1)))
    return r.where((F.size("m") >= 2) & (longest >= 2) & (even >= F.size("m") * 0.5)).select("doc_id", F.get("m", F.lit(0)).alias("headers"), F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))).alias("rows"))
