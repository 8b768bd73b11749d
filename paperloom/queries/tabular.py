"""Queries on tables.  The SQL side works on unnested cells wherever it can, not on nested lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions import rules
from paperloom.functions.text import strip
from paperloom.operators import tables as tb
from paperloom.queries.document import s
from paperloom.session import table

KEY = ["doc_id", "page", "table_no"]


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_tables").distinct()


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw matrices: headers above rows; each third table gets a first row of column numbers, as one extractor gives."""
    t = _tables(spark, d)
    m = F.concat(F.array("headers"), F.coalesce("rows", F.array().cast("array<array<string>>")))
    numbers = F.array(F.transform("headers", lambda h, i: i.cast("string")))
    return t.select(*KEY, "source", "bbox", F.when(F.col("table_no") == 2, F.concat(numbers, m)).otherwise(m).alias("matrix"))


# Cells in rows of their own: row 0 is the header, from row 1 the body.
CELLS = """t AS (SELECT DISTINCT * FROM extracted_tables),
 r AS (SELECT doc_id, page, table_no, 0 AS row_no, headers AS cs FROM t UNION ALL SELECT doc_id, page, table_no, CAST(generate_subscripts(rows, 1) AS INT), unnest(rows) FROM t),
 c AS (SELECT doc_id, page, table_no, row_no, CAST(generate_subscripts(cs, 1) AS INT) AS col_no, coalesce(unnest(cs), '') AS cell FROM r)"""
RAW = """t0 AS (SELECT DISTINCT * FROM extracted_tables),
 raw AS (SELECT doc_id, page, table_no, source, bbox, CASE WHEN table_no = 2 THEN list_concat([list_transform(headers, lambda h, i: CAST(i - 1 AS VARCHAR))], m) ELSE m END AS matrix FROM (SELECT *, list_concat([headers], coalesce(rows, [])) AS m FROM t0)),
 rr AS (SELECT doc_id, page, table_no, source, CAST(generate_subscripts(matrix, 1) - 1 AS INT) AS row_no, unnest(matrix) AS cs FROM raw),
 c AS (SELECT doc_id, page, table_no, source, row_no, CAST(generate_subscripts(cs, 1) AS INT) AS col_no, coalesce(unnest(cs), '') AS cell FROM rr)"""
_S = s("cell")
_SHORT = ", ".join(f"'{w}'" for w in rules.KNOWN_SHORT)
_FRAG = f"""({_S} <> '' AND NOT regexp_matches({_S}, '^[-+]?[0-9]+(\\.[0-9]+)?%?$') AND lower({_S}) NOT IN ({_SHORT}) AND ({_S} LIKE '%-' OR ({_S} LIKE '-%' AND length({_S}) <= 4)
 OR regexp_matches({_S}, '^\\p{{Ll}}{{1,3}}$') OR regexp_matches({_S}, '^\\p{{Lu}}$') OR (regexp_matches({_S}, '^\\pL{{2,4}}$') AND NOT regexp_matches(lower({_S}), '[aeiou]'))))"""
FACTS = f"""{CELLS},
 sizes AS (SELECT doc_id, page, table_no, max(len(cs)) AS width, min(len(cs)) AS least, count(*) - 1 AS n FROM r GROUP BY ALL),
 f AS (SELECT doc_id, page, table_no, count(*) AS cells, count(*) FILTER ({_S} <> '') AS inked, count(*) FILTER (cell <> '') AS truthy, count(*) FILTER ({_FRAG}) AS frags,
   count(*) FILTER (row_no = 0 AND ((length(cell) BETWEEN 1 AND 40 AND contains(cell, ' ')) OR length(cell) BETWEEN 2 AND 24)) AS labels, count(*) FILTER (row_no = 0 AND {_S} <> '') AS named,
   count(*) FILTER (length({_S}) >= 3 AND regexp_matches({_S}, '\\p{{Ll}}$') AND NOT contains({_S}, ' ')) AS mid,
   list_filter(string_split_regex(string_agg(CASE WHEN {_S} <> '' THEN {_S} END, ' ' ORDER BY row_no, col_no), '[\\s\\pZ]+'), lambda w: w <> '') AS tokens,
   string_agg(CASE WHEN row_no = 0 THEN cell END, ' ' ORDER BY col_no) AS title, coalesce(string_agg(CASE WHEN row_no = 1 THEN cell END, ' ' ORDER BY col_no), '') AS first_row FROM c GROUP BY ALL),
 facts AS (SELECT *, CASE WHEN inked = 0 THEN 1.0 ELSE frags::DOUBLE / inked END AS frag, CASE WHEN cells = 0 THEN 1.0 ELSE (cells - inked)::DOUBLE / cells END AS empty, CASE WHEN cells = 0 THEN 0.0 ELSE truthy::DOUBLE / cells END AS fill FROM sizes JOIN f USING (doc_id, page, table_no)),
 scored AS (SELECT *, CASE WHEN width = 0 THEN -100.0 WHEN width >= 16 THEN -80.0 WHEN fill < 0.15 THEN -50.0 WHEN width >= 6 AND frag >= 0.45 THEN -60.0 ELSE
   (CASE WHEN width BETWEEN 2 AND 8 THEN width * 2.5 WHEN width = 1 THEN 1.0 ELSE greatest(0.0, 12.0 - (width - 8) * 1.5) END) + least(n, 40) * 0.2 + (1.0 - (width - least)::DOUBLE / greatest(width, 1)) * 4.0 + fill * 8.0 + least(labels, width) * 0.5
   - (CASE WHEN width = 1 AND n >= 2 THEN 12.0 + least(n, 20) * 0.5 ELSE 0.0 END) - frag * (CASE WHEN width >= 6 THEN 30.0 ELSE 10.0 END) - (CASE WHEN width >= 8 AND fill < 0.40 THEN 15.0 ELSE 0.0 END) END AS score,
   width >= 6 AND inked >= 8 AND (mid::DOUBLE / inked >= 0.35 OR len(list_filter(tokens, lambda w: regexp_matches(w, '^\\pL$')))::DOUBLE / greatest(len(tokens), 1) >= 0.25) AS prose FROM facts)"""
_REASON = """CASE WHEN width = 0 OR (n = 0 AND named < 2) THEN 'empty' WHEN width >= 12 AND n <= 4 THEN 'wide_short' WHEN width >= 18 THEN 'too_wide' WHEN empty >= 0.65 AND width >= 4 THEN 'hollow' WHEN empty >= 0.80 THEN 'very_hollow'
 WHEN frag >= 0.25 AND width >= 8 THEN 'shredded_wide' WHEN frag >= 0.38 AND width >= 5 THEN 'shredded' WHEN frag >= 0.55 THEN 'fragments' WHEN prose THEN 'prose' WHEN regexp_matches(title, '(?:\\b[A-Z]\\b\\s*){4,}') THEN 'spaced_headers'
 WHEN regexp_matches(first_row, '(?:\\b[A-Z]\\b\\s*){5,}') THEN 'spaced_row' WHEN score < 8.0 THEN 'low_score' END"""
_ROUND = "CAST(round({x}, 6) AS DOUBLE)"
_QUALITY = f"""widths AS (SELECT doc_id, page, table_no, source, count(*) AS n_rows, max(len(cs)) AS widest FROM rr GROUP BY ALL),
 full_rows AS (SELECT doc_id, page, table_no, count(*) AS full_n FROM rr JOIN widths USING (doc_id, page, table_no) WHERE len(cs) = widest GROUP BY ALL),
 qq AS (SELECT doc_id, page, table_no, count(*) AS cells, count(*) FILTER ({_S} <> '') AS filled, count(*) FILTER (length({_S}) > 2) AS long, count(*) FILTER (row_no = 0) AS heads,
   count(*) FILTER (row_no = 0 AND length({_S}) > 2 AND NOT regexp_matches({_S}, '^\\pN+$')) AS real FROM c GROUP BY ALL),
 quality AS (SELECT *, CASE WHEN n_rows < 2 OR cells = 0 THEN 0.0 ELSE filled::DOUBLE / cells * 0.30 + long::DOUBLE / cells * 0.30 + (CASE WHEN heads > 0 THEN real::DOUBLE / heads ELSE 0.0 END) * 0.20 + full_n::DOUBLE / n_rows * 0.20 END AS quality FROM widths JOIN full_rows USING (doc_id, page, table_no) JOIN qq USING (doc_id, page, table_no))"""
_COMMON = ", ".join(f"'{w}'" for w in rules.COMMON_WORDS)


def _garbled(x: str) -> str:
    words = f"regexp_extract_all({x}, '[A-Za-z]{{2,}}')"
    odd = f"len(list_filter({words}, lambda w: lower(w) NOT IN ({_COMMON}) AND lower(w) <> 'ppm' AND (length(w) <= 7 OR (w = upper(w) AND length(w) <= 6))))"
    return f"(len({words}) >= 4 AND {odd} >= 2 AND {odd}::DOUBLE / greatest(len({words}), 1) > 0.25)"


def _normal(spark, d):
    t = _raw(spark, d).select(*KEY, tb.normalize(F.col("matrix")).alias("t")).where("t IS NOT NULL")
    return t.select(*KEY, F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


_CLEAN = f"regexp_replace({s('regexp_replace(cell, {0}, {1}, {2})'.format(chr(39) + '[' + chr(92) + 's' + chr(92) + 'pZ' + chr(92) + 'x{85}]+' + chr(39), chr(39) + ' ' + chr(39), chr(39) + 'g' + chr(39)))}, '', '')"
_NORMAL = f"""WITH {RAW}, k AS (SELECT doc_id, page, table_no, row_no, col_no, {_CLEAN} AS cell FROM c), w AS (SELECT doc_id, page, table_no, row_no FROM k WHERE cell <> '' GROUP BY ALL),
 kept AS (SELECT k.*, dense_rank() OVER (PARTITION BY doc_id, page, table_no ORDER BY row_no) AS nth FROM k JOIN w USING (doc_id, page, table_no, row_no)),
 size AS (SELECT doc_id, page, table_no, max(col_no) AS width, max(nth) AS n, count(*) FILTER (nth = 1 AND cell <> '') AS named FROM kept GROUP BY ALL),
 line AS (SELECT doc_id, page, table_no, nth, string_agg(cell, '|' ORDER BY col_no) || repeat('|', CAST(any_value(width) - max(col_no) AS INT)) AS l FROM kept JOIN size USING (doc_id, page, table_no) WHERE NOT (n = 1 AND named < 2) GROUP BY ALL)
 SELECT doc_id, page, table_no, max(CASE WHEN nth = 1 THEN l END) AS headers, coalesce(string_agg(CASE WHEN nth > 1 THEN l END, chr(10) ORDER BY nth), '') AS rows FROM line GROUP BY ALL"""


def _reason(spark, d):
    return tb.facts(_tables(spark, d)).select(*KEY, tb.garbage_reason().alias("reason"))


def _valid(spark, d):
    return _raw(spark, d).select(*KEY, "source", tb.invalid_reason(F.col("matrix"), F.col("source")).alias("reason"))


_JOIN = "coalesce(string_agg(CASE WHEN {w} AND cell <> '' THEN " + _S + " END, ' ' ORDER BY row_no, col_no), '')"
_VALID = f"""WITH {RAW}, {_QUALITY}, txt AS (SELECT doc_id, page, table_no, {_JOIN.replace('{w}', 'row_no = 0')} AS head_text, {_JOIN.replace('{w}', 'true')} AS all_text, {_JOIN.replace('{w}', 'row_no > 0')} AS body_text, count(*) FILTER (row_no = 1 AND length({_S}) > 1) AS content FROM c GROUP BY ALL),
 v AS (SELECT *, list_filter(string_split_regex(all_text, '[\\s\\pZ]+'), lambda w: w <> '') AS ws FROM quality JOIN txt USING (doc_id, page, table_no))
 SELECT doc_id, page, table_no, source, CASE WHEN n_rows < 2 THEN 'too_small' WHEN quality < CASE string_split(source, '-')[1] WHEN 'pdfplumber' THEN 0.65 WHEN 'camelot' THEN 0.5 ELSE 0.45 END THEN 'low_quality' WHEN real = 0 THEN 'no_header' WHEN source LIKE 'pdfplumber%' AND real < 2 THEN 'few_headers'
  WHEN {_garbled('head_text')} THEN 'garbled' WHEN len(ws) > 5 AND len(list_filter(ws, lambda w: length(w) <= 2 AND NOT regexp_matches(w, '^[±−+\\d.]+$')))::DOUBLE / greatest(len(ws), 1) > 0.5 THEN 'short_words'
  WHEN n_rows <= 2 AND heads <= 3 AND len(regexp_extract_all(body_text || ' ' || head_text, '(?i)(\\d+\\.\\d+mm|PIN\\s*\\d+|EXPOSE|PAD\\b)')) >= 2 THEN 'drawing' WHEN content = 0 AND heads > 1 THEN 'empty_first_row' END AS reason FROM v"""


def _merged(spark, d):
    t = _raw(spark, d).select(*KEY, tb.merge_headers(F.col("matrix")).alias("t"))
    return t.select(*KEY, F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").cast("bigint").alias("n_rows"))


_NUM = "regexp_matches({x}, '^[±−+\\d.,\\s°µ%VΩW]+$')".replace("{x}", _S)
_MERGED = f"""WITH {RAW}, k AS (SELECT doc_id, page, table_no, count(*) FILTER (row_no = 1 AND {_S} <> '' AND NOT {_NUM}) AS txt, count(*) FILTER (row_no = 1 AND {_S} <> '' AND {_NUM}) AS num FROM c GROUP BY ALL),
 n AS (SELECT doc_id, page, table_no, count(*) AS n FROM rr GROUP BY ALL), h AS (SELECT a.doc_id, a.page, a.table_no, a.col_no, a.cell AS a, b.cell AS b FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.page = b.page AND a.table_no = b.table_no AND a.col_no = b.col_no AND b.row_no = 1 WHERE a.row_no = 0)
 SELECT doc_id, page, table_no, string_agg(CASE WHEN txt > num AND coalesce({s('b')}, '') <> '' THEN CASE WHEN {s('a')} = '' THEN b ELSE {s("(a || ' ' || b)")} END ELSE a END, '|' ORDER BY col_no) AS headers, CAST(any_value(n) - 1 - CASE WHEN any_value(txt > num) THEN 1 ELSE 0 END AS BIGINT) AS n_rows
 FROM h JOIN k USING (doc_id, page, table_no) JOIN n USING (doc_id, page, table_no) GROUP BY doc_id, page, table_no"""


def _pairs(spark, d):
    t = _tables(spark, d).select("doc_id", "page", "table_no", "headers", "rows", "bbox")
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.table_no") < F.col("b.table_no")))


def _bbox_pairs(spark, d):
    near = F.struct(*[(F.col(f"b.bbox.{k}") + (F.col("a.bbox.x0") - F.col("b.bbox.x0")) * 0.5).alias(k) if k[0] == "x" else (F.col(f"b.bbox.{k}") + (F.col("a.bbox.y0") - F.col("b.bbox.y0")) * 0.9).alias(k) for k in ("x0", "y0", "x1", "y1")])
    p = _pairs(spark, d).select(F.col("a.doc_id").alias("doc_id"), F.col("a.table_no").alias("table_a"), F.col("b.table_no").alias("table_b"), F.col("a.bbox").alias("p"), near.alias("r"))
    return p.select("doc_id", "table_a", "table_b", tb.bboxes_overlap(F.col("p"), F.when(F.col("p").isNotNull() & F.col("r.x0").isNotNull(), F.col("r"))).alias("overlap"))


_PAIRS = "t AS (SELECT DISTINCT doc_id, page, table_no, headers, rows, bbox FROM extracted_tables), p AS (SELECT a.doc_id, a.table_no AS table_a, b.table_no AS table_b, a.headers AS ha, b.headers AS hb, a.rows AS ra, b.rows AS rb, a.bbox AS p, b.bbox AS o FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.table_no < b.table_no)"
_BBOX = f"""WITH {_PAIRS}, m AS (SELECT *, o.x0 + (p.x0 - o.x0) * 0.5 AS x0, o.y0 + (p.y0 - o.y0) * 0.9 AS y0, o.x1 + (p.x0 - o.x0) * 0.5 AS x1, o.y1 + (p.y0 - o.y0) * 0.9 AS y1 FROM p),
 i AS (SELECT *, least(p.x1, x1) - greatest(p.x0, x0) AS w, least(p.y1, y1) - greatest(p.y0, y0) AS h, least((p.x1 - p.x0) * (p.y1 - p.y0), (x1 - x0) * (y1 - y0)) AS area FROM m)
 SELECT doc_id, table_a, table_b, p IS NOT NULL AND o IS NOT NULL AND coalesce(w > 0 AND h > 0 AND area > 0 AND w * h > 0.5 * area, false) AS overlap FROM i WHERE true"""


def _dup_pairs(spark, d):
    p = _pairs(spark, d)
    same = tb.same_table(F.col("a.headers"), F.col("a.rows"), F.col("b.headers"), F.col("b.rows"))
    jac = tb.row_jaccard(F.col("a.rows"), F.col("b.rows"))
    return p.select(F.col("a.doc_id").alias("doc_id"), F.col("a.table_no").alias("table_a"), F.col("b.table_no").alias("table_b"), same.alias("same"), F.round(jac, 6).alias("jaccard"))


_SIG = "list_distinct(list_transform({r}, lambda x: array_to_string(list_transform(x, lambda y: lower(coalesce(y, ''))), '|')))"
_LOW = "list_transform({h}, lambda x: lower(coalesce(x, '')))"
_DUP = f"""WITH {_PAIRS}, g AS (SELECT *, {_SIG.replace('{r}', 'ra')} AS sa, {_SIG.replace('{r}', 'rb')} AS sb, {_LOW.replace('{h}', 'ha')} AS la, {_LOW.replace('{h}', 'hb')} AS lb FROM p),
 j AS (SELECT *, CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 1.0 ELSE len(list_intersect(sa, sb))::DOUBLE / greatest(len(list_distinct(list_concat(sa, sb))), 1) END AS j FROM g)
 SELECT doc_id, table_a, table_b, (la = lb OR list_filter(la, lambda x: x <> '') = list_filter(lb, lambda x: x <> '')) AND CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN len(sa) = 0 AND len(sb) = 0 ELSE j >= 0.85 END AS same, CAST(round(j, 6) AS DOUBLE) AS jaccard FROM j"""


def _overlap(spark, d):
    p = _pairs(spark, d)
    o = tb.word_overlap(F.col("a.headers"), F.col("b.headers"), rules.HEADER_STOP_WORDS)
    return p.select(F.col("a.doc_id").alias("doc_id"), F.col("a.table_no").alias("table_a"), F.col("b.table_no").alias("table_b"), F.round(o, 6).alias("overlap"))


_WORDSET = "list_distinct(list_filter(string_split_regex(lower(array_to_string(list_transform(list_filter({h}, lambda x: coalesce(x, '') <> ''), lambda x: " + s("x") + "), ' ')), '[\\s\\pZ]+'), lambda w: w NOT IN ('', " + ", ".join(f"'{w}'" for w in rules.HEADER_STOP_WORDS) + ")))"
_OVERLAP = f"""WITH {_PAIRS}, g AS (SELECT *, {_WORDSET.replace('{h}', 'ha')} AS wa, {_WORDSET.replace('{h}', 'hb')} AS wb FROM p)
 SELECT doc_id, table_a, table_b, CAST(round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), len(wb)) END, 6) AS DOUBLE) AS overlap FROM g"""


def table_reading_order(spark, d):
    return tb.in_reading_order(_tables(spark, d).select(*KEY, "bbox")).select(*KEY, "place")


def page_table_pairs(spark, d):
    """Each two tables of a page: whether their places overlap, whether they are one table, and by which words."""
    t = _tables(spark, d).select(*KEY, "headers", "rows", "bbox")
    a, b = F.col("a"), F.col("b")
    # tables of a page stand below one another here; the second is moved up by most of the distance
    moved = F.struct(b["bbox"]["x0"].alias("x0"), *[(b["bbox"][k] - (b["bbox"]["y0"] - a["bbox"]["y0"]) * 0.9).alias(k) for k in ("y0",)], b["bbox"]["x1"].alias("x1"), (b["bbox"]["y1"] - (b["bbox"]["y0"] - a["bbox"]["y0"]) * 0.9).alias("y1"))
    first = lambda r: F.get(F.coalesce(r, F.array().cast("array<array<string>>")), F.lit(0))
    return tb.page_pairs(t).select(
        "doc_id", "page", F.col("a.table_no").alias("table_a"), F.col("b.table_no").alias("table_b"),
        tb.bboxes_overlap(a["bbox"], F.when(b["bbox"].isNotNull() & a["bbox"].isNotNull(), moved)).alias("overlap"),
        tb.same_table(a["headers"], a["rows"], b["headers"], b["rows"]).alias("same"),
        tb.same_extraction(a["headers"], a["rows"], b["headers"], b["rows"]).alias("one"),
        F.round(F.coalesce(tb.word_overlap(first(a["rows"]), first(b["rows"])), F.lit(0.0)), 6).alias("first_words"))


_ROWSET = "list_distinct(list_filter(string_split_regex(lower(array_to_string(list_transform(list_filter(coalesce({h}, []), lambda x: coalesce(x, '') <> ''), lambda x: " + s("x") + "), ' ')), '[\\s\\pZ]+'), lambda w: w <> ''))"
_SHARE = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END"
_PAGE_PAIRS = f"""WITH t AS (SELECT DISTINCT doc_id, page, table_no, headers, rows, bbox FROM extracted_tables),
 p AS (SELECT a.doc_id, a.page, a.table_no AS table_a, b.table_no AS table_b, a.headers AS ha, b.headers AS hb, a.rows AS ra, b.rows AS rb, a.bbox AS p, b.bbox AS o FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.table_no < b.table_no),
 m AS (SELECT *, o.y0 - (o.y0 - p.y0) * 0.9 AS y0, o.y1 - (o.y0 - p.y0) * 0.9 AS y1, {_SIG.replace('{r}', 'ra')} AS sa, {_SIG.replace('{r}', 'rb')} AS sb, {_LOW.replace('{h}', 'ha')} AS la, {_LOW.replace('{h}', 'hb')} AS lb,
  {_ROWSET.replace('{h}', 'ra[1]')} AS fa, {_ROWSET.replace('{h}', 'rb[1]')} AS fb, {_WORDSET.replace('{h}', 'ha')} AS wa, {_WORDSET.replace('{h}', 'hb')} AS wb FROM p),
 i AS (SELECT *, least(p.x1, o.x1) - greatest(p.x0, o.x0) AS w, least(p.y1, y1) - greatest(p.y0, y0) AS h, least((p.x1 - p.x0) * (p.y1 - p.y0), (o.x1 - o.x0) * (y1 - y0)) AS area, coalesce({_SHARE.format(a='fa', b='fb')}, 0.0) AS first_words, {_SHARE.format(a='wa', b='wb')} AS head_words FROM m)
 SELECT doc_id, page, table_a, table_b, p IS NOT NULL AND o IS NOT NULL AND coalesce(w > 0 AND h > 0 AND area > 0 AND w * h > 0.5 * area, false) AS overlap,
  (la = lb OR list_filter(la, lambda x: x <> '') = list_filter(lb, lambda x: x <> '')) AND CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN len(sa) = 0 AND len(sb) = 0 ELSE len(list_intersect(sa, sb))::DOUBLE / greatest(len(list_distinct(list_concat(sa, sb))), 1) >= 0.85 END AS same,
  abs(len(ha) - len(hb)) <= 1 AND (first_words > 0.3 OR head_words > 0.3) AS one, CAST(round(first_words, 6) AS DOUBLE) AS first_words FROM i"""


def _best(spark, d):
    return tb.best_per(_tables(spark, d), ["doc_id"], "table_no").select("doc_id", "page", "table_no", F.round("score", 6).alias("score"))


_FALLBACK = "source LIKE 'pdfplumber%'"


def _uncovered(spark, d):
    t = tb.facts(_tables(spark, d)).withColumn("score", tb.score())
    x = t.select("doc_id", "page", "table_no", "source", F.round("score", 6).alias("score"))
    return tb.uncovered(x.where(f"NOT {_FALLBACK}"), x.where(_FALLBACK))


_UNCOVERED = f"""WITH {FACTS}, x AS (SELECT doc_id, page, table_no, source, CAST(round(score, 6) AS DOUBLE) AS score FROM scored JOIN (SELECT doc_id, page, table_no, source FROM t) USING (doc_id, page, table_no))
 SELECT * FROM x WHERE NOT {_FALLBACK} UNION ALL SELECT doc_id, page, table_no, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, table_no) AS k FROM x a WHERE {_FALLBACK} AND NOT EXISTS (SELECT 1 FROM x b WHERE NOT b.{_FALLBACK} AND b.doc_id = a.doc_id AND b.page = a.page)) WHERE k = 1"""


def _top(spark, d):
    t = tb.facts(_tables(spark, d)).withColumn("score", F.round(tb.score(), 6)).select(*KEY, "score")
    return tb.top_per(t, ["doc_id"], [F.desc("score"), "page", "table_no"], 2)


def _md(spark, d):
    return _tables(spark, d).select(*KEY, F.md5(tb.table_markdown(F.col("headers"), F.col("rows"))).alias("digest"))


_CT = s("replace(cell, chr(10), ' ')")
_MD = f"""WITH {CELLS}, w AS (SELECT doc_id, page, table_no, max(len(cs)) AS w FROM r GROUP BY ALL), e AS (SELECT r.doc_id, r.page, r.table_no, r.row_no, '| ' || coalesce(string_agg({_CT}, ' | ' ORDER BY col_no) || repeat(' | ', CAST(any_value(w) - max(col_no) AS INT)), repeat(' | ', CAST(any_value(w) - 1 AS INT))) || ' |' AS l FROM r JOIN w USING (doc_id, page, table_no) LEFT JOIN c USING (doc_id, page, table_no, row_no) GROUP BY ALL)
 SELECT doc_id, page, table_no, md5(string_agg(l || CASE WHEN row_no = 0 THEN chr(10) || '|' || array_to_string(list_transform(range(w), lambda i: ' --- '), '|') || '|' ELSE '' END, chr(10) ORDER BY row_no)) AS digest FROM e JOIN w USING (doc_id, page, table_no) GROUP BY doc_id, page, table_no"""


def _json(spark, d):
    j = tb.table_json(F.col("headers"), F.col("rows"))
    return _tables(spark, d).select(*KEY, F.array_join(j["headers"], "|").alias("headers"), F.array_join(F.transform(j["rows"], lambda r: F.array_join(r, "|")), "\n").alias("rows"))


_JSON = f"""WITH {CELLS}, l AS (SELECT doc_id, page, table_no, row_no, string_agg({_CT}, '|' ORDER BY col_no) AS l FROM c GROUP BY ALL)
 SELECT doc_id, page, table_no, coalesce(max(CASE WHEN row_no = 0 THEN l END), '') AS headers, coalesce(string_agg(CASE WHEN row_no > 0 THEN l END, chr(10) ORDER BY row_no), '') AS rows FROM l GROUP BY ALL"""


def _aligned(spark, d):
    t = _tables(spark, d).select(*KEY, F.explode("headers").alias("cell")).where("cell IS NOT NULL").distinct()
    return t.select(*KEY, "cell", F.array_join(tb.split_aligned_cell(F.col("cell")), "#").alias("parts"))


_ALIGNED = f"""SELECT doc_id, page, table_no, cell, array_to_string(CASE WHEN cell = '' THEN [''] WHEN contains(cell, chr(9)) THEN list_transform(string_split(cell, chr(9)), lambda x: {s('x')}) WHEN regexp_matches({_S}, ' {{2,}}') THEN string_split_regex({_S}, ' {{2,}}') WHEN contains(cell, ' | ') THEN list_transform(string_split(cell, ' | '), lambda x: {s('x')}) ELSE [{_S}] END, '#') AS parts
 FROM (SELECT DISTINCT doc_id, page, table_no, unnest(headers) AS cell FROM extracted_tables) WHERE cell IS NOT NULL"""


def _int_headers(spark, d):
    return _raw(spark, d).select(*KEY, F.size(tb.drop_number_headers(F.col("matrix"))).cast("bigint").alias("n_rows"))


_INT = f"""WITH {RAW}, b AS (SELECT doc_id, page, table_no, count(*) FILTER (row_no = 0 AND {_S} <> '' AND NOT regexp_matches({_S}, '^\\d+$')) AS words FROM c GROUP BY ALL), n AS (SELECT doc_id, page, table_no, count(*) AS n FROM rr GROUP BY ALL)
 SELECT doc_id, page, table_no, CAST(n - CASE WHEN n >= 2 AND coalesce(words, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_rows FROM n LEFT JOIN b USING (doc_id, page, table_no)"""


def _accepted(spark, d):
    """Raw tables through checks and repairs, then one of those that are the same table of a page."""
    t = tb.accept(_raw(spark, d)).select(*KEY, "source", "bbox", "headers", "rows", "score")
    return tb.merge_extractors(t).select(*KEY, "source", F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"), F.round("score", 6).alias("score"))


def _rebuilt(spark, d):
    t = tb.reconstruct(_tables(spark, d).select(*KEY, "headers", "rows"))
    return t.select(*KEY, F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"))


def columns_rebuilt(spark, d):
    """Tables of plain cells whose columns are run together, three blanks apart, and rebuilt."""
    plain = lambda cells: F.forall(cells, lambda c: c.rlike(r"^\S+( \S+)*$") & ~F.contains(c, F.lit("|")))
    t = _tables(spark, d).select(*KEY, "headers", "rows").where(F.size("headers") >= 2).where(
        plain(F.col("headers")) & F.coalesce(F.forall("rows", lambda r: (F.size(r) == F.size("headers")) & plain(r)), F.lit(False)))
    one = lambda r: F.array(F.array_join(r, "   "))
    x = tb.reconstruct(t.select(*KEY, one(F.col("headers")).alias("headers"), F.transform("rows", one).alias("rows")))
    return x.select(*KEY, F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"))


_OK = "NOT list_contains(list_transform({x}, lambda c: coalesce(regexp_matches(c, '^[^\\s]+( [^\\s]+)*$') AND NOT contains(c, '|'), false)), false)"
_COLUMNS = f"""WITH src AS (SELECT DISTINCT doc_id, page, table_no, headers, rows FROM extracted_tables WHERE len(headers) >= 2 AND rows IS NOT NULL AND {_OK.replace('{x}', 'headers')} AND {_OK.replace('{x}', 'flatten(rows)')} AND NOT list_contains(list_transform(rows, lambda r: len(r) = len(headers)), false)),
 one_col AS (SELECT doc_id, page, table_no, [array_to_string(headers, '   ')] AS headers, list_transform(rows, lambda r: [array_to_string(r, '   ')]) AS rows FROM src),
 new AS (WITH {FACTS.replace('extracted_tables', 'src')} SELECT doc_id, page, table_no, score AS new_score FROM scored), old AS (WITH {FACTS.replace('extracted_tables', 'one_col')} SELECT doc_id, page, table_no, score AS old_score FROM scored)
 SELECT doc_id, page, table_no, CAST(CASE WHEN len(rows) >= 1 AND new_score > old_score THEN len(headers) ELSE 1 END AS INT) AS n_columns, CAST(len(rows) AS INT) AS n_rows FROM src JOIN new USING (doc_id, page, table_no) JOIN old USING (doc_id, page, table_no)"""


def _deduped(spark, d):
    return tb.dedupe_list(_tables(spark, d).select(*KEY, "headers", "rows")).select(*KEY)


def _expanded(spark, d):
    x = tb.expand_multiline(F.col("matrix"))
    return _raw(spark, d).select(*KEY, F.size("matrix").alias("rows_in"), F.size(x).alias("rows_out"))


def _repaired(spark, d):
    r = _raw(spark, d).select(*KEY, F.transform("matrix", lambda x: F.transform(x, lambda c: F.replace(c, F.lit("T 9"), F.lit("T A")))).alias("matrix"))
    return r.select(*KEY, F.md5(F.to_json(tb.repair_cells(F.col("matrix")))).alias("digest"))


# Tables of a document in their order: one is kept if it is the same as none kept before it.
_DEDUPED = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, table_no) AS k FROM (SELECT DISTINCT doc_id, page, table_no, headers, rows FROM extracted_tables)),
 g AS (SELECT *, {_SIG.replace('{r}', 'coalesce(rows, [])')} AS sg, {_LOW.replace('{h}', 'coalesce(headers, [])')} AS lo FROM t),
 dup AS (SELECT b.doc_id, b.k, list(a.k) AS before FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.k < b.k WHERE (a.lo = b.lo OR list_filter(a.lo, lambda x: x <> '') = list_filter(b.lo, lambda x: x <> ''))
  AND CASE WHEN len(a.sg) = 0 OR len(b.sg) = 0 THEN len(a.sg) = 0 AND len(b.sg) = 0 ELSE len(list_intersect(a.sg, b.sg)) >= 0.85 * len(list_distinct(list_concat(a.sg, b.sg))) END GROUP BY ALL),
 n AS (SELECT g.doc_id, g.k, page, table_no, coalesce(before, []) AS before FROM g LEFT JOIN dup USING (doc_id, k)),
 f AS (SELECT doc_id, k, [k] AS kept FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, CASE WHEN len(list_intersect(kept, before)) = 0 THEN list_append(kept, n.k) ELSE kept END FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
 SELECT doc_id, page, table_no FROM f JOIN n USING (doc_id, k) WHERE list_contains(kept, k)"""
# The most frequent number of lines of a row's cells, the first of equals, decides into how many rows it goes.
_EXPANDED = f"""WITH {RAW}, k AS (SELECT doc_id, page, table_no, row_no, length(cell) - length(replace(cell, chr(10), '')) + 1 AS n, col_no FROM c WHERE row_no > 0 AND {_S} <> ''),
 g AS (SELECT doc_id, page, table_no, row_no, n, count(*) AS cells, min(col_no) AS first_col FROM k GROUP BY ALL), m AS (SELECT doc_id, page, table_no, row_no, arg_max(n, cells * 1000 - first_col) AS common FROM g GROUP BY ALL),
 e AS (SELECT k.doc_id, k.page, k.table_no, k.row_no, CASE WHEN any_value(common) >= 3 AND count(*) FILTER (abs(n - common) <= 1)::DOUBLE / count(*) >= 0.6 THEN any_value(common) ELSE 1 END AS becomes FROM k JOIN m USING (doc_id, page, table_no, row_no) GROUP BY ALL)
 SELECT doc_id, page, table_no, CAST(count(*) AS INT) AS rows_in, CAST(sum(CASE WHEN rr.row_no = 0 THEN 1 ELSE coalesce(becomes, 1) END) AS INT) AS rows_out FROM rr LEFT JOIN e USING (doc_id, page, table_no, row_no) GROUP BY ALL"""
_REPAIR = "regexp_replace(regexp_replace(coalesce(replace(c, 'T 9', 'T A'), ''), '\\bP\\s*\\)', 'P_OUT)', 'g'), '\\bT\\s*A\\b([^≥≤]|$)', 'T_A\\1', 'g')"


def cells_repaired(spark, d):
    """Cells that the repair changes, after broken subscripts were put in by arithmetic both engines share."""
    broken = F.when(F.length("cell") % 5 == 0, F.concat("cell", F.lit(" at P )"))).when(F.length("cell") % 5 == 1, F.concat(F.lit("T  A "), "cell")).otherwise(F.col("cell"))
    r = _tables(spark, d).select(*KEY, F.posexplode("headers").alias("col_no", "cell")).where("cell IS NOT NULL").select(*KEY, "col_no", broken.alias("cell"))
    fixed = F.get(F.get(tb.repair_cells(F.array(F.array("cell"))), F.lit(0)), F.lit(0))
    return r.select(*KEY, "col_no", fixed.alias("fixed")).where(F.col("fixed") != F.col("cell"))


_CELLS_REPAIRED = f"""WITH {CELLS}, b AS (SELECT doc_id, page, table_no, CAST(col_no - 1 AS INT) AS col_no, CASE WHEN length(cell) % 5 = 0 THEN cell || ' at P )' WHEN length(cell) % 5 = 1 THEN 'T  A ' || cell ELSE cell END AS cell FROM (SELECT doc_id, page, table_no, CAST(generate_subscripts(headers, 1) AS INT) AS col_no, unnest(headers) AS cell FROM t) WHERE cell IS NOT NULL),
 f AS (SELECT *, {_REPAIR.replace("replace(c, 'T 9', 'T A')", 'cell')} AS fixed FROM b) SELECT doc_id, page, table_no, col_no, fixed FROM f WHERE fixed <> cell"""
def _accepted_sql() -> str:
    """The same in SQL: checks on the raw tables, then headers merged and rows expanded, then a fold over the tables of a page."""
    numbers = f"len(list_filter(matrix[1], lambda c: {s("coalesce(c, '')")} <> '' AND NOT regexp_matches({s("coalesce(c, '')")}, '^\\d+$'))) = 0"
    raw = RAW.replace(" raw AS (", " raw0 AS (").replace(" rr AS (", f" raw AS (SELECT doc_id, page, table_no, source, bbox, CASE WHEN source LIKE 'camelot%' AND len(matrix) >= 2 AND {numbers} THEN matrix[2:] ELSE matrix END AS matrix FROM raw0), rr AS (")
    head, _, tail = _VALID.replace(RAW, raw).partition("\n SELECT doc_id, page, table_no, source, ")
    reason = tail.rpartition(" AS reason FROM v")[0]
    words = "list_distinct(list_filter(string_split_regex(lower({x}), '[\\s\\pZ]+'), lambda w: w <> ''))"
    stop = ", ".join(f"'{w}'" for w in rules.HEADER_STOP_WORDS)
    share = "coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(greatest(len({a}), len({b})), 0), 0) > 0.3 AND len({a}) > 0 AND len({b}) > 0"
    return f"""{head.replace('WITH ', 'WITH RECURSIVE ', 1)},
 ok AS (SELECT doc_id, page, table_no, source, quality AS score FROM v WHERE ({reason}) IS NULL),
 mk AS (SELECT doc_id, page, table_no, count(*) FILTER (row_no = 1 AND {_S} <> '' AND NOT {_NUM}) > count(*) FILTER (row_no = 1 AND {_S} <> '' AND {_NUM}) AS merge FROM c GROUP BY ALL),
 kk AS (SELECT doc_id, page, table_no, row_no, length(cell) - length(replace(cell, chr(10), '')) + 1 AS n, col_no FROM c WHERE row_no > 0 AND {_S} <> ''),
 kg AS (SELECT doc_id, page, table_no, row_no, n, count(*) AS cells, min(col_no) AS first_col FROM kk GROUP BY ALL), km AS (SELECT doc_id, page, table_no, row_no, arg_max(n, cells * 1000 - first_col) AS common FROM kg GROUP BY ALL),
 ke AS (SELECT kk.doc_id, kk.page, kk.table_no, kk.row_no, CASE WHEN any_value(common) >= 3 AND count(*) FILTER (abs(n - common) <= 1)::DOUBLE / count(*) >= 0.6 THEN any_value(common) ELSE 1 END AS becomes FROM kk JOIN km USING (doc_id, page, table_no, row_no) GROUP BY ALL),
 body AS (SELECT rr.doc_id, rr.page, rr.table_no, sum(coalesce(becomes, 1)) AS n_rows FROM rr JOIN mk USING (doc_id, page, table_no) LEFT JOIN ke USING (doc_id, page, table_no, row_no) WHERE rr.row_no > CASE WHEN merge THEN 1 ELSE 0 END GROUP BY ALL),
 hw AS (SELECT c.doc_id, c.page, c.table_no, string_agg(CASE WHEN row_no = 0 OR merge THEN {_S} ELSE '' END, ' ' ORDER BY col_no) AS heads FROM c JOIN mk USING (doc_id, page, table_no) WHERE row_no <= 1 GROUP BY ALL),
 fw AS (SELECT c.doc_id, c.page, c.table_no, string_agg({s("CASE WHEN becomes > 1 THEN string_split(cell, chr(10))[1] ELSE cell END")}, ' ' ORDER BY col_no) AS firsts FROM c JOIN mk USING (doc_id, page, table_no) LEFT JOIN ke USING (doc_id, page, table_no, row_no) WHERE row_no = CASE WHEN merge THEN 2 ELSE 1 END GROUP BY ALL),
 a AS (SELECT ok.*, bbox, len(matrix[1]) AS n_columns, coalesce(n_rows, 0) AS n_rows, list_filter({words.replace('{x}', "coalesce(heads, '')")}, lambda w: w NOT IN ({stop})) AS hw, {words.replace('{x}', "coalesce(firsts, '')")} AS fw,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY table_no) AS k FROM ok JOIN raw USING (doc_id, page, table_no) LEFT JOIN body USING (doc_id, page, table_no) LEFT JOIN hw USING (doc_id, page, table_no) LEFT JOIN fw USING (doc_id, page, table_no)),
 m AS (SELECT y.doc_id, y.page, y.k, x.k AS j, abs(x.n_columns - y.n_columns) <= 1 AND (({share.format(a='x.hw', b='y.hw')}) OR ({share.format(a='x.fw', b='y.fw')})) AS alike,
  coalesce(least(x.bbox.x1, y.bbox.x1) > greatest(x.bbox.x0, y.bbox.x0) AND least(x.bbox.y1, y.bbox.y1) > greatest(x.bbox.y0, y.bbox.y0) AND (least(x.bbox.x1, y.bbox.x1) - greatest(x.bbox.x0, y.bbox.x0)) * (least(x.bbox.y1, y.bbox.y1) - greatest(x.bbox.y0, y.bbox.y0))
   > 0.5 * least((x.bbox.x1 - x.bbox.x0) * (x.bbox.y1 - x.bbox.y0), (y.bbox.x1 - y.bbox.x0) * (y.bbox.y1 - y.bbox.y0)) AND x.bbox IS NOT NULL AND y.bbox IS NOT NULL, false) AS over,
  y.n_rows * y.score > x.n_rows * x.score AS by_rows, y.n_columns * y.score > x.n_columns * x.score AS by_columns FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.page = y.page AND x.k < y.k),
 h AS (SELECT doc_id, page, k, list(j) AS met, list(j) FILTER (CASE WHEN alike THEN by_rows ELSE by_columns END) AS won FROM m WHERE alike OR over GROUP BY ALL),
 n AS (SELECT a.doc_id, a.page, a.k, coalesce(met, []) AS met, coalesce(won, []) AS won FROM a LEFT JOIN h USING (doc_id, page, k)),
 z AS (SELECT doc_id, page, k, [k] AS have FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.page, n.k, CASE WHEN len(list_intersect(have, met)) = 0 THEN list_append(have, n.k)
  WHEN list_contains(won, list_filter(have, lambda j: list_contains(met, j))[1]) THEN list_append(list_filter(have, lambda j: j <> list_filter(have, lambda i: list_contains(met, i))[1]), n.k) ELSE have END FROM z JOIN n ON n.doc_id = z.doc_id AND n.page = z.page AND n.k = z.k + 1),
 last AS (SELECT doc_id, page, arg_max(have, k) AS have FROM z GROUP BY ALL)
 SELECT doc_id, page, table_no, source, CAST(n_columns AS INT) AS n_columns, CAST(n_rows AS INT) AS n_rows, {_ROUND.format(x='score')} AS score FROM a JOIN last USING (doc_id, page) WHERE list_contains(have, k)"""


def _facts(column):
    return lambda spark, d: tb.facts(_tables(spark, d)).select(*KEY, F.round(column(), 6).alias("value"))


QUERIES = {
    "table_normalize": _normal,
    "table_score": _facts(tb.score),
    "fragment_ratio": lambda spark, d: tb.facts(_tables(spark, d)).select(*KEY, F.round("_frag", 6).alias("fragments"), F.round("_empty", 6).alias("empty")),
    "garbage_table_reason": _reason,
    "prose_shred": lambda spark, d: tb.facts(_tables(spark, d)).select(*KEY, tb.prose_shred().alias("prose")),
    "table_quality": lambda spark, d: _raw(spark, d).select(*KEY, F.round(tb.quality(F.col("matrix")), 6).alias("quality")),
    "garbled_header": lambda spark, d: _tables(spark, d).select(*KEY, tb.garbled(F.array_join(F.transform(F.filter(F.col("headers"), lambda h: F.coalesce(h, F.lit("")) != ""), strip), " ")).alias("garbled")),
    "valid_table_reason": _valid,
    "split_aligned_cell": _aligned,
    "header_merge": _merged,
    "int_header_drop": _int_headers,
    "bbox_overlap_pairs": _bbox_pairs,
    "table_dup_pairs": _dup_pairs,
    "header_word_overlap": _overlap,
    "page_table_pairs": page_table_pairs,
    "table_reading_order": table_reading_order,
    "best_table_per_document": _best,
    "uncovered_page_fallback": _uncovered,
    "top_tables": _top,
    "table_to_markdown": _md,
    "table_to_json": _json,
    "accepted_tables": _accepted,
    "rebuilt_columns": _rebuilt,
    "columns_rebuilt": columns_rebuilt,
    "table_dedupe_list": _deduped,
    "multiline_expand": _expanded,
    "cell_repair": _repaired,
    "cells_repaired": cells_repaired,
}
_K = "doc_id, page, table_no"
SQL = {
    "table_normalize": _NORMAL,
    "table_score": f"WITH {FACTS} SELECT {_K}, CAST(round(score, 6) AS DOUBLE) AS value FROM scored",
    "fragment_ratio": f"WITH {FACTS} SELECT {_K}, CAST(round(frag, 6) AS DOUBLE) AS fragments, CAST(round(empty, 6) AS DOUBLE) AS empty FROM facts",
    "garbage_table_reason": f"WITH {FACTS} SELECT {_K}, {_REASON} AS reason FROM scored",
    "prose_shred": f"WITH {FACTS} SELECT {_K}, prose FROM scored",
    "table_quality": f"WITH {RAW}, {_QUALITY} SELECT {_K}, CAST(round(quality, 6) AS DOUBLE) AS quality FROM quality",
    "garbled_header": f"WITH {CELLS}, h AS (SELECT {_K}, coalesce(string_agg(CASE WHEN row_no = 0 AND cell <> '' THEN {_S} END, ' ' ORDER BY col_no), '') AS x FROM c GROUP BY ALL) SELECT {_K}, {_garbled('x')} AS garbled FROM h",
    "valid_table_reason": _VALID,
    "split_aligned_cell": _ALIGNED,
    "header_merge": _MERGED,
    "int_header_drop": _INT,
    "bbox_overlap_pairs": _BBOX,
    "table_dup_pairs": _DUP,
    "header_word_overlap": _OVERLAP,
    "page_table_pairs": _PAGE_PAIRS,
    "table_reading_order": f"SELECT doc_id, page, table_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(bbox.y0, 0.0), table_no) AS INT) AS place FROM (SELECT DISTINCT {_K}, bbox FROM extracted_tables)",
    "best_table_per_document": f"WITH {FACTS} SELECT doc_id, page, table_no, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_no) AS k FROM scored) WHERE k = 1 AND score >= 0",
    "uncovered_page_fallback": _UNCOVERED,
    "top_tables": f"WITH {FACTS} SELECT {_K}, score FROM (SELECT {_K}, CAST(round(score, 6) AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, page, table_no) AS k FROM scored) WHERE k <= 2",
    "table_to_markdown": _MD,
    "table_to_json": _JSON,
    "multiline_expand": _EXPANDED,
    "accepted_tables": _accepted_sql(),
    "table_dedupe_list": _DEDUPED,
    "columns_rebuilt": _COLUMNS,
    "cell_repair": f"WITH {RAW} SELECT doc_id, page, table_no, md5(CAST(to_json(list_transform(matrix, lambda r: list_transform(coalesce(r, []), lambda c: {_REPAIR}))) AS VARCHAR)) AS digest FROM raw",
    "cells_repaired": _CELLS_REPAIRED,
}
