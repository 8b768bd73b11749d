"""Queries on decoded layout: spans, runs and recognised words, made from the tables by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paperloom.functions import rules
from paperloom.functions.text import strip
from paperloom.operators import blocks as bl, tables as tb
from paperloom.queries.document import bold_merged, like, noise_section_flags, s
from paperloom.session import table


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Words of sections as spans: a page is three sections, a block is a section."""
    x = table(spark, d, "sections").where("content IS NOT NULL").select("doc_id", "seq", "type", "level", "content").distinct()
    x = x.select("doc_id", F.floor(F.col("seq") / 3).cast("int").alias("page"), F.col("seq").alias("block_no"), "type", "level", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    x = x.select("doc_id", "page", "block_no", "type", "level", "line_no", F.posexplode(F.split("line", " ", -1)).alias("span_no", "w"))
    n = F.length("w")
    size = F.when(F.col("type") == "heading", 21.0 - 2 * F.coalesce("level", F.lit(3))).otherwise(10.0 + (n % 3) * 0.5)
    font = F.when(F.col("type") == "code", "Courier New").when(n % 11 == 0, "DejaVu Sans Mono").otherwise("Times")
    return x.select("doc_id", "page", "block_no", "line_no", "span_no", F.concat("w", F.lit(" ")).alias("text"), size.alias("size"), (n % 4).cast("int").alias("flags"), font.alias("font"))


SPANS = """sp AS (SELECT doc_id, page, block_no, line_no, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS span_no, type, level, unnest(ws) AS w FROM (
  SELECT doc_id, page, block_no, type, level, line_no, string_split(line, ' ') AS ws FROM (SELECT doc_id, CAST(seq // 3 AS INT) AS page, seq AS block_no, type, level, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, unnest(ls) AS line
  FROM (SELECT DISTINCT doc_id, seq, type, level, string_split(content, chr(10)) AS ls FROM sections WHERE content IS NOT NULL)))),
 spans AS (SELECT doc_id, page, block_no, line_no, span_no, w || ' ' AS text, CASE WHEN type = 'heading' THEN 21.0 - 2 * coalesce(level, 3) ELSE 10.0 + (length(w) % 3) * 0.5 END AS size, CAST(length(w) % 4 AS INT) AS flags,
  CASE WHEN type = 'code' THEN 'Courier New' WHEN length(w) % 11 = 0 THEN 'DejaVu Sans Mono' ELSE 'Times' END AS font FROM sp)"""
_INK = s("text") + " <> ''"
_MONO = "regexp_matches(lower(font), 'mono|courier|consol')"


def heading_levels(spark, d):
    x = bl.page_font_size(spans(spark, d))
    ink = F.when(strip(F.col("text")) != "", F.col("size"))
    b = x.groupBy("doc_id", "page", "block_no").agg(F.avg(ink).alias("size"), F.first("page_size").alias("page_size"), F.sum(F.length("text")).alias("n"))
    b = b.where("size IS NOT NULL")
    return b.select("doc_id", "block_no", F.round("size", 4).alias("size"), F.round("page_size", 4).alias("page_size"), bl.heading_level(F.round("size", 4), F.round("page_size", 4), F.col("n")).alias("level"))


_HEAD = f"""WITH {SPANS}, p AS (SELECT doc_id, page, coalesce(avg(size) FILTER ({_INK}), 12.0) AS ps FROM spans GROUP BY ALL), b AS (SELECT doc_id, page, block_no, avg(size) FILTER ({_INK}) AS bs, sum(length(text)) AS n FROM spans GROUP BY ALL),
 j AS (SELECT doc_id, block_no, CAST(round(bs, 4) AS DOUBLE) AS size, CAST(round(ps, 4) AS DOUBLE) AS page_size, n FROM b JOIN p USING (doc_id, page) WHERE bs IS NOT NULL)
 SELECT doc_id, block_no, size, page_size, CASE WHEN size < page_size * 1.4 OR n >= 200 THEN NULL WHEN size >= page_size * 1.8 THEN 1 WHEN size >= page_size * 1.6 THEN 2 ELSE 3 END AS level FROM j"""


def mono_blocks(spark, d):
    mono = F.avg(F.when(strip(F.col("text")) != "", bl.is_mono_font(F.col("font")).cast("double")))
    return spans(spark, d).groupBy("doc_id", "block_no").agg(F.coalesce(mono >= 0.6, F.lit(False)).alias("mono"))


def span_markdown(spark, d):
    x = spans(spark, d).select("*", bl.span_markdown(F.col("text"), F.col("flags"), F.col("font")).alias("md"))
    return x.groupBy("doc_id", "block_no").agg(F.md5(bl.ordered_join(["line_no", "span_no"], "md", "")).alias("digest"))


_SPANMD = f"""WITH {SPANS} SELECT doc_id, block_no, md5(string_agg(CASE WHEN NOT ({_INK}) THEN text WHEN {_MONO} THEN '`' || text || '`' WHEN flags = 3 THEN '***' || text || '***' WHEN flags = 2 THEN '**' || text || '**' WHEN flags = 1 THEN '*' || text || '*' ELSE text END, '' ORDER BY line_no, span_no)) AS digest FROM spans GROUP BY doc_id, block_no"""


def page_blocks(spark, d):
    b = bl.page_blocks(spans(spark, d))
    return b.select("doc_id", "page", "block_no", "type", "level", F.md5("markdown").alias("digest"))


def _sections(spark, d):
    return table(spark, d, "sections").where("content IS NOT NULL").select("doc_id", "seq", "type", "level", "content").distinct()


_SEC = "sec AS (SELECT DISTINCT doc_id, seq, type, level, content FROM sections WHERE content IS NOT NULL)"
_STYLE = """CASE WHEN type = 'heading' THEN 'Heading ' || CAST(coalesce(level, 9) AS {s}) WHEN type = 'list_item' AND seq % 2 = 0 THEN 'List Number' WHEN type = 'list_item' THEN 'List Bullet' WHEN type = 'code' THEN 'Source Code'
 WHEN type = 'quote' THEN 'Intense Quote' WHEN seq % 7 = 0 THEN 'Subtitle' WHEN seq % 7 = 1 THEN 'No Spacing' WHEN seq % 7 = 2 THEN 'Heading x' WHEN seq % 7 = 3 THEN NULL ELSE 'Normal' END"""


def docx_paragraph_type(spark, d):
    x = _sections(spark, d).withColumn("style", F.expr(_STYLE.format(s="string")))
    t = bl.docx_type(F.col("style"), F.col("content"), F.col("seq") % 9 == 0)
    return x.select("doc_id", "seq", t["type"].alias("kind"), t["level"].alias("depth"))


_DOCX = f"""WITH {_SEC}, x AS (SELECT doc_id, seq, content, lower(coalesce({_STYLE.format(s='VARCHAR')}, '')) AS style FROM sec)
 SELECT doc_id, seq, CASE WHEN style LIKE 'heading%' OR style LIKE '%title%' THEN 'heading' WHEN style LIKE 'list%' THEN 'list_item' WHEN regexp_matches(style, 'code|source|preformatted|no spacing') OR seq % 9 = 0 THEN 'code' WHEN style LIKE '%quote%' THEN 'quote' WHEN {like('content', rules.MATH, False)} THEN 'math' ELSE 'paragraph' END AS kind,
 CASE WHEN style LIKE 'heading%' THEN greatest(1, least(6, coalesce(TRY_CAST(trim(replace(style, 'heading', '')) AS INT), 2))) WHEN style LIKE '%title%' THEN 1 END AS depth FROM x"""


def list_prefix(spark, d):
    x = _sections(spark, d).where("type = 'list_item'").withColumn("style", F.expr(_STYLE.format(s="string"))).withColumn("t", F.when(F.col("seq") % 4 == 0, F.concat(F.col("seq").cast("string"), F.lit(") "), F.col("content"))).otherwise(F.col("content")))
    return x.select("doc_id", "seq", bl.list_prefix(F.col("style"), F.col("t")).alias("prefix"))


_PREFIX = f"""WITH {_SEC} SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 4 = 0 THEN CAST(seq AS VARCHAR) || '.' WHEN regexp_matches({s('content')}, '^\\d+[.)]') THEN regexp_extract({s('content')}, '^(\\d+)[.)]', 1) || '.' ELSE '1.' END ELSE '-' END AS prefix FROM sec WHERE type = 'list_item'"""


def _runs(spark, d):
    x = _sections(spark, d)
    return x.select("doc_id", (F.floor(F.col("seq") / 4) + 1).cast("int").alias("part_no"), F.col("seq").alias("para_no"), F.lit(0).alias("run_no"), F.lit(None).cast("string").alias("style"), (F.col("seq") % 3).cast("int").alias("level"), (F.col("type") == "heading").alias("is_title"),
        F.col("content").alias("text"), (F.col("seq") % 5 == 0).alias("bold"), F.when(F.col("seq") % 2 == 0, F.lit(True)).alias("italic"), F.lit(None).cast("string").alias("font"))


def pptx_outline(spark, d):
    p = bl.pptx_sections(_runs(spark, d))
    return p.groupBy("doc_id", "part_no").agg(F.count("*").alias("blocks"), F.md5(bl.ordered_join(["para_no"], "markdown", "\n\n")).alias("digest"))


_PPTX = f"""WITH {_SEC}, p AS (SELECT doc_id, CAST(seq // 4 + 1 AS INT) AS part_no, seq, seq % 3 AS lvl, type, CASE WHEN seq % 10 = 0 THEN '***' || content || '***' WHEN seq % 5 = 0 THEN '**' || content || '**' WHEN seq % 2 = 0 THEN '*' || content || '*' ELSE content END AS f, content FROM sec),
 m AS (SELECT doc_id, part_no, seq, CASE WHEN type = 'heading' AND lvl = 0 THEN '### ' || f WHEN lvl > 0 THEN repeat('  ', CAST(lvl - 1 AS INT)) || '- ' || f WHEN {like('f', rules.MATH, False)} THEN '$' || f || '$' ELSE f END AS md FROM p WHERE {s('content')} <> ''
  UNION ALL SELECT DISTINCT doc_id, part_no, -1, '## Slide ' || CAST(part_no AS VARCHAR) FROM p)
 SELECT doc_id, part_no, count(*) AS blocks, md5(string_agg(md, chr(10) || chr(10) ORDER BY seq)) AS digest FROM m GROUP BY ALL"""


def drawing_label(spark, d):
    """Headings in capitals, and every section, judged as drawing labels."""
    x = _sections(spark, d).withColumn("t", F.when(F.col("seq") % 3 == 0, F.translate("content", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("content")))
    return x.select("doc_id", "seq", bl.looks_like_drawing_label(F.col("t")).alias("label"))


def _label(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({x}, '\\n|\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {s('l')}), lambda l: l <> '')"
    words = f"list_filter(string_split_regex({x}, '[\\s\\pZ\\x{{85}}]+'), lambda w: w <> '')"
    letters = "regexp_replace(l, '[^A-Za-z]', '', 'g')"
    caps = f"len(list_filter({lines}, lambda l: {letters} <> '' AND (({letters} = upper({letters}) AND length({letters}) >= 2) OR regexp_matches(l, '^[A-Z0-9][A-Z0-9 \\-_/]+$'))))"
    return f"""(len({lines}) BETWEEN 1 AND 12 AND NOT regexp_matches({x}, '[{{}};]|::|->|=>|</?\\w+>|\\b(def|class|function|return|import|include|const|var|let|void)\\b') AND len(list_filter({lines}, lambda l: length(l) > 48)) = 0
 AND (({caps} >= greatest(1.0, len({lines}) * 0.6) AND length({x}) < 200) OR (len({words}) > 0 AND length({x}) < 60 AND len(list_filter({words}, lambda w: length(w) = 1))::DOUBLE / greatest(len({words}), 1) >= 0.5)))"""


# What the filter of noisy sections says of code and paragraphs.
_ONES = "len(list_filter(ws, lambda w: length(w) = 1))::DOUBLE / greatest(len(ws), 1) >= 0.5 AND len(ws) > 0"
_NOISE = f"""WITH sec AS (SELECT DISTINCT * FROM sections WHERE type IN ('code', 'paragraph') AND content IS NOT NULL), x AS (SELECT doc_id, seq, type, {s('content')} AS c FROM sec),
 y AS (SELECT *, length(c) AS n, list_filter(string_split_regex(c, '[\\s\\pZ\\x{{85}}]+'), lambda w: w <> '') AS ws, length(regexp_replace(c, '[^\\pL\\pN]', '', 'g')) AS alnum, length(regexp_replace(c, '[\\pL\\pN\\s\\pZ\\x{{85}}]', '', 'g')) AS signs, {_label('c')} AS label FROM x)
 SELECT doc_id, seq, type, CASE WHEN type = 'code' THEN label OR (n < 15 AND alnum::DOUBLE / greatest(n, 1) < 0.5) OR (n < 40 AND {_ONES}) OR (n > 0 AND signs::DOUBLE / greatest(n, 1) > 0.6 AND n < 100) ELSE label AND {_ONES} END AS noise FROM y"""


def cleaned_sections(spark, d):
    """The sections of all files through the cleaning of a conversion without tables and word repair."""
    from paperloom.config import Config
    from paperloom.plans.pipeline import clean_sections

    x = table(spark, d, "sections").distinct()
    done = clean_sections(x, Config(extract_tables=False, fix_lost_letters=False, fix_misread_words=False))
    return done.select("doc_id", "seq", "type", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


_CLEANED = f"""WITH noisy AS ({_NOISE.replace('WITH sec AS', 'WITH sec0 AS').replace('FROM sec)', 'FROM sec0)')}), s AS (SELECT DISTINCT * FROM sections),
 k AS (SELECT s.doc_id, s.seq, s.type, CASE WHEN s.type IN ('paragraph', 'heading') THEN array_to_string(list_filter(string_split({bold_merged('content')}, chr(10)), lambda line: NOT {like(s('line'), rules.CHROME)}), chr(10)) ELSE content END AS c
  FROM s LEFT JOIN noisy n ON n.doc_id = s.doc_id AND n.seq = s.seq AND n.type = s.type WHERE (s.type IS NULL OR s.type <> 'table') AND NOT coalesce(noise, false))
 SELECT DISTINCT doc_id, seq, type, md5(coalesce(c, '')) AS digest FROM k WHERE NOT coalesce(type IN ('paragraph', 'heading') AND length({s('c')}) < 2, false)
  AND NOT coalesce(type = 'paragraph' AND ({s("coalesce(c, '')")} = '' OR regexp_matches({s('c')}, '^\\pN+$') OR regexp_matches({s('c')}, '^(draft|confidential|watermark)$', 'i')), false)"""


def _score(x: str) -> str:
    lines = f"list_filter(string_split_regex({x}, '\\n|\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {s('l')} <> '')"
    m = lambda p, k: f"CASE WHEN regexp_matches({x}, '{p}') THEN {k} ELSE 0 END"
    return " + ".join([
        m(r"[{};]", 2), m("::|->|=>", 2), m(r"\b(def|class|function|return|import|from|const|var|let|void|int|float|public|private|package)\b", 2), m(r"[=<>]=|&&|\|\||<<|>>", 1), m(r"(?m)^\s*#include\b|^\s*using\s+namespace\b", 2), m("</?[A-Za-z][^>]*>", 1),
        f"CASE WHEN len({lines}) >= 3 AND len(list_filter({lines}, lambda l: l LIKE ' %' OR l LIKE chr(9) || '%')) >= 2 THEN 1 ELSE 0 END",
        f"CASE WHEN length({x}) > 20 AND length(regexp_replace({x}, '[\\pL\\pN\\s\\pZ\\x{{85}}]', '', 'g'))::DOUBLE / greatest(length({x}), 1) > 0.18 THEN 1 ELSE 0 END"])


def code_score(spark, d):
    return _sections(spark, d).select("doc_id", "seq", bl.code_score(strip(F.col("content")), F.lit(False)).cast("int").alias("score"), bl.looks_like_code(F.col("content"), F.lit(False)).alias("code"))


_CODE = f"WITH {_SEC}, x AS (SELECT doc_id, seq, {s('content')} AS t FROM sec), y AS (SELECT doc_id, seq, t, CAST({_score('t')} AS INT) AS score FROM x) SELECT doc_id, seq, score, t <> '' AND NOT {_label('t')} AND score >= 3 AS code FROM y"


# Blocks of a page by size, then code, drawing label, mathematics; spans keep their text in blocks of a fixed-width font.
_LETTERS = "length(regexp_replace(c, '[^\\pL]', '', 'g'))"
_KLINES = f"len(list_filter(string_split_regex(c, '\\n|\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {s('l')} <> ''))"
_BLOCKS = f"""WITH {SPANS}, p AS (SELECT doc_id, page, coalesce(avg(size) FILTER ({_INK}), 12.0) AS ps FROM spans GROUP BY ALL),
 b AS (SELECT doc_id, page, block_no, avg(size) FILTER ({_INK}) AS bs, count(DISTINCT line_no) AS n_lines, coalesce(avg(CASE WHEN {_MONO} THEN 1.0 ELSE 0.0 END) FILTER ({_INK}) >= 0.6, false) AS mono FROM spans GROUP BY ALL),
 m AS (SELECT spans.*, mono, CASE WHEN mono OR NOT ({_INK}) THEN text WHEN {_MONO} THEN '`' || text || '`' WHEN flags = 3 THEN '***' || text || '***' WHEN flags = 2 THEN '**' || text || '**' WHEN flags = 1 THEN '*' || text || '*' ELSE text END AS md FROM spans JOIN b USING (doc_id, page, block_no)),
 l AS (SELECT doc_id, page, block_no, line_no, string_agg(md, '' ORDER BY span_no) AS line FROM m GROUP BY ALL),
 c AS (SELECT doc_id, page, block_no, {s("string_agg(line, chr(10) ORDER BY line_no)")} AS c FROM l GROUP BY ALL),
 f AS (SELECT c.*, n_lines, mono, coalesce(bs, ps) AS bs, ps, {_label('c')} AS label, {_score('c')} AS base, {_KLINES} AS k FROM c JOIN b USING (doc_id, page, block_no) JOIN p USING (doc_id, page) WHERE c <> ''),
 g AS (SELECT *, base + CASE WHEN mono AND k >= 4 AND length(c) >= 40 THEN 1 WHEN mono AND k >= 2 AND base >= 1 THEN 1 ELSE 0 END AS score, CASE WHEN bs < ps * 1.4 OR length(c) >= 200 THEN NULL WHEN bs >= ps * 1.8 THEN 1 WHEN bs >= ps * 1.6 THEN 2 ELSE 3 END AS level FROM f),
 h AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN NOT label AND NOT (mono AND k <= 2 AND score < 2 AND {_LETTERS}::DOUBLE / greatest(length(c), 1) > 0.7) AND score >= CASE WHEN mono THEN 2 ELSE 3 END AND (mono OR n_lines >= 2) THEN 'code'
  WHEN label AND mono THEN 'paragraph' WHEN {like('c', rules.MATH, False)} THEN 'math' ELSE 'paragraph' END AS type FROM g)
 SELECT doc_id, page, block_no, type, CAST(level AS INT) AS level, md5(CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || c WHEN 'code' THEN '```' || chr(10) || c || chr(10) || '```' WHEN 'math' THEN CASE WHEN contains(c, chr(10)) THEN '$$' || chr(10) || c || chr(10) || '$$' ELSE '$' || c || '$' END ELSE c END) AS digest FROM h"""


def ocr_paragraph_type(spark, d):
    x = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("ocr_text"))
    return bl.ocr_paragraphs(x).select("doc_id", "seq", "type", "level", F.md5("markdown").alias("digest"))


_OCR_SCORE = "list_sum(list_transform(string_split(c, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*(def |class |import |from |if __name__)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(l, '^\\s*(function |var |const |let |=>)') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, '^\\s*(#include |int main|void |public |private )') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(l, '[{};]\\s*$') THEN 1 ELSE 0 END))"
_OCR = f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda l: {s('l')}), lambda l: l <> '') AS ps FROM documents WHERE text IS NOT NULL),
 q AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS seq, unnest(ps) AS c FROM p), t AS (SELECT *, CASE WHEN NOT contains(c, chr(10)) AND length(c) < 100 AND regexp_matches(c, '^[\\p{{Lu}}\\p{{Nd}}]') THEN 'heading' WHEN {_OCR_SCORE} >= len(string_split(c, chr(10))) * 0.4 + 2 THEN 'code' WHEN {like('c', rules.MATH, False)} THEN 'math' ELSE 'paragraph' END AS type FROM q)
 SELECT doc_id, seq, type, CASE WHEN type = 'heading' THEN 3 END AS level, md5(CASE type WHEN 'heading' THEN '### ' || c WHEN 'code' THEN '```' || chr(10) || c || chr(10) || '```' WHEN 'math' THEN CASE WHEN contains(c, chr(10)) THEN '$$' || chr(10) || c || chr(10) || '$$' ELSE '$' || c || '$' END ELSE c END) AS digest FROM t"""


def _ocr_words(spark, d):
    """Events as recognised words: a page for each user, places by arithmetic."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").cast("int").alias("word_no"), F.col("event_type").alias("text"), ((F.col("event_id") * 37) % 900).cast("int").alias("x"), ((F.col("event_id") * 13) % 200).cast("int").alias("y"))


def ocr_rows(spark, d):
    return tb.ocr_rows(_ocr_words(spark, d)).select("doc_id", "row_no", F.array_join("words", " ").alias("words"))


# The anchor of a row is its first word, so rows follow one another by recursion.
_OCR_ROWS = """WITH RECURSIVE w AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id AS word_no, event_type AS text, (event_id * 37) % 900 AS x, (event_id * 13) % 200 AS y FROM events WHERE trim(event_type) <> ''),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, word_no) AS k FROM w), f AS (SELECT doc_id, word_no, text, x, y, k, y AS anchor, 0 AS row_no FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.word_no, o.text, o.x, o.y, o.k, CASE WHEN abs(o.y - f.anchor) <= 10 THEN f.anchor ELSE o.y END, CASE WHEN abs(o.y - f.anchor) <= 10 THEN f.row_no ELSE f.row_no + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
 SELECT doc_id, CAST(row_no AS INT) AS row_no, string_agg(text, ' ' ORDER BY x, word_no) AS words FROM f GROUP BY ALL"""


def ocr_tables(spark, d):
    return tb.ocr_tables(_ocr_words(spark, d)).select("doc_id", F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"))


def ocr_grid_tables(spark, d):
    """Events as words of a page in a grid, every seventh a little off its row; every third page is ragged."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", F.col("event_type").alias("text"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("k"), (F.col("user_id") % 3).alias("r"))
    wide = F.when(F.col("r") == 0, F.when(F.col("k") < 9, 1).otherwise(7)).otherwise(4)
    x = e.select("doc_id", F.col("event_id").cast("int").alias("word_no"), "text", ((F.col("k") % wide) * 100).cast("int").alias("x"), (F.floor(F.col("k") / wide) * 40 + F.when(F.col("k") % 7 == 0, 9).otherwise(0)).cast("int").alias("y"))
    return tb.ocr_tables(x).select("doc_id", F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"))


_RECUR = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, word_no) AS k FROM w), f AS (SELECT doc_id, word_no, text, x, y, k, y AS anchor, 0 AS row_no FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.word_no, o.text, o.x, o.y, o.k, CASE WHEN abs(o.y - f.anchor) <= 10 THEN f.anchor ELSE o.y END, CASE WHEN abs(o.y - f.anchor) <= 10 THEN f.row_no ELSE f.row_no + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
 g AS (SELECT doc_id, row_no, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS longest FROM g)
 SELECT doc_id, CAST(max(CASE WHEN row_no = 0 THEN n END) AS INT) AS n_columns, CAST(count(*) - 1 AS INT) AS n_rows FROM m GROUP BY doc_id HAVING sum(n) >= 6 AND count(*) >= 2 AND max(longest) >= 2 AND count(*) FILTER (n >= 2 AND n >= longest - 1) >= count(*) * 0.5"""
_OCR_TABLES = f"WITH RECURSIVE w AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id AS word_no, event_type AS text, (event_id * 37) % 900 AS x, (event_id * 13) % 200 AS y FROM events WHERE trim(event_type) <> ''), {_RECUR}"
_OCR_GRID = f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, user_id % 3 AS r FROM events),
 e2 AS (SELECT *, CASE WHEN r = 0 THEN CASE WHEN k < 9 THEN 1 ELSE 7 END ELSE 4 END AS wide FROM e),
 w AS (SELECT doc_id, event_id AS word_no, text, (k % wide) * 100 AS x, (k // wide) * 40 + CASE WHEN k % 7 = 0 THEN 9 ELSE 0 END AS y FROM e2 WHERE trim(text) <> ''), {_RECUR}"""


QUERIES = {f.__name__: f for f in (heading_levels, mono_blocks, span_markdown, page_blocks, docx_paragraph_type, list_prefix, pptx_outline, drawing_label, code_score, ocr_paragraph_type, ocr_rows, ocr_tables, ocr_grid_tables, noise_section_flags, cleaned_sections)}
SQL = {
    "heading_levels": _HEAD,
    "mono_blocks": f"WITH {SPANS} SELECT doc_id, block_no, coalesce(avg(CASE WHEN {_MONO} THEN 1.0 ELSE 0.0 END) FILTER ({_INK}) >= 0.6, false) AS mono FROM spans GROUP BY doc_id, block_no",
    "span_markdown": _SPANMD,
    "docx_paragraph_type": _DOCX,
    "list_prefix": _PREFIX,
    "pptx_outline": _PPTX,
    "drawing_label": f"WITH {_SEC}, x AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE content END AS t FROM sec) SELECT doc_id, seq, {_label('t')} AS label FROM x",
    "code_score": _CODE,
    "page_blocks": _BLOCKS,
    "ocr_paragraph_type": _OCR,
    "ocr_rows": _OCR_ROWS,
    "ocr_tables": _OCR_TABLES,
    "ocr_grid_tables": _OCR_GRID,
    "noise_section_flags": _NOISE,
    "cleaned_sections": _CLEANED,
}
