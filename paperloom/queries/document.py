"""Queries on lines, texts and sections, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions import rules, text as tx
from paperloom.operators import blocks, chunking, images, lines as ln
from paperloom.session import table

# Frames a text with what page edges hold, by arithmetic both engines share.
_FRAME = """'Works gazette' || chr(10) || 'Page ' || CAST(length(m) % 90 + 1 AS {s}) || ' of 99' || chr(10) ||
 CASE length(m) % 6 WHEN 0 THEN 'CONFIDENTIAL - for review' WHEN 1 THEN 'https://example.org/a' WHEN 2 THEN 'Sheet 2 of 9'
 WHEN 3 THEN 'US1234567B2' WHEN 4 THEN '12/03/2021, 10:15 AM' ELSE 'Sample page' END || chr(10) || 'Restrictions apply.' || chr(10) || m || chr(10) ||
 'Contents .......... ' || CAST(length(m) % 50 AS {s}) || chr(10) || 'Works gazette' || chr(10) || '- ' || CAST(length(m) % 7 AS {s}) || ' -'"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversion_results").where("markdown IS NOT NULL").select("doc_id", "markdown").distinct()


def framed(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumnRenamed("markdown", "m").select("doc_id", F.expr(_FRAME.format(s="string")).alias("markdown"))


DOCS = "docs AS (SELECT DISTINCT doc_id, markdown FROM conversion_results WHERE markdown IS NOT NULL)"
FRAMED = f"{DOCS}, framed AS (SELECT doc_id, {_FRAME.format(s='VARCHAR')} AS markdown FROM (SELECT doc_id, markdown AS m FROM docs))"
LINES = f"""{FRAMED}, split AS (SELECT doc_id, string_split(markdown, chr(10)) AS l FROM framed),
 lines AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS line FROM split)"""
_WS0 = r"[\s\pZ\x{85}\x1c-\x1f]*"
_WS = r"[\s\pZ\x{85}\x1c-\x1f]+"


def s(x: str) -> str:
    """SQL for a text without white space at its ends."""
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def like(x: str, patterns: list[str], any_case: bool = True) -> str:
    flags = ", 'i'" if any_case else ""
    return f"regexp_matches({x}, '{q('|'.join(f'(?:{p})' for p in patterns))}'{flags})"


_PAGE = like("line", rules.PAGE_NUMBER)
_ART = f"({like(s('line'), rules.ARTIFACT_ANY_CASE)} OR {like(s('line'), rules.ARTIFACT_THIS_CASE, False)})"
_LEAD = like("line", [rules.LEADER_DOTS], False)
_CHROME = like(s("line"), rules.CHROME)
_STRUCT = like(s("line"), rules.STRUCTURAL, False)


def _digest(lines: DataFrame) -> DataFrame:
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return ln.assemble(lines).join(n, "doc_id").select("doc_id", "n_lines", F.md5("markdown").alias("digest"))


_DIGEST = "SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM {t} GROUP BY doc_id"


def _lines(spark, d):
    return ln.explode_lines(framed(spark, d))


def _where(test) -> callable:
    return lambda spark, d: _lines(spark, d).where(test(F.col("line")))


def _dropped(test: str) -> str:
    return f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE {test}"


_REPEAT = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM {{t}}) WHERE NOT (n >= 2 AND length({s('line')}) < 100 AND {s('line')} <> '' AND NOT {_STRUCT})"
_RUNS = f"SELECT doc_id, line_no, line FROM (SELECT *, lag({s('line')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM {{t}}) WHERE NOT ({s('line')} <> '' AND coalesce({s('line')} = b, false) AND NOT {_STRUCT})"


def line_cleanup_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Lines in, lines out and lines dropped by reason of each document."""
    n = lambda *reasons: F.sum(F.col("reason").isin(*reasons).cast("bigint"))
    return ln.tagged(_lines(spark, d)).groupBy("doc_id").agg(
        F.count("*").alias("lines_in"), F.coalesce(n("page_number"), F.lit(0)).alias("page_numbers"), F.coalesce(n("repeated"), F.lit(0)).alias("repeated"),
        F.coalesce(n("artifact", "leader_dots"), F.lit(0)).alias("artifacts"), F.coalesce(n("run"), F.lit(0)).alias("runs"), F.sum(F.col("reason").isNull().cast("bigint")).alias("lines_out"))


_PIPE = f"""{LINES}, l1 AS (SELECT * FROM lines WHERE NOT {_PAGE}), l2 AS ({_REPEAT.replace('{t}', 'l1')}), l3 AS (SELECT * FROM l2 WHERE NOT {_ART} AND NOT {_LEAD}), l4 AS ({_RUNS.replace('{t}', 'l3')})"""
_PIPE_COUNTS = f"""WITH {_PIPE} SELECT a.doc_id, count(*) AS lines_in,
 count(*) - (SELECT count(*) FROM l1 b WHERE b.doc_id = a.doc_id) AS page_numbers,
 (SELECT count(*) FROM l1 b WHERE b.doc_id = a.doc_id) - (SELECT count(*) FROM l2 b WHERE b.doc_id = a.doc_id) AS repeated,
 (SELECT count(*) FROM l2 b WHERE b.doc_id = a.doc_id) - (SELECT count(*) FROM l3 b WHERE b.doc_id = a.doc_id) AS artifacts,
 (SELECT count(*) FROM l3 b WHERE b.doc_id = a.doc_id) - (SELECT count(*) FROM l4 b WHERE b.doc_id = a.doc_id) AS runs,
 (SELECT count(*) FROM l4 b WHERE b.doc_id = a.doc_id) AS lines_out FROM lines a GROUP BY a.doc_id"""


def artifact_removal(spark: SparkSession, d: str) -> DataFrame:
    """Documents through all line rules in order."""
    return ln.remove_artifacts(framed(spark, d)).select("doc_id", F.length("markdown").cast("bigint").alias("n_chars"), F.md5("markdown").alias("digest"))


_GAPS = r"string_split_regex({x}, '\n{{2,}}')"
_TABLE_SIG = f"md5(lower(regexp_replace({s('p')}, '\\s+', ' ', 'g')))"


def _dedupe_sql(src: str, body: str) -> str:
    """Table blocks after the first copy go, the gaps around them stay: parts and gaps are numbered alike."""
    return f"""parts AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) AS INT) AS k, unnest(ps) AS p, unnest(list_append(gs, '')) AS g
   FROM (SELECT doc_id, {_GAPS.format(x=body)} AS ps, regexp_extract_all({body}, '\\n{{2,}}') AS gs FROM {src})),
 marked AS (SELECT *, p LIKE '|%' AND contains(p, chr(10) || '|') AS t, row_number() OVER (PARTITION BY doc_id, CASE WHEN p LIKE '|%' AND contains(p, chr(10) || '|') THEN {_TABLE_SIG} ELSE CAST(k AS VARCHAR) END ORDER BY k) AS nth FROM parts),
 deduped AS (SELECT doc_id, string_agg(CASE WHEN nth = 1 THEN p ELSE '' END || g, '' ORDER BY k) AS markdown FROM marked GROUP BY doc_id)"""


_REMOVED = f"""WITH {_PIPE}, joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM l4 GROUP BY doc_id), {_dedupe_sql('joined', 'markdown')}
 SELECT f.doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (SELECT framed.doc_id, coalesce({s("regexp_replace(deduped.markdown, chr(10) || '{3,}', chr(10) || chr(10), 'g')")}, '') AS t FROM framed LEFT JOIN deduped USING (doc_id)) f"""


def _md5_of(f) -> callable:
    def run(spark, d):
        x = docs(spark, d)
        return x.select("doc_id", F.md5(f(F.col("markdown"))).alias("digest"))

    return run


def _sections(spark, d):
    return table(spark, d, "sections").distinct()


_SECTIONS = "sec AS (SELECT DISTINCT doc_id, seq, type, level, content, prefix FROM sections)"


def section_artifact_filter(spark, d):
    x = _sections(spark, d).where(~F.coalesce(ln.is_section_artifact(F.col("type"), F.col("content")), F.lit(False)))
    return x.groupBy("doc_id", "type").agg(F.count("*").alias("kept"))


_SEC_ALL = "SELECT DISTINCT * FROM sections"


def noise_section_flags(spark, d):
    x = _sections(spark, d).where("type IN ('code', 'paragraph') AND content IS NOT NULL")
    flag = ln.is_noise_section(F.col("type"), F.col("content"), blocks.looks_like_drawing_label(tx.strip(F.col("content"))))
    return x.select("doc_id", "seq", "type", flag.alias("noise"))


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for kv in rules.EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, ext), ext)


def file_type_detect(spark, d):
    p = table(spark, d, "conversion_results").select(F.col("metadata.source_file").alias("source_file")).where("source_file IS NOT NULL").distinct()
    return p.select("source_file", file_type(F.col("source_file")).alias("file_type"))


_EXT = r"lower(regexp_extract(source_file, '[^/](\.[^./]+)$', 1))"
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EXTENSIONS.items())


def supported_extensions(spark, d):
    """The registry of formats, one row each, with the number of files of the input."""
    known = spark.createDataFrame(sorted(rules.EXTENSIONS.items()), "extension string, file_type string")
    e = table(spark, d, "conversion_results").select("doc_id", F.lower(F.regexp_extract("metadata.source_file", r"[^/](\.[^./]+)$", 1)).alias("extension")).distinct()
    return known.join(e, "extension", "left").groupBy("extension", "file_type").agg(F.count("doc_id").alias("files"))


_SUPPORTED = f"""WITH known(extension, file_type) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in rules.EXTENSIONS.items())}),
 e AS (SELECT DISTINCT doc_id, lower(regexp_extract(metadata.source_file, '[^/](\\.[^./]+)$', 1)) AS extension FROM conversion_results)
 SELECT extension, file_type, count(doc_id) AS files FROM known LEFT JOIN e USING (extension) GROUP BY ALL"""


def match_case(spark, d):
    """A fixed word in the case of the first word of each heading."""
    x = _sections(spark, d).where("type = 'heading'").select(F.regexp_extract("content", "^([A-Za-z]+)", 1).alias("sample")).where("sample <> ''").distinct()
    return x.select("sample", tx.match_case(F.col("sample"), F.lit("replacement")).alias("cased"))


_MATCH = r"""SELECT DISTINCT sample, CASE WHEN sample = upper(sample) THEN 'REPLACEMENT' WHEN regexp_matches(sample, '^[A-Z][a-z]+$') THEN 'Replacement'
 WHEN sample = lower(sample) THEN 'replacement' WHEN regexp_matches(sample, '^[A-Z]') THEN 'Replacement' ELSE 'replacement' END AS cased
 FROM (SELECT regexp_extract(content, '^([A-Za-z]+)', 1) AS sample FROM sections WHERE type = 'heading') WHERE sample <> ''"""


def match_case_all(spark, d):
    """As match_case, with the letters of all scripts."""
    x = _sections(spark, d).where("type = 'heading'").select(F.regexp_extract("content", r"^(\p{L}[\p{L}\p{M}]*)", 1).alias("sample")).where("sample <> ''").distinct()
    return x.select("sample", tx.match_case(F.col("sample"), F.lit("replacement")).alias("cased"))


_MATCH_ALL = r"""SELECT sample, CASE WHEN sample = upper(sample) AND regexp_matches(sample, '\p{Lu}') THEN 'REPLACEMENT' WHEN regexp_matches(sample, '^\p{Lu}') AND substr(sample, 2) = lower(substr(sample, 2)) AND length(sample) > 1 THEN 'Replacement'
 WHEN sample = lower(sample) THEN 'replacement' WHEN regexp_matches(sample, '^\p{Lu}') THEN 'Replacement' ELSE 'replacement' END AS cased
 FROM (SELECT DISTINCT regexp_extract(content, '^(\pL[\pL\pM]*)', 1) AS sample FROM sections WHERE type = 'heading') WHERE sample <> ''"""


def html_escape(spark, d):
    return _sections(spark, d).where("content IS NOT NULL").select("doc_id", "seq", F.md5(tx.escape_html(F.col("content"))).alias("digest"))


def filename_sanitize(spark, d):
    t = table(spark, d, "conversion_results").select(F.col("metadata.title").alias("title")).where("title IS NOT NULL AND NOT title RLIKE '[^\\\\x00-\\\\x7F]'").distinct()
    return t.select("title", tx.sanitize_filename(F.col("title")).alias("file_name"))


def filename_sanitize_all(spark, d):
    """As filename_sanitize, of all titles."""
    t = table(spark, d, "conversion_results").select(F.col("metadata.title").alias("title")).where("title IS NOT NULL").distinct()
    return t.select("title", tx.sanitize_filename(F.col("title")).alias("file_name"))


_SANITIZE = r"""SELECT title, CASE WHEN n = '' THEN 'untitled' ELSE n END AS file_name FROM (SELECT title, left(regexp_replace(regexp_replace(regexp_replace(title, '[^\w\s-]', '_', 'g'), '[-\s]+', '_', 'g'), '^_+|_+$', '', 'g'), 50) AS n
 FROM (SELECT DISTINCT metadata.title AS title FROM conversion_results WHERE metadata.title IS NOT NULL AND NOT regexp_matches(metadata.title, '[^\x00-\x7F]')))"""


_SANITIZE_ALL = f"""SELECT title, CASE WHEN n = '' THEN 'untitled' ELSE n END AS file_name FROM (SELECT title, left(regexp_replace(regexp_replace(regexp_replace(title, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s\\pZ\\x{{85}}-]', '_', 'g'), '[-\\s\\pZ\\x{{85}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 50) AS n
 FROM (SELECT DISTINCT metadata.title AS title FROM conversion_results WHERE metadata.title IS NOT NULL))"""


def image_filename(spark, d):
    t = table(spark, d, "extracted_tables").select("page", "table_no").distinct()
    return t.select("page", "table_no", tx.image_filename(F.col("page"), F.col("table_no") + 1, F.lit("png")).alias("file_name"))


def _payloads(spark, d):
    """Texts as if they were images: numbered within their source."""
    x = table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("source", F.lit("none")).alias("doc_id"), F.col("doc_id").cast("int").alias("idx"), F.encode("text", "UTF-8").alias("data"))
    return x


def payload_dedupe(spark, d):
    return images.dedupe_images(_payloads(spark, d)).select(F.col("doc_id").alias("source"), "idx", "md5_12", F.length("data").cast("bigint").alias("bytes"))


_PAYLOAD = """SELECT source, idx, md5_12, bytes FROM (SELECT coalesce(source, 'none') AS source, CAST(doc_id AS INT) AS idx, left(md5(text), 12) AS md5_12, CAST(strlen(text) AS BIGINT) AS bytes,
 row_number() OVER (PARTITION BY coalesce(source, 'none'), md5(text) ORDER BY doc_id) AS nth FROM documents WHERE text IS NOT NULL AND strlen(text) >= 500) WHERE nth = 1"""


def batch_summary(spark, d):
    """Files, failures and the size of all Markdown, by type of file."""
    x = table(spark, d, "conversion_results").select("doc_id", F.coalesce("metadata.file_type", F.lit("unknown")).alias("file_type"), "markdown").distinct()
    ok = F.coalesce(tx.strip(F.col("markdown")) != "", F.lit(False))
    return x.groupBy("file_type").agg(F.count("*").alias("files"), F.sum(ok.cast("bigint")).alias("converted"), F.sum((~ok).cast("bigint")).alias("failed"), F.coalesce(F.sum(F.length("markdown")), F.lit(0)).cast("bigint").alias("n_chars"))


_BATCH = f"""SELECT file_type, count(*) AS files, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS converted, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed, CAST(coalesce(sum(length(markdown)), 0) AS BIGINT) AS n_chars
 FROM (SELECT DISTINCT doc_id, coalesce(metadata.file_type, 'unknown') AS file_type, markdown, coalesce({s('markdown')} <> '', false) AS ok FROM conversion_results) GROUP BY file_type"""


def section_stats(spark, d):
    return blocks.section_stats(_sections(spark, d))


_STATS = """SELECT doc_id, count(*) AS total_sections, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type = 'paragraph') AS paragraphs, count(*) FILTER (type = 'table') AS tables,
 count(*) FILTER (type = 'code') AS code_blocks, count(*) FILTER (type = 'math') AS math_blocks FROM (SELECT DISTINCT * FROM sections) GROUP BY doc_id"""


def summary_lines(spark, d):
    from paperloom.sinks.files import summary_line

    return section_stats(spark, d).select("doc_id", summary_line(F.struct("total_sections", "headings", "paragraphs")).alias("summary"))


def merged_paragraphs(spark, d):
    x = blocks.merge_paragraphs(_sections(spark, d))
    return x.select("doc_id", "seq", "type", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


_MERGED = """WITH sec AS (SELECT DISTINCT doc_id, seq, type, content FROM sections), b AS (SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER w = 'paragraph' THEN 0 ELSE 1 END AS begins FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
 g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY seq) AS grp FROM b)
 SELECT doc_id, min(seq) AS seq, min_by(type, seq) AS type, md5(coalesce(string_agg(content, chr(10) ORDER BY seq), '')) AS digest FROM g GROUP BY doc_id, grp"""


def combined_markdown(spark, d):
    """All files of a type as one text: each under its title, set apart by rules; its length and digest."""
    from paperloom.sinks.files import combined

    x = table(spark, d, "conversion_results").where("markdown IS NOT NULL").select(F.coalesce("metadata.file_type", F.lit("unknown")).alias("batch"), "doc_id", F.col("doc_id").alias("stem"), "markdown").distinct()
    return combined(x, "batch").select("batch", F.length("markdown").cast("bigint").alias("n_chars"), F.md5("markdown").alias("digest"))


_COMBINED = """SELECT batch, CAST(length(m) AS BIGINT) AS n_chars, md5(m) AS digest FROM (SELECT batch, string_agg('# ' || doc_id || chr(10) || chr(10) || markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS m
 FROM (SELECT DISTINCT coalesce(metadata.file_type, 'unknown') AS batch, doc_id, markdown FROM conversion_results WHERE markdown IS NOT NULL) GROUP BY batch)"""


def combined_json(spark, d):
    """All files of a type as one JSON object, with a small object for each; its length and digest."""
    from paperloom.sinks import files

    x = table(spark, d, "conversion_results").where("markdown IS NOT NULL").select(F.coalesce("metadata.file_type", F.lit("unknown")).alias("batch"), "doc_id", F.concat("doc_id", F.lit('"\\')).alias("stem"), "markdown").distinct()
    x = x.withColumn("structured", F.to_json(F.struct(F.length("markdown").alias("n"), F.md5("markdown").alias("digest"))))
    return files.combined_json(x, "batch").select("batch", F.length("json").cast("bigint").alias("n_chars"), F.md5("json").alias("digest"))


_COMBINED_JSON = """SELECT batch, CAST(length(j) AS BIGINT) AS n_chars, md5(j) AS digest FROM (SELECT batch, '{"batch":true,"files":{' || string_agg('"' || doc_id || '\\"\\\\":{"n":' || length(markdown) || ',"digest":"' || md5(markdown) || '"}', ',' ORDER BY doc_id) || '}}' AS j
 FROM (SELECT DISTINCT coalesce(metadata.file_type, 'unknown') AS batch, doc_id, markdown FROM conversion_results WHERE markdown IS NOT NULL) GROUP BY batch)"""


def enhancement_flags(spark, d):
    """Whether anything in a text suggests that a model could help."""
    from paperloom import enhance

    t = F.when(F.length("markdown") % 3 == 0, F.regexp_replace("markdown", "[_^\\t|]|[^\\x00-\\x7F]", "")).otherwise(F.col("markdown"))
    return docs(spark, d).select("doc_id", enhance.needs_enhancement(t).alias("flag"))


_FLAGS = f"""WITH {DOCS}, x AS (SELECT doc_id, CASE WHEN length(markdown) % 3 = 0 THEN regexp_replace(markdown, '[_^\\t|]|[^\\x00-\\x7F]', '', 'g') ELSE markdown END AS t FROM docs), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM x)
 SELECT doc_id, regexp_matches(t, '([^\\s]\\t){{2,}}|[a-zA-Z]\\^[0-9]|[a-zA-Z]_[0-9]|[^\\x00-\\x7F]{{3,}}') OR len(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i], '\\|.*\\|') AND NOT (regexp_matches(ls[i + 1], '^\\|[-\\s:|]') OR (ls[i + 1] = '|' AND i + 1 < len(ls))))) > 0 AS flag FROM l"""


def chunk_fixed(spark, d):
    x = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return chunking.fixed_chunks(x, "text", 1000, 100).select("doc_id", "chunk_no", "start", F.md5("chunk").alias("digest"))


_CHUNK = """SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(k * 900 AS INT) AS start, md5(substr(t, k * 900 + 1, 1000)) AS digest
 FROM (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1000 THEN [0] ELSE range(0, (length(t) - 1) // 900 + 1) END) AS k FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents WHERE text IS NOT NULL))"""


def chunk_paragraph(spark, d):
    return chunking.chunks(docs(spark, d)).select("doc_id", "chunk_no", "start", F.length("chunk").alias("n_chars"))


# Chunk after chunk: a window ends behind its last blank line if that lies in its second half.
_PARAGRAPHS = f"""WITH RECURSIVE {DOCS}, c AS (SELECT doc_id, 0 AS chunk_no, 0 AS start, markdown AS t FROM docs
 UNION ALL SELECT doc_id, chunk_no + 1, stop - 500, t FROM (SELECT *, start + CASE WHEN start + 15000 < length(t) AND r > 0 AND 14999 - r > 7500 THEN 15001 - r ELSE 15000 END AS stop
  FROM (SELECT *, strpos(reverse(substr(t, start + 1, 15000)), chr(10) || chr(10)) AS r FROM c WHERE length(t) > 15000)) WHERE stop - 500 < length(t)),
 e AS (SELECT *, strpos(reverse(substr(t, start + 1, 15000)), chr(10) || chr(10)) AS r FROM c)
 SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(start AS INT) AS start, CAST(CASE WHEN start + 15000 < length(t) AND r > 0 AND 14999 - r > 7500 THEN 15001 - r ELSE least(15000, length(t) - start) END AS INT) AS n_chars FROM e"""


def _changed(f) -> callable:
    """Documents of the corpus that a text repair changes, with the digest of the result."""

    def run(spark, d):
        x = docs(spark, d).select("doc_id", "markdown", f(F.col("markdown")).alias("t"))
        return x.where("t <> markdown").select("doc_id", F.md5("t").alias("digest"))

    return run


# Spaced words in front of a text, by a number both engines share, and what they become.
_SPACED = """CASE length(m) % 4 WHEN 0 THEN 'R E P O R T   O N   P u m p s' WHEN 1 THEN '- A B C D  E   f g h i' WHEN 2 THEN '1 2 3 4 a b' ELSE 'A B C' || chr(10) || 'D E F G' END"""
_JOINED = """CASE length(m) % 4 WHEN 0 THEN 'Report   O N   Pumps' WHEN 1 THEN '- Abcde fghi' WHEN 2 THEN '1234ab' ELSE 'A B C' || chr(10) || 'Defg' END"""


def spaced_words_joined(spark, d):
    """Texts with spaced words in front of them, those joined."""
    x = docs(spark, d).withColumnRenamed("markdown", "m").select("doc_id", F.expr(f"{_SPACED} || chr(10) || m").alias("t"))
    return x.select("doc_id", F.md5(tx.collapse_spaced(F.col("t"))).alias("digest"))


# A word sign in Unicode.
_W = r"[\pL\pM\p{Nd}\p{Nl}_]"
_FINAL = f"""WITH {DOCS}, a AS (SELECT doc_id, replace(replace(replace(replace(markdown, '\\\\(', '\\('), '\\\\)', '\\)'), '\\\\[', '\\['), '\\\\]', '\\]') AS t FROM docs),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '({_W}){_WS0}\\^{_WS0}(\\p{{Nd}})', '\\1^{{\\2}}', 'g'), '({_W}){_WS0}_{_WS0}(\\p{{Nd}})', '\\1_{{\\2}}', 'g') AS t FROM a)
 SELECT doc_id, md5({s("regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM b"""
# All bars and hashes are escaped, then those behind a word sign are put back.
_ESCAPED = f"""WITH {DOCS}, e AS (SELECT doc_id, markdown, regexp_replace(regexp_replace(markdown, '([#|])', '\\\\\\1', 'g'), '({_W})\\\\([#|])', '\\1\\2', 'g') AS t FROM docs) SELECT doc_id, md5(t) AS digest FROM e WHERE t <> markdown"""


# Lines are folded in order: d what is finished, l the last line, o whether it may go on.
_PROSE = f"length({s('x')}) >= 20 AND NOT regexp_matches({s('x')}, '^(?:#|\\||```|>|-|\\*|\\$\\$|\\d+[.)][\\s\\pZ]|(?i:table[\\s\\pZ]+\\d+|figure[\\s\\pZ]+\\d+|rev\\.[\\s\\pZ]*[A-Z][\\s\\pZ]*\\|))')"
_left = lambda x: f"regexp_replace({x}, '^{_WS}', '')"
_right = lambda x: f"regexp_replace({x}, '{_WS}$', '')"
_JOINS = f"a.o AND b.o AND NOT (length(a.l) > 120 AND right(a.l, 1) IN ('.', '!', '?') AND regexp_matches({_left('b.l')}, '^\\p{{Lu}}'))"
_GLUED = f"a.l || CASE WHEN a.l LIKE '%-' THEN '' ELSE ' ' END || {_left('b.l')}"
_REFLOW = f"""WITH {DOCS}, f AS (SELECT doc_id, markdown, list_transform(string_split(markdown, chr(10)), lambda x: {{'d': '', 'l': x, 'o': {_PROSE}}}) AS ls FROM docs),
 g AS (SELECT doc_id, markdown, list_transform(ls, lambda b: {{'d': '', 'l': CASE WHEN b.o THEN {_right('b.l')} ELSE b.l END, 'o': b.o}}) AS first, ls FROM f),
 r AS (SELECT doc_id, markdown, list_reduce(list_prepend(first[1], ls[2:]), lambda a, b: CASE WHEN {_JOINS} THEN {{'d': a.d, 'l': {_GLUED}, 'o': length({_GLUED}) <= 2000}}
  ELSE {{'d': a.d || a.l || chr(10), 'l': CASE WHEN b.o THEN {_right('b.l')} ELSE b.l END, 'o': b.o}} END) AS z FROM g)
 SELECT doc_id, md5(z.d || z.l) AS digest FROM r WHERE z.d || z.l <> markdown"""
# Neighbouring bold spans merge in pairs; seven rounds are more than any chain of the input needs.
# The word boundary of the one engine knows all letters.  Blanks and line feeds are doubled, so that each find has its own on both sides.
_BOLD = "replace(replace(markdown, ' ', '  '), chr(10), chr(10) || chr(10))"
_BOLD = f"regexp_replace({_BOLD}, '(^|[^\\pL\\pM\\p{{Nd}}_])([a-z]+ing)  ([a-z]+)($|[^\\pL\\pM\\p{{Nd}}_])', '\\1**\\2**  **\\3**\\4', 'g')"
_BOLD = f"replace(replace({_BOLD}, '  ', ' '), chr(10) || chr(10), chr(10))"


def bold_merged(x: str, rounds: int = 7) -> str:
    """SQL for a text with neighbouring bold spans merged."""
    for _ in range(rounds):
        x = f"regexp_replace({x}, '\\*\\*([^*]+?)\\*\\*({_WS})\\*\\*([^*]+?)\\*\\*', '**\\1\\2\\3**', 'g')"
    return f"regexp_replace({x}, '\\*\\*([,.;:]+)\\*\\*', '\\1', 'g')"


_BOLD = f"WITH {DOCS}, x AS (SELECT doc_id, markdown, {bold_merged(_BOLD)} AS t FROM docs) SELECT doc_id, md5(t) AS digest FROM x WHERE t <> markdown"


def lines_digest(f) -> callable:
    return lambda spark, d: _digest(f(_lines(spark, d)))


QUERIES = {
    "line_cleanup_pipeline": line_cleanup_pipeline,
    "file_type_detect": file_type_detect,
    "supported_extensions": supported_extensions,
    "page_number_filter": _where(ln.is_page_number),
    "artifact_pattern_filter": _where(ln.is_artifact),
    "leader_dot_filter": _where(ln.is_leader),
    "chrome_line_filter": _where(ln.is_chrome),
    "repeated_line_filter": lines_digest(ln.drop_repeated),
    "duplicate_run_collapse": lines_digest(ln.collapse_runs),
    "artifact_removal": artifact_removal,
    "structural_line_flags": lambda spark, d: _lines(spark, d).groupBy("doc_id").agg(F.sum(ln.is_structural(tx.strip(F.col("line"))).cast("bigint")).alias("structural")),
    "patent_print_flag": lambda spark, d: docs(spark, d).select("doc_id", ln.looks_like_patent_print(F.concat("markdown", F.when(F.length("markdown") % 2 == 0, " Find prior art - Download pdf").otherwise(" Patent"))).alias("patent_print")),
    "md_table_strip": lines_digest(ln.drop_table_lines),
    "md_table_offsets": lambda spark, d: ln.table_offsets(_lines(spark, d)),
    "md_table_dedupe": lambda spark, d: ln.dedupe_tables(docs(spark, d).select("doc_id", F.concat_ws("\n\n", "markdown", "markdown").alias("markdown"))).select("doc_id", F.md5("markdown").alias("digest")),
    "section_artifact_filter": section_artifact_filter,
    "whitespace_clean": _md5_of(lambda t: tx.clean_whitespace(F.concat(F.lit("  \n"), F.replace(t, F.lit(". "), F.lit(".  \n\n\n\n"))))),
    "math_detect": lambda spark, d: _sections(spark, d).where("content IS NOT NULL").select("doc_id", "seq", tx.is_math(F.when(F.col("seq") % 4 == 0, F.concat("content", F.lit(" \\frac{a}{b}"))).otherwise(F.col("content"))).alias("is_math")),
    "match_case": match_case,
    "match_case_all": match_case_all,
    "html_escape": html_escape,
    "filename_sanitize": filename_sanitize,
    "filename_sanitize_all": filename_sanitize_all,
    "image_filename": image_filename,
    "short_hash": lambda spark, d: docs(spark, d).select("doc_id", tx.short_hash(F.col("markdown")).alias("hash")),
    "payload_dedupe": payload_dedupe,
    "batch_summary": batch_summary,
    "section_stats": section_stats,
    "merged_paragraphs": merged_paragraphs,
    "summary_lines": summary_lines,
    "combined_markdown": combined_markdown,
    "combined_json": combined_json,
    "enhancement_flags": enhancement_flags,
    "truncate_text": _md5_of(lambda t: tx.truncate(t, 2000)),
    "strip_model_fence": _md5_of(lambda t: tx.strip_model_fence(F.concat(F.lit("```\n"), t, F.lit("\n```")))),
    "final_cleanup": _md5_of(tx.final_cleanup),
    "human_size": lambda spark, d: table(spark, d, "documents").select("doc_id", tx.human_size((F.col("n_chars") * F.col("n_chars")).cast("double")).alias("size")),
    "escape_markdown": _changed(tx.escape_markdown),
    "chunk_fixed": chunk_fixed,
    "chunk_paragraph": chunk_paragraph,
    "ligature_fix": _changed(tx.fix_words),
    "spaced_text_collapse": _changed(tx.collapse_spaced),
    "spaced_words_joined": spaced_words_joined,
    "bold_defragment": _changed(lambda t: tx.defragment_bold(F.regexp_replace(t, r"\b([a-z]+ing) ([a-z]+)\b", "**$1** **$2**"))),
    "reflow": _changed(tx.reflow_hard_wraps),
}

SQL = {
    "line_cleanup_pipeline": _PIPE_COUNTS,
    "file_type_detect": f"SELECT source_file, CASE {_EXT} {_TYPES} ELSE {_EXT} END AS file_type FROM (SELECT DISTINCT metadata.source_file AS source_file FROM conversion_results WHERE metadata.source_file IS NOT NULL)",
    "supported_extensions": _SUPPORTED,
    "page_number_filter": _dropped(_PAGE),
    "artifact_pattern_filter": _dropped(_ART),
    "leader_dot_filter": _dropped(_LEAD),
    "chrome_line_filter": _dropped(_CHROME),
    "repeated_line_filter": f"WITH {LINES}, k AS ({_REPEAT.replace('{t}', 'lines')}) {_DIGEST.replace('{t}', 'k')}",
    "duplicate_run_collapse": f"WITH {LINES}, k AS ({_RUNS.replace('{t}', 'lines')}) {_DIGEST.replace('{t}', 'k')}",
    "artifact_removal": _REMOVED,
    "structural_line_flags": f"WITH {LINES} SELECT doc_id, CAST(sum(CASE WHEN {_STRUCT} THEN 1 ELSE 0 END) AS BIGINT) AS structural FROM lines GROUP BY doc_id",
    "patent_print_flag": f"WITH {DOCS} SELECT doc_id, ({' + '.join(f'CAST(contains(lower(t), {chr(39)}{x.lower()}{chr(39)}) AS INT)' for x in rules.PATENT_PRINT)}) >= 2 AS patent_print FROM (SELECT doc_id, markdown || CASE WHEN length(markdown) % 2 = 0 THEN ' Find prior art - Download pdf' ELSE ' Patent' END AS t FROM docs)",
    "md_table_strip": f"WITH {LINES}, k AS (SELECT * FROM lines WHERE NOT starts_with({s('line')}, '|')) {_DIGEST.replace('{t}', 'k')}",
    "md_table_offsets": f"""WITH {LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, starts_with({s('line')}, '|') AND contains(substr({s('line')}, 2), '|') AS r FROM lines),
 b AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS blk FROM o)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(o)) - 1 AS INT) AS table_no, CAST(min(o) AS BIGINT) AS start, CAST(max(o + length(line)) AS BIGINT) AS "end" FROM b WHERE r GROUP BY doc_id, blk""",
    "md_table_dedupe": f"WITH {DOCS}, twice AS (SELECT doc_id, markdown || chr(10) || chr(10) || markdown AS markdown FROM docs), {_dedupe_sql('twice', 'markdown')} SELECT doc_id, md5(markdown) AS digest FROM deduped",
    "section_artifact_filter": f"SELECT doc_id, type, count(*) AS kept FROM ({_SEC_ALL}) WHERE NOT coalesce(type = 'paragraph' AND ({s('coalesce(content, {0})'.format(chr(39) * 2))} = '' OR regexp_matches({s('content')}, '^\\pN+$') OR regexp_matches({s('content')}, '^(draft|confidential|watermark)$', 'i')), false) GROUP BY doc_id, type",
    "whitespace_clean": f"WITH {DOCS} SELECT doc_id, md5({s('t')}) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace('  ' || chr(10) || replace(markdown, '. ', '.  ' || repeat(chr(10), 4)), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM docs)",
    "math_detect": f"SELECT doc_id, seq, {like('t', rules.MATH, False)} AS is_math FROM (SELECT DISTINCT doc_id, seq, CASE WHEN seq % 4 = 0 THEN content || ' \\frac{{a}}{{b}}' ELSE content END AS t FROM ({_SEC_ALL}) WHERE content IS NOT NULL)",
    "match_case": _MATCH,
    "match_case_all": _MATCH_ALL,
    "html_escape": f"SELECT doc_id, seq, md5(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM ({_SEC_ALL}) WHERE content IS NOT NULL",
    "filename_sanitize": _SANITIZE,
    "filename_sanitize_all": _SANITIZE_ALL,
    "image_filename": "SELECT DISTINCT page, table_no, printf('page%03d_img%03d.png', page, table_no + 1) AS file_name FROM extracted_tables",
    "short_hash": f"WITH {DOCS} SELECT doc_id, left(md5(markdown), 12) AS hash FROM docs",
    "payload_dedupe": _PAYLOAD,
    "batch_summary": _BATCH,
    "section_stats": _STATS,
    "merged_paragraphs": _MERGED,
    "summary_lines": f"SELECT doc_id, 'Total Sections: ' || total_sections || ' · Headings: ' || headings || ' · Paragraphs: ' || paragraphs AS summary FROM ({_STATS})",
    "combined_markdown": _COMBINED,
    "combined_json": _COMBINED_JSON,
    "enhancement_flags": _FLAGS,
    "truncate_text": f"WITH {DOCS} SELECT doc_id, md5(CASE WHEN length(markdown) > 2000 THEN left(markdown, 2000) || chr(10) || chr(10) || '... [TRUNCATED due to length] ...' ELSE markdown END) AS digest FROM docs",
    "strip_model_fence": f"WITH {DOCS} SELECT doc_id, md5(regexp_replace(regexp_replace({s('t')}, '^```\\n?', ''), '\\n?```$', '')) AS digest FROM (SELECT doc_id, '```' || chr(10) || markdown || chr(10) || '```' AS t FROM docs)",
    "final_cleanup": _FINAL,
    "escape_markdown": _ESCAPED,
    "chunk_paragraph": _PARAGRAPHS,
    "reflow": _REFLOW,
    "bold_defragment": _BOLD,
    "spaced_words_joined": f"SELECT doc_id, md5({_JOINED} || chr(10) || m) AS digest FROM (SELECT DISTINCT doc_id, markdown AS m FROM conversion_results WHERE markdown IS NOT NULL)",
    "human_size": "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM (SELECT doc_id, CAST(n_chars * n_chars AS DOUBLE) AS n FROM documents)",
    "chunk_fixed": _CHUNK,
}
