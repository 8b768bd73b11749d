"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import leaks, lookalikes, near, packing, pieces, scans, truncation
from paperloom.session import materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings(table(spark, d, "sections"), table(spark, d, "conversion_results")).select("doc_id", "seq", "line_no", "kind").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "sections"), table(spark, d, "conversion_results"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, "conversion_results"), table(spark, d, "chunk_profiles"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "conversion_results"), table(spark, d, "chunk_profiles"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together again from its pieces, and whether all of them fit."""
    p = table(spark, d, "chunk_profiles").distinct()
    x = pieces.split(table(spark, d, "conversion_results"), p).join(p, "profile")
    own = F.when(F.col("piece") == 0, F.col("piece_text")).otherwise(F.expr("substring(piece_text, overlap_chars + 1)"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("t")))), lambda x: x["t"]), "")
    fits = F.max(F.length("piece_text")) <= F.first("max_chars")
    return x.groupBy("profile", "doc_id").agg(F.md5(whole).alias("digest"), fits.alias("fits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_as(table(spark, d, "sections"), table(spark, d, "ref_texts"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Each section whose content changes, with the one form its class takes."""
    s = table(spark, d, "sections").where("content IS NOT NULL").select("doc_id", "seq", F.col("content").alias("value"))
    c = lookalikes.classes(s.select("value"), table(spark, d, "ref_texts").select(F.col("content").alias("value")), all_values=False)
    # the changed values are few beside the sections; they are computed once
    return s.join(materialise(c.where("value <> canonical")), "value").select("doc_id", "seq", F.col("value").alias("content"), "canonical").distinct()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversion_results").select(F.col("doc_id").alias("id"), F.col("markdown").alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = near.links(_texts(spark, d), width=3, threshold=0.6)
    return near.id_pairs(members, pairs).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per file with a text: its group, and its links to other texts (five words, 0.8)."""
    members, pairs = near.links(_texts(spark, d))
    return near.groups(members, pairs).withColumnRenamed("id", "doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_containers(spark, d), table(spark, d, "pack_targets"))


def p6_compared(spark: SparkSession, d: str) -> DataFrame:
    """The containers of the evolution beside those of plain best fit, and the lower bound."""
    return packing.compared(p6_containers(spark, d), table(spark, d, "pack_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_removed(spark: SparkSession, d: str) -> DataFrame:
    """The number of words cut out of each document, and whether enough is left of it."""
    return p7_clean(spark, d).select("doc_id", "removed", "kept").distinct()


def p7_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.by_benchmark(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many of the cut documents are shown by what: a prefix join on texts, lines, sentences or words, or the end alone."""
    return truncation.evidence(table(spark, d, "documents")).groupBy("evidence").agg(F.count("*").alias("documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.rates(docs, truncation.truncated(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_canonical, p5_found, p5_groups, p6_containers, p6_fill, p6_compared, p7_found, p7_clean, p7_removed, p7_benchmarks, p8_found, p8_evidence, p8_rates)}
_WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_GRAMS = """SELECT {k}, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT {k}, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM {t})"""
_LEAKS = f"""items AS (SELECT item_id, least(13, len(w)) AS n, w FROM (SELECT item_id, {_WORDS.format(x='text')} AS w FROM eval_items) WHERE len(w) > 0), ig AS ({_GRAMS.format(k='item_id', t='items')}),
 lens AS (SELECT DISTINCT n FROM items), d AS (SELECT doc_id, n, w FROM (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL), lens WHERE len(w) >= n), dg AS ({_GRAMS.format(k='doc_id', t='d')}),
 hits AS (SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (n, g))"""
_STRETCH = r"'[^\s\pZ\x{85}\x1c-\x1f.!?。！？]+'"



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _form(x: str) -> str:
    """SQL for the form that equal-looking texts share."""
    for letter, parts in lookalikes._APART.items():
        x = f"replace({x}, {_text(letter)}, {_text(parts)})"
    out = f"translate({x}, {_text(lookalikes.FROM + lookalikes._UNSEEN)}, {_text(lookalikes.TO)})"
    for sign, letters in lookalikes._JOINED.items():
        out = f"replace({out}, {_text(sign)}, {_text(letters)})"
    return f"nfc_normalize(trim(regexp_replace({out}, ' {{2,}}', ' ', 'g')))"


SQL: dict[str, str] = {
    "p2_rebuilt": "SELECT DISTINCT profile, doc_id, md5(markdown) AS digest, true AS fits FROM conversion_results, chunk_profiles WHERE length(markdown) > max_chars",
    "p3_found": f"""WITH s AS (SELECT doc_id, seq, content, {_form('content')} AS form FROM sections WHERE content IS NOT NULL), r AS (SELECT ref_id, content, {_form('content')} AS form FROM ref_texts WHERE content IS NOT NULL)
 SELECT DISTINCT ref_id, doc_id, seq FROM r JOIN s USING (form) WHERE r.content <> s.content""",
    "p3_canonical": f"""WITH v AS (SELECT content AS value, count(*) AS copies, NULL AS wanted FROM sections WHERE content IS NOT NULL GROUP BY content UNION ALL SELECT DISTINCT content, 0, content FROM ref_texts WHERE content IS NOT NULL),
 u AS (SELECT value, sum(copies) AS copies, min(wanted) AS wanted, {_form('value')} AS form FROM v GROUP BY value),
 b AS (SELECT *, coalesce(min(wanted) OVER (PARTITION BY form), first_value(value) OVER (PARTITION BY form ORDER BY copies DESC, value)) AS canonical FROM u)
 SELECT DISTINCT doc_id, seq, content, canonical FROM sections JOIN b ON b.value = content WHERE content <> canonical""",
    "p2_found": f"""WITH m AS (SELECT DISTINCT doc_id, markdown, list_max(list_transform(regexp_extract_all(markdown, {_STRETCH}), lambda x: length(x))) AS s FROM conversion_results WHERE markdown IS NOT NULL)
 SELECT DISTINCT profile, doc_id, 'oversized' AS kind FROM m, chunk_profiles WHERE length(markdown) > max_chars UNION ALL SELECT DISTINCT profile, doc_id, 'forced' FROM m, chunk_profiles WHERE length(markdown) > max_chars AND s > max_chars""",
    "p5_found": f"""WITH w AS (SELECT doc_id, {_WORDS.format(x='markdown')} AS w FROM (SELECT DISTINCT doc_id, markdown FROM conversion_results WHERE markdown IS NOT NULL)),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.6 * (a.n + b.n - c)""",
    "p5_groups": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x='markdown')} AS w FROM (SELECT DISTINCT doc_id, markdown FROM conversion_results WHERE markdown IS NOT NULL)),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
 k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY doc_id), r AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY h), rs AS (SELECT rep, g FROM r JOIN s ON s.doc_id = rep),
 p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL), l AS (SELECT x, y FROM p JOIN r a ON a.rep = x JOIN r b ON b.rep = y WHERE c >= 0.8 * (a.n + b.n - c)),
 reach(x, y) AS (SELECT rep, rep FROM r UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y), comp AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x), deg AS (SELECT x AS rep, count(*) AS links FROM l GROUP BY x)
 SELECT doc_id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM k JOIN r USING (h) JOIN comp USING (rep) LEFT JOIN deg USING (rep)""",
    "p7_found": f"WITH {_LEAKS} SELECT item_id, doc_id FROM hits",
    "p7_removed": f"""WITH {_LEAKS.split(' hits AS')[0]} win AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g, i FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d)),
 spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS spot FROM win JOIN (SELECT DISTINCT n, g FROM ig) USING (n, g)), gone AS (SELECT doc_id, count(*) AS removed FROM spots GROUP BY doc_id)
 SELECT DISTINCT doc_id, coalesce(removed, 0) AS removed, removed IS NULL OR removed < 0.5 * len({_WORDS.format(x='text')}) AS kept FROM documents LEFT JOIN gone USING (doc_id)""",
    "p7_benchmarks": f"""WITH {_LEAKS} SELECT benchmark, count(DISTINCT item_id) AS items, count(DISTINCT CASE WHEN doc_id IS NOT NULL THEN item_id END) AS leaked_items, count(DISTINCT doc_id) AS documents FROM eval_items LEFT JOIN hits USING (item_id) GROUP BY benchmark""",
}
