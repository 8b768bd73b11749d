"""The whole conversion: decoded relations or files in, one result per document out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom import enhance as en
from paperloom.config import Config
from paperloom.functions import text as tx
from paperloom.operators import blocks as bl, images as im, lines as ln, tables as tb
from paperloom.session import materialise
from paperloom.sources import scan as sc
from paperloom.sources.decode import decode


#: A section of any format on its way to a result.
_COLUMNS = ["doc_id", "part_no", "para_no", "type", "level", "content", "prefix", "headers", "rows", "source", "score", "path", "markdown"]


def clean_markdown(text: Column, config: Config, tables_gone: bool) -> Column:
    """The post-pass on a document's Markdown, in one Python stage."""
    return tx.clean_text(text, tables_gone, config.fix_lost_letters or config.fix_misread_words)


def clean_sections(sections: DataFrame, config: Config) -> DataFrame:
    """Sections without discarded tables, near-empty prose and artifacts; contents cleaned.

    Of decoded pages (``layout`` is true, or there is no such column) noise and
    repeated tables go as well, and words are repaired.  Columns as given.
    """
    names = sections.columns
    s = sections if "layout" in names else sections.withColumn("layout", F.lit(True))
    label = bl.looks_like_drawing_label(tx.strip(F.coalesce("content", F.lit(""))))
    noise = F.coalesce(ln.is_noise_section(F.col("type"), F.coalesce("content", F.lit("")), label), F.lit(False))
    s = s.where(~(F.col("layout") & noise))
    rest = s.where("type IS NULL OR type <> 'table'")
    prose = F.col("type").isin("paragraph", "heading") & F.col("content").isNotNull()
    lines = F.filter(F.split(tx.defragment_bold(F.col("content")), "\n", -1), lambda x: ~ln.is_chrome(x))
    rest = rest.withColumn("content", F.when(prose, F.array_join(lines, "\n")).otherwise(F.col("content"))).where(~(prose & (F.length(tx.strip(F.col("content"))) < 2)))
    if config.fix_lost_letters or config.fix_misread_words:
        rest = rest.withColumn("content", F.when(F.col("layout"), tx.clean_words(F.col("content"))).otherwise(F.col("content")))
    if config.extract_tables:
        t = s.where("type = 'table'")
        t = tb.dedupe_list(t.where("layout")).unionByName(t.where("NOT layout"))
        rest = rest.unionByName(tb.kept(t).select(*rest.columns))
    if config.remove_artifacts:
        rest = rest.where(~F.coalesce(ln.is_section_artifact(F.col("type"), F.col("content")), F.lit(False)))
    return rest.select(*names)


def layout_sections(decoded: DataFrame, config: Config) -> DataFrame:
    """The sections of decoded pages: typed blocks, then the page's vetted tables."""
    spans = decoded.where("span IS NOT NULL").select("doc_id", "span.*")
    raw = decoded.where("raw.source IS NOT NULL").select("doc_id", "raw.*")
    s = bl.layout_sections(spans, tb.vetted(raw) if config.extract_tables else None)
    return s.withColumn("path", F.lit(None).cast("string")).select(*_COLUMNS)


def image_sections(decoded: DataFrame, config: Config) -> DataFrame:
    """The sections of recognised images: paragraphs by type, tables of words behind them, and the image itself."""
    text = decoded.where("ocr IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.collect_list("ocr.text"), "\n\n").alias("ocr_text"))
    if config.extract_tables:
        words = tb.ocr_tables(decoded.where("word IS NOT NULL").select("doc_id", "word.*"))
        words = words.select("doc_id", tb.table_markdown(F.col("headers"), F.col("rows")).alias("table"))
        text = text.join(words, "doc_id", "left").withColumn("ocr_text", F.concat_ws("\n\n", "ocr_text", "table"))
    none = lambda t: F.lit(None).cast(t)
    rest = [none("string").alias("prefix"), none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"), none("string").alias("source"), none("double").alias("score")]
    s = bl.ocr_paragraphs(text).select("doc_id", F.lit(0).alias("part_no"), F.col("seq").alias("para_no"), "type", "level", "content", *rest, none("string").alias("path"), "markdown")
    if config.extract_images:
        name = F.concat(F.lit("images/"), F.col("image.source"))
        own = decoded.where("image.source LIKE 'source_image%'").select(
            "doc_id", F.lit(0).alias("part_no"), F.lit(1_000_000_000).alias("para_no"), F.lit("image").alias("type"), none("int").alias("level"), none("string").alias("content"), *rest,
            F.regexp_replace(name, r"\.[^./]+$", "").alias("path"), F.concat(F.lit("![Source Image]("), name, F.lit(")")).alias("markdown"))
        s = s.unionByName(own)
    return s.select(*_COLUMNS)


def office_sections(decoded: DataFrame, config: Config) -> DataFrame:
    """The sections of decoded Word and slide files, in the columns of all formats, with ``slide``."""
    runs = decoded.where("run IS NOT NULL").select("doc_id", "run.*")
    none = lambda t: F.lit(None).cast(t)
    word = bl.docx_sections(runs.where("part_no = 0"))
    slide = bl.pptx_sections(runs.where("part_no > 0"))
    text = word.unionByName(slide).select("doc_id", "part_no", "para_no", "type", "level", "content", "prefix", none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"), "markdown")
    if config.extract_tables:
        raw = decoded.where("raw IS NOT NULL AND raw.source IS NULL").select("doc_id", "raw.*").withColumn("t", tb.first_row_headers(F.col("matrix")))
        has = runs.where("part_no > 0").select("doc_id").distinct().withColumn("slides", F.lit(True))
        raw = raw.join(has, "doc_id", "left")
        part = F.when(F.col("slides"), F.col("page")).otherwise(0)
        para = F.when(F.col("slides"), 1_000_000 + F.col("table_no")).otherwise(F.col("page"))
        tabs = raw.select("doc_id", part.alias("part_no"), para.cast("int").alias("para_no"), F.lit("table").alias("type"), none("int").alias("level"), none("string").alias("content"), none("string").alias("prefix"), "t.headers", "t.rows", tb.table_markdown(F.col("t.headers"), F.col("t.rows")).alias("markdown"))
        text = text.unionByName(tabs.where("markdown <> ''"))
    text = text.withColumn("source", none("string")).withColumn("score", none("double")).withColumn("path", none("string"))
    return text.select(*_COLUMNS).withColumn("slide", F.col("part_no") > 0)


def results(sections: DataFrame, config: Config) -> DataFrame:
    """(doc_id, markdown, sections) of all formats; ``sections`` has also ``layout`` and ``slide``.

    The Markdown is that of the sections as decoded, with slides set apart by
    rules; the sections in the result are the cleaned ones.
    """
    part = sections.groupBy("doc_id", "part_no").agg(bl.ordered_join(["para_no"], "markdown", "\n\n").alias("md"), F.max("slide").alias("slide"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "md"))), lambda x: x["md"])
    joined = F.when(F.max("slide"), F.array_join(texts, "\n\n---\n\n")).otherwise(F.array_join(texts, "\n\n"))
    doc = part.groupBy("doc_id").agg(tx.clean_whitespace(joined).alias("markdown"))
    cols = ["type", "level", "content", "prefix", "headers", "rows", "source", "score", "path"]
    kept = clean_sections(sections, config).groupBy("doc_id")
    sec = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "para_no", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("sections"))
    return doc.join(sec, "doc_id", "left")


def stats(sections: Column) -> Column:
    n = lambda t: F.size(F.filter(sections, lambda x: x["type"] == t)).alias
    return F.struct(F.size(sections).alias("total_sections"), n("heading")("headings"), n("paragraph")("paragraphs"), n("table")("tables"), n("code")("code_blocks"), n("math")("math_blocks"))


def convert_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, status, error, enhance_error, markdown, structured, images, metadata): one row for each file, failed ones too.

    ``files`` has doc_id, file_type, content.
    """
    decoded = materialise(decode(files, sc.decoders()))
    no, yes = F.lit(False), F.lit(True)
    every = office_sections(decoded, config).withColumn("layout", no)
    every = every.unionByName(layout_sections(decoded, config).withColumn("slide", no).withColumn("layout", yes))
    every = every.unionByName(image_sections(decoded, config).withColumn("slide", no).withColumn("layout", no))
    base = materialise(results(materialise(every), config))
    if config.remove_artifacts:
        base = base.drop("markdown").join(ln.remove_artifacts(base, "markdown", config.min_repetition), "doc_id")
    if config.extract_tables:
        base = base.drop("markdown").join(without_garbage_tables(base), "doc_id")
    base = base.withColumn("markdown", clean_markdown(F.col("markdown"), config, not config.extract_tables))
    if config.use_llm:
        base = en.enhance(base, en.provider(config.llm_provider, config.llm_model, config.llm_host, config.llm_api_key))
    else:
        base = base.withColumn("enhance_error", F.lit(None).cast("string"))
    meta = decoded.where("meta IS NOT NULL").select("doc_id", "meta")
    failed = decoded.where("error IS NOT NULL").select("doc_id", "error")
    out = files.select("doc_id", "file_type").join(base, "doc_id", "left").join(meta, "doc_id", "left").join(failed, "doc_id", "left")
    if config.extract_images:
        raw = decoded.where("image IS NOT NULL").select("doc_id", "image.*")
        raw = raw.withColumn("place", F.coalesce("page", F.lit(0)).cast("bigint") * 1_000_000 + F.col("idx"))
        named = im.named(im.dedupe_images(raw, place="place"))
        pics = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "filename", "extension", "source", "md5_12", "data"))).alias("images"))
        out = out.join(pics, "doc_id", "left")
    else:
        out = out.withColumn("images", F.lit(None).cast("array<struct<place:bigint,filename:string,extension:string,source:string,md5_12:string,data:binary>>"))
    stem = F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]+)?$", 1)
    title = F.when((F.col("meta.title") == "") & (F.col("file_type") == "pptx"), stem).otherwise(F.col("meta.title"))
    refs = F.transform(F.coalesce("images", F.array().cast("array<struct<place:bigint,filename:string,extension:string,source:string,md5_12:string,data:binary>>")), lambda x: F.struct(F.concat(F.lit("images/"), x["filename"]).alias("path"), x["filename"].alias("filename")))
    meta = F.struct(title.alias("title"), F.col("meta.author").alias("author"), F.col("meta.subject").alias("subject"), F.col("meta.created").alias("created"), F.col("meta.modified").alias("modified"),
        F.col("meta.page_count").alias("page_count"), F.col("meta.slide_count").alias("slide_count"), F.col("doc_id").alias("source_file"), F.lit(config.use_llm).alias("use_llm"), F.lit(config.remove_artifacts).alias("artifacts_removed"))
    done = F.col("error").isNull()
    md = F.coalesce("markdown", F.lit(""))
    structured = F.to_json(F.struct(title.alias("title"), meta.alias("metadata"), F.col("sections"), refs.alias("images"), stats(F.coalesce("sections", F.array().cast(_SECTIONS))).alias("stats"), md.alias("markdown")))
    return out.select("doc_id", F.when(done, "ok").otherwise("failed").alias("status"), "error", "enhance_error", F.when(done, md).alias("markdown"), F.when(done, structured).alias("structured"), "images", F.when(done, meta).alias("metadata"))


_SECTIONS = "array<struct<type:string,level:int,content:string,prefix:string,headers:array<string>,rows:array<array<string>>,source:string,score:double,path:string>>"


def without_garbage_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of ``docs`` without the tables that are none; other lines stay."""
    x = docs.select("doc_id", "markdown")
    none = F.coalesce(F.contains(F.col("markdown"), F.lit("|")), F.lit(False))
    some = ln.assemble(ln.drop_garbage_tables(ln.explode_lines(x.where(none))))
    # a text of such tables only has no line left
    return x.where(~none).unionByName(x.where(none).select("doc_id").join(some, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown")))


def convert_folder(spark: SparkSession, folder: str, config: Config = Config(), recursive: bool = False) -> DataFrame:
    """All supported files of a folder: a batch is only more rows."""
    return convert_files(sc.scan(spark, folder, recursive), config)


def clean_corpus(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, markdown): texts that were converted elsewhere, through the same cleaning."""
    d = ln.dedupe_tables(docs, "markdown", "\n\n")
    if config.extract_tables:
        d = without_garbage_tables(d)
    d = d.withColumn("markdown", clean_markdown(F.col("markdown"), config, not config.extract_tables))
    return ln.remove_artifacts(d, "markdown", config.min_repetition) if config.remove_artifacts else d
