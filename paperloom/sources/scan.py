"""Scanning folders, and the registry of decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions import rules
from paperloom.sources.office import DECODERS
from paperloom.sources.pdf import decode_pdf

#: The decoders this package has.
_OWN: dict[str, Callable[[bytes], Iterator[dict]]] = {**DECODERS, "pdf": decode_pdf}
#: Decoders that need a library of their own: file type to a function that imports it when it is called.
_plugins: dict[str, Callable[[bytes], Iterator[dict]]] = {}
# How a library that finds tables by strategies is to be asked, in this order: by ruling, then by text where ruling finds nothing.
TABLE_SETTINGS_STRICT = [
    {"vertical_strategy": "lines", "horizontal_strategy": "lines", "intersection_tolerance": 5, "snap_tolerance": 3},
    {"vertical_strategy": "lines_strict", "horizontal_strategy": "lines_strict", "intersection_tolerance": 3, "snap_tolerance": 3},
    None,
    {"vertical_strategy": "lines", "horizontal_strategy": "text", "min_words_horizontal": 2, "intersection_tolerance": 5},
]
TABLE_SETTINGS_TEXT = [
    {"vertical_strategy": "text", "horizontal_strategy": "text", "min_words_vertical": 3, "min_words_horizontal": 2, "text_x_tolerance": 3, "text_y_tolerance": 3},
    {"vertical_strategy": "text", "horizontal_strategy": "lines", "min_words_vertical": 3, "intersection_tolerance": 5},
]


def file_type(path: Column) -> Column:
    """The category of a path by its lower-cased suffix, else the suffix itself."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for kv in rules.EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, ext), ext)


def register(kind: str, decoder: Callable[[bytes], Iterator[dict]]) -> None:
    """A decoder for a file type: from bytes to dicts with one of the columns of schema.DECODED.

    It takes the place of the package's own decoder for that type.  Images
    have none of their own: OCR gives ``ocr`` (the text), ``word`` (each with
    its place) and ``image`` (the source itself, named source_image).
    """
    _plugins[kind] = decoder


def decoders() -> dict[str, Callable[[bytes], Iterator[dict]]]:
    return {**_OWN, **_plugins}


def scan(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(doc_id, path, rel_path, file_type, length, content) of the supported files in a folder.

    Names that begin with a dot or an underscore are skipped, as Spark does.
    Only files of supported types are opened: the content is read after the filter.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    base = folder.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    kinds = sorted(set(rules.EXTENSIONS.values()))
    return files.select(rel.alias("doc_id"), "path", rel.alias("rel_path"), file_type(F.col("path")).alias("file_type"), "length", "content").where(F.col("file_type").isin(kinds))
