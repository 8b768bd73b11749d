"""Extracted images: small ones and repeated ones go, the rest are named."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paperloom.functions.text import image_filename, short_hash

MIN_BYTES = 500


def dedupe_images(images: DataFrame, min_bytes: int = MIN_BYTES, place: str = "idx") -> DataFrame:
    """Without images under ``min_bytes`` and without later copies in their document; adds ``md5_12``.

    ``place`` numbers the images of a document.  Only the hash goes through the
    window, the bytes come back by a join on the image's place, so that no
    payload is sorted.
    """
    big = images.where(F.length("data") >= min_bytes)
    nth = F.row_number().over(Window.partitionBy("doc_id", "md5_12").orderBy(place))
    first = big.select("doc_id", place, short_hash(F.col("data")).alias("md5_12")).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return big.join(first, ["doc_id", place])


def office_names(images: DataFrame) -> DataFrame:
    """File names of images from an archive: numbered by their place, metafiles as png."""
    ext = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    ext = F.when(ext == "", "png").when(ext.isin("emf", "wmf"), "png").otherwise(F.regexp_extract("source", r"\.([^./]+)$", 1))
    return images.withColumn("extension", ext).withColumn("filename", F.format_string("image_%03d.%s", F.col("idx"), F.col("extension")))


def page_names(images: DataFrame) -> DataFrame:
    """File names of images from pages: the page, and the number on it."""
    return images.withColumn("filename", image_filename(F.col("page"), F.col("idx"), F.col("extension")))


def named(images: DataFrame) -> DataFrame:
    """Names by what an image comes from: a page, an archive, or the file itself (source_image)."""
    own = F.col("source").startswith("source_image")
    paged = page_names(images.where(F.col("page").isNotNull() & ~own))
    itself = images.where(own).withColumn("filename", F.col("source"))
    return paged.unionByName(itself).unionByName(office_names(images.where(F.col("page").isNull() & ~own)))
