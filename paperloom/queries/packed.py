"""Queries on packed fields (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.operators import packed_cells as pc
from paperloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pc.split_packed(table(spark, d, "extracted_tables"), table(spark, d, "column_kinds"))


def p4_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The inferred delimiters of each list column, with the scores they were chosen by."""
    kinds = table(spark, d, "column_kinds").where("holds = 'list'").select(F.lower(pc.trim_blanks(F.col("header"))).alias("source_key")).distinct()
    every = pc.cells(table(spark, d, "extracted_tables")).withColumn("source_key", F.lower(pc.trim_blanks(F.col("header"))))
    listed = every.where("row_no >= 0 AND cell IS NOT NULL").join(kinds, "source_key")
    score = lambda c: F.round(c, 6).alias(c)
    return pc.infer_delimiters(listed).select("source_key", "delimiter", "cells", score("consistency"), score("regularity"), score("score"), "used")


QUERIES = {"p4_found": p4_found, "p4_delimiters": p4_delimiters}
SQL: dict[str, str] = {}
