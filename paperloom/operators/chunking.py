"""Overlapping chunks of long texts, with a preference for blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.arrow import I, S, batch, rows


def chunk(text: str, size: int = 15_000, overlap: int = 500) -> list[tuple[int, str]]:
    """(start, chunk): windows that end at their last blank line if it lies in their second half."""
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half of the size")
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            blank = text.rfind("\n\n", start, end)
            if blank - start > size // 2:
                end = blank + 2
        out.append((start, text[start:end]))
        start = end - overlap
    return out


def chunks(docs: DataFrame, text: str = "markdown", size: int = 15_000, overlap: int = 500) -> DataFrame:
    """(doc_id, chunk_no, start, chunk); null texts have none, an empty text has one empty chunk."""
    chunk("", size, overlap)

    def run(batches):
        for b in batches:
            yield batch([(d, k, s, c) for d, t in rows(b, "doc_id", "text") for k, (s, c) in enumerate(chunk(t, size, overlap))], ["doc_id", "chunk_no", "start", "chunk"], [S, I, I, S])

    return docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id string, chunk_no int, start int, chunk string")


def fixed_chunks(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """The same for texts without blank lines, in expressions only."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    return docs.select("doc_id", F.posexplode(starts).alias("chunk_no", "start"), F.col(text).alias("_t")).select("doc_id", "chunk_no", "start", F.expr(f"substring(_t, start + 1, {size})").alias("chunk"))
