"""Fields that hold several values: one row per value, with its position.

The delimiters of a source (a column header, or a table whose columns were run
together) are inferred, not given: every candidate is scored on how consistent
its piece counts are and on how regular its pieces are, and the ones that
explain the source's cells are used to split, outside quotes only.

Null cells, cells of blanks, and rows that are shorter or longer than the
headers are allowed; a cell with fewer than two non-empty values gives no row.
Exact duplicate tables count once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.arrow import batch
from paperloom.session import materialise

# The delimiters that are tried, and quotes.
DELIMITERS = [";", ",", "|", "/", "•", "·", "\t", "\n"]
#: Columns run together may also be set apart by two or more blanks.
WIDE_GAP = "  "
_QUOTED = '"(?:[^"]|"")*"|“[^”]*”'
_BLANKS = " \t\n\r\f\v\xa0\u2002\u2003\u2009\u202f\u3000\ufeff"

#: A delimiter is used for a source if its score is at least this share of the best one's.
MIN_SCORE = 0.5
#: What a piece counts that is found nowhere else, times the share of its type in the source.
BY_TYPE = 0.25
#: So many cells of all list sources together are added to each source, which decides where it has few itself.
POOLED = 5


def _pattern(used: tuple[str, ...]) -> re.Pattern:
    chars = re.escape("".join(d for d in used if d != WIDE_GAP))
    at = "|".join(([f"[{chars}]"] if chars else []) + (["\t+|[ ]{2,}"] if WIDE_GAP in used else []))
    if not at:
        return re.compile(r"(?s)(.+)")
    return re.compile(rf"(?s)([ ]*(?:{_QUOTED})[ ]*)(?:{at}|$)|((?:(?!{at}).)*)(?:{at})|(.+)$")


_patterns: dict[tuple[str, ...], re.Pattern] = {}


def pieces(cell: str, used: Sequence[str] = tuple(DELIMITERS)) -> list[str]:
    """The pieces of a cell in order: quotes removed, blanks trimmed, no piece after a final delimiter.

    ``used`` has the delimiters that count.  A quoted text is a value only if
    it fills its piece; other quote signs are ordinary characters.  An empty
    cell has no pieces.
    """
    key = tuple(used)
    if key not in _patterns:
        _patterns[key] = _pattern(key)
    text = cell.strip(" ") if WIDE_GAP in key else cell
    # each match is one piece and the delimiter behind it, or the rest of the cell
    return [_unquote((m[1] or m[2] or m[3] or "").strip(_BLANKS)) for m in _patterns[key].finditer(text)]


def _unquote(piece: str) -> str:
    if len(piece) >= 2:
        if piece[0] == piece[-1] == '"':
            return piece[1:-1].replace('""', '"').strip(_BLANKS)
        if piece[0] == "“" and piece[-1] == "”":
            return piece[1:-1].strip(_BLANKS)
    return piece


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def cells(tables: DataFrame) -> DataFrame:
    """One row per header entry (row_no -1) and cell, with the header of its column.

    A table delivered twice counts once.  Null arrays give no row.
    """
    t = tables.select("doc_id", "page", "table_no", "headers", "rows").distinct()
    heads = F.transform("headers", lambda h, i: F.struct(F.lit(-1).alias("row_no"), i.alias("col_no"), h.alias("cell"), h.alias("header")))
    body = F.flatten(
        F.transform(
            F.coalesce("rows", F.array().cast("array<array<string>>")),
            lambda r, i: F.transform(
                F.coalesce(r, F.array().cast("array<string>")),
                lambda c, j: F.struct(i.alias("row_no"), j.alias("col_no"), c.alias("cell"), F.get(F.col("headers"), j).alias("header")),
            ),
        )
    )
    return t.select("doc_id", "page", "table_no", F.inline(F.concat(F.coalesce(heads, F.array().cast("array<struct<row_no:int,col_no:int,cell:string,header:string>>")), body)))


def _key(header: Column) -> Column:
    return F.lower(trim_blanks(header))


def run_together(headers: DataFrame, kinds: DataFrame) -> DataFrame:
    """Header entries that are several known headers run together, and the delimiter between them.

    ``headers`` has distinct entries in ``header``.  Of the candidates the one
    counts under which all pieces (two at least) are known headers.
    """
    def parts(batches):
        for b in batches:
            rows = [(h, d, pieces(h, [d])) for h in b.column("header").to_pylist() for d in (*DELIMITERS, WIDE_GAP) if d in h]
            rows = [(h, d, len(p), x) for h, d, p in rows if len(p) >= 2 for x in p]
            yield batch(rows, ["header", "delimiter", "n", "part"], [pa.string(), pa.string(), pa.int32(), pa.string()])

    # parts are joined with the known headers by equality, so the table of kinds may be of any size
    parts = headers.where(F.col("header").rlike(r"[;,|/•·\t\n]|  ")).select("header").mapInArrow(parts, "header string, delimiter string, n int, part string")
    known = kinds.select(_key(F.col("header")).alias("key")).distinct()
    hit = parts.join(known, _key(F.col("part")) == F.col("key"), "left").groupBy("header", "delimiter", "n").agg(F.count("key").alias("known"))
    return hit.where((F.col("known") == F.col("n")) & (F.col("n") >= 2)).groupBy("header").agg(F.max_by("delimiter", F.struct("n", "delimiter")).alias("delimiter"), F.max("n").alias("width"))


def piece_type(piece: Column) -> Column:
    """The shape of a piece: digits as 9, words as a, signs as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, r"\p{Nd}+", "9"), r"\p{L}+", "a"), r"\s+", " ")


def infer_delimiters(listed: DataFrame) -> DataFrame:
    """Per source the candidates that occur in its cells, with their scores and whether they are used.

    ``listed`` has ``source_key`` and ``cell``.  A candidate is scored on

    * ``consistency``: the share of the cells it occurs in that it cuts into as many
      non-empty pieces as there are delimiters plus one, or one fewer (a trailing one), and
    * ``regularity``: how far the pieces of these cells are values of the source.  A piece
      counts 1 if the source also has it in a cell without this candidate, as the whole
      cell or cut out by others; else it counts by the share of its type in the source.

    ``score`` is their product, drawn towards the candidate's score over all
    sources where there are few cells.  A candidate is ``used`` if it scores at
    least MIN_SCORE of the source's best, so that a source with candidates
    always has one.  All counts are aggregated per (source, piece) before
    anything is shuffled again.
    """
    def tried(batches):
        for b in batches:
            rows = []
            for key, cell, n in zip(*(b.column(c).to_pylist() for c in ("source_key", "cell", "copies"))):
                cuts = [pieces(cell, [d]) if d in cell else () for d in DELIMITERS]
                mask = sum(1 << i for i, cut in enumerate(cuts) if len(cut) > 1)
                rows += [(key, mask, x, n, 0) for x in pieces(cell) if x]
                # a row without a piece stands for the cell
                rows += [(key, 1 << i, None, n, n * (sum(map(bool, cut)) >= len(cut) - 1)) for i, cut in enumerate(cuts) if len(cut) > 1]
            yield batch(rows, ["source_key", "mask", "piece", "copies", "good"], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()])

    d = listed.groupBy("source_key", "cell").agg(F.count("*").alias("copies"))
    cut = d.mapInArrow(tried, "source_key string, mask int, piece string, copies bigint, good bigint")
    # all about one piece meets here, already summed over the cells of each task
    by = materialise(cut.groupBy("source_key", "mask", "piece").agg(F.sum("copies").alias("copies"), F.sum("good").alias("good")))
    names = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    cells = by.where("piece IS NULL").select("source_key", F.col("mask").alias("bit"), F.col("copies").alias("cells"), (F.col("good") / F.col("copies")).alias("consistency"))
    value = by.where("piece IS NOT NULL").withColumn("type", piece_type(F.col("piece")))
    # the candidates that every cell with this piece has
    always = value.groupBy("source_key", "piece").agg(F.bit_and("mask").alias("always"))
    types = value.groupBy("source_key", "type").agg(F.sum("copies").alias("n"))
    types = types.join(value.groupBy("source_key").agg(F.sum("copies").alias("all")), "source_key").select("source_key", "type", (F.col("n") / F.col("all")).alias("share"))
    made = value.join(always, ["source_key", "piece"]).join(types, ["source_key", "type"]).select("*", F.inline(names)).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    worth = F.when(F.col("always").bitwiseAND(F.col("bit")) == 0, 1.0).otherwise(BY_TYPE * F.col("share"))
    regular = made.groupBy("source_key", "bit", "delimiter").agg((F.sum(worth * F.col("copies")) / F.sum("copies")).alias("regularity"))
    scored = cells.join(regular, ["source_key", "bit"]).withColumn("own", F.col("consistency") * F.col("regularity"))
    pooled = scored.groupBy("bit").agg((F.sum(F.col("own") * F.col("cells")) / F.sum("cells")).alias("pooled"))
    scored = scored.join(F.broadcast(pooled), "bit")  # one row for each candidate
    scored = scored.withColumn("score", (F.col("own") * F.col("cells") + POOLED * F.col("pooled")) / (F.col("cells") + POOLED))
    best = F.max("score").over(Window.partitionBy("source_key"))  # one row for each candidate of a source
    return scored.select("source_key", "delimiter", "cells", "consistency", "regularity", "score", (F.col("score") >= MIN_SCORE * best).alias("used"))


def split_packed(tables: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per non-empty value of each cell that holds two or more.

    ``kinds`` says of a header whether its column holds lists.  A column holds
    several values if its header does (blanks around it and case aside), or if
    the header entry itself is several known headers run together; then that
    entry and the cells below it are divided at the same delimiter.
    """
    # read by four branches below, so it is computed once
    every = materialise(cells(tables))
    listed_keys = kinds.where("holds = 'list'").select(_key(F.col("header")).alias("source_key")).distinct()
    packed = every.withColumn("source_key", _key(F.col("header")))
    # both small sides are left to the planner: it broadcasts them only under its size threshold
    listed = packed.where("row_no >= 0 AND cell IS NOT NULL").join(listed_keys, "source_key")
    kept = infer_delimiters(listed).where("used").groupBy("source_key").agg(F.sort_array(F.collect_set("delimiter")).alias("used"))
    runs = run_together(every.where("row_no = -1 AND header IS NOT NULL").select("header").distinct(), kinds)
    one = listed.join(kept, "source_key").select("doc_id", "page", "table_no", "row_no", "col_no", "cell", "used")
    two = every.where("cell IS NOT NULL").join(runs, "header").select("doc_id", "page", "table_no", "row_no", "col_no", "cell", F.array("delimiter").alias("used"))
    both = one.unionByName(two).distinct()
    def split(batches):
        keys = ["doc_id", "page", "table_no", "row_no", "col_no"]
        for b in batches:
            rows = []
            for *key, cell, used in zip(*(b.column(c).to_pylist() for c in (*keys, "cell", "used"))):
                cut = pieces(cell, used)
                if sum(map(bool, cut)) >= 2:
                    rows += [(*key, i, x) for i, x in enumerate(cut) if x]
            yield batch(rows, [*keys, "pos", "value"], [pa.string(), *[pa.int32()] * 5, pa.string()])

    return both.mapInArrow(split, "doc_id string, page int, table_no int, row_no int, col_no int, pos int, value string").distinct()
