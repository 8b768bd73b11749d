"""Cutting oversized texts into pieces under a limit, at natural boundaries, with overlap.

Lengths are code points.  A text of at most the limit is one piece.  Each
further piece begins exactly ``overlap`` code points before the end of the one
before it.  Null texts give no piece; an empty text is never oversized.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from paperloom.arrow import I, S, batch, rows

# White space and sentence ends, as code points.
_SPACE = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?。！？"], dtype=np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？"], dtype=np.uint32)
LEVELS = ("heading", "block", "line", "sentence", "word")
#: So many profiles are sent to all tasks at once; more are worked off in blocks.
MAX_PROFILES = 10_000
_HEADING = re.compile(r"^#{1,6} ", re.M)
_FENCE = re.compile(r"^```", re.M)


def boundaries(text: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sorted offsets after which the text may be cut, by level, and where its white space and stops are.

    A token is a word with the white space behind it; the prefix sums of the
    tokens' lengths are the offsets of ``word``.  ``sentence`` is the first of
    them behind a stop, ``line`` follows a line feed, ``block`` is the blank
    line between paragraphs, tables and code blocks, but not one inside a code
    block, and ``stop`` follows a stop with no white space behind it.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(code)
    space = np.isin(code, _SPACE) if code.max(initial=0) > 127 else (code == 32) | ((code >= 9) & (code <= 13)) | ((code >= 28) & (code <= 31))
    begins = ~space
    begins[1:] &= space[:-1]
    lengths = np.diff(np.flatnonzero(begins), prepend=0)
    offsets = np.cumsum(lengths)
    words = offsets[offsets > 0]
    stop = np.isin(code, _STOPS)
    wide = np.isin(code, _WIDE_STOPS)
    follows = np.empty(n, dtype=bool)
    follows[:-1], follows[-1:] = space[1:], True
    # a sentence ends with its stop, closing signs and the white space behind it
    ends = np.flatnonzero((stop & follows) | wide) + 1
    at = np.searchsorted(words, ends)
    after = np.where(at < len(words), words[np.minimum(at, len(words) - 1)] if len(words) else n, n)
    sentences = np.unique(np.where(space[np.minimum(ends, n - 1)] & (ends < n), after, ends)) if len(ends) else ends
    newline = code == 10
    lines = np.flatnonzero(newline) + 1
    blank = lines[(lines >= 2) & newline[np.maximum(lines - 2, 0)]]
    fences = np.array([m.start() for m in _FENCE.finditer(text)], dtype=np.int64) if "```" in text else lines[:0]
    blocks = blank[np.searchsorted(fences, blank) % 2 == 0]
    heads = np.array([m.start() for m in _HEADING.finditer(text)], dtype=np.int64) if "#" in text else lines[:0]
    heads = heads[(heads > 0) & (np.searchsorted(fences, heads) % 2 == 0)]
    return {"heading": heads, "block": blocks, "line": lines, "sentence": sentences, "word": words, "stop": np.flatnonzero(stop) + 1}, np.flatnonzero(space | stop)


def _last(at: dict[str, np.ndarray], levels: tuple[str, ...], floor: int, most: int) -> tuple[int, str]:
    """The last boundary in (floor, most] of the first level that has one, by binary search; (0, "") if none has."""
    for name in levels:
        marks = at[name]
        i = int(np.searchsorted(marks, most, "right")) - 1
        if i >= 0 and marks[i] > floor:
            return int(marks[i]), name
    return 0, ""


def cuts(n: int, at: dict[str, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the boundary it ends at) of each piece.

    A piece ends at the last boundary within the limit, of the strongest level
    that has one in the second half of the piece, then at the last sentence or
    word that moves the cut forward, then at such a stop; else the cut is hard.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    out, start = [], 0
    while n - start > limit:
        most, least = start + limit, start + overlap
        end, level = _last(at, LEVELS, start + max(overlap, limit // 2), most)
        if not end:
            end, level = _last(at, ("sentence", "word"), least, most)
        if not end:
            end, level = _last(at, ("stop",), least, most)
        if not end:
            end, level = most, "hard"
        out.append((start, end, level))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def forced(pieces: list[tuple[int, int, str]], breaks: np.ndarray, n: int, limit: int) -> bool:
    """Whether a hard cut lies in a stretch without white space and stops that is longer than the limit.

    Each such stretch has one: no piece can hold it, so one ends inside it.
    """
    for _, end, level in pieces:
        if level == "hard":
            i = int(np.searchsorted(breaks, end))
            left, right = (int(breaks[i - 1]) if i else -1), (int(breaks[i]) if i < len(breaks) else n)
            if right - left - 1 > limit:
                return True
    return False


def _blocks(profiles: DataFrame):
    """The distinct profiles in blocks of at most MAX_PROFILES; one empty block if there are none."""
    rows_ = (tuple(r) for r in profiles.select("profile", "max_chars", "overlap_chars").distinct().toLocalIterator())
    first = list(itertools.islice(rows_, MAX_PROFILES))
    yield first
    while block := list(itertools.islice(rows_, MAX_PROFILES)):
        yield block


def _each(docs: DataFrame, profiles: DataFrame, names: list[str], types: list, schema: str, rows_of, distinct: bool) -> DataFrame:
    """``rows_of(profile, text, limit, pieces, breaks)`` of each text that is over the limit of a profile."""

    def one(todo):
        def run(batches):
            for b in batches:
                out = []
                for doc, text in rows(b, "doc_id", "markdown"):
                    at, breaks = boundaries(text)
                    for name, limit, overlap in todo:
                        got = cuts(len(text), at, limit, overlap)
                        if len(got) > 1:
                            out += rows_of(name, doc, text, limit, got, breaks)
                yield batch(out, names, types)

        least = min((limit for _, limit, _ in todo), default=0)
        texts = docs.where(F.length("markdown") > least).select("doc_id", "markdown")
        return (texts.distinct() if distinct else texts).mapInArrow(run, schema)

    return functools.reduce(DataFrame.unionByName, [one(todo) for todo in _blocks(profiles)])


def split(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, doc_id, piece, first, last, cut, piece_text) of each oversized text.

    ``first`` and ``last`` are offsets of the piece in the text; ``cut`` names
    the boundary it ends at (hard: none was left; end: the text's own end).
    Exact copies of a row count once.
    """

    def rows_of(profile, doc, text, limit, got, breaks):
        return [(profile, doc, i, s, e, level, text[s:e]) for i, (s, e, level) in enumerate(got)]

    names = ["profile", "doc_id", "piece", "first", "last", "cut", "piece_text"]
    return _each(docs, profiles, names, [S, S, I, I, I, S, S], "profile string, doc_id string, piece int, first int, last int, cut string, piece_text string", rows_of, True)


def oversized(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, doc_id, kind): ``oversized`` texts, those of several pieces; ``forced`` in addition, if a hard cut could not be avoided.

    Exact copies of a row count once.
    """

    def rows_of(profile, doc, text, limit, got, breaks):
        return [(profile, doc, "oversized")] + ([(profile, doc, "forced")] if forced(got, breaks, len(text), limit) else [])

    return _each(docs, profiles, ["profile", "doc_id", "kind"], [S, S, S], "profile string, doc_id string, kind string", rows_of, False).distinct()
