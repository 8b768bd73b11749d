"""Held-out items inside training text.

Words are the longest runs of a-z and 0-9 in the lower-cased text.  A text
holds an item if it has ``n`` consecutive words of the item, or all words of an
item of fewer than ``n``.  Items without a word never occur.  Null and empty
texts hold nothing.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from paperloom.arrow import B, L, S, batch, rows
from paperloom.session import materialise

WORD = re.compile("[a-z0-9]+")
N = 13
#: The set of n-grams is sent to all executors only up to these sizes, measured before anything is collected; beyond them it is joined.
MAX_ITEMS, MAX_CHARS, MAX_GRAMS = 50_000, 30_000_000, 3_000_000
#: Bits of the filter that keeps windows without an item out of the join: a constant size of 16 MB, whatever the number of items.
FILTER_BITS = 1 << 27
#: A window that more than HOT places have is joined in so many parts.
HOT, PARTS = 100_000, 32
REMOVED = " "


class Grams:
    """The hash set of all n-grams of the items, with what is needed to look it up quickly."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, self.at, self.one = n, {}, {}
        self.pairs: set[str] = set()
        self.lengths: set[int] = set()
        for item, text in items:
            words = WORD.findall((text or "").lower())
            k = min(n, len(words))
            if k == 1:
                self.one.setdefault(words[0], set()).add(item)
            if k < 2:
                continue
            self.lengths.add(k)
            for i in range(len(words) - k + 1):
                gram = " ".join(words[i : i + k])
                # the hash finds, the gram beside it verifies
                self.at.setdefault(xxhash.xxh64_intdigest(gram), {}).setdefault(gram, set()).add(item)
            self.pairs.update(f"{a} {b}" for a, b in zip(words, words[1:]))
        # a window of k words holds a pair that begins at a multiple of k - 1
        self.step = min(self.lengths, default=2) - 1

    def find(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item to the windows (first word, words) that were found and verified."""
        hits: dict[int, list[tuple[int, int]]] = {}
        if self.one:
            for i, w in enumerate(words):
                for item in self.one.get(w, ()):
                    hits.setdefault(item, []).append((i, 1))
        done: set[tuple[int, int]] = set()
        for p in range(0, len(words) - 1, self.step):
            if f"{words[p]} {words[p + 1]}" not in self.pairs:
                continue
            for k in self.lengths:
                for s in range(max(0, p - k + 2), min(p, len(words) - k) + 1):
                    if (s, k) in done:
                        continue
                    done.add((s, k))
                    gram = " ".join(words[s : s + k])
                    for item in self.at.get(xxhash.xxh64_intdigest(gram), {}).get(gram, ()):
                        hits.setdefault(item, []).append((s, k))
        return hits


def spans(text: str) -> list[tuple[str, int, int]]:
    """The words with their places in ``text``, also where lower case is longer than the original."""
    low = text.lower()
    if len(low) == len(text):
        return [(m[0], *m.span()) for m in WORD.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    low = "".join(c.lower() for c in text)
    return [(m[0], origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(low)]


def _grams(items: DataFrame, n: int) -> Grams | None:
    """The n-grams of all items, or None if they are beyond the bounds."""
    i = items.select("item_id", "text").distinct()
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    size = i.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
    if size.items > MAX_ITEMS or size.chars > MAX_CHARS or size.words > MAX_GRAMS:
        return None
    return Grams([tuple(r) for r in i.collect()], n)


def leaks(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, doc_id): each document with each item found in it."""
    grams = _grams(items, n)
    if grams is None:
        return _joined(docs, items, n)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches):
        g = shared.value
        for b in batches:
            out = []
            for doc, text in rows(b, "doc_id", "text"):
                out += [(item, doc) for item in g.find(WORD.findall(text.lower()))]
            yield batch(out, ["item_id", "doc_id"], [L, L])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(scan, "item_id bigint, doc_id bigint").distinct()


def _windows(words: list[str], lengths: list[int]):
    """(k, 64-bit hashes of all windows of k words) for each of the lengths."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    at = h.copy()
    for k in range(1, min(max(lengths, default=0), len(words)) + 1):
        if k > 1:
            at = at[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :]
            at ^= at >> np.uint64(29)
        if k in lengths:
            yield k, at


def _places(docs: DataFrame, items: DataFrame, n: int, places: bool) -> DataFrame:
    """(item_id, doc_id, h_text, start, k): the windows of items in documents, for item sets of any size.

    The windows of the documents pass a filter of constant size before they are
    shuffled, by hash and then by their words, so that the match is exact.
    Without ``places`` a window counts once for each document, with start -1.
    ``h_text`` tells apart different texts of one doc_id.
    """

    def of_items(batches):
        for b in batches:
            out = []
            for i, text in rows(b, "item_id", "text"):
                words = WORD.findall(text.lower())
                k = min(n, len(words))
                for _, at in _windows(words, [k]):
                    out += [(k, int(h), " ".join(words[s : s + k]), i) for s, h in enumerate(at.view(np.int64))]
            yield batch(list(dict.fromkeys(out)), ["k", "h", "gram", "item_id"], [L, L, S, L])

    grams = materialise(items.where("text IS NOT NULL").select("item_id", "text").mapInArrow(of_items, "k bigint, h bigint, gram string, item_id bigint").distinct())
    lengths = [r[0] for r in grams.select("k").distinct().collect()]  # at most n numbers
    spot = F.pmod("h", F.lit(FILTER_BITS)) + 1  # Spark numbers bits from 1
    bits = grams.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # at most FILTER_BITS in all; each bucket has 32,768
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def of_docs(batches):
        have = shared.value
        for b in batches:
            out = []
            for doc, text in rows(b, "doc_id", "text"):
                words = WORD.findall(text.lower())
                h_text = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
                for k, at in _windows(words, lengths):
                    p = at % np.uint64(FILTER_BITS)
                    hit = np.flatnonzero((have[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
                    out += [(k, h, " ".join(words[s : s + k]), doc, h_text, s if places else -1) for s, h in zip(hit.tolist(), at[hit].view(np.int64).tolist())]
            yield batch(list(dict.fromkeys(out)), ["k", "h", "gram", "doc_id", "h_text", "start"], [L, L, S, L, L, L])

    found = materialise(docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(of_docs, "k bigint, h bigint, gram string, doc_id bigint, h_text bigint, start bigint"))
    # what very many places have is joined in parts, by document
    hot = materialise(found.groupBy("k", "h").agg(F.count("*").alias("places")).where(F.col("places") > HOT).select("k", "h", F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = found.join(hot, ["k", "h"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).drop("parts")
    right = grams.join(hot, ["k", "h"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["k", "h", "gram", "part"]).select("item_id", "doc_id", "h_text", "start", "k")


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``leaks`` by a join, for item sets too large to send to every executor."""
    return _places(docs, items, n, False).select("item_id", "doc_id").distinct()


def _cut(doc, text: str | None, hits: list[tuple[int, int]], drop_share: float) -> tuple:
    """A row of ``without_leaks``: the text without the windows (first word, words)."""
    words = spans(text) if text and hits else []
    gone = {i for s, k in hits for i in range(s, s + k)}
    if gone:
        parts, last = [], 0
        for i in sorted(gone):
            if i - 1 not in gone:
                parts.append(text[last : words[i][1]])
            last = words[i][2]
        text = REMOVED.join([*parts, text[last:]])
    return doc, text, len(gone), not gone or len(gone) < drop_share * len(words)


def without_leaks(docs: DataFrame, items: DataFrame, n: int = N, drop_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed, kept): all documents, leaked spans cut out.

    ``removed`` counts the words cut; a document that loses at least
    ``drop_share`` of its words has kept = false.  Null texts stay null.  Item
    sets beyond the broadcast bounds are joined, with the same result.
    """
    names, types = ["doc_id", "text", "removed", "kept"], [L, S, L, B]
    schema = "doc_id bigint, text string, removed bigint, kept boolean"
    grams = _grams(items, n)
    if grams is None:
        # the windows of one document are no more than its words, for each length
        at = _places(docs, items, n, True).select("doc_id", "h_text", "start", "k").distinct()
        at = at.groupBy("doc_id", "h_text").agg(F.collect_list(F.struct("start", "k")).alias("at")).withColumnRenamed("h_text", "h")

        def keyed(batches):
            for b in batches:
                yield batch([(d, t, None if t is None else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63) for d, t in rows(b, "doc_id", "text")], ["doc_id", "text", "h"], [L, S, L])

        both = docs.select("doc_id", "text").mapInArrow(keyed, "doc_id bigint, text string, h bigint").join(at, ["doc_id", "h"], "left")

        def cut(batches):
            for b in batches:
                yield batch([_cut(d, t, [(x["start"], x["k"]) for x in hits or ()], drop_share) for d, t, hits in rows(b, "doc_id", "text", "at")], names, types)

        return both.select("doc_id", "text", "at").mapInArrow(cut, schema)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches):
        g = shared.value
        for b in batches:
            out = []
            for doc, text in rows(b, "doc_id", "text"):
                hits = g.find([w for w, _, _ in spans(text)]).values() if text else ()
                out.append(_cut(doc, text, [x for hit in hits for x in hit], drop_share))
            yield batch(out, names, types)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def by_benchmark(found: DataFrame, items: DataFrame) -> DataFrame:
    """(benchmark, items, leaked_items, documents): how much of each benchmark leaked."""
    per = items.select("item_id", "benchmark").distinct()
    hit = found.join(per, "item_id")
    return (
        per.groupBy("benchmark").agg(F.count("*").alias("items"))
        .join(hit.groupBy("benchmark").agg(F.countDistinct("item_id").alias("leaked_items"), F.countDistinct("doc_id").alias("documents")), "benchmark", "left")
        .select("benchmark", "items", F.coalesce("leaked_items", F.lit(0)).alias("leaked_items"), F.coalesce("documents", F.lit(0)).alias("documents"))
    )
