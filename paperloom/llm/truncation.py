"""Texts that were cut off before their end: found by self-joins on prefixes.

A value that is a strict prefix of longer copies elsewhere was cut.  The join
runs on values of four sizes, and what it finds is labelled:

* ``copy``: the whole text, less white space and a mark of a cut at its end.
  Texts are hashed by prefixes of fixed lengths; only those that share one with
  another text are sorted, so that a strict prefix stands directly before a
  value that begins with it.
* ``line``: the last line against all complete lines without a stop, sorted.
* ``lead``: the last sentence against all finished ones, hashed by a prefix of
  fixed length, its first two words.
* ``word``: the last word, which nowhere is a complete word.

Which ends are looked up is decided by the end itself: a finished sentence,
row, code block or rule is no cut.  An end that cannot be whole (an open code
block, a row without its last bar, a sentence that stops at a comma or has no
stop behind finished ones) is a cut also where no longer copy exists; it is
labelled ``rule`` if the join finds nothing.  All other ends, such as list
entries, headings and closing lines, are cut only if the join says so.

Null and blank texts are no case.  White space at the end does not count.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from paperloom.arrow import I, L, S, batch, rows
from paperloom.session import materialise

# What is put where a text was cut.
MARKS = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…|[a-z ]*(?:not shown|truncated|omitted|cut off|continued|continues|missing)[a-z ]*)\]|\.{3,}|…|�+|(?<=[\w ])[-‐¬]))+$", re.I)
_LAST_OF_MARK = tuple("].…�-‐¬")
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)$")
_STOP = re.compile(r"[.!?。！？][\"'”»’)\]*_`]*$")
_NUMBER_STOP = re.compile(r"(?:^|\s)(?:\d{1,3}(?:,\d{3})*|\d+)\.$")
_ENTRY = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_MARKUP = re.compile(r"^\s*(?:>\s*)*(?:#{1,6}\s+)?(?:(?:[-*+•]|\d{1,3}[.)])\s+)?")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_CODE_ID = re.compile(r"^[A-Z]{1,4}$")
_STRIP = ".,;:!?()[]{}\"'“”„«»`*_>|#"
#: A lead of two words belongs to sentences if more than this many times as many sentences begin with it as plain lines do.
LEAD_TIMES = 2
#: From the strongest to the weakest.
EVIDENCE = ("copy", "line", "lead", "word", "rule")


def _mark(text: str) -> re.Match | None:
    """The marks of a cut at the end of a text without white space there; the last character tells most texts apart."""
    if text[-1:] not in _LAST_OF_MARK or (text[-1:] == "." and not text.endswith("...")):
        return None
    return MARKS.search(text)


def tail(text: str) -> tuple[str, str]:
    """(state, unit): state is done, cut, or open; the unit to look up is the last line without its markup, "" if there is none."""
    t = text.rstrip().rstrip("﻿​").rstrip()
    if not t:
        return "done", ""
    marked = _mark(t)
    bare = t[: marked.start()].rstrip() if marked else t
    if bare.count("```") % 2:
        return "cut", ""
    last = bare[bare.rfind("\n") + 1 :].strip()
    if not last or (not marked and _RULE.match(last)) or last.startswith("```"):
        return "done", ""
    if last.startswith("|"):
        block = []
        for line in reversed(bare.split("\n")):
            if not line.strip().startswith("|"):
                break
            block.append(line.strip())
        whole = last.endswith("|") and len(last) > 1 and last.count("|") >= block[-1].count("|")
        return ("done" if whole else "cut"), ""
    if _STOP.search(last):
        return ("cut" if _NUMBER_STOP.search(last) and not _ENTRY.match(last + " x") else "done"), last
    unit = _MARKUP.sub("", last, count=1).strip()
    if not unit:
        return ("cut" if marked else "done"), ""
    if last[-1] in ",;，；、:：" or _inner_stop(unit):
        return "cut", unit
    if _CJK.search(unit[-1]) and not _ENTRY.match(last) and not last.startswith("#"):
        return "cut", unit
    if unit.endswith(")") and "(" in unit:
        return "done", ""
    # white space in front of a mark shows that more was to come
    return "open", unit


_INNER = re.compile(r"[.!?][\"”)]*\s+(?=\S)|[。！？]")


def _sentence_ends(unit: str):
    """The places behind stops inside the unit; a stop ends a sentence of three words or more, or is a wide one."""
    for m in _INNER.finditer(unit):
        if m[0] in "。！？" or len(unit[: m.start()].split()) >= 3:
            yield m.end()


def _last_sentence(unit: str) -> str:
    """What follows the last stop inside the unit."""
    return unit[max(_sentence_ends(unit), default=0) :]


def _inner_stop(unit: str) -> bool:
    """Whether the unit holds a finished sentence."""
    return next(_sentence_ends(unit), None) is not None


_DIGIT = re.compile(r"\d")


def _lead(unit: str) -> str:
    """The first two words; words with digits are all alike."""
    return " ".join("0" if _DIGIT.search(w) else w for w in unit.split()[:2])


def _last(unit: str) -> str:
    """The last word; with a short code in capitals before it that belongs to it."""
    words = [w.strip(_STRIP) for w in unit.split()]
    if len(words) > 1 and _CODE_ID.match(words[-2]) and words[-1][:1].isdigit():
        return f"{words[-2]} {words[-1]}"
    return words[-1] if words else ""


_CODES = re.compile(r"\b([A-Z]{1,4} \d[\w/.-]*\w|[A-Z]{1,4} \d)(?=\W)")


def _unmarked(text: str) -> str:
    """The text without white space and a mark of a cut at its end."""
    t = text.rstrip()
    m = _mark(t)
    return t[: m.start()].rstrip() if m else t


def prefix_hashes(text: str) -> list[int]:
    """Hashes of the prefixes of 1, 2, 4, … characters that ``text`` has, and of the whole of it."""
    h, out, at = xxhash.xxh3_64(), [], 0
    while (size := 1 << len(out)) <= len(text):
        h.update(text[at:size].encode("utf-8", "surrogatepass"))
        out.append(h.intdigest() - 2**63)
        at = size
    h.update(text[at:].encode("utf-8", "surrogatepass"))
    return [*out, h.intdigest() - 2**63]


def _observe(docs: DataFrame) -> DataFrame:
    """One pass over all texts: the state of each end, and counts of what is complete elsewhere.

    Rows (kind, key, n, doc_id, source, unit, hashes): d, the ends that are cut
    or open; b, the prefix hashes of each text; w, words followed by something;
    p, plain lines followed by others; s, first two words of sentences.  Counts
    are summed per task.
    """
    names, types = ["kind", "key", "n", "doc_id", "source", "unit", "hashes"], [S, S, L, L, S, S, pa.list_(L)]

    def run(batches):
        words, plain, leads = Counter(), Counter(), Counter()

        def flush():
            complete = Counter()
            for raw, n in words.items():
                w = raw.strip(_STRIP)
                if w and raw[-1] not in "-‐¬":
                    complete[w] += n
            words.clear()
            out = [("w", k, n, None, None, None, None) for k, n in complete.items()]
            out += [("p", k, n, None, None, None, None) for k, n in plain.items()]
            out += [("s", k, n, None, None, None, None) for k, n in leads.items()]
            plain.clear()
            leads.clear()
            return batch(out, names, types)

        for b in batches:
            out = []
            for doc, source, text in rows(b, "doc_id", "source", "text"):
                state, unit = tail(text)
                if state != "done":
                    out.append(("d", state, 1, doc, source, unit, None))
                t = _unmarked(text)
                if t:
                    out.append(("b", None, 1, doc, source, None, prefix_hashes(t)))
                # the end itself is no evidence
                head, body = t.rpartition("\n")[0], t.rpartition(" ")[0]
                words.update(body.split())
                words.update(_CODES.findall(body))
                for line in head.split("\n"):
                    if not line or line[0] in "|`" or line.startswith("    "):
                        continue
                    if _STOP.search(line[-6:]):
                        leads.update([_lead(_MARKUP.sub("", line, count=1))])
                    else:
                        unit = _MARKUP.sub("", line, count=1).strip()
                        if unit and not _inner_stop(unit):
                            plain[unit] += 1
            yield batch(out, names, types)
            if len(words) + len(plain) > 300_000:
                yield flush()
        yield flush()

    made = docs.where("text IS NOT NULL").select("doc_id", "source", "text")
    return made.mapInArrow(run, "kind string, key string, n bigint, doc_id bigint, source string, unit string, hashes array<bigint>")


def next_in_order(values: DataFrame) -> DataFrame:
    """(value, next): each distinct ``value`` with the one that follows it in byte order.

    Values are sorted by ranges, so that a group of values that begin alike is
    spread over tasks; only the first value of each task is looked at again.
    """

    def run(batches):
        at, before, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            out = []
            for value in b.column("value").to_pylist():
                if before is not None:
                    out.append((at, int(first), before, value))
                    first = False
                before = value
            yield batch(out, ["task", "first", "value", "next"], [I, I, S, S])
        if before is not None:
            yield batch([(at, int(first) + 2, before, None)], ["task", "first", "value", "next"], [I, I, S, S])

    ordered = values.select("value").where("value IS NOT NULL").distinct().repartitionByRange("value").sortWithinPartitions("value")
    done = materialise(ordered.mapInArrow(run, "task int, first int, value string, next string"))
    # one row per task from here on
    edge = done.where("first IN (1, 3)").select("task", F.col("value").alias("begins"))
    follow = edge.withColumn("follows", F.lead("begins").over(Window.orderBy("task"))).select("task", "follows")
    return done.join(F.broadcast(follow), "task").select("value", F.when(F.col("first") >= 2, F.col("follows")).otherwise(F.col("next")).alias("next"))


def strict_prefixes(values: DataFrame) -> DataFrame:
    """(value, longer): values that are strict prefixes of a longer one, with the next such value."""
    return next_in_order(values).where(F.col("next").startswith(F.col("value"))).withColumnRenamed("next", "longer")


def prefix_copies(docs: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, rest, last): documents whose text, less a mark of a cut, is a strict prefix of a longer
    copy, how that goes on, and how the text ends.

    ``hashes`` (doc_id, hashes) has the ``prefix_hashes`` of each text, if they
    are known.  A text can only be a prefix of those that share the longest of
    its hashed prefixes, which is at least half of it.  Equal texts do not
    count as two.
    """
    if hashes is None:
        hashes = materialise(_observe(docs)).where("kind = 'b'").select("doc_id", "hashes")
    at = hashes.select("doc_id", F.element_at("hashes", -1).alias("whole"), F.posexplode("hashes").alias("level", "h"), (F.size("hashes") - 2).alias("own")).where("level <= own")
    several = at.groupBy("level", "h").agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.max(F.col("level") == F.col("own")).alias("ends")).where("low <> high AND ends")
    # written, so that its size is known: few of them are sent to all tasks, and the texts stay where they are
    some = materialise(at.join(several.select("level", "h"), ["level", "h"], "left_semi").select("doc_id").distinct())

    def bared(batches):
        for b in batches:
            yield batch([(doc, source, _unmarked(text)) for doc, source, text in rows(b, "doc_id", "source", "text")], ["doc_id", "source", "value"], [L, S, S])

    texts = docs.where("text IS NOT NULL").select("doc_id", "source", "text").join(some, "doc_id", "left_semi")
    texts = materialise(texts.mapInArrow(bared, "doc_id bigint, source string, value string").where("value <> ''"))
    found = strict_prefixes(texts.select("value"))
    return texts.join(found, "value").select("doc_id", "source", F.expr("substring(longer, length(value) + 1, 80)").alias("rest"), F.substring("value", -1, 1).alias("last"))


def evidence(docs: DataFrame) -> DataFrame:
    """(source, doc_id, evidence) of the documents that break off; one row for each document and source.

    ``evidence`` names the strongest that was found: copy, line, lead, word, or
    rule where nothing but the end itself shows the cut.
    """
    seen = materialise(_observe(docs))
    ends = seen.where("kind = 'd'").select("doc_id", "source", F.col("key").alias("state"), "unit")
    # a document by itself gives no evidence: units and their parts are looked up in counts of all texts
    units = ends.where("unit <> ''").select("unit").distinct()

    def lasts(batches):
        for b in batches:
            yield batch([(u, _lead(_last_sentence(u) or u), _last(u)) for (u,) in rows(b, "unit")], ["unit", "lead", "word"], [S, S, S])

    units = materialise(units.mapInArrow(lasts, "unit string, lead string, word string"))
    counts = materialise(seen.where("kind IN ('w', 'p', 's')").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where("kind = 'w'").select(F.col("key").alias("word"), F.col("n").alias("n_word"))
    leads = counts.where("kind = 's'").select(F.col("key").alias("lead"), F.col("n").alias("n_lead"))
    lines = counts.where("kind = 'p'").select(F.col("key").alias("unit"), F.col("n").alias("n_line"))
    plain = lines.withColumn("lead", F.regexp_replace(F.array_join(F.slice(F.split("unit", r"\s+"), 1, 2), " "), r"\S*\d\S*", "0")).groupBy("lead").agg(F.sum("n_line").alias("n_plain"))
    longer = strict_prefixes(units.select(F.col("unit").alias("value")).unionByName(lines.select(F.col("unit").alias("value"))))
    # a word that ends several units and begins no longer word is whole, even if it never stands elsewhere
    ends_many = ends.where("state = 'open'").select("unit").distinct().join(units, "unit").groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").join(words.select("word"), "word", "left_anti").select("word")
    begins = strict_prefixes(words.select(F.col("word").alias("value")).unionByName(ends_many.select(F.col("word").alias("value")))).select(F.col("value").alias("word"))
    words = words.unionByName(ends_many.join(begins, "word", "left_anti").select("word", F.lit(2).cast("long").alias("n_word")))
    judged = (
        units.join(words, "word", "left").join(leads, "lead", "left").join(plain, "lead", "left").join(lines, "unit", "left")
        .join(longer.select(F.col("value").alias("unit"), "longer"), "unit", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lead = (zero("n_lead") > LEAD_TIMES * zero("n_plain")) & (zero("n_line") == 0)
    line = F.col("longer").isNotNull() & (zero("n_line") == 0)
    found = judged.select("unit", F.when(line, 2).when(lead, 3).when(F.col("n_word").isNull(), 4).alias("rank")).where("rank IS NOT NULL")
    shown = ends.join(found, "unit", "left").select("source", "doc_id", F.when(F.col("rank").isNull() & (F.col("state") == "cut"), 5).otherwise(F.col("rank")).alias("rank")).where("rank IS NOT NULL")
    # a longer copy shows a cut where the end alone does not: whatever follows on the line, unless the end is a whole one
    copies = prefix_copies(docs, seen.where("kind = 'b'").select("doc_id", "hashes"))
    copies = copies.where(F.col("rest").rlike(r"^[^\S\n]*[^\s.!?。！？]") & F.col("last").rlike(r"[^.!?。！？|)`\"]"))
    every = shown.unionByName(copies.select("source", "doc_id", F.lit(1).alias("rank")))
    names = F.array(*map(F.lit, EVIDENCE))
    return every.groupBy("source", "doc_id").agg(F.min("rank").alias("rank")).select("source", "doc_id", F.element_at(names, F.col("rank")).alias("evidence"))


def truncated(docs: DataFrame) -> DataFrame:
    """(source, doc_id) of the documents that break off inside a word, sentence, row or code block."""
    return evidence(docs).select("source", "doc_id")


def rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate) of each source, the null source too."""
    n = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"))
    m = found.groupBy("source").agg(F.countDistinct("doc_id").alias("truncated"))
    both = n.join(m.withColumnRenamed("source", "s"), n.source.eqNullSafe(F.col("s")), "left")
    cut = F.coalesce("truncated", F.lit(0))
    return both.select("source", "documents", cut.alias("truncated"), F.round(cut / F.col("documents"), 6).alias("rate"))
