"""One form for text that looks the same but differs in its characters.

Width of letters and blanks, invisible characters, and the script or encoding
a glyph is taken from make no difference; letters, accents, case, digits,
exponents and words do.  Look-alikes are mapped, the mapped values are grouped
under a collation that respects accents and case but knows which sequences are
equivalent, and each class takes one of its members for all.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.session import materialise

# Characters of other scripts that look like a Latin one, and the one they look like.
_ALIKE = {
    "Latin": ("ɡɑ", "ga"),
    "Cyrillic small": ("асеорухіјѕһԁԛԝѵёїү", "aceopyxijshdqwvëïy"),
    "Cyrillic capital": ("АВЕКМНОРСТХУІЈЅЁЇԚԜԌѴҮ", "ABEKMHOPCTXYIJSËÏQWGVY"),
    "Greek small": ("οϲϳνμ", "ocjvµ"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    "Armenian": ("օսՕՏԼ", "ouOSL"),
    "hyphens": ("‐‑﹣", "---"),
}
# Blanks of any width, and characters without any width.
_BLANKS = "".join(map(chr, [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNSEEN = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]))
# Signs that are several letters.
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII"}
_SINGLE = ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm")


#: The planes that have characters with decompositions: looking at no others makes the import quick.
_PLANES = (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20))


def _drawn_otherwise() -> dict[str, str]:
    """Characters that Unicode has a second time in another width or as mathematical letters, and the plain ones."""
    alike = dict(zip(*("".join(x) for x in zip(*_ALIKE.values()))))
    out = {}
    for i in _PLANES:
        kind, _, code = unicodedata.decomposition(chr(i)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>") and " " not in code and chr(i) not in _BLANKS + _UNSEEN:
            plain = chr(int(code, 16))
            out[chr(i)] = alike.get(plain, plain)
    return out


def _bases() -> dict[str, str]:
    """Letters with marks, and the letter that is left without them, of all scripts; of a Hangul syllable, its first."""
    out = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0xAC00, 0xD7A4)}
    for c in map(chr, _PLANES):
        kind = unicodedata.decomposition(c)
        if not kind or kind[0] == "<":
            continue
        letters = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if len(letters) == 1 and letters.isalnum():
            out[c] = letters
    return out


def _apart() -> dict[str, str]:
    """Letters with marks whose letter is a look-alike, taken apart, so that both ways to write them are mapped alike."""
    alike = dict(zip(*("".join(x) for x in zip(*_ALIKE.values()))))
    return {c: unicodedata.normalize("NFD", c).translate(str.maketrans(alike)) for c, base in _BASES.items() if base in alike and c not in alike}


_OTHERWISE, _BASES = _drawn_otherwise(), _bases()
_APART = _apart()
FROM = "".join(a for a, _ in _ALIKE.values()) + _SINGLE[0] + "".join(_OTHERWISE) + _BLANKS
TO = "".join(b for _, b in _ALIKE.values()) + _SINGLE[1] + "".join(_OTHERWISE.values()) + " " * len(_BLANKS)
COLLATION = "UNICODE"


#: The blocks that hold all signs of ``_APART`` and ``_JOINED``.
_SPELT = r"[\x{370}-\x{52F}\x{1F00}-\x{1FFF}\x{2160}-\x{216B}\x{FB00}-\x{FB06}]"


def mapped(text: Column) -> Column:
    """The text with look-alikes replaced, blanks made plain, and invisible characters left out."""
    several = F.create_map(*[F.lit(x) for pair in {**_APART, **_JOINED}.items() for x in pair])
    # few texts have signs that stand for several characters; there each character is looked up
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    one = F.when(text.rlike(_SPELT), spelt).otherwise(text)
    out = F.when(text.rlike(r"[^\x20-\x7E]"), F.translate(one, FROM + _UNSEEN, TO)).otherwise(text)
    return F.trim(F.regexp_replace(out, " {2,}", " "))


PY_MAP = str.maketrans({**{a: b for a, b in zip(FROM, TO)}, **_APART, **_JOINED, **{c: None for c in _UNSEEN}})


def _coarse(form: Column) -> Column:
    """A number that equal-looking forms share: of their letters without marks, digits and plain signs, in order.

    Sequences that are canonically equivalent have the same letters without
    marks, so the key never parts what the collation calls equal.  Left out are
    the letters of a Hangul syllable after its first, and the signs that marks
    go with or that have a second code.
    """
    plain = F.when(form.rlike(r"[^\x00-\x7F]"), F.translate(form, "".join(_BASES), "".join(_BASES.values()))).otherwise(form)
    return F.xxhash64(F.regexp_replace(plain, r"[^\p{Lu}\p{Ll}\p{Lo}\p{Nd}!-:?@\[-_{-~]+|[\x{1160}-\x{11FF}]+", ""))


def classes(values: DataFrame, preferred: DataFrame | None = None, all_values: bool = True) -> DataFrame:
    """(value, canonical) for each distinct non-null ``value``; without ``all_values`` only for
    values that share their coarse key with another value, which leaves out those that stand alone.

    The canonical member of a class is its smallest value in ``preferred``, if
    there is one, else the value most rows have; ties go to the smallest in
    code points, so the choice does not depend on the order of rows.
    """
    v = values.where("value IS NOT NULL").select("value", F.lit(1).alias("one"), F.lit(None).cast("string").alias("wanted"))
    if preferred is not None:
        v = v.unionByName(preferred.where("value IS NOT NULL").select("value", F.lit(0).alias("one"), F.col("value").alias("wanted")))
    return _classes(_formed(v), all_values)


def _formed(rows: DataFrame) -> DataFrame:
    """``rows`` with the form of their ``value`` and its key ``k``."""
    return rows.withColumn("form", mapped(F.col("value"))).withColumn("k", _coarse(F.col("form")))


def _classes(v: DataFrame, all_values: bool) -> DataFrame:
    """``classes`` of ``v`` (value, one, wanted, form, k): ``one`` counts a row, ``wanted`` is the value if it is preferred."""
    # a value alone under its key is a class of its own: only numbers are shuffled to find that out
    h = F.xxhash64("value")
    several = v.groupBy("k").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("k")
    shared = materialise(v.join(several, "k", "left_semi").groupBy("k", "form", "value").agg(F.sum("one").alias("copies"), F.min("wanted").alias("wanted")))
    shared.createOrReplaceTempView("paperloom_lookalike_values")
    spark = v.sparkSession
    # each form takes the smallest of the forms the collation calls equal; they are compared, since grouping or joining
    # by the collated column parted some equal texts of large inputs here; a key has few forms, which differ in marks
    spark.sql(f"""
        WITH forms AS (SELECT DISTINCT k, form FROM paperloom_lookalike_values)
        SELECT a.k, a.form, min(b.form) AS class FROM forms a JOIN forms b
        ON a.k = b.k AND a.form COLLATE {COLLATION} <= b.form COLLATE {COLLATION} AND a.form COLLATE {COLLATION} >= b.form COLLATE {COLLATION} GROUP BY a.k, a.form
    """).createOrReplaceTempView("paperloom_lookalike_classes")
    out = spark.sql("""
        WITH v AS (SELECT v.*, c.class FROM paperloom_lookalike_values v JOIN paperloom_lookalike_classes c ON v.k = c.k AND v.form = c.form),
        best AS (SELECT k, class, coalesce(min(wanted), min_by(value, struct(-copies, value))) AS canonical FROM v GROUP BY k, class)
        SELECT v.value, best.canonical FROM v JOIN best ON v.k = best.k AND v.class = best.class""")
    if not all_values:
        return out
    return out.unionByName(v.join(several, "k", "left_anti").select("value", F.col("value").alias("canonical")).distinct())


def same_as(sections: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, doc_id, seq): sections whose content looks like a reference text but is another sequence.

    Sections that share no coarse key with any reference are left out before
    values are grouped; the coarse key of equal-looking texts is the same, so
    none is lost.  References that look alike are each linked with the sections
    of their class.  Null contents are no case; repeated rows count once.
    """
    refs = materialise(_formed(refs.where("content IS NOT NULL").select("ref_id", F.col("content").alias("value"))))
    rows = _formed(sections.where("content IS NOT NULL").select("doc_id", "seq", F.col("content").alias("value")))
    # few rows are left here; read once, used for the classes and for the result
    rows = materialise(rows.join(refs.select("k").distinct(), "k", "left_semi"))
    v = rows.select("value", F.lit(1).alias("one"), F.lit(None).cast("string").alias("wanted"), "form", "k")
    v = v.unionByName(refs.select("value", F.lit(0).alias("one"), F.col("value").alias("wanted"), "form", "k"))
    found = materialise(_classes(v, all_values=False))
    hit = found.join(refs.join(found, "value").select("ref_id", F.col("value").alias("wanted"), "canonical"), "canonical").where("value <> wanted")
    return rows.join(hit.select("value", "ref_id"), "value").select("ref_id", "doc_id", "seq").distinct()
