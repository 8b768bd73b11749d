"""Text functions: Column to Column, and plain Python where a replacement needs a callback.

Null gives null throughout; an empty text gives an empty text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from paperloom.functions import rules

#: Python's idea of white space, for engines whose \s is ASCII.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    """One alternation of whole patterns, for one rlike per line."""
    return ("(?iu)" if ignore_case else "") + "(?:" + "|".join(patterns) + ")"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def clean_whitespace(text: Column) -> Column:
    """No blanks before line ends, at most one blank line in a row, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def collapse_newlines(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_math(text: Column) -> Column:
    return text.rlike("|".join(rules.MATH))


def match_case(sample: Column, word: Column) -> Column:
    """``word`` in the case of ``sample``: capitals, capitalised, lower, else only the first letter follows."""
    cased = sample.rlike(r"\p{L}")
    first = F.upper(F.substring(word, 1, 1))
    head, rest = F.substring(sample, 1, 1), sample.substr(F.lit(2), F.greatest(F.length(sample) - 1, F.lit(0)))
    starts = head.rlike(r"^\p{Lu}")
    return (
        F.when(sample == "", word)
        .when(cased & (sample == F.upper(sample)) & sample.rlike(r"\p{Lu}"), F.upper(word))
        .when(starts & rest.rlike(r"\p{L}") & (rest == F.lower(rest)), F.concat(first, F.lower(word.substr(F.lit(2), F.length(word)))))
        .when(cased & (sample == F.lower(sample)), F.lower(word))
        .when(starts, F.concat(first, word.substr(F.lit(2), F.length(word))))
        .otherwise(word)
    )


def _in_case(sample: str, word: str) -> str:
    if sample.isupper():
        return word.upper()
    if sample[:1].isupper():
        return word.capitalize() if sample[1:].islower() else word[:1].upper() + word[1:]
    return word.lower() if sample.islower() else word


_LIGATURES = str.maketrans(rules.LIGATURES)
_LOST = [(re.compile(p, re.I), w) for p, w in rules.LOST_LETTERS]
_WORD = re.compile(r"\b[A-Za-z][A-Za-z0-9']{2,}\b")


def repair_words(text: str, lost_letters: bool = True, misread: bool = True) -> str:
    """Ligature signs, lost letters and misread words put right; each group of rules can be left out."""
    text = text.translate(_LIGATURES)
    if lost_letters:
        for pattern, word in _LOST:
            text = pattern.sub(lambda m, w=word: _in_case(m[0], w), text)
    if misread:
        text = _WORD.sub(lambda m: _in_case(m[0], rules.MISREAD_WORDS[m[0].lower()]) if m[0].lower() in rules.MISREAD_WORDS else m[0], text)
    return text


_SPACED = r"(?:\w[^\S\n]{1,2}){3,}\w"
_SPACED_RUN = re.compile(rf"{_SPACED}(?:[^\S\n]{{3,}}{_SPACED})*")


def join_spaced_letters(text: str) -> str:
    """Words written with a blank after each letter; three or more blanks part words."""

    def joined(run: re.Match) -> str:
        words = []
        for part in re.split(r"[^\S\n]{3,}", run[0]):
            letters = part.replace(" ", "")
            if not part.strip():
                continue
            words.append(part if len(letters) <= 2 else letters.capitalize() if letters.isupper() else letters)
        return " ".join(words)

    return _SPACED_RUN.sub(joined, text)


_BOLD_PAIR = re.compile(r"\*\*([^*]+?)\*\*(\s+)\*\*([^*]+?)\*\*")


def merge_bold(text: str) -> str:
    """Neighbouring bold spans become one, until none is left; bold punctuation becomes plain."""
    if "**" not in text:
        return text
    count = 1
    while count:
        text, count = _BOLD_PAIR.subn(r"**\1\2\3**", text)
    return re.sub(r"\*\*([,.;:]+)\*\*", r"\1", text)


_NOT_PROSE = re.compile(r"#|\||```|>|-|\*|\$\$|\d+[.)]\s|(?i:table\s+\d+|figure\s+\d+|rev\.\s*[A-Z]\s*\|)")


def is_prose(line: str) -> bool:
    s = line.strip()
    return len(s) >= 20 and not _NOT_PROSE.match(s)


def reflow(text: str) -> str:
    """Hard-wrapped prose lines joined; a paragraph ends at other lines, at 2,000 characters, or
    after 120 where a sentence ends and a capital follows.  A hyphen at a line's end stays."""
    out: list[str] = []
    open_ = False
    for line in text.split("\n"):
        prose = is_prose(line)
        if prose and open_:
            last = out[-1]
            if not (len(last) > 120 and last[-1] in ".!?" and line.lstrip()[:1].isupper()):
                out[-1] = last + ("" if last.endswith("-") else " ") + line.lstrip()
                open_ = len(out[-1]) <= 2000
                continue
        out.append(line.rstrip() if prose else line)
        open_ = prose
    return "\n".join(out)


def _series(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


_CHROME = re.compile("|".join(f"(?:{p})" for p in rules.CHROME), re.I)


def post_pass(text: str, tables_gone: bool = True, words: bool = True) -> str:
    """The pass on a document's Markdown: tables left out, bold, wraps, page furniture, words, white space."""
    if tables_gone and "|" in text:
        text = "\n".join(x for x in text.split("\n") if not x.strip().startswith("|"))
    text = reflow(merge_bold(text))
    text = "\n".join(x for x in text.split("\n") if not _CHROME.search(x.strip()))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    if words:
        text = join_spaced_letters(repair_words(text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def clean_text(text: Column, tables_gone: bool, words: bool) -> Column:
    """``post_pass`` in one Python stage."""
    return _series(lambda t: post_pass(t, tables_gone, words))(text)


def clean_words(text: Column) -> Column:
    """Words repaired and spaced letters joined, in one Python stage."""
    return _series(lambda t: join_spaced_letters(repair_words(t)))(text)


fix_words = _series(repair_words)
collapse_spaced = _series(join_spaced_letters)
defragment_bold = _series(merge_bold)
reflow_hard_wraps = _series(reflow)


def final_cleanup(text: Column) -> Column:
    """Delimiters unescaped, bare exponents and indices braced, white space cleaned."""
    t = F.replace(F.replace(F.replace(text, F.lit("\\\\("), F.lit("\\(")), F.lit("\\\\)"), F.lit("\\)")), F.lit("\\\\["), F.lit("\\["))
    t = F.replace(t, F.lit("\\\\]"), F.lit("\\]"))
    t = F.regexp_replace(t, r"(?U)(\w)\s*\^\s*(\d)", "$1^{$2}")
    t = F.regexp_replace(t, r"(?U)(\w)\s*_\s*(\d)", "$1_{$2}")
    return clean_whitespace(t)


def truncate(text: Column, most: int = 30_000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n... [TRUNCATED due to length] ..."))).otherwise(text)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\w)([#|])", r"\\$1")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_hash(data: Column) -> Column:
    return F.substring(F.md5(data), 1, 12)


def sanitize_filename(name: Column, most: int = 50) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s-]", "_"), r"(?U)[-\s]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, most)
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def image_filename(page: Column, index: Column, extension: Column) -> Column:
    return F.format_string("page%03d_img%03d.%s", page, index, extension)


def human_size(size: Column) -> Column:
    """One decimal and the largest unit that gives at least 1."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(f" {unit}"))
        out = F.when(size < 1024 ** (k + 1), text) if out is None else out.when(size < 1024 ** (k + 1), text)
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(size / float(1024**4), 1)), F.lit(" TB")))


def strip_model_fence(text: Column) -> Column:
    """A model's answer without a bare code fence around it; an opening fence with a language stays."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"^```\n?", ""), r"\n?```$", "")


def host_url(host: str | None) -> str:
    """A model server's address: scheme added, final slashes gone, wildcard and local names as loopback."""
    url = (host or "127.0.0.1:11434").strip()
    url = (url if url.startswith("http") else "http://" + url).rstrip("/")
    return url.replace("://0.0.0.0", "://127.0.0.1").replace("://localhost", "://127.0.0.1")
