"""The patterns, word lists and constants the operators work with."""

from __future__ import annotations

# File name extensions and the category of each.
EXTENSIONS = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".pptx": "pptx", ".ppt": "pptx", ".png": "image", ".jpg": "image",
    ".jpeg": "image", ".tiff": "image", ".tif": "image", ".bmp": "image", ".webp": "image", ".gif": "image",
}

# Whole lines that are a page number (any case).
PAGE_NUMBER = [
    r"^\s*\d+\s*$", r"^\s*[-–—]\s*\d+\s*[-–—]\s*$", r"^\s*page\s+\d+\s*$", r"^\s*p\.\s*\d+\s*$", r"^\s*\d+\s*/\d+\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$", r"^\s*\d+\s+of\s+\d+\s*$",
]

# Beginnings of structural Markdown lines.
STRUCTURAL = [r"^#+\s", r"^\|", r"^```", r"^\s*[-*+]\s", r"^\s*\d+\.\s", r"^>", r"^---", r"^\$\$"]

# Signs of a printed patent page.
PATENT_PRINT = ["patents.google.com", "Find Prior Art", "Family To Family Citations", "Cited by examiner", "Patent Citations", "Non-Patent Citations", "Download PDF"]

# Whole lines that are no content, in any case.
ARTIFACT_ANY_CASE = [
    r"^\s*draft\b.*$", r"^\s*confidential\b.*$", r"^\s*do\s+not\s+distribute\b.*$", r"^\s*internal\s+use\s+only\b.*$",
    r"^\s*proprietary\s+and\s+confidential\b.*$", r"^\s*sample\b.*$", r"^\s*watermark\b.*$",
    r"^\s*not\s+for\s+(distribution|publication|release)\b.*$", r"^\s*for\s+internal\s+use\b.*$", r"^\s*trade\s+secret\b.*$",
    r"^\s*Download\s+PDF\b.*$", r"^\s*Find\s+Prior\s+Art\b.*$", r"^\s*Similar\s*$", r"^\s*Show\s+more\s*$", r"^\s*Send\s+Feedback\s*$",
    r"^\s*About\s*$", r"^\s*Public\s+Datasets\b.*$", r"^\s*Terms\s*$", r"^\s*Privacy\s+Policy\s*$", r"^\s*Help\s*$",
    r"^\s*View\s+\d+\s+more\s+classifications?\s*$", r"^\s*\*?\s*Cited\s+by\s+examiner.*$", r"^\s*Family\s+To\s+Family\s+Citations\s*$",
    r"^\s*Data\s+provided\s+by\b.*$", r"^\s*Patent\s+Citations\s*$", r"^\s*Non[- ]Patent\s+Citations\s*$", r"^\s*Cited\s+By\s*$",
    r"^\s*Classifications\s*$", r"^\s*Legal\s+Events\s*$", r"^\s*Concepts\s*$", r"^\s*Worldwide\s+applications\s*$", r"^\s*Discuss\s*$",
    r"^\s*Add\s+to\s+list\s*$", r"^\s*Google\s+Patents\s*$", r"^\s*Advanced\s+search\s*$", r"^\s*My\s+account\s*$", r"^\s*Sign\s+in\s*$",
    r"^\s*Sheet\s+\d+\s+of\s+\d+\s*$", r"^\s*United\s+States\s+Patent\s*$", r"^\s*\(\d{2}\)\s*Patent\s+No\.\s*$",
    r"^\s*\d{1,2}/\d{1,2}/\d{2,4},?\s*.*patents\.google\.com.*$",
]
# The same, in this case only.
ARTIFACT_THIS_CASE = [
    r"^\s*\d+\s+of\s+\d+\s*$", r"^\s*US\d+[A-Z]\d?\s*$", r"^\s*https?://\S+\s*$",
    r"^\s*\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)?\s*$",
]
# Fixed value: a line of a table of contents.
LEADER_DOTS = r"^\s*.+\s*[\.•·]{3,}\s*\d+\s*$"
# Further lines of page furniture (any case).
CHROME = [
    r"^Rev\.\s*[A-Z]\s*\|\s*Page\s+\d+\s+of\s+\d+\s*$", r"^Page\s+\d+\s+of\s+\d+\s*$", r"^\d{5}-\d{3}\s*$",
    r"^Authorized\s+licensed\s+use\b.*$", r"^Downloaded\s+on\b.*$", r"^Restrictions\s+apply\.\s*$",
]

# Signs of mathematics.
MATH = [
    r"\\frac", r"\\sqrt", r"\\sum", r"\\int", r"\\prod", r"\\alpha", r"\\beta", r"\\gamma", r"\\delta", r"\\pi", r"\\infty",
    r"\\partial", r"\\nabla", r"\\begin\{equation", r"\\begin\{align", r"\\[a-zA-Z]+\{", r"\^\{[^}]+\}", r"_\{[^}]+\}",
]

# Ligature signs and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Word pieces left by a lost ligature or letter (pattern, whole).
LOST_LETTERS = [
    (r"\bnding\b", "finding"), (r"\bnancial\b", "financial"), (r"\bnance\b", "finance"), (r"\bnished\b", "finished"), (r"\bnish\b", "finish"),
    (r"\bnal\b", "final"), (r"\brst\b", "first"), (r"\beld\b", "field"), (r"\bnger\b", "finger"), (r"\btted\b", "fitted"), (r"\btting\b", "fitting"),
    (r"\bexible\b", "flexible"), (r"\boating\b", "floating"), (r"\bush\b", "flush"), (r"\buid\b", "fluid"), (r"\biciency\b", "efficiency"),
    (r"\bicient\b", "efficient"), (r"\bective\b", "effective"), (r"\bectively\b", "effectively"), (r"electried\b", "electrified"),
    (r"electrication\b", "electrification"), (r"\bve-year\b", "five-year"), (r"\bslent\b", "silent"), (r"\bslence\b", "silence"), (r"\bslently\b", "silently"),
]
# Misread words and their right forms.
MISREAD_WORDS = {
    "slent": "silent", "slence": "silence", "slently": "silently", "electried": "electrified", "electrication": "electrification",
    "nancial": "financial", "nance": "finance", "nding": "finding", "rst": "first", "eld": "field", "exible": "flexible", "iciency": "efficiency",
    "icient": "efficient", "ective": "effective", "flgure": "figure", "clalm": "claim", "clalms": "claims", "patcnt": "patent", "patcnts": "patents",
    "inventlon": "invention", "embodlment": "embodiment", "embodlments": "embodiments", "applicatlon": "application", "freqnency": "frequency",
    "frequcncy": "frequency", "amplifer": "amplifier", "ampliier": "amplifier", "transmltter": "transmitter", "receivcr": "receiver",
    "receivor": "receiver", "capacitcr": "capacitor", "capacltor": "capacitor", "circnit": "circuit", "voltagc": "voltage", "systcm": "system",
    "systern": "system", "devlce": "device", "devlces": "devices", "methcd": "method", "diagiam": "diagram", "dlagram": "diagram",
    "comprlsing": "comprising", "accordlng": "according", "inc1uding": "including", "signa1": "signal", "outpu1": "output", "outpnt": "output",
    "inpnt": "input", "fiilter": "filter", "fiilters": "filters", "cnrrent": "current", "crrrent": "current", "procese": "process", "procees": "process",
}

# Short cells that are no fragments.
KNOWN_SHORT = [
    "min", "max", "typ", "avg", "std", "var", "mhz", "ghz", "khz", "hz", "dbm", "db", "v", "mv", "ma", "ua", "na", "pa", "rf", "if", "dc", "ac", "bw",
    "tx", "rx", "id", "no", "yes", "n/a", "nil", "usd", "eur", "qty", "pct", "pdf", "doi", "ieee", "s21", "s11", "s22", "s12", "oip3", "iip3", "p1db",
    "nf", "vs", "to", "of", "or", "and", "the", "a", "b", "c", "d", "e", "x", "y", "z",
]
# Words usual in table headers.
COMMON_WORDS = [
    "parameter", "test", "conditions", "comments", "min", "typ", "max", "unit", "frequency", "gain", "output", "input", "power", "supply", "voltage",
    "current", "temperature", "range", "description", "function", "component", "value", "default", "model", "package", "option", "branding", "pin",
    "mnemonic", "magnitude", "angle", "rating", "absolute", "maximum", "operating", "storage", "dissipation", "noise", "figure", "compression",
    "intercept", "isolation", "return", "loss", "interface", "exposed", "paddle", "name", "number", "type", "speed", "bandwidth", "impedance", "s11",
    "s12", "s21", "s22", "oip3", "p1db", "vpos", "rfout", "rfin", "capacitance", "inductance", "resistance", "material", "dimension", "weight", "height",
    "width", "length", "depth", "thickness", "table", "note", "notes", "symbol", "typical", "characteristic", "performance", "specification",
    "electrical", "characteristics", "overview", "revision", "history", "ordering", "guide", "information", "general", "application", "circuit",
]
# Words that do not count when headers are compared.
HEADER_STOP_WORDS = ["of", "the", "a", "and", "or", "for", "in", "to"]
MONO_FONTS = ["mono", "courier", "consol"]
MONO_RUN_FONTS = ["consol", "courier", "mono", "code"]
CODE_STYLES = ["code", "source", "preformatted", "no spacing", "html preformatted"]

# Signs that a text is code and no drawing label, and lines in capitals.
LABEL_CODE = r"[{};]|::|->|=>|</?\w+>|\b(def|class|function|return|import|include|const|var|let|void)\b"
LABEL_CAPITALS = r"^[A-Z0-9][A-Z0-9 \-_/]+$"
# Signs of code and the points for each.
CODE_POINTS = [
    (r"[{};]", 2), (r"::|->|=>", 2),
    (r"\b(def|class|function|return|import|from|const|var|let|void|int|float|public|private|package)\b", 2),
    (r"[=<>]=|&&|\|\||<<|>>", 1), (r"(?m)^\s*#include\b|^\s*using\s+namespace\b", 2), (r"</?[A-Za-z][^>]*>", 1),
]
# Signs of code in a recognised line and the points for each.
OCR_CODE_POINTS = [
    (r"^\s*(def |class |import |from |if __name__)", 3), (r"^\s*(function |var |const |let |=>)", 2), (r"^\s*(#include |int main|void |public |private )", 3), (r"[{};]\s*$", 1),
]
