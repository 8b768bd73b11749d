"""Schemas of the relations the engine passes around."""

BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPANS = "doc_id string, page int, block_no int, line_no int, span_no int, text string, size double, flags int, font string"
RUNS = "doc_id string, part_no int, para_no int, run_no int, style string, level int, is_title boolean, text string, bold boolean, italic boolean, font string"
RAW_TABLES = f"doc_id string, page int, table_no int, source string, bbox {BBOX}, matrix array<array<string>>"
OCR_WORDS = "doc_id string, word_no int, text string, x int, y int, w int, h int, conf int"
IMAGES = "doc_id string, idx int, filename string, data binary, extension string, page int, width int, height int, source string"
SECTIONS = "doc_id string, seq int, type string, level int, content string, prefix string, headers array<string>, rows array<array<string>>, path string, filename string, source string, score double"
METADATA = "doc_id string, title string, author string, subject string, created string, modified string, page_count int, slide_count int"
#: What a decoder gives: one row per thing it found, in one of the columns of structs.
DECODED = (
    f"doc_id string, error string, run struct<part_no: int, para_no: int, run_no: int, style: string, level: int, is_title: boolean, text: string, bold: boolean, italic: boolean, font: string>, "
    f"span struct<page: int, block_no: int, line_no: int, span_no: int, text: string, size: double, flags: int, font: string>, "
    f"raw struct<page: int, table_no: int, matrix: array<array<string>>, source: string, bbox: {BBOX}>, "
    f"image struct<idx: int, source: string, data: binary, extension: string, page: int, width: int, height: int>, "
    f"ocr struct<text: string>, word struct<word_no: int, text: string, x: int, y: int, w: int, h: int, conf: int>, "
    f"meta struct<title: string, author: string, subject: string, created: string, modified: string, page_count: int, slide_count: int>"
)
