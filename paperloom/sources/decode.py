"""Running decoders over the files of a scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom import schema

#: Rows of one batch of decoded things; images are large.
_BATCH = 500


def decode(files: DataFrame, known: dict[str, Callable[[bytes], Iterator[dict]]]) -> DataFrame:
    """``files`` (doc_id, file_type, content) to rows of schema.DECODED.

    A file that cannot be read gives one row with its error and no other, and
    the files after it go on.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema.DECODED))

    def run(batches):
        for b in batches:
            for doc, kind, content in zip(b["doc_id"].to_pylist(), b["file_type"].to_pylist(), b["content"]):
                try:
                    if kind not in known:
                        raise ValueError(f"no decoder for {kind}")
                    if content.as_py() is None:
                        raise ValueError("no content")
                    rows = [{"doc_id": doc, **row} for row in known[kind](content.as_py())]
                    made = [pa.RecordBatch.from_pylist(rows[k : k + _BATCH], arrow) for k in range(0, len(rows), _BATCH)]
                except Exception as e:  # noqa: BLE001 - one file must not end the batch
                    made = [pa.RecordBatch.from_pylist([{"doc_id": doc, "error": f"Error: {e}"}], arrow)]
                yield from made

    return files.select("doc_id", "file_type", "content").mapInArrow(run, schema.DECODED)
