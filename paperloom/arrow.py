"""Helpers for functions that run over Arrow batches."""

from __future__ import annotations

import pyarrow as pa

S, I, L, D, B = pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.bool_()
BYTES = pa.binary()


def batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def rows(b: pa.RecordBatch, *names: str):
    return zip(*(b.column(n).to_pylist() for n in names))
