"""Spans found in texts: a common form for the scans, and how they are digested for their queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import ship

#: kind, start, end in code points, end exclusive
Span = tuple[str, int, int]

SPAN_TYPE = "array<struct<kind: string, start: int, end: int>>"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def scan(docs: DataFrame, row: Callable[[str], tuple], fields: list[tuple[str, str]]) -> DataFrame:
    """``docs`` (doc_id, text) mapped row by row in Arrow batches: doc_id and the values that ``row`` returns for the text.

    No shuffle; a task holds one batch of texts. A null text counts as empty.
    """
    ship(docs.sparkSession)
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    names = ["doc_id", *(name for name, _ in fields)]
    kinds = [pa.int64(), *(arrow[kind] for _, kind in fields)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = [(doc_id, *row(texts[k].as_py() or "")) for k, doc_id in enumerate(ids)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    schema = ", ".join(["doc_id long", *(f"{name} {kind}" for name, kind in fields)])
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(rows, schema)
