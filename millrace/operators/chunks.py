"""Cutting texts at a paragraph, line or space before a limit of characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, piece_no int, start long, piece string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("piece", pa.string())])


def cuts(text: str, limit: int) -> Iterator[tuple[int, str]]:
    """(start, piece): while more than limit is left, up to the last blank line, else line, else space in the window's second half."""
    at = 0
    while len(text) - at > limit:
        half = at + limit // 2
        for mark in ("\n\n", "\n", " "):
            k = text.rfind(mark, at, at + limit)
            if k > half:
                end = k + len(mark)
                break
        else:
            end = at + limit
        yield at, text[at:end]
        at = end
    if at < len(text) or not text:
        yield at, text[at:]


def chunk(documents: DataFrame, limit: int = 16_384) -> DataFrame:
    """doc_id, piece_no, start, piece. Texts within the limit stay in the JVM; only longer ones are cut in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (s, p) in enumerate(cuts(t, limit))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    d = documents.where("text is not null").select("doc_id", "text")
    short = d.where(F.length("text") <= limit).select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.col("text").alias("piece"))
    return short.unionByName(d.where(F.length("text") > limit).mapInArrow(run, SCHEMA))
