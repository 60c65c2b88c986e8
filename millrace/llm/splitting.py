"""Problem 6: items above a size limit become consecutive pieces under it, cut at natural boundaries.

A hierarchy of separators is tried from coarse to fine: section, paragraph, sentence, word, character. A unit that
fits is kept whole, one that doesn't is split by the next separator; units are packed greedily, and every piece but the
first repeats the end of the piece before it, from a boundary of words where there is one, and less of it where a whole
unit fits only so. The finest separator that was needed is the document's boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LIMIT, OVERLAP = 8192, 200

_NEWLINE = r"(?:\r\n|\r|\n)"
#: Separators; a unit doesn't count the bytes of those around it. Sections begin behind several blank lines or at a heading.
LEVELS = (
    ("section", re.compile(rf"{_NEWLINE}(?:[^\S\r\n]*{_NEWLINE}){{2,}}[^\S\r\n]*|{_NEWLINE}[^\S\r\n]*{_NEWLINE}(?=#{{1,6}} )")),
    ("paragraph", re.compile(rf"{_NEWLINE}(?:[^\S\r\n]*{_NEWLINE})+[^\S\r\n]*")),
    ("sentence", re.compile(r"(?<=[.!?…])\s+")),
    ("word", re.compile(r"\s+")),
)
#: The boundary of a document whose finest units are of a level; those of sections are between blank lines, too.
NAMES = ("paragraph", "paragraph", "sentence", "word", "none")

SCHEMA = "doc_id long, piece_no int, boundary string, byte_offset long, text_offset long, n_bytes int, overlap_bytes int, text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("boundary", pa.string()), ("byte_offset", pa.int64()), ("text_offset", pa.int64()), ("n_bytes", pa.int32()), ("overlap_bytes", pa.int32()), ("text", pa.string())])


def byte_positions(text: str) -> np.ndarray:
    """The UTF-8 offset of each character, and of the end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), out=at[1:])
    return at


def units(text: str, at: np.ndarray, most: int, step: int, lo: int = 0, hi: int | None = None, level: int = 0) -> Iterator[tuple[int, int]]:
    """The ends of consecutive units of text[lo:hi] with at most `most` bytes each, as coarse as possible, and the level of each.

    Separators are units of level -1. Where nothing else divides a text, characters do, every `step` bytes.
    """
    hi = len(text) if hi is None else hi
    if at[hi] - at[lo] <= most:
        yield hi, max(0, level - 1)
        return
    if level == len(LEVELS):
        while at[hi] - at[lo] > step:
            lo = int(np.searchsorted(at, at[lo] + step, "right")) - 1
            yield lo, level
        yield hi, level
        return
    for m in LEVELS[level][1].finditer(text, lo, hi):
        s, e = m.span()
        if s > lo:
            yield from units(text, at, most, step, lo, s, level + 1)
        while at[e] - at[s] > step:  # white space beyond a piece's size
            s = int(np.searchsorted(at, at[s] + step, "right")) - 1
            yield s, -1
        yield e, -1
        lo = e
    if lo < hi:
        yield from units(text, at, most, step, lo, hi, level + 1)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, at: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], str]:
    """(start, end, end of the piece before) in characters of each piece, which without overlaps make the text; the boundary."""
    at = byte_positions(text) if at is None else at
    if at[-1] <= limit:
        return ([(0, len(text), 0)] if text else []), NAMES[0]
    found, start, done, end, finest = [], 0, 0, 0, 0
    for u, level in units(text, at, limit, limit - overlap):
        finest = max(finest, level)
        if end > done and at[u] - at[start] > limit:
            found.append((start, end, done))
            done = end
            low = int(np.searchsorted(at, at[end] - overlap))
            space = next((m.end() for m in LEVELS[3][1].finditer(text, max(0, low - 1), end) if m.end() < end), low)
            start = max(space if 2 * (at[end] - at[space]) >= overlap else low, found[-1][0] + 1)
            if at[u] - at[start] > limit:  # a whole unit with less overlap
                low = max(start, int(np.searchsorted(at, at[u] - limit)))
                start = next((m.end() for m in LEVELS[3][1].finditer(text, max(0, low - 1), end) if low <= m.end() < end), end)
        end = u
    found.append((start, end, done))
    return found, NAMES[finest]


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every document above limit bytes, with the coarsest boundary whose units all fit, as the splitter met it.

    text_offset counts bytes of the text; byte_offset those of the source file, and stays 0 where sources have none
    (json, sqlite) and null where the document's is null. Null and smaller texts have no rows; a repeated row has its
    pieces repeated; a text without any boundary is cut between characters.
    """
    if not 0 <= overlap < limit - 4:
        raise ValueError("overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, offset, no_offsets in zip(*(c.to_pylist() for c in b.columns)):
                at = byte_positions(text)
                found, name = pieces(text, limit, overlap, at)
                for k, (s, e, before) in enumerate(found):
                    base = offset if offset is None or no_offsets else offset + int(at[s])
                    rows.append((i, k, name, base, int(at[s]), int(at[e] - at[s]), int(at[before] - at[s]) if k else 0, text[s:e]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    large = texts(documents, "byte_offset", F.coalesce(F.regexp_replace(F.lower("source"), r"\.(gz|bz2|xz|lzma)$", "").rlike(r"\.(json|db|sqlite|sqlite3)$"), F.lit(False)).alias("no_offsets"))
    return large.where(F.octet_length("text") > limit).mapInArrow(run, SCHEMA)
