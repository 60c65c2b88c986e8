"""Mixed document sources as one DataFrame: text, JSON Lines, JSON, CSV/TSV, DOCX, SQLite; gzip, bz2, xz; zip and tar.

The driver lists files and the members of archives; a source is then read by one task, which opens a container once for
all its members. Lines, and rows of tables and databases, pass through it; a text or a JSON document is held whole. Spark's own readers aren't used: they hide names that begin with an underscore, drop empty
files, break lines at a lone carriage return, replace undecodable bytes and don't know xz.
"""

from __future__ import annotations

import bz2
import codecs
import csv
import gzip
import io
import json
import lzma
import os
import re
import sqlite3
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DatasetDecodeError, DatasetError, DatasetFormatError
from ..operators import chat
from ..operators.chunks import cuts

#: Names that a text field or column may have, in order of preference; suffixes; limits; byte order marks.
TEXT_FIELDS = ("text", "content", "body", "document", "raw_content")
TEXT_COLUMNS = ("text", "content", "body", "document", "review", "review_text", "message", "comment", "abstract", "sentence")
KINDS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "csv", "docx": "docx", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "txt": "text", "text": "text", "md": "text", "rst": "text", "log": "text"}
CODECS = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open, "lzma": lzma.open}
MAX_JSON, MAX_DOCX, MAX_MEMBERS, MAX_ARCHIVE, MAX_FIELD = 128 << 20, 32 << 20, 20_000, 32 << 30, 16 << 20
BOMS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
MEMBER = "::"
NAMED = 20


@dataclass(frozen=True)
class Options:
    encoding: str = "utf-8"
    text_field: str | None = None
    messages_field: str | None = None
    table: str | None = None
    min_chars: int = 1
    max_chars: int = 16_384
    on_error: str = "fail"

    def __post_init__(self) -> None:
        if self.on_error not in ("fail", "skip"):
            raise ConfigError(f"on_error must be fail or skip, not {self.on_error!r}")
        if self.text_field and self.messages_field:
            raise ConfigError("text and messages can't both be read from a record")
        if self.max_chars < 2:
            raise ConfigError("max_chars must be at least 2")


@dataclass
class Listing:
    """Sources in reading order, and what was passed over (all counted, the first NAMED named)."""

    sources: list[tuple] = field(default_factory=list)
    passed: dict[str, list[str]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def note(self, why: str, name: str) -> None:
        self.counts[why] = self.counts.get(why, 0) + 1
        if len(self.passed.setdefault(why, [])) < NAMED:
            self.passed[why].append(name)


def _suffix(name: str) -> tuple[str | None, str | None]:
    """(kind, codec) of a name."""
    parts = os.path.basename(name).lower().split(".")
    codec = parts.pop() if len(parts) > 1 and parts[-1] in CODECS else None
    return (KINDS.get(parts[-1]) if len(parts) > 1 else None), codec


def _archive(name: str) -> str | None:
    n = name.lower()
    return "zip" if n.endswith(".zip") else "tar" if re.search(r"\.(tar|tgz|tbz2|txz|tar\.(gz|bz2|xz))$", n) else None


def _hidden(path: str) -> bool:
    return any(p.startswith(".") for p in path.split("/") if p not in (".", ".."))


def is_sqlite(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(16) == b"SQLite format 3\x00"


def discover(root: str) -> Listing:
    """All sources under root, by POSIX path; archives expanded in place, their members by name."""
    if not os.path.exists(root):
        raise DatasetError(f"{root} does not exist")
    out = Listing()
    if os.path.isfile(root):
        files = [(os.path.basename(root), root)]
    else:
        found = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]
        files = sorted((os.path.relpath(p, root).replace(os.sep, "/"), p) for p in found)
        files = [(r, p) for r, p in files if not _hidden(r)]
    for relative, path in files:
        if a := _archive(relative):
            _members(out, relative, path, a)
            continue
        kind, codec = _suffix(relative)
        if kind is None and os.path.isfile(root) and "." not in os.path.basename(relative).lstrip("."):
            kind = "text"
            out.note("assumed_text", relative)
        if kind is None:
            out.note("unrecognized", relative)
        elif kind == "sqlite" and (codec or not is_sqlite(path)):
            out.note("not_a_database", relative)
        else:
            out.sources.append((relative, path, None, kind, codec, os.path.getsize(path)))
    if not out.sources:
        raise DatasetError(f"nothing readable in {root}", "It holds: " + ", ".join(r for r, _ in files[:10]))
    return out


def _members(out: Listing, relative: str, path: str, kind: str) -> None:
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            entries = sorted((i.filename, i.file_size) for i in z.infolist() if not i.is_dir() and (i.external_attr >> 16) & 0o170000 != 0o120000)
    else:
        with tarfile.open(path) as t:
            entries = sorted((m.name, m.size) for m in t if m.isfile())
    if len(entries) > MAX_MEMBERS or sum(n for _, n in entries) > MAX_ARCHIVE:
        raise DatasetError(f"{relative} has more members or bytes than is allowed")
    for name, size in entries:
        k, codec = _suffix(name)
        shown = f"{relative}{MEMBER}{name}"
        if _hidden(name) or name.startswith("__MACOSX/"):
            continue
        if _archive(name):
            out.note("nested_archive", shown)
        elif k is None or k == "sqlite":
            out.note("member_ignored", shown)
        else:
            out.sources.append((shown, path, name, k, codec, size))


def _open(path: str, containers: dict, member: str | None, codec: str | None):
    if member is None:
        return CODECS[codec](path, "rb") if codec else open(path, "rb")
    if path not in containers:
        containers[path] = zipfile.ZipFile(path) if _archive(path) == "zip" else tarfile.open(path)
    box = containers[path]
    raw = box.open(member) if isinstance(box, zipfile.ZipFile) else box.extractfile(member)
    return CODECS[codec](raw, "rb") if codec else raw


def decode(data: bytes, encoding: str, source: str, at: int = 0) -> str:
    """Strictly: an undecodable byte is an error that names its place, never a replacement character.

    at: the place of data in the source; only at the beginning of a source a byte order mark is looked for.
    """
    for mark, name in BOMS if at == 0 else ():
        if data.startswith(mark):
            if encoding not in ("utf-8", "utf8") and encoding.replace("-", "")[:5] != name.replace("-", "")[:5]:
                raise DatasetDecodeError(f"{source} has a byte order mark of {name}, not {encoding}")
            encoding = name
            break
    wide = encoding.startswith(("utf-16", "utf-32"))
    if not wide and (zero := data.find(b"\0", 0, 1 << 20)) >= 0:
        raise DatasetFormatError(f"{source} holds a zero byte at {at + zero} and is no text")
    try:
        return data.decode(encoding)
    except UnicodeDecodeError as e:
        raise DatasetDecodeError(f"{source}: byte {at + e.start} ({data[e.start:e.end].hex()}) is not {encoding}", at=at + e.start) from e


def _undecodable(f, encoding: str) -> int | None:
    """The place of the first byte of a file that can't be decoded, a part of the file at a time."""
    decoder, at = codecs.getincrementaldecoder(encoding)(), 0
    while True:
        data = f.read(1 << 20)
        held = len(decoder.getstate()[0])
        try:
            decoder.decode(data, not data)
        except UnicodeDecodeError as e:
            return at - held + e.start
        if not data:
            return None
        at += len(data)


class _Rows:
    """What one source yields: documents, and counters of the rest."""

    def __init__(self, source: str, o: Options) -> None:
        self.source, self.o, self.ordinal, self.rows, self.counts, self.chars = source, o, 0, [], {}, 0

    def count(self, why: str, n: int = 1) -> None:
        self.counts[why] = self.counts.get(why, 0) + n

    def bad(self, message: str) -> None:
        if self.o.on_error == "fail":
            raise DatasetFormatError(f"{self.source}: {message}")
        self.count("records_skipped")

    def keep(self, text: str, offset: int, spans: list | None = None) -> None:
        if len(text.strip()) >= max(1, self.o.min_chars):
            self.rows.append((self.ordinal, offset, text, spans))
            if spans is not None:
                self.count("chat_documents")
                self.count("chat_chars", len(text))
                self.count("chat_trained_chars", sum(hi - lo for lo, hi in spans))
            self.chars += len(text)
            self.ordinal += 1
        else:
            self.count("short_documents")

    def pieces(self, text: str) -> None:
        if len(text) > self.o.max_chars:
            self.count("long_files_split")
        at = 0
        for _, piece in cuts(text, self.o.max_chars):
            self.keep(piece, at)
            at += len(piece.encode())


def _value(record, rows: _Rows, state: dict):
    """The text of a JSON record; the field is resolved once, from the first object."""
    if isinstance(record, str):
        return record
    if not isinstance(record, dict):
        return rows.bad("a record is neither text nor an object")
    if "field" not in state:
        state["field"] = rows.o.text_field or next((k for k in TEXT_FIELDS if isinstance(record.get(k), str)), None)
        if state["field"] is None:
            raise DatasetFormatError(f"{rows.source}: no field of {', '.join(TEXT_FIELDS)} holds text", "Name the field.")
    text = record.get(state["field"])
    return text if isinstance(text, str) else rows.bad(f"field {state['field']} holds no text")


def _record(record, rows: _Rows, state: dict, at: int) -> None:
    """Keeps the text of a JSON record, or the conversation that it holds."""
    name = rows.o.messages_field
    if name is None:
        value = _value(record, rows, state)
        if value is not None:
            rows.keep(value, at)
    elif not isinstance(record, dict) or name not in record:
        rows.bad(f"a record has no field {name} with messages")
    elif why := chat.fault(record[name]):
        rows.bad(f"messages of a record: {why}")
    else:
        text, spans = chat.written_out(record[name])
        rows.keep(text, at, spans)


def _strict(constant: str):
    raise ValueError(constant)


def _jsonl(f, rows: _Rows) -> Iterator[None]:
    """A line at a time; byte offsets are those of the source."""
    if rows.o.encoding.startswith(("utf-16", "utf-32")):
        raise DatasetFormatError(f"{rows.source}: JSON Lines must be in an encoding with one-byte line ends")
    at, state = 0, {}
    for n, line in enumerate(f, 1):
        if line.strip():
            text = decode(line.removesuffix(b"\n"), rows.o.encoding, rows.source, at)
            try:
                record = json.loads(text, parse_constant=_strict)
            except ValueError:
                rows.bad(f"line {n} is no JSON")
            else:
                _record(record, rows, state, at)
        at += len(line)
        yield


def _json(data: bytes, rows: _Rows) -> None:
    if len(data) > MAX_JSON:
        raise DatasetFormatError(f"{rows.source} is larger than a whole-file JSON may be", "Write it as JSON Lines.")
    try:
        whole = json.loads(decode(data, rows.o.encoding, rows.source), parse_constant=_strict)
    except ValueError as e:
        raise DatasetFormatError(f"{rows.source} is no JSON: {e}") from e
    if isinstance(whole, dict):
        arrays = [k for k, v in whole.items() if isinstance(v, list)]
        key = rows.o.messages_field if rows.o.messages_field in whole else rows.o.text_field or next((k for k in TEXT_FIELDS if isinstance(whole.get(k), str)), None)
        arrays = [k for k in arrays if k != rows.o.messages_field]
        if key and arrays:
            raise DatasetFormatError(f"{rows.source} has both text and an array")
        if not key and len(arrays) != 1:
            raise DatasetFormatError(f"{rows.source} has {len(arrays)} arrays; one is needed")
        whole = [whole] if key else whole[arrays[0]]
    if not isinstance(whole, list):
        raise DatasetFormatError(f"{rows.source} is neither an array nor an object")
    state: dict = {}
    for record in whole:
        _record(record, rows, state, 0)


def column(header: list[str], wanted: str | None, source: str) -> int:
    names = [h.strip().lower() for h in header]
    if wanted is not None:
        if wanted.strip().lower() not in names:
            raise DatasetFormatError(f"{source} has no column {wanted!r}")
        return names.index(wanted.strip().lower())
    if len(names) == 1:
        if any(d in header[0] for d in ";|\t,"):
            raise DatasetFormatError(f"{source}: the header looks as if another delimiter was used")
        return 0
    for c in TEXT_COLUMNS:
        if c in names:
            return names.index(c)
    raise DatasetFormatError(f"{source}: which of {', '.join(header)} is the text?", "Name the column.")


def _csv(f, rows: _Rows) -> Iterator[None]:
    """A row at a time. f is decoded as it is read; an undecodable byte ends it with an error."""
    csv.field_size_limit(MAX_FIELD)
    delimiter = "\t" if re.search(r"\.tsv(\.\w+)?$", rows.source.lower()) else ","
    raw = io.BufferedReader(f, 1 << 20) if not isinstance(f, io.BufferedReader) else f
    head = raw.peek(1 << 20)
    encoding = next((name for mark, name in BOMS if head.startswith(mark)), rows.o.encoding)
    decode(head[:64].split(b"\n")[0] if encoding == "utf-8-sig" else b"", rows.o.encoding, rows.source)  # a mark that contradicts the encoding
    if not encoding.startswith(("utf-16", "utf-32")) and (zero := head.find(b"\0")) >= 0:
        raise DatasetFormatError(f"{rows.source} holds a zero byte at {zero} and is no text")
    reader = csv.reader(io.TextIOWrapper(raw, encoding, "strict", newline=""), delimiter=delimiter)
    try:
        header = next(reader, None)
        if header is None:
            return
        at = column(header, rows.o.text_field, rows.source)
        for row in reader:
            if not row:
                continue
            if len(row) <= at:
                rows.bad(f"row {reader.line_num} is too short")
                continue
            if len(row) > len(header):
                rows.count("extra_field_rows")
            rows.keep(row[at], 0)
            yield
    except csv.Error as e:
        raise DatasetFormatError(f"{rows.source} can't be read as CSV: {e}") from e


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}tab": "\t", f"{_W}noBreakHyphen": "-"}


def docx_text(data: bytes, source: str = "document") -> str:
    """The text of a Word document: runs, breaks and paragraphs, without fallbacks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {i.filename: i.file_size for i in z.infolist()}
        part = "word/document.xml"
        if part not in names:
            rels = ElementTree.fromstring(z.read("_rels/.rels")) if "_rels/.rels" in names else []
            part = next((r.get("Target", "").lstrip("/") for r in rels if r.get("Type", "").endswith("/officeDocument")), "")
        if names.get(part, MAX_DOCX + 1) > MAX_DOCX:
            raise DatasetFormatError(f"{source} has no document part of an allowed size")
        xml = z.read(part)
    if b"<!DOCTYPE" in xml:
        raise DatasetFormatError(f"{source} declares a document type")
    out: list[str] = []

    def walk(node) -> None:
        for e in node:
            if e.tag.endswith("}Fallback"):
                continue
            if e.tag == f"{_W}t":
                out.append(e.text or "")
            elif e.tag in _BREAKS:
                out.append(_BREAKS[e.tag])
            walk(e)
            if e.tag == f"{_W}p":
                out.append("\n")

    walk(ElementTree.fromstring(xml))
    return "".join(out).strip("\n")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite(path: str, rows: _Rows) -> Iterator[None]:
    """One column of one table, in a pinned order. Views, internal and shadow tables aren't choices."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        objects = db.execute("SELECT name, type, coalesce(sql, '') FROM sqlite_master WHERE type IN ('table', 'view')").fetchall()
        virtual = [n for n, t, s in objects if s.upper().startswith("CREATE VIRTUAL")]
        tables = [n for n, t, _ in objects if t == "table" and not n.startswith("sqlite_") and not any(n.startswith(v + "_") for v in virtual)]
        wanted = rows.o.table
        if wanted is not None and wanted not in tables:
            raise DatasetFormatError(f"{rows.source} has no table {wanted!r}")
        if wanted is None and len(tables) != 1:
            raise DatasetFormatError(f"{rows.source}: which of {', '.join(sorted(tables)) or 'no tables'}?", "Name the table.")
        table = wanted or tables[0]
        info = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        names = [i[1] for i in info]
        text = names[column(names, rows.o.text_field, rows.source)]
        order = next((r for r in ("rowid", "_rowid_", "oid") if r not in [n.lower() for n in names]), None)
        if order:
            try:
                db.execute(f"SELECT {order} FROM {_quoted(table)} LIMIT 0")
            except sqlite3.OperationalError:
                order = None
        if not order:
            keys = sorted((i[5], i[1]) for i in info if i[5])
            if not keys:
                raise DatasetFormatError(f"{rows.source}: the rows of {table} have no order")
            order = ", ".join(_quoted(k) for _, k in keys)
        for (value,) in db.execute(f"SELECT {_quoted(text)} FROM {_quoted(table)} ORDER BY {order}"):
            if value is not None and not isinstance(value, str):
                rows.bad(f"column {text} holds a {type(value).__name__}")
            else:
                rows.keep(value or "", 0)
            yield
    finally:
        db.close()


def _parts(path: str, member: str | None, kind: str, codec: str | None, containers: dict, rows: _Rows) -> Iterator[None]:
    """Reads a source into rows, which may be emptied at every step. Lines, rows of tables and of databases are read one at
    a time; texts, JSON documents and DOCX, which are one value, whole."""
    o, relative = rows.o, rows.source
    try:
        if kind == "sqlite":
            yield from _sqlite(path, rows)
        elif kind in ("jsonl", "csv"):
            if o.on_error == "skip":  # a source that can't be decoded is skipped whole: nothing may have been emitted yet
                with _open(path, containers, member, codec) as f:
                    head = f.read(4)
                encoding = next((name for mark, name in BOMS if head.startswith(mark)), o.encoding)
                with _open(path, containers, member, codec) as f:
                    if (at := _undecodable(f, encoding)) is not None:
                        raise DatasetDecodeError(f"{relative}: byte {at} is not {encoding}", at=at)
            with _open(path, containers, member, codec) as f:
                yield from (_jsonl if kind == "jsonl" else _csv)(f, rows)
        else:
            with _open(path, containers, member, codec) as f:
                data = f.read()
            {"text": lambda: rows.pieces(decode(data, o.encoding, relative)), "json": lambda: _json(data, rows), "docx": lambda: rows.pieces(docx_text(data, relative))}[kind]()
            yield
    except UnicodeDecodeError as e:
        with _open(path, containers, member, codec) as f:
            at = _undecodable(f, e.encoding)
        raise DatasetDecodeError(f"{relative}: byte {at} is not {e.encoding}", at=at) from e
    except DatasetDecodeError:
        if o.on_error == "fail":
            raise
        rows.rows, rows.counts = [], {"files_skipped": 1}
    except EOFError as e:
        raise DatasetError(f"{relative} is cut off") from e
    except (OSError, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError) as e:
        raise DatasetError(f"{relative} is damaged: {e}") from e


def _read(relative: str, path: str, member: str | None, kind: str, codec: str | None, o: Options, containers: dict) -> _Rows:
    """A whole source at once."""
    rows = _Rows(relative, o)
    for _ in _parts(path, member, kind, codec, containers, rows):
        pass
    return rows


#: Documents, and characters of them, after which a task hands on what it has of a source.
FLUSH_ROWS, FLUSH_CHARS = 4096, 16 << 20

SCHEMA = "source_idx long, source string, kind string, ordinal long, byte_offset long, text string, trained_spans array<struct<span_start:int,span_end:int>>, outcome string, n long"


COLUMNS = ["source_idx", "source", "kind", "ordinal", "byte_offset", "text", "trained_spans", "outcome", "n"]


def read(spark: SparkSession, root: str, options: Options | None = None) -> tuple[DataFrame, DataFrame, Listing]:
    """(documents, counters, listing). documents: source_idx, source, ordinal, byte_offset, text, trained_spans, in the order of the first
    two numbers; counters: source, outcome, n. Members of one archive are read by one task."""
    o = options or Options()
    listing = discover(root)
    rows = [(i, *s) for i, s in enumerate(listing.sources)]
    frame = spark.createDataFrame(rows, "source_idx long, source string, path string, member string, kind string, codec string, size long")
    boxes = max(1, len({r[2] for r in rows}))

    def handed(r, got: _Rows) -> pd.DataFrame:
        spans = lambda s: None if s is None else [{"span_start": lo, "span_end": hi} for lo, hi in s]
        out = [(r.source_idx, r.source, r.kind, k, at, t, spans(s), None, None) for k, at, t, s in got.rows]
        out += [(r.source_idx, r.source, r.kind, None, None, None, None, w, n) for w, n in [("documents", len(got.rows)), *got.counts.items()]]
        got.rows, got.counts, got.chars = [], {}, 0
        return pd.DataFrame(out, columns=COLUMNS).astype({"ordinal": "Int64", "byte_offset": "Int64", "n": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        containers: dict = {}
        for f in frames:
            for r in f.itertuples():
                got = _Rows(r.source, o)
                for _ in _parts(r.path, r.member, r.kind, r.codec, containers, got):
                    if len(got.rows) >= FLUSH_ROWS or got.chars >= FLUSH_CHARS:
                        yield handed(r, got)
                yield handed(r, got)
        for c in containers.values():
            c.close()

    read_ = frame.repartition(min(boxes, spark.sparkContext.defaultParallelism * 4), "path").mapInPandas(run, SCHEMA)
    documents = read_.where("outcome is null").select("source_idx", "source", "ordinal", "byte_offset", "text", "trained_spans")
    return documents, read_.where("outcome is not null").groupBy("source", "outcome").agg(F.sum("n").alias("n")), listing
