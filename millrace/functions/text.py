"""Characters, lines and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that str.isspace() and str.splitlines() know, as a Java and RE2 class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

#: Buckets of writing systems, as ranges of code points.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "digits": ((0x30, 0x39),),
    "emoji_symbols": ((0x2600, 0x27BF), (0x1F000, 0x1FAFF)),
}


def script_class(name: str) -> str:
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in SCRIPTS[name]) + "]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    """Without white space at either end, whatever Unicode counts as such."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def stem(path: Column) -> Column:
    """The name in lower case without the suffix of a codec."""
    return F.regexp_replace(F.lower(path), r"\.(gz|bz2|xz|lzma)$", "")


def codec(path: Column) -> Column:
    found = F.regexp_extract(F.lower(path), r"\.(gz|bz2|xz|lzma)$", 1)
    return F.when(found == "", F.lit("none")).otherwise(found)


def kind(path: Column) -> Column:
    """The format that a name stands for, null for names that are none."""
    s, expr = stem(path), F.lit(None).cast("string")
    for name, suffixes in reversed((("jsonl", "jsonl|ndjson"), ("json", "json"), ("csv", "csv|tsv"), ("docx", "docx"), ("sqlite", "db|sqlite|sqlite3"), ("text", "txt|text|md|rst|log"))):
        expr = F.when(s.rlike(rf"\.({suffixes})$"), F.lit(name)).otherwise(expr)
    return expr


def location(source: Column, ordinal: Column, offset: Column) -> Column:
    return F.format_string("%s:%d (byte %s)", source, ordinal, F.format_number(offset, 0))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))
