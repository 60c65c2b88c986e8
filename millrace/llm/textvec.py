"""Words, shingles and sentences of many texts at once, as numpy arrays.

A text becomes an array of code points; hashes of words are differences of a running polynomial hash, so that no
Python code runs per word. Hashes are 64 bits wide and the same in every process and at every batch size.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def alnum() -> np.ndarray:
    """By code point: is it a letter or digit, as str.isalnum has it."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings with a line feed after each; where each begins (one entry more than strings)."""
    joined = "\n".join(strings) + "\n"
    at = np.zeros(len(strings) + 1, np.int64)
    np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings)), out=at[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), at


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, independent of where the range lies."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(0x51ED27)) * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of some texts: hash, text number, and the range of code points of each; at: where each text begins."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    codes: np.ndarray


def words(strings: list[str]) -> Words:
    """Maximal runs of letters or digits, lower-cased."""
    c, at = codes([s.lower() for s in strings])
    start, end = spans(alnum()[c])
    return Words(range_hashes(c, start, end), np.searchsorted(at, start, "right") - 1, start, end, at, c)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, the text of each, and the number of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    keep = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[keep]), doc[keep], keep


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text and hash, with their numbers of occurrences."""
    if not len(hashes):
        return hashes, doc, np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return h[first], d[first], np.diff(first, append=len(h))


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's bigint holds it."""
    return np.ascontiguousarray(x).view(np.int64)


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(x) for x in chars]] = True
    return table


@functools.cache
def _sentence_marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _marks(".!?…。！？"), space, _marks("”“\"»«’')]*_")


def sentence_starts(c: np.ndarray) -> np.ndarray:
    """By code point: does a sentence begin behind it (an end mark and closing quotes before white space, or a line's end)."""
    ends, space, close = _sentence_marks()
    e, s, q = ends[c], space[c], close[c]
    out = np.zeros(len(c), bool)
    out[:-1] = e[:-1] & s[1:]
    out[:-2] |= e[:-2] & q[1:-1] & s[2:]
    out[:-3] |= e[:-3] & q[1:-2] & q[2:-1] & s[3:]
    return out | (c == 10) | (c == 13) | (c == 0x2028)


def sentences(w: Words) -> np.ndarray:
    """The number of the sentence of each word, counted on from text to text; numbers of sentences without words are left out."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    till = np.cumsum(sentence_starts(w.codes))[w.start]
    return np.concatenate(([0], np.cumsum((till[1:] != till[:-1]) | (w.doc[1:] != w.doc[:-1]))))
