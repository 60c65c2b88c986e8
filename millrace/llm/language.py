"""Problem 1: the language of each document and of each stretch of whole sentences, by rank-order profiles.

A language's profile is the order of its most frequent character n-grams, counted by the executors on a bounded sample of
documents labelled with it. A sentence's n-grams, most frequent first, are held against every profile: an n-gram costs as many
places as its rank is away from the profile's, and the most where the profile lacks it. The least-cost path through a
document's sentences, with a price for every change of language, gives its stretches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as V
from .common import maybe_in, slices, texts, written
from .encoding import _decode, _encode
from .langcodes import _BY_NAME, CODES

#: Sampled documents of each language, those with the least hash of doc_id.
SAMPLE = 300
#: Lengths of n-grams, with a mark at either end of a word; places of a profile.
LENGTHS, PLACES = (1, 2, 3, 4), 1500
#: Price of a change of language between sentences, in n-grams that are as far out of place as can be.
CHANGE = 4.0
#: Characters worked on at once: what fits in the processor's cache.
SLICE = 150_000
#: Sentences of up to so many words, all capitalised, are names.
FEW = 4
#: A sentence of whose n-grams a smaller share is in any profile is also read under other decodings.
STRANGE = 0.45
#: A document of whose n-grams, as many as FEWEST or none at all, a smaller share is in any profile is in another language.
UNKNOWN, FEWEST, OTHER = 0.5, 20, "und"
#: (written in, read as): what garbled sentences are read back under.
DECODINGS = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("utf-8", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("utf-8", "koi8-r"), ("utf-8", "mac_roman"), ("cp1251", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("iso8859-5", "cp1251"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "latin-1"), ("utf-8", "cp1250"))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code(lang: str = "lang"):
    """The two-letter code that the column names, in another spelling or not, or null; as langcodes.normal has it."""
    head = F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^[^\-_.@ (]+", 0)
    return F.create_map(*(F.lit(x) for kv in _BY_NAME.items() for x in kv))[head]


def grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(hash, sentence) of every n-gram, the text of each sentence that has letters, where it lies in the joined text,
    whether it is but a few capitalised words (labels and names), and the lower-case code points of all."""
    lower = [s.lower() for s in strings]
    c, at = V.codes(lower)
    written_c = V.codes(strings)[0]
    letter = _letters()[c]
    digit = np.flatnonzero(V.alnum()[c] & ~letter)
    if len(digit):  # codes and numbers with letters are no words
        start, end = V.spans(V.alnum()[c])
        for k in np.unique(np.searchsorted(start, digit, "right") - 1):
            letter[start[k] : end[k]] = False
    starts = V.sentence_starts(c)
    sent = np.cumsum(starts)
    sent -= starts  # the end mark belongs to its own sentence
    doc = np.repeat(np.arange(len(strings)), np.diff(at))
    where = np.flatnonzero(letter)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, bool), c
    s = sent[where]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (doc[where[1:]] != doc[where[:-1]])))
    number = np.cumsum(new) - 1
    begins = np.concatenate(([True], (np.diff(where) > 1) | new[1:]))
    n_words = np.bincount(number[begins])
    capital = (written_c != c)[where] if len(written_c) == len(c) else np.zeros(len(where), bool)
    names_only = (n_words <= FEW) & (np.bincount(number[begins], capital[begins]) == n_words)
    # words parted by one mark, which belongs to the sentence of the word before it
    gap = np.concatenate((np.diff(where) > 1, [True]))
    places = np.arange(len(where)) + np.concatenate(([0], np.cumsum(gap)[:-1])) + 1
    size = places[-1] + 2
    seq, of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    seq[places], of[places] = c[where].astype(np.uint64) + np.uint64(1), number
    marks = places[gap] + 1
    of[marks] = number[gap]
    mark = seq == 0
    found_h, found_s = [], []
    h, inside = np.zeros(size, np.uint64), np.ones(size, bool)  # of the n symbols from here on; no mark but at the ends
    with np.errstate(over="ignore"):
        for n in range(1, min(size, LENGTHS[-1]) + 1):
            m = size - n + 1
            h = h[:m] * np.uint64(0xD6E8FEB86659FD93) + seq[n - 1 :]
            inside = inside[:m]
            if n > 2:
                inside = inside & ~mark[n - 2 : n - 2 + m]
            if n in LENGTHS:
                i = np.flatnonzero(inside & ~(mark[:m] & mark[n - 1 :]))
                found_h.append(V.mix(h[i] + np.uint64(n)))
                found_s.append(of[i + (1 if n > 1 else 0)])
    first = where[new]
    last = np.append(where[np.flatnonzero(new)[1:] - 1], where[-1])
    return np.concatenate(found_h), np.concatenate(found_s), doc[first], list(zip(first.tolist(), (last + 1).tolist())), names_only, c


TABLE = 1 << 21


@dataclass
class Profiles:
    """By n-gram that any profile has (in the order of their hashes): its hash, and its place in each language's profile."""

    hashes: np.ndarray
    places: np.ndarray  # float32, in parts of PLACES; far beyond 1 where the profile lacks it

    def __post_init__(self) -> None:
        self.table = np.full(TABLE, -1, np.int32)  # where a hash is looked up at once; those in its way are searched for
        slot = (self.hashes & np.uint64(TABLE - 1)).astype(np.int64)
        self.table[slot] = np.arange(len(self.hashes))
        lost = np.flatnonzero(self.table[slot] != np.arange(len(self.hashes)))
        self.lost, self.lost_at = self.hashes[lost], lost

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h & np.uint64(TABLE - 1)).astype(np.int64)]
        hit = np.flatnonzero(at >= 0)
        wrong = hit[self.hashes[at[hit]] != h[hit]]
        at[wrong] = -1
        if len(self.lost) and len(wrong):
            k = np.minimum(np.searchsorted(self.lost, h[wrong]), len(self.lost) - 1)
            same = self.lost[k] == h[wrong]
            at[wrong[same]] = self.lost_at[k[same]]
        return at

    def distances(self, h: np.ndarray, sent: np.ndarray, n_sent: int) -> tuple[np.ndarray, np.ndarray]:
        """By sentence and language: places out of place over PLACES, summed over its n-grams; and their share in any profile."""
        ids = self.ids(h)
        known = ids >= 0
        mine = sent[known].astype(np.int64)
        share = np.bincount(mine, minlength=n_sent) / np.maximum(1, np.bincount(sent, minlength=n_sent))
        out = np.zeros((n_sent, len(CODES)), np.float32)
        if not len(mine):
            return out, share
        key = np.sort((mine << 24) | ids[known])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        order = np.sort(((key >> 24) << 40) | ((65535 - np.minimum(count, 65535)) << 24) | (key & 0xFFFFFF))  # most frequent first
        s, g = order >> 40, order & 0xFFFFFF
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        rank = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        cost = self.places[g]
        cost -= (rank / PLACES).astype(np.float32)[:, None]
        np.abs(cost, out=cost)
        np.minimum(cost, 1.0, out=cost)
        out[s[start]] = np.add.reduceat(cost, start, axis=0)
        return out, share


def ranked(tops: list[np.ndarray]) -> Profiles:
    """Profiles from the n-grams of each language in the order of their frequency."""
    hashes = np.unique(np.concatenate(tops)) if any(map(len, tops)) else np.zeros(0, np.uint64)
    places = np.full((max(1, len(hashes)), len(CODES)), 1e6, np.float32)
    for k, t in enumerate(tops):
        places[np.searchsorted(hashes, t), k] = np.arange(len(t)) / PLACES
    return Profiles(hashes if len(hashes) else np.zeros(1, np.uint64), places)


_COUNTS = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _counts(shared):
    """N-grams of a batch by language, of sentences that don't contradict their label by the profiles so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in batches:
            strings, of = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo, hi in slices(strings):
                h, sent, doc, *_ = grams(strings[lo:hi])
                if not len(h):
                    continue
                lang = of[lo + doc].astype(np.int64)
                if found is not None:
                    best = found.distances(h, sent, len(doc))[0].argmin(1)
                    lang = np.where(best == lang, lang, -1)
                for k in np.unique(lang[lang >= 0]):
                    u, n = np.unique(h[lang[sent] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(V.signed(u)), pa.array(n)], schema=_COUNTS)

    return run


def profiles(labelled: DataFrame) -> Profiles:
    """Counts n-grams of labelled texts (text, lang: the number of its code), once by the labels and then, twice more, by
    those sentences only whose nearest profile is their label's. Only PLACES n-grams a language reach the driver."""
    found = None
    for _ in range(3):
        shared = labelled.sparkSession.sparkContext.broadcast(found)
        counts = labelled.mapInArrow(_counts(shared), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # n-grams of a bounded sample
        rows = counts.withColumn("place", place).where(F.col("place") <= PLACES).orderBy("lang", "place").toArrow()
        lang, gram = rows["lang"].to_numpy(), rows["gram"].to_numpy().view(np.uint64)
        found = ranked([gram[lang == k] for k in range(len(CODES))])
    return found


def fit(documents: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most `sample` labelled documents of each language (whole texts), chosen by hash."""
    rows = documents.select("doc_id", code().alias("code")).where("doc_id is not null and code is not null and text is not null")
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ranked([np.zeros(0, np.uint64) for _ in CODES])
    top = 1 << 40
    limit = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, int(min(top, top * sample * 1.2 / n)))))[F.col("code")]
    h = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(top))
    near = rows.withColumn("h", h).where(F.col("h") <= limit).dropDuplicates(["doc_id"])
    first = F.row_number().over(W.partitionBy("code").orderBy("h", "doc_id"))  # some 1.2 times the sample
    number = F.create_map(*(F.lit(x) for i, c in enumerate(CODES) for x in (c, i)))[F.col("code")]
    near = written(near.withColumn("no", first).where(F.col("no") <= sample).select("doc_id", number.alias("number")))
    found = maybe_in(texts(documents), "doc_id", near.select("doc_id")).join(near, "doc_id").dropDuplicates(["doc_id"])
    return profiles(written(found.repartition(len(CODES) * 2, "doc_id").select("text", F.col("number").alias("lang"))))


_ORDINARY = "“”„‟‘’«»‹›–—…¿¡°•·\xad"


@functools.cache
def _strange() -> np.ndarray:
    """By code point: 1 for what is neither a letter nor an ordinary mark, 2 for a control character of C1."""
    table = np.zeros(0x110000, np.int8)
    for i in range(0x80, 0x110000):
        c = chr(i)
        table[i] = 2 if i <= 0x9F else not (c.isalnum() or c.isspace() or c in _ORDINARY)
    return table


def _odd(c: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """By sentence: has it up to four characters that are neither letters nor ordinary marks within a word, as garbled text has."""
    kind = _strange()[c]
    lo, hi = V.spans(kind == 1)
    word = V.alnum()
    inner = (hi - lo <= 4) & (lo > 0) & (hi < len(c))
    lo, hi = lo[inner], hi[inner]
    at = np.sort(np.concatenate((lo[word[c[lo - 1]] & word[c[np.minimum(hi, len(c) - 1)]]], np.flatnonzero(kind == 2))))
    start, end = np.array(spans).T
    return np.searchsorted(at, end) > np.searchsorted(at, start)


def reread(text: str) -> list[str]:
    """What a garbled text may have been."""
    out = []
    for was, read in DECODINGS:
        try:
            out.append(_decode(_encode(text, read), was))
        except UnicodeError:
            pass
    return out


def path(cost: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of each sentence on the least-cost path."""
    n, k = cost.shape
    back = np.zeros((n, k), np.int64)
    total = cost[0].copy()
    for i in range(1, n):
        best = int(total.argmin())
        stay = total <= total[best] + change
        back[i] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] + change) + cost[i]
    out = np.empty(n, np.int64)
    out[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def classify(strings: list[str], p: Profiles, change: float = CHANGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, costs, share of its n-grams in any profile) of each sentence that has letters, in order.

    The language is len(CODES) for all sentences of documents that no profile knows.
    """
    h, sent, doc, spans, names_only, c = grams(strings)
    if not len(doc):
        return doc, doc, np.zeros((0, len(CODES))), np.zeros(0)
    cost, share = p.distances(h, sent, len(doc))
    odd = np.flatnonzero((share < STRANGE) | _odd(c, spans))
    if len(odd):
        joined = "\n".join(s.lower() for s in strings)
        case = joined if len(joined) != sum(map(len, strings)) + len(strings) - 1 else "\n".join(strings)  # as written, where lower case has its length
        for i in odd:
            s = case[spans[i][0] : spans[i][1]]
            if s.isascii():
                continue
            options = [x for x in reread(s) if x != s]
            if not options:
                continue
            gh, gs, gd, *_ = grams(options)
            if not len(gd):
                continue
            c, sh = p.distances(gh, gs, len(gd))
            n = np.bincount(gd, minlength=len(options))
            per = np.zeros((len(options), len(CODES)), np.float32)
            np.add.at(per, gd, c)
            good = np.zeros(len(options))
            np.add.at(good, gd, sh)
            best = int((good / np.maximum(1, n)).argmax())
            if good[best] / max(1, n[best]) > share[i] + (0.1 if share[i] < STRANGE else 0.02) and (share[i] < STRANGE or per[best].min() < cost[i].min()):
                cost[i] = per[best]
                share[i] = good[best] / max(1, n[best])
    # names make no stretch: they go with their neighbours, unless the document has nothing else
    rest = np.bincount(doc, ~names_only, minlength=len(strings))[doc] > 0
    cost[names_only & rest] = 0
    lang = cost.argmin(1)
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    mixed = np.add.reduceat(np.concatenate(([False], (lang[1:] != lang[:-1]) & (doc[1:] == doc[:-1]))), edges[:-1]) > 0
    for k in np.flatnonzero(mixed):
        lo, hi = edges[k], edges[k + 1]
        lang[lo:hi] = path(cost[lo:hi], change)
    n = np.bincount(sent, minlength=len(doc))
    first, each = edges[:-1], np.diff(edges)
    total, known = np.add.reduceat(n, first), np.add.reduceat(n * share, first)
    other = (known < UNKNOWN * total) & (total >= FEWEST) | (known == 0)
    return doc, np.where(np.repeat(other, each), len(CODES), lang), cost, share


SCHEMA = "doc_id long, seg_no int, lang string, confidence double, n_sentences int, n_segs int, doc_lang string, doc_confidence double, named string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_segs", pa.int32()), ("doc_lang", pa.string()), ("doc_confidence", pa.float64()), ("named", pa.string())])


def _sure(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language by row, and how much nearer its profile is than the second's, as a share of the latter's distance."""
    two = np.partition(cost, 1, axis=1)[:, :2]
    return cost.argmin(1), np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(1e-9, two[:, 1]), 0.0)


def stretches(documents: DataFrame, p: Profiles, change: float = CHANGE) -> DataFrame:
    """A row for each maximal stretch of sentences in one language of each document with letters, and the document's own.

    confidence is 0 where two languages are equally far and near 1 where only one fits; lang is "und" where no profile
    fits, with the part of the n-grams that none knows as confidence. named is the code that the column lang stands for,
    if any. Texts that are null or have no letters have no rows; repeated rows have theirs each.
    """
    sent = documents.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*CODES, OTHER])
        for b in batches:
            ids, strings, named = b.column(0), b.column(1).to_pylist(), b.column(2)
            for lo, hi in slices(strings, SLICE):
                doc, lang, cost, share = classify(strings[lo:hi], sent.value, change)
                if not len(doc):
                    continue
                new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
                first = np.flatnonzero(new_doc | np.concatenate(([True], lang[1:] != lang[:-1])))
                d = doc[first]
                doc_first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                of_doc = np.cumsum(np.concatenate(([True], d[1:] != d[:-1]))) - 1
                seg = np.arange(len(first)) - doc_first[of_doc]
                per = np.add.reduceat(cost, first, axis=0)
                two = np.sort(per, axis=1)[:, :2]
                other = lang[first] == len(CODES)
                mine = per[np.arange(len(first)), np.minimum(lang[first], len(CODES) - 1)]
                rival = np.where(mine <= two[:, 0], two[:, 1], two[:, 0])
                conf = np.clip(np.where(rival > 0, 1 - mine / np.maximum(1e-9, rival), 0.0), 0, 1)
                strange = 1 - np.add.reduceat(share, first) / np.diff(first, append=len(lang))
                conf = np.where(other, np.clip(strange, 0, 1), conf)
                whole, sure = _sure(np.add.reduceat(per, doc_first, axis=0))
                whole, sure = np.where(other[doc_first], len(CODES), whole), np.where(other[doc_first], conf[doc_first], sure)
                at = pa.array(d)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(at).cast(pa.int64()), pa.array(seg.astype(np.int32)), names.take(pa.array(lang[first])), pa.array(conf.astype(np.float64)), pa.array(np.diff(first, append=len(lang)).astype(np.int32)), pa.array(np.diff(doc_first, append=len(first))[of_doc].astype(np.int32)), names.take(pa.array(whole[of_doc])), pa.array(sure[of_doc].astype(np.float64)), named.slice(lo, hi - lo).take(at)], schema=_SCHEMA)

    return texts(documents.withColumn("named", code()), "named").mapInArrow(run, SCHEMA)


def mislabelled(found: DataFrame) -> DataFrame:
    """doc_id, seg_no, lang of the stretches of documents in several languages or whose label isn't their language."""
    return found.where("n_segs > 1 or named is null or named <> lang").select("doc_id", "seg_no", "lang").distinct()
