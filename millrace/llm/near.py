"""Problem 5: near-duplicate records, by consistent weighted sampling.

Weights are TF-IDF of word shingles; document frequencies are counted over all documents in a sketch of fixed size, and
improved consistent weighted sampling turns the weights into samples. Where pairs by plain Jaccard similarity are asked
for, the weights are damped to a range of RANGE: whole weights would lower the similarity of texts whose shared shingles
are frequent, while damped ones keep it above a bound that follows from the plain similarity. Bands of samples make the
candidate pairs, a signature that each class carries judges them where they meet, and what is left is verified on whole
shingle sets. Documents with the same set of shingles are one class; only classes are compared.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies
from . import textvec as V
from .common import components, done, maybe_in, slices, texts, written

#: Words of a shingle and least similarity, as TESTDATA.md has them for this problem.
SHINGLE, SIMILARITY = 3, 0.6
#: A pair is found if all ROWS samples of any of BANDS bands agree: at similarity 0.6 with probability 0.9996.
BANDS, ROWS = 32, 3
SAMPLES = BANDS * ROWS
#: Samples of which four bits each are kept to estimate a pair's similarity, and how many must agree: at similarity 0.6
#: some 60 of 96 do, and fewer than 37 with a probability under one in a million; of unrelated texts' some 8 do.
KEPT, AGREE = 96, 37
#: Where plain similarity counts: the greatest weight of a shingle over the least. Sets of plain similarity s then have a
#: weighted one of s / (s + RANGE * (1 - s)) at least, 0.577 for 0.6, and share one of PLAIN_BANDS with probability 0.9996.
RANGE, PLAIN_BANDS = 1.1, 37
#: There, two bits each of so many samples by plain similarity are kept, and so many must agree: at similarity 0.6 some 179
#: of 256 do, and fewer than 143 with a probability under one in a million; at 0.25, as of texts of one template, so many
#: do in one of 40,000 pairs.
PLAIN_KEPT, PLAIN_AGREE = 256, 143
#: Counters of the sketch of document frequencies, and of a row of it that is merged at once.
SKETCH, SEGMENT = 1 << 22, 1 << 16
#: Random variates are drawn for POOL rows; a shingle has those of its hash's row, and its hash tells it from the others.
POOL = 1 << 12
#: Weights are rounded to quarters of their logarithm; LEVELS of them, from LOWEST on.
LEVELS, LOWEST = 36, -1.0


def shingles(strings: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: hash, text, occurrences; sorted by text and hash."""
    w = V.words(strings)
    h, doc, _ = V.ngrams(w.hash, w.doc, n)
    return V.distinct(h, doc)


# --- pass 1: classes and document frequencies

def _set_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each set whose shingles begin at first."""
    with np.errstate(over="ignore"):
        return V.mix(np.add.reduceat(V.mix(h + np.uint64(5)), first))


_FIRST = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("n", pa.int32())])


def _first(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, strings = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in slices(strings):
                h, doc, _ = shingles(strings[lo:hi], n)
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                a, m = _set_hash(h, first), np.diff(first, append=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[first]].astype(np.int64)), pa.array(V.signed(a)), pa.array(m.astype(np.int32))], schema=_FIRST)

    return run


_COUNTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("counts", pa.binary())])


def _sketch(n: int):
    """The counters of one task, a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(SKETCH, np.uint32), False
        for b in batches:
            strings = b.column(0).to_pylist()
            for lo, hi in slices(strings):
                h, _, _ = shingles(strings[lo:hi], n)
                seen = seen or bool(len(h))
                at = (h & np.uint64(SKETCH - 1)).astype(np.int64)
                if len(h) > SKETCH // 4:
                    count += np.bincount(at, minlength=SKETCH).astype(np.uint32)
                else:
                    np.add.at(count, at, 1)
        if seen:
            packed = [zlib.compress(count[i : i + SEGMENT].tobytes(), 1) for i in range(0, SKETCH, SEGMENT)]
            k = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(packed, pa.binary())], schema=_COUNTS)

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, np.uint64)
    for x in rows["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pd.DataFrame({"part": [key[1]], "segment": [key[0]], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def merged(counts: DataFrame, fan: int = 64, merge=_merge) -> DataFrame:
    """The sums of the tasks' counters, a row for each segment: a tree, in which no group has more than fan rows."""
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan)
        counts = written(counts.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("segment", "part").applyInPandas(merge, "part int, segment int, counts binary"))
        if parts == 1:
            return counts


def first_pass(documents: DataFrame, n: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """(classes, levels): doc_id, a (the set's hash), n (its size) by document; and the weight level of each counter.

    Frequencies are counted over the classes' smallest documents, so that copies don't make their words common. The sketch
    has SKETCH counters whatever the number of documents; its 4 MB of levels are all that reaches the driver.
    """
    classes = classes_of(documents, n)
    one = written(classes.groupBy("a").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    distinct = maybe_in(texts(documents), "doc_id", one).join(one, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("text")
    df = np.zeros(SKETCH, np.float64)
    for r in merged(written(distinct.mapInArrow(_sketch(n), "part int, segment int, counts binary"))).toLocalIterator():
        df[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    weight = np.log1p(one.count() / np.maximum(df, 1))
    return classes, level_of(weight)


_COUNTED = pa.schema([*_FIRST, *_COUNTS])


def _counted(n: int):
    """The rows of _first and those of _sketch, from one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.uint32)
        for b in batches:
            ids, strings = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in slices(strings):
                h, doc, _ = shingles(strings[lo:hi], n)
                if not len(h):
                    continue
                np.add.at(count, (h & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                k = len(first)
                none = [pa.nulls(k, t) for t in _COUNTS.types]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[first]].astype(np.int64)), pa.array(V.signed(_set_hash(h, first))), pa.array(np.diff(first, append=len(h)).astype(np.int32)), *none], schema=_COUNTED)
        if count.any():
            packed = [zlib.compress(count[i : i + SEGMENT].tobytes(), 1) for i in range(0, SKETCH, SEGMENT)]
            k = len(packed)
            none = [pa.nulls(k, t) for t in _FIRST.types]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(k, TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(packed, pa.binary())], schema=_COUNTED)

    return run


def counted(documents: DataFrame, n: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """As first_pass, with frequencies over all texts, copies too: enough where the weights are damped. One reading."""
    both = written(texts(documents).mapInArrow(_counted(n), "doc_id long, a long, n int, part int, segment int, counts binary"))
    classes = both.where("a is not null").select("doc_id", "a", "n")
    df = np.zeros(SKETCH, np.float64)
    for r in merged(both.where("counts is not null").select("part", "segment", "counts")).toLocalIterator():
        df[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return classes, level_of(np.log1p(classes.count() / np.maximum(df, 1)))


def classes_of(documents: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, a (the hash of the set of shingles), n (its size) of each document with a shingle."""
    return written(texts(documents).mapInArrow(_first(n), "doc_id long, a long, n int"))


def level_of(weight: np.ndarray) -> np.ndarray:
    """The level of a weight."""
    return np.clip(np.rint((np.log(np.maximum(weight, 1e-9)) - LOWEST) * 4), 0, LEVELS - 1).astype(np.uint8)


def level(h: np.ndarray, times: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The weight level of shingles that occur so many times in their document."""
    return np.minimum(LEVELS - 1, levels[(h & np.uint64(SKETCH - 1)).astype(np.int64)] + np.rint(4 * np.log(times)).astype(np.int64))


def weights(levels: np.ndarray) -> np.ndarray:
    return np.exp(levels / 4 + LOWEST)


# --- pass 2: samples and bands


@functools.cache
def variates(damped: bool = False) -> np.ndarray:
    """By weight level, pool row and sample: ln a of improved consistent weighted sampling, as an integer of the same order.

    Damped, the levels are spread over a range of RANGE, and there are samples for PLAIN_BANDS.
    """
    rng, m = np.random.default_rng(5), PLAIN_BANDS * ROWS if damped else SAMPLES
    r, c = rng.gamma(2, 1, (2, POOL, m))
    beta = rng.random((POOL, m))
    out = np.empty((LEVELS, POOL, m), np.uint32)
    for k in range(LEVELS):
        t = np.floor((k * np.log(RANGE) / (LEVELS - 1) if damped else k / 4 + LOWEST) / r + beta)
        a = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
        out[k] = np.where(a >> 31, ~a, a | np.uint32(1 << 31))
    return out.reshape(LEVELS * POOL, m)


def _least(first: np.ndarray, size: int, rows, out: np.ndarray, block: int = 512) -> np.ndarray:
    """out, with the column-wise least of the rows of each text that begins at first; rows(lo, hi) makes a block of them."""
    ends = np.append(first[1:], size)
    for i, (start, end) in enumerate(zip(first.tolist(), ends.tolist())):
        out[i] = rows(start, min(end, start + block)).min(axis=0)  # much faster than reduceat
        for lo in range(start + block, end, block):
            np.minimum(out[i], rows(lo, min(end, lo + block)).min(axis=0), out=out[i])
    return out


def samples(h: np.ndarray, first: np.ndarray, levels: np.ndarray, damped: bool = False) -> np.ndarray:
    """The samples of each text whose shingles begin at first: the least (ln a, shingle) for each draw of the variates."""
    table = variates(damped)
    out = np.empty((len(first), table.shape[1]), np.uint64)
    row = levels.astype(np.int64) * POOL + (h >> np.uint64(52)).astype(np.int64)
    low = (h & np.uint64(0xFFFFFFFF))[:, None]

    def rows(lo: int, hi: int) -> np.ndarray:
        x = table[row[lo:hi]].astype(np.uint64)
        x <<= np.uint64(32)
        x |= low[lo:hi]
        return x

    return _least(first, len(h), rows, out)


@functools.cache
def multipliers() -> np.ndarray:
    """Odd numbers: a shingle's hash times each of them is its place in the order of that sample."""
    return np.random.default_rng(5).integers(0, 2**63, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def plain_samples(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As samples, of shingles that all weigh the same: two sets agree in a sample with their plain Jaccard similarity."""
    by = multipliers()
    return _least(first, len(h), lambda lo, hi: h[lo:hi, None] * by, np.empty((len(first), SAMPLES), np.uint64))


@functools.cache
def plain_multipliers() -> np.ndarray:
    return np.random.default_rng(6).integers(0, 2**31, PLAIN_KEPT).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def plain_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: two bits of each of PLAIN_KEPT samples by plain similarity, 32 in a number."""
    by, low = plain_multipliers(), (V.mix(h) >> np.uint64(32)).astype(np.uint32)
    least = _least(first, len(h), lambda lo, hi: low[lo:hi, None] * by, np.empty((len(first), PLAIN_KEPT), np.uint32))
    bits = ((least >> np.uint32(12)) & np.uint32(3)).astype(np.uint64).reshape(len(first), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return V.signed(np.bitwise_or.reduce(bits, axis=2))


def band_keys(s: np.ndarray) -> np.ndarray:
    """By text and band: the hash of the band's number and samples."""
    with np.errstate(over="ignore"):
        bands = s.shape[1] // ROWS
        key = np.zeros((len(s), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
        for k in range(ROWS):
            key = V.mix(key * np.uint64(0xD6E8FEB86659FD93) + s[:, k::ROWS])
    return key


def kept_bits(s: np.ndarray) -> np.ndarray:
    """By text: four bits of each of KEPT samples, sixteen in a number."""
    bits = (V.mix(s[:, :KEPT]) & np.uint64(15)).reshape(len(s), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return V.signed(np.bitwise_or.reduce(bits, axis=2))


#: Columns with the kept samples; by weighted similarity the last ones are empty.
PART = [f"s{i}" for i in range(max(KEPT // 16, PLAIN_KEPT // 32))]


def alike(plain: float = 0.0):
    """Do enough of the kept samples agree with those in the columns whose names have t before, and do the sizes n and tn of the sets allow this plain similarity?

    Without a plain similarity, samples of four bits by weighted similarity are held against each other, AGREE of KEPT; else
    those of two bits, PLAIN_AGREE of PLAIN_KEPT.
    """
    agree = F.lit(PLAIN_KEPT if plain else KEPT)
    for c in PART if plain else PART[: KEPT // 16]:
        x = F.col(c).bitwiseXOR(F.col(f"t{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        if not plain:
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        agree = agree - F.bit_count(x.bitwiseAND(F.lit(0x5555555555555555 if plain else 0x1111111111111111)))
    return (F.least("n", "tn") >= plain * F.greatest("n", "tn") - 1e-6) & (agree >= (PLAIN_AGREE if plain else AGREE))


_BANDS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), *((c, pa.int64()) for c in PART)])
BAND_ROWS = ", ".join(f"{f.name} long" for f in _BANDS)


def _bands(n: int, levels, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = b.column(0).to_pylist()
            for lo, hi in slices(strings):
                h, doc, times = shingles(strings[lo:hi], n)
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                s = samples(h, first, level(h, times, levels.value), damped=plain)
                a, key, bits, k = _set_hash(h, first), band_keys(s), plain_bits(h, first) if plain else kept_bits(s), len(first)
                none = pa.nulls(key.size, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(V.signed(key.ravel())), pa.array(np.repeat(V.signed(a), key.shape[1])), none, *(none for _ in PART)], schema=_BANDS)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(V.signed(a)), pa.array(np.diff(first, append=len(h))), *(pa.array(np.ascontiguousarray(bits[:, i])) if i < bits.shape[1] else pa.nulls(k, pa.int64()) for i in range(len(PART)))], schema=_BANDS)

    return run


def candidates(documents: DataFrame, levels: np.ndarray, n: int = SHINGLE, plain: float = 0.0) -> DataFrame:
    """Pairs a < b of classes that share a band and agree in enough of their kept samples; by plain similarity if that has a bound.

    No group is collected, and a key of copies alone makes no pair. Pairs are judged where they meet: templates make many
    that are unlike, and those are never shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(levels)
    both = written(texts(documents).select("text").mapInArrow(_bands(n, shared, plain > 0), BAND_ROWS))
    rows = both.where("key is not null").select("key", "a")
    several = written(rows.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").select("key"))
    done(spark=documents.sparkSession)
    kept = written(maybe_in(rows, "key", several).join(several, "key", "left_semi").distinct())
    done(several)
    sample = both.where("key is null").select("a", "n", *PART).dropDuplicates(["a"])
    signed = kept.join(sample, "a")
    other = signed.select("key", F.col("a").alias("b"), *(F.col(c).alias(f"t{c}") for c in ["n", *PART]))
    found = written(signed.join(other, "key").where((F.col("a") < F.col("b")) & alike(plain)).select("a", "b").distinct())
    done(both, kept)
    return found


# --- verification

_SETS = pa.schema([("a", pa.int64()), ("set", pa.binary())])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, strings = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi in slices(strings):
                h, doc, times = shingles(strings[lo:hi], n)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                both = np.stack(((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(times, 2**32 - 1).astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(a[lo:hi]), pa.array([np.ascontiguousarray(both[:, at[i] : at[i + 1]][:, np.argsort(both[0, at[i] : at[i + 1]], kind="stable")]).tobytes() for i in range(hi - lo)], pa.binary())], schema=_SETS)

    return run


def similarity(x: np.ndarray, y: np.ndarray, levels: np.ndarray | None) -> tuple[float, float]:
    """(plain, weighted) Jaccard similarity of two sets: rows of shingles (low 32 bits, sorted) and occurrences.

    Without levels all shingles weigh the same.
    """
    common, i, j = np.intersect1d(x[0], y[0], return_indices=True)
    plain = len(common) / max(1, x.shape[1] + y.shape[1] - len(common))
    if levels is None:
        return plain, plain
    p, q = (weights(level(s[0].astype(np.uint64), np.maximum(1, s[1]), levels)) for s in (x, y))
    least = np.minimum(p[i], q[j]).sum()
    return plain, float(least / max(1e-12, p.sum() + q.sum() - least))


def verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame, levels: np.ndarray | None, n: int = SHINGLE) -> DataFrame:
    """a, b, plain, weighted: the similarities of each candidate pair of classes, from the whole sets of both."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)
    wanted = written(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct())
    one = written(classes.join(wanted, "a", "left_semi").groupBy("a").agg(F.min("doc_id").alias("doc_id")))
    found = maybe_in(texts(documents), "doc_id", one.select("doc_id")).join(one, "doc_id").select("a", "text")
    sets = written(found.mapInArrow(_sets(n), "a long, set binary").dropDuplicates(["a"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [similarity(np.frombuffer(x, np.uint32).reshape(2, -1), np.frombuffer(y, np.uint32).reshape(2, -1), shared.value) for x, y in zip(f["s"], f["t"])]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "plain": [x for x, _ in s], "weighted": [y for _, y in s]})

    both = pairs.join(sets.withColumnRenamed("set", "s"), "a").join(sets.select(F.col("a").alias("b"), F.col("set").alias("t")), "b")
    out = written(both.select("a", "b", "s", "t").mapInPandas(run, "a long, b long, plain double, weighted double"))
    done(wanted, one, sets)
    return out


def links(documents: DataFrame, n: int = SHINGLE, plain: float = 0.0, weighted: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc_id, a by document, and the pairs a < b of classes with at least these similarities.

    Candidates are by weighted similarity if that has a bound, else by plain, with damped weights. Texts with fewer than n
    words have no class. A document whose text differs from another's in nothing but what lies between words is of its class.
    """
    classes, levels = first_pass(documents, n) if weighted else counted(documents, n)
    classes = classes.dropDuplicates(["doc_id", "a"])
    found = verified(documents, classes, candidates(documents, levels, n, 0.0 if weighted else plain), levels if weighted else None, n)
    return classes, found.where((F.col("plain") >= plain) & (F.col("weighted") >= weighted))


def pairs(documents: DataFrame, n: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id_a < doc_id_b of documents of different copy groups whose shingle sets have this plain similarity.

    Copies are compared once, as a class; only the result names every member.
    """
    classes, linked = links(documents, n, plain=least)
    groups = copies.copies(documents)
    member = written(classes.join(groups, "doc_id", "left").select("a", "doc_id", F.coalesce("group_id", "doc_id").alias("g")))
    across = linked.select("a", "b")
    left = member.select("a", F.col("doc_id").alias("i"), F.col("g").alias("gi"))
    right = member.select(F.col("a").alias("b"), F.col("doc_id").alias("j"), F.col("g").alias("gj"))
    between = across.join(left, "a").join(right, "b")
    mixed = member.groupBy("a").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("a")
    inside = left.join(mixed, "a", "left_semi").join(right.withColumnRenamed("b", "a"), "a").where("i < j")
    both = between.select("i", "j", "gi", "gj").unionByName(inside.select("i", "j", "gi", "gj")).where("gi <> gj")
    return both.select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()


def groups(documents: DataFrame, n: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, group_id, n_links of each document with a shingle.

    class_id is the smallest doc_id with the same shingle set, group_id that of all documents connected by links of this
    weighted similarity, n_links the number of other classes linked with the document's.
    """
    classes, linked = links(documents, n, weighted=least)
    linked = written(linked.select("a", "b"))
    part = components(linked).select(F.col("node").alias("a"), "component")
    degree = linked.select("a").unionByName(linked.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    named = written(classes.groupBy("a").agg(F.min("doc_id").alias("class_id")).join(part, "a", "left").join(degree, "a", "left").select("a", "class_id", F.coalesce("component", "a").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    top = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return classes.select("doc_id", "a").join(named.join(top, "component"), "a").select("doc_id", "class_id", "group_id", "n_links")
