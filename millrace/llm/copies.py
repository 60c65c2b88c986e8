"""Problem 4: records that differ only in formatting.

Two 128-bit keys stand for a text: one of its letters and digits in order (case-folded), and, for labelled records
(one field per line, or a JSON object), one of its set of fields. Every task keeps two register-blocked Bloom filters
of the keys it has seen, once and repeatedly; merged by block over all tasks they tell which keys may repeat anywhere.
Only those keys are shuffled and grouped exactly; all other rows are single records and are never moved. Keys are written
in the order of their hash, so that where several rounds of filters are needed each reads its own range only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .common import ROW_WORDS, filter_rows, slices, table_path, texts, written

#: Keys a 64-bit filter block holds on average: 16 bits a key.
KEYS_PER_BLOCK = 4
#: Blocks of one round's filter, 32 MB where it is broadcast: 16 million keys.
ROUND_BLOCKS = 1 << 22
#: Labels of turns; a conversation is no labelled record, its order counts.
ROLES = {"user", "assistant", "system"}

_OTHER = re.compile(r"[\W_]+")
_FIELD = re.compile(r"^\s*([^:\n]+?)\s*:(?!//)(.*)$")

KEYS = T.StructType().add("doc_id", "long").add("a", "long").add("b", "long").add("ra", "long").add("rb", "long")
_KEYS = pa.schema([(f.name, pa.int64()) for f in KEYS])


def canonical(text: str) -> str:
    """Letters and digits only, case-folded."""
    return _OTHER.sub("", text.casefold())


class _Object(list):
    """The pairs of a JSON object."""


def _flat(value) -> str:
    """Objects within a value have their fields in sorted order; the order of an array counts."""
    if isinstance(value, _Object):
        return "".join(k + v for k, v in sorted((canonical(k), canonical(_flat(v))) for k, v in value))
    if isinstance(value, list):
        return "".join(map(_flat, value))
    return "" if value is None else str(value)


def fields(text: str) -> list[tuple[str, str]] | None:
    """The canonical fields of a labelled record in sorted order; None for other texts.

    A record is a JSON object, or at least two lines of the form ``name: value`` with different names, blank lines
    aside. Values of a JSON object are compared after decoding, objects within them in any order.
    """
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            pairs = json.loads(body, object_pairs_hook=_Object, parse_float=str, parse_int=str, parse_constant=str)
        except (ValueError, RecursionError):
            return None
        found = [(canonical(k), canonical(_flat(v))) for k, v in pairs]
        return sorted(found) if len(found) > 1 else None
    if "\n" not in body and "\r" not in body or ":" not in body:
        return None
    found = []
    for line in body.splitlines():
        if not line.strip():
            continue
        m = _FIELD.match(line)
        if not m or not (name := canonical(m[1])) or name.isdigit():
            return None
        found.append((name, canonical(m[2])))
    names = {n for n, _ in found}
    return sorted(found) if len(found) > 1 and len(names) == len(found) and not names <= ROLES else None


def _two(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string of letters and digits."""
    c, at = V.codes(strings)
    a = V.range_hashes(c, at[:-1], at[1:] - 1)
    b = V.range_hashes(V.mix(c.astype(np.uint64) + np.uint64(77)), at[:-1], at[1:] - 1)
    return a, b


def _plain(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same hashes of the letters and digits of each text, and how many there are."""
    c, at = V.codes([s.casefold() for s in strings])
    keep = V.alnum()[c]
    till = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=till[1:])
    c, start, end = c[keep], till[at[:-1]], till[at[1:]]
    return V.range_hashes(c, start, end), V.range_hashes(V.mix(c.astype(np.uint64) + np.uint64(77)), start, end), end - start


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, strings = b.column(0), b.column(1).to_pylist()
        for lo, hi in slices(strings):
            part = strings[lo:hi]
            a, z, n = _plain(part)
            records = [(i, f) for i, s in enumerate(part) if (f := fields(s))]
            ra, rb = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            has = np.zeros(len(part), bool)
            if records:
                at = np.array([i for i, _ in records])
                x, y = _two(["\x1e".join(f"{k}\x1f{v}" for k, v in f) for _, f in records])
                ra[at], rb[at], has[at] = V.signed(x), V.signed(y), True
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(V.signed(a)), pa.array(V.signed(z)), pa.array(ra, mask=~has), pa.array(rb, mask=~has)], schema=_KEYS).filter(keep)


def keys(documents: DataFrame) -> DataFrame:
    """doc_id, the key (a, b) of the letters and digits, and the key (ra, rb) of the fields of labelled records.

    Texts that are null or have neither letters nor digits have no row. Repeated rows have a row each.
    """
    return texts(documents).mapInArrow(_keys, KEYS)


def _masks(h: np.ndarray) -> np.ndarray:
    """Three bits of a block for each key, from its second hash."""
    bit = lambda k: np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return bit(0) | bit(1) | bit(2)


_FILTERS = pa.schema([("block", pa.int64()), ("once", pa.int64()), ("again", pa.int64())])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two filters of one task, a row for each block that it touched."""
    block, mask = [], []
    for b in batches:
        block.append(b.column(0).to_numpy(zero_copy_only=False))
        mask.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, block)) >= 2_000_000:
            yield _filter(np.concatenate(block), np.concatenate(mask))
            block, mask = [], []
    if block:
        yield _filter(np.concatenate(block), np.concatenate(mask))


def _filter(block: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    mask = _masks(h)
    order = np.argsort(block, kind="stable")
    block, mask = block[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    if not len(first):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(0, np.int64))] * 3, schema=_FILTERS)
    again = np.zeros(len(block), np.uint64)
    seen = mask.copy()
    step = 1
    # doubling within each block's run: seen = bits of the rows up to here, again = bits that two of them have
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(block)))
    longest = int(np.diff(first, append=len(block)).max())
    while step < longest:
        same = np.zeros(len(block), bool)
        same[step:] = group[step:] == group[:-step]
        at = np.flatnonzero(same)
        before, twice = seen[at - step].copy(), again[at - step].copy()
        again[at] |= twice | (seen[at] & before)
        seen[at] |= before
        step *= 2
    last = np.concatenate((first[1:], [len(block)])) - 1
    return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(V.signed(seen[last])), pa.array(V.signed(again[last]))], schema=_FILTERS)


def _round(keyed: DataFrame, blocks: int, a: str, b: str, flag: str) -> DataFrame:
    """keyed (keys of one round) with the flag, from one filter of so many blocks."""
    mask = F.lit(0).cast("long")
    for i in range(3):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({b}, {6 * i}) & 63 as int))"))
    mine = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(4), a), F.lit(blocks)))
    partial = mine.select("block", b).mapInArrow(_filters, "block long, once long, again long")
    # bits of the rows so far, in any order: a bit that a row has too was seen by two tasks. Windows stream and spill.
    so_far = F.bit_or("once").over(W.partitionBy("block").orderBy("once").rowsBetween(W.unboundedPreceding, -1))
    both = partial.withColumn("again", F.col("again").bitwiseOR(F.coalesce(so_far, F.lit(0).cast("long")).bitwiseAND(F.col("once"))))
    words = both.groupBy("block").agg(F.bit_or("again").alias("_bits")).where("_bits <> 0").select(F.floor(F.col("block") / ROW_WORDS).cast("int").alias("_row"), F.pmod("block", F.lit(ROW_WORDS)).cast("int").alias("_word"), "_bits")
    probed = mine.withColumn("_row", F.floor(F.col("block") / ROW_WORDS).cast("int")).join(F.broadcast(filter_rows(words)), "_row", "left")
    bits = F.get("_words", F.pmod("block", F.lit(ROW_WORDS)).cast("int"))
    return probed.withColumn(flag, F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))).drop("block", "_row", "_words")


def flagged(keyed: DataFrame, a: str, b: str, flag: str) -> DataFrame:
    """keyed with a column flag: false only where the key (a, b) certainly occurs in one row.

    The merged filter of a round, which is broadcast, has at most ROUND_BLOCKS blocks whatever the number of rows. Rounds
    are ranges of a; keyed is a table whose files are sorted by a, so that each round reads its own part of it.
    """
    n = keyed.count()
    rounds = max(1, -(-n // (KEYS_PER_BLOCK * ROUND_BLOCKS)))
    blocks = max(1, -(-n // (KEYS_PER_BLOCK * rounds)))
    if rounds == 1:
        return _round(keyed, blocks, a, b, flag)
    spark, path = keyed.sparkSession, table_path(keyed.sparkSession)
    edges = [(k << 64) // rounds - (1 << 63) for k in range(rounds + 1)]
    for low, high in zip(edges, edges[1:]):  # one job each: the plan stays as small as that of one round
        out = _round(keyed.where((F.col(a) >= low) & (F.col(a) <= high - 1)), blocks, a, b, flag)
        out.write.mode("append").parquet(path)
        schema = out.schema
    return spark.read.schema(schema).parquet(path)


def grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, singles): members has doc_id, group_id, n_copies of groups of two or more; singles has doc_id.

    Labelled records are grouped by their fields; another text with the letters and digits of a labelled record joins
    its group. group_id is the smallest doc_id of the group. A row that is repeated whole counts once.
    """
    keyed = written(keys(documents).sortWithinPartitions("a"))
    rows = flagged(keyed, "a", "b", "text_again")
    labelled = flagged(written(rows.where("ra is not null").sortWithinPartitions("ra")), "ra", "rb", "fields_again")
    other = rows.where("ra is null")
    again = F.col("text_again") | F.col("fields_again")
    columns = ["doc_id", "a", "b", "ra", "rb"]
    possible = written(other.where("text_again").select(columns).unionByName(labelled.where(again).select(columns)).dropDuplicates())
    single = other.where("not text_again").select("doc_id").unionByName(labelled.where(~again).select("doc_id"))
    named = possible.where("ra is not null").groupBy("a", "b").agg(F.min(F.struct("ra", "rb")).alias("r"))
    key = (
        F.when(F.col("ra").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("ra").alias("x"), F.col("rb").alias("y")))
        .when(F.col("r").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("r.ra").alias("x"), F.col("r.rb").alias("y")))
        .otherwise(F.struct(F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y")))
    )
    exact = written(possible.join(named, ["a", "b"], "left").select("doc_id", key.alias("key")))
    groups = exact.groupBy("key").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    members = exact.join(groups, "key").select("doc_id", "group_id", "n_copies")
    return members.where("n_copies > 1"), single.unionByName(members.where("n_copies = 1").select("doc_id"))


def copies(documents: DataFrame) -> DataFrame:
    """group_id, doc_id of every member of a group of at least two documents with the same canonical content."""
    return grouped(documents)[0].select("group_id", "doc_id")


def records(documents: DataFrame) -> DataFrame:
    """One row per distinct content: group_id (its smallest doc_id) and n_copies; texts without letters and digits have none."""
    members, singles = grouped(documents)
    return members.groupBy("group_id").agg(F.count("*").alias("n_copies")).unionByName(singles.select(F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("n_copies")))
