"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow plumbing."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session without that setting (tests, one machine) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoint")  # one machine, as in tests
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables of this process, to be removed in the end.
_paths: list[str] = []


def table_path(spark: SparkSession) -> str:
    """Where to write a table in the shared folder. Tables are removed when the driver ends, or by remove()."""
    if not _paths:
        atexit.register(remove, spark)
    _paths.append(f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}")
    return _paths[-1]


def remove(spark: SparkSession) -> None:
    """Removes the tables that results so far were made from: call it when those have been used."""
    try:
        for path in _paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the tables stay
        pass
    _paths.clear()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives the loss of executors, is read column by column."""
    spark = df.sparkSession
    path = table_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def done(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Removes tables that written() returned and nothing reads any more, and has Spark remove the shuffle files of ended steps.

    Left alone, both would stay until the driver ends or happens to collect its garbage, and add up over the steps.
    """
    spark = spark or tables[0].sparkSession
    for path in (t._written for t in tables):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _paths:
            _paths.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (and the columns named) of the rows that have a text; nothing else is read."""
    return documents.select("doc_id", "text", *more).where(F.col("text").isNotNull())


def slices(strings: list[str], limit: int = 600_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of strings with about limit characters each; a longer string has a range of its own."""
    lo = size = 0
    for i, s in enumerate(strings):
        if size and size + len(s) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(s) + 1
    if lo < len(strings):
        yield lo, len(strings)


#: Words of 64 bits of a filter that is broadcast: at most 32 MB, for some 16 million keys at 16 bits each.
FILTER_WORDS = 1 << 22
#: Words in a row of such a filter.
ROW_WORDS = 64


def filter_place(words: int, *columns) -> tuple:
    """(row, word in it, mask of three bits) of a key in a filter of so many words."""
    h = F.xxhash64(F.lit(11), *columns)
    mask = F.lit(0).cast("long")
    for i in range(3):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    at = F.pmod(F.xxhash64(F.lit(12), *columns), F.lit(words))
    return F.floor(at / ROW_WORDS).cast("int"), F.pmod(at, F.lit(ROW_WORDS)).cast("int"), mask


def filter_rows(words: DataFrame) -> DataFrame:
    """_row, _words from (_row, _word, _bits): ROW_WORDS words to a row, so that a broadcast filter is hardly larger than its bits."""
    some = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    return words.groupBy("_row").agg(some.alias("_m")).select("_row", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long"))).alias("_words"))


def maybe_in(df: DataFrame, column: str, keys: DataFrame, most_words: int | None = None) -> DataFrame:
    """The rows of df whose column is among keys (one column), and few others: a Bloom semi-join without a shuffle of df.

    The filter grows with the keys up to most_words words (FILTER_WORDS if not given). Where the keys would need more,
    all rows are returned: the exact join that follows then moves them, as any join of two large tables does.
    """
    key = keys.columns[0]
    words = max(ROW_WORDS, -(-keys.count() // 4))
    if words > (FILTER_WORDS if most_words is None else most_words):
        return df
    row, word, mask = filter_place(words, F.col(key))
    bits = keys.select(row.alias("_row"), word.alias("_word"), mask.alias("_mask")).groupBy("_row", "_word").agg(F.bit_or("_mask").alias("_bits"))
    row, word, mask = filter_place(words, F.col(column))
    return df.withColumn("_row", row).join(F.broadcast(filter_rows(bits)), "_row").where(F.get("_words", word).bitwiseAND(mask) == mask).drop("_row", "_words")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b), by alternating large and small stars.

    Every round is a written table, so that lineage stays short and lost executors cost one round. Rounds grow with the
    logarithm of the longest chain, and end for certain: a round never links a node with a larger one than before.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v")))
        new = written(small.distinct())
        if not new.exceptAll(e).limit(1).count() and not e.exceptAll(new).limit(1).count():
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
