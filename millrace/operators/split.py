"""Training and validation sides by a hash of the content, so that copies never part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction_sha(text: Column, seed: int) -> Column:
    """The fraction in [0, 1) that SQL can compute, too: 48 bits of SHA-256 of seed and text."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fraction_blake(seed: int):
    """A pandas UDF: 64 bits of BLAKE2b keyed by the seed, as a part of 2^64."""
    key = seed.to_bytes(8, "little", signed=False)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, key=key).digest(), "big") / 2.0**64)

    return run


def side(fraction: Column, val_fraction: float | Column) -> Column:
    """val strictly below the fraction, train from there on."""
    return F.when(fraction < val_fraction, "val").when(fraction.isNotNull(), "train")


def summary(sided: DataFrame) -> DataFrame:
    """split (with a row 'total'), documents, chars."""
    rolled = sided.where("split is not null").rollup("split").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.grouping("split").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("split")).alias("split"), "documents", F.coalesce("chars", F.lit(0)).alias("chars"))


def suggestions(fractions: DataFrame, column: str = "fraction", by: tuple[str, ...] = ()) -> DataFrame:
    """The lowest two-place fraction that gives a validation document, and the highest that keeps a training one."""
    low, high = (F.floor(F.min(column) * 100) + 1) / 100, F.floor(F.max(column) * 100) / 100
    return fractions.groupBy(*by).agg(low.alias("low"), high.alias("high")).select(*by, F.when(F.col("low") < 0.5, F.col("low")).alias("val_fraction_to_raise"), F.when(F.col("high") >= 0.01, F.col("high")).alias("val_fraction_to_keep"))
