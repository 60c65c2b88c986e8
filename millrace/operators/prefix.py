"""Running sums over a whole table without pulling it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that a task sums at most, but for rows of equal order; tables of up to FEW times as many have one level of buckets.
ROWS, FEW, BUCKETS = 250_000, 16, 4096


def exclusive_sums(df: DataFrame, order: str, values: dict[str, str], by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each output: column of values, the sum over the rows before it in the given order (of its group).

    Rows fall into buckets of the order column (a number), by equal parts of its range; in large tables a bucket with many
    rows is parted once more by its own range, so that a few ids far from the others leave no bucket large. A window over
    the few sums of buckets gives where each begins, a window within each bucket the rest. Rows of equal order are taken
    in that of the columns in ties. Null values count as 0, rows with null order come first.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // min(BUCKETS, max(FEW, n // ROWS))))
    keyed = df.withColumn("_b", F.coalesce(F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long"))
    if n > FEW * ROWS:
        parts = F.ceil(F.count("*") / ROWS)
        span = F.greatest(F.lit(1), F.ceil((F.max(order) - F.min(order) + 1) / parts))
        inner_range = keyed.groupBy("_b").agg(F.min(order).alias("_from"), span.alias("_width"))  # BUCKETS rows
        keyed = keyed.join(F.broadcast(inner_range), "_b").withColumn("_c", F.coalesce(F.floor((F.col(order) - F.col("_from")) / F.col("_width")), F.lit(0)).cast("long")).drop("_from", "_width")
    else:
        keyed = keyed.withColumn("_c", F.lit(0).cast("long"))
    per = keyed.groupBy(*by, "_b", "_c").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_s_{o}") for o, c in values.items()))
    w = W.partitionBy(*by).orderBy("_b", "_c").rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*by, "_b", "_c", *(F.coalesce(F.sum(f"_s_{o}").over(w), F.lit(0)).alias(f"_a_{o}") for o in values))
    inner = W.partitionBy(*by, "_b", "_c").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    out = keyed.join(starts, [*by, "_b", "_c"])
    for o, c in values.items():
        out = out.withColumn(o, F.col(f"_a_{o}") + F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(inner), F.lit(0)))
    return out.drop("_b", "_c", *(f"_a_{o}" for o in values))
