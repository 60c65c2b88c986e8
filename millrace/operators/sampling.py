"""Sampling from logits, as relations (vec_id, token_id, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def logits(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.select("vec_id", F.posexplode(column).alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


def softmax(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    w = W.partitionBy("vec_id")
    z = rows.withColumn("z", F.col("logit") / temperature)
    z = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return z.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("z", "e")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The rows with one of the k largest logits; ties with the kth stay."""
    ranked = rows.withColumn("r", F.rank().over(W.partitionBy("vec_id").orderBy(F.desc("logit"))))
    return ranked.where(F.col("r") <= k).drop("r")


def top_p(rows: DataFrame, p: float) -> DataFrame:
    """The most likely rows until those before reach p."""
    w = W.partitionBy("vec_id").orderBy(F.desc("logit"), "token_id").rowsBetween(W.unboundedPreceding, -1)
    return softmax(rows).withColumn("before", F.coalesce(F.sum("p").over(w), F.lit(0.0))).where(F.col("before") < p).drop("before")


def greedy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vec_id").agg(F.max(F.struct("logit", (-F.col("token_id")).alias("t"))).alias("m")).select("vec_id", (-F.col("m.t")).alias("token_id"), F.col("m.logit").alias("logit"))


def penalise(rows: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of seen (vec_id, token_id) tokens, divided if positive, multiplied if not."""
    flagged = rows.join(seen.select("vec_id", "token_id", F.lit(True).alias("s")).distinct(), ["vec_id", "token_id"], "left")
    return flagged.withColumn("logit", F.when(F.col("s") & (F.col("logit") > 0), F.col("logit") / penalty).when(F.col("s"), F.col("logit") * penalty).otherwise(F.col("logit"))).drop("s")


def cross_entropy(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """vec_id, loss: minus log softmax of the target (vec_id, target, mask)."""
    w = W.partitionBy("vec_id")
    z = rows.withColumn("top", F.max("logit").over(w))
    z = z.withColumn("lse", F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(w)) + F.col("top"))
    return z.join(targets, "vec_id").where(F.col("token_id") == F.col("target")).select("vec_id", "mask", (F.col("lse") - F.col("logit")).alias("loss"))


def masked_mean(losses: DataFrame) -> DataFrame:
    return losses.agg((F.sum(F.col("loss") * F.col("mask")) / F.greatest(F.lit(1), F.sum("mask"))).alias("loss"), F.sum("mask").alias("scored"))
