"""Parameters, memory, schedules, budgets and the ladder of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The shapes that are tried, smallest first: name, layers, heads, width, sequence length.
PRESETS = (("tiny", 4, 4, 256, 256), ("small", 6, 6, 384, 512), ("medium", 8, 8, 512, 512), ("large", 12, 12, 768, 1024))
MIN_STEPS, MAX_STEPS, TRAIN_MAX_STEPS = 50, 100_000, 20_000
EPOCHS_BEFORE_MEMORISING, TOKENS_PER_PARAMETER, LOW_TOKENS_PER_PARAMETER = 4.0, 20.0, 5.0
DEFAULT_EPOCHS = 3.0
PERSISTENT_BYTES, ACTIVATION_SLOTS = 16, 12
SKIP_MULTIPLE, COLLAPSE = 4.0, 0.35


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRESETS)), "rung int, p struct<name:string,n_layer:int,n_head:int,d_model:int,seq_len:int>").select("rung", "p.*")


def parameters(shapes: DataFrame) -> DataFrame:
    """shapes (n_layer, n_head, d_model, seq_len, vocab_size) with where their parameters are; embeddings are tied."""
    d, n, v = (F.col(c).cast("long") for c in ("d_model", "n_layer", "vocab_size"))
    ffn = (F.floor((F.floor(d * 8 / 3) + 63) / 64) * 64).cast("long")
    out = shapes.withColumn("ffn_dim", ffn)
    out = out.withColumns({"embedding": v * d, "attention": n * 4 * d * d, "ffn": n * 3 * d * F.col("ffn_dim"), "norm": n * 2 * d + d})
    return out.withColumn("parameters", F.col("embedding") + F.col("attention") + F.col("ffn") + F.col("norm"))


def peak_bytes(shapes: DataFrame, batch: Column, activation_bytes: int = 2) -> DataFrame:
    """A rough upper estimate of memory in training, and floating-point operations a token."""
    tokens = batch.cast("long") * F.col("seq_len")
    peak = F.col("parameters") * PERSISTENT_BYTES + tokens * F.col("d_model") * F.col("n_layer") * ACTIVATION_SLOTS * activation_bytes + tokens * F.col("vocab_size") * 8
    flops = 6.0 * F.col("parameters") + 12.0 * F.col("n_layer") * F.col("seq_len") * F.col("d_model")
    return shapes.withColumns({"peak_bytes": peak.cast("long"), "flops_per_token": flops})


def schedule(spark: SparkSession, steps: int, peak: float, warmup: int, floor: float = 0.0, kind: str = "cosine") -> DataFrame:
    """step, lr: linear warm-up, then cosine, linear or constant down to the floor."""
    s = F.col("step")
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - warmup) / max(1, steps - warmup)))
    factor = {"cosine": 0.5 * (1.0 + F.cos(math.pi * done)), "linear": 1.0 - done, "constant": F.lit(1.0)}[kind]
    low = peak if kind == "constant" else floor
    return spark.range(steps).select(F.col("id").alias("step")).withColumn("lr", F.when(s < warmup, F.lit(peak) * (s + 1) / max(1, warmup)).otherwise(low + (peak - low) * factor))


def budget(runs: DataFrame) -> DataFrame:
    """runs (train_tokens, val_tokens, parameters, tokens_per_step, steps) with epochs, ratios and what to warn of."""
    t, p = F.col("train_tokens"), F.col("parameters")
    seen = F.col("steps") * F.col("tokens_per_step")
    epochs = F.when(t <= 0, F.lit(0.0)).otherwise(seen / t)
    per = F.when(p <= 0, F.lit(0.0)).otherwise(t / p)
    out = runs.withColumns({"epochs": epochs, "tokens_per_parameter": per, "steps_per_epoch": F.when(F.col("tokens_per_step") <= 0, F.lit(0.0)).otherwise(t / F.col("tokens_per_step")), "tokens_never_read": F.greatest(F.lit(0).cast("long"), t - seen)})
    return out.withColumns({"will_memorise": F.col("epochs") > EPOCHS_BEFORE_MEMORISING, "data_limited": F.col("tokens_per_parameter") < LOW_TOKENS_PER_PARAMETER, "leaves_unread": (t > 0) & (F.col("epochs") < 1.0), "no_validation": F.col("val_tokens") == 0})


def derived_steps(train_tokens: Column, params: Column, tokens_per_step: Column) -> Column:
    least = F.least(EPOCHS_BEFORE_MEMORISING * train_tokens, TOKENS_PER_PARAMETER * params)
    return F.greatest(F.lit(MIN_STEPS), F.least(F.lit(MAX_STEPS), F.floor(least / tokens_per_step))).cast("long")


def default_steps(train_tokens: Column, tokens_per_step: Column) -> Column:
    """Steps of a run that names none: DEFAULT_EPOCHS over the training tokens, within bounds."""
    steps = F.floor(DEFAULT_EPOCHS * F.greatest(F.lit(1), train_tokens) / tokens_per_step)
    return F.greatest(F.lit(MIN_STEPS), F.least(F.lit(TRAIN_MAX_STEPS), steps)).cast("long")


def windows(tokens: Column, seq_len: Column | int) -> Column:
    """How many windows of seq_len + 1 tokens fit, one window's length kept for the shift of epochs."""
    return F.greatest(F.lit(0).cast("long"), F.floor((tokens - seq_len) / (F.lit(0) + seq_len + 1)).cast("long"))


def ladder(measured: DataFrame, memory: int) -> DataFrame:
    """measured (rung, name, peak_bytes, flops_per_token, rate) with verdict, and chosen: the last rung before the first that failed.

    A rung fails if its estimate is far above the memory, its peak is above it, or its rate of operations falls under
    COLLAPSE of the best rate before.
    """
    w = W.orderBy("rung").rowsBetween(W.unboundedPreceding, -1)  # a handful of rungs
    flops = F.col("flops_per_token") * F.col("rate")
    best = F.max(flops).over(w)
    verdict = F.when(F.col("peak_bytes") > SKIP_MULTIPLE * memory, "skipped").when(F.col("peak_bytes") > memory, "too_large").when(flops < COLLAPSE * best, "collapsed").otherwise("ok")
    out = measured.withColumn("verdict", verdict)
    failed = F.max(F.when(F.col("verdict") != "ok", 1).otherwise(0)).over(W.orderBy("rung").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn("reached", failed == 0)
    return out.withColumn("chosen", F.col("reached") & ~F.coalesce(F.lead("reached").over(W.orderBy("rung")), F.lit(False)))


def recommended_lr(d_model: Column) -> Column:
    """3e-4 at a width of 512, by the root of the width, to three significant digits."""
    raw = 3e-4 * F.sqrt(512.0 / d_model)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)) - 2)
    return F.rint(raw / scale) * scale
