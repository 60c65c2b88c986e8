"""Run logs of JSON lines: reading them as they are, summaries, windows, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formats import perplexity

WINDOW = 50


def field(name: str, kind: str) -> Column:
    """A number of the record in v, null where it's another type (a boolean, a string) or absent."""
    raw = F.expr(f"schema_of_variant(try_variant_get(v, '$.{name}', 'variant'))")
    ok = raw.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$" if kind == "long" else "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(ok, F.expr(f"try_variant_get(v, '$.{name}', '{kind}')"))


def parsed(lines: DataFrame) -> DataFrame:
    """lines (run_id, line_no, line), each once however often it was delivered, with v, the object on it, or null."""
    once = lines.where("line is not null").select("run_id", "line_no", "line").dropDuplicates(["run_id", "line_no", "line"])
    v = F.expr("try_parse_json(line)")
    return once.withColumn("v", F.when(F.expr("schema_of_variant(try_parse_json(line))").startswith("OBJECT"), v))


def records(lines: DataFrame) -> DataFrame:
    """The typed fields of every object."""
    p = parsed(lines).where("v is not null")
    return p.select(
        "run_id",
        "line_no",
        F.expr("try_variant_get(v, '$.event', 'string')").alias("event"),
        field("step", "long").alias("step"),
        field("time", "double").alias("time"),
        field("loss", "double").alias("loss"),
        field("val_loss", "double").alias("val_loss"),
        field("tokens", "long").alias("tokens"),
        field("tokens_per_second", "double").alias("tokens_per_second"),
        field("elapsed", "double").alias("elapsed"),
        F.expr("try_variant_get(v, '$.path', 'string')").alias("path"),
        F.expr("try_variant_get(v, '$.is_best', 'boolean')").alias("is_best"),
    )


def torn(lines: DataFrame) -> DataFrame:
    """run_id, lines, objects, unreadable of the lines as delivered; nulls are unreadable."""
    ok = F.coalesce(F.expr("schema_of_variant(try_parse_json(line))").startswith("OBJECT"), F.lit(False))
    return lines.groupBy("run_id").agg(F.count("*").alias("lines"), F.count_if(ok).alias("objects"), F.count_if(~ok).alias("unreadable"))


def summary(recs: DataFrame) -> DataFrame:
    """One row a run: counts, first and last loss, best validation loss (the first of equal ones), most tokens and seconds."""
    train = (F.col("event") == "train") & F.col("loss").isNotNull()
    evals = (F.col("event") == "eval") & F.col("val_loss").isNotNull()
    at = lambda c, cond: F.when(cond, F.struct("line_no", c))
    best = F.min(F.when(evals, F.struct("val_loss", "line_no", "step")))
    return recs.groupBy("run_id").agg(
        F.count_if(train).alias("train_records"),
        F.count_if(evals).alias("eval_records"),
        F.min(at("loss", train))["loss"].alias("first_loss"),
        F.max(at("loss", train))["loss"].alias("final_loss"),
        F.max(at("step", train))["step"].alias("steps"),
        best["val_loss"].alias("best_val_loss"),
        best["step"].alias("best_val_step"),
        F.max(at("val_loss", evals))["val_loss"].alias("final_val_loss"),
        F.max(F.when(train, F.col("tokens"))).alias("tokens_seen"),
        F.max("elapsed").alias("elapsed_seconds"),
    ).withColumn("best_val_perplexity", F.when(F.col("best_val_loss").isNotNull(), perplexity(F.col("best_val_loss"))))


def throughput(recs: DataFrame, window: int = WINDOW) -> DataFrame:
    """run_id, line_no, rate: tokens by seconds over the last records of the run, seconds at least a billionth each."""
    w = W.partitionBy("run_id").orderBy("line_no")
    t = recs.where("event = 'train' and tokens is not null and elapsed is not null")
    t = t.withColumn("dt", F.greatest(F.lit(1e-9), F.col("elapsed") - F.coalesce(F.lag("elapsed").over(w), F.lit(0.0)))).withColumn("dn", F.col("tokens") - F.coalesce(F.lag("tokens").over(w), F.lit(0)))
    last = w.rowsBetween(1 - window, W.currentRow)
    return t.select("run_id", "line_no", F.sum("dn").over(last).alias("window_tokens"), F.round(F.sum("dt").over(last), 6).alias("window_seconds"))


def best_so_far(recs: DataFrame) -> DataFrame:
    """run_id, line_no, step, val_loss, improved: strictly below all before."""
    w = W.partitionBy("run_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    e = recs.where("event = 'eval' and val_loss is not null")
    before = F.min("val_loss").over(w)
    return e.select("run_id", "line_no", "step", "val_loss", (before.isNull() | (F.col("val_loss") < before)).alias("improved"))


def weighted_loss(recs: DataFrame) -> DataFrame:
    """Mean loss of a run weighted by the tokens since the record before; records without any are skipped."""
    w = W.partitionBy("run_id").orderBy("line_no")
    t = recs.where("event = 'train' and loss is not null and tokens is not null").withColumn("n", F.col("tokens") - F.coalesce(F.lag("tokens").over(w), F.lit(0)))
    out = t.where("n > 0").groupBy("run_id").agg(F.sum("n").alias("tokens"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return out.withColumn("perplexity", F.exp("loss")).withColumn("bits_per_token", F.col("loss") / F.log(F.lit(2.0)))


def checkpoints(recs: DataFrame) -> DataFrame:
    """run_id, step (from the name), name, is_best of the checkpoints logged, each once."""
    name = F.element_at(F.split("path", "/"), -1)
    c = recs.where("event = 'checkpoint' and path is not null").select("run_id", name.alias("name"), F.coalesce("is_best", F.lit(False)).alias("is_best"), "line_no")
    c = c.groupBy("run_id", "name").agg(F.max("is_best").alias("is_best"), F.max("line_no").alias("line_no"))
    return c.withColumn("step", F.regexp_extract("name", r"(\d+)$", 1).cast("long")).where("step is not null")


def pointers(saved: DataFrame) -> DataFrame:
    """run_id, latest, best: the newest, and the last that was flagged best, or the first of all where none is."""
    return saved.groupBy("run_id").agg(F.max_by("name", "step").alias("latest"), F.coalesce(F.max_by("name", F.when(F.col("is_best"), F.col("line_no"))), F.min_by("name", "line_no")).alias("best"))


def pruned(saved: DataFrame, keep: int = 3) -> DataFrame:
    """run_id, name, removed: of those neither newest nor pointed to, the oldest max(0, total - keep); keep 0 keeps all."""
    p = saved.join(pointers(saved), "run_id")
    protected = (F.col("name") == F.col("latest")) | (F.col("name") == F.col("best"))
    p = p.withColumn("total", F.count("*").over(W.partitionBy("run_id"))).withColumn("protected", protected)
    p = p.withColumn("k", F.row_number().over(W.partitionBy("run_id", "protected").orderBy("step")))
    gone = (F.lit(keep) > 0) & ~F.col("protected") & (F.col("k") <= F.col("total") - keep)
    return p.select("run_id", "name", "step", gone.alias("removed"))
