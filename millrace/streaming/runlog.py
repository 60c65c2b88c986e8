"""The run log while it is written: tail, running best, rate of the last records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runlog import WINDOW, field


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, line_no, line of Parquet files as they arrive."""
    return spark.readStream.schema("run_id string, line_no long, line string").parquet(folder)


def records(lines: DataFrame) -> DataFrame:
    """Typed fields as the batch has them; torn lines and lines that are no object are dropped, as they are counted elsewhere."""
    v = F.expr("try_parse_json(line)")
    ok = lines.withColumn("v", v).where(F.expr("schema_of_variant(v)").startswith("OBJECT"))
    event, gone = F.expr("try_variant_get(v, '$.event', 'string')"), F.expr("try_variant_get(v, '$.diverged', 'boolean')")
    return ok.select("run_id", "line_no", event.alias("event"), gone.alias("diverged"), *(field(n, t).alias(n) for n, t in (("step", "long"), ("loss", "double"), ("val_loss", "double"), ("tokens", "long"), ("elapsed", "double"))))


def best(recs: DataFrame) -> DataFrame:
    """run_id, best_val_loss and its step so far, unscored, diverged: an aggregate in update mode.

    Nothing in it counts lines, so that a line delivered twice or late changes nothing.
    """
    evals = (F.col("event") == "eval") & F.col("val_loss").isNotNull()
    first = F.min(F.when(evals, F.struct("val_loss", "line_no", "step")))
    diverged = (F.col("event") == "diverged") | ((F.col("event") == "end") & F.coalesce(F.col("diverged"), F.lit(False)))
    out = recs.groupBy("run_id").agg(first.alias("b"), F.coalesce(F.bool_or(F.col("event") == "unscored"), F.lit(False)).alias("unscored"), F.coalesce(F.bool_or(diverged), F.lit(False)).alias("diverged"))
    return out.select("run_id", F.col("b.val_loss").alias("best_val_loss"), F.col("b.step").alias("best_step"), "unscored", "diverged")


def _rate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known: dict[int, tuple[int, float]] = {}
    if state.exists:
        known = {n: (t, e) for n, t, e in zip(*state.get)}
    for f in frames:
        for r in f.itertuples():
            known.setdefault(int(r.line_no), (int(r.tokens), float(r.elapsed)))  # a line counts once
    newest = sorted(known)[-WINDOW - 1 :]  # a late line takes its place
    state.update((newest, [known[n][0] for n in newest], [known[n][1] for n in newest]))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    rows = [(0, 0.0), *(known[n] for n in newest)] if len(newest) <= WINDOW else [known[n] for n in newest]
    n = sum(b[0] - a[0] for a, b in zip(rows, rows[1:]))
    seconds = sum(max(1e-9, b[1] - a[1]) for a, b in zip(rows, rows[1:]))
    yield pd.DataFrame({"run_id": [key[0]], "line_no": [newest[-1]], "window_tokens": [n], "window_seconds": [round(seconds, 6)], "rate": [n / seconds]})


def rate(recs: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """run_id, line_no, window_tokens, window_seconds, rate of the last WINDOW records, as the batch has them: state by run.

    With idle_ms the state of a run that has been silent for so long is dropped (and time alone makes batches).
    """
    train = recs.where("event = 'train' and tokens is not null and elapsed is not null").select("run_id", "line_no", "tokens", "elapsed")
    return train.groupBy("run_id").applyInPandasWithState(lambda k, f, s: _rate(k, f, s, idle_ms), "run_id string, line_no long, window_tokens long, window_seconds double, rate double", "lines array<long>, tokens array<long>, seconds array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def appended(recs: DataFrame, folder: str, checkpoint: str):
    """The records as lines of JSON in a folder, each batch once, whatever is repeated after a failure: a running query."""
    return recs.select(F.to_json(F.struct(*(c for c in recs.columns if c != "line_no"))).alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()


def withheld(chunks: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """stream_id, text, finished of generated text (stream_id, chunk_no, text) as it may be shown: what may begin a stop
    string is held back until more comes, and nothing behind a stop is shown. State is the text held back."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ("", False)
        rows = pd.concat(list(frames)).sort_values("chunk_no")
        text, shown = held, ""
        if not done:
            text += "".join(rows["text"])
            at = [text.find(s) for s in stops]
            cut = min((k for k in at if k >= 0), default=-1)
            if cut >= 0:
                shown, held, done = text[:cut], "", True
            else:
                keep = max((k for s in stops for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
                shown, held = text[: len(text) - keep], text[len(text) - keep :]
        state.update((held, done))
        yield pd.DataFrame({"stream_id": [key[0]], "text": [shown], "finished": [done]})

    return chunks.where("text is not null").groupBy("stream_id").applyInPandasWithState(run, "stream_id string, text string, finished boolean", "held string, done boolean", "update", GroupStateTimeout.NoTimeout)
