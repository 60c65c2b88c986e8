"""The run log as a stream gives what the batch gives."""

import random

from millrace.operators import runlog as batch
from millrace.streaming import runlog

LINES = "run_id string, line_no long, line string"


def started(spark, tmp_path, name, df):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    return q


def test_stream_and_batch_agree_on_a_dirty_log(spark, tmp_path):
    rng = random.Random(3)
    lines = [(r, i, f'{{"event":"train","step":{i},"tokens":{i * 10 + len(r)},"elapsed":{i * 0.5}}}') for r in ("r", "short") for i in range(1, 80 if r == "r" else 9)]
    lines += [("r", 100 + i, f'{{"event":"eval","step":{i},"val_loss":{v}}}') for i, v in enumerate([5.0, 3.0, 3.0, 4.0])]
    lines += [("r", 200, '{"event":"ev'), ("r", 201, "[1]"), ("r", 202, '{"event":"train","tokens":true,"elapsed":7}'), ("r", 203, '{"event":"end","diverged":true}'), ("short", 9, '{"event":"unscored","step":9}')]
    dirty = lines + rng.sample(lines, 30)
    rng.shuffle(dirty)
    folder = str(tmp_path / "log")
    spark.createDataFrame(dirty[:60], LINES).coalesce(1).write.mode("append").parquet(folder)
    recs = runlog.records(runlog.tail(spark, folder))
    queries = [started(spark, tmp_path, "best", runlog.best(recs)), started(spark, tmp_path, "rate", runlog.rate(recs))]
    spark.createDataFrame(dirty[60:], LINES).coalesce(1).write.mode("append").parquet(folder)
    text = runlog.appended(recs, str(tmp_path / "out"), str(tmp_path / "out-state"))
    for q in (*queries, text):
        q.processAllAvailable()
        q.stop()
    want = {(r["run_id"], r["line_no"]): r for r in batch.throughput(batch.records(spark.createDataFrame(dirty, LINES))).collect()}
    got = {r["run_id"]: r for r in spark.table("rate").collect()}  # the last one of each run
    for run, last in (("r", 79), ("short", 8)):
        assert (got[run]["window_tokens"], got[run]["window_seconds"]) == (want[run, last]["window_tokens"], want[run, last]["window_seconds"])
    best = {r["run_id"]: (r["best_val_loss"], r["best_step"], r["unscored"], r["diverged"]) for r in spark.table("best").collect()}
    assert best == {"r": (3.0, 1, False, True), "short": (None, None, True, False)}
    assert spark.read.text(str(tmp_path / "out")).count() == sum(x[2].startswith("{") and x[2].endswith("}") for x in dirty)


def test_text_that_may_begin_a_stop_is_held_back(spark, tmp_path):
    folder, schema = str(tmp_path / "chunks"), "stream_id string, chunk_no long, text string"
    spark.createDataFrame([("a", 0, "Hello\n"), ("b", 0, "one\n\nUs")], schema).coalesce(1).write.mode("append").parquet(folder)
    chunks = spark.readStream.schema(schema).parquet(folder)
    q = started(spark, tmp_path, "shown", runlog.withheld(chunks, ("\n\nUser:",)))
    spark.createDataFrame([("a", 1, "there"), ("b", 1, "er: two"), ("b", 2, "more")], schema).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    rows = [(r["stream_id"], r["text"], r["finished"]) for r in spark.table("shown").collect()]
    assert sorted(r for r in rows if r[0] == "a") == [("a", "\nthere", False), ("a", "Hello", False)]
    assert [r for r in rows if r[0] == "b"] == [("b", "one", False), ("b", "", True)]
