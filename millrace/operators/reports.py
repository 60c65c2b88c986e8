"""What a run, a dataset or a plan says of itself: differences, coverage, regimes, precision, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings of which a change is reported when a run goes on.
SETTINGS = ("steps", "lr", "min_lr_ratio", "resolved_warmup_steps", "schedule", "seed", "batch_size", "grad_accum", "seq_len", "weight_decay", "beta1", "beta2", "grad_clip")
#: Names of tensors here and in the exchange format, outside the blocks and within one.
OUTER = {"embed_tokens.weight": "model.embed_tokens.weight", "final_norm.weight": "model.norm.weight", "lm_head.weight": "lm_head.weight"}
INNER = {"attn_norm": "input_layernorm", "ffn_norm": "post_attention_layernorm", "attn.q_proj": "self_attn.q_proj", "attn.k_proj": "self_attn.k_proj", "attn.v_proj": "self_attn.v_proj", "attn.o_proj": "self_attn.o_proj", "ffn.gate_proj": "mlp.gate_proj", "ffn.up_proj": "mlp.up_proj", "ffn.down_proj": "mlp.down_proj"}


def identity(left: Column, right: Column) -> Column:
    """match, mismatch, or unknown where either isn't recorded."""
    return F.when(left.isNull() | right.isNull(), "unknown").when(left == right, "match").otherwise("mismatch")


def compared(runs: DataFrame, manifests: DataFrame, shards: DataFrame) -> DataFrame:
    """run_id, dataset, tokens, vocabulary: do a run's artefacts agree with the dataset that it names?

    runs: run_id, content_hash, train_tokens and vocab_size as the run has them; manifests: content_hash, vocab_size,
    train_tokens; shards: content_hash, tokens of the split as its files have them.
    """
    files = shards.groupBy("content_hash").agg(F.sum("tokens").alias("file_tokens"))
    j = runs.join(manifests.select("content_hash", F.lit(True).alias("known"), F.col("vocab_size").alias("said_vocab"), F.col("train_tokens").alias("said_tokens")), "content_hash", "left").join(files, "content_hash", "left")
    dataset = F.when(F.col("content_hash").isNull(), "unknown").when(F.col("known"), "match").otherwise("mismatch")
    return j.select("run_id", dataset.alias("dataset"), identity(F.col("said_tokens"), F.col("file_tokens")).alias("tokens"), identity(F.col("vocab_size"), F.col("said_vocab")).alias("vocabulary"))


def changed(before: DataFrame, after: DataFrame, key: str, settings: tuple[str, ...]) -> DataFrame:
    """key, setting, was, now of every setting that differs; one that only one side has differs from null."""
    each = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), (F.col(s) if s in df.columns else F.lit(None)).cast("string").alias(name)) for s in settings))).alias("x")).select(key, "x.*")
    return each(before, "was").join(each(after, "now"), [key, "setting"], "full").where(~F.col("was").eqNullSafe(F.col("now")))


def incompatible(base_fingerprint: Column, base_vocab: Column, fingerprint: Column, vocab: Column) -> Column:
    """What keeps a base model from being trained on with a dataset: the first of both that is known and differs."""
    return F.when(identity(base_fingerprint, fingerprint) == "mismatch", "tokenizer").when(identity(base_vocab, vocab) == "mismatch", "vocabulary size")


def coverage(splits: DataFrame, seq_len: int) -> DataFrame:
    """splits (tokens, windows_scored, predictions, trained) with windows, coverage, tokens_outside, stopped_early, scored_share."""
    width = seq_len + 1
    windows = F.greatest(F.lit(0).cast("long"), F.floor((F.col("tokens") - seq_len) / width).cast("long"))
    out = splits.withColumn("windows", windows)
    return out.withColumns({
        "coverage": F.when(F.col("windows") > 0, F.least(F.lit(1.0), F.col("windows_scored") / F.col("windows"))).otherwise(0.0),
        "tokens_outside": F.greatest(F.lit(0).cast("long"), F.col("tokens") - F.col("windows") * width),
        "stopped_early": F.col("windows_scored") < F.col("windows"),
        "scored_share": F.when(F.col("predictions") > 0, F.col("trained") / F.col("predictions")).otherwise(0.0),
    })


def accumulated(parts: DataFrame, *by: str) -> DataFrame:
    """loss of each step from its parts (loss, scored), weighted by what they scored; a step without any is unscored."""
    n = F.sum("scored")
    step = parts.groupBy(*by).agg(n.alias("scored"), (F.sum(F.when(F.col("scored") > 0, F.col("loss") * F.col("scored"))) / F.nullif(n, F.lit(0))).alias("loss"))
    finite = ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    return step.withColumn("event", F.when(F.col("scored") == 0, "unscored").when(~finite, "diverged").otherwise("train"))


def regime(verdict: Column) -> Column:
    """What ended the search for a plan, by the verdict on the last candidate; null where nothing did."""
    return (
        F.when(verdict.isNull(), "unconstrained")
        .when(verdict.isin("oom", "spills", "skipped", "too_large", "collapsed"), "vram-limited")
        .when(verdict == "not_enough_data", "data-limited")
        .when(verdict == "too_slow", "compute-limited")
        .otherwise("blocked")
    )


def precision(requested: Column, backend: Column, bf16: Column) -> Column:
    """(dtype, scaled, refused) by what was asked for and what the device is and can do."""
    plain = backend.isin("cpu", "mps") | (requested == "fp32")
    kind = F.when(plain, "fp32").when((requested == "bf16") | ((requested == "auto") & bf16), "bf16").otherwise("fp16")
    return F.struct(kind.alias("dtype"), (kind == "fp16").alias("scaled"), (~plain & (requested == "bf16") & ~bf16).alias("refused"))


def tensor_name(name: Column) -> Column:
    """A tensor's name in the exchange format, null where it has none."""
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    block, part = F.regexp_extract(name, r"^blocks\.(\d+)\.(.+)\.weight$", 1), F.regexp_extract(name, r"^blocks\.(\d+)\.(.+)\.weight$", 2)
    inner = F.when(block != "", F.concat(F.lit("model.layers."), block, F.lit("."), F.element_at(pairs(INNER), part), F.lit(".weight")))
    return F.coalesce(F.element_at(pairs(OUTER), name), inner)


def pointer(entry: Column, exists: Column) -> Column:
    """Why a pointer can't answer, or null: it names nothing, or a checkpoint that is gone."""
    return F.when(entry.isNull(), "not_recorded").when(~F.coalesce(exists, F.lit(False)), "gone")


def fitted(messages: Column, size, context: int, reply: str = "assistant") -> Column:
    """How many of the oldest messages are dropped so that the rest fits: whole ones, never the last, and no reply comes first.

    size: the size of an array of messages as a column; as sizes don't add up, each rest is measured whole.
    """
    n = F.size(messages)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (k == n - 1) | (F.get(messages, k)["role"] != reply))
    fits = F.filter(starts, lambda k: size(F.slice(messages, k + 1, n - k)) <= context)
    return F.when(n > 0, F.coalesce(F.array_min(fits), n - 1)).otherwise(0)


def remembered(history: Column, question: Column, answer: Column) -> Column:
    """The history with an exchange more, or as it was if the reply is blank."""
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.when(F.trim(answer) == "", history).otherwise(F.concat(history, F.array(role("user", question), role("assistant", answer))))


def extended(history: Column, more: Column) -> Column:
    """The history with its last message grown by more; unchanged if there is neither."""
    last = F.element_at(history, -1)
    grown = F.concat(F.slice(history, 1, F.greatest(F.lit(0), F.size(history) - 1)), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], more).alias("content"))))
    return F.when((F.size(history) == 0) | (F.trim(more) == ""), history).otherwise(grown)


def weights_agree(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """name, state of tensors (name, values) on two sides: ok, missing, unexpected, shape or differs, with the largest difference."""
    j = left.select("name", F.col("values").alias("a")).join(right.select("name", F.col("values").alias("b")), "name", "full")
    most = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return j.select("name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.size("a") != F.size("b"), "shape").when(most > tolerance, "differs").otherwise("ok").alias("state"), F.when(F.size("a") == F.size("b"), most).alias("difference"))


def hour(row: dict[str, Column], stamp: Column, compass) -> Column:
    """A line of prose from an hour's readings: summary, temperature, apparent, humidity, speed, bearing, visibility, pressure, kind."""
    one = lambda v, form: F.when(v.isNotNull(), F.format_string(form, v))
    wind = F.when(row["speed"] == 0, "wind calm").when(row["bearing"].isNull(), one(row["speed"], "wind %.1f km/h")).otherwise(F.concat(one(row["speed"], "wind %.1f km/h "), compass(row["bearing"])))
    summary = F.lower(F.trim(F.coalesce(row["summary"], F.lit(""))))
    parts = [
        F.when(summary == "", "no summary").otherwise(summary),
        one(row["temperature"], "%.1fC"),
        one(row["apparent"], "feels %.1fC"),
        F.coalesce(one(row["humidity"] * 100, "humidity %.0f%%"), F.lit("humidity unknown")),
        F.when(row["speed"].isNotNull(), wind),
        one(row["visibility"], "visibility %.1f km"),
        F.coalesce(one(row["pressure"], "pressure %.1f mb"), F.lit("pressure unknown")),
        row["kind"],
    ]
    return F.concat(F.date_format(stamp, "HH:mm"), F.lit("  "), F.concat_ws(", ", *parts))


def chance_of_none(documents: Column, fraction: Column) -> Column:
    """How likely a split of this fraction stays empty, in words."""
    percent = 100.0 * F.pow(1.0 - fraction, documents)
    return F.when(percent < 1, "under 1%").otherwise(F.concat(F.lit("about "), F.rint(percent).cast("int").cast("string"), F.lit("%")))


def divisor(value: Column, cap: Column) -> Column:
    """The largest divisor of value that isn't above cap."""
    some = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(cap, value)))
    return F.when(cap >= value, value).otherwise(F.array_max(F.filter(some, lambda k: value % k == 0)))


def halves(start: Column, effective: Column) -> Column:
    """start, half of it, and so on down to 1."""
    top = F.greatest(F.lit(1).cast("long"), F.least(start, F.greatest(F.lit(1).cast("long"), effective)))
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(top.cast("double"))).cast("int")), lambda k: F.call_function("shiftright", top, k))


def cadence(steps: Column, times: int, floor: int, ceiling: int) -> Column:
    """How often to do what should be done some times in all: within bounds, and at least once."""
    every = F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.floor(steps / max(1, times))), F.greatest(F.lit(1), steps))
    return F.greatest(F.lit(1), every).cast("long")


def same_twice(first: DataFrame, second: DataFrame) -> DataFrame:
    """name, first, second of counters on which two passes over the same sources disagree."""
    j = first.select("name", F.col("n").alias("first")).join(second.select("name", F.col("n").alias("second")), "name", "full")
    return j.where(~F.col("first").eqNullSafe(F.col("second")))
