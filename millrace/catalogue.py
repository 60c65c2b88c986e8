"""The queries of the core: (session, folder of the tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue_more import QUERIES
from .functions import formats, text
from .operators import chat, chunks, prefix, profile, rules, runlog, sampling, split, tokens
from .plans import planning

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

SEED, VAL_FRACTION, CHUNK, SEQ_LEN, SHARD_TOKENS = 1234, 0.05, 16_384, 256, 65_536
STOPS = ("\n\nUser:", "\nUser:", "\n\n", "\n")


def _query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents")


# --- profile


@_query
def corpus_profile(s, d):
    return profile.corpus(_docs(s, d))


@_query
def length_percentiles(s, d):
    return profile.percentiles(_docs(s, d))


@_query
def chars_by_source(s, d):
    return profile.chars_by_source(_docs(s, d))


@_query
def largest_sources(s, d):
    return profile.largest_sources(_docs(s, d))


@_query
def script_histogram(s, d):
    return profile.scripts(_docs(s, d))


@_query
def script_shares(s, d):
    return profile.script_shares(_docs(s, d))


@_query
def row_regularity(s, d):
    return profile.row_tally(_docs(s, d)).where("delimiter is not null")


@_query
def strongest_row_shape(s, d):
    return profile.strongest_row_shape(_docs(s, d))


def _rows_as_text(s, d):
    i = _t(s, d, "lineitem")
    return i.select(F.concat_ws(",", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"), "l_returnflag", "l_linestatus").alias("text"))


@_query
def tabular_detector(s, d):
    return profile.strongest_row_shape(_rows_as_text(s, d))


@_query
def duplicate_groups(s, d):
    return profile.duplicate_groups(_docs(s, d))


@_query
def keep_filter(s, d):
    return profile.kept(_docs(s, d))


@_query
def validation_findings(s, d):
    docs = _docs(s, d)
    one = F.lit(1).alias("k")
    p = profile.corpus(docs).withColumn("k", F.lit(1))
    shares = profile.script_shares(docs).agg(F.max_by("script", "share").alias("dominant_script"), F.max("share").alias("dominant_share"), F.count("*").alias("n_scripts"), F.coalesce(F.max(F.when(F.col("script") == "digits", F.col("share"))), F.lit(0.0)).alias("digit_share")).select("*", one)
    shape = profile.strongest_row_shape(docs).select("*", one)
    rank = profile.percentiles(docs).select("median_chars", one)
    files = _t(s, d, "source_files").dropDuplicates()
    counts = files.agg(F.count_if(F.col("size_bytes").isNull()).alias("files_skipped")).select("*", one)
    short = profile.kept(docs).agg(F.coalesce(F.sum("short"), F.lit(0)).alias("short_documents")).select("*", one)
    for other in (shares, shape, rank, counts, short):  # one row each
        p = p.join(other, "k")
    zero = {c: F.lit(0) for c in ("records_skipped", "extra_field_rows", "members_ignored", "nested_archives", "files_unrecognized", "assumed_text", "long_files_split")}
    p = p.withColumns({"vocab_size": F.lit(32_000), "achieved_vocab": F.lit(6_000), "truncated": F.lit(False), **zero})
    return rules.findings(p).withColumn("value", F.round("value", 6))


@_query
def dataset_verdicts(s, d):
    return rules.verdict(_t(s, d, "findings").dropDuplicates(["content_hash", "rule_no", "code", "message"]))


# --- sources, names


@_query
def source_kinds(s, d):
    f = _t(s, d, "source_files").select("path", "kind", "compressed", "size_bytes").dropDuplicates()
    return f.groupBy("kind", "compressed").agg(F.count("*").alias("files"), F.countDistinct(F.split_part("path", F.lit("::"), F.lit(1))).alias("containers"), F.sum("size_bytes").alias("bytes"))


@_query
def name_classes(s, d):
    p = F.col("path")
    return _t(s, d, "source_files").select("path").distinct().select("path", text.kind(p).alias("kind"), text.codec(p).alias("codec"), F.contains(p, F.lit("::")).alias("in_archive"), text.hidden(p).alias("hidden"))


@_query
def biggest_files(s, d):
    f = _t(s, d, "source_files").where("size_bytes is not null").dropDuplicates(["path", "size_bytes"])
    return f.orderBy(F.desc("size_bytes"), "path").limit(3).select("path", "size_bytes", formats.size(F.col("size_bytes")).alias("shown"))


@_query
def document_locations(s, d):
    return _docs(s, d).where("source is not null and ordinal is not null and byte_offset is not null").select("doc_id", text.location(F.col("source"), F.col("ordinal"), F.col("byte_offset")).alias("location"))


@_query
def emitted_ordinals(s, d):
    k = _docs(s, d).where("text is not null and source is not null").where(F.length(text.strip(F.col("text"))) >= 20)
    k = k.select("doc_id", "source", "ordinal", F.lit(1).alias("one"))
    return prefix.exclusive_sums(k, "ordinal", {"kept_ordinal": "one"}, ("source",), ("doc_id",)).select("doc_id", "source", F.col("kept_ordinal").cast("int").alias("kept_ordinal"))


@_query
def missing_sources(s, d):
    return _docs(s, d).where("source is not null").groupBy("source").agg(F.count("*").alias("documents")).join(_t(s, d, "source_files").where("size_bytes is not null").select(F.col("path").alias("source")), "source", "left_anti")


# --- splits and chunks


@_query
def content_split_sha(s, d):
    f = split.fraction_sha(F.col("text"), SEED)
    return _docs(s, d).where("text is not null").select("doc_id", f.alias("fraction"), split.side(f, VAL_FRACTION).alias("split"))


@_query
def content_split_blake2b(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", split.fraction_blake(SEED)("text").alias("fraction")).withColumn("split", split.side(F.col("fraction"), VAL_FRACTION))


@_query
def split_summary_rollup(s, d):
    f = split.fraction_sha(F.col("text"), SEED)
    return split.summary(_docs(s, d).where("text is not null").select(split.side(f, VAL_FRACTION).alias("split"), F.length("text").cast("long").alias("n_chars")))


@_query
def dataset_sides(s, d):
    m = _t(s, d, "manifests").where("val_fraction is not null").groupBy("content_hash").agg(F.max("val_fraction").alias("val_fraction"))
    r = _t(s, d, "split_rows").where("fraction is not null").select("content_hash", "doc_id", "fraction").distinct().join(m, "content_hash")
    return r.groupBy("content_hash").agg(F.count_if(F.col("fraction") < F.col("val_fraction")).alias("val"), F.count_if(F.col("fraction") >= F.col("val_fraction")).alias("train"))


@_query
def orphan_split_rows(s, d):
    m = _t(s, d, "manifests").select("content_hash").distinct()
    return _t(s, d, "split_rows").join(m, "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"))


@_query
def doc_chunks(s, d):
    return chunks.chunk(_docs(s, d), CHUNK).select("doc_id", "piece_no", "start", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


# --- conversations


@_query
def chat_turns(s, d):
    m = chat.turns(_docs(s, d)).select("doc_id", F.posexplode("messages").alias("turn", "m"))
    return m.groupBy("m.role").agg(F.count("*").alias("turns"), F.sum(F.length("m.content").cast("long")).alias("chars"))


@_query
def chat_render(s, d):
    return chat.render(chat.turns(_docs(s, d))).select("doc_id", F.md5("rendered").alias("rendered_md5"))


@_query
def chat_spans(s, d):
    return chat.render(chat.turns(_docs(s, d))).select("doc_id", F.posexplode("spans").alias("n", "p")).select("doc_id", "n", "p.span_start", "p.span_end")


@_query
def chat_prompt(s, d):
    t = chat.turns(_docs(s, d)).where(F.size("messages") > 1)
    return t.select("doc_id", F.md5(chat.prompt(F.col("messages"))).alias("prompt_md5"))


@_query
def chat_refusals(s, d):
    t = chat.turns(_docs(s, d))
    return t.select(F.coalesce(chat.problem(F.col("messages")), F.lit("none")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@_query
def chat_trained_share(s, d):
    n = F.aggregate("trained_spans", F.lit(0).cast("long"), lambda a, x: a + x["span_end"] - x["span_start"])
    return _docs(s, d).where("text is not null and size(trained_spans) > 0").groupBy("source").agg(F.sum(n).alias("trained"), F.sum(F.length("text").cast("long")).alias("chars")).withColumn("share", F.col("trained") / F.greatest(F.lit(1), F.col("chars")))


@_query
def stop_strings(s, d):
    e = chat.earliest_stop(F.col("text"), STOPS)
    return _docs(s, d).where("text is not null").select("doc_id", e["at"].alias("at"), e["order"].alias("stop_no"), chat.held_back(F.col("text"), STOPS).alias("held_back"))


# --- tokens: one a byte, and one at each document's end


def _sided(s, d):
    f = split.fraction_sha(F.col("text"), SEED)
    return _docs(s, d).where("text is not null").select("doc_id", split.side(f, VAL_FRACTION).alias("split"), (F.octet_length("text").cast("long") + 1).alias("tokens"))


@_query
def token_offsets(s, d):
    return prefix.exclusive_sums(_sided(s, d), "doc_id", {"first_token": "tokens"}, ("split",)).select("doc_id", "split", "tokens", "first_token")


@_query
def token_shards(s, d):
    o = token_offsets(s, d)
    first, last = F.floor(F.col("first_token") / SHARD_TOKENS), F.floor((F.col("first_token") + F.col("tokens") - 1) / SHARD_TOKENS)
    e = o.withColumn("shard_no", F.explode(F.sequence(first, last)))
    low, high = F.col("shard_no") * SHARD_TOKENS, (F.col("shard_no") + 1) * SHARD_TOKENS
    n = F.least(high, F.col("first_token") + F.col("tokens")) - F.greatest(low, F.col("first_token"))
    return e.withColumn("n", n).groupBy("split", "shard_no").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@_query
def window_counts(s, d):
    t = _sided(s, d).groupBy("split").agg(F.sum("tokens").alias("tokens"))
    return t.select("split", "tokens", planning.windows(F.col("tokens"), SEQ_LEN).alias("windows"), F.floor((F.col("tokens") - 1) / 2).alias("largest_seq_len"))


@_query
def document_windows(s, d):
    o = token_offsets(s, d)
    w = SEQ_LEN + 1
    return o.select("doc_id", "split", F.floor(F.col("first_token") / w).alias("first_window"), F.floor((F.col("first_token") + F.col("tokens") - 1) / w).alias("last_window"))


@_query
def manifest_windows(s, d):
    m = _t(s, d, "manifests").dropDuplicates(["content_hash"]).select("content_hash", F.explode("splits").alias("split", "x"))
    return m.select("content_hash", "split", F.col("x.tokens").alias("tokens"), planning.windows(F.col("x.tokens"), SEQ_LEN).alias("windows"))


def _shards(s, d):
    return _t(s, d, "shards").dropDuplicates(["content_hash", "split_name", "shard_no"])


@_query
def shard_offsets(s, d):
    w = W.partitionBy("content_hash", "split_name").orderBy("shard_no").rowsBetween(W.unboundedPreceding, -1)
    return _shards(s, d).select("content_hash", "split_name", "shard_no", "tokens", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("first_token"))


@_query
def offset_lookup(s, d):
    """The shard, and the place in it, of the tokens at each tenth of every split."""
    o = shard_offsets(s, d)
    whole = o.groupBy("content_hash", "split_name").agg(F.sum("tokens").alias("all"))
    asked = whole.select("content_hash", "split_name", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tenth"), "all").withColumn("at", F.floor(F.col("all") * F.col("tenth") / 10))
    hit = asked.join(o, ["content_hash", "split_name"]).where("at >= first_token and at < first_token + tokens")
    return hit.select("content_hash", "split_name", "tenth", "shard_no", (F.col("at") - F.col("first_token")).alias("local"))


@_query
def split_tokens_rollup(s, d):
    r = _shards(s, d).rollup("content_hash", "split_name").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"))
    return r.select(F.coalesce("content_hash", F.lit("all")).alias("content_hash"), F.coalesce("split_name", F.lit("total")).alias("split_name"), "tokens", "bytes", "shards")


@_query
def shard_masks(s, d):
    x = F.when(F.col("mask_name").isNull(), "none").when(F.col("mask_bytes") == F.col("tokens"), "whole").otherwise("wrong_size")
    g = _shards(s, d).withColumn("state", x).groupBy("content_hash").agg(F.bool_and(F.col("state") != "none").alias("all_masked"), F.bool_or(F.col("state") != "none").alias("any_masked"), F.count_if(F.col("state") == "wrong_size").alias("wrong_size"))
    return g.withColumn("partial", F.col("any_masked") & ~F.col("all_masked"))


@_query
def manifest_against_shards(s, d):
    m = _t(s, d, "manifests").dropDuplicates(["content_hash"]).select("content_hash", F.explode("splits").alias("split_name", "x")).select("content_hash", "split_name", F.explode("x.shards").alias("h"))
    m = m.select("content_hash", "split_name", F.col("h.name").alias("name"), F.col("h.bytes").alias("said_bytes"), F.col("h.sha256").alias("said_sha"))
    j = m.join(_shards(s, d).select("content_hash", "split_name", "name", "bytes", "sha256"), ["content_hash", "split_name", "name"], "full")
    state = F.when(F.col("bytes").isNull(), "missing").when(F.col("said_bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("said_bytes"), "wrong_size").when(F.col("sha256") != F.col("said_sha"), "wrong_hash").otherwise("ok")
    return j.select("content_hash", "split_name", "name", state.alias("state"))


def _word_counts(s, d):
    """doc_id and, of the words of each conversation, how many there are, touch a trained span, and touch one in part.

    Within the row: pieces are walked with their place, nothing is exploded or shuffled.
    """
    t = _docs(s, d).where("text is not null and size(trained_spans) > 0")
    zero = F.lit(0).cast("long")

    def step(a, piece):
        hi = a["at"] + F.length(piece)
        lo = hi - F.length(F.regexp_replace(piece, f"^{text.SPACE}+", ""))
        inside = F.aggregate("trained_spans", zero, lambda n, x: n + F.greatest(zero, F.least(hi, x["span_end"].cast("long")) - F.greatest(lo, x["span_start"].cast("long"))))
        touches = F.exists("trained_spans", lambda x: (hi > x["span_start"]) & (lo < x["span_end"]))
        return F.struct(hi.alias("at"), (a["words"] + 1).alias("words"), (a["trained"] + touches.cast("long")).alias("trained"), (a["straddling"] + ((inside > 0) & (inside < hi - lo)).cast("long")).alias("straddling"))

    start = F.struct(zero.alias("at"), zero.alias("words"), zero.alias("trained"), zero.alias("straddling"))
    pieces = F.regexp_extract_all("text", F.lit(rf"{text.SPACE}*[^{text.SPACE[1:]}+"), 0)
    return t.select("doc_id", F.aggregate(pieces, start, step).alias("w")).select("doc_id", "w.*").where("words > 0")


@_query
def mask_overlap(s, d):
    return _word_counts(s, d).select("doc_id", "words", "trained")


@_query
def straddling(s, d):
    return _word_counts(s, d).agg(F.coalesce(F.sum("straddling"), F.lit(0)).alias("straddling"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


# --- run logs


def _records(s, d):
    return runlog.records(_t(s, d, "metrics_lines"))


@_query
def torn_log(s, d):
    return runlog.torn(_t(s, d, "metrics_lines"))


@_query
def metrics_summary(s, d):
    return runlog.summary(_records(s, d)).withColumn("best_val_perplexity", F.round("best_val_perplexity", 6))


@_query
def throughput_window(s, d):
    return runlog.throughput(_records(s, d))


@_query
def best_so_far(s, d):
    return runlog.best_so_far(_records(s, d))


@_query
def weighted_loss(s, d):
    return runlog.weighted_loss(_records(s, d)).select("run_id", "tokens", *(F.round(c, 6).alias(c) for c in ("loss", "perplexity", "bits_per_token")))


@_query
def checkpoint_pointer(s, d):
    return runlog.pointers(runlog.checkpoints(_records(s, d)))


@_query
def checkpoint_prune(s, d):
    return runlog.pruned(runlog.checkpoints(_records(s, d)))


@_query
def record_types(s, d):
    v = "schema_of_variant(try_parse_json(line))"
    kind = F.expr(f"case when line is null then 'null' when {v} is null then 'malformed' when {v} like 'OBJECT%' then 'object' else 'other' end")
    return _t(s, d, "metrics_lines").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@_query
def json_property(s, d):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return _t(s, d, "events").groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


# --- sampling


def _logits(s, d):
    return sampling.logits(_t(s, d, "embeddings"))


@_query
def softmax(s, d):
    return sampling.softmax(_logits(s, d), 0.8).select("vec_id", "token_id", F.round("p", 9).alias("p"))


@_query
def sample_topk(s, d):
    return sampling.top_k(_logits(s, d), 5).select("vec_id", "token_id")


@_query
def sample_topp(s, d):
    return sampling.top_p(_logits(s, d), 0.3).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("token_id").alias("least"), F.max("token_id").alias("most"))


@_query
def greedy_argmax(s, d):
    return sampling.greedy(_logits(s, d)).select("vec_id", "token_id")


@_query
def repetition_penalty(s, d):
    seen = _t(s, d, "embeddings").select("vec_id", F.col("label").alias("token_id"))
    return sampling.penalise(_logits(s, d), seen, 1.3).select("vec_id", "token_id", F.round("logit", 9).alias("logit"))


@_query
def masked_cross_entropy(s, d):
    e = _t(s, d, "embeddings")
    targets = e.select("vec_id", F.col("label").alias("target"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"))
    return sampling.masked_mean(sampling.cross_entropy(_logits(s, d), targets)).select(F.round("loss", 9).alias("loss"), "scored")


# --- plans


def _shapes(s):
    return planning.parameters(planning.presets(s).withColumn("vocab_size", F.lit(32_000)))


@_query
def lr_schedule(s, d):
    return planning.schedule(s, 2_000, 3e-4, 100, 3e-5).select("step", F.round("lr", 12).alias("lr"))


@_query
def param_breakdown(s, d):
    return _shapes(s).select("rung", "name", "ffn_dim", "embedding", "attention", "ffn", "norm", "parameters", formats.parameters(F.col("parameters")).alias("shown"))


@_query
def peak_estimate(s, d):
    return planning.peak_bytes(_shapes(s), F.lit(32)).select("name", "peak_bytes", "flops_per_token")


@_query
def plan_ladder(s, d):
    m = planning.peak_bytes(_shapes(s), F.lit(16)).withColumn("rate", 120_000.0 / F.pow(F.lit(3.0), F.col("rung")))
    return planning.ladder(m, 4 << 30).select("rung", "name", "verdict", "reached", "chosen")


@_query
def recommended_rates(s, d):
    return planning.presets(s).select("name", F.round(planning.recommended_lr(F.col("d_model")), 9).alias("lr"))


@_query
def data_budget(s, d):
    m = _t(s, d, "manifests").dropDuplicates(["content_hash"])
    tokens = lambda k: F.coalesce(F.element_at("splits", k)["tokens"], F.lit(0).cast("long"))
    runs = m.select("content_hash", tokens("train").alias("train_tokens"), tokens("val").alias("val_tokens"), F.lit(13_900_000).cast("long").alias("parameters"), F.lit(8_192).cast("long").alias("tokens_per_step"), F.lit(1_500).cast("long").alias("steps"))
    b = planning.budget(runs).withColumn("derived_steps", planning.derived_steps(F.col("train_tokens"), F.col("parameters"), F.col("tokens_per_step")))
    return b.select("content_hash", *(F.round(c, 6).alias(c) for c in ("epochs", "tokens_per_parameter", "steps_per_epoch")), "tokens_never_read", "will_memorise", "data_limited", "leaves_unread", "no_validation", "derived_steps")


# --- rows as prose, quantities


@_query
def daily_prose(s, d):
    e = _t(s, d, "events").where("ts is not null")
    first = e.groupBy("ts").agg(F.min_by(F.struct("event_type", "value", "user_id"), "event_id").alias("x")).select("ts", "x.*")
    bearing = (F.col("user_id") * 7) % 360
    line = F.concat(F.date_format("ts", "HH:mm"), F.lit("  "), F.col("event_type"), F.lit(", "), F.format_string("%.1f", F.col("value")), F.lit(", wind "), formats.compass_point(bearing))
    day = F.to_date("ts")
    g = first.select(day.alias("day"), F.struct("ts", line.alias("line")).alias("r")).groupBy("day").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(", "), F.date_format("day", "EEEE"), F.lit("."))
    return g.select("day", F.size("rows").alias("readings"), F.md5(F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).alias("text_md5"))


@_query
def fmt_units(s, d):
    o = _t(s, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 1000).cast("long").alias("n"))
    return o.select("o_orderkey", formats.count(F.col("n")).alias("count"), formats.size(F.col("n")).alias("size"), formats.duration(F.col("n") % 400_000).alias("duration"))


# --- byte-level tokens of a public vocabulary


@_query
def pretokens_top(s, d):
    return tokens.pretokens(_docs(s, d)).orderBy(F.desc("n"), "token").limit(100)


@_query
def bpe_encode_counts(s, d):
    return tokens.compression(_docs(s, d))


@_query
def bpe_roundtrip(s, d):
    return tokens.round_trips(_docs(s, d))


@_query
def bpe_mask(s, d):
    """Tokens of conversations that touch a trained span, and those on both sides of an edge of one."""
    t = _docs(s, d).where("text is not null and size(trained_spans) > 0").select("doc_id", "trained_spans", tokens.offsets_encoder()("text").alias("e"))
    each = t.select("doc_id", "trained_spans", F.explode(F.arrays_zip("e.lo", "e.hi")).alias("o")).select("doc_id", "trained_spans", F.col("o.lo").alias("lo"), F.col("o.hi").alias("hi"))
    inside = F.exists("trained_spans", lambda x: (each["hi"] > x["span_start"]) & (each["lo"] < x["span_end"]))
    return each.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(inside).alias("trained"))


def queries() -> dict[str, Query]:
    return _ALL | QUERIES
