"""More queries of the core, each beside its SQL: reports, parsing, windows, prepared files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, parse
from .operators import chat, profile, reports, rules, runlog, split, windows
from .plans import planning
from .sources import readers, shards

SEED, VAL_FRACTION, SEQ_LEN = 1234, 0.05, 256
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_FRACTION = f"(('0x' || substr(sha256('{SEED}:' || text), 1, 12))::BIGINT / {float(1 << 48)})"
_STREAM = f"""t AS (SELECT doc_id, CASE WHEN {_FRACTION} < {VAL_FRACTION} THEN 'val' ELSE 'train' END AS split, strlen(text) + 1 AS n FROM documents WHERE text IS NOT NULL),
    o AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n AS first FROM t)"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    f = split.fraction_sha(F.col("text"), SEED)
    return windows.byte_stream(_t(spark, d, "documents").where("text is not null").withColumn("split", split.side(f, VAL_FRACTION)))


def _shared(spark: SparkSession) -> str:
    """A new folder that all tasks see: in spark.checkpoint.dir, or beside the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "-files"
    path = f"{named.removeprefix('file://').removeprefix('file:').rstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


# --- windows and prepared files


@_query(f"""WITH {_STREAM}, s AS (SELECT split, sum(n) AS all_n FROM t GROUP BY split),
    w AS (SELECT split, unnest(range(0, (all_n // {SEQ_LEN + 1})::BIGINT)) AS "window" FROM s),
    e AS (SELECT split, ((first + n - 1) // {SEQ_LEN + 1})::BIGINT AS "window", count(*) AS c FROM o GROUP BY 1, 2)
    SELECT w.split, w."window", {SEQ_LEN}::INTEGER AS n_inputs, {SEQ_LEN}::INTEGER AS n_targets, coalesce(c, 0)::INTEGER AS ends FROM w LEFT JOIN e ON e.split = w.split AND e."window" = w."window" """)
def token_windows(s, d):
    """The windows of both splits: how many inputs and targets each has, and how many documents end in it."""
    w = windows.sequential(_stream(s, d), SEQ_LEN)
    first = F.element_at("inputs", 1) == windows.END
    ends = F.size(F.filter("targets", lambda x: x == windows.END)) + first.cast("int")
    return w.select("split", F.col("window").cast("long").alias("window"), F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"), ends.alias("ends"))


@_query(f"""WITH {_STREAM}, x AS (SELECT d.doc_id, t.split, t.n, d.text, d.trained_spans, len(d.trained_spans) > 0 AS typed FROM documents d JOIN t ON t.doc_id = d.doc_id)
    SELECT split, count(*) AS documents, sum(n)::BIGINT AS tokens, count(*) AS end_tokens,
    sum(CASE WHEN NOT coalesce(typed, FALSE) THEN n - (strlen(text) = 0)::INT ELSE list_sum(list_transform(trained_spans, lambda s: strlen(substr(text, s.span_start + 1, s.span_end - s.span_start)))) + (list_max(list_transform(trained_spans, lambda s: s.span_end)) >= length(text))::INT END)::BIGINT AS trained
    FROM x GROUP BY split""")
def stream_totals(s, d):
    return windows.totals(_stream(s, d)).drop("masked_documents")


@_query(f"""WITH {_STREAM}, s AS (SELECT split, sum(n)::BIGINT AS all_n FROM t GROUP BY split), k AS (SELECT split, all_n, unnest(range(0, (all_n + 999999) // 1000000)) AS shard FROM s)
    SELECT split, shard::BIGINT AS shard, least(1000000, all_n - shard * 1000000)::BIGINT AS tokens, (2 * least(1000000, all_n - shard * 1000000))::BIGINT AS bytes, 'ok' AS state, 'ok' AS mask_state FROM k""")
def prepared_shards(s, d):
    """Writes both splits as shards with masks, reads the manifest back strictly and verifies every file."""
    out = f"{_shared(s)}/set"
    m = shards.write(_stream(s, d).withColumn("mask", F.col("mask").cast("array<int>")), out, 384, shard_tokens=1_000_000)
    states = shards.verify(s, out)
    rows = [(side, k, x["tokens"], x["bytes"], x["name"], x["mask_name"]) for side, part in m["splits"].items() for k, x in enumerate(part["shards"])]
    listed = s.createDataFrame(rows, "split string, shard long, tokens long, bytes long, name string, mask_name string")
    named = listed.join(states, "name").join(states.select(F.col("name").alias("mask_name"), F.col("state").alias("mask_state")), "mask_name")
    return named.select("split", "shard", "tokens", "bytes", "state", "mask_state")


@_query(f"WITH {_STREAM} SELECT 0 AS epoch, 8 AS n_rows, {8 * SEQ_LEN}::BIGINT AS inputs, 0::BIGINT AS apart FROM o LIMIT 1")
def batch_rows(s, d):
    """Step 3's batch of eight: rows, inputs, and targets that aren't the inputs moved by one."""
    b = windows.batch(_stream(s, d), SEQ_LEN, 8, 3, SEED)
    apart = F.slice("inputs", 2, SEQ_LEN - 1) != F.slice("targets", 1, SEQ_LEN - 1)
    return b.groupBy("epoch").agg(F.count("*").cast("int").alias("n_rows"), F.sum(F.size("inputs").cast("long")).alias("inputs"), F.count_if(apart).alias("apart"))


@_query("""WITH h AS (SELECT DISTINCT content_hash, split_name, shard_no, tokens FROM shards)
    SELECT content_hash, split_name, shard_no, (sum(tokens) OVER w - tokens)::BIGINT AS lo, (sum(tokens) OVER w)::BIGINT AS hi FROM h WINDOW w AS (PARTITION BY content_hash, split_name ORDER BY shard_no)""")
def shard_ranges(s, d):
    from pyspark.sql import Window as W

    h = _t(s, d, "shards").select("content_hash", "split_name", "shard_no", "tokens").distinct()
    till = F.sum("tokens").over(W.partitionBy("content_hash", "split_name").orderBy("shard_no"))  # a dataset's shards
    return h.select("content_hash", "split_name", "shard_no", (till - F.col("tokens")).alias("lo"), till.alias("hi"))


# --- readers


@_query("""SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') GROUP BY 1""")
def jsonl_records(s, d):
    """The documents as JSON Lines, compressed, read back by the reader: what comes out, and how often."""
    path = _shared(s)
    _t(s, d, "documents").where("text is not null").select("text").write.mode("append").option("compression", "gzip").json(f"{path}/corpus")
    for name in sorted(os.listdir(f"{path}/corpus")):  # Spark's own names end in .json.gz
        if name.endswith(".json.gz"):
            os.rename(f"{path}/corpus/{name}", f"{path}/corpus/{name.removesuffix('.json.gz')}.jsonl.gz")
        else:
            os.remove(f"{path}/corpus/{name}")
    read, _, _ = readers.read(s, f"{path}/corpus", readers.Options(min_chars=1))
    return read.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


_VALID = r"(json_valid(line) AND NOT regexp_matches(line, ':\s*-?(NaN|Infinity)\b'))"


@_query(f"""WITH x AS (SELECT run_id, line, {_VALID} AND (json_type(try_cast(line AS JSON)) = 'VARCHAR' OR json_type(try_cast(line AS JSON)) = 'OBJECT' AND json_type(try_cast(line AS JSON), '$.event') = 'VARCHAR') AS ok FROM metrics_lines WHERE line IS NOT NULL AND regexp_matches(line, '\\S'))
    SELECT 'documents' AS outcome, count(*) FILTER (coalesce(ok, FALSE)) AS n FROM x UNION ALL SELECT 'records_skipped', count(*) FILTER (NOT coalesce(ok, FALSE)) FROM x""")
def malformed_counts(s, d):
    """The run logs as files, read with the event as text (a bare string is its own): records, and those skipped as malformed."""
    path = f"{_shared(s)}/logs"
    _t(s, d, "metrics_lines").where("line is not null").select("line").write.text(path)
    for name in os.listdir(path):
        if name.endswith(".txt"):
            os.rename(f"{path}/{name}", f"{path}/{name.removesuffix('.txt')}.jsonl")
        else:
            os.remove(f"{path}/{name}")
    _, counters, _ = readers.read(s, path, readers.Options(on_error="skip", text_field="event", min_chars=1))
    return counters.where("outcome in ('documents', 'records_skipped')").groupBy("outcome").agg(F.sum("n").alias("n"))


# --- rules where they hold and where they don't

_MEASURES = """SELECT p_partkey AS k, (p_partkey % 7 > 0)::INT * 100 AS documents, (p_partkey * 7919) % 2000003 + p_partkey % 3 AS total_chars, ((p_partkey % 61)::DOUBLE / 1000) AS control_ratio,
    (p_partkey % 100)::DOUBLE / 100 AS whitespace_ratio, (p_partkey % 70)::DOUBLE / 100 AS duplicate_rate, p_partkey % 4 AS replacement_chars, p_partkey % 90 AS median_chars,
    CASE WHEN p_partkey % 2 = 0 THEN ',' END AS delimiter, (p_partkey % 30)::BIGINT AS sampled_lines, (p_partkey % 11)::DOUBLE / 10 AS row_share, (p_partkey % 9)::DOUBLE / 10 AS digit_share,
    CASE p_partkey % 3 WHEN 0 THEN 'latin' WHEN 1 THEN 'han' ELSE 'digits' END AS dominant_script, (p_partkey % 13)::DOUBLE / 12 AS dominant_share, p_partkey % 5 AS n_scripts,
    CASE WHEN p_partkey % 5 = 0 THEN 32000 ELSE 512 END AS vocab_size, p_partkey % 8 * 1000 AS achieved_vocab, p_partkey % 6 = 0 AS truncated, p_partkey % 17 AS c FROM part"""


@_query(f"""WITH m AS ({_MEASURES}), x AS (SELECT *, delimiter IS NOT NULL AND sampled_lines >= 20 AND row_share >= 0.8 AS tab, dominant_share < 0.6 AND n_scripts > 1 AS mixed FROM m WHERE documents > 0),
    f AS (SELECT 1 AS rule_no, 'empty_corpus' AS code, k FROM m WHERE documents = 0
    UNION ALL SELECT 2, 'corpus_too_small', k FROM x WHERE total_chars < 1000 UNION ALL SELECT 3, 'likely_binary', k FROM x WHERE control_ratio > 0.05
    UNION ALL SELECT 4, 'control_characters', k FROM x WHERE control_ratio > 0.001 AND control_ratio <= 0.05 UNION ALL SELECT 5, 'rows_not_prose', k FROM x WHERE tab AND digit_share < 0.4
    UNION ALL SELECT 7, 'looks_like_a_table', k FROM x WHERE tab AND digit_share >= 0.4 UNION ALL SELECT 8, 'small_corpus', k FROM x WHERE total_chars BETWEEN 1000 AND 1048575
    UNION ALL SELECT 9, 'vocab_too_large_for_corpus', k FROM x WHERE total_chars < vocab_size * 100 UNION ALL SELECT 10, 'vocabulary_saturated', k FROM x WHERE achieved_vocab < vocab_size * 0.25
    UNION ALL SELECT 11, 'very_short_documents', k FROM x WHERE median_chars < 32 UNION ALL SELECT 12, 'mostly_whitespace', k FROM x WHERE whitespace_ratio > 0.6
    UNION ALL SELECT 13, 'heavy_duplication', k FROM x WHERE duplicate_rate > 0.5 UNION ALL SELECT 14, 'some_duplication', k FROM x WHERE duplicate_rate > 0.2 AND duplicate_rate <= 0.5
    UNION ALL SELECT 15, 'duplicate_check_truncated', k FROM x WHERE truncated UNION ALL SELECT 16, 'replacement_characters', k FROM x WHERE replacement_chars > 0
    UNION ALL SELECT 17, 'mixed_scripts', k FROM x WHERE mixed UNION ALL SELECT 18, 'non_latin_script', k FROM x WHERE NOT mixed AND dominant_script NOT IN ('latin', 'digits')
    UNION ALL SELECT r + 19, ['files_skipped', 'records_skipped', 'csv_rows_with_extra_fields', 'short_documents_dropped', 'archive_members_ignored', 'nested_archives_ignored', 'files_unrecognized', 'assumed_text', 'documents_were_split'][r + 1], k FROM x, range(9) t(r) WHERE (c + r) % 3 > 0)
    SELECT rule_no::INTEGER AS rule_no, code, count(*) AS n, sum(k)::BIGINT AS of_profiles FROM f GROUP BY 1, 2""")
def rule_matrix(s, d):
    """Every rule over profiles with measures on both sides of each threshold, a part each: how often it holds, and where."""
    k = F.col("p_partkey")
    ratio = lambda m, by: (k % m).cast("double") / by
    p = _t(s, d, "part").select(
        k.alias("k"), ((k % 7 > 0).cast("int") * 100).alias("documents"), ((k * 7919) % 2000003 + k % 3).alias("total_chars"), ratio(61, 1000).alias("control_ratio"), ratio(100, 100).alias("whitespace_ratio"),
        ratio(70, 100).alias("duplicate_rate"), (k % 4).alias("replacement_chars"), (k % 90).alias("median_chars"), F.when(k % 2 == 0, ",").alias("delimiter"), (k % 30).alias("sampled_lines"), ratio(11, 10).alias("row_share"),
        ratio(9, 10).alias("digit_share"), F.when(k % 3 == 0, "latin").when(k % 3 == 1, "han").otherwise("digits").alias("dominant_script"), ratio(13, 12).alias("dominant_share"), (k % 5).alias("n_scripts"),
        F.when(k % 5 == 0, 32000).otherwise(512).alias("vocab_size"), (k % 8 * 1000).alias("achieved_vocab"), (k % 6 == 0).alias("truncated"),
        *((((k % 17) + r) % 3).alias(c) for r, (_, _, c) in enumerate(rules.COUNTERS)),
    )
    return rules.findings(p, keep=("k",)).groupBy("rule_no", "code").agg(F.count("*").alias("n"), F.sum("k").alias("of_profiles"))


_MESSAGES = """CASE o_orderkey % 11 WHEN 0 THEN 'not_a_list' WHEN 1 THEN 'empty' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'no_role' WHEN 4 THEN 'unknown_role' WHEN 5 THEN 'no_content' WHEN 6 THEN 'empty_content' WHEN 7 THEN 'no_assistant' ELSE 'none' END"""


@_query(f"""SELECT {_MESSAGES} AS problem, CASE o_orderkey % 11 WHEN 8 THEN 'ends_with_reply' WHEN 9 THEN 'ends_with_reply' WHEN 7 THEN 'none' WHEN 10 THEN 'none' ELSE {_MESSAGES} END AS prompt_problem, count(*) AS n FROM orders GROUP BY 1, 2""")
def conversation_problems(s, d):
    """Conversations with each fault, one an order: why they can't be rendered, or asked."""
    k, c = F.col("o_orderkey") % 11, F.col("o_orderpriority")
    m = lambda r, t: F.struct(F.lit(r).cast("string").alias("role"), (t if not isinstance(t, str) and t is not None else F.lit(t)).cast("string").alias("content"))
    user, reply = m("user", c), m(" Assistant ", c)
    nothing = F.lit(None).cast("struct<role:string,content:string>")
    lists = {0: F.lit(None).cast("array<struct<role:string,content:string>>"), 1: F.array().cast("array<struct<role:string,content:string>>"), 2: F.array(user, nothing), 3: F.array(m(None, c), reply), 4: F.array(m("tool", c), reply), 5: F.array(user, m("assistant", None)), 6: F.array(m("user", "  "), reply), 7: F.array(user, user), 8: F.array(user, reply), 9: F.array(m("SYSTEM", c), user, reply), 10: F.array(user, reply, user)}
    messages = F.coalesce(*(F.when(k == i, x) for i, x in lists.items()))
    named = lambda prompt: F.coalesce(chat.problem(messages, prompt), F.lit("none"))
    return _t(s, d, "orders").groupBy(named(False).alias("problem"), named(True).alias("prompt_problem")).agg(F.count("*").alias("n"))


@_query("""WITH t AS (SELECT concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, l_returnflag, l_linestatus, l_extendedprice::BIGINT, (l_discount * 100)::BIGINT, (l_tax * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d')) AS text FROM lineitem)
    SELECT 'looks_like_a_table' AS code, 'error' AS level, count(*) AS rows FROM t""")
def table_findings(s, d):
    """The rows of a table as text: what the rules of table-like layout say of them."""
    c = F.col
    cents = lambda x: F.rint(c(x) * 100).cast("long")
    t = _t(s, d, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c("l_quantity").cast("long"), "l_returnflag", "l_linestatus", F.rint("l_extendedprice").cast("long"), cents("l_discount"), cents("l_tax"), F.date_format("l_shipdate", "yyyyMMdd")).alias("text"), F.lit("lineitem").alias("source"))
    shape = profile.strongest_row_shape(t).select("*", F.lit(1).alias("k"))
    shares = profile.script_shares(t).agg(F.max_by("script", "share").alias("dominant_script"), F.max("share").alias("dominant_share"), F.count("*").alias("n_scripts"), F.coalesce(F.max(F.when(F.col("script") == "digits", F.col("share"))), F.lit(0.0)).alias("digit_share")).select("*", F.lit(1).alias("k"))
    p = profile.corpus(t).withColumn("k", F.lit(1)).join(shape, "k").join(shares, "k")
    p = p.withColumns({"median_chars": F.lit(100), "vocab_size": F.lit(512), "achieved_vocab": F.lit(512), "truncated": F.lit(False), **{x: F.lit(0) for _, _, x in rules.COUNTERS}})
    found = rules.findings(p, keep=("documents",)).where(F.col("code").isin("rows_not_prose", "tabular_override", "looks_like_a_table"))
    return found.select("code", "level", F.col("documents").alias("rows"))


# --- artefacts and runs


@_query("""WITH m AS (SELECT content_hash, max(vocab_size) AS v, max(splits['train'].tokens) AS t FROM manifests GROUP BY 1), h AS (SELECT content_hash, sum(tokens) AS n FROM (SELECT DISTINCT content_hash, shard_no, tokens FROM shards WHERE split_name = 'train') GROUP BY 1),
    r AS (SELECT run_id, max(content_hash) AS content_hash, CASE length(run_id) % 2 WHEN 0 THEN 512 END AS vocab FROM metrics_lines GROUP BY 1)
    SELECT run_id, CASE WHEN r.content_hash IS NULL THEN 'unknown' WHEN m.content_hash IS NULL THEN 'mismatch' ELSE 'match' END AS dataset,
    CASE WHEN t IS NULL OR n IS NULL THEN 'unknown' WHEN t = n THEN 'match' ELSE 'mismatch' END AS tokens, CASE WHEN vocab IS NULL OR v IS NULL THEN 'unknown' WHEN vocab = v THEN 'match' ELSE 'mismatch' END AS vocabulary
    FROM r LEFT JOIN m ON m.content_hash = r.content_hash LEFT JOIN h ON h.content_hash = r.content_hash""")
def artefact_match(s, d):
    """Runs against the dataset they name: is it known, do its files hold the tokens it says, is the vocabulary the run's."""
    m = _t(s, d, "manifests").groupBy("content_hash").agg(F.max("vocab_size").alias("vocab_size"), F.max(F.element_at("splits", "train")["tokens"]).alias("train_tokens"))
    h = _t(s, d, "shards").where("split_name = 'train'").select("content_hash", "shard_no", "tokens").distinct()
    r = _t(s, d, "metrics_lines").groupBy("run_id").agg(F.max("content_hash").alias("content_hash")).withColumn("vocab_size", F.when(F.length("run_id") % 2 == 0, 512))
    return reports.compared(r, m, h)


@_query("""WITH m AS (SELECT content_hash, max(tokenizer_fingerprint) AS f, max(vocab_size) AS v FROM manifests GROUP BY 1)
    SELECT a.content_hash AS base, b.content_hash AS dataset, CASE WHEN a.f <> b.f THEN 'tokenizer' WHEN a.v <> b.v THEN 'vocabulary size' ELSE 'none' END AS problem FROM m a JOIN m b ON a.content_hash < b.content_hash""")
def finetune_check(s, d):
    m = _t(s, d, "manifests").groupBy("content_hash").agg(F.max("tokenizer_fingerprint").alias("f"), F.max("vocab_size").alias("v"))
    a, b = m.alias("a"), m.alias("b")
    j = a.join(b, F.col("a.content_hash") < F.col("b.content_hash"))  # a few dozen manifests
    return j.select(F.col("a.content_hash").alias("base"), F.col("b.content_hash").alias("dataset"), F.coalesce(reports.incompatible(F.col("a.f"), F.col("a.v"), F.col("b.f"), F.col("b.v")), F.lit("none")).alias("problem"))


@_query("""WITH m AS (SELECT content_hash, max(seed) AS seed, max(vocab_size) AS batch_size, max(val_fraction) AS lr FROM manifests WHERE content_hash IS NOT NULL GROUP BY 1),
    n AS (SELECT content_hash, max(seed) AS seed, max(vocab_size) + max(vocab_size) % 3 AS batch_size, CASE WHEN max(vocab_size) > 600 THEN max(val_fraction) END AS lr FROM manifests WHERE content_hash IS NOT NULL GROUP BY 1)
    SELECT content_hash, 'batch_size' AS setting, m.batch_size::VARCHAR AS was, n.batch_size::VARCHAR AS now FROM m JOIN n USING (content_hash) WHERE m.batch_size IS DISTINCT FROM n.batch_size
    UNION ALL SELECT content_hash, 'lr', m.lr::VARCHAR, n.lr::VARCHAR FROM m JOIN n USING (content_hash) WHERE m.lr IS DISTINCT FROM n.lr""")
def config_changes(s, d):
    """Settings of a run and of the one that goes on with it."""
    m = _t(s, d, "manifests").where("content_hash is not null").groupBy("content_hash").agg(F.max("seed").alias("seed"), F.max("vocab_size").alias("batch_size"), F.max("val_fraction").alias("lr"))
    n = m.withColumn("lr", F.when(F.col("batch_size") > 600, F.col("lr"))).withColumn("batch_size", F.col("batch_size") + F.col("batch_size") % 3)
    return reports.changed(m, n, "content_hash", reports.SETTINGS)


@_query(f"""WITH m AS (SELECT content_hash, max(splits['val'].tokens) AS tokens FROM manifests GROUP BY 1), w AS (SELECT content_hash, tokens, greatest(0, (tokens - {SEQ_LEN}) // {SEQ_LEN + 1}) AS windows, tokens // 400 AS scored FROM m WHERE tokens IS NOT NULL)
    SELECT content_hash, windows::BIGINT AS windows, round(CASE WHEN windows > 0 THEN least(1.0, scored / windows) ELSE 0 END, 9) AS coverage, greatest(0, tokens - windows * {SEQ_LEN + 1})::BIGINT AS tokens_outside, scored < windows AS stopped_early, round(CASE WHEN scored > 0 THEN 0.75 ELSE 0.0 END, 9)::DOUBLE AS scored_share FROM w""")
def eval_coverage(s, d):
    m = _t(s, d, "manifests").groupBy("content_hash").agg(F.max(F.element_at("splits", "val")["tokens"]).alias("tokens")).where("tokens is not null")
    p = m.withColumn("windows_scored", F.floor(F.col("tokens") / 400)).withColumn("predictions", F.col("windows_scored") * SEQ_LEN).withColumn("trained", F.col("predictions") * 0.75)
    return reports.coverage(p, SEQ_LEN).select("content_hash", "windows", F.round("coverage", 9).alias("coverage"), "tokens_outside", "stopped_early", F.round("scored_share", 9).alias("scored_share"))


@_query("""WITH p AS (SELECT o_custkey AS step, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 97 END AS scored, o_totalprice / 1e5 AS loss FROM orders)
    SELECT step, sum(scored)::BIGINT AS scored, round(sum(loss * scored) / nullif(sum(scored), 0), 9) AS loss, CASE WHEN sum(scored) = 0 THEN 'unscored' ELSE 'train' END AS event FROM p GROUP BY step""")
def accumulated_steps(s, d):
    """Micro-batches (orders) of a step (their customer): the loss weighted by what was scored, steps that scored nothing."""
    p = _t(s, d, "orders").select(F.col("o_custkey").alias("step"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("o_orderkey") % 97).alias("scored"), (F.col("o_totalprice") / 1e5).alias("loss"))
    return reports.accumulated(p, "step").select("step", "scored", F.round("loss", 9).alias("loss"), "event")


@_query(r"""WITH q AS (SELECT DISTINCT run_id, line_no, line FROM metrics_lines WHERE line IS NOT NULL AND json_valid(line) AND NOT regexp_matches(line, ':\s*-?(NaN|Infinity)\b')),
    e AS (SELECT run_id, line_no, (line::JSON)->>'$.event' AS event, json_type(line::JSON, '$.val_loss') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS numeric, try_cast((line::JSON)->>'$.val_loss' AS DOUBLE) AS v FROM q WHERE json_type(line::JSON) = 'OBJECT')
    SELECT run_id, line_no, round(CASE WHEN v > 20 THEN 'inf'::DOUBLE ELSE exp(v) END, 6) AS perplexity, round(v / ln(2), 9) AS bits_per_token FROM e WHERE event = 'eval' AND numeric AND v IS NOT NULL""")
def perplexity(s, d):
    r = runlog.records(_t(s, d, "metrics_lines")).where("event = 'eval' and val_loss is not null")
    return r.select("run_id", "line_no", F.round(formats.perplexity(F.col("val_loss")), 6).alias("perplexity"), F.round(F.col("val_loss") / F.log(F.lit(2.0)), 9).alias("bits_per_token"))


# --- scalars


@_query("""SELECT source, count(*) AS documents, count(*) - count(DISTINCT text) AS repeated, round((count(*) - count(DISTINCT text)) / count(*), 9) AS rate FROM documents WHERE text IS NOT NULL GROUP BY source""")
def duplicate_rate(s, d):
    g = _t(s, d, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("text").alias("u"))
    return g.select("source", "documents", (F.col("documents") - F.col("u")).alias("repeated"), F.round((F.col("documents") - F.col("u")) / F.col("documents"), 9).alias("rate"))


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey % 50 AS a, o_orderkey % 60 AS b FROM orders)
    SELECT o_orderkey, (CASE k WHEN 0 THEN a * 3600.0 + b * 60 WHEN 1 THEN b * 60.0 WHEN 2 THEN b + 0.5 WHEN 3 THEN NULL WHEN 4 THEN a * 86400.0 ELSE NULL END)::DOUBLE AS seconds FROM x
    WHERE CASE k WHEN 0 THEN a + b > 0 WHEN 1 THEN b > 0 WHEN 4 THEN a > 0 ELSE TRUE END""")
def parsed_durations(s, d):
    k, a, b = (F.col("o_orderkey") % n for n in (7, 50, 60))
    text = F.when(k == 0, F.format_string(" %dh%dm", a, b)).when(k == 1, b.cast("string")).when(k == 2, F.format_string("%d.5S", b)).when(k == 3, F.format_string("%d hours", a)).when(k == 4, F.format_string("%d d", a)).when(k == 5, F.lit("")).otherwise(F.format_string("-%dm", b))
    zero = F.coalesce(F.when(k == 0, a + b == 0).when(k == 1, b == 0).when(k == 4, a == 0), F.lit(False))
    return _t(s, d, "orders").where(~zero).select("o_orderkey", parse.seconds(text).alias("seconds"))


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 40 + 1 AS a FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN a * 1073741824 WHEN 1 THEN a * 1048576 WHEN 2 THEN a * 1073741824 + 536870912 WHEN 3 THEN a WHEN 4 THEN NULL ELSE 1024 * a END::BIGINT AS n FROM x""")
def parsed_memory(s, d):
    k, a = F.col("o_orderkey") % 6, F.col("o_orderkey") % 40 + 1
    text = F.when(k == 0, F.format_string("%d", a)).when(k == 1, F.format_string("%d MiB", a)).when(k == 2, F.format_string("%d.5gb", a)).when(k == 3, F.format_string("%dB", a)).when(k == 4, F.format_string("%dg512m", a)).otherwise(F.format_string(" %d Kb ", a))
    return _t(s, d, "orders").select("o_orderkey", parse.bytes_of(text).alias("n"))


@_query("""WITH m AS (SELECT content_hash, max(val_fraction) AS f FROM manifests WHERE val_fraction IS NOT NULL GROUP BY 1), n AS (SELECT content_hash, count(DISTINCT doc_id) % 90 AS n FROM split_rows GROUP BY 1)
    SELECT content_hash, n.n AS documents, CASE WHEN 100 * pow(1 - f, n.n) < 1 THEN 'under 1%' ELSE 'about ' || round_even(100 * pow(1 - f, n.n), 0)::INTEGER || '%' END AS chance FROM m JOIN n USING (content_hash)""")
def empty_split_chances(s, d):
    m = _t(s, d, "manifests").where("val_fraction is not null").groupBy("content_hash").agg(F.max("val_fraction").alias("f"))
    n = _t(s, d, "split_rows").groupBy("content_hash").agg((F.countDistinct("doc_id") % 90).alias("documents"))
    return m.join(n, "content_hash").select("content_hash", "documents", reports.chance_of_none(F.col("documents"), F.col("f")).alias("chance"))


@_query("""SELECT kind, count(*) AS files, CASE WHEN count(*) > 3 THEN array_to_string((list(path ORDER BY path))[1:3], ', ') || ', and ' || (count(*) - 3) || ' more' ELSE array_to_string(list(path ORDER BY path), ', ') END AS shown,
    array_to_string(list_transform(list(path ORDER BY path)[1:2], lambda x: '''' || x || ''''), ', ') AS quoted FROM (SELECT DISTINCT kind, path FROM source_files WHERE path IS NOT NULL) GROUP BY kind""")
def file_lists(s, d):
    g = _t(s, d, "source_files").where("path is not null").select("kind", "path").distinct().groupBy("kind").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("path")).alias("p"))  # files of a kind, as scanned
    return g.select("kind", "files", parse.some_of(F.col("p"), F.col("files")).alias("shown"), parse.quoted(F.slice("p", 1, 2)).alias("quoted"))


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 96 + 1 AS v, o_custkey % 70 + 1 AS cap FROM orders)
    SELECT o_orderkey, CASE WHEN cap >= v THEN v ELSE list_max(list_filter(range(1, cap + 1), lambda k: v % k = 0)) END::BIGINT AS divisor,
    (floor(log2(least(cap, v))) + 1)::INTEGER AS rungs, greatest(1, least(500, least(greatest(25, o_orderkey % 3000 // 20), greatest(1, o_orderkey % 3000))))::BIGINT AS every FROM x""")
def micro_batches(s, d):
    v, cap, steps = F.col("o_orderkey") % 96 + 1, F.col("o_custkey") % 70 + 1, F.col("o_orderkey") % 3000
    return _t(s, d, "orders").select("o_orderkey", reports.divisor(v, cap).alias("divisor"), F.size(reports.halves(cap, v)).alias("rungs"), reports.cadence(steps, 20, 25, 500).alias("every"))


@_query("""WITH r AS (SELECT unnest(['auto', 'bf16', 'fp16', 'fp32']) AS requested), b AS (SELECT unnest(['cpu', 'mps', 'cuda', 'rocm']) AS backend), f AS (SELECT unnest([TRUE, FALSE]) AS bf16),
    x AS (SELECT *, CASE WHEN backend IN ('cpu', 'mps') OR requested = 'fp32' THEN 'fp32' WHEN requested = 'bf16' THEN 'bf16' WHEN requested = 'fp16' THEN 'fp16' WHEN bf16 THEN 'bf16' ELSE 'fp16' END AS dtype FROM r, b, f)
    SELECT *, dtype = 'fp16' AS scaled, requested = 'bf16' AND NOT bf16 AND backend IN ('cuda', 'rocm') AS refused FROM x""")
def precision_table(s, d):
    rows = [(r, b, f) for r in ("auto", "bf16", "fp16", "fp32") for b in ("cpu", "mps", "cuda", "rocm") for f in (True, False)]
    t = s.createDataFrame(rows, "requested string, backend string, bf16 boolean")
    return t.select("*", reports.precision(F.col("requested"), F.col("backend"), F.col("bf16")).alias("p")).select("requested", "backend", "bf16", "p.*")


@_query("""SELECT v AS verdict, r AS regime FROM (VALUES ('oom', 'vram-limited'), ('spills', 'vram-limited'), ('not_enough_data', 'data-limited'), ('too_slow', 'compute-limited'), ('error', 'blocked'), (NULL, 'unconstrained')) t(v, r)""")
def regimes(s, d):
    t = s.createDataFrame([(v,) for v in ("oom", "spills", "not_enough_data", "too_slow", "error", None)], "verdict string")
    return t.select("verdict", reports.regime(F.col("verdict")).alias("regime"))


@_query("""WITH l AS (SELECT unnest(range(0, 3)) AS i), p(a, b) AS (VALUES ('attn_norm', 'input_layernorm'), ('attn.o_proj', 'self_attn.o_proj'), ('ffn.up_proj', 'mlp.up_proj'))
    SELECT 'blocks.' || i || '.' || a || '.weight' AS name, 'model.layers.' || i || '.' || b || '.weight' AS mapped FROM l, p UNION ALL SELECT 'final_norm.weight', 'model.norm.weight' UNION ALL SELECT 'blocks.0.odd.weight', NULL UNION ALL SELECT 'head', NULL""")
def tensor_names(s, d):
    names = [f"blocks.{i}.{p}.weight" for i in range(3) for p in ("attn_norm", "attn.o_proj", "ffn.up_proj")] + ["final_norm.weight", "blocks.0.odd.weight", "head"]
    return s.createDataFrame([(n,) for n in names], "name string").select("name", reports.tensor_name(F.col("name")).alias("mapped"))


@_query(r"""SELECT source, substr(trim(regexp_replace(replace(arg_min(text, {'o': ordinal, 'd': doc_id}), '"', ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 48) AS opening FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND ordinal IS NOT NULL GROUP BY source""")
def prompt_openings(s, d):
    """The beginning of each source's first document on one line."""
    g = _t(s, d, "documents").where("text is not null and source is not null and ordinal is not null").groupBy("source").agg(F.min_by("text", F.struct("ordinal", "doc_id")).alias("text"))
    return g.select("source", parse.opening(F.col("text")).alias("opening"))


@_query("""WITH x AS (SELECT content_hash, (floor(min(fraction) * 100) + 1) / 100 AS lo, floor(max(fraction) * 100) / 100 AS hi FROM split_rows WHERE fraction IS NOT NULL GROUP BY 1)
    SELECT content_hash, CASE WHEN lo < 0.5 THEN lo END AS raise_to, CASE WHEN hi >= 0.01 THEN hi END AS keep_to FROM x""")
def split_suggestions(s, d):
    return split.suggestions(_t(s, d, "split_rows").where("fraction is not null"), by=("content_hash",)).select("content_hash", F.col("val_fraction_to_raise").alias("raise_to"), F.col("val_fraction_to_keep").alias("keep_to"))


@_query("""WITH e AS (SELECT * FROM events WHERE ts IS NOT NULL) SELECT event_id, strftime(ts, '%H:%M') || '  ' || lower(event_type) || CASE WHEN user_id % 3 > 0 THEN ', ' || (user_id % 40) || '.0C' ELSE '' END ||
    CASE WHEN user_id % 4 = 0 THEN ', humidity unknown' ELSE ', humidity ' || (user_id % 4 * 25) || '%' END || CASE WHEN user_id % 5 = 0 THEN ', wind calm' ELSE ', wind ' || (user_id % 5) || '.0 km/h' END ||
    CASE WHEN user_id % 6 = 0 THEN ', pressure unknown' ELSE ', pressure ' || (1000 + user_id % 6) || '.0 mb' END || CASE WHEN user_id % 2 = 0 THEN ', precip none recorded' ELSE ', precip rain' END AS line FROM e""")
def hourly_lines(s, d):
    """Readings as a line of prose each; zero stands for missing in two of the fields."""
    u = F.col("user_id")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("double")
    row = {"summary": F.col("event_type"), "temperature": parse.number(F.when(u % 3 > 0, text(u % 40)).otherwise("n/a")), "apparent": none, "humidity": parse.nonzero(text((u % 4) / 4)), "speed": parse.number(text(u % 5)), "bearing": none, "visibility": none, "pressure": parse.nonzero(text(F.when(u % 6 > 0, u % 6 + 1000).otherwise(0))), "kind": parse.labelled_kind(F.when(u % 2 == 0, "null").otherwise(" Rain"))}
    return _t(s, d, "events").where("ts is not null").select("event_id", reports.hour(row, F.col("ts"), formats.compass_point).alias("line"))


@_query("""WITH m AS (SELECT vec_id, embedding FROM embeddings), b AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i = 2 AND vec_id % 7 = 0 THEN x + 0.5 ELSE x END) AS e FROM m WHERE vec_id % 10 > 0)
    SELECT vec_id::VARCHAR AS name, CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'differs' ELSE 'ok' END AS state FROM m""")
def export_check(s, d):
    """Weights as they were and as they were read back, some of them changed or gone."""
    a = _t(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("values"), "vec_id")
    b = a.where("vec_id % 10 > 0").withColumn("values", F.transform("values", lambda x, i: F.when((i == 1) & (F.col("vec_id") % 7 == 0), x + 0.5).otherwise(x)))
    return reports.weights_agree(a.drop("vec_id"), b.drop("vec_id"), 1e-9).select("name", "state")


@_query("""WITH k AS (SELECT unnest(['text', 'docx']) AS kind) SELECT list_sort(list(DISTINCT kind)) AS kinds, (SELECT list_sort(list(DISTINCT f.kind)) FROM source_files f JOIN k USING (kind)) AS cuttable FROM source_files""")
def cuttable_kinds(s, d):
    g = _t(s, d, "source_files").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # six kinds
    return g.select("kinds", F.array_intersect("kinds", F.array(F.lit("text"), F.lit("docx"))).alias("cuttable"))


@_query("""WITH s AS (SELECT unnest(range(0, 200)) AS step)
    SELECT 'linear' AS kind, step, round(CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 ELSE 0.0001 + 0.0009 * (1 - (step - 20) / 180) END, 12)::DOUBLE AS lr FROM s
    UNION ALL SELECT 'constant', step, round(CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 ELSE 0.001 END, 12)::DOUBLE FROM s""")
def lr_kinds(s, d):
    each = [planning.schedule(s, 200, 1e-3, 20, 1e-4, kind).select(F.lit(kind).alias("kind"), "step", F.round("lr", 12).alias("lr")) for kind in ("linear", "constant")]
    return each[0].unionByName(each[1])


@_query("""WITH m AS (SELECT content_hash, max(splits['train'].tokens) AS t, max(vocab_size) % 64 + 1 AS b FROM manifests GROUP BY 1)
    SELECT content_hash, greatest(50, least(20000, floor(3.0 * greatest(1, t) / (b * 256))))::BIGINT AS steps FROM m WHERE t IS NOT NULL""")
def default_steps(s, d):
    """Steps of a run that names none: three epochs, within bounds."""
    m = _t(s, d, "manifests").groupBy("content_hash").agg(F.max(F.element_at("splits", "train")["tokens"]).alias("t"), (F.max("vocab_size") % 64 + 1).alias("b")).where("t is not null")
    return m.select("content_hash", planning.default_steps(F.col("t"), F.col("b") * 256).alias("steps"))
