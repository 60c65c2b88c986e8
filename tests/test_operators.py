"""Small, hand-computed cases and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.errors import MillraceError
from millrace.functions import formats, parse, text
from millrace.operators import chat, chunks, prefix, profile, reports, rules, runlog, sampling, split, tokens, windows
from millrace.plans import planning


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def one(df):
    return df.first().asDict()


def test_profile_of_nothing_and_of_odd_characters(spark):
    p = one(profile.corpus(docs(spark, [])))
    assert p["documents"] == 0 and p["duplicate_rate"] == 0.0 and p["mean_chars"] == 0.0
    p = one(profile.corpus(docs(spark, [(1, "a\x1c  b", "s"), (2, None, None), (3, "\x00\x07�😀", None), (4, "\x00\x07�😀", "s")])))
    assert (p["documents"], p["total_chars"], p["whitespace_chars"], p["control_chars"], p["replacement_chars"]) == (3, 13, 3, 5, 2)
    assert (p["non_ascii_chars"], p["unique_documents"], p["sources"]) == (6, 2, 1)


def test_percentile_rounds_half_to_even(spark):
    d = docs(spark, [(i, "x" * n, "s") for i, n in enumerate([1, 2, 3, 4])])
    assert one(profile.percentiles(d)) == {"p10_chars": 1, "median_chars": 3, "p90_chars": 4}


def test_row_shape_ties_take_the_earlier_delimiter_and_fewer_fields(spark):
    d = docs(spark, [(1, "a,b,c\nd;e;f\n\n  \n", "s")])
    assert one(profile.strongest_row_shape(d)) == {"delimiter": ",", "fields": 3, "row_share": 0.5, "sampled_lines": 2}
    assert one(profile.strongest_row_shape(docs(spark, []))) == {"delimiter": None, "fields": 0, "row_share": 0.0, "sampled_lines": 0}


@pytest.mark.parametrize(("change", "code"), [({"documents": 0}, "empty_corpus"), ({"total_chars": 999}, "corpus_too_small"), ({"total_chars": 1_048_575}, "small_corpus"), ({"control_ratio": 0.051}, "likely_binary"), ({"control_ratio": 0.0011}, "control_characters"), ({"median_chars": 31.0}, "very_short_documents"), ({"whitespace_ratio": 0.61}, "mostly_whitespace"), ({"duplicate_rate": 0.51}, "heavy_duplication"), ({"duplicate_rate": 0.21}, "some_duplication"), ({"replacement_chars": 1}, "replacement_characters"), ({"dominant_share": 0.59}, "mixed_scripts"), ({"dominant_script": "han"}, "non_latin_script"), ({"delimiter": ",", "row_share": 0.8, "sampled_lines": 20, "digit_share": 0.4}, "looks_like_a_table"), ({"delimiter": ",", "row_share": 0.8, "sampled_lines": 20, "digit_share": 0.39}, "rows_not_prose"), ({"delimiter": ",", "row_share": 0.8, "sampled_lines": 19}, None), ({"truncated": True}, "duplicate_check_truncated"), ({"nested_archives": 1}, "nested_archives_ignored"), ({"vocab_size": 256, "achieved_vocab": 63}, "vocabulary_saturated"), ({"vocab_size": 20_972, "achieved_vocab": 20_972}, "vocab_too_large_for_corpus")])
def test_each_rule_on_its_edge(spark, change, code):
    base = {"documents": 10, "total_chars": 2_097_152, "control_ratio": 0.001, "delimiter": None, "row_share": 0.0, "sampled_lines": 0, "digit_share": 0.0, "dominant_script": "latin", "dominant_share": 0.6, "n_scripts": 2, "vocab_size": 1, "achieved_vocab": 1, "median_chars": 32.0, "whitespace_ratio": 0.6, "duplicate_rate": 0.2, "truncated": False, "replacement_chars": 0, **{c: 0 for _, _, c in rules.COUNTERS}}
    schema = ", ".join(f"{k} {'string' if k in ('delimiter', 'dominant_script') else 'boolean' if k == 'truncated' else 'double' if 'ratio' in k or 'share' in k or 'rate' in k or 'median' in k else 'long'}" for k in base)
    found = [r["code"] for r in rules.findings(spark.createDataFrame([tuple((base | change).values())], schema)).collect()]
    assert found == ([code] if code else [])


CONVERSATION = [("system", "Be brief."), ("user", "Hi!"), ("assistant", "Hey."), ("assistant", "More?"), ("user", "No")]


def test_conversation_renders_and_comes_back(spark):
    m = [Row(role=r, content=c) for r, c in CONVERSATION]
    df = spark.createDataFrame([(1, m)], "doc_id long, messages array<struct<role:string,content:string>>")
    r = one(chat.render(df))
    assert r["rendered"] == "System: Be brief.\nUser: Hi!\nAssistant: Hey.\nAssistant: More?\n\nUser: No"
    spans = [(s["span_start"], s["span_end"]) for s in r["spans"]]
    assert [r["rendered"][a:b] for a, b in spans] == ["Hey.\n", "More?\n\n"]
    back = chat.turns(spark.createDataFrame([(1, r["rendered"])], "doc_id long, text string")).first()["messages"]
    assert [(x["role"], x["content"].rstrip("\n")) for x in back] == CONVERSATION
    asked = df.select(chat.prompt(F.col("messages")).alias("p")).first()["p"]
    assert asked == r["rendered"] + "\nAssistant:"


@pytest.mark.parametrize(("messages", "why"), [(None, "not_a_list"), ([], "empty"), ([("user", "a")], "no_assistant"), ([("robot", "a")], "unknown_role"), ([(None, "a")], "no_role"), ([("user", None)], "no_content"), ([(" Assistant ", "  ")], "empty_content"), ([(" Assistant ", "x")], None)])
def test_refusals(spark, messages, why):
    df = spark.createDataFrame([(messages,)], "messages array<struct<role:string,content:string>>")
    assert df.select(chat.problem(F.col("messages")).alias("p")).first()["p"] == why


def test_stops_and_held_back(spark):
    df = spark.createDataFrame([("abc\nUser: x\nUs",), ("nothing",)], "t string")
    rows = df.select(chat.earliest_stop(F.col("t"), ("\nUser:", "\nUser")).alias("e"), chat.held_back(F.col("t"), ("\nUser:",)).alias("h")).collect()
    assert (rows[0]["e"]["at"], rows[0]["e"]["stop"], rows[0]["h"]) == (3, "\nUser:", 3) and rows[1]["e"] is None and rows[1]["h"] == 0


def test_chunks_make_the_text_and_prefer_boundaries(spark):
    t = "aaaa bbbb\n\ncccc dddd eeee" * 9
    assert "".join(p for _, p in chunks.cuts(t, 20)) == t
    assert all(len(p) <= 20 for _, p in chunks.cuts(t, 20))
    d = docs(spark, [(1, t, "s"), (2, "", "s"), (3, None, "s"), (4, "y" * 50, "s")])
    rows = chunks.chunk(d, 20).orderBy("doc_id", "piece_no").collect()
    assert "".join(r["piece"] for r in rows if r["doc_id"] == 1) == t
    assert [len(r["piece"]) for r in rows if r["doc_id"] == 4] == [20, 20, 10] and [r["piece"] for r in rows if r["doc_id"] == 2] == [""]


def test_split_is_strict_and_the_same_for_any_partitioning(spark):
    d = docs(spark, [(i, f"text {i % 50}", "s") for i in range(200)])
    f = lambda df: {(r[0], r[1]) for r in df.select("doc_id", split.fraction_blake(7)("text").alias("f")).collect()}
    assert f(d) == f(d.repartition(7))
    assert len({v for _, v in f(d)}) == 50
    x = spark.createDataFrame([(0.05,), (0.049,), (None,)], "f double")
    assert [r[0] for r in x.select(split.side(F.col("f"), 0.05)).collect()] == ["train", "val", None]


def test_exclusive_sums_in_two_levels(spark):
    n = np.random.default_rng(1).integers(0, 9, 500)
    d = spark.createDataFrame([(int(i), int(v), "ab"[i % 2]) for i, v in enumerate(n)], "i long, v long, g string").repartition(5)
    got = {r["i"]: r["s"] for r in prefix.exclusive_sums(d, "i", {"s": "v"}).collect()}
    assert got == {i: int(n[:i].sum()) for i in range(500)}
    got = {r["i"]: r["s"] for r in prefix.exclusive_sums(d, "i", {"s": "v"}, ("g",)).collect()}
    assert got == {i: int(n[i % 2 : i : 2].sum()) for i in range(500)}


def test_run_log_with_torn_boolean_and_equal_losses(spark):
    lines = ['{"event":"train","step":1,"loss":5.0,"tokens":10,"elapsed":1.0}', '{"event":"train","step":2,"loss":true,"tokens":20}', '{"event":"ev', "3", None, '{"event":"eval","step":2,"val_loss":4.0}', '{"event":"eval","step":3,"val_loss":4.0}', '{"event":"eval","step":4,"val_loss":null}', '{"event":"train","step":4,"loss":NaN}']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("r", 0, lines[0])], "run_id string, line_no long, line string")
    assert one(runlog.torn(df)) == {"run_id": "r", "lines": 10, "objects": 6, "unreadable": 4}
    s = one(runlog.summary(runlog.records(df)))
    assert (s["train_records"], s["eval_records"], s["best_val_loss"], s["best_val_step"], s["tokens_seen"]) == (1, 2, 4.0, 2, 10)
    assert [r["improved"] for r in runlog.best_so_far(runlog.records(df)).orderBy("line_no").collect()] == [True, False]


def test_prune_keeps_newest_and_pointed(spark):
    saved = spark.createDataFrame([("r", f"step_{i:03d}", i == 2, i, i) for i in range(6)], "run_id string, name string, is_best boolean, line_no long, step long")
    gone = lambda keep: {r["name"] for r in runlog.pruned(saved, keep).where("removed").collect()}
    assert gone(3) == {"step_000", "step_001", "step_003"} and gone(0) == set() and gone(9) == set()


def test_sampling_ties(spark):
    rows = spark.createDataFrame([(1, t, x) for t, x in enumerate([1.0, 3.0, 3.0, 2.0, 2.0])], "vec_id long, token_id int, logit double")
    assert {r["token_id"] for r in sampling.top_k(rows, 3).collect()} == {1, 2, 3, 4}
    assert one(sampling.greedy(rows))["token_id"] == 1
    assert {r["token_id"] for r in sampling.top_p(rows, 0.4).collect()} == {1, 2}


def test_formats(spark):
    df = spark.createDataFrame([(700,), (3072,), (2_900_000_000,), (451_000_000,), (42,)], "n long")
    assert [r[0] for r in df.select(formats.size(F.col("n"))).collect()][:3] == ["700 B", "3.00 KiB", "2.70 GiB"]
    assert [r[0] for r in df.select(formats.count(F.col("n"))).collect()][3:] == ["451M", "42"]
    d = spark.createDataFrame([(0.0,), (0.125,), (31.0,), (9300.0,), (612000.0,), (None,)], "s double")
    assert [r[0] for r in d.select(formats.duration(F.col("s"))).collect()] == ["0s", "125ms", "31s", "2h 35m", "7d 2h", "unknown"]
    c = spark.createDataFrame([(0.0,), (11.25,), (348.75,), (-90.0,)], "d double")
    assert [r[0] for r in c.select(formats.compass_point(F.col("d"))).collect()] == ["N", "NNE", "N", "W"]


def test_names(spark):
    df = spark.createDataFrame([("a/B.JSONL.gz",), ("x.txt",), ("noext",), (".git/x.md",)], "p string")
    assert [tuple(r) for r in df.select(text.kind(F.col("p")), text.codec(F.col("p")), text.hidden(F.col("p"))).collect()] == [("jsonl", "gz", False), ("text", "none", False), (None, "none", False), ("text", "none", True)]


def test_parameters_of_presets(spark):
    p = planning.parameters(planning.presets(spark).withColumn("vocab_size", F.lit(512))).where("name = 'tiny'").first()
    assert p["ffn_dim"] == 704 and p["parameters"] == 512 * 256 + 4 * (4 * 256 * 256 + 3 * 256 * 704 + 2 * 256) + 256


def test_batches_are_a_function_of_the_step():
    starts = lambda step: windows.starts_of(10_000, 16, 4, step, 5, "train")
    assert starts(3) == starts(3) != starts(4)
    n = (10_000 - 16) // 17
    per_epoch = n // 4
    seen = [s for k in range(per_epoch) for _, s in starts(k)]
    assert len(set(seen)) == len(seen) and max(seen) + 17 <= 10_000


def test_probes_come_back(spark):
    d = spark.createDataFrame(list(enumerate(tokens.PROBES.values())), "doc_id long, text string")
    assert {r["ok"] for r in tokens.round_trips(d).collect()} == {True} and tokens.failed_probes() == [] and len(tokens.PROBES) == 18


def test_windows_and_batches_hold_the_stream(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, "train", t, [(2, 5)] if i % 3 == 0 else None) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, split string, text string, trained_spans array<struct<span_start:int,span_end:int>>").repartition(3)
    stream = windows.checked_masks(windows.byte_stream(d))
    ids = [x for t in texts for x in [*(b + 3 for b in t.encode()), windows.END]]
    got = windows.sequential(stream, 16).orderBy("window").collect()
    assert [r["inputs"] + r["targets"][-1:] for r in got] == [ids[i : i + 17] for i in range(0, len(ids) - 16, 17)]
    assert all(r["inputs"][1:] == r["targets"][:-1] and len(r["target_mask"]) == 16 for r in got)
    b = windows.batch(stream, 16, 4, 2, seed=9).orderBy("row").collect()
    assert [r["inputs"] + r["targets"][-1:] for r in b] == [ids[r["start"] : r["start"] + 17] for r in b] and len(b) == 4
    t = {i: r for i, r in enumerate(stream.orderBy("doc_id").collect())}
    want = [int(any(2 <= k < 5 for k in [j])) for j, c in enumerate(texts[0]) for _ in c.encode()]
    assert t[0]["mask"][:-1] == want and t[1]["mask"] == [1] * len(t[1]["ids"])
    for args in ((1, 4, 0), (16, 0, 0), (16, 10_000, 0)):
        with pytest.raises(MillraceError):
            windows.batch(stream, *args, seed=9)
    assert windows.masks_used("whole", None) and not windows.masks_used("none", None) and not windows.masks_used("whole", False)
    with pytest.raises(MillraceError):
        windows.masks_used("none", True)


def test_values_as_people_write_them(spark):
    said = ["2h5m", "1.5d", " 7 ", "0", "-3", "3 weeks", "", "10m 4x", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i")
    assert [r[0] for r in d.select(parse.seconds(F.col("t"))).collect()] == [7500.0, 129600.0, 420.0, None, None, None, None, None, None]
    sizes = ["3", "1,024kb", "2TiB", "5b", "-1g", "x", "1g 5m"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(sizes)], "i int, t string").orderBy("i")
    assert [r[0] for r in d.select(parse.bytes_of(F.col("t"))).collect()] == [3 << 30, 1 << 20, 2 << 40, 5, None, None, None]
    with pytest.raises(MillraceError) as e:
        parse.choice("fp61", ["fp16", "fp32", "bf16"], "precision")
    assert e.value.exit_code == 2 and "fp16?" in e.value.hint and parse.nearest("gpu", ["cpu", "xpu"], 0.7) is None
    assert [parse.json_shown(x) for x in (None, True, "four", list(range(40)), {"a": 1})] == ["null", "true", '"four"', "an array", '{"a": 1}']


def test_history_is_fitted_by_whole_messages(spark):
    turns = [("user", "aaaa"), ("assistant", "bbbb"), ("user", "cccc"), ("assistant", "dddd"), ("user", "eeee")]
    d = spark.createDataFrame([([(r, c) for r, c in turns],)], "m array<struct<role:string,content:string>>")
    size = lambda m: F.aggregate(m, F.lit(0), lambda n, x: n + F.length(x["content"]))
    assert [d.select(reports.fitted(F.col("m"), size, n)).first()[0] for n in (20, 19, 12, 11, 4, 1)] == [0, 2, 2, 4, 4, 4]
    more = d.select(reports.extended(reports.remembered(F.col("m"), F.lit("q"), F.lit("a")), F.lit("!")).alias("m"), reports.remembered(F.col("m"), F.lit("q"), F.lit(" ")).alias("n")).first()
    assert [tuple(x) for x in more["m"]][-2:] == [("user", "q"), ("assistant", "a!")] and len(more["n"]) == 5
    assert spark.range(1).select(chat.reply_content(F.lit(" said so\n\n"))).first()[0] == "said so"


def test_quantities_below_zero_and_whole(spark):
    d = spark.createDataFrame([(-3072.0,), (-5.0,), (2.5,), (1234567.5,)], "n double")
    got = [tuple(r) for r in d.select(formats.size(F.col("n")), formats.whole(F.col("n"))).collect()]
    assert got == [("-3.00 KiB", "-3,072"), ("-5 B", "-5"), ("2 B", "2"), ("1.18 MiB", "1,234,568")]


def test_prefix_sums_with_an_id_far_from_the_others(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS", 5)
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9)) for i in [*rng.sample(range(1000), 300), 10**15]]
    df = spark.createDataFrame(rows, "i long, g string, n long").repartition(4)
    got = {r["i"]: r["before"] for r in prefix.exclusive_sums(df, "i", {"before": "n"}, ("g",)).collect()}
    assert got == {i: sum(m for j, h, m in rows if h == g and j < i) for i, g, n in rows}
