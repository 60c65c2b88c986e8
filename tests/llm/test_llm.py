"""The operators against brute force, round trips and held-out labels, and on nulls, ties, repeated and missing rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import common, copies, encoding, language, langcodes, mixing, near, overlap, packing, queries, splitting, subjects, textvec

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOC = "doc_id long, text string, lang string, source string, byte_offset long, trained_spans array<struct<span_start:int,span_end:int>>, a long, key string, segment int"


def docs(spark, texts, lang="en", source="s.txt"):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, lang, source, 0, None, 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def sentence(rng, n=9):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and letterless texts, a very long one without spaces, ties, a row twice."""
    d = docs(spark, [None, "", "   ", "!?", "one", "x" * 60_000, "Same text here, twice over.", "same TEXT here twice over", "😀 é 日本語"])
    return d.unionByName(d.where("doc_id = 6")).unionByName(docs(spark, [None]).selectExpr("cast(null as bigint) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) byte_offset", "trained_spans", "a", "key", "segment"))


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).limit(0)


def test_word_hashes_are_the_same_everywhere():
    texts = ["Ab cd-ef", "", "cd", "É1 ab"]
    w = textvec.words(texts)
    by = defaultdict(set)
    for h, d, s, e in zip(w.hash, w.doc, w.start, w.end):
        by["".join(map(chr, w.codes[s:e]))].add(int(h))
    assert {k: len(v) for k, v in by.items()} == {"ab": 1, "cd": 1, "ef": 1, "é1": 1} and w.doc.tolist() == [0, 0, 0, 2, 3, 3]
    alone = textvec.words(["ab"])
    assert int(alone.hash[0]) in by["ab"]
    h, doc, first = textvec.ngrams(w.hash, w.doc, 2)
    assert doc.tolist() == [0, 0, 3]


def test_maybe_in_loses_nothing(spark):
    df = spark.range(10_000)
    keys = spark.range(0, 10_000, 37).toDF("k")
    got = {r[0] for r in common.maybe_in(df, "id", keys).collect()}
    assert got >= set(range(0, 10_000, 37)) and len(got) < 3_000


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (30, 1), *((i, i + 1) for i in range(100, 160))]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 8: 8, 9: 8, **{i: 100 for i in range(100, 161)}}


# --- 4: copies


def test_copies(spark, odd, none):
    assert {tuple(r) for r in copies.copies(odd).collect()} == {(6, 6), (6, 7)}
    assert {tuple(r) for r in copies.records(odd).collect()} == {(4, 1), (5, 1), (6, 2), (8, 1)}
    assert copies.copies(none).count() == 0 and copies.records(none).count() == 0


def test_records_in_any_order_and_form(spark):
    d = docs(spark, ["Title: The A\nPlace: B-1", "place:  b1 \n\nTITLE: the a!", '{"Place": "B 1", "Title": "The \\u0041"}', "Title: B1\nPlace: the a", "title the a place b1", "User: a\nAssistant: b", "Assistant: b\nUser: a", "STRASSE eins", "straße eins"])
    assert {tuple(r) for r in copies.copies(d).collect()} == {(0, 0), (0, 1), (0, 2), (0, 4), (7, 7), (7, 8)}


def test_fields_of_nested_objects_in_any_order(spark):
    d = docs(spark, ['{"b": {"c": 1, "d": [1, 2]}, "a": 0}', '{"a": 0, "b": {"d": [1, 2], "c": 1}}', '{"a": 0, "b": {"d": [2, 1], "c": 1}}', "A rather long name of a field that goes on and on until it has over sixty characters: 1\nb: 2", "b: 2\nA rather long name of a field that goes on and on until it has over sixty characters: 1"])
    assert {tuple(r) for r in copies.copies(d).collect()} == {(0, 0), (0, 1), (3, 3), (3, 4)}


def test_filters_of_any_size_and_trees_of_any_width(spark, monkeypatch):
    keys = spark.range(0, 5_000, 37).toDF("k")
    assert common.maybe_in(spark.range(5_000), "id", keys, most_words=1).count() == 5_000  # too many keys: the join that follows decides
    counts = spark.createDataFrame([(p, s, near.zlib.compress(np.full(near.SEGMENT, p + s, np.uint32).tobytes())) for p in range(11) for s in range(2)], "part int, segment int, counts binary")
    got = {r["segment"]: np.frombuffer(near.zlib.decompress(r["counts"]), np.uint32) for r in near.merged(counts, fan=2).collect()}
    assert (got[0] == 55).all() and (got[1] == 66).all()


def test_rounds_of_the_filter_change_nothing(spark, monkeypatch):
    texts = [f"text {i % 300}" for i in range(900)] + [f"only {i}" for i in range(500)]
    want = {tuple(r) for r in copies.copies(docs(spark, texts)).collect()}
    monkeypatch.setattr(copies, "ROUND_BLOCKS", 50)
    assert {tuple(r) for r in copies.copies(docs(spark, texts).repartition(5)).collect()} == want and len(want) == 900


# --- 5 and 2: near-duplicates, overlaps


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [sentence(rng, 1)[:-1].lower()]
    return " ".join(w)


def jaccard(a, b, n=near.SHINGLE):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (WORD.findall(t.lower()) for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def variants():
    rng = random.Random(4)
    out = []
    for _ in range(60):
        base = " ".join(sentence(rng) for _ in range(rng.randint(1, 12)))
        out += [base, base.upper(), *(edited(rng, base, k) for k in (1, 2, 4, 7))]
    return out


def test_near_duplicates_against_brute_force(spark, variants):
    d = docs(spark, variants)
    group = {i: g for g, i in ((r["group_id"], r["doc_id"]) for r in copies.copies(d).collect())}
    want = {(i, j) for i in range(len(variants)) for j in range(i + 1, len(variants)) if group.get(i, -1) != group.get(j, -2) and jaccard(variants[i], variants[j]) >= near.SIMILARITY}
    assert {tuple(r) for r in near.pairs(d).collect()} == want and len(want) > 100


def hot(rng, copies=160, bases=14, others=320):
    """A text that holds a third of the rows with its copies, its variants edited all over, and unlike texts."""
    words = sentence(rng, 160)[:-1].lower().split()
    out = [" ".join(words)] * copies
    for k in range(bases):
        w = list(words)
        for i in range(k, len(w), 12 + k % 5):
            w[i] = sentence(rng, 1)[:-1].lower() + "q"
        out.append(" ".join(w))
    return out + [sentence(rng, 40) for _ in range(others)]


def test_variants_of_a_text_with_many_copies(spark):
    texts = hot(random.Random(2))
    edits = range(160, 174)
    want = {(i, j) for j in edits for i in range(160) if jaccard(texts[0], texts[j]) >= near.SIMILARITY} | {(i, j) for i in edits for j in edits if i < j and jaccard(texts[i], texts[j]) >= near.SIMILARITY}
    assert {tuple(r) for r in near.pairs(docs(spark, texts)).collect()} == want and len(want) > 1_000


def test_documents_of_a_template(spark):
    rng = random.Random(3)
    common_part = sentence(rng, 150)
    texts = [f"{common_part} {sentence(rng, 44)}" for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if jaccard(texts[i], texts[j]) >= near.SIMILARITY}
    assert len({tuple(r) for r in near.pairs(docs(spark, texts)).collect()} & want) >= 0.99 * len(want) and len(want) == 780


def test_unlike_texts_of_a_template_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(12)
    common = sentence(rng, 80)
    texts = [f"{common} {sentence(rng, 120)}" for _ in range(200)]  # similarity 0.24: 19,900 pairs, all below 0.6
    seen = []
    verified = near.verified
    monkeypatch.setattr(near, "verified", lambda d, c, pairs, *more: seen.append(pairs.count()) or verified(d, c, pairs, *more))
    assert near.pairs(docs(spark, texts)).count() == 0 and 0.15 < jaccard(texts[0], texts[1]) < 0.3
    assert seen[0] < 20  # 4 % of them before


def test_tables_that_nothing_reads_are_removed(spark, variants):
    before = len(common._paths)
    near.candidates(docs(spark, variants), np.zeros(near.SKETCH, np.uint8), plain=0.6)
    assert len(common._paths) == before + 1


def test_pairs_come_from_weighted_samples(spark, monkeypatch, variants):
    seen = []
    candidates = near.candidates
    monkeypatch.setattr(near, "candidates", lambda d, levels, *more: seen.append(levels) or candidates(d, levels, *more))
    near.pairs(docs(spark, variants))
    assert len(np.unique(seen[0])) > 1  # frequent and rare shingles have different weights


def test_damped_weights_keep_plain_similarity():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    a, b = (np.sort(s) for s in (h[:4000], h[1000:]))  # plain similarity 0.6
    for common, own in ((0, near.LEVELS - 1), (near.LEVELS - 1, 0)):
        lev = lambda s: np.where(np.isin(s, h[1000:4000]), common, own)  # noqa: B023,E731
        x, y = (near.samples(s, np.array([0]), lev(s), damped=True)[0] for s in (a, b))
        assert len(x) == near.PLAIN_BANDS * near.ROWS and abs((x == y).mean() - 0.6) < 0.17
    bound = near.SIMILARITY / (near.SIMILARITY + near.RANGE * (1 - near.SIMILARITY))
    assert 1 - (1 - bound**near.ROWS) ** near.PLAIN_BANDS > 0.9996


def test_plain_samples_estimate_plain_similarity():
    h = np.sort(np.random.default_rng(3).integers(0, 2**63, 4000).astype(np.uint64))
    x, y = (near.plain_samples(s, np.array([0]))[0] for s in (h[:3000], h[1000:]))
    assert abs((x == y).mean() - 0.5) < 0.2


def test_near_duplicates_of_odd_rows(spark, odd, none):
    assert near.pairs(odd).count() == 0 and near.pairs(none).count() == 0 and near.groups(none).count() == 0
    g = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.groups(odd).collect()}
    assert g == {6: (6, 0), 7: (6, 0)}


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    lev = np.zeros(near.SKETCH, np.uint8) + np.uint8(12)
    a, b = h[:300], h[100:]
    x, y = (near.samples(s, np.array([0]), near.level(s, np.ones(len(s), np.int64), lev))[0] for s in (a, b))
    assert abs((x == y).mean() - 0.5) < 0.2


def test_overlaps_against_brute_force(spark, variants):
    rng = random.Random(8)
    sets = {"h1": 0.3, "h2": 0.0, "h3": None}
    rows = [(h, i, None if rng.random() < 0.05 else rng.random()) for i in range(len(variants)) for h in ("h1", "h2", "h3", "h4") if rng.random() < 0.7]
    split_rows = spark.createDataFrame(rows + rows[:20], "content_hash string, doc_id long, fraction double")
    manifests = spark.createDataFrame([*sets.items(), ("h1", 0.3)], "content_hash string, val_fraction double")
    d = docs(spark, variants)
    group = {i: g for g, i in ((r["group_id"], r["doc_id"]) for r in copies.copies(d).collect())}
    side = {i: f < 0.3 for h, i, f in rows if h == "h1" and f is not None}
    want = {("h1", i, j) for i in side for j in side if i < j and side[i] != side[j] and (group.get(i, -1) == group.get(j, -2) or jaccard(variants[i], variants[j]) >= overlap.SIMILARITY)}
    found = overlap.find(d, split_rows, manifests)
    assert {tuple(r) for r in overlap.pairs(found).collect()} == want and len(want) > 100
    named = {(r["doc_id"], r["split"]): r for r in overlap.records(found).collect() if r["content_hash"] == "h1"}
    assert {(k, "val" if side[k] else "train") for _, i, j in want for k in (i, j)} <= set(named)
    per = overlap.report(found, d).where("content_hash = 'h1'").collect()
    assert sum(r["n_documents"] for r in per) == len(named) and sum(r["n_alike"] for r in per) >= len({k for _, i, j in want for k in (i, j)})


def across(spark, texts, val):
    """The pairs found and those of brute force: texts in val, the others in train."""
    s = spark.createDataFrame([("h", i, 0.05 if i in val else 0.5) for i in range(len(texts))], "content_hash string, doc_id long, fraction double")
    found = overlap.pairs(overlap.find(docs(spark, texts), s, spark.createDataFrame([("h", 0.1)], "content_hash string, val_fraction double")))
    plain = ["".join(WORD.findall(t.lower())) for t in texts]
    want = {("h", min(i, j), max(i, j)) for i in val for j in set(range(len(texts))) - val if plain[i] == plain[j] or jaccard(texts[i], texts[j]) >= overlap.SIMILARITY}
    return {tuple(r) for r in found.collect()}, want


def test_overlaps_of_a_text_with_many_copies(spark):
    found, want = across(spark, hot(random.Random(2), 100, 14, 60), set(range(100, 110)))
    assert found == want and len(want) == 900


def test_overlaps_of_texts_that_repeat_themselves(spark):
    rng = random.Random(6)
    texts = []
    for words, times in ((5, 10), (10, 25), (10, 60), (4, 40)):
        line = sentence(rng, words)[:-1].lower()
        texts += [f"{line} " * times, f"{line} " * times + sentence(rng, 2)[:-1].lower(), f"{line} " * (times - 1)]
    found, want = across(spark, texts, {0, 3, 6, 9})
    assert found == want and len(want) == 8


def test_overlaps_of_odd_rows(spark, odd, none):
    s = spark.createDataFrame([("h", i, 0.05 if i % 2 else 0.5) for i in range(10)] + [("h", None, 0.1), (None, 3, 0.2)], "content_hash string, doc_id long, fraction double")
    m = spark.createDataFrame([("h", 0.1)], "content_hash string, val_fraction double")
    assert {tuple(r) for r in overlap.pairs(overlap.find(odd, s, m)).collect()} == {("h", 6, 7)}
    for d, rows in ((none, s), (odd, s.limit(0))):
        found = overlap.find(d, rows, m)
        assert overlap.overlaps(found).count() == 0 and overlap.records(found).count() == 0


def test_a_record_inside_another_and_one_spread_over_two(spark):
    rng = random.Random(1)
    words = [w for _ in range(60) for w in sentence(rng, 100)[:-1].lower().split()]
    inner = words[:300]
    texts = [" ".join(inner), " ".join(words[1000:1850] + inner + words[2000:2850]), " ".join(words[300:500] + words[3000:3100]), " ".join(words[300:500] + words[4000:4600]), " ".join(words[3000:3100] + words[4700:5600]), sentence(rng, 80)]
    s = spark.createDataFrame([("h", i, 0.05 if i in (0, 2, 5) else 0.5) for i in range(6)], "content_hash string, doc_id long, fraction double")
    found = overlap.find(docs(spark, texts), s, spark.createDataFrame([("h", 0.1)], "content_hash string, val_fraction double"))
    rows = {(r["val_id"], r["train_id"]): r for r in overlap.overlaps(found).collect()}
    assert rows[0, 1]["val_coverage"] == 1.0 and rows[0, 1]["similarity"] < 0.2 and rows[2, 3]["val_coverage"] == pytest.approx(2 / 3)
    per = {r["doc_id"]: r["coverage"] for r in overlap.records(found).collect()}
    assert per[0] == 1.0 and per[2] > 0.9 and 5 not in per and per[1] == pytest.approx(300 / 2000)


def test_every_shared_span_of_20_words_counts_wherever_it_lies(spark):
    rng = random.Random(5)
    texts, val = [], {}
    for k in range(40):  # pairs of 38 words that share 20 of them, at any place of either, and nothing else
        common = sentence(rng, 20)[:-1].lower()
        for side in (0.0, 0.5):
            n = rng.randint(0, 18)
            val[len(texts)] = side
            texts.append(f"{sentence(rng, n)[:-1].lower() if n else ''} {common} {sentence(rng, 18 - n)[:-1].lower() if n < 18 else ''}".strip())
    s = spark.createDataFrame([("h", i, f) for i, f in val.items()], "content_hash string, doc_id long, fraction double")
    found = overlap.find(docs(spark, texts), s, spark.createDataFrame([("h", 0.1)], "content_hash string, val_fraction double"))
    rows = {(r["val_id"], r["train_id"]): r["val_coverage"] for r in overlap.overlaps(found).collect()}
    assert set(rows) == {(i, i + 1) for i in range(0, 80, 2)} and set(rows.values()) == {20 / 38}
    assert {r["coverage"] for r in overlap.records(found).collect()} == {20 / 38} and overlap.records(found).count() == 80


def test_a_passage_that_several_have_names_all_of_them(spark):
    rng = random.Random(6)
    common = sentence(rng, 40)[:-1]
    texts = [f"{common} {sentence(rng, 20)}", *(f"{sentence(rng, 100)} {common} {sentence(rng, 100)}" for _ in range(4))]
    s = spark.createDataFrame([("h", i, 0.5 if i else 0.0) for i in range(5)], "content_hash string, doc_id long, fraction double")
    found = overlap.find(docs(spark, texts), s, spark.createDataFrame([("h", 0.1)], "content_hash string, val_fraction double"))
    assert {(r["val_id"], r["train_id"]) for r in overlap.overlaps(found).collect()} == {(0, i) for i in range(1, 5)}


def test_every_long_shared_span_has_a_chosen_suffix():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    n = overlap.PREFIX + overlap.WINDOW - 1
    for at in range(0, 360, 7):
        b[100 : 100 + n] = a[at : at + n]
        h = np.concatenate((a, b))
        key, doc, pos = overlap.chosen(h, np.repeat([0, 1], [400, 500]))
        left = {(k, p - at) for k, d, p in zip(key.tolist(), doc, pos) if d == 0}
        assert left & {(k, p - 100) for k, d, p in zip(key.tolist(), doc, pos) if d == 1}
    alone = overlap.chosen(b, np.zeros(500, np.int64))
    assert (alone[2] == pos[doc == 1]).all()  # what is chosen in a text doesn't depend on its neighbours


def test_joint_suffix_array():
    v, t = np.arange(40, dtype=np.uint32), np.concatenate((np.arange(5, 27), [90, 91])).astype(np.uint32)
    s, cv, ct = overlap.shared(v, t)
    assert s == 20 / (38 + 22 - 20) and cv == [(5, 27)] and ct == [(0, 22)]
    assert overlap.shared(v, t, span=23)[1:] == ([], [])
    assert overlap.shared(v, v)[0] == 1.0 and overlap.shared(v[:2], t[:2]) == (0.0, [], [])


# --- 6: splitting


@pytest.mark.parametrize(("text", "name"), [("a. b.\n\n" * 3000, "paragraph"), ("some words here. " * 900, "sentence"), ("word " * 3000, "word"), ("x" * 20_000, "none"), ("é" * 9_000, "none"), ("\n\n".join(["p" * 8192, "q" * 8192]), "paragraph"), ("p" * 8193 + "\n\nq", "none")])
def test_pieces_cover_the_text(text, name):
    found, boundary = splitting.pieces(text)
    assert boundary == name
    whole, before = "", 0
    for k, (s, e, d) in enumerate(found):
        assert len(text[s:e].encode()) <= 8192 and s <= d == before
        assert k == 0 or len(text[s:d].encode()) <= 200 and (len(text[s:d].encode()) >= 90 or len(text[d:e].encode()) > 8192 - 110)
        whole, before = whole + text[d:e], e
    assert whole == text


def test_units_that_fit_stay_whole():
    text = "\n\n".join(("word " * 1700)[:8099] for _ in range(3))
    found, boundary = splitting.pieces(text)
    assert boundary == "paragraph" and [text[d:e].strip() for _, e, d in found] == [p.strip() for p in text.split("\n\n")]
    assert all(len(text[s:e].encode()) <= 8192 for s, e, _ in found)


def test_splitting_of_odd_rows(spark, odd, none):
    rows = splitting.split(odd).orderBy("piece_no").collect()
    assert {r["doc_id"] for r in rows} == {5} and rows[1]["byte_offset"] == rows[1]["text_offset"] > 0
    assert splitting.split(none).count() == 0
    j = splitting.split(docs(spark, ["x " * 9000], source="a.json.gz")).collect()
    assert {r["byte_offset"] for r in j} == {0} and len(j) > 2


# --- 7: packing


def test_packing_keeps_all_limits(spark, odd, none):
    rng = random.Random(5)
    spans = [[(0, 5)], [], None]
    rows = [(i, "y" * rng.randint(0, 900), "en", "s", 0, rng.choice(spans), 1, "k", 1) for i in range(800)] + [(900, "z" * 5000, "en", "s", 0, None, 1, "k", 1)]
    d = spark.createDataFrame(rows, DOC)
    plans = spark.createDataFrame([("a", 1000), ("b", 4096), ("b", 4096), ("c", None), (None, 5), ("e", 0)], "plan_id string, capacity_tokens int")
    got = packing.pack(d, plans, loss_share=0.9)
    held = packing.containers(got, plans).collect()
    assert all(r["tokens"] <= {"a": 1000, "b": 4096}[r["plan_id"]] and r["n_segments"] <= {"a": 31, "b": 128}[r["plan_id"]] for r in held)
    per = Counter()
    for r in got.collect():
        per[r["plan_id"], r["doc_id"]] += r["tokens"]
    assert per == {(p, r[0]): len(r[1]) + 1 for p in "ab" for r in rows}
    assert {tuple(r) for r in packing.oversized(got).collect()} == {("a", 900), ("b", 900)}
    full = packing.containers(packing.pack(d, plans), plans).groupBy("plan_id").avg("fill").collect()
    assert min(r[1] for r in full) > 0.97
    assert packing.pack(none, plans).count() == 0 and packing.pack(d, plans.limit(0)).count() == 0
    assert packing.pack(odd, plans).where("plan_id = 'b' and doc_id = 6").count() == 2


def test_packing_with_three_limits_that_bind():
    rng = np.random.default_rng(4)
    tokens = rng.integers(20, 900, 3000)
    loss = (tokens * rng.choice([0.0, 0.4, 1.0], 3000)).astype(np.int64)
    boxes = packing.fill(tokens, loss, 2000, 5, 1100)
    assert sorted(i for b in boxes for i in b) == list(range(3000))
    t, n, q = (np.array(x) for x in ([tokens[b].sum() for b in boxes], [len(b) for b in boxes], [loss[b].sum() for b in boxes]))
    assert t.max() <= 2000 and n.max() <= 5 and q.max() <= 1100
    assert (n == 5).sum() > 50 and (q > 1000).sum() > 50 and (t > 1950).sum() > 50
    assert len(boxes) <= 1.12 * max(tokens.sum() / 2000, 3000 / 5, loss.sum() / 1100)
    lone = packing.fill(np.array([900, 500, 90]), np.array([900, 0, 90]), 1000, 9, 300)  # beyond the limit by itself
    assert sorted(map(sorted, lone)) == [[0], [1, 2]]


# --- 8: mixing


def test_mixture_reaches_shares_and_caps(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, "w" * rng.randint(20, 400), "en", "big" if i % 3 else f"s{i % 7}", 0, None, 1, "k", 1) for i in range(3000)]
    d = spark.createDataFrame(rows, DOC)
    have = Counter()
    for r in rows:
        have[r[3]] += len(r[1]) + 1
    total = 300_000
    targets = spark.createDataFrame([("r", "big", 0.5, 2, total), ("r", "s0", 0.3, 3, total), ("r", "s3", 0.2, 1, total), ("r", "gone", 0.0001, 9, total), ("r", "big", 0.5, 2, total), (None, "big", 0.1, 1, 5), ("x", None, 0.1, 1, 5)], "recipe_id string, source string, target_share double, max_repeats int, total_tokens long")
    uses, shares = mixing.mix(d, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert len(got) == 4 and not got["gone"]["reached"]
    for s, share, cap in (("big", 0.5, 2), ("s0", 0.3, 3), ("s3", 0.2, 1)):
        want = min(share * total, cap * have[s])
        assert abs(got[s]["tokens"] - want) < 401 and got[s]["most_uses"] <= cap and got[s]["reached"] == (cap * have[s] >= share * total)
    u = uses.collect()
    assert len({(r["doc_id"], r["use_no"]) for r in u}) == len(u)
    per = defaultdict(list)
    for r in u:
        per[r["shard"]].append(r["position"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert mixing.mix(none, targets)[0].count() == 0 and mixing.mix(odd, targets.limit(0))[1].count() == 0


def test_leaves_share_the_quotas_out():
    q = np.array([100, 3, 57])
    parts = [mixing.leaf(1, q, 9, k) for k in range(9)]
    assert (parts[0][0] == 0).all() and (parts[-1][1] == q).all()
    assert all((a[1] == b[0]).all() for a, b in zip(parts, parts[1:]))


# --- 3: encodings


@pytest.mark.parametrize("channel", ["utf-8>cp1252", "utf-8>cp1252 twice", "utf-8>cp850", "cp1252>mac_roman", "utf-8>latin-1"])
def test_encodings_come_back(spark, channel):
    rng = random.Random(7)
    words = ["über", "größe", "später", "müde", "fällt", "schön", "würde", "natürlich", "—", "„so“", "hören", "das", "ist", "ein", "Haus"]
    clean = [" ".join(rng.choice(words) for _ in range(25)) + f" {sentence(rng)}" for _ in range(80)]
    broken = {i: clean[i][:40] + encoding.damaged(clean[i][40:], channel) for i in (3, 40)}
    d = docs(spark, [broken.get(i, t) for i, t in enumerate(clean)] + ['It prints "Ã¼" here.', "It prints “�” here.", "f�r immer"])
    got = {r["doc_id"]: r["restored_md5"] for r in encoding.repaired(d).collect()}
    assert got == {**{i: hashlib.md5(clean[i].encode()).hexdigest() for i in broken}, 82: ""}


def test_lattices_of_bytes_with_wildcards():
    lost = encoding.LOST
    for word, gone in (("größe", 3), ("größe", 5), ("naïve", 2), ("日本語", 4)):
        data = list(word.encode())
        data[gone] = None
        assert [a if a == b else lost for a, b in zip(word, encoding.lattice(data))] == list(encoding.lattice(data)) and encoding.lattice(data).count(lost) == 1
    assert encoding.lattice(list("für".encode())) == "für" and encoding.lattice([0xC3]) == lost
    assert encoding.pattern("gr\u00c3\u00b6\u00c3\ufffde", "utf-8>cp1252") == f"grö{lost}e"


def test_lost_characters_that_the_corpus_determines(spark):
    rng = random.Random(7)
    words = ["über", "größe", "später", "müde", "schön", "natürlich", "das", "ist", "ein", "Haus", "mäuse", "mause"]
    clean = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(60)]
    lost = ["das ist sp\ufffdter sch\ufffdn", "das gr\u00c3\u00b6\u00c3\ufffde ist nat\u00c3\u00bcrlich m\u00c3\u00bcde \u00c3\u00bcber", "m\ufffduse und xy\ufffdz"]
    got = {r["doc_id"]: (r["restored"], r["restored_md5"]) for r in encoding.repaired(docs(spark, clean + lost)).collect()}
    assert got == {60: ("das ist später schön", ""), 61: ("das größe ist natürlich müde über", ""), 62: ("mäuse und xy\ufffdz", "")}


def test_encodings_of_odd_rows(odd, none):
    assert encoding.repaired(odd).count() == 0 and encoding.repaired(none).count() == 0


def test_a_garbled_group_that_holds_a_third_of_the_rows(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeéèüößñç") for _ in range(6)) + "é"
    known = [word() for _ in range(40)]
    clean = [" ".join(rng.choice(known) for _ in range(12)) for _ in range(40)]
    source = [encoding.damaged(" ".join(rng.choice(known) for _ in range(12)), "utf-8>latin-1") for _ in range(20)]
    d = docs(spark, clean + source + [source[0]] * 30)
    got = {r["doc_id"]: r["restored_md5"] for r in encoding.repaired(d).collect()}
    want = {40 + i: hashlib.md5(encoding.mended(t, "utf-8>latin-1").encode()).hexdigest() for i, t in enumerate(source + [source[0]] * 30)}
    assert got == want


@pytest.mark.parametrize("name", list(encoding.channels()))
def test_every_channel_has_an_inverse(name):
    for text in ("für größe", "привет", "zażółć"):
        x = encoding.damaged(text, name)
        assert x is None or encoding.mended(x, name) == text


# --- 1: languages


def test_languages_held_out(spark, odd, none):
    lines = {"de": "der hund und die katze sind nicht im haus weil es heute sehr warm ist", "en": "the dog and the cat are not in the house because it is very warm today", "fr": "le chien et le chat ne sont pas dans la maison parce que il fait chaud", "ru": "собака и кошка не дома потому что сегодня очень тепло на улице"}
    rng = random.Random(9)
    say = lambda c: " ".join(rng.sample(lines[c].split(), 9)).capitalize() + ". "
    rows = [(i, "".join(say(c) for _ in range(5)), c, "s", 0, None, 1, "k", 1) for i, c in enumerate(list(lines) * 20)]
    p = language.fit(spark.createDataFrame(rows, DOC))
    odd_ones = [(200, say("de") + say("de") + say("fr"), "de", "s", 0, None, 1, "k", 1), (201, say("en") * 3, "EN_gb", "s", 0, None, 1, "k", 1), (202, say("en") * 3, "und", "s", 0, None, 1, "k", 1), (203, say("ru") * 3, "fr", "s", 0, None, 1, "k", 1), (204, encoding.damaged(say("ru") * 3, "utf-8>cp1252"), "Russian", "s", 0, None, 1, "k", 1), (205, "12 34", None, "s", 0, None, 1, "k", 1)]
    found = language.stretches(spark.createDataFrame(odd_ones, DOC), p)
    assert {tuple(r) for r in language.mislabelled(found).collect()} == {(200, 0, "de"), (200, 1, "fr"), (202, 0, "en"), (203, 0, "ru")}
    assert {r["doc_lang"] for r in found.where("doc_id = 204").collect()} == {"ru"}
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    assert {r["doc_id"] for r in language.stretches(odd, p).collect()} == {4, 5, 6, 7, 8}
    other = language.stretches(docs(spark, ["这是一段关于天气的中文文本。", "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό.", say("fr")], lang="en"), p)
    assert [(r["lang"], r["doc_lang"]) for r in other.orderBy("doc_id").collect()] == [("und", "und"), ("und", "und"), ("fr", "fr")]
    assert language.stretches(none, p).count() == 0 and {r["lang"] for r in language.stretches(odd, language.fit(none)).collect()} == {"und"}


def test_long_sentences_are_compared_whole():
    words = sentence(random.Random(5), 900).lower()
    h, sent, doc, *_ = language.grams([words])
    tops = [np.unique(h)[::-1][:language.PLACES]] + [np.zeros(0, np.uint64)] * (len(language.CODES) - 1)
    p = language.ranked(tops)
    got, share = p.distances(h, sent, len(doc))
    place = {int(g): i for i, g in enumerate(tops[0])}
    counts = Counter(int(x) for x in h if int(x) in place)
    order = sorted(counts, key=lambda g: (-counts[g], p.ids(np.array([g], np.uint64))[0]))
    assert len(order) > 600 and got[0, 0] == pytest.approx(sum(min(1, abs(place[g] - i) / language.PLACES) for i, g in enumerate(order)), rel=1e-3)
    assert share[0] == pytest.approx(sum(counts.values()) / len(h))


@pytest.mark.parametrize(("lang", "code"), [("en-US", "en"), ("deu", "de"), ("German", "de"), ("PT", "pt"), ("es-419", "es"), ("und", None), ("", None), (None, None), ("ca", None)])
def test_names_of_languages(spark, lang, code):
    assert langcodes.normal(lang) == code
    assert spark.createDataFrame([(lang,)], "lang string").select(language.code()).first()[0] == code


# --- 9: subjects


def test_subjects_held_out(spark, odd, none):
    rng = random.Random(10)
    topic = {"law": "court judge claim appeal contract", "food": "oven butter dough salt recipe", "sport": "match goal team coach referee"}
    filler = "the a was in of and for with on at yesterday people saw it there".split()
    say = lambda s: " ".join(rng.sample(filler, 6) + rng.sample((topic[s] if s else "went home late again alone").split(), 3)).capitalize() + ". "
    truth, rows, labels = {}, [], []
    for i in range(420):
        s = list(topic)[i % 3]
        other = rng.choice([None, None, *topic])
        rows.append((i, "".join(say(s) for _ in range(4)) + (say(other) * 2 if other else say(None)), "en", "s", 0, None, 1, "k", 1))
        truth[i] = {s} | ({other} if other else set())
        if i < 300:
            labels += [(i, x) for x in truth[i]] if i % 15 else [(i, "food")]
    rows += [(1000 + i, "".join(say(None) for _ in range(6)), "en", "s", 0, None, 1, "k", 1) for i in range(90)]  # letters about nothing
    d = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([*labels, (0, None), (None, "law"), (1, "unknown")], "doc_id long, subject string")
    areas = spark.createDataFrame([(s,) for s in topic] + [(None,)], "subject string")
    model = subjects.fit(d, lab, areas)
    got = defaultdict(set)
    for r in subjects.subjects(subjects.assign(d, model)).collect():
        got[r["doc_id"]].add(r["subject"])
    right = [got[i] == truth[i] for i in range(300, 420)]
    assert np.mean(right) > 0.9 and sum(1000 + i in got for i in range(90)) < 9
    assert subjects.composition(subjects.assign(d, model)).agg({"share": "sum"}).first()[0] == pytest.approx(1)
    assert subjects.assign(none, model).count() == 0
    assert subjects.subjects(subjects.assign(odd, subjects.fit(none, lab, areas))).count() == 0


# --- queries


@needs_tables
@pytest.mark.parametrize(("name", "columns"), [("p1_found", "doc_id seg_no lang"), ("p2_found", "content_hash doc_id_a doc_id_b"), ("p3_found", "doc_id restored_md5"), ("p4_found", "group_id doc_id"), ("p5_found", "doc_id_a doc_id_b"), ("p6_found", "doc_id boundary"), ("p7_found", "plan_id doc_id"), ("p8_found", "recipe_id source"), ("p9_found", "doc_id subject")])
def test_queries_have_their_columns(spark, name, columns):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == columns.split() and df.count() == df.distinct().count()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert {tuple(r) for r in queries.queries()[name](spark, DATA).collect()} == set(con.sql(queries.oracle_sql()[name]).fetchall())
