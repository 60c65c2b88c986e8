"""Problem 9: the subject areas of each document.

For every language and subject an interpolated n-gram model (bigram, unigram, background) of words is trained on a
bounded sample of labelled documents, first on those with one label. The background, and the vocabulary beside the
sample's words, are counted over all distinct texts. Sentences of documents with several labels are then
dealt to the label that explains them best, documents that contradict their label are dropped, and the models trained
again. (Sentences of documents with one label stay together: dealt one by one, they drift apart by phrases that have
nothing to do with subjects.) A sentence is about
the subject with the lowest per-token cross-entropy, if that is lower than the background's by more than a margin,
calibrated on labelled documents that were held out from training. A document has every subject that at least a fifth of its sentences are about.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as V
from .common import maybe_in, slices, texts, written
from .langcodes import CODES, normal

#: Defaults of fit(): labelled documents to train on, those with the least hash of doc_id, and most bytes of their texts;
#: words of the vocabulary beside those of the sample.
MOST_LABELLED, MOST_BYTES, MOST_WORDS = 12_000, 48 << 20, 30_000
#: Part of the labelled documents that the margin is calibrated on.
HELD_OUT = 5
SHARE = 0.2
#: A document's mixture of subjects: how much a sentence's words count, rounds, and weight of an even mixture.
TRUST, MIXINGS, EVEN = 0.7, 4, 0.15
BIGRAM, UNIGRAM, BACKGROUND = 0.45, 0.45, 0.1
LEAST_COUNT, ROUNDS = 3, 4
#: Words that this share of the subjects have are common to all; a subject with fewer tokens of a language has no model in it.
COMMON, LEAST_COMMON, LEAST_TOKENS = 0.75, 15, 200
MARGINS = np.arange(0.0, 0.42, 0.03)


@dataclass
class Tokens:
    """Words of whole texts: hash, sentence, text; and the text of each sentence."""

    hash: np.ndarray
    sent: np.ndarray
    doc: np.ndarray
    of: np.ndarray


@functools.cache
def _lower() -> np.ndarray:
    return np.fromiter((chr(i).islower() for i in range(0x110000)), dtype=bool, count=0x110000)


def tokens(strings: list[str]) -> Tokens:
    """The words and sentences of some texts. A line that goes on in lower case in the next one is broken, not ended."""
    w = V.words(strings)
    if not len(w.hash):
        return Tokens(w.hash, w.doc[:0], w.doc, w.doc[:0])
    starts = V.sentence_starts(w.codes)
    as_written = V.codes(strings)[0]
    if len(as_written) == len(w.codes):
        feed = np.flatnonzero((w.codes[:-1] == 10) | (w.codes[:-1] == 13))
        ended = V._sentence_marks()[0][w.codes[np.maximum(feed - 1, 0)]]
        feed = feed[_lower()[as_written[feed + 1]] & ~ended]
        feed = feed[~np.isin(feed, w.at[1:] - 1)]  # texts end for certain
        starts[feed] = False
    till = np.cumsum(starts)[w.start]
    new = np.concatenate(([True], (till[1:] != till[:-1]) | (w.doc[1:] != w.doc[:-1])))
    return Tokens(w.hash, np.cumsum(new) - 1, w.doc, w.doc[new])


@dataclass
class Model:
    subjects: list[str]
    vocabulary: np.ndarray  # sorted hashes
    language: np.ndarray  # by word (the last: unknown) and language, log probability
    unigram: np.ndarray  # by language, word and subject: log of subject's by background's probability, without a known bigram
    bigrams: list[np.ndarray]  # by language, sorted keys
    bigram: list[np.ndarray]  # by language: the same log ratio, by bigram and subject
    margin: float = 0.0

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def languages(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.language[ids], first, axis=0).argmax(axis=1)

    def scores(self, h: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By sentence: how much less each subject's per-token cross-entropy is than the background's, and the language."""
        if not len(h):
            return np.zeros((0, len(self.subjects))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.ids(h)
        first = np.flatnonzero(np.diff(sent, prepend=-1))
        length = np.diff(first, append=len(h))
        lang = self.languages(ids, first)
        of = lang[sent]
        ratio = self.unigram[of, ids]
        key = pair_keys(ids, sent, len(self.vocabulary))
        for k in np.unique(lang):
            known = self.bigrams[k]
            if len(known):
                mine = np.flatnonzero((of == k) & (key >= 0))
                at = np.minimum(np.searchsorted(known, key[mine]), len(known) - 1)
                hit = known[at] == key[mine]
                ratio[mine[hit]] = self.bigram[k][at[hit]]
        return np.add.reduceat(ratio, first, axis=0) / length[:, None], lang, first


def deal(score: np.ndarray, length: np.ndarray, of: np.ndarray, margin: float) -> np.ndarray:
    """The subject of each sentence, or the number of subjects for none.

    A document mixes subjects: what its sentences are about in all makes each subject likelier for each of them.
    """
    n_docs, k = int(of.max(initial=-1)) + 1, score.shape[1]
    like = np.concatenate((score, np.full((len(score), 1), margin)), 1) * (TRUST * length[:, None])
    first = np.flatnonzero(np.diff(of, prepend=-1))
    n = np.bincount(of, minlength=n_docs)[:, None]
    log_share = np.zeros((n_docs, k + 1))
    for _ in range(MIXINGS):
        post = like + log_share[of]
        post = np.exp(post - post.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        share = np.full((n_docs, k + 1), EVEN)
        if len(first):
            share[of[first]] += np.add.reduceat(post, first, axis=0)
        log_share = np.log(share / (n + EVEN * (k + 1)))
    return (like + log_share[of]).argmax(1)


def pair_keys(ids: np.ndarray, sent: np.ndarray, size: int) -> np.ndarray:
    """A number for each word and the word before it in its sentence; -1 where either is unknown or there is none."""
    key = np.full(len(ids), -1, np.int64)
    ok = np.flatnonzero((sent[1:] == sent[:-1]) & (ids[1:] < size) & (ids[:-1] < size)) + 1
    key[ok] = ids[ok - 1].astype(np.int64) * size + ids[ok]
    return key


def _tally(what: np.ndarray, label: np.ndarray, size: int, n_sub: int) -> np.ndarray:
    """How often each thing has each label."""
    has = label >= 0
    return np.bincount(what[has] * n_sub + label[has], minlength=size * n_sub).reshape(size, n_sub).astype(np.float64)


def _all_scores(model: Model, h: np.ndarray, sent: np.ndarray, first: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Scores of all sentences, some at a time."""
    ends = np.append(first, len(h))
    out = np.empty((len(first), len(model.subjects)), np.float32)
    for i in range(0, len(first), chunk):
        j = min(len(first), i + chunk)
        out[i:j] = model.scores(h[ends[i] : ends[j]], sent[ends[i] : ends[j]] - i)[0]
    return out


@dataclass
class Sample:
    """Words of labelled texts, with sentence and text; the languages' models; labels by text and subject."""

    model: Model
    hash: np.ndarray
    sent: np.ndarray
    of: np.ndarray
    lang: np.ndarray
    has: np.ndarray

    def part(self, docs: np.ndarray) -> Sample:
        """Of these texts only (by text: is it in), numbered anew."""
        word, sentence = docs[self.of][self.sent], docs[self.of]
        return Sample(self.model, self.hash[word], (np.cumsum(sentence) - 1)[self.sent[word]], (np.cumsum(docs) - 1)[self.of[sentence]], self.lang[sentence], self.has[docs])


def sample(strings: list[str], langs: list[str | None], labels: list[set[str]], subjects: list[str], frequent: np.ndarray) -> Sample:
    """A vocabulary of the sample's words and of those frequent in the corpus, and models of the languages."""
    parts, base, sbase = [], 0, 0
    for lo, hi in slices(strings):
        t = tokens(strings[lo:hi])
        parts.append((t.hash, t.sent + sbase, t.of + base))
        sbase += len(t.of)
        base = hi
    h, sent, of = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    h = h.astype(np.uint64)
    words, counts = np.unique(h, return_counts=True)
    vocabulary = np.union1d(words[counts >= LEAST_COUNT], frequent.astype(np.uint64))
    if not len(vocabulary):
        vocabulary = np.zeros(1, np.uint64)
    size, n_lang, n_sub = len(vocabulary), len(CODES), len(subjects)
    model = Model(subjects, vocabulary, np.zeros((size + 1, n_lang), np.float32), np.zeros((0, 0, n_sub), np.float32), [], [])  # train() makes the rest
    has = np.zeros((len(strings), n_sub), bool)
    for i, x in enumerate(labels):
        for s in x:
            if s in subjects:
                has[i, subjects.index(s)] = True
    lang = np.array([CODES.index(c) if (c := normal(x)) else -1 for x in langs], np.int64)[of] if len(of) else of
    if len(h):
        ids, first = model.ids(h), np.flatnonzero(np.diff(sent, prepend=-1))
        for _ in range(3):
            count = _tally(ids, lang[sent], size + 1, n_lang)
            here = count.sum(1) > 0
            count[size] = count[size].mean() + 1  # an unknown word tells nothing
            model.language = np.log((count + 0.02) / (count.sum(0) + 0.02 * (size + 1))).astype(np.float32)
            model.language[~here] = 0  # nor does one that the sample lacks
            model.language[size] = 0
            ends = np.append(first, len(ids))
            lang = np.concatenate([model.languages(ids[ends[i] : ends[min(i + 20_000, len(first))]], first[i : i + 20_000] - first[i]) for i in range(0, len(first), 20_000)])
    return Sample(model, h, sent, of, lang, has)


@dataclass
class Corpus:
    """Counts over all distinct texts: of words by language, and of the bigrams asked for (sorted keys) by language."""

    words: np.ndarray  # by language and word
    bigrams: list[np.ndarray]  # by language: sorted keys
    times: list[np.ndarray]
    before: list[np.ndarray]  # by language and word: how often it is followed by a known word in its sentence


def train(given: Sample, corpus: Corpus) -> Model:
    """The models of every language and subject from labelled texts, against the background of the corpus."""
    h, sent, of, lang, has = given.hash, given.sent, given.of, given.lang, given.has
    size, n_lang, n_sub, n_docs = len(given.model.vocabulary), len(CODES), has.shape[1], len(has)
    model = replace(given.model, unigram=np.full((n_lang, size + 1, n_sub), -5, np.float32), bigrams=[np.zeros(0, np.int64)] * n_lang, bigram=[np.zeros((0, n_sub), np.float32)] * n_lang)
    if not len(h):
        return model
    ids, first = model.ids(h), np.flatnonzero(np.diff(sent, prepend=-1))
    single = has.sum(1) == 1
    label = np.where(single, has.argmax(1), -1)[of].astype(np.int8)  # of each sentence; -1: teaches nothing but the background
    key = pair_keys(ids, sent, size)
    token_lang = lang[sent]
    for _ in range(ROUNDS):
        for k in range(n_lang):
            mine = np.flatnonzero(token_lang == k)
            if not len(mine):
                continue
            uni = _tally(ids[mine], label[sent[mine]], size + 1, n_sub)
            none = uni.sum(0) < LEAST_TOKENS  # too little to say anything
            if none.all():
                model.unigram[k][:, :] = -5
                continue
            # Subjects differ in what else their documents hold (tables, reports): counts are scaled so that the middle one
            # of the words that nearly all subjects have is as frequent in each, and tells nothing.
            count = np.maximum(corpus.words[k], np.bincount(ids[mine], minlength=size + 1)).astype(float)
            common = (uni[:, ~none] >= LEAST_COUNT).sum(1) >= COMMON * (~none).sum()
            common[size] = False
            scale, whole = np.maximum(1e-9, uni.sum(0)), count.sum()
            if common.sum() >= LEAST_COMMON:
                middle = np.log(uni[common][:, ~none] + 0.5).mean(1)
                scale[~none] = np.exp(np.median(np.log(uni[common][:, ~none] + 0.5) - middle[:, None], axis=0))
                whole = np.exp(np.median(np.log(count[common]) - middle))
            p_uni = uni / scale
            p_uni /= max(1e-9, p_uni[:, ~none].sum(0).mean())
            p_count = (count + 0.5) / whole
            p_count /= p_count.sum()
            back = (0.5 * p_uni[:, ~none].mean(1) + 0.5 * p_count)[:, None]
            model.unigram[k] = np.log(((BIGRAM + UNIGRAM) * p_uni + BACKGROUND * back) / back)
            model.unigram[k][size] = 0
            model.unigram[k][:, none] = -5
            pairs = mine[key[mine] >= 0]
            known, which, times = np.unique(key[pairs], return_inverse=True, return_counts=True)
            if not len(known):
                continue
            if len(corpus.bigrams[k]):
                at = np.minimum(np.searchsorted(corpus.bigrams[k], known), len(corpus.bigrams[k]) - 1)
                times = np.where(corpus.bigrams[k][at] == known, np.maximum(times, corpus.times[k][at]), times)
            bi = _tally(which, label[sent[pairs]], len(known), n_sub)
            v, w = known // size, known % size
            before = np.maximum(np.bincount(v, times, size + 1), corpus.before[k])
            before_s = np.stack([np.bincount(v, bi[:, s], size + 1) for s in range(n_sub)], 1)
            seen = (before_s[v] > 0.5) & ~none
            p_bi = np.where(seen, bi / np.maximum(1e-9, before_s[v]), 0.0)
            p_back = 0.5 * p_bi.sum(1) / np.maximum(1, seen.sum(1)) + 0.5 * times / before[v]
            p_back = (BIGRAM * p_back)[:, None] + (UNIGRAM + BACKGROUND) * back[w]
            p = np.where(seen, BIGRAM * p_bi + UNIGRAM * p_uni[w], (BIGRAM + UNIGRAM) * p_uni[w]) + BACKGROUND * p_back
            ratio = np.log(p / p_back)
            ratio[:, none] = -5
            often = times >= LEAST_COUNT
            model.bigrams[k], model.bigram[k] = known[often], ratio[often].astype(np.float32)
        score = _all_scores(model, h, sent, first)
        length = np.diff(first, append=len(h)).astype(np.float32)[:, None]
        whole = np.zeros((n_docs, n_sub), np.float32)
        np.add.at(whole, of, score * length)
        right = has[np.arange(n_docs), whole.argmax(1)]  # documents that contradict their label teach nothing
        mine = np.where(has[of], score, -np.inf)
        best = mine.argmax(1)
        sure = (mine.max(1) > 0.05) & (score.argmax(1) == best) & (has.sum(1) > 1)[of]
        label = np.where((single & right)[of] | sure, best, -1).astype(np.int8)
    return model


def margin(model: Model, held: Sample) -> float:
    """The margin with which the model agrees best with the labels of texts that it wasn't trained on."""
    if not len(held.hash):
        return float(MARGINS[len(MARGINS) // 4])
    first, n_sub = np.flatnonzero(np.diff(held.sent, prepend=-1)), held.has.shape[1]
    score = _all_scores(model, held.hash, held.sent, first)
    length = np.diff(first, append=len(held.hash))
    n = np.bincount(held.of, minlength=len(held.has))
    worth = []
    for m in MARGINS:
        about = np.zeros((len(held.has), n_sub + 1))
        np.add.at(about, (held.of, deal(score, length, held.of, m)), 1)
        said = about[:, :n_sub] >= np.maximum(1e-9, SHARE * n[:, None])
        worth.append(2 * (said & held.has).sum() / max(1, said.sum() + held.has.sum()))
    near = np.flatnonzero(np.array(worth) >= max(worth) - 0.002)
    return float(MARGINS[near[len(near) // 2]])


def calibrated(given: Sample, corpus: Corpus) -> Model:
    """A model of all labelled texts, with the margin of one that a part of them was held out from."""
    out = np.arange(len(given.has)) % HELD_OUT == 0
    m = margin(train(given.part(~out), corpus), given.part(out)) if len(given.has) >= 4 * HELD_OUT else margin(given.model, given.part(out & False))
    return replace(train(given, corpus), margin=m)


_SEEN = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each text, and the words of a batch with the number of its texts that have them."""
    for b in batches:
        strings = b.column(1).to_pylist()
        for lo, hi in slices(strings):
            w = V.words(strings[lo:hi])
            c, at = V.codes(strings[lo:hi])
            k = hi - lo
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k).cast(pa.int64()), pa.array(V.signed(V.range_hashes(c, at[:-1], at[1:] - 1))), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=_SEEN)
            word, _, _ = V.distinct(w.hash, w.doc)
            u, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(V.signed(u)), pa.array(n)], schema=_SEEN)


def _counted(shared):
    """By language: counts of the vocabulary's words (kind 0), of the bigrams asked for (1), of words before another (2)."""
    schema = pa.schema([("kind", pa.int8()), ("lang", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked = shared.value
        size, n_lang = len(model.vocabulary), len(CODES)
        counts = [np.zeros((n_lang, size + 1), np.int64), np.zeros((n_lang, max(1, len(asked))), np.int64), np.zeros((n_lang, size + 1), np.int64)]
        for b in batches:
            strings = b.column(0).to_pylist()
            for lo, hi in slices(strings):
                t = tokens(strings[lo:hi])
                if not len(t.hash):
                    continue
                ids = model.ids(t.hash)
                lang = model.languages(ids, np.flatnonzero(np.diff(t.sent, prepend=-1)))[t.sent]
                counts[0] += np.bincount(lang * (size + 1) + ids, minlength=n_lang * (size + 1)).reshape(n_lang, -1)
                key = pair_keys(ids, t.sent, size)
                at = np.flatnonzero(key >= 0)
                counts[2] += np.bincount(lang[at] * (size + 1) + key[at] // size, minlength=n_lang * (size + 1)).reshape(n_lang, -1)
                if len(asked):
                    place = np.minimum(np.searchsorted(asked, key[at]), len(asked) - 1)
                    hit = asked[place] == key[at]
                    counts[1] += np.bincount(lang[at][hit] * len(asked) + place[hit], minlength=n_lang * len(asked)).reshape(n_lang, -1)
        for kind, c in enumerate(counts):
            lang, key = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(lang.astype(np.int8)), pa.array(key), pa.array(c[lang, key])], schema=schema)

    return run


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES, most_words: int = MOST_WORDS) -> Model:
    """Trains on at most most_labelled labelled documents with at most most_bytes of whole texts; everything else is counted
    over all distinct texts. Labels without subject or of unknown subjects are left out.

    The sample is read, and the models are trained, by one task whose input is bounded by these parameters: the sample's
    texts, and counts of its bigrams and of at most most_words words beside its own. The model reaches the driver.
    """
    spark = documents.sparkSession
    subjects = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    named = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    h = F.xxhash64(F.lit(3), "doc_id")
    chosen = written(named.orderBy(h, "doc_id").limit(most_labelled))
    rows = maybe_in(texts(documents, "lang"), "doc_id", chosen.select("doc_id")).join(chosen, "doc_id").dropDuplicates(["doc_id"])
    rows = written(rows.select("doc_id", h.alias("h"), "text", "lang", "subjects"))
    till = F.sum(F.octet_length("text").cast("long")).over(W.orderBy("h", "doc_id"))  # at most most_labelled rows
    within = rows.select("doc_id", "h", till.alias("till")).where(F.col("till") <= most_bytes).select("doc_id")
    found = rows.join(within, "doc_id", "left_semi")

    seen = written(texts(documents).mapInArrow(_seen, "doc_id long, text long, word long, n long"))
    top = seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(most_words).select("word")

    def first(key: tuple, rows: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
        """The sample; and apart from it what all tasks need to count: the vocabulary, languages and bigrams."""
        rows = rows.sort_values(["h", "doc_id"])
        given = sample(rows["text"].tolist(), rows["lang"].tolist(), [set(x) for x in rows["subjects"]], subjects, frequent["word"].to_numpy(np.int64).view(np.uint64))
        asked = np.unique(pair_keys(given.model.ids(given.hash), given.sent, len(given.model.vocabulary))) if len(given.hash) else np.zeros(0, np.int64)
        return pd.DataFrame({"given": [pickle.dumps(given)], "shared": [pickle.dumps((given.model, asked[asked >= 0]))]})

    # one task, away from the driver: its input is bounded by the parameters. The null rows make it run on nothing, too.
    one = lambda df: df.groupBy(F.lit(1).alias("all"))
    some = found.unionByName(spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema)))
    made = written(one(some).cogroup(one(top)).applyInPandas(lambda k, a, b: first(k, a.dropna(subset=["doc_id"]), b), "given binary, shared binary"))
    shared = spark.sparkContext.broadcast(pickle.loads(made.select("shared").first()[0]))

    reps = seen.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    again = written(seen.where("text is not null").select("doc_id").join(reps, "doc_id", "left_anti").distinct())
    each = texts(documents).join(again, "doc_id", "left_anti").select("text")
    counts = each.mapInArrow(_counted(shared), "kind byte, lang byte, key long, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))

    def second(key: tuple, made: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        given, (model, asked) = pickle.loads(made["given"].iloc[0]), pickle.loads(made["shared"].iloc[0])
        kind, lang, key, n = (counts[c].to_numpy(np.int64) for c in ("kind", "lang", "key", "n"))
        words, before = np.zeros((2, len(CODES), len(model.vocabulary) + 1), np.int64)
        for k, into in ((0, words), (2, before)):
            into[lang[kind == k], key[kind == k]] = n[kind == k]
        bigrams, times = [], []
        for k in range(len(CODES)):
            mine = np.flatnonzero((kind == 1) & (lang == k))
            mine = mine[np.argsort(key[mine])]
            bigrams.append(asked[key[mine]])
            times.append(n[mine])
        return pd.DataFrame({"model": [pickle.dumps(calibrated(given, Corpus(words, bigrams, times, list(before))))]})

    done = one(made).cogroup(one(counts)).applyInPandas(second, "model binary").first()
    return pickle.loads(done["model"])


SCHEMA = "doc_id long, subject string, n_about int, n_sentences int, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("n_about", pa.int32()), ("n_sentences", pa.int32()), ("score", pa.float64())])


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """A row for each document and subject with any sentence, and one with subject null for all sentences about none.

    score is the mean margin over the background of the sentences counted. Documents without text or words have no rows;
    repeated rows are counted each by itself.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.subjects)
        names = pa.array([*m.subjects, None], pa.string())
        for b in batches:
            ids, strings = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(strings):
                t = tokens(strings[lo:hi])
                if not len(t.of):
                    continue
                score, _, first = m.scores(t.hash, t.sent)
                best = deal(score, np.diff(first, append=len(t.hash)), t.of, m.margin)
                cell = t.of * (k + 1) + best
                about = np.bincount(cell, minlength=(hi - lo) * (k + 1))
                mine = np.where(best < k, score[np.arange(len(best)), np.minimum(best, k - 1)], 0)
                total = np.bincount(cell, mine, minlength=(hi - lo) * (k + 1))
                n = np.bincount(t.of, minlength=hi - lo)
                at = np.flatnonzero(about)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(at // (k + 1))).cast(pa.int64()), names.take(pa.array(at % (k + 1))), pa.array(about[at].astype(np.int32)), pa.array(n[at // (k + 1)].astype(np.int32)), pa.array(total[at] / about[at])], schema=_SCHEMA)

    return texts(documents).mapInArrow(run, SCHEMA)


def subjects(assigned: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, subject of every subject that at least this share of the document's sentences are about."""
    return assigned.where((F.col("subject").isNotNull()) & (F.col("n_about") >= F.col("n_sentences") * share)).select("doc_id", "subject")


def composition(assigned: DataFrame, share: float = SHARE) -> DataFrame:
    """subject (null: none), n_documents with at least this share, n_sentences and their share of the corpus."""
    has = F.count_if(F.col("n_about") >= F.col("n_sentences") * share)
    per = assigned.groupBy("subject").agg(has.alias("n_documents"), F.sum("n_about").alias("n_sentences"))
    return per.withColumn("share", F.col("n_sentences") / F.sum("n_sentences").over(W.partitionBy()))  # a row for each subject
