"""Problem 3: text that was decoded with the wrong character encoding.

A noisy channel: text was written in one encoding and read in another, perhaps twice, perhaps with bytes lost. Every
frequent word of the corpus is sent through every channel; where a much rarer word of the corpus is what comes out, the
documents that have it are suspects. So are those with a token, however frequent, that read back from several bytes a
character is a shorter word of the corpus. Frequencies are counted over distinct texts.

In a suspect's text each token is, for every channel with evidence, a lattice over the bytes that it is made of: a lost
byte is a wildcard, the edges are the characters that some bytes can be, and the best path through it is the token with
a mark for every character that can't be told. Corpus words that match the marks fill them, the likelier the more frequent
they are. A Viterbi search over the words of the text, under corpus frequencies, finds the spans, their channels and the
words that were lost.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, texts, written

#: A corpus word must be in so many times as many documents as the damaged form to explain that; a word in fewer than
#: RARE documents says little by itself.
LEAST_RATIO, RARE = 6, 4
#: Log cost of beginning and of ending a damaged span.
TURN = 2.5
#: Log odds of a word that is rare both ways: read back from several bytes a character, or from one.
MULTIBYTE, SINGLE = 3.0, 0.4
#: Least log odds of a token that reads back from several bytes a character as a shorter known word, however frequent.
STRUCTURE = 1.0

#: A lost character is filled if the most frequent of the words that match has this part of all their occurrences.
SURE = 0.8

LOST = "�"
#: A run of ASCII letters and non-ASCII characters (white space among them, as damage makes it).
_TOKEN = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: A word in which a question mark stands for a letter.
_ASKED = re.compile(r"[^\W\d_]*\?[^\W\d_?]+(?:\?[^\W\d_?]+)*\??")
_ALL_ASKED = re.compile(r"(?<!\S)\?{2,}[,;:.!]?(?:\s+[\d.,:;!-]*\s*\?+[,;:.!]?){3,}")
_QUOTES = "\"'“”„‟«»‹›‘’‚`"
_QUOTED_LOST = re.compile(rf"[{_QUOTES}]{LOST}+\s?[{_QUOTES}]")

WESTERN = ("cp1252", "mac_roman", "cp850", "cp437")
CENTRAL = ("cp1250", "iso8859-2")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")


@functools.cache
def _table(name: str) -> tuple[str, object]:
    """A one-byte code page; bytes that it leaves open are C1 characters, as browsers read them."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(i))
    table = "".join(chars)
    return table, codecs.charmap_build(table)


def _encode(text: str, name: str) -> bytes:
    return text.encode("utf-8") if name == "utf-8" else codecs.charmap_encode(text, "strict", _table(name)[1])[0]


def _decode(data: bytes, name: str, errors: str = "strict") -> str:
    return data.decode("utf-8", errors) if name == "utf-8" else codecs.charmap_decode(data, "strict", _table(name)[0])[0]


@functools.cache
def channels() -> dict[str, tuple[tuple[str, str], ...]]:
    """Name -> (written in, read as), once or twice. Earlier ones are preferred where two do the same."""
    found = {f"utf-8>{r}": (("utf-8", r),) for r in ("cp1252", "latin-1", *CENTRAL, *CYRILLIC, *WESTERN[1:])}
    for r in ("cp1252", "latin-1"):
        found[f"utf-8>{r} twice"] = (("utf-8", r),) * 2
    one = [(w, r) for w in (*WESTERN, *CENTRAL) for r in (*WESTERN, *CENTRAL)] + [(w, r) for w in CYRILLIC for r in (*CYRILLIC, "cp1252", "latin-1", "mac_roman")] + [(w, r) for w in WESTERN[:2] for r in ("cp1251", "koi8-r")]
    return found | {f"{w}>{r}": ((w, r),) for w, r in one if w != r}


def damaged(text: str, name: str) -> str | None:
    """What comes out of the channel, None where nothing can."""
    try:
        for w, r in channels()[name]:
            text = _decode(_encode(text, w), r)
    except UnicodeError:
        return None
    return text


def mended(text: str, name: str, errors: str = "strict") -> str | None:
    """What went into the channel; with errors 'replace', lost bytes are wildcards."""
    try:
        for w, r in reversed(channels()[name]):
            text = _decode(_encode(text, r), w, errors)
    except UnicodeError:
        return None
    return text


def shape(word: str) -> str:
    """The word with one question mark for each character that isn't ASCII."""
    return re.sub(r"[^\x00-\x7f]", "?", word)


def gaps(word: str) -> set[str]:
    """The word with a mark for each of its characters that aren't ASCII, one at a time and all at once."""
    at = [i for i, c in enumerate(word) if c > "\x7f"]
    found = {word[:i] + LOST + word[i + 1 :] for i in at} | {re.sub(r"[^\x00-\x7f]", LOST, word)}
    return {x for x in found if len(x) > 2 and 2 * x.count(LOST) <= len(x)}


def _bytes(token: str, read: str) -> list[int | None]:
    """The bytes that the token was read from, None for those that were lost."""
    found: list[int | None] = []
    for c in token:
        try:
            found.append(None if c == LOST else _encode(c, read)[0])
        except UnicodeError:
            found += c.encode("utf-8", "surrogatepass")  # was never in the channel
    return found


def lattice(data: list[int | None]) -> str:
    """The best path through a lattice of UTF-8 characters over bytes with wildcards: LOST for each that can't be told.

    Edges are whole characters of one to four bytes. A character with a wildcard costs one, a byte that is in no character
    more: of equally dear paths the one with longer characters is taken.
    """
    n = len(data)
    cost, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    for i in range(n):
        if cost[i] == math.inf:
            continue
        lead = data[i]
        for size in (1, 2, 3, 4):
            part = data[i : i + size]
            low, high = ((0x00, 0x7F), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))[size - 1]
            if len(part) < size or lead is not None and not low <= lead <= high or any(b is not None and not 0x80 <= b <= 0xBF for b in part[1:]):
                continue
            if None in part:
                step, c = 1.0 + 0.1 * (4 - size) * (lead is None), LOST
            else:
                try:
                    step, c = 0.0, bytes(part).decode("utf-8")
                except UnicodeDecodeError:
                    continue
            if cost[i] + step <= cost[i + size]:
                cost[i + size], back[i + size] = cost[i] + step, (i, c)
        if cost[i] + 2.5 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 2.5, (i, LOST)
    out, i = [], n
    while i:
        i, c = back[i]
        out.append(c)
    return "".join(reversed(out))


def pattern(token: str, name: str) -> str | None:
    """The token as it went into a channel, with LOST for what can't be told; None if the channel explains nothing of it."""
    steps = channels()[name]
    if steps[0][0] != "utf-8" or len(steps) > 1:
        return None
    x = lattice(_bytes(token, steps[0][1]))
    return x if x != token and LOST in x and x.count(LOST) <= max(1, len(x) // 3) and len(x) < len(token) else None


@functools.cache
def _many() -> list[str]:
    """The channels from several bytes a character, once."""
    return [k for k, v in channels().items() if v[0][0] == "utf-8" and len(v) == 1]


def _tokens(text: str) -> set[str]:
    found = set() if text.isascii() else {t for t in set(_TOKEN.findall(text)) if not t.isascii()}
    if LOST in text:  # and what lost bytes leave of words
        found |= {x for t in list(found) if LOST in t for name in _many() if (x := pattern(t, name))}
    return found.union(t for t in _ASKED.findall(text) if len(t) > 2) if "?" in text else found


_PAIRS = pa.schema([("doc_id", pa.int64()), ("token", pa.string()), ("of", pa.int64())])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, out_ids, out, of = b.column(0).to_pylist(), [], [], []
        for i, text in zip(ids, b.column(1).to_pylist()):
            found = sorted(_tokens(text))
            out_ids += [i] * len(found)
            out += found
            if found:
                of += [int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.string()), pa.array(of, pa.int64())], schema=_PAIRS)


_FORMS = pa.schema([("token", pa.string()), ("channel", pa.string()), ("word", pa.string()), ("base", pa.string()), ("n_word", pa.int64())])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every channel makes of each frequent word, and its shapes with the characters lost."""
    for b in batches:
        rows = []
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if LOST in word or "?" in word:
                continue
            for w in {word, word.upper(), word.capitalize()}:  # as it is written in titles and capitals
                for name in channels():
                    x = damaged(w, name)
                    if x and x != w and not x.isascii() and not x.isspace():  # a no-break space is no word
                        rows.append((x, name, w, word, n))
                rows += [(x, LOST, w, word, n) for x in gaps(w)]
            s = shape(word)
            if re.search(r"\?[a-zA-Z]", s):
                rows.append((s, "?", word, word, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _FORMS)], schema=_FORMS)


def _plain(text: str) -> bool:
    """Nothing but letters, digits, white space and ordinary marks."""
    return not any("\x7f" <= c <= "\x9f" or c == LOST or "─" <= c <= "▟" for c in text)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shorter words of plain letters that tokens are when read back from several bytes a character."""
    names = [k for k, v in channels().items() if v[0][0] == "utf-8"]
    for b in batches:
        rows = []
        for token in b.column(0).to_pylist():
            for name in names:
                x = mended(token, name)
                if x is not None and len(x) < len(token) and x.isalpha() and _plain(x):
                    rows.append((token, name, x, x.lower(), 0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _FORMS)], schema=_FORMS)


def _odds(token: str, n: int, name: str, known: dict[str, dict[str, int]]) -> tuple[float, bool]:
    """(log odds of the channel against the token as it is, were bytes lost)."""
    if token.isascii():
        return 0.0, False
    many = channels()[name][0][0] == "utf-8"
    x = mended(token, name)
    if name in known.get(token, ()):
        odds = math.log(known[token][name] / n)
        return (max(odds + MULTIBYTE, STRUCTURE if x.isalpha() else -math.inf) if many and x is not None and len(x) < len(token) else odds), False
    if x is not None:
        if x == token:
            return 0.0, False
        if not _plain(x):
            return -6.0, False
        rare = n < RARE
        if many and len(x) < len(token):
            return (MULTIBYTE if rare else max(MULTIBYTE - math.log(n), 0.0 if x.isalpha() else -math.inf)), False
        return (SINGLE if rare and x.isalpha() >= token.isalpha() else -SINGLE - math.log(n)), False
    x = pattern(token, name) if LOST in token else mended(token, name, "replace")
    if x is not None and x.count(LOST) <= max(1, len(x) // 3) and len(x) < len(token):
        return max(-1.5, math.log(known[x][LOST] / n) if LOST in known.get(x, ()) else -1.5), True
    return -30.0, False


def filled(text: str, fill: dict[str, str]) -> str:
    """The text with what was lost filled by the corpus words that match, where those tell it."""
    if LOST in text:
        text = _TOKEN.sub(lambda m: fill.get(m[0], m[0]), text)
    return _ASKED.sub(lambda m: fill.get(m[0], m[0]), text) if "?" in text else text


def restore(text: str, counts: dict[str, int], known: dict[str, dict[str, int]], strong: set[str]) -> tuple[str, bool, list[str]]:
    """(restored text, were characters lost, channels found).

    counts: in how many distinct texts the text's tokens are; known: by token, in how many the words are that each channel
    makes it from; strong: the channels for which there is evidence in the text.
    """
    names = sorted(strong & set(channels()), key=list(channels()).index)
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    found = [(s, e) for s, e in found if not text[s:e].isascii()]
    used: list[str] = []
    lost = bool(re.search(LOST, _QUOTED_LOST.sub("", text))) or bool(_ALL_ASKED.search(text)) or "?" in strong
    if names and found:
        width = len(names) + 1
        total, back, gone = [0.0] * width, [], []
        for k in range(1, width):
            total[k] = -TURN
        for s, e in found:
            token = text[s:e]
            quoted = s > 0 and e < len(text) and text[s - 1] in _QUOTES and text[e] in _QUOTES and e - s <= 8
            odds = [(0.0, False), *((-20.0, False) if quoted else _odds(token, counts.get(token, 1), c, known) for c in names)]
            if back:
                step = [max(range(width), key=lambda j: total[j] - TURN * ((j != 0) + (k != 0)) * (j != k)) for k in range(width)]
                total = [total[j] - TURN * ((j != 0) + (k != 0)) * (j != k) for k, j in enumerate(step)]
            else:
                step = list(range(width))
            back.append(step)
            gone.append([g for _, g in odds])
            total = [t + o for t, (o, _) in zip(total, odds)]
        k = max(range(width), key=lambda j: total[j] - TURN * (j != 0))
        states = []
        for step in reversed(back):
            states.append(k)
            k = step[k]
        states.reverse()
        out, at, i = [], 0, 0
        while i < len(found):
            j = i
            while j + 1 < len(found) and states[j + 1] == states[i]:
                j += 1
            if states[i]:
                name, s, e = names[states[i] - 1], found[i][0], found[j][1]
                x = mended(text[s:e], name)
                if x is None:  # token by token, where something between them was never in the channel
                    x, last = "", s
                    for p, q in found[i : j + 1]:
                        y = mended(text[p:q], name)
                        if y is None:
                            y, lost = pattern(text[p:q], name) or mended(text[p:q], name, "replace") or text[p:q], True
                        x += text[last:p] + y
                        last = q
                out += [text[at:s], x]
                at = e
                used.append(name)
            i = j + 1
        text = "".join(out) + text[at:]
    return text, lost, sorted(set(used))


_RESTORED = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("lost", pa.bool_()), ("channels", pa.list_(pa.string())), ("restored_md5", pa.string())])
RESTORED = "doc_id long, restored string, lost boolean, channels array<string>, restored_md5 string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            counts = {t["token"]: t["n"] for t in r["tokens"] or ()}
            known: dict[str, dict[str, int]] = defaultdict(dict)
            strong, fill = set(), {}
            for e in sorted(r["evidence"] or (), key=lambda e: (e["n_word"], e["word"])):
                known[e["token"]][e["channel"]] = e["n_word"]
                if e["strong"]:
                    strong.add(e["channel"])
                if e["channel"] in ("?", LOST) and e["n_word"] >= SURE * e["n_all"]:
                    fill[e["token"]] = e["word"]
            text, lost, used = restore(r["text"], counts, known, strong)
            if lost and fill:
                text = filled(text, fill)
            if lost or text != r["text"]:
                rows.append((r["doc_id"], text, lost, used, "" if lost else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _RESTORED)], schema=_RESTORED)


def repaired(documents: DataFrame) -> DataFrame:
    """doc_id, restored, lost, channels, restored_md5 of the documents with text that was decoded wrongly.

    Where characters were lost, restored_md5 is '' and restored the likeliest text: words that the corpus tells are
    filled, what can't be told is left as it is. Texts that only quote such characters, null and empty texts have no rows; a row that is repeated whole counts once.
    """
    pairs = written(texts(documents).mapInArrow(_list, "doc_id long, token string, of long"))
    each = written(pairs.groupBy("token").agg(F.countDistinct("of").alias("n")))
    pairs = pairs.select("doc_id", "token")
    lower = each.groupBy(F.lower("token").alias("l")).agg(F.sum("n").alias("m"))
    counts = written(each.withColumn("l", F.lower("token")).join(lower, "l").select("token", F.when(F.col("token") == F.col("l"), F.col("n")).otherwise(F.col("m")).alias("n")))
    forms = counts.where(f"n >= {LEAST_RATIO}").mapInArrow(_forms, "token string, channel string, word string, base string, n_word long")
    made = forms.join(counts, "token").withColumn("strong", F.col("n_word") >= LEAST_RATIO * F.col("n"))
    back = counts.mapInArrow(_read_back, "token string, channel string, word string, base string, n_word long").drop("n_word")
    back = back.join(lower.select(F.col("l").alias("base"), F.col("m").alias("n_word")), "base").join(counts, "token").withColumn("strong", F.lit(True))
    made = written(made.unionByName(back))
    garbled = made.where(F.col("strong") & ~F.col("channel").isin("?", LOST)).select(F.col("token").alias("base")).distinct()  # frequent, but a damaged form itself
    words = written(made.join(garbled, "base", "left_anti").groupBy("token", "channel").agg(F.max(F.struct("n_word", "word")).alias("w"), F.max("strong").alias("strong"), F.sum("n_word").alias("n_all")).select("token", "channel", "w.*", F.when(F.col("channel") == LOST, F.lit(False)).otherwise(F.col("strong")).alias("strong"), "n_all"))
    plain = texts(documents).where(F.col("text").contains(LOST) | F.col("text").rlike(r"\?{2,}[,;:.!]?\s+\?")).select("doc_id")
    suspects = written(pairs.join(words.where("strong").select("token").distinct(), "token", "left_semi").select("doc_id").unionByName(plain).distinct())
    mine = written(maybe_in(pairs, "doc_id", suspects).join(suspects, "doc_id", "left_semi").distinct())
    tokens = mine.join(counts, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "n")).alias("tokens"))
    evidence = mine.join(words, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "channel", "word", "n_word", "strong", "n_all")).alias("evidence"))
    found = maybe_in(texts(documents), "doc_id", suspects).join(suspects, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return found.join(tokens, "doc_id", "left").join(evidence, "doc_id", "left").mapInArrow(_restore, RESTORED)
