"""Byte-level tokens: pre-tokens, encoding with a public vocabulary, windows and batches."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Where the vocabulary is; a parameter of every function here.
TOKENIZER = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Fixed value: how byte-level BPE cuts text before merging.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts, by name, that any byte-level tokenizer must give back unchanged.
PROBES = {
    "ascii": "The quick brown fox jumps over the lazy dog.",
    "leading_space": " leading space matters",
    "trailing_space": "trailing space matters ",
    "double_space": "two  spaces  between  words",
    "tabs_newlines": "a\tb\r\nc\n\nd",
    "only_whitespace": "   \n\t  ",
    "empty": "",
    "digits": "3.14159 and 1,000,000 and 0x1F",
    "accented": "naïve café Straße é\u0301",
    "cjk": "中文测试：你好世界",
    "kana": "こんにちはカタカナ",
    "hangul": "한국어 테스트",
    "cyrillic": "Привет мир",
    "arabic_rtl": "مرحبا بالعالم",
    "emoji": "😀🚀 🇬🇧",
    "zwj_sequence": "👩\u200d💻 ❤\ufe0f",
    "mixed": "Hello 世界 123 🌍 naïve\n\ttab",
    "eot_literal": "before <|endoftext|> after",
}


def failed_probes(path: str = TOKENIZER) -> list[str]:
    """The names of the probes that the vocabulary doesn't give back."""
    t = load(path)
    return [name for name, s in PROBES.items() if t.decode(t.encode(s, add_special_tokens=False).ids, skip_special_tokens=False) != s]


def pretokens(documents: DataFrame) -> DataFrame:
    """token, n: how often each pre-token occurs, inside the JVM."""
    t = documents.where("text is not null and text <> ''")
    return t.select(F.explode(F.regexp_extract_all("text", F.lit(PRETOKEN), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@functools.cache
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def encoder(path: str = TOKENIZER):
    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for s in texts:
            yield pd.Series([e.ids for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], index=s.index)

    return encode


def offsets_encoder(path: str = TOKENIZER):
    """ids, and the character range of each."""

    @F.pandas_udf("struct<ids array<int>, lo array<int>, hi array<int>>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = load(path)
        for s in texts:
            found = t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)
            yield pd.DataFrame({"ids": [e.ids for e in found], "lo": [[a for a, _ in e.offsets] for e in found], "hi": [[b for _, b in e.offsets] for e in found]}, index=s.index)

    return encode


def decoder(path: str = TOKENIZER):
    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for s in ids:
            yield pd.Series(t.decode_batch([list(x) for x in s], skip_special_tokens=False), index=s.index)

    return decode


def encoded(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids of the documents with a text."""
    return documents.where("text is not null").select("doc_id", encoder(path)("text").alias("ids"))


def compression(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """documents, tokens, chars_per_token, bytes_per_token, over whole texts."""
    t = documents.where("text is not null").select(F.length("text").cast("long").alias("c"), F.octet_length("text").cast("long").alias("b"), F.size(encoder(path)("text")).cast("long").alias("n"))
    return t.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), (F.sum("c") / F.sum("n")).alias("chars_per_token"), (F.sum("b") / F.sum("n")).alias("bytes_per_token"))


def round_trips(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ok, n_bytes: does decoding give each text back, and how many bytes come back."""
    e = documents.where("text is not null").select("doc_id", "text", encoder(path)("text").alias("ids"))
    back = e.select("doc_id", "text", decoder(path)("ids").alias("back"))
    return back.select("doc_id", (F.col("back") == F.col("text")).alias("ok"), F.octet_length("back").cast("long").alias("n_bytes"))


def epoch_order(windows: int, seq_len: int, seed: int, epoch: int, split: str) -> tuple[np.ndarray, int]:
    """The order of the windows in an epoch, and by how many tokens they are shifted."""
    salt = sum(ord(c) * i for i, c in enumerate(split, 1))
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, epoch, salt])))
    return rng.permutation(windows), int(rng.integers(0, seq_len + 1))
