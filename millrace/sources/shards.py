"""Prepared datasets: token shards of fixed size with masks and checksums, and the manifest that lists them."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EmptySplitError, VerificationError
from ..operators.prefix import exclusive_sums

MANIFEST = "manifest.json"


def token_dtype(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 65_536 else "<u4"


def content_hash(parts: dict) -> str:
    """SHA-256 of what is reproducible, as canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def write(documents: DataFrame, out: str, vocab_size: int, shard_tokens: int = 64 << 20, settings: dict | None = None) -> dict:
    """documents (split, doc_id, ids, and mask or none, an array of 0 and 1) as shards in a folder that all tasks see.

    Tokens of a split are one stream in the order of doc_id, cut every shard_tokens, also within documents. A task writes
    whole shards only. Everything goes to a folder of its own beside out, which takes out's place in the end; a failure
    leaves what was there before.
    """
    if shard_tokens < 2:
        raise ConfigError("a shard holds at least two tokens")
    dtype, masked = token_dtype(vocab_size), "mask" in documents.columns
    sized = documents.withColumn("n", F.size("ids").cast("long"))
    placed = exclusive_sums(sized, "doc_id", {"first": "n"}, ("split",))
    first, last = F.floor(F.col("first") / shard_tokens), F.floor((F.col("first") + F.col("n") - 1) / shard_tokens)
    cut = placed.where("n > 0").withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0), F.col("shard") * shard_tokens - F.col("first")).cast("int")
    hi = F.least(F.col("n"), (F.col("shard") + 1) * shard_tokens - F.col("first")).cast("int")
    part = lambda c: F.slice(c, lo + 1, hi - lo).alias(c)
    pieces = cut.select("split", "shard", "first", part("ids"), *([part("mask")] if masked else []))
    temp = f"{out.rstrip('/')}.{uuid.uuid4().hex}"
    os.makedirs(temp)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        split, shard = key
        rows = rows.sort_values("first")
        row = {"split": split, "shard": shard}
        for column, name, kind in (("ids", f"{split}_{shard:05d}.bin", dtype), ("mask", f"{split}_{shard:05d}.mask", "u1"))[: 1 + masked]:
            data = np.concatenate([np.asarray(x) for x in rows[column]]).astype(kind).tobytes()
            final, own = f"{temp}/{name}", f"{temp}/.{name}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(own, final)  # a repeated task writes the same bytes
            p = "" if column == "ids" else "mask_"
            row |= {f"{p}name": name, f"{p}bytes": len(data), f"{p}sha256": hashlib.sha256(data).hexdigest()}
            if column == "ids":
                row["tokens"] = len(data) // np.dtype(kind).itemsize
        return pd.DataFrame([{"mask_name": None, "mask_bytes": None, "mask_sha256": None} | row])

    schema = "split string, shard long, name string, tokens long, bytes long, sha256 string, mask_name string, mask_bytes long, mask_sha256 string"
    try:
        rows = sorted((r.asDict() for r in pieces.groupBy("split", "shard").applyInPandas(one, schema).toLocalIterator()), key=lambda r: (r["split"], r["shard"]))
        counts = {r["split"]: r["c"] for r in sized.groupBy("split").agg(F.count("*").alias("c")).collect()}
        if not counts.get("train"):
            raise EmptySplitError("no document went to the training split")
        splits = {s: {"documents": c, "tokens": sum(r["tokens"] for r in rows if r["split"] == s), "shards": [{k: v for k, v in r.items() if k not in ("split", "shard")} for r in rows if r["split"] == s]} for s, c in sorted(counts.items())}
        manifest = {"format_version": 1, "dtype": dtype, "byte_order": "little", "vocab_size": vocab_size, "shard_tokens": shard_tokens, "settings": settings or {}, "splits": splits}
        manifest = {"content_hash": content_hash(manifest), **manifest}
        with open(f"{temp}/{MANIFEST}", "w", encoding="ascii", newline="\n") as f:
            json.dump(manifest, f, indent=1)
        old = f"{temp}.old"
        if os.path.exists(out):
            os.rename(out, old)
        os.rename(temp, out)
        shutil.rmtree(old, ignore_errors=True)
        return manifest
    except BaseException:
        shutil.rmtree(temp, ignore_errors=True)
        raise


def load(folder: str) -> dict:
    """The manifest, strictly: every known key must be there with its type; a boolean is no number."""
    with open(f"{folder}/{MANIFEST}", encoding="ascii") as f:
        m = json.load(f)
    for key, kind in (("content_hash", str), ("format_version", int), ("dtype", str), ("vocab_size", int), ("shard_tokens", int), ("splits", dict)):
        if not isinstance(m.get(key), kind) or isinstance(m.get(key), bool):
            raise VerificationError(f"{folder}: {key} is missing or no {kind.__name__}")
    if content_hash({k: v for k, v in m.items() if k != "content_hash"}) != m["content_hash"]:
        raise VerificationError(f"{folder}: the manifest was changed after it was written")
    return m


def verify(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """name, state (ok, missing, wrong_size, wrong_hash) of every file of the manifest; one task a file."""
    m = load(folder)
    files = [(s[p + "name"], s[p + "bytes"], s[p + "sha256"]) for x in m["splits"].values() for s in x["shards"] for p in ("", "mask_") if s[p + "name"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            states = []
            for r in f.itertuples():
                path = f"{folder}/{r.name}"
                if not os.path.exists(path):
                    states.append("missing")
                elif os.path.getsize(path) != r.bytes:
                    states.append("wrong_size")
                else:
                    states.append("wrong_hash" if deep and hashlib.sha256(open(path, "rb").read()).hexdigest() != r.sha256 else "ok")
            yield pd.DataFrame({"name": f["name"], "state": states})

    frame = spark.createDataFrame(files, "name string, bytes long, sha256 string")
    return frame.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "name string, state string")


def tokens(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """shard, first (of the stream), ids and mask of each shard of a split."""
    m = load(folder)
    rows, at = [], 0
    for k, s in enumerate(m["splits"].get(split, {"shards": []})["shards"]):
        rows.append((k, at, f"{folder}/{s['name']}", f"{folder}/{s['mask_name']}" if s["mask_name"] else None))
        at += s["tokens"]
    kind = m["dtype"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"shard": [r.shard], "first": [r.first], "ids": [np.fromfile(r.path, kind).astype(np.int64)], "mask": [np.fromfile(r.mask, "u1").astype(np.int32) if r.mask else None]})

    return spark.createDataFrame(rows, "shard int, first long, path string, mask string").repartition(max(1, len(rows))).mapInPandas(run, "shard int, first long, ids array<long>, mask array<int>")
