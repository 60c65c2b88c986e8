"""The token stream of a split as data: ids with end tokens and masks, windows, batches.

A split's stream is its documents in the order of doc_id, each with an end token behind it. Nothing holds the stream as a
whole: a document's place follows from running sums, and windows gather the pieces of documents that reach into them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, EmptySplitError, VerificationError
from .prefix import exclusive_sums
from .tokens import epoch_order

END = 0


def byte_stream(sided: DataFrame) -> DataFrame:
    """doc_id, split, ids, mask of documents (doc_id, split, text, trained_spans): a token a UTF-8 byte, plus 3, and END.

    mask is 1 on tokens that touch a trained span, and on the end token if the last character is trained; documents
    without spans are trained on whole.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("split", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, masks = [], []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
                trained = np.ones(len(text), bool) if not spans else np.zeros(len(text), bool)
                for s in spans or ():
                    trained[s["span_start"] : s["span_end"]] = True
                ids.append(np.append(data.astype(np.int32) + 3, END))
                masks.append(np.append(trained[char], trained[-1:].any()).astype(np.int8) if len(data) else np.zeros(1, np.int8))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], schema=schema)

    rows = sided.where("text is not null and split is not null").select("doc_id", "split", "text", "trained_spans")
    return rows.mapInArrow(run, "doc_id long, split string, ids array<int>, mask array<byte>")


def placed(stream: DataFrame) -> DataFrame:
    """stream (split, doc_id, ids, mask) with first, the place of each document in its split's stream."""
    sized = stream.withColumn("n", F.size("ids").cast("long"))
    return exclusive_sums(sized, "doc_id", {"first": "n"}, ("split",))


def _gathered(pieces: DataFrame, *by: str) -> DataFrame:
    """Pieces (at, ids, mask) of each group joined in order."""
    rows = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "ids", "mask"))).alias("p"))  # at most a window's tokens
    return rows.withColumn("ids", F.flatten(F.transform("p", lambda x: x["ids"]))).withColumn("mask", F.flatten(F.transform("p", lambda x: x["mask"]))).drop("p")


def _examples(windows: DataFrame, seq_len: int) -> DataFrame:
    return windows.withColumns({"inputs": F.slice("ids", 1, seq_len), "targets": F.slice("ids", 2, seq_len), "target_mask": F.slice("mask", 2, seq_len)}).drop("ids", "mask")


def sequential(stream: DataFrame, seq_len: int) -> DataFrame:
    """split, window, inputs, targets, target_mask of the consecutive windows of seq_len + 1 tokens that a split holds."""
    if seq_len < 2:
        raise ConfigError("seq_len must be at least 2")
    width = seq_len + 1
    rows = placed(stream).where("n > 0")
    first, last = F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width)
    cut = rows.withColumn("window", F.explode(F.sequence(first, last)))
    low = F.greatest(F.lit(0), F.col("window") * width - F.col("first")).cast("int")
    high = F.least(F.col("n"), (F.col("window") + 1) * width - F.col("first")).cast("int")
    part = lambda c: F.slice(c, low + 1, high - low).alias(c)
    found = _gathered(cut.select("split", "window", (F.col("first") + low).alias("at"), part("ids"), part("mask")), "split", "window")
    return _examples(found.where(F.size("ids") == width), seq_len)


def batch(stream: DataFrame, seq_len: int, size: int, step: int, seed: int, split: str = "train") -> DataFrame:
    """row, epoch, start, inputs, targets, target_mask of the batch of a step: a function of its arguments alone.

    Only documents that reach into the batch's windows are touched; what is broadcast is a row for each of them.
    """
    rows = placed(stream.where(F.col("split") == split)).where("n > 0")
    tokens = rows.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    starts = starts_of(tokens, seq_len, size, step, seed, split)
    asked = stream.sparkSession.createDataFrame([(i, e, s) for i, (e, s) in enumerate(starts)], "row int, epoch int, start long")
    hit = rows.join(F.broadcast(asked), (F.col("first") < F.col("start") + seq_len + 1) & (F.col("first") + F.col("n") > F.col("start")))
    low = F.greatest(F.lit(0), F.col("start") - F.col("first")).cast("int")
    high = F.least(F.col("n"), F.col("start") + seq_len + 1 - F.col("first")).cast("int")
    part = lambda c: F.slice(c, low + 1, high - low).alias(c)
    found = _gathered(hit.select("row", "epoch", "start", (F.col("first") + low).alias("at"), part("ids"), part("mask")), "row", "epoch", "start")
    return _examples(found, seq_len)


def starts_of(tokens: int, seq_len: int, size: int, step: int, seed: int, split: str) -> list[tuple[int, int]]:
    """(epoch, first token) of each row of a batch; the epoch's order is drawn anew for each epoch that is asked for."""
    windows = max(0, (tokens - seq_len) // (seq_len + 1))
    if seq_len < 2 or size < 1:
        raise ConfigError("seq_len must be at least 2 and a batch at least 1")
    if windows < size:
        raise EmptySplitError(f"{split} has {windows} windows, a batch needs {size}")
    usable = windows // size * size
    epoch, at = divmod(step * size, usable)
    order, shift = epoch_order(windows, seq_len, seed, epoch, split)
    return [(epoch, shift + int(i) * (seq_len + 1)) for i in order[at : at + size]]


def checked_masks(stream: DataFrame) -> DataFrame:
    """stream, or an error where a mask hasn't its document's length."""
    wrong = stream.where(F.size("ids") != F.size("mask")).limit(1).count()
    if wrong:
        raise VerificationError("a mask must have a value for each token")
    return stream


def masks_used(state: str, wanted: bool | None) -> bool:
    """Are masks used, with a dataset that has them (whole), not (none) or in part: as wanted, else where they are whole."""
    if wanted and state != "whole":
        raise ConfigError(f"masks are asked for, but the dataset's are {state}")
    if state == "partial":
        raise VerificationError("some shards have a mask and others none")
    return state == "whole" if wanted is None else wanted


def totals(stream: DataFrame) -> DataFrame:
    """split, documents, tokens, end_tokens, trained, masked_documents."""
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m)
    return stream.groupBy("split").agg(F.count("*").alias("documents"), F.sum(F.size("ids").cast("long")).alias("tokens"), F.count_if(F.element_at("ids", -1) == END).alias("end_tokens"), F.sum(trained).alias("trained"), F.count_if(trained < F.size("ids")).alias("masked_documents"))
