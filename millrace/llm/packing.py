"""Problem 7: items of varying length fill containers of fixed capacity.

Vector bin packing by the dot-product heuristic: into the open container goes, of all items that fit, the one whose
demand (tokens, one segment, loss-bearing tokens) has the largest product with what is left of each limit. Items are
dealt to shards by a hash of their id, so that each shard is packed by one task and loses at most one open container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tokens packed by one task.
SHARD_TOKENS = 8_000_000
#: Classes of similar items to a container's capacity; within a class the largest goes first.
CLASSES = 512
#: Containers take at most capacity / TOKENS_PER_SEGMENT segments.
TOKENS_PER_SEGMENT = 32

SCHEMA = "plan_id string, shard int, container int, position int, doc_id long, part_no int, n_parts int, tokens long, loss_tokens long, start long"


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, tokens (UTF-8 bytes and one end token) and loss_tokens of the documents with a text.

    Loss-bearing are the trained spans and the end token; a document without spans is trained on whole.
    """
    inside = F.aggregate("trained_spans", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.octet_length(F.substring(F.col("text"), s["span_start"] + 1, s["span_end"] - s["span_start"])), F.lit(0)))
    tokens = F.octet_length("text").cast("long") + 1
    spans = F.coalesce(F.size("trained_spans"), F.lit(0)) > 0
    return documents.where(F.col("text").isNotNull()).select("doc_id", tokens.alias("tokens"), F.when(spans, F.least(tokens, inside + 1)).otherwise(tokens).alias("loss_tokens"))


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> list[list[int]]:
    """Containers as lists of item numbers. Every item must fit by its tokens.

    An item whose loss-bearing tokens alone exceed their limit begins a container and has no other of them beside it.
    """
    order = np.lexsort((loss, tokens))  # the largest of a class is taken from its end
    kind = (tokens[order] - 1) * CLASSES // capacity * 4 + np.minimum(3, loss[order] * 4 // np.maximum(1, tokens[order] + 1))
    by = np.argsort(kind, kind="stable")
    order, kind = order[by], kind[by]
    low = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(kind) else np.zeros(0, np.int64)
    top = np.append(low[1:], len(kind)) - 1  # of each class, where its largest item is
    t, q = tokens[order], loss[order]
    head_t, head_q = t[top].astype(float), q[top].astype(float)
    least_t, least_q = t[low].astype(float), np.minimum.reduceat(q, low).astype(float) if len(low) else head_q
    there = np.ones(len(order), bool)
    alive = len(low)
    out: list[list[int]] = []
    while alive:
        left_t, left_s, left_q = float(capacity), segments, float(loss_limit)
        box: list[int] = []
        while left_s and alive:
            score = head_t * (left_t / capacity**2) + head_q * (max(0.0, left_q) / loss_limit**2)  # the segment's part is the same for all
            score[(head_t > left_t) | ((head_q > left_q) & bool(box) & (head_q > 0))] = -1.0
            k = int(score.argmax())
            i = int(top[k])
            if score[k] < 0:  # no largest item of a class fits: the largest smaller one that does
                i = -1
                for c in np.flatnonzero((least_t <= left_t) & ((least_q <= left_q) | (least_q == 0))):
                    fits = np.flatnonzero(there[low[c] : top[c]] & (t[low[c] : top[c]] <= left_t) & ((q[low[c] : top[c]] <= left_q) | (q[low[c] : top[c]] == 0)))
                    if len(fits) and (i < 0 or t[low[c] + fits[-1]] > t[i]):
                        k, i = int(c), int(low[c] + fits[-1])
                if i < 0:
                    break
            box.append(int(order[i]))
            there[i] = False
            left_t -= t[i]
            left_q -= q[i]
            left_s -= 1
            if i != top[k]:
                continue
            while i >= low[k] and not there[i]:
                i -= 1
            if i < low[k]:
                keep = np.ones(alive, bool)
                keep[k] = False
                low, top, head_t, head_q, least_t, least_q = (x[keep] for x in (low, top, head_t, head_q, least_t, least_q))
                alive -= 1
            else:
                top[k] = i
                head_t[k], head_q[k] = t[i], q[i]
        out.append(box)
    return out


def pack(documents: DataFrame, plans: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = 1.0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The contents of each plan's containers: a row for each document, or for each part of one above the capacity.

    start is the part's first token in its document; loss_tokens of parts are dealt in proportion, rounded up. A
    container takes at most capacity / tokens_per_segment segments and loss_share x capacity loss-bearing tokens (an
    item that alone exceeds the latter has no other loss-bearing item beside it). Documents without text, and plans
    without id or positive capacity, have no rows; rows of one plan that are repeated count once, repeated documents as
    often as they come. Sizes are written once; texts are read for nothing else.
    """
    items = written(sizes(documents))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    plans = plans.select("plan_id", "capacity_tokens").where("plan_id is not null and capacity_tokens > 0").dropDuplicates()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        plan, shard, capacity = key
        size, ids = rows["tokens"].to_numpy(np.int64), rows["doc_id"].to_numpy()
        n = -(-size // capacity)
        doc = np.repeat(np.arange(len(size)), n)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = part * capacity
        tokens = np.minimum(capacity, size[doc] - start)
        loss = -(-rows["loss_tokens"].to_numpy(np.int64)[doc] * tokens // size[doc])
        boxes = fill(tokens, loss, int(capacity), max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share)))
        flat = np.array([i for b in boxes for i in b], np.int64)
        counts = np.array([len(b) for b in boxes], np.int64)
        box = np.repeat(np.arange(len(boxes)), counts)
        where = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        d = doc[flat]
        return pd.DataFrame({"plan_id": plan, "shard": shard, "container": box, "position": where, "doc_id": ids[d], "part_no": part[flat], "n_parts": n[d], "tokens": tokens[flat], "loss_tokens": loss[flat], "start": start[flat]})

    wanted = plans.groupBy().agg(F.collect_list(F.struct("plan_id", "capacity_tokens")).alias("plans")).first()["plans"]  # settings: a few rows
    if not wanted:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    each = F.explode(F.array(*(F.struct(F.lit(p["plan_id"]).alias("plan_id"), F.lit(int(p["capacity_tokens"])).alias("capacity_tokens")) for p in wanted)))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "doc_id", "tokens"), F.lit(shards)).cast("int"))
    return dealt.select("doc_id", "tokens", "loss_tokens", "shard", each.alias("p")).select("doc_id", "tokens", "loss_tokens", "shard", "p.*").groupBy("plan_id", "shard", "capacity_tokens").applyInPandas(one, SCHEMA)


def containers(contents: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, shard, container, n_segments, tokens, loss_tokens and fill (tokens by capacity) of each container."""
    capacity = plans.select("plan_id", "capacity_tokens").dropDuplicates()
    found = contents.groupBy("plan_id", "shard", "container").agg(F.count("*").alias("n_segments"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    return found.join(capacity, "plan_id").withColumn("fill", F.col("tokens") / F.col("capacity_tokens")).drop("capacity_tokens")


def oversized(contents: DataFrame) -> DataFrame:
    """plan_id, doc_id of the documents that had to be split."""
    return contents.where("n_parts > 1 and part_no = 0").select("plan_id", "doc_id")


def checked(contents: DataFrame, plans: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = 1.0) -> DataFrame:
    """plan_id, n_parts, tokens, and numbers of containers: over a limit (never any), and with no room left under each limit.

    Full by segments or loss-bearing tokens are those that hold as many segments as they may, or have less than a tenth
    of their loss-bearing tokens left. A container that one item's loss-bearing tokens exceed counts as full, not as over.
    """
    capacity = plans.select("plan_id", "capacity_tokens").dropDuplicates()
    boxes = contents.groupBy("plan_id", "shard", "container").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("q"), F.max("loss_tokens").alias("most")).join(capacity, "plan_id")
    segments, limit = F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / tokens_per_segment)), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * loss_share))
    over = (F.col("t") > F.col("capacity_tokens")) | (F.col("n") > segments) | (F.col("q") > F.greatest(limit, F.col("most")))
    return boxes.groupBy("plan_id").agg(
        F.sum("n").alias("n_parts"), F.sum("t").alias("tokens"), F.count_if(over).alias("n_over"), F.count("*").alias("n_containers"),
        F.count_if(F.col("n") == segments).alias("full_segments"), F.count_if(F.col("q") >= 0.9 * limit).alias("full_loss"), F.count_if(F.col("t") >= 0.99 * F.col("capacity_tokens")).alias("full_tokens"),
    )
