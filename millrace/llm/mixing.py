"""Problem 8: records of several sources in target shares of a total size, small sources repeated up to a cap.

The documents of a source are dealt to blocks by hash. A source's quota is its number of block uses: whole passes over
its blocks, then a part of a permuted pass, of whose last block only some documents are taken. A splitting tree deals
the quotas to output shards: at each node the left half gets a multivariate hypergeometric draw from what the node has.
Every leaf recomputes its path from the root, so that nothing larger than one path is held anywhere; it then knows its
range of the source's permuted blocks, disjoint from those of all other leaves. Rows are shuffled within their shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Documents of a block, and the most blocks of a source.
BLOCK_DOCUMENTS, MOST_BLOCKS = 128, 1 << 16
#: Tokens of an output shard.
SHARD_TOKENS = 4_000_000
SEED = 20


def leaf(seed: int, quotas: np.ndarray, shards: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each source's permuted block uses that belong to the shard."""
    low, high = 0, shards
    first, have = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(have.sum())
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, round(total * (middle - low) / (high - low)), method="marginals") if total else have
        if shard < middle:
            high, have = middle, left
        else:
            low, first, have = middle, first + left, have - left
    return first, first + have


def plan(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sized, wanted): documents with tokens and block; and for each recipe and source what is wanted and there.

    wanted: recipe_id, source, target_share, max_repeats, total_tokens, need, have (tokens of one pass), blocks.
    """
    targets = targets.select("recipe_id", "source", "target_share", "max_repeats", "total_tokens").where("recipe_id is not null and source is not null and target_share is not null and total_tokens is not null").dropDuplicates(["recipe_id", "source"])
    sources = targets.select("source").distinct()
    sized = documents.where("text is not null and source is not null").select("doc_id", "source", (F.octet_length("text") + 1).cast("long").alias("tokens"))
    sized = written(sized.join(sources, "source", "left_semi"))
    stats = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    stats = stats.withColumn("blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / BLOCK_DOCUMENTS)).cast("long"))
    wanted = targets.join(stats, "source", "left").fillna({"have": 0, "n": 0, "blocks": 0})
    wanted = wanted.withColumn("need", F.col("target_share") * F.col("total_tokens")).withColumn("max_repeats", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))))
    return sized, written(wanted)


def uses(sized: DataFrame, wanted: DataFrame, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """recipe_id, shard, position, source, doc_id, use_no, tokens: every chosen use of a document.

    A source whose cap is too low for its share is used max_repeats times. A recipe's tokens miss the total by less
    than a document for each source that reaches its share.
    """
    blocked = sized.join(wanted.select("source", "blocks").distinct(), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    blocked = written(blocked.select("source", "block", "doc_id", "tokens"))
    blocks = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    full = F.least(F.floor(F.col("need") / F.col("have")), F.col("max_repeats")).cast("long")
    w = wanted.where("have > 0").withColumn("full", full).withColumn("rest", F.when(F.col("full") < F.col("max_repeats"), F.col("need") - F.col("full") * F.col("have")).otherwise(F.lit(0.0)))
    passes = w.withColumn("use_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).where("use_no < full or rest > 0")
    each = passes.join(blocks.hint("merge"), "source").withColumn("h", F.xxhash64(F.lit(seed), "recipe_id", "source", "use_no", "block"))
    till = F.sum("block_tokens").over(W.partitionBy("recipe_id", "source", "use_no").orderBy("h", "block").rowsBetween(W.unboundedPreceding, W.currentRow))
    each = each.withColumn("till", till).withColumn("take", F.when(F.col("use_no") < F.col("full"), F.col("block_tokens").cast("double")).otherwise(F.col("rest") - F.col("till") + F.col("block_tokens"))).where("take > 0")
    each = each.withColumn("j", F.row_number().over(W.partitionBy("recipe_id", "source").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "use_no", "block")) - 1)  # of at most MOST_BLOCKS x repeats
    each = written(each.select("recipe_id", "source", "use_no", "block", "j", "take", (F.col("take") >= F.col("block_tokens")).alias("whole")))

    quotas = each.groupBy("recipe_id", "source").agg(F.count("*").alias("quota")).groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("quotas"))
    shards = wanted.groupBy("recipe_id").agg(F.max("total_tokens").alias("total")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("total") / shard_tokens)).cast("int"))
    leaves = quotas.join(shards, "recipe_id").select("recipe_id", "quotas", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                names, counts = [q["source"] for q in r.quotas], np.array([q["quota"] for q in r.quotas])
                lo, hi = leaf(zlib.crc32(f"{seed} {r.recipe_id}".encode()), counts, r.shards, r.shard)
                n = hi - lo
                yield pd.DataFrame({"recipe_id": r.recipe_id, "source": np.repeat(np.array(names, object), n), "shard": r.shard, "j": np.arange(n.sum(), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)})

    dealt = leaves.repartition("recipe_id", "shard").mapInPandas(deal, "recipe_id string, source string, shard int, j long")
    chosen = each.join(dealt.hint("merge"), ["recipe_id", "source", "j"])  # as many rows as block uses: never broadcast
    rows = blocked.join(chosen.hint("merge"), ["source", "block"])

    def part(f: pd.DataFrame) -> pd.DataFrame:
        """Of one block, in permuted order, every document that still fits."""
        f = f.sort_values(["h", "doc_id"])
        rest, keep = float(f["take"].iloc[0]), []
        for t in f["tokens"]:
            keep.append(t <= rest)
            rest -= t * keep[-1]
        return f.loc[keep, names]

    names = ["recipe_id", "source", "shard", "doc_id", "use_no", "tokens"]
    cut = rows.where(~F.col("whole")).withColumn("h", F.xxhash64(F.lit(seed + 2), "doc_id")).groupBy("recipe_id", "source", "block").applyInPandas(part, "recipe_id string, source string, shard int, doc_id long, use_no long, tokens long")
    kept = rows.where("whole").select(names).unionByName(cut)
    place = F.row_number().over(W.partitionBy("recipe_id", "shard").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "use_no"), "doc_id", "use_no")) - 1
    return kept.select("recipe_id", "shard", place.alias("position"), "source", "doc_id", "use_no", "tokens")


def shares(chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each recipe and source: target and actual share and tokens, uses, the most uses of one document, reached.

    A source isn't reached if the uses chosen have spent all its documents as often as they may be used, and still miss
    the target.
    """
    per = chosen.groupBy("recipe_id", "source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("recipe_id", "source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_uses"))
    all_of = per.groupBy("recipe_id").agg(F.sum("tokens").alias("recipe_tokens"))
    out = wanted.join(per, ["recipe_id", "source"], "left").join(all_of, "recipe_id", "left").fillna({"tokens": 0, "uses": 0, "most_uses": 0})
    spent = F.col("tokens") >= F.col("max_repeats") * F.col("have")
    return out.select("recipe_id", "source", "target_share", (F.col("tokens") / F.col("recipe_tokens")).alias("actual_share"), F.col("need").alias("target_tokens"), "tokens", "uses", "most_uses", "max_repeats", (~(spent & (F.col("tokens") < F.col("need")))).alias("reached"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of the recipes in targets. Null and empty inputs give no rows; repeated targets count once."""
    sized, wanted = plan(documents, targets)
    chosen = uses(sized, wanted, seed)
    return chosen, shares(chosen, wanted)
