"""What a corpus is: one pass of aggregates over documents (text, source), whole texts throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

DELIMITERS = (",", "\t", ";", "|")


def corpus(documents: DataFrame) -> DataFrame:
    """One row of sizes, character mix and exact duplicates. Null texts are no documents."""
    t = F.col("text")
    n = F.length(t).cast("long")
    counts = {"b": F.octet_length(t).cast("long"), "ws": X.count(t, X.SPACE), "na": X.count(t, r"[^\x00-\x7F]"), "ctl": X.count(t, X.CONTROL), "rep": X.count(t, r"\x{FFFD}")}
    d = documents.where(t.isNotNull()).select("source", F.md5(t).alias("h"), n.alias("n"), *(c.alias(k) for k, c in counts.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = d.agg(
        F.count("*").alias("documents"),
        total("n").alias("total_chars"),
        total("b").alias("total_utf8_bytes"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_chars"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_chars"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_chars"),
        total("ws").alias("whitespace_chars"),
        total("na").alias("non_ascii_chars"),
        total("ctl").alias("control_chars"),
        total("rep").alias("replacement_chars"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("h").alias("unique_documents"),
    )
    out = out.withColumn("duplicate_documents", F.col("documents") - F.col("unique_documents"))
    return out.withColumns(
        {
            "duplicate_rate": X.ratio(F.col("duplicate_documents"), F.col("documents")),
            "whitespace_ratio": X.ratio(F.col("whitespace_chars"), F.col("total_chars")),
            "non_ascii_ratio": X.ratio(F.col("non_ascii_chars"), F.col("total_chars")),
            "control_ratio": X.ratio(F.col("control_chars"), F.col("total_chars")),
            "rough_tokens": (F.col("total_chars") / 4).cast("long"),
        }
    )


def percentiles(documents: DataFrame, marks: dict[str, float] | None = None) -> DataFrame:
    """Nearest-rank percentiles of length: the value at index round-half-even(q x (n - 1)), from a histogram of lengths."""
    marks = marks or {"p10_chars": 0.10, "median_chars": 0.50, "p90_chars": 0.90}
    hist = documents.where("text is not null").groupBy(F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))
    w = W.orderBy("n")  # over the distinct lengths, not the documents
    ranked = hist.withColumn("till", F.sum("c").over(w)).withColumn("all", F.sum("c").over(W.partitionBy()))
    at = lambda q: F.rint(F.lit(q) * (F.col("all") - 1))
    return ranked.agg(*(F.min(F.when(F.col("till") > at(q), F.col("n"))).alias(name) for name, q in marks.items()))


def chars_by_source(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text").cast("long")).alias("chars"))


def largest_sources(documents: DataFrame, limit: int = 5) -> DataFrame:
    return chars_by_source(documents).where("source is not null").orderBy(F.desc("chars"), "source").limit(limit)


def scripts(documents: DataFrame) -> DataFrame:
    """script, chars of every bucket, in one pass."""
    sums = documents.where("text is not null").agg(*(F.coalesce(F.sum(X.count(F.col("text"), X.script_class(s))), F.lit(0)).alias(s) for s in X.SCRIPTS))
    return sums.unpivot([], list(X.SCRIPTS), "script", "chars")


def script_shares(documents: DataFrame) -> DataFrame:
    """script, chars, share, rank of the buckets that occur; shares of the buckets' sum, not of all characters."""
    s = scripts(documents)
    total = F.sum("chars").over(W.partitionBy())  # a row for each bucket
    return s.withColumn("share", F.col("chars") / total).where("chars > 0").withColumn("rank", F.row_number().over(W.orderBy(F.desc("chars"), "script")))


def row_tally(texts: DataFrame) -> DataFrame:
    """delimiter, found (at least two on a line), width (characters of such lines); the row with delimiter null has all lines."""
    lines = texts.where("text is not null").select(F.explode(F.split("text", X.LINE_BREAK)).alias("line")).where(F.length(X.strip(F.col("line"))) > 0)
    counted = lines.select(F.length("line").cast("long").alias("width"), *(F.length(F.col("line")) - F.length(F.replace(F.col("line"), F.lit(d), F.lit(""))) for d in DELIMITERS)).toDF("width", "d0", "d1", "d2", "d3")
    by_shape = counted.groupBy("d0", "d1", "d2", "d3").agg(F.count("*").alias("lines"), F.sum("width").alias("width"))
    pairs = F.array(F.struct(F.lit(None).cast("string").alias("delimiter"), F.lit(None).cast("int").alias("found")), *(F.struct(F.lit(d).alias("delimiter"), F.col(f"d{i}").alias("found")) for i, d in enumerate(DELIMITERS)))
    each = by_shape.select("lines", "width", F.explode(pairs).alias("p")).where("p.delimiter is null or p.found >= 2")
    return each.groupBy("p.delimiter", "p.found").agg(F.sum("lines").alias("lines"), F.sum("width").alias("width"))


def strongest_row_shape(texts: DataFrame) -> DataFrame:
    """delimiter, fields, row_share, lines: of each delimiter the count with most text (the smaller on ties), of these the
    strictly largest share (the earlier delimiter on ties)."""
    tally = row_tally(texts)
    rank = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter"))
    best = tally.agg(
        F.max(F.when(F.col("delimiter").isNotNull(), F.struct("width", (-rank).alias("order"), (-F.col("found")).alias("less")))).alias("b"),
        F.max(F.when(F.col("delimiter").isNull(), F.col("width"))).alias("all"),
        F.max(F.when(F.col("delimiter").isNull(), F.col("lines"))).alias("sampled_lines"),
    )
    delimiter = F.element_at(F.array(*map(F.lit, DELIMITERS)), (-F.col("b.order")).cast("int"))
    has = F.col("b").isNotNull()
    return best.select(F.when(has, delimiter).alias("delimiter"), F.when(has, 1 - F.col("b.less")).otherwise(0).cast("long").alias("fields"), F.when(has, F.col("b.width") / F.col("all")).otherwise(0.0).alias("row_share"), F.coalesce("sampled_lines", F.lit(0)).alias("sampled_lines"))


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """text_md5, copies, first_id of texts that occur more than once, exactly."""
    return documents.where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def kept(documents: DataFrame, least: int = 20) -> DataFrame:
    """source, kept, short: documents whose stripped text has at least max(1, least) characters, and the others."""
    n = F.length(X.strip(F.col("text")))
    ok = n >= max(1, least)
    return documents.where("text is not null").groupBy("source").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("short"))
