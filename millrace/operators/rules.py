"""Threshold rules over profiles, as findings in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING, NOTE = "error", "warning", "note"

#: Thresholds of the rules.
MIN_CHARS, SMALL_CHARS = 1_000, 1 << 20
CONTROL_ERROR, CONTROL_WARNING = 0.05, 0.001
TABLE_LINES, TABLE_SHARE, TABLE_DIGITS = 20, 0.80, 0.40
CHARS_PER_VOCAB, SATURATION = 100, 0.25
SHORT_MEDIAN, MOSTLY_SPACE = 32, 0.60
HEAVY_DUPLICATION, SOME_DUPLICATION = 0.50, 0.20
DOMINANT_SCRIPT = 0.60

#: Counters that a finding is made of wherever they are above zero: code, level, counter.
COUNTERS = (
    ("files_skipped", WARNING, "files_skipped"),
    ("records_skipped", WARNING, "records_skipped"),
    ("csv_rows_with_extra_fields", WARNING, "extra_field_rows"),
    ("short_documents_dropped", NOTE, "short_documents"),
    ("archive_members_ignored", NOTE, "members_ignored"),
    ("nested_archives_ignored", NOTE, "nested_archives"),
    ("files_unrecognized", NOTE, "files_unrecognized"),
    ("assumed_text", NOTE, "assumed_text"),
    ("documents_were_split", NOTE, "long_files_split"),
)


def suggested_vocab(chars: Column) -> Column:
    """The largest power of two not above chars / 100, at least 258."""
    n = F.floor(chars / CHARS_PER_VOCAB).cast("long")
    return F.greatest(F.lit(258).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(n, F.lit(1)))) - 1))


def findings(profile: DataFrame, allow_tabular: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """rule_no, level, code, value (and the columns to keep) for each rule that holds, in order.

    profile: a row for each corpus with documents, total_chars, the ratios, median_chars, duplicate_rate, replacement_chars, the row
    shape (delimiter, row_share, sampled_lines), digit_share, dominant_script, dominant_share, n_scripts, vocab_size,
    achieved_vocab and the counters. A null measure never makes a finding. An empty corpus has one finding only.
    """
    c = F.col
    table = c("delimiter").isNotNull() & (c("sampled_lines") >= TABLE_LINES) & (c("row_share") >= TABLE_SHARE)
    digits = c("digit_share") >= TABLE_DIGITS
    mixed = (c("dominant_share") < DOMINANT_SCRIPT) & (c("n_scripts") > 1)
    rules: list[tuple[str, str, Column, Column]] = [
        ("corpus_too_small", ERROR, c("total_chars") < MIN_CHARS, c("total_chars")),
        ("likely_binary", ERROR, c("control_ratio") > CONTROL_ERROR, c("control_ratio")),
        ("control_characters", WARNING, (c("control_ratio") > CONTROL_WARNING) & (c("control_ratio") <= CONTROL_ERROR), c("control_ratio")),
        ("rows_not_prose", WARNING, table & ~digits, c("row_share")),
        ("tabular_override", WARNING, table & digits & F.lit(allow_tabular), c("row_share")),
        ("looks_like_a_table", ERROR, table & digits & F.lit(not allow_tabular), c("row_share")),
        ("small_corpus", WARNING, (c("total_chars") >= MIN_CHARS) & (c("total_chars") < SMALL_CHARS), c("total_chars")),
        ("vocab_too_large_for_corpus", WARNING, c("total_chars") < c("vocab_size") * CHARS_PER_VOCAB, suggested_vocab(c("total_chars"))),
        ("vocabulary_saturated", WARNING, (c("achieved_vocab") < c("vocab_size")) & (c("achieved_vocab") / c("vocab_size") < SATURATION), c("achieved_vocab")),
        ("very_short_documents", WARNING, c("median_chars") < SHORT_MEDIAN, c("median_chars")),
        ("mostly_whitespace", WARNING, c("whitespace_ratio") > MOSTLY_SPACE, c("whitespace_ratio")),
        ("heavy_duplication", WARNING, c("duplicate_rate") > HEAVY_DUPLICATION, c("duplicate_rate")),
        ("some_duplication", NOTE, (c("duplicate_rate") > SOME_DUPLICATION) & (c("duplicate_rate") <= HEAVY_DUPLICATION), c("duplicate_rate")),
        ("duplicate_check_truncated", NOTE, c("truncated"), F.lit(1)),
        ("replacement_characters", WARNING, c("replacement_chars") > 0, c("replacement_chars")),
        ("mixed_scripts", NOTE, mixed, c("dominant_share")),
        ("non_latin_script", NOTE, ~mixed & ~c("dominant_script").isin("latin", "digits"), c("dominant_share")),
        *((code, level, c(counter) > 0, c(counter)) for code, level, counter in COUNTERS),
    ]
    empty = c("documents") == 0
    every = [("empty_corpus", ERROR, empty, F.lit(0)), *((k, lv, cond & ~empty, v) for k, lv, cond, v in rules)]
    rows = F.array(*(F.when(cond, F.struct(F.lit(i).alias("rule_no"), F.lit(lv).alias("level"), F.lit(k).alias("code"), v.cast("double").alias("value"))) for i, (k, lv, cond, v) in enumerate(every, 1)))
    return profile.select(*keep, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(*keep, "f.*")


def verdict(found: DataFrame, by: str = "content_hash") -> DataFrame:
    """ok, first_error, errors, warnings, notes for each group of findings (rule_no, level, code)."""
    level = F.lower("level")
    first = F.min_by("code", F.when(level == ERROR, F.col("rule_no")))
    return found.groupBy(by).agg((F.count_if(level == ERROR) == 0).alias("ok"), first.alias("first_error"), F.count_if(level == ERROR).alias("errors"), F.count_if(level == WARNING).alias("warnings"), F.count_if(~level.isin(ERROR, WARNING)).alias("notes"))
