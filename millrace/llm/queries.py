"""The pN_ queries: (session, folder of the tables) -> DataFrame; and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies as _copies
from . import encoding as _encoding
from . import language as _language
from . import mixing as _mixing
from . import near as _near
from . import overlap as _overlap
from . import packing as _packing
from . import splitting as _splitting
from . import subjects as _subjects
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return _language.stretches(documents, _language.fit(documents))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _language.mislabelled(_stretches(spark, d))


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d)


def _overlaps(spark: SparkSession, d: str) -> _overlap.Found:
    return _overlap.find(table(spark, d, "documents"), table(spark, d, "split_rows"), table(spark, d, "manifests"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.pairs(_overlaps(spark, d))


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.overlaps(_overlaps(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.report(_overlaps(spark, d), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _encoding.repaired(table(spark, d, "documents")).select("doc_id", "restored_md5")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _encoding.repaired(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies.copies(table(spark, d, "documents"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return _copies.records(table(spark, d, "documents"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    return _copies.records(table(spark, d, "documents")).agg(F.sum("n_copies").alias("n_documents"), F.max("group_id").alias("last_group"), F.min("n_copies").alias("fewest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near.pairs(table(spark, d, "documents"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near.groups(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _splitting.split(table(spark, d, "documents")).where("piece_no = 0").select("doc_id", "boundary")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _splitting.split(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packing.oversized(_packing.pack(table(spark, d, "documents"), table(spark, d, "pack_plans")))


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return _packing.pack(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return _packing.containers(_packing.pack(table(spark, d, "documents"), plans), plans)


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return _packing.checked(_packing.pack(table(spark, d, "documents"), plans), plans).select("plan_id", "n_parts", "tokens", "n_over")


def p7_bound(spark: SparkSession, d: str) -> DataFrame:
    """A plan in which all three limits bind: short of segments and of loss-bearing tokens."""
    plans, limits = table(spark, d, "pack_plans"), {"tokens_per_segment": 1024, "loss_share": 0.75}
    return _packing.checked(_packing.pack(table(spark, d, "documents"), plans, **limits), plans, **limits)


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the chosen uses come to, against plain arithmetic: the most uses of a document, and targets missed."""
    found = _mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return found.select("recipe_id", "source", F.round("target_tokens").cast("long").alias("target"), "reached", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), (F.col("tokens") <= F.col("target_tokens") + 1e-6).alias("within_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where(~F.col("reached")).select("recipe_id", "source")


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return _subjects.assign(documents, _subjects.fit(documents, table(spark, d, "subject_labels"), table(spark, d, "subject_areas")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects.subjects(_assigned(spark, d))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects.composition(_assigned(spark, d))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


#: Written independently of the operators: plain arithmetic on whole tables.
_BLANK = r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+[^\S\r\n]*"
_SQL = {
    "p6_found": f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '{_BLANK}', chr(1), 'g') AS p FROM documents WHERE strlen(text) > 8192),
        e AS (SELECT doc_id, string_split(p, chr(1)) AS a, string_split(regexp_replace(p, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS b, regexp_split_to_array(p, '[\\s' || chr(1) || ']+') AS c FROM d)
        SELECT doc_id, CASE WHEN list_max(list_transform(a, lambda x: strlen(x))) <= 8192 THEN 'paragraph' WHEN list_max(list_transform(b, lambda x: strlen(x))) <= 8192 THEN 'sentence'
        WHEN list_max(list_transform(c, lambda x: strlen(x))) <= 8192 THEN 'word' ELSE 'none' END AS boundary FROM e""",
    "p4_totals": r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')),
        g AS (SELECT min(doc_id) AS g FROM d GROUP BY regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'))
        SELECT (SELECT count(*) FROM d)::BIGINT AS n_documents, max(g) AS last_group, 1::BIGINT AS fewest FROM g""",
    "p7_totals": """SELECT p.plan_id, sum(ceil((strlen(d.text) + 1) / p.capacity_tokens))::BIGINT AS n_parts, sum(strlen(d.text) + 1)::BIGINT AS tokens, 0::BIGINT AS n_over
        FROM documents d, (SELECT DISTINCT * FROM pack_plans) p WHERE d.text IS NOT NULL GROUP BY p.plan_id""",
    "p8_totals": """WITH s AS (SELECT source, sum(strlen(text) + 1) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source)
        SELECT DISTINCT t.recipe_id, t.source, round(t.target_share * t.total_tokens)::BIGINT AS target, t.max_repeats * coalesce(s.tokens, 0) >= t.target_share * t.total_tokens AS reached,
        true AS within_cap, true AS within_target FROM mix_targets t LEFT JOIN s ON s.source = t.source""",
    "p7_found": """SELECT DISTINCT p.plan_id, d.doc_id FROM documents d, pack_plans p
        WHERE d.text IS NOT NULL AND strlen(d.text) + 1 > p.capacity_tokens""",
    "p8_found": """WITH s AS (SELECT source, sum(strlen(text) + 1) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source)
        SELECT DISTINCT t.recipe_id, t.source FROM mix_targets t LEFT JOIN s ON s.source = t.source
        WHERE t.max_repeats * coalesce(s.tokens, 0) < t.target_share * t.total_tokens""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
