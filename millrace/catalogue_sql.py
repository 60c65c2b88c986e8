"""The same queries in DuckDB's SQL, written another way where there is one."""

from __future__ import annotations

from . import catalogue_more
from .catalogue import CHUNK, SEED, SEQ_LEN, SHARD_TOKENS, STOPS, VAL_FRACTION
from .functions.formats import COMPASS
from .functions.text import CONTROL, LINE_BREAK, SCRIPTS, SPACE, script_class
from .operators.profile import DELIMITERS

_NONSPACE = "[^" + SPACE[1:]


def _gone(pattern: str, column: str = "text") -> str:
    return f"(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')))"


_DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_PROFILE = f"""SELECT count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS total_chars, coalesce(sum(strlen(text)), 0)::BIGINT AS total_utf8_bytes,
    coalesce(min(length(text)), 0) AS min_chars, coalesce(max(length(text)), 0) AS max_chars, coalesce(avg(length(text)), 0.0) AS mean_chars,
    coalesce(sum({_gone(SPACE)}), 0)::BIGINT AS whitespace_chars, coalesce(sum({_gone("[^" + chr(92) + "x00-" + chr(92) + "x7F]")}), 0)::BIGINT AS non_ascii_chars,
    coalesce(sum({_gone(CONTROL)}), 0)::BIGINT AS control_chars, coalesce(sum({_gone(chr(92) + "x{FFFD}")}), 0)::BIGINT AS replacement_chars,
    count(DISTINCT source) AS sources, count(DISTINCT text) AS unique_documents FROM {_DOCS}"""
_RATIOS = """SELECT *, documents - unique_documents AS duplicate_documents,
    CASE WHEN documents = 0 THEN 0.0 ELSE (documents - unique_documents) / documents END AS duplicate_rate,
    CASE WHEN total_chars = 0 THEN 0.0 ELSE whitespace_chars / total_chars END AS whitespace_ratio,
    CASE WHEN total_chars = 0 THEN 0.0 ELSE non_ascii_chars / total_chars END AS non_ascii_ratio,
    CASE WHEN total_chars = 0 THEN 0.0 ELSE control_chars / total_chars END AS control_ratio,
    total_chars // 4 AS rough_tokens FROM p"""
_SCRIPTS = " UNION ALL ".join(f"SELECT '{n}' AS script, coalesce(sum({_gone(script_class(n))}), 0)::BIGINT AS chars FROM {_DOCS}" for n in SCRIPTS)
_PERCENTILES = f"""r AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM {_DOCS})"""


def _rows(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{d}' AS delimiter, {i} AS o, length(line) - length(replace(line, '{d}', '')) AS found, length(line) AS width FROM l" for i, d in enumerate(DELIMITERS))
    return f"""l AS (SELECT line FROM (SELECT unnest(regexp_split_to_array(text, '{LINE_BREAK}')) AS line FROM {source}) WHERE regexp_matches(line, '{_NONSPACE}')),
    e AS ({each}), t AS (SELECT delimiter, o, found, count(*) AS lines, sum(width)::BIGINT AS width FROM e WHERE found >= 2 GROUP BY ALL),
    b AS (SELECT * FROM t ORDER BY width DESC, o, found LIMIT 1), a AS (SELECT coalesce(sum(length(line)), 0)::BIGINT AS total, count(*) AS n FROM l)"""


_SHAPE = """SELECT b.delimiter, coalesce(b.found + 1, 0)::BIGINT AS fields, coalesce(b.width / a.total, 0.0) AS row_share, a.n AS sampled_lines FROM a LEFT JOIN b ON TRUE"""
_LINEITEM_TEXT = "(SELECT concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber, trunc(l_quantity)::BIGINT, l_returnflag, l_linestatus) AS text FROM lineitem)"
_FRACTION = f"(('0x' || substr(sha256('{SEED}:' || text), 1, 12))::BIGINT / {float(1 << 48)})"
_SIDE = f"CASE WHEN {_FRACTION} < {VAL_FRACTION} THEN 'val' ELSE 'train' END"
_SIDED = f"t AS (SELECT doc_id, {_SIDE} AS split, strlen(text) + 1 AS tokens FROM {_DOCS})"
_OFFSETS = f"{_SIDED}, o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token FROM t)"
_SHARDS = "h AS (SELECT DISTINCT ON (content_hash, split_name, shard_no) * FROM shards)"
_SHARD_OFFSETS = f"{_SHARDS}, o AS (SELECT content_hash, split_name, shard_no, tokens, (sum(tokens) OVER (PARTITION BY content_hash, split_name ORDER BY shard_no) - tokens)::BIGINT AS first_token FROM h)"

# conversations: turns by the labels that begin lines
_TURNS = r"""c AS (SELECT doc_id, text, regexp_split_to_array(text, '(?:^|\n)(?:System|User|Assistant):') AS p, regexp_extract_all(text, '(?:^|\n)(System|User|Assistant):', 1) AS l
        FROM documents WHERE regexp_matches(text, '^(System|User|Assistant): ')),
    u AS (SELECT doc_id, text, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, l, p FROM c),
    v AS (SELECT doc_id, i, n, lower(l[i]) AS role, l[i] AS label, regexp_replace(regexp_replace(p[i + 1], '^ ', ''), '\n$', '') AS content,
        CASE WHEN i = 1 THEN '' WHEN l[i - 1] = 'Assistant' AND l[i] <> 'Assistant' THEN chr(10) || chr(10) ELSE chr(10) END AS gap,
        CASE WHEN i = n THEN 0 WHEN l[i] = 'Assistant' AND l[i + 1] <> 'Assistant' THEN 2 ELSE 1 END AS behind FROM u)"""
_PIECES = _TURNS + ", w AS (SELECT *, gap || label || ': ' || content AS piece FROM v)"

#: A line that is JSON by the standard, which has no NaN and no Infinity.
_VALID = r"(json_valid(line) AND NOT regexp_matches(line, ':\s*-?(NaN|Infinity)\b'))"
_REC = f"""j AS (SELECT DISTINCT run_id, line_no, line FROM metrics_lines WHERE line IS NOT NULL AND {_VALID} AND json_type(try_cast(line AS JSON)) = 'OBJECT'),
    q AS (SELECT run_id, line_no, line ->> '$.event' AS event,
        CASE WHEN json_type(line, '$.step') IN ('BIGINT', 'UBIGINT') THEN (line ->> '$.step')::BIGINT END AS step,
        CASE WHEN json_type(line, '$.loss') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (line ->> '$.loss')::DOUBLE END AS loss,
        CASE WHEN json_type(line, '$.val_loss') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (line ->> '$.val_loss')::DOUBLE END AS val_loss,
        CASE WHEN json_type(line, '$.tokens') IN ('BIGINT', 'UBIGINT') THEN (line ->> '$.tokens')::BIGINT END AS tokens,
        CASE WHEN json_type(line, '$.elapsed') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (line ->> '$.elapsed')::DOUBLE END AS elapsed,
        line ->> '$.path' AS path, coalesce((line ->> '$.is_best') = 'true', FALSE) AS is_best FROM j)"""
_CKPT = _REC + r""", k AS (SELECT run_id, regexp_extract(path, '[^/]*$') AS name, bool_or(is_best) AS is_best, max(line_no) AS line_no FROM q WHERE event = 'checkpoint' AND path IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT *, regexp_extract(name, '(\d+)$', 1)::BIGINT AS step FROM k WHERE regexp_matches(name, '\d+$')),
    z AS (SELECT run_id, arg_max(name, step) AS latest, coalesce(arg_max(name, line_no) FILTER (is_best), arg_min(name, line_no)) AS best FROM s GROUP BY 1)"""

_LOGITS = "g AS (SELECT vec_id, unnest(range(0, len(embedding))) AS token_id, unnest(embedding)::DOUBLE AS logit FROM embeddings)"
_PRESETS = "a AS (SELECT *, n * 0 + 32000::BIGINT AS v, 64 * ((floor(8 * d / 3)::BIGINT + 63) // 64) AS ffn_dim FROM (VALUES (0, 'tiny', 4::BIGINT, 256::BIGINT, 256), (1, 'small', 6, 384, 512), (2, 'medium', 8, 512, 512), (3, 'large', 12, 768, 1024)) x(rung, name, n, d, seq))"
_PARAMS = _PRESETS + ", p AS (SELECT *, v * d AS embedding, n * 4 * d * d AS attention, n * 3 * d * ffn_dim AS ffn, n * 2 * d + d AS norm, v * d + n * 4 * d * d + n * 3 * d * ffn_dim + n * 2 * d + d AS parameters FROM a)"


def _three(v: str) -> str:
    return f"CASE WHEN abs({v}) < 10 THEN printf('%.2f', {v}) WHEN abs({v}) < 100 THEN printf('%.1f', {v}) ELSE printf('%.0f', {v}) END"


_COUNT = "CASE " + " ".join(f"WHEN n >= {t} THEN {_three(f'(n / {float(t)})')} || '{u}'" for t, u in ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K"))) + " ELSE printf('%.0f', n::DOUBLE) END"
_SIZE = "CASE " + " ".join(f"WHEN n >= {1024**k} THEN {_three(f'(n / {float(1024**k)})')} || ' {u}'" for k, u in ((5, "PiB"), (4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + " ELSE n || ' B' END"
_DURATION = "CASE WHEN s = 0 THEN '0s' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) WHEN s < 86400 THEN printf('%dh %02dm', s // 3600, s // 60 % 60) ELSE printf('%dd %dh', s // 86400, s // 3600 % 24) END"
def _text(s: str) -> str:
    return "'" + s.replace("\n", "' || chr(10) || '") + "'"


def _stops() -> str:
    """Where each stop string begins, 1e9 for nowhere; the least of them, and the first that has it."""
    at = [f"CASE WHEN strpos(text, {_text(s)}) > 0 THEN strpos(text, {_text(s)}) - 1 ELSE 1000000000 END" for s in STOPS]
    first = " ".join(f"WHEN {a} = m THEN {i}" for i, a in enumerate(at))
    held = ", ".join(f"CASE WHEN suffix(text, {_text(s[:k])}) THEN {k} ELSE 0 END" for s in STOPS for k in range(1, len(s)))
    return f"SELECT doc_id, CASE WHEN m < 1000000000 THEN m END AS at, CASE WHEN m = 1000000000 THEN NULL {first} END AS stop_no, greatest(0, {held}) AS held_back FROM (SELECT *, least({', '.join(at)}) AS m FROM {_DOCS})"


_COMPASS = "(list_value(" + ", ".join(f"'{c}'" for c in COMPASS) + "))"

SQL: dict[str, str] = {
    "corpus_profile": f"WITH p AS ({_PROFILE}) {_RATIOS}",
    "length_percentiles": f"WITH {_PERCENTILES} SELECT max(n) FILTER (i = round_even(0.1 * (c - 1), 0)) AS p10_chars, max(n) FILTER (i = round_even(0.5 * (c - 1), 0)) AS median_chars, max(n) FILTER (i = round_even(0.9 * (c - 1), 0)) AS p90_chars FROM r",
    "chars_by_source": f"SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM {_DOCS} GROUP BY source",
    "largest_sources": f"SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM {_DOCS} WHERE source IS NOT NULL GROUP BY source ORDER BY chars DESC, source LIMIT 5",
    "script_histogram": _SCRIPTS,
    "script_shares": f"WITH s AS ({_SCRIPTS}) SELECT script, chars, chars / (SELECT sum(chars) FROM s) AS share, row_number() OVER (ORDER BY chars DESC, script) AS rank FROM s WHERE chars > 0",
    "row_regularity": f"WITH {_rows(_DOCS)} SELECT delimiter, found, lines, width FROM t",
    "strongest_row_shape": f"WITH {_rows(_DOCS)} {_SHAPE}",
    "tabular_detector": f"WITH {_rows(_LINEITEM_TEXT)} {_SHAPE}",
    "duplicate_groups": f"SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM {_DOCS} GROUP BY text HAVING count(*) > 1",
    "keep_filter": f"SELECT source, count(*) FILTER (n >= 20) AS kept, count(*) FILTER (n < 20) AS short FROM (SELECT source, length(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) AS n FROM {_DOCS}) GROUP BY source",
    "validation_findings": f"""WITH p AS ({_PROFILE}), m AS ({_RATIOS}), sc AS (SELECT * FROM ({_SCRIPTS}) WHERE chars > 0),
        d AS (SELECT arg_max(script, chars) AS dom, max(chars) / sum(chars) AS share, count(*) AS k, coalesce(sum(chars) FILTER (script = 'digits'), 0) / sum(chars) AS digits FROM sc),
        {_rows(_DOCS)}, sh AS ({_SHAPE}), {_PERCENTILES}, md AS (SELECT max(n) FILTER (i = round_even(0.5 * (c - 1), 0)) AS med FROM r),
        f AS (SELECT count(*) FILTER (size_bytes IS NULL) AS skipped FROM (SELECT DISTINCT * FROM source_files)),
        ks AS (SELECT count(*) AS short FROM {_DOCS} WHERE length(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) < 20),
        x AS (SELECT *, delimiter IS NOT NULL AND sampled_lines >= 20 AND row_share >= 0.8 AS tab FROM m, d, sh, md, f, ks)
        SELECT rule_no, level, code, round(value, 6) AS value FROM (
        SELECT 2 AS rule_no, 'error' AS level, 'corpus_too_small' AS code, total_chars::DOUBLE AS value FROM x WHERE total_chars < 1000
        UNION ALL SELECT 3, 'error', 'likely_binary', control_ratio FROM x WHERE control_ratio > 0.05
        UNION ALL SELECT 4, 'warning', 'control_characters', control_ratio FROM x WHERE control_ratio > 0.001 AND control_ratio <= 0.05
        UNION ALL SELECT 5, 'warning', 'rows_not_prose', row_share FROM x WHERE tab AND digits < 0.4
        UNION ALL SELECT 7, 'error', 'looks_like_a_table', row_share FROM x WHERE tab AND digits >= 0.4
        UNION ALL SELECT 8, 'warning', 'small_corpus', total_chars FROM x WHERE total_chars BETWEEN 1000 AND 1048575
        UNION ALL SELECT 9, 'warning', 'vocab_too_large_for_corpus', greatest(258, pow(2, floor(log2(greatest(1, total_chars // 100))))) FROM x WHERE total_chars < 3200000
        UNION ALL SELECT 10, 'warning', 'vocabulary_saturated', 6000 FROM x
        UNION ALL SELECT 11, 'warning', 'very_short_documents', med FROM x WHERE med < 32
        UNION ALL SELECT 12, 'warning', 'mostly_whitespace', whitespace_ratio FROM x WHERE whitespace_ratio > 0.6
        UNION ALL SELECT 13, 'warning', 'heavy_duplication', duplicate_rate FROM x WHERE duplicate_rate > 0.5
        UNION ALL SELECT 14, 'note', 'some_duplication', duplicate_rate FROM x WHERE duplicate_rate > 0.2 AND duplicate_rate <= 0.5
        UNION ALL SELECT 16, 'warning', 'replacement_characters', replacement_chars FROM x WHERE replacement_chars > 0
        UNION ALL SELECT 17, 'note', 'mixed_scripts', share FROM x WHERE share < 0.6 AND k > 1
        UNION ALL SELECT 18, 'note', 'non_latin_script', share FROM x WHERE NOT (share < 0.6 AND k > 1) AND dom NOT IN ('latin', 'digits')
        UNION ALL SELECT 19, 'warning', 'files_skipped', skipped FROM x WHERE skipped > 0
        UNION ALL SELECT 22, 'note', 'short_documents_dropped', short FROM x WHERE short > 0)""",
    "dataset_verdicts": "WITH f AS (SELECT DISTINCT content_hash, rule_no, lower(level) AS level, code, message FROM findings) SELECT content_hash, count(*) FILTER (level = 'error') = 0 AS ok, arg_min(code, rule_no) FILTER (level = 'error') AS first_error, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level NOT IN ('error', 'warning')) AS notes FROM f GROUP BY content_hash",
    "source_kinds": "SELECT kind, compressed, count(*) AS files, count(DISTINCT split_part(path, '::', 1)) AS containers, sum(size_bytes)::BIGINT AS bytes FROM (SELECT DISTINCT path, kind, compressed, size_bytes FROM source_files) GROUP BY 1, 2",
    "name_classes": r"""SELECT path, CASE WHEN regexp_matches(s, '\.(jsonl|ndjson)$') THEN 'jsonl' WHEN s LIKE '%.json' THEN 'json' WHEN regexp_matches(s, '\.(csv|tsv)$') THEN 'csv' WHEN s LIKE '%.docx' THEN 'docx'
        WHEN regexp_matches(s, '\.(db|sqlite|sqlite3)$') THEN 'sqlite' WHEN regexp_matches(s, '\.(txt|text|md|rst|log)$') THEN 'text' END AS kind,
        coalesce(nullif(regexp_extract(lower(path), '\.(gz|bz2|xz|lzma)$', 1), ''), 'none') AS codec, strpos(path, '::') > 0 AS in_archive, regexp_matches(path, '(^|/)\.') AS hidden
        FROM (SELECT DISTINCT path, regexp_replace(lower(path), '\.(gz|bz2|xz|lzma)$', '') AS s FROM source_files)""",
    "biggest_files": f"SELECT path, n AS size_bytes, {_SIZE} AS shown FROM (SELECT DISTINCT path, size_bytes AS n FROM source_files WHERE size_bytes IS NOT NULL) ORDER BY n DESC, path LIMIT 3",
    "document_locations": "SELECT doc_id, source || ':' || ordinal || ' (byte ' || format('{:,}', byte_offset) || ')' AS location FROM documents WHERE source IS NOT NULL AND ordinal IS NOT NULL AND byte_offset IS NOT NULL",
    "emitted_ordinals": f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ordinal NULLS FIRST, doc_id) - 1 AS kept_ordinal FROM {_DOCS} WHERE source IS NOT NULL AND length(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) >= 20",
    "missing_sources": "SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT path FROM source_files WHERE size_bytes IS NOT NULL AND path IS NOT NULL) GROUP BY source",
    "content_split_sha": f"SELECT doc_id, {_FRACTION} AS fraction, {_SIDE} AS split FROM {_DOCS}",
    "split_summary_rollup": f"WITH x AS (SELECT {_SIDE} AS split, length(text) AS n FROM {_DOCS}) SELECT split, count(*) AS documents, sum(n)::BIGINT AS chars FROM x GROUP BY split UNION ALL SELECT 'total', count(*), coalesce(sum(n), 0)::BIGINT FROM x",
    "dataset_sides": "WITH m AS (SELECT content_hash, max(val_fraction) AS f FROM manifests WHERE val_fraction IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT content_hash, doc_id, fraction FROM split_rows WHERE fraction IS NOT NULL) SELECT content_hash, count(*) FILTER (fraction < f) AS val, count(*) FILTER (fraction >= f) AS train FROM r JOIN m USING (content_hash) GROUP BY 1",
    "orphan_split_rows": "SELECT content_hash, count(*) AS n FROM split_rows WHERE content_hash IS NULL OR content_hash NOT IN (SELECT content_hash FROM manifests WHERE content_hash IS NOT NULL) GROUP BY 1",
    "doc_chunks": f"""WITH RECURSIVE w(doc_id, piece_no, start, rest, piece) AS (
        SELECT doc_id, -1, 0::BIGINT, text, '' FROM {_DOCS}
        UNION ALL SELECT doc_id, piece_no + 1, start + length(piece), substr(rest, cut + 1), substr(rest, 1, cut) FROM (
            SELECT *, CASE WHEN length(rest) <= {CHUNK} THEN length(rest) WHEN p2 > {CHUNK // 2} THEN p2 + 2 WHEN p1 > {CHUNK // 2} THEN p1 + 1 WHEN p0 > {CHUNK // 2} THEN p0 + 1 ELSE {CHUNK} END AS cut FROM (
                SELECT *, {CHUNK} - strpos(reverse(substr(rest, 1, {CHUNK})), chr(10) || chr(10)) - 1 - CASE WHEN strpos(reverse(substr(rest, 1, {CHUNK})), chr(10) || chr(10)) = 0 THEN {CHUNK} ELSE 0 END AS p2,
                    {CHUNK} - strpos(reverse(substr(rest, 1, {CHUNK})), chr(10)) - CASE WHEN strpos(substr(rest, 1, {CHUNK}), chr(10)) = 0 THEN {CHUNK} ELSE 0 END AS p1,
                    {CHUNK} - strpos(reverse(substr(rest, 1, {CHUNK})), ' ') - CASE WHEN strpos(substr(rest, 1, {CHUNK}), ' ') = 0 THEN {CHUNK} ELSE 0 END AS p0 FROM w))
            WHERE piece_no = -1 OR length(rest) > 0)
        SELECT doc_id, piece_no, start, length(piece) AS n_chars, md5(piece) AS piece_md5 FROM w WHERE piece_no >= 0""",
    "chat_turns": f"WITH {_TURNS} SELECT role, count(*) AS turns, sum(length(content))::BIGINT AS chars FROM v GROUP BY role",
    "chat_render": f"WITH {_PIECES} SELECT doc_id, md5(string_agg(piece, '' ORDER BY i)) AS rendered_md5 FROM w GROUP BY doc_id",
    "chat_spans": f"""WITH {_PIECES}, e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS till FROM w)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, till - length(content) AS span_start, till + behind AS span_end FROM e WHERE role = 'assistant'""",
    "chat_prompt": f"WITH {_PIECES} SELECT doc_id, md5(string_agg(piece, '' ORDER BY i) || chr(10) || 'Assistant:') AS prompt_md5 FROM w WHERE n > 1 AND NOT (i = n AND role = 'assistant') GROUP BY doc_id",
    "chat_refusals": f"WITH {_TURNS}, e AS (SELECT doc_id, bool_or(length(trim(content)) = 0) AS empty, bool_or(role = 'assistant') AS replies FROM v GROUP BY doc_id) SELECT CASE WHEN empty THEN 'empty_content' WHEN NOT replies THEN 'no_assistant' ELSE 'none' END AS problem, count(*) AS n FROM e GROUP BY 1",
    "chat_trained_share": "WITH x AS (SELECT source, length(text) AS n, list_sum(list_transform(trained_spans, lambda s: s.span_end - s.span_start)) AS t FROM documents WHERE text IS NOT NULL AND len(trained_spans) > 0) SELECT source, sum(t)::BIGINT AS trained, sum(n)::BIGINT AS chars, sum(t) / greatest(1, sum(n)) AS share FROM x GROUP BY source",
    "stop_strings": _stops(),
    "token_offsets": f"WITH {_OFFSETS} SELECT doc_id, split, tokens, first_token FROM o",
    "token_shards": f"""WITH {_OFFSETS}, e AS (SELECT *, unnest(range(first_token // {SHARD_TOKENS}, (first_token + tokens - 1) // {SHARD_TOKENS} + 1)) AS shard_no FROM o)
        SELECT split, shard_no, sum(least((shard_no + 1) * {SHARD_TOKENS}, first_token + tokens) - greatest(shard_no * {SHARD_TOKENS}, first_token))::BIGINT AS tokens, count(*) AS documents, min(doc_id) AS first_doc FROM e GROUP BY 1, 2""",
    "window_counts": f"WITH {_SIDED} SELECT split, sum(tokens)::BIGINT AS tokens, greatest(0, (sum(tokens) - {SEQ_LEN}) // {SEQ_LEN + 1})::BIGINT AS windows, ((sum(tokens) - 1) // 2)::BIGINT AS largest_seq_len FROM t GROUP BY split",
    "document_windows": f"WITH {_OFFSETS} SELECT doc_id, split, first_token // {SEQ_LEN + 1} AS first_window, (first_token + tokens - 1) // {SEQ_LEN + 1} AS last_window FROM o",
    "manifest_windows": f"WITH m AS (SELECT DISTINCT ON (content_hash) content_hash, unnest(map_entries(splits)) AS e FROM manifests) SELECT content_hash, e.key AS split, e.value.tokens AS tokens, greatest(0, (e.value.tokens - {SEQ_LEN}) // {SEQ_LEN + 1})::BIGINT AS windows FROM (SELECT content_hash, unnest(map_entries(splits)) AS e FROM (SELECT DISTINCT ON (content_hash) * FROM manifests))",
    "shard_offsets": f"WITH {_SHARD_OFFSETS} SELECT * FROM o",
    "offset_lookup": f"""WITH {_SHARD_OFFSETS}, a AS (SELECT content_hash, split_name, unnest(range(0, 10)) AS tenth, sum(tokens)::BIGINT AS n FROM o GROUP BY 1, 2)
        SELECT a.content_hash, a.split_name, tenth, shard_no, (n * tenth // 10 - first_token)::BIGINT AS local FROM a JOIN o ON a.content_hash = o.content_hash AND a.split_name = o.split_name AND n * tenth // 10 >= first_token AND n * tenth // 10 < first_token + tokens""",
    "split_tokens_rollup": f"WITH {_SHARDS} SELECT content_hash, split_name, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes, count(*) AS shards FROM h GROUP BY 1, 2 UNION ALL SELECT content_hash, 'total', sum(tokens)::BIGINT, sum(bytes)::BIGINT, count(*) FROM h GROUP BY 1 UNION ALL SELECT 'all', 'total', sum(tokens)::BIGINT, sum(bytes)::BIGINT, count(*) FROM h",
    "shard_masks": f"WITH {_SHARDS} SELECT content_hash, count(mask_name) = count(*) AS all_masked, count(mask_name) > 0 AS any_masked, count(*) FILTER (mask_name IS NOT NULL AND mask_bytes IS DISTINCT FROM tokens) AS wrong_size, count(mask_name) BETWEEN 1 AND count(*) - 1 AS partial FROM h GROUP BY 1",
    "manifest_against_shards": f"""WITH {_SHARDS}, m AS (SELECT content_hash, split_name, unnest(x.shards) AS k FROM (SELECT content_hash, e.key AS split_name, e.value AS x FROM (SELECT content_hash, unnest(map_entries(splits)) AS e FROM (SELECT DISTINCT ON (content_hash) * FROM manifests))))
        SELECT coalesce(m.content_hash, h.content_hash) AS content_hash, coalesce(m.split_name, h.split_name) AS split_name, coalesce(m.k.name, h.name) AS name,
        CASE WHEN h.bytes IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unlisted' WHEN h.bytes <> m.k.bytes THEN 'wrong_size' WHEN h.sha256 <> m.k.sha256 THEN 'wrong_hash' ELSE 'ok' END AS state
        FROM m FULL JOIN h ON m.content_hash = h.content_hash AND m.split_name = h.split_name AND m.k.name = h.name""",
    "mask_overlap": "WITH {0} SELECT doc_id, count(*) AS words, count(*) FILTER (len(list_filter(trained_spans, lambda x: hi > x.span_start AND lo < x.span_end)) > 0) AS trained FROM b GROUP BY doc_id",
    "straddling": "WITH {0}, c AS (SELECT *, coalesce(list_sum(list_transform(trained_spans, lambda x: greatest(0, least(hi, x.span_end) - greatest(lo, x.span_start)))), 0) AS n FROM b) SELECT count(*) FILTER (n > 0 AND n < hi - lo) AS straddling, count(*) AS words FROM c",
    "bpe_roundtrip": "SELECT doc_id, true AS ok, strlen(text)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL",
    "torn_log": f"SELECT run_id, count(*) AS lines, count(*) FILTER ({_VALID} AND json_type(try_cast(line AS JSON)) = 'OBJECT') AS objects, count(*) - count(*) FILTER ({_VALID} AND json_type(try_cast(line AS JSON)) = 'OBJECT') AS unreadable FROM metrics_lines GROUP BY run_id",
    "metrics_summary": f"""WITH {_REC} SELECT run_id, count(*) FILTER (t) AS train_records, count(*) FILTER (e) AS eval_records, arg_min(loss, line_no) FILTER (t) AS first_loss, arg_max(loss, line_no) FILTER (t) AS final_loss,
        arg_max_null(step, line_no) FILTER (t) AS steps, min(val_loss) FILTER (e) AS best_val_loss, first(step ORDER BY val_loss, line_no) FILTER (e) AS best_val_step, arg_max(val_loss, line_no) FILTER (e) AS final_val_loss,
        max(tokens) FILTER (t) AS tokens_seen, max(elapsed) AS elapsed_seconds,
        round(CASE WHEN min(val_loss) FILTER (e) > 20 THEN 'inf'::DOUBLE ELSE exp(min(val_loss) FILTER (e)) END, 6) AS best_val_perplexity
        FROM (SELECT *, coalesce(event = 'train' AND loss IS NOT NULL, FALSE) AS t, coalesce(event = 'eval' AND val_loss IS NOT NULL, FALSE) AS e FROM q) GROUP BY run_id""",
    "throughput_window": f"""WITH {_REC}, x AS (SELECT run_id, line_no, greatest(1e-9, elapsed - coalesce(lag(elapsed) OVER w, 0)) AS dt, tokens - coalesce(lag(tokens) OVER w, 0) AS dn FROM q WHERE event = 'train' AND tokens IS NOT NULL AND elapsed IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY line_no))
        SELECT run_id, line_no, sum(dn) OVER y ::BIGINT AS window_tokens, round(sum(dt) OVER y, 6) AS window_seconds FROM x WINDOW y AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "best_so_far": f"WITH {_REC}, x AS (SELECT run_id, line_no, step, val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q WHERE event = 'eval' AND val_loss IS NOT NULL) SELECT run_id, line_no, step, val_loss, m IS NULL OR val_loss < m AS improved FROM x",
    "weighted_loss": f"""WITH {_REC}, x AS (SELECT run_id, loss, tokens - coalesce(lag(tokens) OVER (PARTITION BY run_id ORDER BY line_no), 0) AS n FROM q WHERE event = 'train' AND loss IS NOT NULL AND tokens IS NOT NULL), y AS (SELECT run_id, sum(n)::BIGINT AS tokens, sum(loss * n) / sum(n) AS l FROM x WHERE n > 0 GROUP BY 1)
        SELECT run_id, tokens, round(l, 6) AS loss, round(exp(l), 6) AS perplexity, round(l / ln(2), 6) AS bits_per_token FROM y""",
    "checkpoint_pointer": f"WITH {_CKPT} SELECT * FROM z",
    "checkpoint_prune": f"""WITH {_CKPT}, x AS (SELECT s.run_id, name, step, name = latest OR name = best AS kept, count(*) OVER (PARTITION BY s.run_id) AS total FROM s JOIN z ON s.run_id = z.run_id)
        SELECT run_id, name, step, NOT kept AND row_number() OVER (PARTITION BY run_id, kept ORDER BY step) <= total - 3 AS removed FROM x""",
    "record_types": f"SELECT CASE WHEN line IS NULL THEN 'null' WHEN NOT {_VALID} THEN 'malformed' WHEN json_type(try_cast(line AS JSON)) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind, count(*) AS n FROM metrics_lines GROUP BY 1",
    "json_property": "SELECT event_type, count(props ->> '$.k') AS with_k, sum((props ->> '$.k')::BIGINT)::BIGINT AS sum_k, max((props ->> '$.k')::BIGINT) AS max_k FROM events GROUP BY 1",
    "softmax": f"WITH {_LOGITS} SELECT vec_id, token_id, round(exp(logit / 0.8) / sum(exp(logit / 0.8)) OVER (PARTITION BY vec_id), 9) AS p FROM g",
    "sample_topk": f"WITH {_LOGITS} SELECT vec_id, token_id FROM g QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 5",
    "sample_topp": f"WITH {_LOGITS}, p AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM g), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT vec_id, count(*) AS n, min(token_id) AS least, max(token_id) AS most FROM c WHERE b < 0.3 GROUP BY 1",
    "greedy_argmax": f"WITH {_LOGITS} SELECT vec_id, token_id FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) = 1",
    "repetition_penalty": f"WITH {_LOGITS} SELECT g.vec_id, token_id, round(CASE WHEN token_id <> coalesce(label, -1) THEN logit WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END, 9) AS logit FROM g JOIN embeddings e ON e.vec_id = g.vec_id",
    "masked_cross_entropy": f"WITH {_LOGITS}, l AS (SELECT vec_id, ln(sum(exp(logit))) AS z FROM g GROUP BY 1), x AS (SELECT l.z - g.logit AS loss, CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM embeddings e JOIN g ON g.vec_id = e.vec_id AND g.token_id = e.label JOIN l ON l.vec_id = e.vec_id) SELECT round(sum(loss * m) / greatest(1, sum(m)), 9) AS loss, sum(m)::BIGINT AS scored FROM x",
    "lr_schedule": "SELECT i AS step, round(CASE WHEN i < 100 THEN 3e-4 * (i + 1) / 100 ELSE 3e-5 + (3e-4 - 3e-5) * 0.5 * (1 + cos(pi() * least(1.0, (i - 100) / 1900.0))) END, 12) AS lr FROM range(2000) t(i)",
    "param_breakdown": f"WITH {_PARAMS} SELECT rung, name, ffn_dim, embedding, attention, ffn, norm, parameters, printf('%.1fM', parameters / 1e6) AS shown FROM p",
    "peak_estimate": f"WITH {_PARAMS} SELECT name, (parameters * 16 + 32 * seq * d * n * 12 * 2 + 32 * seq * v * 8)::BIGINT AS peak_bytes, 6.0::DOUBLE * parameters + 12.0::DOUBLE * n * seq * d AS flops_per_token FROM p",
    "plan_ladder": f"""WITH {_PARAMS}, m AS (SELECT rung, name, parameters * 16 + 16 * seq * d * n * 12 * 2 + 16 * seq * v * 8 AS peak, (6.0::DOUBLE * parameters + 12.0::DOUBLE * n * seq * d) * 120000.0 / pow(3, rung) AS f FROM p),
        x AS (SELECT *, CASE WHEN peak > 4 * 4294967296 THEN 'skipped' WHEN peak > 4294967296 THEN 'too_large' WHEN f < 0.35 * max(f) OVER (ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'collapsed' ELSE 'ok' END AS verdict FROM m),
        b AS (SELECT coalesce(min(rung) FILTER (verdict <> 'ok'), 99) AS bad FROM x) SELECT rung, name, verdict, rung < bad AS reached, rung < bad AND (rung = bad - 1 OR rung = (SELECT max(rung) FROM x)) AS chosen FROM x, b""",
    "recommended_rates": "SELECT name, lr FROM (VALUES ('tiny', 0.000424), ('small', 0.000346), ('medium', 0.0003), ('large', 0.000245)) t(name, lr)",
    "data_budget": """WITH m AS (SELECT DISTINCT ON (content_hash) * FROM manifests), x AS (SELECT content_hash, coalesce(splits['train'].tokens, 0) AS t, coalesce(splits['val'].tokens, 0) AS v, 13900000 AS p, 8192 AS k, 1500 AS s FROM m)
        SELECT content_hash, round(CASE WHEN t <= 0 THEN 0 ELSE s * k / t END, 6) AS epochs, round(t / p, 6) AS tokens_per_parameter, round(t / k, 6) AS steps_per_epoch, greatest(0, t - s * k)::BIGINT AS tokens_never_read,
        CASE WHEN t <= 0 THEN 0 ELSE s * k / t END > 4 AS will_memorise, t / p < 5 AS data_limited, t > 0 AND s * k < t AS leaves_unread, v = 0 AS no_validation, greatest(50, least(100000, floor(least(4.0 * t, 20.0 * p) / k)))::BIGINT AS derived_steps FROM x""",
    "daily_prose": f"""WITH f AS (SELECT ts, arg_min(event_type, event_id) AS k, arg_min(value, event_id) AS v, arg_min(user_id, event_id) AS u FROM events WHERE ts IS NOT NULL GROUP BY ts),
        l AS (SELECT ts, strftime(ts, '%H:%M') || '  ' || k || ', ' || printf('%.1f', round(v::DECIMAL(18, 6), 1)::DOUBLE) || ', wind ' || {_COMPASS}[(floor((u * 7) % 360 / 22.5 + 0.5)::INT % 16) + 1] AS line FROM f)
        SELECT ts::DATE AS day, count(*)::INT AS readings, md5(strftime(ts::DATE, '%Y-%m-%d, %A.') || chr(10) || string_agg(line, chr(10) ORDER BY ts)) AS text_md5 FROM l GROUP BY ts::DATE""",
    "fmt_units": f"SELECT o_orderkey, {_COUNT} AS count, {_SIZE} AS size, {_DURATION} AS duration FROM (SELECT *, n % 400000 AS s FROM (SELECT o_orderkey, floor(o_totalprice * 1000)::BIGINT AS n FROM orders))",
}
_WORDS = f"""a AS (SELECT doc_id, trained_spans, unnest(regexp_extract_all(text, '{SPACE}*{_NONSPACE}+')) AS piece, generate_subscripts(regexp_extract_all(text, '{SPACE}*{_NONSPACE}+'), 1) AS k FROM documents WHERE text IS NOT NULL AND len(trained_spans) > 0),
    b AS (SELECT doc_id, trained_spans, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS hi, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(regexp_replace(piece, '^{SPACE}+', '')))::BIGINT AS lo FROM a)"""
for _k in ("mask_overlap", "straddling"):
    SQL[_k] = SQL[_k].replace("{0}", _WORDS)
#: Columns that are 32 bits wide there and 64 here.
_NARROW = {"script_shares": "rank", "row_regularity": "found", "emitted_ordinals": "kept_ordinal", "doc_chunks": "n_chars", "chat_spans": "n span_start span_end", "stop_strings": "at", "offset_lookup": "tenth", "softmax": "token_id", "sample_topk": "token_id", "sample_topp": "least most", "greedy_argmax": "token_id", "repetition_penalty": "token_id"}
for _k, _columns in _NARROW.items():
    SQL[_k] = f"SELECT * REPLACE ({', '.join(f'"{c}"::INTEGER AS "{c}"' for c in _columns.split())}) FROM ({SQL[_k]})"
SQL["recommended_rates"] = f"SELECT name, lr::DOUBLE AS lr FROM ({SQL['recommended_rates']})"
SQL |= catalogue_more.SQL
