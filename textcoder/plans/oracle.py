"""DuckDB statements that compute the same results as ``plans.catalog``.

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are registered by the caller.
"""

from __future__ import annotations

from textcoder.operators.generation import DESCRIPTION_PREFIX

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    if name in ORACLE:
        raise KeyError(f"oracle {name!r} registered twice")
    ORACLE[name] = text.strip()


# ----------------------------------------------------------------- retrieval on `embeddings`

def _pairs(metric: str = "cosine") -> str:
    score = {
        "cosine": "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) "
                  "* sqrt(list_dot_product(c.v, c.v)))",
        "dot": "list_dot_product(q.v, c.v)",
        "l2": "list_distance(q.v, c.v)",
    }[metric]
    order = "round(score, 6) ASC" if metric == "l2" else "round(score, 6) DESC"
    return f"""
e AS (SELECT vec_id, CAST(label AS VARCHAR) AS code, CAST(embedding AS DOUBLE[]) AS v
      FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.code AS true_code, c.vec_id AS id, c.code AS code,
             {score} AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id)
                     AS INTEGER) AS rank
      FROM p QUALIFY rank <= 5)"""


_DECISIONS = "WITH " + _pairs() + """,
d AS (SELECT query_id, any_value(true_code) AS true_code,
             list(code ORDER BY rank) AS codes, list(score ORDER BY rank) AS scores
      FROM r GROUP BY query_id),
dec AS (SELECT query_id, true_code, codes[1] AS pred_code, codes[1] IS NOT NULL AS codable,
               round(coalesce(scores[1], 0.0), 6) AS confidence,
               array_to_string(codes, ', ') AS retrieved_list,
               coalesce(list_contains(codes, true_code), false) AS retriever_hit,
               coalesce(codes[1] = true_code, false) AS correct
        FROM d),
ev AS (SELECT *, CASE WHEN retriever_hit THEN correct END AS correct_given_hit FROM dec)"""

sql("knn_top5", "WITH " + _pairs() + """
SELECT query_id, rank, id, code, round(score, 6) AS score FROM r""")

sql("knn_blocks", ORACLE["knn_top5"])
sql("knn_cells_all", "WITH " + _pairs() + """
SELECT query_id, rank, id, round(score, 6) AS score FROM r""")

sql("index_exact", ORACLE["knn_cells_all"])

sql("knn_dot", "WITH " + _pairs("dot") + """
SELECT query_id, rank, id, round(score, 6) AS score FROM r""")

sql("knn_l2", "WITH " + _pairs("l2") + """
SELECT query_id, rank, id, round(score, 6) AS score FROM r""")

sql("knn_decision", _DECISIONS + """
SELECT query_id, true_code, pred_code, codable, confidence, retrieved_list FROM ev""")

sql("knn_lookup", _DECISIONS + """
SELECT query_id, coalesce(pred_code, '') AS code,
       CASE WHEN pred_code IS NULL THEN 'Not codable'
            WHEN n.n_name IS NULL THEN '(label not found)' ELSE n.n_name END AS label,
       confidence
FROM ev LEFT JOIN nation n ON ev.pred_code = CAST(n.n_nationkey AS VARCHAR)""")

sql("no_candidate", """
SELECT vec_id AS query_id, '' AS code, 'Not codable' AS label, false AS codable,
       0.0::DOUBLE AS confidence, 0 AS n_candidates
FROM embeddings""")

sql("rag_eval_rows", _DECISIONS + """
SELECT query_id, true_code, pred_code, codable, confidence, retrieved_list,
       retriever_hit, correct, correct_given_hit FROM ev""")

_METRIC_AGG = _DECISIONS + """,
a AS (SELECT count(*) AS n_total, count_if(retriever_hit) AS n_hit,
             count_if(correct) AS n_correct, count_if(NOT retriever_hit) AS n_retriever_errors,
             count_if(retriever_hit AND NOT correct) AS n_generation_errors,
             count_if(correct AND NOT retriever_hit) AS correct_not_retrieved
      FROM ev),
m AS (SELECT *, round(n_hit::DOUBLE / n_total, 6) AS retriever_at_k,
             round(CASE WHEN n_hit > 0
                   THEN (n_correct - correct_not_retrieved)::DOUBLE / n_hit END, 6)
               AS conditional_accuracy,
             round(n_correct::DOUBLE / n_total, 6) AS pipeline_accuracy,
             round(n_retriever_errors::DOUBLE / n_total, 6) AS retriever_error_share,
             round(n_generation_errors::DOUBLE / n_total, 6) AS generation_error_share
      FROM a),
m2 AS (SELECT *, round(retriever_at_k * conditional_accuracy, 6) AS retriever_x_conditional
       FROM m),
m3 AS (SELECT *, round(pipeline_accuracy - retriever_x_conditional, 6) AS identity_gap FROM m2)"""

sql("rag_metrics", _METRIC_AGG + """
SELECT metric, value FROM (
  UNPIVOT (SELECT n_total::DOUBLE AS n_total, n_hit::DOUBLE AS n_hit,
                  n_correct::DOUBLE AS n_correct,
                  n_retriever_errors::DOUBLE AS n_retriever_errors,
                  n_generation_errors::DOUBLE AS n_generation_errors,
                  correct_not_retrieved::DOUBLE AS correct_not_retrieved,
                  retriever_at_k, conditional_accuracy, pipeline_accuracy,
                  retriever_x_conditional, identity_gap, retriever_error_share,
                  generation_error_share FROM m3)
  ON COLUMNS(*) INTO NAME metric VALUE value)""")

sql("rag_error_split", _DECISIONS + """,
a AS (SELECT count(*) AS total, count_if(NOT retriever_hit) AS retriever_error,
             count_if(retriever_hit AND NOT correct) AS generation_error,
             count_if(correct) AS correct FROM ev)
SELECT stage, CAST(n AS BIGINT) AS n, round(n::DOUBLE / total, 6) AS share FROM (
  SELECT total, 'retriever_error' AS stage, retriever_error AS n FROM a
  UNION ALL SELECT total, 'generation_error', generation_error FROM a
  UNION ALL SELECT total, 'correct', correct FROM a)""")

_CURVE = _DECISIONS + """,
t AS (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 10) r(i)),
c AS (SELECT threshold, count_if(confidence >= threshold) AS kept,
             count_if(confidence >= threshold AND correct) AS good,
             (SELECT count(*) FROM ev) AS total
      FROM t, ev GROUP BY threshold HAVING count_if(confidence >= threshold) > 0),
w AS (SELECT threshold, round(good::DOUBLE / kept, 6) AS precision,
             round(kept::DOUBLE / total, 6) AS coverage FROM c)"""

sql("precision_coverage", _CURVE + """
SELECT threshold, 'precision' AS metric, precision AS value FROM w
UNION ALL SELECT threshold, 'coverage', coverage FROM w""")

sql("threshold_for_precision", _CURVE + """
SELECT 0.95::DOUBLE AS target, min(threshold) AS threshold,
       arg_min(coverage, threshold) AS coverage
FROM w WHERE precision >= 0.95""")

sql("confidence_box", _DECISIONS + """,
l AS (SELECT CASE WHEN correct THEN 'Correct' ELSE 'Incorrect' END AS outcome,
             confidence AS c FROM ev),
q AS (SELECT outcome, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.5) AS median,
             quantile_cont(c, 0.75) AS q3 FROM l GROUP BY outcome),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l.outcome, count(*) AS n, round(any_value(q1), 6) AS q1,
       round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       round(min(CASE WHEN c BETWEEN lo AND hi THEN c END), 6) AS lower_whisker,
       round(max(CASE WHEN c BETWEEN lo AND hi THEN c END), 6) AS upper_whisker,
       CAST(count_if(NOT (c BETWEEN lo AND hi)) AS BIGINT) AS n_outliers
FROM l JOIN f USING (outcome) GROUP BY l.outcome""")


# ----------------------------------------------------------------- nomenclature from `part`
# Python's whitespace in ASCII: \t \n \v \f \r, U+001C..U+001F and the blank.
_WS = r"[\x09-\x0d\x1c-\x20]"


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{_WS}+', ' ', 'g')), '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _uuid5(x: str) -> str:
    from ..functions.text import namespace_hex
    h = f"sha1(unhex('{namespace_hex()}') || encode({x}))"
    return (f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' "
            f"|| lower(printf('%x', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 8)) "
            f"|| substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))")


_RAW = """
pp AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part),
raw AS (
  SELECT DISTINCT p_type AS CODE, 'Type ' || p_type AS HEADING, '1' AS LEVEL,
         NULL::VARCHAR AS PARENT_CODE, NULL::VARCHAR AS Includes,
         NULL::VARCHAR AS IncludesAlso, NULL::VARCHAR AS Excludes FROM pp
  UNION ALL
  SELECT DISTINCT p_type || '.' || p_brand, p_brand || ' ' || p_type, '2', p_type,
         NULL, NULL, NULL FROM pp
  UNION ALL
  SELECT DISTINCT p_type || '.' || p_brand || '.' || p_size,
         p_brand || ' ' || p_type || ' size ' || p_size, '3', p_type || '.' || p_brand,
         NULL, NULL, NULL FROM pp
  UNION ALL
  SELECT p_type || '.' || p_brand || '.' || p_size || '.' || CAST(p_partkey AS VARCHAR) || ' ',
         p_name, '4', p_type || '.' || p_brand || '.' || p_size,
         '  ' || p_name || ' ' || chr(9) || ' ' || p_type || chr(9) || ' ',
         p_brand || '\\nsize ' || p_size,
         CASE WHEN p_partkey % 2 = 1 THEN 'Other ' || p_type || ' parts' END FROM pp),
val AS (SELECT *, TRY_CAST(LEVEL AS INTEGER) AS level_num,
  CASE WHEN CODE IS NULL OR CODE = '' THEN 'absent: CODE'
       WHEN HEADING IS NULL OR HEADING = '' THEN 'absent: HEADING'
       WHEN LEVEL IS NULL OR LEVEL = '' THEN 'absent: LEVEL'
       WHEN TRY_CAST(LEVEL AS INTEGER) IS NULL THEN 'level not in 1..4: ' || LEVEL
       WHEN TRY_CAST(LEVEL AS INTEGER) NOT BETWEEN 1 AND 4
         THEN 'level not in 1..4: ' || CAST(TRY_CAST(LEVEL AS INTEGER) AS VARCHAR)
       WHEN TRY_CAST(LEVEL AS INTEGER) > 1 AND """ + _clean("PARENT_CODE") + """ IS NULL
         THEN 'no parent at level ' || CAST(TRY_CAST(LEVEL AS INTEGER) AS VARCHAR)
              || ': ' || CODE
       WHEN """ + _clean("HEADING") + """ IS NULL THEN 'heading without text: ' || CODE
  END AS error FROM raw),
d0 AS (SELECT """ + _strip("CODE") + """ AS code, """ + _clean("HEADING") + """ AS heading,
              level_num AS level, """ + _clean("PARENT_CODE") + """ AS parent_code,
              """ + _clean("Includes") + """ AS includes,
              """ + _clean("IncludesAlso") + """ AS includes_also,
              """ + _clean("Excludes") + """ AS excludes
       FROM val WHERE error IS NULL),
docs AS (SELECT *, """ + _strip("""replace(concat_ws(chr(10), '# Code: ' || code,
         '# Title: ' || heading,
         CASE WHEN includes IS NOT NULL
              THEN chr(10) || '## Includes:' || chr(10) || """ + _strip("includes") + """ END,
         CASE WHEN includes_also IS NOT NULL
              THEN chr(10) || '## Also includes:' || chr(10) || """ + _strip("includes_also") + """ END,
         CASE WHEN excludes IS NOT NULL
              THEN chr(10) || '## Excludes:' || chr(10) || """ + _strip("excludes") + """ END),
         '\\n', chr(10))""") + """ AS text FROM d0)"""

sql("validate_nomenclature", "WITH " + _RAW + """
SELECT CODE, LEVEL, level_num, error FROM val""")

sql("assemble_text", "WITH " + _RAW + """
SELECT code, level, text FROM docs""")

sql("leaf_filter", "WITH " + _RAW + """
SELECT code, heading, parent_code FROM docs WHERE level = 4""")

sql("point_ids", "WITH " + _RAW + """
SELECT code, """ + _uuid5("code") + """ AS id FROM docs""")

sql("payload", "WITH " + _RAW + """
SELECT """ + _uuid5("code") + """ AS id, code, level, parent_code, text
FROM docs WHERE level = 4""")

sql("label_dict", "WITH " + _RAW + """
SELECT """ + _strip("CODE") + """ AS code, arg_max(""" + _strip("HEADING") + """, 0) AS label
FROM raw WHERE CODE <> '' AND HEADING <> '' GROUP BY 1""")

# ----------------------------------------------------------------- text
sql("clean_text", """
SELECT doc_id, """ + _clean("text") + """ AS clean,
       CAST(length(""" + _clean("text") + """) AS INTEGER) AS n_chars_clean
FROM documents""")

sql("text_scalars", """
SELECT page_id, lower(url) AS url_lower,
       regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS url_stem,
       CAST(length(html) - length(replace(html, '<', '')) AS INTEGER) AS n_tags,
       CAST(length(""" + _strip("html") + """) AS INTEGER) AS n_chars_stripped
FROM pages""")

# ----------------------------------------------------------------- embeddings of text
_DIM = 1024


def _buckets(src: str, key: str, text: str) -> str:
    """Sparse hashed vectors of ``text`` per ``key``: (key, bucket, cnt, weight)."""
    return f"""(
  WITH t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}),
                                                        '[\\p{{L}}\\p{{N}}]+')) AS tok
             FROM {src}),
  b AS (SELECT k, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {_DIM} AS INTEGER) AS bucket,
               count(*) AS cnt FROM t GROUP BY ALL)
  SELECT k, bucket, cnt, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY k)) AS weight FROM b)"""


sql("hash_embed", f"""
SELECT k AS doc_id, bucket, round(weight, 6) AS weight FROM {_buckets('documents', 'doc_id', 'text')}""")
sql("hash_embed_native", ORACLE["hash_embed"])
sql("dedupe_embed", ORACLE["hash_embed"])

sql("text_knn", "WITH " + _RAW + f""",
leaf AS (SELECT code, text FROM docs WHERE level = 4),
cb AS {_buckets('leaf', 'code', 'text')},
qb AS {_buckets('part', 'p_partkey', 'p_name')},
s AS (SELECT qb.k AS query_id, cb.k AS code, sum(qb.weight * cb.weight) AS score
      FROM qb JOIN cb USING (bucket) GROUP BY ALL)
SELECT query_id, rank, code, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, code)
                 AS INTEGER) AS rank FROM s) WHERE rank <= 5""")


# ----------------------------------------------------------------- vector table
sql("build_vectors", "WITH " + _RAW + f""",
leaf AS (SELECT code, level, text FROM docs WHERE level = 4),
nb AS (SELECT k AS code, CAST(count(*) AS INTEGER) AS n_nonzero
       FROM {_buckets('leaf', 'code', 'text')} GROUP BY k)
SELECT """ + _uuid5("leaf.code") + f""" AS id, leaf.code, level, {_DIM} AS dim,
       coalesce(n_nonzero, 0) AS n_nonzero
FROM leaf LEFT JOIN nb USING (code)""")

sql("upsert_twice", "WITH " + _RAW + """
SELECT 2 AS version, CAST(0 AS BIGINT) AS n_rejected, count(*) AS n_rows, count(*) AS n_ids
FROM docs WHERE level = 4""")

# ----------------------------------------------------------------- prompts and generation
_PART_RANK = "WITH " + _RAW + f""",
leaf AS (SELECT code, text FROM docs WHERE level = 4),
cb AS {_buckets('leaf', 'code', 'text')},
qb AS {_buckets('part', 'p_partkey', 'p_name')},
s AS (SELECT qb.k AS query_id, cb.k AS code, sum(qb.weight * cb.weight) AS score
      FROM qb JOIN cb USING (bucket) GROUP BY ALL),
rk AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, code) AS rank
  FROM s) WHERE rank <= 5),
cand AS (SELECT query_id, list(rk.code ORDER BY rank) AS codes, list(score ORDER BY rank) AS scores,
                string_agg(rk.code, ', ' ORDER BY rank) AS codes_list,
                '## ' || string_agg(leaf.text, chr(10) || chr(10) || '## ' ORDER BY rank) AS descr
         FROM rk JOIN leaf USING (code) GROUP BY query_id),
coded AS (SELECT p.p_partkey AS query_id, p.p_name AS activity,
                 concat_ws('.', p_type, p_brand, CAST(p_size AS VARCHAR),
                           CAST(p_partkey AS VARCHAR)) AS true_code,
                 codes, scores, coalesce(codes_list, '') AS codes_list,
                 coalesce(descr, '## ') AS descr
          FROM part p LEFT JOIN cand ON cand.query_id = p.p_partkey)"""

sql("prompt_build", _PART_RANK + """
SELECT query_id, codes_list,
       replace(replace(replace('Activity to code: {activity}

Candidate entries:
{descriptions}

Candidate codes: {codes}', '{activity}', activity), '{descriptions}', descr),
               '{codes}', codes_list) AS user
FROM coded""")

sql("response_parse", _PART_RANK + """
SELECT query_id, codes[1] AS nace_code, codes[1] IS NOT NULL AS codable,
       round(coalesce(scores[1], 0.0), 6) AS confidence, NULL::VARCHAR AS error
FROM coded""")

sql("batch_coding", _PART_RANK + """
SELECT query_id, activity, true_code, codes[1] AS pred_code, codes[1] IS NOT NULL AS codable,
       round(coalesce(scores[1], 0.0), 6) AS confidence, codes_list AS retrieved_list,
       coalesce(list_contains(codes, true_code), false) AS retriever_hit,
       coalesce(codes[1] = true_code, false) AS correct,
       CASE WHEN coalesce(list_contains(codes, true_code), false)
            THEN coalesce(codes[1] = true_code, false) END AS correct_given_hit,
       NULL::VARCHAR AS error
FROM coded""")


def _text(value: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in value.split("\n"))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _parse_error(x: str) -> str:
    j = f"CASE WHEN json_valid(trim({x}, {_WHITE})) THEN trim({x}, {_WHITE}) END"
    keys = f"json_keys({j})"
    return f"""CASE WHEN {x} IS NULL THEN 'no response'
     WHEN NOT (starts_with(trim({x}, {_WHITE}), '{{') AND ends_with(trim({x}, {_WHITE}), '}}'))
          OR NOT json_valid(trim({x}, {_WHITE})) THEN 'not a JSON object'
     WHEN NOT list_contains({keys}, 'nace_code') THEN 'missing key: nace_code'
     WHEN NOT list_contains({keys}, 'codable') THEN 'missing key: codable'
     WHEN NOT list_contains({keys}, 'confidence') THEN 'missing key: confidence'
     WHEN json_type(json_extract({j}, '$.nace_code')) NOT IN ('VARCHAR', 'NULL')
       THEN 'nace_code is not text'
     WHEN lower(trim(json_extract_string({j}, '$.codable')))
          NOT IN ('true', '1', 'yes', 'on', 't', 'y', 'false', '0', 'no', 'off', 'f', 'n')
          OR json_extract_string({j}, '$.codable') IS NULL
       THEN 'codable is not a boolean'
     WHEN TRY_CAST(json_extract_string({j}, '$.confidence') AS DOUBLE) IS NULL
       THEN 'confidence is not a number'
     WHEN TRY_CAST(json_extract_string({j}, '$.confidence') AS DOUBLE) NOT BETWEEN 0 AND 1
       THEN 'confidence out of range' END"""


sql("response_parse_events", f"""
WITH e AS (SELECT event_id, props, {_parse_error('props')} AS error FROM events)
SELECT event_id,
       CASE WHEN error IS NULL THEN json_extract_string(trim(props), '$.nace_code') END
         AS nace_code,
       CASE WHEN error IS NULL THEN lower(trim(json_extract_string(trim(props), '$.codable')))
            IN ('true', '1', 'yes', 'on', 't', 'y') END AS codable,
       CASE WHEN error IS NULL
            THEN TRY_CAST(json_extract_string(trim(props), '$.confidence') AS DOUBLE) END
         AS confidence,
       error
FROM e""")

sql("response_parse_dirty", f"""
WITH r AS (SELECT doc_id, CASE doc_id % 6
             WHEN 0 THEN chr(10) || '{{"nace_code": "' || lang || '", "codable": true, "confidence": 0.5}}' || chr(10) || chr(9)
             WHEN 1 THEN '{{"nace_code": 12.3, "codable": true, "confidence": 0.5}}'
             WHEN 2 THEN '{{"nace_code": {{"x": 1}}, "codable": true, "confidence": 0.5}}'
             WHEN 3 THEN '{{"nace_code": null, "codable": "no", "confidence": "0.25"}}'
             WHEN 4 THEN '{{"nace_code": "' || lang || '", "codable": true, "confidence": 0.5}} done'
             ELSE chr(9) || '{{"nace_code": "' || source || '", "codable": true, "confidence": 1.5}}' END AS response FROM documents),
p AS (SELECT doc_id, trim(response, {_WHITE}) AS response, {_parse_error('response')} AS error FROM r),
e AS (SELECT doc_id, error, CASE WHEN error IS NULL THEN response END AS response FROM p)
SELECT doc_id, CASE WHEN error IS NULL THEN json_extract_string(response, '$.nace_code') END AS nace_code,
       CASE WHEN error IS NULL THEN lower(json_extract_string(response, '$.codable')) = 'true' END AS codable,
       CASE WHEN error IS NULL THEN json_extract_string(response, '$.confidence')::DOUBLE END AS confidence, error
FROM e""")

sql("prompt_slots", f"""
SELECT doc_id, '{{codes}} ' || source || ' {{descriptions}}' AS activity,
       'Activity to code: ' || '{{codes}} ' || source || ' {{descriptions}}' || chr(10) || chr(10) || 'Candidate entries:' || chr(10)
       || {_text(DESCRIPTION_PREFIX)} || lang || ' {{activity}}' || chr(10) || chr(10) || 'Candidate codes: ' || source AS prompt
FROM documents""")

sql("fallback_rows", f"""
WITH e AS (SELECT event_id, props, {_parse_error('props')} AS error FROM events)
SELECT event_id,
       CASE WHEN error IS NULL THEN json_extract_string(trim(props), '$.nace_code') END
         AS pred_code,
       coalesce(CASE WHEN error IS NULL
                     THEN lower(trim(json_extract_string(trim(props), '$.codable')))
                          IN ('true', '1', 'yes', 'on', 't', 'y') END, false) AS codable,
       coalesce(CASE WHEN error IS NULL
                     THEN TRY_CAST(json_extract_string(trim(props), '$.confidence') AS DOUBLE)
                END, 0.0) AS confidence,
       0 AS n_candidates, error
FROM e""")


# ----------------------------------------------------------------- labelled examples, splits
_SPLIT = """
h AS (SELECT doc_id, text AS label, lang AS code,
             row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos,
             count(*) OVER () AS n
      FROM documents),
z AS (SELECT *, n - CAST(ceil(0.3 * n) AS BIGINT) AS n_train,
             CAST(ceil(0.3 * n) AS BIGINT) - CAST(ceil(0.5 * CAST(ceil(0.3 * n) AS BIGINT)) AS BIGINT)
               AS n_val FROM h),
s AS (SELECT doc_id, label, code,
             CASE WHEN pos <= n_train THEN 'train' WHEN pos <= n_train + n_val THEN 'val'
                  ELSE 'test' END AS split FROM z)"""

sql("scan_labelled", "SELECT doc_id, text AS label, lang AS code FROM documents")

sql("n_unique", """
SELECT count(*) AS n_rows,
       count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS n_unique
FROM documents""")

sql("value_counts_top10", """
SELECT source, count(*) AS count FROM documents GROUP BY source
ORDER BY count DESC, source NULLS FIRST LIMIT 10""")

sql("distinct_codes", "SELECT DISTINCT source AS code FROM documents")

sql("split_assign", "WITH " + _SPLIT + " SELECT doc_id, split FROM s")

sql("split_sizes", "WITH " + _SPLIT + " SELECT split, count(*) AS n FROM s GROUP BY split")

sql("missing_codes", "WITH " + _SPLIT + """
SELECT DISTINCT code FROM s WHERE code NOT IN (SELECT code FROM s WHERE split = 'train')""")

sql("label_encode", "WITH " + _SPLIT + """
SELECT code, CAST(dense_rank() OVER (ORDER BY code) - 1 AS INTEGER) AS code_index
FROM (SELECT DISTINCT code FROM s WHERE split = 'train')""")

sql("sample_100", """
SELECT doc_id, lang FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")

sql("head_n", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 10")

sql("word_freq", "WITH " + _SPLIT + """
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+')) AS word
  FROM s WHERE split = 'train') GROUP BY word""")

sql("latest_run", """
SELECT arg_max('run-' || CAST(event_id AS VARCHAR), ts) AS run_id FROM events""")

sql("preview_100", _PART_RANK + """
SELECT query_id, codes[1] AS pred_code, round(coalesce(scores[1], 0.0), 6) AS confidence
FROM coded ORDER BY query_id LIMIT 100""")

sql("array_preview", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(i - 1 AS INTEGER) AS pos,
       round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, range(1, 9) r(i) WHERE i <= len(embedding)""")


# ----------------------------------------------------------------- CSV ingest, export, stream
sql("csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS id, """ + _strip("text") + """ AS activity_description
FROM documents WHERE """ + _strip("text") + """ <> ''""")

sql("csv_sequence_ids", """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR) AS id,
       """ + _strip("p_name") + """ AS activity_description
FROM part WHERE """ + _strip("p_name") + """ <> ''""")

_EXPORT = _PART_RANK + """,
lab AS (SELECT """ + _strip("CODE") + """ AS code, arg_max(""" + _strip("HEADING") + """, 0) AS label
        FROM raw WHERE CODE <> '' AND HEADING <> '' GROUP BY 1),
ex AS (SELECT CAST(query_id AS VARCHAR) AS id, activity AS activity_description,
              coalesce(codes[1], '') AS code,
              CASE WHEN codes[1] IS NULL THEN 'Not codable'
                   WHEN lab.label IS NULL THEN '(label not found)' ELSE lab.label END AS label,
              printf('%.3f', round(coalesce(scores[1], 0.0), 6)) AS confidence
       FROM coded LEFT JOIN lab ON lab.code = coded.codes[1])"""

sql("classify_batch", _EXPORT + " SELECT * FROM ex")
sql("json_to_csv", _EXPORT + " SELECT * FROM ex")
sql("classify_stream", _EXPORT + " SELECT * FROM ex")


# ----------------------------------------------------------------- extras
from ..operators.extras import HASH_SCALE as _HASH_SCALE, poisson1_thresholds  # noqa: E402

_LO, _HI = (1 - 0.95) / 2, 1 - (1 - 0.95) / 2


def _poisson_case() -> str:
    th = poisson1_thresholds(12)
    return ("CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(th))
            + f" ELSE {len(th)} END")


_PART_EV = _PART_RANK + """,
pev AS (SELECT query_id, true_code, codes[1] AS pred_code,
               coalesce(codes[1] = true_code, false) AS correct FROM coded)"""


def _chain(nomenclature: str, pairs: str) -> str:
    """CTEs ``anc`` (ancestors of each code by parent) and ``pe`` (``pairs`` with both sides' ancestors)."""
    levels = ", ".join(f"CASE {d} " + " ".join(f"WHEN {x}.level THEN {x}.code" for x in "npgh") + f" END AS a{d}"
                       for d in (1, 2, 3, 4))
    sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "tp" for c in ("u1", "u2", "a1", "a2", "a3", "a4"))
    return f"""
anc AS (SELECT n.code, p.code AS u1, g.code AS u2, {levels}
        FROM {nomenclature} n LEFT JOIN {nomenclature} p ON p.code = n.parent_code
        LEFT JOIN {nomenclature} g ON g.code = p.parent_code LEFT JOIN {nomenclature} h ON h.code = g.parent_code),
pe AS (SELECT x.true_code, x.pred_code, {sides}
       FROM {pairs} x LEFT JOIN anc t ON t.code = x.true_code LEFT JOIN anc p ON p.code = x.pred_code)"""


_ERROR_CLASS = """
SELECT CASE WHEN pred_code IS NULL THEN 'none' WHEN pred_code = true_code THEN 'exact'
            WHEN p_u1 = t_u1 THEN 'sibling' WHEN p_u2 = t_u2 THEN 'same_group'
            WHEN p_a1 = t_a1 THEN 'same_sector' ELSE 'far' END AS error_class, count(*) AS n
FROM pe GROUP BY 1"""

sql("hier_accuracy", _PART_EV + "," + _chain("docs", "pev") + """,
c AS (SELECT count(*) AS n, """ + ", ".join(
    f"CAST(count_if(coalesce(coalesce(p_a{d}, pred_code) = coalesce(t_a{d}, true_code), false)) AS BIGINT) AS c{d}"
    for d in (1, 2, 3, 4)) + """ FROM pe)
""" + " UNION ALL ".join(
    f"SELECT {d} AS depth, n, c{d} AS n_correct, round(c{d}::DOUBLE / n, 6) AS accuracy FROM c"
    for d in (1, 2, 3, 4)))

sql("error_class", _PART_EV + "," + _chain("docs", "pev")
    + _ERROR_CLASS.replace("count(*) AS n", "CAST(count(*) AS BIGINT) AS n"))

sql("sector_accuracy", _PART_EV + "," + _chain("docs", "pev") + """
SELECT t_a1 AS sector, count(*) AS n, CAST(count_if(pred_code = true_code) AS BIGINT) AS n_correct,
       round(count_if(pred_code = true_code)::DOUBLE / count(*), 6) AS accuracy
FROM pe GROUP BY 1""")

sql("error_class_opaque", "WITH " + _RAW + """,
hid AS (SELECT substr(md5(code), 1, 12) AS code, level, substr(md5(parent_code), 1, 12) AS parent_code FROM docs),
lf AS (SELECT p_partkey AS k, concat_ws('.', p_type, p_brand, p_size, CAST(p_partkey AS VARCHAR)) AS code,
              p_type AS t, p_type || '.' || p_brand AS g, p_type || '.' || p_brand || '.' || p_size AS u FROM pp),
op AS (SELECT substr(md5(code), 1, 12) AS true_code, substr(md5(
         CASE k % 7 WHEN 0 THEN min(code) OVER (PARTITION BY u) WHEN 1 THEN min(code) OVER (PARTITION BY g)
                    WHEN 2 THEN min(code) OVER (PARTITION BY t) WHEN 3 THEN max(code) OVER ()
                    WHEN 4 THEN 'unknown' WHEN 5 THEN code END), 1, 12) AS pred_code FROM lf),""" + _chain("hid", "op")
    + _ERROR_CLASS)

sql("bootstrap_ci", _PART_EV + """,
rep AS (SELECT query_id, CAST(correct AS BIGINT) AS ok, b,
               CAST(('0x' || substr(md5('42:' || CAST(b AS VARCHAR) || ':' ||
                                        CAST(query_id AS VARCHAR)), 1, 15)) AS BIGINT)
                 / {scale} AS u
        FROM pev, range(-1, 200) r(b)),
w AS (SELECT b, ok, CASE WHEN b < 0 THEN 1 ELSE {weight} END AS w FROM rep),
pb AS (SELECT b, sum(w * ok)::DOUBLE / sum(w) AS acc FROM w GROUP BY b)
SELECT round(max(CASE WHEN b < 0 THEN acc END), 6) AS estimate,
       round(quantile_cont(acc, {lo}) FILTER (WHERE b >= 0), 6) AS lower,
       round(quantile_cont(acc, {hi}) FILTER (WHERE b >= 0), 6) AS upper,
       count(*) FILTER (WHERE b >= 0) AS replicates
FROM pb""".format(scale=repr(_HASH_SCALE), weight=_poisson_case(), lo=repr(_LO), hi=repr(_HI)))

sql("prf", _DECISIONS + """,
pt AS (SELECT true_code AS cls, count(*) AS support, count_if(pred_code = true_code) AS tp
      FROM ev GROUP BY 1),
pp AS (SELECT pred_code AS cls, count(*) AS npred FROM ev WHERE pred_code IS NOT NULL GROUP BY 1),
pc AS (SELECT coalesce(pt.cls, pp.cls) AS cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
             coalesce(npred, 0) AS npred FROM pt FULL JOIN pp ON pt.cls = pp.cls),
pm AS (SELECT cls, tp, npred - tp AS fp, support - tp AS fn, support,
             CASE WHEN npred > 0 THEN tp::DOUBLE / npred END AS precision,
             CASE WHEN support > 0 THEN tp::DOUBLE / support END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall <> 0
                     THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pm)
SELECT cls AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf
UNION ALL
SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT),
       round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM pf
UNION ALL
SELECT 'weighted', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT),
       round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6) FROM pf""")

sql("triage", _DECISIONS + """
SELECT query_id, pred_code, confidence,
       CASE WHEN confidence >= 0.5 AND pred_code IS NOT NULL THEN 'automatic' ELSE 'review' END
         AS queue
FROM ev""")



def _terms(src: str, key: str, text: str) -> str:
    return f"""(SELECT k, term, count(*) AS cnt FROM (
  SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {src})
  GROUP BY ALL)"""


_BM25 = _PART_RANK + f""",
lc AS {_terms('leaf', 'code', 'text')},
qc AS {_terms('part', 'p_partkey', 'p_name')},
dl AS (SELECT k, sum(cnt) AS dl FROM lc GROUP BY k),
st AS (SELECT count(*) AS n_docs, avg(coalesce(dl, 0)) AS avgdl FROM leaf LEFT JOIN dl ON dl.k = leaf.code),
dft AS (SELECT term, count(*) AS df FROM lc GROUP BY term),
bw AS (SELECT lc.k AS code, lc.term,
              ln(1 + (st.n_docs - dft.df + 0.5) / (dft.df + 0.5)) * lc.cnt * (1.2 + 1)
                / (lc.cnt + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)) AS w
       FROM lc JOIN dl USING (k) JOIN dft USING (term) CROSS JOIN st),
bm AS (SELECT qc.k AS query_id, bw.code, sum(qc.cnt * bw.w) AS score
       FROM qc JOIN bw USING (term) GROUP BY ALL),
bmr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                                    ORDER BY round(score, 6) DESC, code) AS rank
                       FROM bm) WHERE rank <= 10)"""

sql("bm25_top10", _BM25 + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, code, round(score, 6) AS score FROM bmr""")

sql("bm25_rrf", _BM25 + """,
dnr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                                    ORDER BY round(score, 6) DESC, code) AS rank
                       FROM s) WHERE rank <= 10),
fu AS (SELECT query_id, code, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (
         SELECT query_id, code, rank FROM bmr UNION ALL SELECT query_id, code, rank FROM dnr)
       GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, code, round(rrf, 9) AS rrf FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, code) AS rank
  FROM fu) WHERE rank <= 5""")

sql("rescore", "WITH " + _pairs().replace("QUALIFY rank <= 5", "QUALIFY rank <= 10") + """,
v AS (SELECT *, round(sum(round(score, 6)) OVER (PARTITION BY query_id, code), 6) AS vote FROM r)
SELECT query_id, CAST(rank2 AS INTEGER) AS rank, id, code, round(score, 6) AS score, vote FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY vote DESC, round(score, 6) DESC, id) AS rank2 FROM v)
WHERE rank2 <= 5""")

sql("few_shot", f"""
WITH qb AS {_buckets('part', 'p_partkey', 'p_name')},
s AS (SELECT a.k AS query_id, b.k AS ex_id, sum(a.weight * b.weight) AS score
      FROM qb a JOIN qb b USING (bucket) WHERE a.k <> b.k GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                                  ORDER BY round(score, 6) DESC, ex_id) AS rank
                     FROM s) WHERE rank <= 3),
e AS (SELECT r.query_id, count(*) AS n,
             string_agg(p.p_name || ' -> ' || concat_ws('.', p.p_type, p.p_brand,
                        CAST(p.p_size AS VARCHAR), CAST(p.p_partkey AS VARCHAR)),
                        chr(10) ORDER BY rank) AS examples
      FROM r JOIN part p ON p.p_partkey = r.ex_id GROUP BY r.query_id)
SELECT p.p_partkey AS query_id, CAST(coalesce(n, 0) AS INTEGER) AS n_examples,
       coalesce(examples, '') AS examples
FROM part p LEFT JOIN e ON e.query_id = p.p_partkey""")

sql("hier_check", "WITH " + _RAW + """
SELECT d.code, d.level, d.parent_code,
       CASE WHEN p.code IS NULL THEN 'missing parent'
            WHEN d.level <> p.level + 1 THEN 'level is not parent level + 1' END AS problem
FROM docs d LEFT JOIN docs p ON p.code = d.parent_code
WHERE d.level > 1 AND (p.code IS NULL OR d.level <> p.level + 1)""")

sql("vector_check", """
SELECT count(*) AS n, CAST(count_if(embedding IS NULL) AS BIGINT) AS n_null,
       CAST(max(len(embedding)) AS INTEGER) AS max_dim, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
       CAST(count_if(len(list_filter(embedding, lambda x: isnan(x))) > 0) AS BIGINT) AS n_nan,
       CAST(count_if(list_sum(list_transform(embedding,
                     lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) = 0) AS BIGINT) AS n_zero_norm,
       CAST(count_if(len(embedding) <> 64) AS BIGINT) AS n_bad_dim
FROM embeddings""")

sql("resume", _EXPORT + " SELECT * FROM ex")


# ----------------------------------------------------------------- rules on faulty rows
sql("validate_faulty", """
WITH f AS (SELECT p_partkey % 10 AS k, p_partkey, p_name FROM part)
SELECT p_name AS "Includes",
       CASE k WHEN 4 THEN NULL WHEN 5 THEN '4.0' WHEN 6 THEN '7' WHEN 7 THEN ' 4 ' ELSE '4' END AS "LEVEL",
       CASE WHEN k IN (4, 5) THEN NULL WHEN k = 6 THEN 7 ELSE 4 END::INTEGER AS level_num,
       CASE WHEN k IN (0, 1) THEN 'absent: CODE' WHEN k = 2 THEN 'absent: HEADING' WHEN k = 4 THEN 'absent: LEVEL'
            WHEN k = 5 THEN 'level not in 1..4: 4.0' WHEN k = 6 THEN 'level not in 1..4: 7'
            WHEN k = 8 THEN 'no parent at level 4: ' || CAST(p_partkey AS VARCHAR)
            WHEN k = 3 THEN 'heading without text: ' || CAST(p_partkey AS VARCHAR) END AS error
FROM f""")

sql("label_last_wins", """
SELECT """ + _strip("source") + """ AS code, 'document ' || CAST(max(doc_id) AS VARCHAR) AS label
FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1""")

sql("generate_rows", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ValueError: refused' END AS gen_error,
       CASE doc_id % 3 WHEN 0 THEN 'no response' WHEN 1 THEN 'confidence out of range' END AS error,
       CASE WHEN doc_id % 3 = 2 THEN source END AS pred_code, doc_id % 3 = 2 AS codable,
       CASE WHEN doc_id % 3 = 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence, 2 AS n_kept,
       CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 0 END AS n_emptied
FROM documents""")

sql("missing_rare_codes", "WITH " + _SPLIT + """,
q AS (SELECT concat_ws('-', code, CAST(doc_id // 3 AS VARCHAR)) AS code, split FROM s)
SELECT DISTINCT code FROM q WHERE code NOT IN (SELECT code FROM q WHERE split = 'train')""")

sql("encode_fixed", """
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS words
           FROM documents),
c AS (SELECT doc_id, flatten(list_transform(words, lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9]+')
        THEN list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 THEN 1 ELSE 37 END
             + instr('abcdefghijklmnopqrstuvwxyz0123456789', x[i])) ELSE [1::BIGINT] END)) AS ids FROM w)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(10), lambda i: 0::BIGINT))[1:10], ' ') AS ids FROM c""")

sql("hier_check_faulty", "WITH " + _RAW + """,
m AS (SELECT code, level, CASE WHEN level = 4 AND string_split(code, '.')[-1]::INTEGER % 5 = 0 THEN 'nowhere'
                               WHEN level = 4 AND string_split(code, '.')[-1]::INTEGER % 5 = 1 THEN string_split(code, '.')[1]
                               ELSE parent_code END AS parent_code FROM docs)
SELECT d.code, d.level, d.parent_code,
       CASE WHEN p.code IS NULL THEN 'missing parent' ELSE 'level is not parent level + 1' END AS problem
FROM m d LEFT JOIN m p ON p.code = d.parent_code
WHERE d.level > 1 AND (p.code IS NULL OR d.level <> p.level + 1)""")

sql("vector_check_faulty", """
SELECT count(*) AS n, CAST(count_if(vec_id % 10 = 0) AS BIGINT) AS n_null, 64 AS max_dim, 8 AS min_dim,
       CAST(count_if(vec_id % 10 = 2) AS BIGINT) AS n_nan, CAST(count_if(vec_id % 10 = 3) AS BIGINT) AS n_zero_norm,
       CAST(count_if(vec_id % 10 = 1) AS BIGINT) AS n_bad_dim
FROM embeddings""")

sql("upsert_delta", """
WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS code, CASE WHEN vec_id % 100 = 0 THEN 'second' ELSE 'first' END AS text
           FROM embeddings
           UNION ALL SELECT 'new', CAST(label AS VARCHAR), 'second' FROM embeddings WHERE vec_id = 0)
SELECT id, code, text, 64 AS dim, count(*) FILTER (WHERE text = 'second') OVER () AS rows_written FROM p""")

sql("upsert_rejects", """
SELECT CASE WHEN vec_id % 11 <> 5 THEN CAST(vec_id AS VARCHAR) END AS id,
       CASE WHEN vec_id % 7 = 1 THEN 'null vector' WHEN vec_id % 7 = 2 THEN 'wrong dimension'
            WHEN vec_id % 11 = 5 THEN 'null id' ELSE 'stored' END AS why
FROM embeddings""")
