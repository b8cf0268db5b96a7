"""The catalog queries in plain SQL, for comparison with another engine.

``VIEWS`` are the derived tables of ``sources/fixtures.py``; each text in
``SQL`` names the views it needs and gets them as common table expressions.
"""

from __future__ import annotations

import re

from ragassay.functions import prompts
from ragassay.operators import diagnose as dx
from ragassay.operators.compare import POISSON
from ragassay.schemas import METRICS, NO_ANSWER, NO_CONTEXT

VIEWS: dict[str, str] = {
    "fx_documents": """
        SELECT doc_id, concat(source, '/', lang) AS doc_name, text, source, lang,
               doc_id % 7 = 0 AS is_deleted
        FROM documents""",
    "fx_topics": """
        SELECT topic_name, topic_name = 'src13' AS is_deleted
        FROM (SELECT lang AS topic_name FROM documents UNION SELECT source FROM documents)""",
    "fx_known_topics": """
        SELECT DISTINCT source AS topic_name, source = 'src13' AS is_deleted FROM documents""",
    "fx_document_topics": """
        SELECT doc_id, lang AS topic_name, doc_id % 11 = 0 AS is_deleted FROM documents
        UNION ALL
        SELECT doc_id, source, doc_id % 11 = 0 FROM documents""",
    "fx_document_chunks": """
        SELECT chunk_id, v.doc_id, chunk_id - 2 * v.doc_id AS chunk_index,
               CASE WHEN chunk_id = 2 * v.doc_id THEN substr(text, 1, CAST(ceil(length(text) / 2) AS INT))
                    ELSE substr(text, CAST(ceil(length(text) / 2) AS INT) + 1) END AS content,
               chunk_id - 2 * v.doc_id + 1 AS page_number, embedding, chunk_id % 13 = 0 AS is_deleted
        FROM (SELECT vec_id AS chunk_id, CAST(floor(vec_id / 2) AS BIGINT) AS doc_id, embedding
              FROM embeddings) v
        JOIN documents d ON d.doc_id = v.doc_id""",
    "fx_questions": """
        SELECT item_id AS query_id, text AS question, embedding
        FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "fx_query_history": """
        SELECT query_id, conv_id, turn, question, generated_answer,
               TIMESTAMP '2024-01-01 00:00:00' + query_id * INTERVAL '1' SECOND AS query_time,
               TIMESTAMP '2024-01-01 00:00:00' + (query_id + 1 + query_id % 7) * INTERVAL '1' SECOND
                   AS response_time,
               query_id % 17 = 0 AND query_id > 0 AS is_deleted
        FROM (SELECT u.conv_id * 100 + u.turn AS query_id, u.conv_id, u.turn, u.text AS question,
                     a.text AS generated_answer
              FROM conversations u
              JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
              WHERE u.role = 'user' AND a.role = 'assistant')""",
    "fx_contexts": """
        SELECT query_id, rank_no, d.doc_id, d.doc_id AS chunk_id, text,
               1.0::DOUBLE / (rank_no + 1) AS similarity_score, rank_no AS page_number
        FROM (SELECT query_id, 1 AS rank_no, conv_id AS doc_id FROM fx_query_history
              UNION ALL
              SELECT query_id, 2, conv_id + turn FROM fx_query_history WHERE turn > 0) w
        JOIN fx_documents d ON d.doc_id = w.doc_id AND NOT d.is_deleted""",
    "fx_run_mapping": """
        SELECT conv_id % 4 AS run_id, query_id, query_id % 19 = 0 AND query_id > 0 AS is_deleted
        FROM fx_query_history""",
    "fx_golden_records": """
        SELECT item_id AS id, concat('batch_', item_id % 3) AS batch_name,
               concat('Which passage is item ', item_id, '?') AS question, text AS ground_truth,
               CASE WHEN item_id % 4 > 0 THEN ['benchmark'] END AS expected_topics,
               CASE WHEN item_id % 2 = 0 THEN 'Factoid' ELSE 'Reasoning' END AS complexity,
               item_id % 9 = 0 AS is_deleted
        FROM benchmark""",
    "fx_golden_mapping": """
        SELECT query_id, query_id % (SELECT count(DISTINCT item_id) FROM benchmark) AS golden_record_id
        FROM fx_query_history WHERE conv_id % 2 = 0
        UNION ALL
        SELECT query_id, (query_id + 1) % (SELECT count(DISTINCT item_id) FROM benchmark)
        FROM fx_query_history WHERE conv_id % 2 = 0 AND query_id % 3 = 0""",
    "fx_evaluation_jobs": """
        SELECT job_id, CASE WHEN job_id <> 7 THEN job_id % 4 END AS inference_run_id,
               TIMESTAMP '2024-02-01 00:00:00' + (job_id * 5 % 8) * INTERVAL '1' DAY AS start_time
        FROM (SELECT DISTINCT user_id % 8 AS job_id FROM events)""",
    "fx_requested_jobs": "SELECT DISTINCT user_id % 10 AS job_id FROM events",
    "fx_metric_candidates": """
        SELECT event_id, ts, job_id, query_id, evaluation_strategy, 'generation' AS metric_category,
               metric_name,
               CAST(least(5.0::DOUBLE, CAST(cents % 251 AS DOUBLE) / 100
                    + CASE WHEN metric_name = 'answer_relevance' AND job_id % 2 = 1 THEN 0.0::DOUBLE
                           ELSE (job_id % 6) * 0.5::DOUBLE END
                    + CASE metric_name WHEN 'faithfulness' THEN 1.25::DOUBLE
                           WHEN 'correctness' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)
                    AS DECIMAL(5,4)) AS metric_value,
               concat('event ', event_id) AS reasoning, event_id % 29 = 0 AS is_deleted
        FROM (SELECT event_id, ts, user_id % 8 AS job_id,
                     event_id % n * 100 + CAST(floor(event_id / n) AS BIGINT) % 4 AS query_id,
                     CAST(round(value * 100) AS BIGINT) AS cents,
                     CASE WHEN event_type = 'signup' OR user_id % 8 = 6 THEN 'CASE1_GROUND_TRUTH'
                          ELSE 'CASE2_RAG_TRIAD' END AS evaluation_strategy,
                     CASE WHEN event_type = 'signup' OR user_id % 8 = 6 THEN 'correctness'
                          WHEN event_type = 'click' THEN 'context_relevance'
                          WHEN event_type = 'view' THEN 'faithfulness'
                          WHEN event_type = 'purchase' OR user_id % 8 IN (4, 5) THEN 'answer_relevance'
                          ELSE 'semantic_similarity' END AS metric_name
              FROM events, (SELECT count(DISTINCT conv_id) AS n FROM conversations))""",
    "fx_evaluation_metrics": """
        SELECT * FROM fx_metric_candidates
        QUALIFY row_number() OVER (
            PARTITION BY query_id, evaluation_strategy, metric_name, job_id ORDER BY event_id) = 1""",
    "fx_arrivals": """
        SELECT d.doc_id, doc_name, text, lang, source FROM fx_documents d
        WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
          AND regexp_matches(text, '[^\\s\\p{Z}]')""",
    "fx_resident": """
        SELECT * FROM fx_documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "fx_qa_pairs": """
        SELECT query_id, conv_id % 4 AS run_id,
               CASE WHEN length(question) < 40 THEN concat('INVALID_CHUNK ', question)
                    ELSE question END AS question,
               CASE WHEN length(generated_answer) < 100 THEN 'REJECTED'
                    ELSE generated_answer END AS answer,
               CASE WHEN turn = 0 THEN 'Factoid' ELSE 'Reasoning' END AS complexity
        FROM fx_query_history""",
    # derived steps several oracles share
    "st_pages": """
        SELECT doc_id, pos AS page_number, pages[pos] AS page_text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS pages,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
        WHERE regexp_matches(pages[pos], '[^\\s\\p{Z}]')""",
    "st_retired": """
        SELECT doc_id, doc_name FROM fx_resident
        WHERE NOT is_deleted AND doc_name IN (SELECT doc_name FROM fx_arrivals)""",
    "st_versions": """
        SELECT *, doc_id < max(doc_id) OVER (PARTITION BY doc_name) AS is_deleted FROM fx_arrivals""",
    "st_scored": """
        SELECT q.query_id, c.chunk_id, c.doc_id, c.content, c.page_number,
               list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim
        FROM fx_document_chunks c JOIN fx_documents d ON d.doc_id = c.doc_id, fx_questions q
        WHERE NOT c.is_deleted AND NOT d.is_deleted""",
    "st_topic_rows": """
        SELECT m.doc_id, t.topic_name FROM fx_document_topics m
        JOIN fx_topics t ON t.topic_name = m.topic_name
        WHERE NOT m.is_deleted AND NOT t.is_deleted""",
    "st_hits": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
        FROM st_scored WHERE sim >= 0.3
        QUALIFY rank_no <= 5""",
    "st_fetched": """
        SELECT m.run_id, h.query_id, h.conv_id, h.turn, h.question,
               coalesce(h.generated_answer, '') AS generated_answer, g.ground_truth
        FROM fx_run_mapping m
        JOIN fx_query_history h ON h.query_id = m.query_id
        LEFT JOIN fx_golden_mapping l ON l.query_id = h.query_id
        LEFT JOIN fx_golden_records g ON g.id = l.golden_record_id AND NOT g.is_deleted
        WHERE NOT m.is_deleted AND NOT h.is_deleted""",
    "st_context_text": """
        SELECT query_id, string_agg(text, chr(10) ORDER BY rank_no) AS found
        FROM fx_contexts GROUP BY query_id""",
    "st_tokens": """
        SELECT run_id, f.query_id, ground_truth, generated_answer AS answer,
               list_distinct(list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS q,
               list_distinct(list_filter(regexp_split_to_array(lower(generated_answer), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS a,
               list_distinct(list_filter(regexp_split_to_array(lower(coalesce(ground_truth, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS g,
               list_distinct(list_filter(regexp_split_to_array(lower(coalesce(found, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS c
        FROM st_fetched f LEFT JOIN st_context_text t ON t.query_id = f.query_id""",
    "st_case1": """
        SELECT run_id, query_id, 'CASE1_GROUND_TRUTH' AS evaluation_strategy, 'correctness' AS metric_name,
               2 * len(list_intersect(a, g)) AS part, len(a) + len(g) AS whole, false AS abstained
        FROM st_tokens WHERE ground_truth IS NOT NULL""",
    "st_case2": """
        SELECT run_id, query_id, 'CASE2_RAG_TRIAD' AS evaluation_strategy, metric_name, part, whole,
               metric_name = 'faithfulness' AND regexp_matches(lower(answer),
                   'cannot answer|not available in the provided documents') AS abstained
        FROM (SELECT *, 'context_relevance' AS metric_name, len(list_intersect(q, c)) AS part, len(q) AS whole
              FROM st_tokens WHERE ground_truth IS NULL
              UNION ALL
              SELECT *, 'faithfulness', len(list_intersect(a, c)), len(a) FROM st_tokens WHERE ground_truth IS NULL
              UNION ALL
              SELECT *, 'answer_relevance', len(list_intersect(q, a)), len(q) FROM st_tokens WHERE ground_truth IS NULL)""",
    "st_scores": """
        SELECT run_id, query_id, evaluation_strategy, metric_name,
               CASE WHEN abstained THEN 5.0::DOUBLE WHEN whole > 0
                    THEN round(part::DOUBLE / whole * 5.0::DOUBLE, 4) ELSE 0.0::DOUBLE END AS score,
               concat('shared tokens: ', part, ' of ', whole) AS reasoning
        FROM (SELECT * FROM st_case1 UNION ALL SELECT * FROM st_case2)""",
    "st_pivot": f"""
        SELECT e.job_id, e.query_id, h.question, h.generated_answer, g.ground_truth,
               {", ".join(
                   f"max(CASE WHEN metric_name = '{m}' THEN metric_value END) AS {m}_score, "
                   f"max(CASE WHEN metric_name = '{m}' THEN reasoning END) AS {m}_reasoning"
                   for m in METRICS)}
        FROM fx_evaluation_metrics e
        JOIN fx_query_history h ON h.query_id = e.query_id
        LEFT JOIN fx_golden_mapping l ON l.query_id = h.query_id
        LEFT JOIN fx_golden_records g ON g.id = l.golden_record_id AND NOT g.is_deleted
        WHERE NOT e.is_deleted AND NOT h.is_deleted
        GROUP BY ALL""",
    "st_averages": f"""
        SELECT r.job_id,
               {", ".join(
                   f"coalesce(CAST(sum({m}_score) AS DOUBLE) / count({m}_score), 0.0::DOUBLE) AS {m}"
                   for m in METRICS)}
        FROM fx_requested_jobs r LEFT JOIN st_pivot p ON p.job_id = r.job_id
        GROUP BY r.job_id""",
    "st_metadata": """
        SELECT r.job_id,
               CASE WHEN j.job_id IS NULL THEN 'NOT_FOUND'
                    ELSE coalesce(CAST(j.inference_run_id AS VARCHAR), 'UNKNOWN_RUN') END AS setting_id,
               CASE WHEN j.job_id IS NULL THEN 'NOT_FOUND'
                    ELSE coalesce(max(g.batch_name), 'case2_blind_test_dataset') END AS dataset_name
        FROM fx_requested_jobs r
        LEFT JOIN fx_evaluation_jobs j ON j.job_id = r.job_id
        LEFT JOIN fx_run_mapping m ON m.run_id = j.inference_run_id
        LEFT JOIN fx_golden_mapping l ON l.query_id = m.query_id
        LEFT JOIN fx_golden_records g ON g.id = l.golden_record_id
        GROUP BY r.job_id, j.job_id, j.inference_run_id""",
    "st_quality": f"""
        SELECT *, CASE WHEN len(list_filter([{", ".join(METRICS)}], lambda v: v > 0)) > 0
                  THEN CAST(printf('%.2f', list_sum(list_filter([{", ".join(METRICS)}], lambda v: v > 0))
                       / len(list_filter([{", ".join(METRICS)}], lambda v: v > 0))) AS DOUBLE)
                  ELSE 0.0::DOUBLE END AS quality_score
        FROM st_averages""",
    "st_results": """
        SELECT m.run_id, m.query_id, min(l.golden_record_id) AS golden_record_id
        FROM fx_run_mapping m LEFT JOIN fx_golden_mapping l ON l.query_id = m.query_id
        GROUP BY m.run_id, m.query_id""",
}

_UUID5 = """(concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
    CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8'
        WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
        WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END,
    substr(h, 18, 3), '-', substr(h, 21, 12)))"""


def _uuid5(name: str) -> str:
    digest = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({name}))"
    return re.sub(r"\bh\b", digest, _UUID5)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fixed2(value: str) -> str:
    return f"printf('%.2f', {value})"


def _decimal_fixed2(value: str) -> str:
    """Half-even text of a DECIMAL(5,4), in whole hundredths and a remainder."""
    units = f"CAST({value} * 10000 AS BIGINT)"
    cents = (
        f"({units} // 100 + CASE WHEN {units} % 100 > 50 "
        f"OR ({units} % 100 = 50 AND ({units} // 100) % 2 = 1) THEN 1 ELSE 0 END)"
    )
    return f"printf('%d.%02d', {cents} // 100, {cents} % 100)"


def _finding(number: str, finding: dx.Finding, fires: str, evidence: str) -> str:
    return f"""
        SELECT job_id, {number} AS rule_no, {_text(finding.issue)} AS issue, {evidence} AS evidence,
               {_text("|".join(finding.causes))} AS likely_root_causes,
               {_text("|".join(finding.actions))} AS recommended_actions
        FROM st_averages WHERE {fires}"""


def _below(number: str, metric: str, threshold: float, finding: dx.Finding) -> str:
    evidence = (
        f"concat('avg_{metric} (', {_fixed2(metric)}, "
        f"') is below the acceptable threshold of {threshold}.')"
    )
    return _finding(number, finding, f"{metric} <> 0 AND {metric} < {threshold}", evidence)


def _poor_answer(number: str, context: float, answer: float) -> str:
    evidence = (
        f"concat('avg_context_relevance (', {_fixed2('context_relevance')}, ') is healthy (>= {context}).|"
        f"However, avg_answer_relevance (', {_fixed2('answer_relevance')}, ') is poor (< {answer}).')"
    )
    fires = (
        f"context_relevance <> 0 AND answer_relevance <> 0 AND context_relevance >= {context} "
        f"AND answer_relevance < {answer}"
    )
    return _finding(number, dx.ANSWER_RELEVANCE, fires, evidence)


VIEWS["st_findings"] = " UNION ALL ".join(
    [
        _below("1", "context_relevance", 4.0, dx.RETRIEVAL),
        _below("2", "faithfulness", 4.5, dx.HALLUCINATION),
        _poor_answer("3", 3.5, 3.5),
        _below("4", "correctness", 4.0, dx.CORRECTNESS),
    ]
)


def _chunk_level(level: int, separator: str, width: int) -> str:
    """One separator of the chunker: cut the units that contain it.

    Short pieces between long ones form runs, long pieces and uncut units are
    the units of the next level.
    """
    return f"""
        cut{level} AS (
            SELECT DISTINCT doc_id, lo, txt, lo AS pos FROM units{level} WHERE contains(txt, {separator})
            UNION
            SELECT doc_id, lo, txt, lo + sum(length(part) + {width}) OVER (PARTITION BY doc_id, lo ORDER BY i) - {width}
            FROM (SELECT doc_id, lo, txt, unnest(string_split(txt, {separator})) AS part,
                         unnest(range(1, len(string_split(txt, {separator})) + 1)) AS i
                  FROM units{level} WHERE contains(txt, {separator}))),
        piece{level} AS (
            SELECT *, count(*) FILTER (WHERE hi - pos >= 1000) OVER (PARTITION BY doc_id, lo ORDER BY pos) AS run
            FROM (SELECT doc_id, lo, txt, pos, lead(pos) OVER (PARTITION BY doc_id, lo ORDER BY pos) AS hi
                  FROM cut{level})
            WHERE hi IS NOT NULL),
        runs{level} AS (
            SELECT doc_id, list_prepend(CAST(min(pos) AS BIGINT), list(CAST(hi AS BIGINT) ORDER BY hi)) AS b
            FROM piece{level} WHERE hi - pos < 1000 GROUP BY doc_id, lo, run),
        units{level + 1} AS (
            SELECT doc_id, CAST(pos AS BIGINT) AS lo, substr(txt, CAST(pos - lo + 1 AS BIGINT), CAST(hi - pos AS BIGINT)) AS txt
            FROM piece{level} WHERE hi - pos >= 1000
            UNION ALL
            SELECT doc_id, lo, txt FROM units{level} WHERE NOT contains(txt, {separator}))"""


_CHUNKS = f"""WITH RECURSIVE
        units1 AS (
            SELECT doc_id, CAST(0 AS BIGINT) AS lo, text AS txt FROM fx_documents
            WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')),
        {_chunk_level(1, "chr(10) || chr(10)", 2)},
        {_chunk_level(2, "chr(10)", 1)},
        {_chunk_level(3, "' '", 1)},
        runs AS (
            SELECT * FROM runs1 UNION ALL SELECT * FROM runs2 UNION ALL SELECT * FROM runs3
            UNION ALL SELECT doc_id, range(lo, lo + length(txt) + 1) FROM units4),
        windows AS (
            SELECT doc_id, b, 1 AS h, len(list_filter(b, lambda x: x <= b[1] + 1000)) AS e FROM runs
            UNION ALL
            SELECT doc_id, b, n AS h, len(list_filter(b, lambda x: x <= b[n] + 1000)) AS e
            FROM (SELECT doc_id, b, 1 + len(list_filter(b, lambda x: x < greatest(b[e] - 200, b[e + 1] - 1000))) AS n
                  FROM windows WHERE e < len(b))),
        chunks AS (
            SELECT w.doc_id, b[h] AS start, regexp_replace(substr(text, b[h] + 1, b[e] - b[h]),
                       '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS content
            FROM windows w JOIN fx_documents d ON d.doc_id = w.doc_id)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index,
               CAST(1 AS BIGINT) AS page_number, content
        FROM chunks WHERE content <> ''"""
VIEWS["fx_text_chunks"] = f"""
        SELECT concat(doc_id, '-', chunk_index) AS chunk_id, doc_id, chunk_index, content, page_number,
               (doc_id + chunk_index) % 13 = 0 AS is_deleted
        FROM ({_CHUNKS})"""


def _single_rule(rule: str) -> str:
    return (
        "SELECT job_id, CAST(rule_no AS BIGINT) AS finding_no, issue, evidence, likely_root_causes, "
        f"recommended_actions FROM ({rule})"
    )


def _report_file(dataset: str, job: str) -> str:
    def has(marks: tuple[str, ...]) -> str:
        return " OR ".join(f"contains({dataset}, '{mark}')" for mark in marks)

    return f"""CASE WHEN {has(dx.CASE1_MARKS)} THEN '{dx.CASE1_REPORT}'
                    WHEN {has(dx.CASE2_MARKS)} THEN '{dx.CASE2_REPORT}'
                    ELSE concat('diagnosis_report_', substr({job}, 1, 8), '.json') END"""


_RANKING = (
    "SELECT query_id, CAST(rank_no AS BIGINT) AS rank_no, chunk_id, doc_id, "
    "round(sim, 6) AS similarity_score FROM "
)
_TOPIC_LIST = "('en', 'src0', 'src1', 'src2', 'src3', 'src4')"


def _json_list(joined: str) -> str:
    """JSON array of the parts of a '|'-joined text without quotes or escapes inside."""
    return f"concat('[\"', replace({joined}, '|', '\",\"'), '\"]')"


SQL: dict[str, str] = {
    "doc_fingerprint": """
        SELECT doc_id, concat(doc_id, '.txt') AS document_name, md5(text) AS md5_hash,
               CAST(len(string_split(text, chr(10))) AS BIGINT) AS total_pages
        FROM fx_documents""",
    "page_explode": "SELECT doc_id, page_number, page_text FROM st_pages",
    "active_documents": "SELECT doc_id, doc_name FROM fx_documents WHERE NOT is_deleted",
    "chunk_recursive": _CHUNKS,
    "chunk_index": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS chunk_index,
               page_number, page_text AS content FROM st_pages""",
    "chunk_rows": """
        SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, content,
               'RecursiveCharacterTextSplitter' AS chunking_strategy,
               concat('{"page_number":', page_number, ',"token_count":null}') AS metadata
        FROM fx_text_chunks""",
    "embed_batch": """
        WITH words AS (
            SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'),
                                                lambda w: w <> '')) AS word
            FROM fx_text_chunks),
        codes AS (
            SELECT chunk_id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) AS code FROM words),
        sums AS (
            SELECT chunk_id, code % 64 AS dimension,
                   CAST(sum(CASE WHEN code >= 2147483648 THEN -1 ELSE 1 END) AS DOUBLE) AS total
            FROM codes GROUP BY ALL)
        SELECT chunk_id, dimension,
               round(CAST(CAST(total / sqrt(sum(total * total) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE), 6)
                   AS value
        FROM sums WHERE total <> 0""",
    "topic_id_uuid5": f"SELECT topic_name, {_uuid5('topic_name')} AS topic_id FROM fx_topics",
    "soft_delete_cascade": """
        SELECT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS row_key,
               is_deleted OR doc_id IN (SELECT doc_id FROM st_retired) AS is_deleted,
               doc_id IN (SELECT doc_id FROM st_retired) AS newly_deleted
        FROM fx_resident
        UNION ALL
        SELECT 'document_chunks', CAST(chunk_id AS VARCHAR),
               is_deleted OR doc_id IN (SELECT doc_id FROM st_retired),
               NOT is_deleted AND doc_id IN (SELECT doc_id FROM st_retired)
        FROM fx_text_chunks WHERE doc_id IN (SELECT doc_id FROM fx_resident)
        UNION ALL
        SELECT 'document_topics', concat(doc_id, '/', topic_name),
               is_deleted OR doc_id IN (SELECT doc_id FROM st_retired),
               NOT is_deleted AND doc_id IN (SELECT doc_id FROM st_retired)
        FROM fx_document_topics WHERE doc_id IN (SELECT doc_id FROM fx_resident)""",
    "reingest_documents": """
        SELECT doc_id, doc_name, is_deleted OR doc_id IN (SELECT doc_id FROM st_retired) AS is_deleted,
               '' AS md5_hash, CAST(0 AS BIGINT) AS total_pages
        FROM fx_resident
        UNION ALL
        SELECT doc_id, doc_name, is_deleted, md5(text), CAST(len(string_split(text, chr(10))) AS BIGINT)
        FROM st_versions""",
    "topics_upsert": f"""
        SELECT {_uuid5('topic_name')} AS topic_id, topic_name, is_deleted, was_inserted
        FROM (SELECT coalesce(k.topic_name, n.topic_name) AS topic_name,
                     CASE WHEN n.topic_name IS NOT NULL THEN false ELSE k.is_deleted END AS is_deleted,
                     k.topic_name IS NULL AS was_inserted
              FROM fx_known_topics k
              FULL JOIN (SELECT lang AS topic_name FROM fx_arrivals UNION SELECT source FROM fx_arrivals) n
                ON n.topic_name = k.topic_name)""",
    "document_topics_map": f"""
        SELECT doc_id, {_uuid5('topic_name')} AS topic_id
        FROM (SELECT doc_id, unnest([lang, source]) AS topic_name FROM fx_arrivals)""",
    "ingest_stats": """
        WITH new_chunks AS (
            SELECT doc_id, count(*) AS n FROM fx_text_chunks GROUP BY doc_id),
        per_name AS (
            SELECT doc_name, count(*) AS docs, sum(n) AS chunks, count(*) FILTER (WHERE is_deleted) AS old_docs,
                   coalesce(sum(n) FILTER (WHERE is_deleted), 0) AS old_chunks
            FROM st_versions JOIN new_chunks USING (doc_id) GROUP BY doc_name),
        firsts AS (
            SELECT doc_name, count(*) AS n FROM (
                SELECT topic_name, arg_min(doc_name, doc_id) AS doc_name
                FROM (SELECT doc_id, doc_name, unnest([lang, source]) AS topic_name FROM fx_arrivals)
                WHERE topic_name NOT IN (SELECT topic_name FROM fx_known_topics)
                GROUP BY topic_name) GROUP BY doc_name),
        gone_docs AS (SELECT doc_name, count(*) AS n FROM st_retired GROUP BY doc_name),
        gone_chunks AS (
            SELECT doc_name, count(*) AS n FROM fx_text_chunks c JOIN st_retired r USING (doc_id)
            WHERE NOT c.is_deleted GROUP BY doc_name),
        gone_topics AS (
            SELECT doc_name, count(*) AS n FROM fx_document_topics t JOIN st_retired r USING (doc_id)
            WHERE NOT t.is_deleted GROUP BY doc_name)
        SELECT p.doc_name,
               CAST(coalesce(d.n, 0) + old_docs AS BIGINT) AS soft_deleted_documents,
               CAST(coalesce(c.n, 0) + old_chunks AS BIGINT) AS soft_deleted_document_chunks,
               CAST(coalesce(t.n, 0) + 2 * old_docs AS BIGINT) AS soft_deleted_document_topics,
               CAST(docs AS BIGINT) AS inserted_documents,
               CAST(coalesce(f.n, 0) AS BIGINT) AS inserted_topics,
               CAST(2 * docs AS BIGINT) AS inserted_document_topics,
               CAST(chunks AS BIGINT) AS inserted_document_chunks
        FROM per_name p
        LEFT JOIN firsts f USING (doc_name) LEFT JOIN gone_docs d USING (doc_name)
        LEFT JOIN gone_chunks c USING (doc_name) LEFT JOIN gone_topics t USING (doc_name)""",
    "cosine_scores": """
        SELECT query_id, vec_id AS chunk_id, round(sim, 6) AS similarity_score
        FROM (SELECT q.query_id, e.vec_id,
                     list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim
              FROM embeddings e, fx_questions q)
        WHERE sim >= 0.15""",
    "semantic_search_topk": _RANKING + """(
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
        FROM st_scored WHERE sim >= 0.15) WHERE rank_no <= 5""",
    "semantic_search_topics": _RANKING + f"""(
        SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
        FROM st_scored s JOIN st_topic_rows t ON t.doc_id = s.doc_id
        WHERE sim >= 0.15 AND t.topic_name IN {_TOPIC_LIST}) WHERE rank_no <= 5""",
    "semantic_search_topics_distinct": _RANKING + f"""(
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
        FROM st_scored
        WHERE sim >= 0.15 AND doc_id IN (
            SELECT doc_id FROM st_topic_rows WHERE topic_name IN {_TOPIC_LIST})) WHERE rank_no <= 5""",
    "semantic_search_params": _RANKING + """(
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
        FROM (SELECT * FROM st_scored WHERE query_id % 5 >= 2
              UNION ALL
              SELECT s.* FROM st_scored s JOIN st_topic_rows t ON t.doc_id = s.doc_id
              WHERE query_id % 5 < 2 AND t.topic_name IN ('en', concat('src', query_id % 7)))
        WHERE sim >= CASE WHEN query_id % 2 = 0 THEN 0.2 ELSE 0.15 END)
        WHERE rank_no <= CASE WHEN query_id % 3 > 0 THEN query_id % 4 + 1 ELSE 5 END""",
    "retrieved_contexts": """
        SELECT query_id, CAST(rank_no AS BIGINT) AS rank_no, CAST(chunk_id AS VARCHAR) AS chunk_id,
               CAST(doc_id AS VARCHAR) AS doc_id, content AS text, round(sim, 6) AS similarity_score,
               CAST(page_number AS BIGINT) AS page_number
        FROM st_hits""",
    "generator_prompt": f"""
        SELECT q.query_id, concat({_text(prompts.ANSWER_PROMPT_HEAD)}, coalesce(block, ''),
               {_text(prompts.ANSWER_PROMPT_QUESTION)}, question, {_text(prompts.ANSWER_PROMPT_TAIL)}) AS prompt
        FROM fx_questions q LEFT JOIN (
            SELECT query_id, string_agg(concat('[Source ', rank_no, ' | Score: ',
                       printf('%.4f', round(sim, 6)), ' | page_number=', page_number,
                       ', token_count=None]', chr(10), content), chr(10) || chr(10) ORDER BY rank_no) AS block
            FROM st_hits GROUP BY query_id) b ON b.query_id = q.query_id""",
    "rag_answers": f"""
        SELECT q.query_id, coalesce(max(content) FILTER (WHERE rank_no = 1), {_text(NO_ANSWER)}) AS generated_answer,
               count(h.chunk_id) AS n_contexts
        FROM fx_questions q LEFT JOIN st_hits h ON h.query_id = q.query_id GROUP BY q.query_id""",
    "context_preview": """
        SELECT chunk_id, CASE WHEN length(content) > 100
               THEN concat(replace(substr(content, 1, 100), chr(10), ' '), '...') ELSE content END AS preview
        FROM fx_text_chunks""",
    "seed_chunks": """
        SELECT chunk_id, content, CAST(page_number AS BIGINT) AS page_number FROM fx_text_chunks
        WHERE NOT is_deleted AND length(content) > 300
        ORDER BY md5(concat(chunk_id, '|42')), chunk_id LIMIT 50""",
    "seed_chunks_topics": f"""
        SELECT chunk_id, topic_name, content, CAST(page_number AS BIGINT) AS page_number
        FROM fx_text_chunks c JOIN st_topic_rows t ON t.doc_id = c.doc_id
        WHERE NOT c.is_deleted AND length(content) > 300 AND topic_name IN {_TOPIC_LIST}
        ORDER BY md5(concat(chunk_id, '|', topic_name, '|42')), chunk_id, topic_name LIMIT 50""",
    "qa_generate": """
        SELECT chunk_id,
               CASE WHEN usable THEN concat('What does the text say about ',
                    regexp_split_to_array(sentence, '[ \\n]+')[1], '?') ELSE 'INVALID_CHUNK' END AS question,
               CASE WHEN usable THEN sentence ELSE 'REJECTED' END AS answer,
               CASE WHEN words > 100 THEN 'Reasoning' ELSE 'Factoid' END AS complexity
        FROM (SELECT *, words >= 5 AND sentence <> '' AS usable FROM (
            SELECT chunk_id, trim(regexp_extract(content, '^[^.!?]*[.!?]?', 0), ' ') AS sentence,
                   len(list_filter(regexp_split_to_array(content, '[ \\n]+'), lambda w: w <> '')) AS words
            FROM fx_text_chunks WHERE NOT is_deleted AND length(content) > 300))""",
    "qa_reject_filter": """
        SELECT query_id, question, answer, complexity FROM fx_qa_pairs
        WHERE NOT contains(question, 'INVALID_CHUNK') AND answer <> 'REJECTED'""",
    "golden_yield": """
        SELECT run_id, count(*) AS sampled, count(*) FILTER (WHERE ok) AS valid,
               round(count(*) FILTER (WHERE ok) / count(*) * 100.0::DOUBLE, 9) AS yield_rate
        FROM (SELECT run_id, NOT contains(question, 'INVALID_CHUNK') AND answer <> 'REJECTED' AS ok
              FROM fx_qa_pairs) GROUP BY run_id""",
    "golden_replace_batch": """
        WITH incoming AS (
            SELECT concat('batch_', CASE WHEN run_id < 2 THEN run_id ELSE run_id + 1 END) AS batch_name,
                   question, answer AS ground_truth, complexity
            FROM fx_qa_pairs
            WHERE NOT contains(question, 'INVALID_CHUNK') AND answer <> 'REJECTED')
        SELECT batch_name, question, ground_truth, complexity,
               CAST(coalesce(len(expected_topics), 0) AS BIGINT) AS n_topics,
               is_deleted OR batch_name IN (SELECT batch_name FROM incoming) AS is_deleted
        FROM fx_golden_records
        UNION ALL
        SELECT batch_name, question, ground_truth, complexity, 0, false FROM incoming""",
    "golden_fetch_batch": """
        SELECT id, batch_name, question, ground_truth, complexity,
               CAST(coalesce(len(expected_topics), 0) AS BIGINT) AS n_topics
        FROM fx_golden_records WHERE batch_name = 'batch_1' AND NOT is_deleted""",
    "inference_worklist": """
        SELECT 'case1' AS mode, question, CAST(id AS VARCHAR) AS golden_record_id
        FROM fx_golden_records WHERE batch_name = 'batch_1' AND NOT is_deleted
        UNION ALL
        SELECT 'case2', question, '' FROM fx_query_history
        UNION ALL
        SELECT 'case2 limited', question, ''
        FROM (SELECT question FROM fx_query_history ORDER BY query_id LIMIT 50)""",
    "inference_golden_mapping": """
        SELECT query_id, golden_record_id FROM st_results WHERE golden_record_id IS NOT NULL""",
    "inference_summary": """
        SELECT run_id, CAST(1 AS BIGINT) AS inference_run_history, count(*) AS query_history,
               count(*) AS inference_run_query_mapping, count(golden_record_id) AS golden_record_query_mapping
        FROM st_results GROUP BY run_id""",
    "query_latency": """
        SELECT query_id, strftime(query_time, '%Y-%m-%d %H:%M:%S') AS query_time,
               strftime(query_time, '%Y-%m-%d %H:%M:%S') AS retrieval_time,
               strftime(response_time, '%Y-%m-%d %H:%M:%S') AS response_time,
               CAST(epoch_us(response_time) - epoch_us(query_time) AS DOUBLE) / 1000000 AS latency_seconds
        FROM fx_query_history""",
    "evaluation_fetch": """
        SELECT run_id, f.query_id, question, generated_answer, coalesce(n, 0) AS n_contexts, ground_truth
        FROM st_fetched f
        LEFT JOIN (SELECT query_id, count(*) AS n FROM fx_contexts GROUP BY query_id) c
          ON c.query_id = f.query_id""",
    "evaluation_case_counts": """
        SELECT run_id, count(*) AS total_queries, count(ground_truth) AS case1_queries,
               count(*) - count(ground_truth) AS case2_queries
        FROM st_fetched GROUP BY run_id""",
    "judge_routing": """
        SELECT run_id, query_id, CASE WHEN ground_truth IS NOT NULL THEN 'CASE1_GROUND_TRUTH'
               ELSE 'CASE2_RAG_TRIAD' END AS evaluation_strategy FROM st_fetched""",
    "judge_context_block": f"""
        SELECT h.query_id, coalesce(block, {_text(NO_CONTEXT)}) AS contexts
        FROM fx_query_history h LEFT JOIN (
            SELECT query_id, string_agg(concat('[Document ', pos, ']:', chr(10), text),
                       chr(10) || chr(10) ORDER BY pos) AS block
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_no) AS pos FROM fx_contexts)
            GROUP BY query_id) b ON b.query_id = h.query_id""",
    "judge_correctness": """
        SELECT run_id, query_id, metric_name, score, reasoning FROM st_scores
        WHERE evaluation_strategy = 'CASE1_GROUND_TRUTH'""",
    "judge_triad": """
        SELECT run_id, query_id, metric_name, score, reasoning FROM st_scores
        WHERE evaluation_strategy = 'CASE2_RAG_TRIAD'""",
    "eav_flatten": """
        SELECT job_id, query_id, evaluation_strategy, 'generation' AS metric_category, metric_name,
               CAST(CAST(score AS DECIMAL(5,4)) AS DOUBLE) AS metric_value, reasoning
        FROM st_scores JOIN fx_evaluation_jobs ON inference_run_id = run_id""",
    "evaluation_summary": """
        SELECT job_id, count(*) AS total_queries_evaluated,
               CAST(sum(CASE WHEN ground_truth IS NULL THEN 3 ELSE 1 END) AS BIGINT) AS metrics_generated
        FROM st_fetched JOIN fx_evaluation_jobs ON inference_run_id = run_id GROUP BY job_id""",
    "evaluation_jobs": """
        SELECT DISTINCT concat('job-', run_id) AS job_id, run_id AS inference_run_id,
               '2024-03-01 00:00:00' AS start_time, 'lexical' AS evaluator_model,
               'v1.0' AS evaluator_prompt_version FROM st_fetched""",
    "metrics_insert_if_absent": """
        SELECT event_id, job_id, query_id, evaluation_strategy, metric_name,
               CAST(metric_value AS DOUBLE) AS metric_value, reasoning
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, evaluation_strategy, metric_name, job_id
                     ORDER BY event_id) AS rn
              FROM fx_metric_candidates WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') n
        WHERE rn = 1 AND NOT EXISTS (
            SELECT 1 FROM fx_metric_candidates o
            WHERE o.ts < TIMESTAMP '2024-01-16 00:00:00' AND o.query_id = n.query_id
              AND o.evaluation_strategy = n.evaluation_strategy AND o.metric_name = n.metric_name
              AND o.job_id = n.job_id)""",
    "metrics_pivot": f"""
        SELECT job_id, query_id, question, generated_answer, ground_truth,
               {", ".join(f"CAST({m}_score AS DOUBLE) AS {m}_score, {m}_reasoning" for m in METRICS)}
        FROM st_pivot""",
    "metric_averages": f"""
        SELECT job_id, {", ".join(f"round({m}, 9) AS {m}" for m in METRICS)} FROM st_averages""",
    "job_metadata": "SELECT job_id, setting_id, dataset_name FROM st_metadata",
    "overall_quality": "SELECT job_id, quality_score FROM st_quality",
    "stage_metrics": " UNION ALL ".join(
        f"SELECT job_id, '{stage}' AS stage, '{metric}' AS metric_name, round({metric}, 9) AS value FROM st_averages"
        for metric, stage in dx.STAGES.items()
    ),
    "rule_retrieval": _single_rule(_below("1", "context_relevance", 3.5, dx.RETRIEVAL)),
    "rule_hallucination": _single_rule(_below("1", "faithfulness", 4.0, dx.HALLUCINATION)),
    "rule_answer_relevance": _single_rule(_poor_answer("1", 2.5, 3.5)),
    "rule_correctness": _single_rule(_below("1", "correctness", 4.0, dx.CORRECTNESS)),
    "diagnose_rules": """
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY rule_no) AS finding_no, issue,
               evidence, likely_root_causes, recommended_actions FROM st_findings""",
    "report_file_name": f"""
        SELECT dataset_name, job_id, {_report_file('dataset_name', 'job_id')} AS report_file
        FROM (SELECT dataset_name, CAST(job_id AS VARCHAR) AS job_id FROM st_metadata
              UNION ALL
              SELECT concat(lang, '_', CASE WHEN length(text) > 2000 THEN 'benchmark' ELSE 'case2' END, '_', source),
                     md5(text) FROM fx_documents
              UNION ALL
              SELECT batch_name, md5(ground_truth) FROM fx_golden_records)""",
    "diagnosis_report": f"""
        SELECT q.job_id, {_report_file('dataset_name', 'CAST(q.job_id AS VARCHAR)')} AS report_file,
               concat('{{"setting_id":"', setting_id, '","dataset_name":"', dataset_name,
                      '","overall_summary":{{"quality_score":', quality_score,
                      ',"latency_seconds":1.25,"cost_estimate":0.05}},"stage_metrics":{{"retrieval":{{"context_relevance":',
                      round(context_relevance, 9), '}},"reranking":{{}},"generation":{{"faithfulness":',
                      round(faithfulness, 9), ',"answer_relevance":', round(answer_relevance, 9),
                      '}},"end_to_end":{{"correctness":', round(correctness, 9), ',"semantic_similarity":',
                      round(semantic_similarity, 9), '}}}},"diagnosis":[', coalesce(findings, ''), ']}}') AS report
        FROM st_quality q JOIN st_metadata m ON m.job_id = q.job_id
        LEFT JOIN (SELECT job_id, string_agg(concat('{{"issue":"', issue, '","evidence":', {_json_list('evidence')},
                          ',"likely_root_causes":', {_json_list('likely_root_causes')},
                          ',"recommended_actions":', {_json_list('recommended_actions')}, '}}'), ',' ORDER BY rule_no) AS findings
                   FROM st_findings GROUP BY job_id) f ON f.job_id = q.job_id
        WHERE {" OR ".join(f"{m} <> 0" for m in METRICS)}""",
    "export_job_case1": """
        SELECT DISTINCT job_id FROM st_pivot WHERE correctness_score IS NOT NULL
        ORDER BY job_id DESC LIMIT 1""",
    "export_job_case2": """
        SELECT r.run_id, coalesce(
                   (SELECT job_id FROM fx_evaluation_jobs j WHERE j.inference_run_id = r.run_id
                    ORDER BY start_time DESC LIMIT 1),
                   (SELECT job_id FROM st_pivot WHERE faithfulness_score IS NOT NULL
                    GROUP BY job_id ORDER BY count(query_id) DESC, job_id LIMIT 1)) AS job_id
        FROM (SELECT DISTINCT conv_id % 6 AS run_id FROM fx_query_history) r""",
    "export_csv_rows": f"""
        SELECT job_id, CAST(p.query_id AS VARCHAR) AS query_id, question,
               coalesce(shown, '[]') AS retrieved_contexts, coalesce(generated_answer, 'None') AS generated_answer,
               coalesce(ground_truth, '') AS ground_truth,
               {", ".join(
                   f"CASE WHEN {m}_score IS NULL THEN '' ELSE {_decimal_fixed2(f'{m}_score')} END AS {m}_score, "
                   f"coalesce({m}_reasoning, '') AS {m}_reasoning" for m in METRICS[:4])}
        FROM st_pivot p LEFT JOIN (
            SELECT query_id, concat('[', string_agg(concat('{{"chunk_id":"', chunk_id, '","text":', to_json(text), '}}'),
                                    ',' ORDER BY rank_no), ']') AS shown
            FROM fx_contexts GROUP BY query_id) c ON c.query_id = p.query_id""",
}


def _bm25(chunks: str, k: int) -> str:
    """Common table expressions that score every posting of chunks; the last is best."""
    return f"""
        worded AS (
            SELECT chunk_id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'),
                                         lambda w: w <> '') AS ws FROM ({chunks})),
        figures AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM worded),
        postings AS (
            SELECT term, chunk_id, count(*) AS tf, any_value(length) AS length
            FROM (SELECT chunk_id, len(ws) AS length, unnest(ws) AS term FROM worded) GROUP BY term, chunk_id),
        weights AS (
            SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS weight
            FROM postings, figures GROUP BY term, n),
        asked AS (
            SELECT query_id, term, count(*) AS times
            FROM (SELECT item_id AS query_id,
                         unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
                                            lambda w: w <> '')) AS term FROM benchmark) GROUP BY query_id, term),
        scored AS (
            SELECT query_id, chunk_id,
                   sum(times * CAST(floor(weight * ((tf * 2.2::DOUBLE)
                       / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / mean)))) * 1000000) AS BIGINT)) AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term), figures GROUP BY query_id, chunk_id),
        best AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no,
                   chunk_id, score FROM scored QUALIFY rank_no <= {k})"""


SQL["bm25_topk"] = f"""WITH {_bm25("SELECT * FROM fx_text_chunks WHERE NOT is_deleted", 5)}
        SELECT query_id, rank_no, chunk_id, round(score / 1000000.0::DOUBLE, 6) AS score FROM best"""

SQL["hybrid_topk"] = f"""WITH {_bm25("""SELECT c.chunk_id, content FROM fx_document_chunks c
        JOIN fx_documents d ON d.doc_id = c.doc_id WHERE NOT c.is_deleted AND NOT d.is_deleted""", 20)},
        near AS (
            SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank_no
            FROM st_scored WHERE sim >= 0.15 QUALIFY rank_no <= 10),
        met AS (
            SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id,
                   b.rank_no AS sparse_rank, v.rank_no AS dense_rank,
                   coalesce(1.0::DOUBLE / (b.rank_no + 60), 0) + coalesce(1.0::DOUBLE / (v.rank_no + 60), 0) AS fused_score
            FROM best b FULL JOIN near v ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id)
        SELECT query_id, chunk_id, coalesce(sparse_rank, 0) AS sparse_rank,
               coalesce(dense_rank, 0) AS dense_rank, round(fused_score, 9) AS fused_score,
               row_number() OVER (PARTITION BY query_id ORDER BY met.fused_score DESC, chunk_id) AS rank_no
        FROM met QUALIFY rank_no <= 5"""


def _hashed(text: str) -> str:
    """Per row of st_truths the default vector of a text, 64 wide, as (key, dimension, value)."""
    return f"""
        SELECT key, code % 64 AS dimension,
               CAST(CAST(CAST(sum(sign) AS DOUBLE) / sqrt(sum(CAST(sum(sign) AS DOUBLE) * sum(sign)) OVER (PARTITION BY key))
                    AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT key, code, CASE WHEN code >= 2147483648 THEN -1 ELSE 1 END AS sign
              FROM (SELECT key, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) AS code
                    FROM (SELECT key, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'),
                                                         lambda w: w <> '')) AS word FROM st_truths)))
        GROUP BY key, code % 64 HAVING sum(sign) <> 0"""


VIEWS["st_truths"] = """
        SELECT row_number() OVER () AS key, run_id, query_id, generated_answer, ground_truth
        FROM st_fetched WHERE ground_truth IS NOT NULL"""
VIEWS["st_similarity"] = f"""
        SELECT run_id, query_id, coalesce(cosine, 0) AS cosine,
               round(greatest(coalesce(cosine, 0), 0) * 5, 4) AS score
        FROM st_truths t LEFT JOIN (
            SELECT a.key, sum(a.value * g.value) AS cosine
            FROM ({_hashed("generated_answer")}) a JOIN ({_hashed("ground_truth")}) g
              ON g.key = a.key AND g.dimension = a.dimension GROUP BY a.key) c ON c.key = t.key"""

SQL["judge_similarity"] = """
        SELECT run_id, query_id, 'semantic_similarity' AS metric_name, score,
               concat('cosine of answer and ground truth: ', printf('%.4f', cosine)) AS reasoning
        FROM st_similarity"""

SQL["similarity_averages"] = """
        WITH best AS (
            SELECT job_id, query_id, CAST(max(CAST(score AS DECIMAL(5,4))) AS DOUBLE) AS score
            FROM st_similarity JOIN fx_evaluation_jobs ON inference_run_id = run_id GROUP BY job_id, query_id),
        truths AS (
            SELECT DISTINCT l.query_id, g.ground_truth
            FROM fx_golden_mapping l LEFT JOIN fx_golden_records g ON g.id = l.golden_record_id AND NOT g.is_deleted)
        SELECT j.job_id, round(coalesce(avg(score), 0), 9) AS semantic_similarity
        FROM fx_evaluation_jobs j
        LEFT JOIN (SELECT b.* FROM best b JOIN fx_query_history h ON h.query_id = b.query_id AND NOT h.is_deleted
                   LEFT JOIN truths t ON t.query_id = b.query_id) p ON p.job_id = j.job_id
        GROUP BY j.job_id"""

SQL["ranking_metrics"] = """
        WITH truth AS (
            SELECT id AS truth_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(ground_truth, '')),
                       '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ws
            FROM fx_golden_records WHERE NOT is_deleted),
        held AS (
            SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
                                                            lambda w: w <> ''))) AS w
            FROM fx_documents WHERE NOT is_deleted),
        grades AS (
            SELECT truth_id, doc_id, least(3, 4 * count(*) // any_value(n)) AS grade
            FROM (SELECT truth_id, len(ws) AS n, unnest(ws) AS w FROM truth) t JOIN held USING (w)
            GROUP BY truth_id, doc_id HAVING 4 * count(*) >= any_value(n)),
        ideal AS (
            SELECT truth_id, count(*) OVER (PARTITION BY truth_id) AS total,
                   sum(CASE WHEN no <= 5 THEN (pow(2, grade) - 1) / log2(no + 1) END) OVER (PARTITION BY truth_id) AS best, no
            FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY grade DESC) AS no FROM grades)),
        asked AS (
            SELECT run_id, m.query_id, truth_id
            FROM fx_run_mapping m JOIN fx_golden_mapping l ON l.query_id = m.query_id
            JOIN truth ON truth_id = golden_record_id WHERE NOT m.is_deleted),
        met AS (
            SELECT run_id, a.query_id, a.truth_id, sum((pow(2, grade) - 1) / log2(rank_no + 1)) AS gain,
                   count(*) AS hits, min(rank_no) AS first
            FROM asked a JOIN fx_contexts c ON c.query_id = a.query_id AND rank_no <= 5
            JOIN grades g ON g.truth_id = a.truth_id AND g.doc_id = c.chunk_id GROUP BY ALL),
        pairs AS (
            SELECT a.run_id, total, coalesce(gain, 0) / best AS ndcg, coalesce(hits, 0) / total AS recall,
                   coalesce(1.0::DOUBLE / first, 0) AS reciprocal
            FROM asked a LEFT JOIN met m ON m.run_id = a.run_id AND m.query_id = a.query_id AND m.truth_id = a.truth_id
            LEFT JOIN (SELECT * FROM ideal WHERE no = 1) i ON i.truth_id = a.truth_id)
        SELECT run_id, count(*) AS n_pairs, count(total) AS n_judged,
               round(avg(CASE WHEN total IS NOT NULL THEN ndcg END), 9) AS ndcg,
               round(avg(CASE WHEN total IS NOT NULL THEN recall END), 9) AS recall, round(avg(reciprocal), 9) AS mrr
        FROM pairs GROUP BY run_id"""


SQL["expanded_search"] = f"""WITH {_bm25("SELECT * FROM fx_text_chunks WHERE NOT is_deleted", 10)},
        gains AS (
            SELECT query_id, term, sum(CAST(floor(weight * (tf / length) * 1000000) AS BIGINT)) AS gain
            FROM best JOIN postings USING (chunk_id) JOIN weights USING (term) GROUP BY query_id, term),
        added AS (
            SELECT query_id, term FROM gains g
            WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.query_id = g.query_id AND a.term = g.term)
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, term) <= 5),
        wider AS (SELECT query_id, term, 4 * times AS times FROM asked UNION ALL SELECT query_id, term, 1 FROM added),
        again AS (
            SELECT query_id, chunk_id,
                   sum(times * CAST(floor(weight * ((tf * 2.2::DOUBLE)
                       / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / mean)))) * 1000000) AS BIGINT)) AS score
            FROM wider JOIN weights USING (term) JOIN postings USING (term), figures GROUP BY query_id, chunk_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_no, chunk_id,
               round(score / 1000000.0::DOUBLE / 4.0::DOUBLE, 8) AS score
        FROM again QUALIFY rank_no <= 5"""

SQL["decomposed_search"] = f"""WITH {_bm25("SELECT * FROM fx_text_chunks WHERE NOT is_deleted", 10)
    .replace("asked AS (", "parts AS (SELECT item_id, unnest(string_split_regex(coalesce(text, ''), '[.?!;\\n]+')) AS text, "
             "unnest(range(len(string_split_regex(coalesce(text, ''), '[.?!;\\n]+')))) AS part FROM benchmark), asked AS (")
    .replace("SELECT item_id AS query_id,", "SELECT concat(item_id, '#', part) AS query_id,")
    .replace("AS term FROM benchmark)", "AS term FROM parts)")},
        shares AS (
            SELECT CAST(string_split(query_id, '#')[1] AS BIGINT) AS query_id, chunk_id,
                   sum(CAST(floor(1000000000 / (rank_no + 60)) AS BIGINT)) AS share, count(*) AS n_parts
            FROM best GROUP BY ALL)
        SELECT query_id, chunk_id, n_parts,
               row_number() OVER (PARTITION BY query_id ORDER BY share DESC, chunk_id) AS rank_no
        FROM shares QUALIFY rank_no <= 5"""

SQL["compare_runs"] = f"""
        WITH known AS (
            SELECT job_id AS run_id, query_id, metric_name, CAST(round(metric_value * 10000) AS BIGINT) AS units
            FROM fx_evaluation_metrics WHERE NOT is_deleted),
        pairs AS (
            SELECT k.*, b.units AS base FROM known k JOIN known b
              ON b.query_id = k.query_id AND b.metric_name = k.metric_name AND b.run_id = 0 WHERE k.run_id <> 0),
        drawn AS (
            SELECT *, CASE WHEN replicate = 0 THEN 1 ELSE list_sum([CASE WHEN u >= bound THEN 1 ELSE 0 END
                                                                   for bound in {POISSON}]) END AS times
            FROM (SELECT *, CAST('0x' || substr(md5(concat('7:', replicate, ':', query_id)), 1, 8) AS BIGINT) AS u
                  FROM pairs, range(201) r(replicate))),
        sums AS (
            SELECT run_id, metric_name, replicate, sum(times)::BIGINT AS n, sum(times * units)::BIGINT AS run,
                   sum(times * base)::BIGINT AS base
            FROM drawn GROUP BY ALL HAVING sum(times) > 0),
        told AS (
            SELECT run_id, metric_name, max(n) FILTER (WHERE replicate = 0) AS n_pairs,
                   max(base / n / 10000) FILTER (WHERE replicate = 0) AS baseline_mean,
                   max(run / n / 10000) FILTER (WHERE replicate = 0) AS run_mean,
                   max((run - base) / n / 10000) FILTER (WHERE replicate = 0) AS difference,
                   list((run - base) / n / 10000 ORDER BY (run - base) / n) FILTER (WHERE replicate > 0) AS d
            FROM sums GROUP BY ALL),
        limits(metric_name, least) AS (
            VALUES ('context_relevance', 3.5::DOUBLE), ('faithfulness', 4.0::DOUBLE), ('answer_relevance', 3.5::DOUBLE)),
        ends AS (
            SELECT *, d[CAST(floor(len(d) * 0.025::DOUBLE) AS BIGINT) + 1] AS low,
                   d[len(d) - CAST(floor(len(d) * 0.025::DOUBLE) AS BIGINT)] AS high FROM told)
        SELECT run_id, n_pairs, e.metric_name,
               CASE WHEN run_mean < least THEN 'below' WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse'
                    ELSE 'same' END AS verdict,
               round(baseline_mean, 9) AS baseline_mean, round(run_mean, 9) AS run_mean,
               round(difference, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high, round(least, 9) AS least
        FROM ends e LEFT JOIN limits l ON l.metric_name = e.metric_name"""


SQL["latency_profile"] = """
        WITH timed AS (
            SELECT CAST(run_id AS VARCHAR) AS run_id,
                   CAST(epoch_us(response_time) - epoch_us(query_time) AS DOUBLE) / 1000000 AS latency,
                   (length(question) * 0.075::DOUBLE + length(generated_answer) * 0.3::DOUBLE) / 1000000 AS cost
            FROM fx_run_mapping m JOIN fx_query_history h ON h.query_id = m.query_id
            WHERE NOT m.is_deleted AND NOT h.is_deleted),
        lists AS (
            SELECT run_id, list(latency ORDER BY latency) AS l, sum(cost) AS cost FROM timed GROUP BY run_id
            UNION ALL SELECT 'all', list(latency ORDER BY latency), sum(cost) FROM timed HAVING count(*) > 0)
        SELECT run_id, len(l)::BIGINT AS n, l[CAST(ceil(len(l) * 0.5::DOUBLE) AS BIGINT)] AS p50,
               l[CAST(ceil(len(l) * 0.9::DOUBLE) AS BIGINT)] AS p90,
               l[CAST(ceil(len(l) * 0.99::DOUBLE) AS BIGINT)] AS p99, round(cost, 6) AS cost FROM lists"""


SQL["chunk_sections"] = """
        WITH marked AS (
            SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i:
                       CASE WHEN (i - 1) % 7 = 0 THEN concat('# Part ', i, chr(10), x)
                            WHEN (i - 1) % 7 = 3 THEN concat('## Section ', i, ' ##', chr(10), x)
                            WHEN (i - 1) % 7 = 4 THEN concat('1.2.3 Detail ', i, chr(10), x) ELSE x END) AS ls
            FROM fx_documents WHERE text IS NOT NULL),
        texts AS (SELECT doc_id, string_split(array_to_string(ls, chr(10)), chr(10)) AS ls FROM marked),
        lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM texts),
        bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
        told AS (
            SELECT *, CASE WHEN regexp_full_match(t, '#{1,6}[ \\t]+\\S.*') THEN 1
                           WHEN regexp_full_match(t, '[0-9]{1,3}(\\.[0-9]{1,3}){0,5}\\.?[ \\t]+\\S.*') THEN 2 END AS kind
            FROM bare),
        titled AS (
            SELECT *, CASE kind WHEN 1 THEN rtrim(regexp_extract(t, '^#{1,6}[ \\t]+(\\S.*)$', 1), '# ' || chr(9))
                                WHEN 2 THEN regexp_extract(t, '^[0-9]{1,3}(\\.[0-9]{1,3}){0,5}\\.?[ \\t]+(\\S.*)$', 2) END AS title
            FROM told),
        levels AS (
            SELECT *, CASE WHEN kind = 1 AND title <> '' THEN length(regexp_extract(t, '^#+'))
                           WHEN kind = 2 AND length(title) <= 80 AND NOT regexp_matches(title, '[.!?;,:]$')
                           THEN 1 + length(replace(regexp_extract(t, '^[0-9]{1,3}(\\.[0-9]{1,3}){0,5}'), '.', '..'))
                                - length(regexp_extract(t, '^[0-9]{1,3}(\\.[0-9]{1,3}){0,5}')) END AS level
            FROM titled),
        placed AS (
            SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM levels),
        headings AS (SELECT doc_id, part, level, title FROM placed WHERE level IS NOT NULL),
        bodies AS (
            SELECT doc_id, part, string_agg(line, chr(10) ORDER BY no) AS body
            FROM placed WHERE level IS NULL GROUP BY doc_id, part),
        paths AS (
            SELECT b.doc_id, b.part, string_agg(h.title, ' > ' ORDER BY h.part) AS path
            FROM bodies b JOIN headings h ON h.doc_id = b.doc_id AND h.part <= b.part
            WHERE NOT EXISTS (SELECT 1 FROM headings k WHERE k.doc_id = h.doc_id AND k.part > h.part
                              AND k.part <= b.part AND k.level <= h.level)
            GROUP BY b.doc_id, b.part)
        SELECT b.doc_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.part) - 1 AS section_no,
               coalesce(path, '') AS heading_path, md5(body) AS content_md5
        FROM bodies b LEFT JOIN paths p ON p.doc_id = b.doc_id AND p.part = b.part
        WHERE regexp_matches(body, '[^\\s\\p{Z}]')"""


SQL["judge_failures"] = """
        SELECT run_id, count(*) AS total_queries_evaluated,
               count(*) FILTER (WHERE length(question) % 3 <> 0) AS metrics_generated,
               count(*) FILTER (WHERE length(question) % 3 = 0) AS failed
        FROM st_fetched GROUP BY run_id"""


def _needed(sql: str) -> list[str]:
    """Views a text uses, directly or through other views, in definition order."""
    todo, seen = [sql], set()
    while todo:
        for name in re.findall(r"\b(?:fx|st)_\w+", todo.pop()):
            if name in VIEWS and name not in seen:
                seen.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in seen]


def full_sql(name: str) -> str:
    sql = SQL[name].strip()
    views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in _needed(sql))
    if not views:
        return sql
    for head in ("WITH RECURSIVE", "WITH"):
        if sql.startswith(head):
            return f"{head} {views},\n{sql.removeprefix(head)}"
    return f"WITH {views}\n{sql}"


def all_sql() -> dict[str, str]:
    return {name: full_sql(name) for name in SQL}
