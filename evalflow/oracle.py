"""DuckDB twins of the fixture derivations (FIXTURES.md part B).

These strings are the independent reference the driver compares Spark
results against; they are written in plain SQL, not generated from the
Spark plans.
"""

from __future__ import annotations

K = "json_extract_string(props, '$.k')"

RECORDS_BASE = f"""
records_base AS (
  SELECT
    e.event_type AS recipe,
    concat('ds', e.user_id % 3) AS dataset,
    concat('r', e.event_id) AS record_id,
    concat('q', e.event_id // 5) AS input,
    concat('a-', e.event_id, '.', {K}) AS output,
    concat('{{"k":', {K}, ',"seg":"s', e.event_id % 7, '","hot":',
           CASE WHEN e.event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}') AS metadata,
    [{{'page_content': b0.text, 'metadata': concat('{{"item":', b0.item_id, '}}')}},
     {{'page_content': b1.text, 'metadata': concat('{{"item":', b1.item_id, '}}')}}] AS contexts,
    CAST({K} AS BIGINT) * 10 AS n_tokens,
    e.ts AS start_time,
    e.ts + to_microseconds(CAST(round(e.value * 100000) AS BIGINT)) AS end_time,
    e.event_id
  FROM events e
  LEFT JOIN benchmark b0 ON b0.item_id = (e.event_id * 3) % (SELECT count(*) FROM benchmark)
  LEFT JOIN benchmark b1 ON b1.item_id = (e.event_id * 7 + 1) % (SELECT count(*) FROM benchmark)
)"""

RECORDS = "records AS (SELECT * EXCLUDE (event_id) FROM records_base)"


def _reason(n: str) -> str:
    return (
        f"CASE WHEN {n} % 29 = 0 THEN NULL WHEN {n} % 13 = 0 THEN concat('Criteria: c', {n}) "
        f"ELSE concat('Criteria: c', {n}, chr(10), 'Supporting Evidence: e', {n}) END"
    )


FEEDBACKS = f"""
fb_rows AS (
  SELECT r.*, m.ord, m.name, m.dup
  FROM records_base r
  CROSS JOIN (VALUES (0, 'answer_correctness', 0), (1, 'answer_relevance', 0),
                     (2, 'context_relevance', 0), (3, 'groundedness', 0),
                     (1, 'answer_relevance', 1)) m(ord, name, dup)
  WHERE m.dup = 0 OR r.event_id % 41 = 0
),
fb_vals AS (
  SELECT *,
    CASE WHEN dup = 1 THEN 'done'
         WHEN (event_id + ord) % 17 = 0 THEN 'failed'
         WHEN (event_id + ord) % 19 = 0 THEN 'none'
         WHEN (event_id + ord) % 23 = 0 THEN 'running'
         ELSE 'done' END AS status,
    CASE WHEN dup = 1 THEN CAST((event_id * 13) % 11 AS DOUBLE) / 10
         WHEN ord = 0 THEN CAST((event_id * 7) % 12 - 1 AS DOUBLE) / 10
         WHEN ord = 1 THEN CAST((event_id * 5) % 11 AS DOUBLE) / 10
         WHEN ord = 2 THEN CAST((event_id * 3) % 11 AS DOUBLE) / 10
         ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS result
  FROM fb_rows
),
feedbacks AS (
  SELECT recipe, dataset, record_id, name, status, result,
    CASE ord
      WHEN 0 THEN [{{'reason': concat('Criteria: agreement ', event_id), 'reasons': NULL::VARCHAR,
                    'context': NULL::VARCHAR, 'score': result}}]
      WHEN 1 THEN [{{'reason': {_reason('event_id')}, 'reasons': NULL::VARCHAR, 'context': NULL::VARCHAR,
                    'score': CAST(event_id % 11 AS DOUBLE) / 10}}]
      WHEN 2 THEN [{{'reason': {_reason('event_id')}, 'reasons': NULL::VARCHAR,
                    'context': contexts[1].page_content, 'score': CAST(event_id % 11 AS DOUBLE) / 10}},
                   {{'reason': {_reason('(event_id + 1)')}, 'reasons': NULL::VARCHAR,
                    'context': CASE WHEN event_id % 31 = 0 THEN 'context not in the retrieved list'
                                    ELSE contexts[2].page_content END,
                    'score': CAST((event_id + 1) % 11 AS DOUBLE) / 10}}]
      ELSE [{{'reason': NULL::VARCHAR, 'reasons': concat('Statement 0: supported ', event_id),
              'context': NULL::VARCHAR, 'score': CAST((event_id * 3) % 11 AS DOUBLE) / 10}},
            {{'reason': NULL::VARCHAR, 'reasons': concat('Statement 1: supported ', event_id),
              'context': NULL::VARCHAR, 'score': CAST((event_id * 3 + 1) % 11 AS DOUBLE) / 10}}]
    END AS calls,
    start_time + to_seconds(ord + 1 + dup * 100) AS last_ts
  FROM fb_vals
)"""

# Latest done result per record and metric, wide.
WIDE = """
wide AS (
  SELECT recipe, dataset, record_id,
    arg_max(result, last_ts) FILTER (WHERE name = 'answer_correctness') AS answer_correctness,
    arg_max(result, last_ts) FILTER (WHERE name = 'answer_relevance') AS answer_relevance,
    arg_max(result, last_ts) FILTER (WHERE name = 'context_relevance') AS context_relevance,
    arg_max(result, last_ts) FILTER (WHERE name = 'groundedness') AS groundedness
  FROM feedbacks WHERE status = 'done'
  GROUP BY recipe, dataset, record_id
)"""

RUN_FRAME = """
run_frame AS (
  SELECT r.recipe, r.dataset, r.record_id, r.metadata, r.n_tokens AS total_tokens,
    date_diff('microsecond', r.start_time, r.end_time) / 1e6 AS latency,
    r.input, r.output, r.start_time,
    w.answer_correctness, w.answer_relevance, w.context_relevance, w.groundedness
  FROM records r LEFT JOIN wide w USING (recipe, dataset, record_id)
)"""

CHART = """
chart AS (
  SELECT recipe, dataset, record_id, metadata, total_tokens, latency,
    CASE WHEN answer_correctness >= 0 THEN answer_correctness END AS answer_correctness,
    CASE WHEN answer_relevance >= 0 THEN answer_relevance END AS answer_relevance,
    CASE WHEN context_relevance >= 0 THEN context_relevance END AS context_relevance,
    CASE WHEN groundedness >= 0 THEN groundedness END AS groundedness
  FROM run_frame
)"""

LONG = """
long AS (
  UNPIVOT (SELECT record_id, recipe, dataset, answer_correctness, answer_relevance,
                  context_relevance, groundedness, latency FROM chart)
  ON answer_correctness, answer_relevance, context_relevance, groundedness, latency
  INTO NAME metric VALUE value
)"""

QUERY_ITEMS = """
query_items AS (
  SELECT concat('conv', u.conv_id % 2) AS dataset, u.conv_id * 100 + u.turn AS pos,
    u.text AS query, a.text AS ground_truth, u.conv_id, u.turn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

GOLDEN = """
golden AS (
  SELECT concat('ds', item_id % 3) AS dataset, item_id AS pos,
    concat('q', item_id // 6) AS query, text AS ground_truth
  FROM benchmark
)"""

EVAL_RECORDS = """
eval_records AS (
  SELECT 'lexical' AS recipe, q.dataset, concat('c', q.pos) AS record_id, q.query AS input,
    n.text AS output,
    [{'page_content': b0.text, 'metadata': concat('{"item":', b0.item_id, '}')},
     {'page_content': b1.text, 'metadata': concat('{"item":', b1.item_id, '}')}] AS contexts,
    q.ground_truth, q.pos
  FROM query_items q
  LEFT JOIN conversations n ON n.conv_id = q.conv_id AND n.turn = q.turn + 3 AND n.role = 'assistant'
  LEFT JOIN benchmark b0 ON b0.item_id = (q.conv_id * 3 + q.turn) % (SELECT count(*) FROM benchmark)
  LEFT JOIN benchmark b1 ON b1.item_id = (q.conv_id * 7 + q.turn + 1) % (SELECT count(*) FROM benchmark)
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


STORE = (RECORDS_BASE, RECORDS, FEEDBACKS)
FRAMES = (*STORE, WIDE, RUN_FRAME)
CHARTS = (*FRAMES, CHART)

RECIPES = """
recipes AS (
  SELECT t, cs, [{'key': 'source', 'value': t}, {'key': 'chunk_size', 'value': CAST(cs AS VARCHAR)},
                 {'key': 'k', 'value': CAST(length(t) AS VARCHAR)}] AS ingredients
  FROM (SELECT DISTINCT event_type AS t FROM events) CROSS JOIN (VALUES (100), (200)) v(cs)
),
named AS (
  SELECT *, array_to_string(list_transform(ingredients, lambda e: e.key || '_' || e.value), '_') AS recipe
  FROM recipes
),
plan AS (
  SELECT 'ingest' AS step, concat_ws('_', 'ingest', 'pipelines/ingest.py', 'ingest_documents', 'chunk_size_' || cs) AS pipeline_key,
    recipe FROM named
  UNION ALL
  SELECT 'query', concat_ws('_', 'query', 'pipelines/query.py', 'query_pipeline', 'chunk_size_' || cs || '_k_' || length(t)),
    recipe FROM named
)"""
