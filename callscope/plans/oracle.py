"""The registered queries in plain SQL, over the same views, as an independent check."""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LINE_END = r"\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}"

VIEWS = """
WITH RECURSIVE base AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS v,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
calls AS (
  SELECT event_id AS call_id, ts AS started_at, user_id AS run_id,
         CASE WHEN event_id % 2 = 0 THEN 'responses' ELSE 'chat' END AS api,
         concat('classifier-v', CAST(user_id % 7 AS VARCHAR)) AS cache_key,
         CASE WHEN user_id % 7 < 5 THEN user_id % 7 ELSE user_id % 14 END AS prompt_version,
         CASE WHEN event_type = 'error' THEN 'HTTP 500' END AS error,
         CAST(v * 10 AS DECIMAL(18,2)) AS latency_ms,
         CASE WHEN k = 0 THEN 0 ELSE 1280 + k END AS input_tokens,
         CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 1280 END AS BIGINT) AS cached_tokens,
         k AS user_tokens,
         CASE event_id % 6 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'Final answer: allow.'
              WHEN 2 THEN 'review or allow' WHEN 3 THEN 'Allow? No, block'
              WHEN 4 THEN '  blocked item number 12345678901234567890' ELSE '  '
         END AS response_text
  FROM base),
good AS (SELECT * FROM calls WHERE error IS NULL),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at, call_id) AS rn FROM calls),
warmups AS (
  SELECT run_id, call_id AS warmup_call_id, latency_ms AS cold_latency_ms
  FROM ordered WHERE rn = 1 AND error IS NULL),
warmed AS (
  SELECT o.*, w.cold_latency_ms FROM ordered o JOIN warmups w USING (run_id) WHERE o.rn > 1),
proof AS (
  SELECT api, call_id, started_at, latency_ms AS ttft_ms,
         CASE WHEN user_tokens < 50 AND api = 'chat' THEN concat('u', call_id) END AS isolation_key,
         CASE WHEN user_tokens < 50 AND api = 'responses' THEN concat('iso-', call_id // 4)
              ELSE cache_key END AS cache_key
  FROM calls),
sent AS (
  SELECT CASE WHEN answered THEN user_id ELSE -1 - user_id END AS request_id,
         epoch_us(min(ts)) - 250000 - (user_id % 5) * 100000 AS sent_us
  FROM base, (VALUES (true), (false)) AS v(answered)
  WHERE answered OR user_id % 50 = 0 GROUP BY user_id, answered),
ttft AS (
  SELECT api, cache_key, call_id, started_at, latency_ms AS ttft_ms,
         CASE WHEN user_tokens < 50 THEN 'COLD' ELSE 'WARM' END AS cond
  FROM calls),
chunks AS (
  SELECT user_id AS request_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         CASE event_type
           WHEN 'view' THEN ''
           WHEN 'click' THEN CASE user_id % 3 WHEN 0 THEN ' bl' WHEN 1 THEN ' re' ELSE '  ' END
           WHEN 'signup' THEN CASE user_id % 3 WHEN 0 THEN 'ock' WHEN 1 THEN 'view' ELSE chr(10) END
           WHEN 'error' THEN CASE user_id % 3 WHEN 0 THEN '.' WHEN 1 THEN chr(10) ELSE 'word' END
           ELSE CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'al' ELSE chr(9) END
         END AS delta,
         CASE WHEN event_type = 'purchase' THEN 'response.completed'
              ELSE 'response.output_text.delta' END AS ev
  FROM events),
messages AS (
  SELECT conv_id * 1000 + turn AS msg_id, conv_id AS prompt_version, text,
         concat('classifier-v', conv_id % 3) AS cache_key,
         CASE WHEN turn > 1 THEN CAST(conv_id * 1000 + turn - 1 AS VARCHAR) END
           AS previous_response_id,
         CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS isolation_key
  FROM conversations WHERE role = 'user'),
prompts AS (
  SELECT conv_id AS prompt_version, text AS prompt_text FROM conversations WHERE role = 'system'),
prompted AS (SELECT * FROM messages LEFT JOIN prompts USING (prompt_version)),
stored AS (
  SELECT conv_id * 1000 + turn AS response_id,
         CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS previous_response_id,
         conv_id, turn, role, text,
         1700000000 + conv_id * 100 + turn AS created_at,
         length(text) AS input_tokens, length(text) % 211 AS output_tokens
  FROM conversations),
deleted AS (SELECT response_id FROM stored WHERE conv_id % 5 = 0 AND turn = 0),
live AS (SELECT * FROM stored WHERE response_id NOT IN (SELECT response_id FROM deleted)),
expected AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'BLOCK' WHEN quality = 0 THEN 'REVIEW'
                      ELSE 'ALLOW' END AS expected
  FROM labels),
policy AS (
  SELECT * FROM (VALUES ('secrets', 3, '(password|api[_-]?key|secret)'),
                        ('contact', 2, '[a-z0-9._]+@[a-z0-9]+[.][a-z]+'),
                        ('license', 1, '(license|copyright)')) AS t(category, severity, pattern))
"""


def label(text: str) -> str:
    """The label rule as SQL."""
    words = " ".join(
        f"WHEN regexp_matches({text}, '(?i)(^|[^{WORD}]){word}($|[^{WORD}])') THEN '{word}'"
        for word in ("BLOCK", "ALLOW", "REVIEW")
    )
    line = f"[^{SPACE}]([^{LINE_END}]*[^{SPACE}])?"
    return f"CASE {words} ELSE substr(regexp_extract({text}, '{line}', 0), 1, 30) END"


PCT = (
    "CASE WHEN input_tokens = 0 THEN 0 ELSE CAST(round_even("
    "CAST(cached_tokens AS DOUBLE) / CAST(input_tokens AS DOUBLE) * 100, 0) AS BIGINT) END"
)
RATIO = "CAST(cold_latency_ms AS DOUBLE) / CAST(latency_ms AS DOUBLE)"
LATENCY_TAG = (
    "CASE WHEN CAST(latency_ms AS DOUBLE) < CAST(cold_latency_ms AS DOUBLE) * 0.85::DOUBLE "
    f"THEN 'WARM (' || printf('%.1f', {RATIO}) || '× faster than cold)' "
    "ELSE 'WARM (prompt_cache_key active)' END"
)
PCT_TAG = f"'WARM (' || CAST({PCT} AS VARCHAR) || '% cached)'"


def _verdict(table: str, key: str) -> str:
    return f"""SELECT d.{key}, max(severity) AS severity,
        string_agg(DISTINCT category, ',' ORDER BY category) AS categories
        FROM {table} d LEFT JOIN policy ON regexp_matches(d.text, pattern) GROUP BY d.{key}"""


WORDS = "CASE severity WHEN 3 THEN 'BLOCK' WHEN 2 THEN 'REVIEW' ELSE 'ALLOW' END"


def _judged() -> str:
    return f"(SELECT doc_id, {WORDS} AS label FROM ({_verdict('documents', 'doc_id')}))"


def _ab(source: str, keys: str) -> str:
    """The A/B test with the write call ranked out of the warm ones."""
    return f"""
SELECT {keys}, cold_runs, warm_reads, cold_ttft_ms, warm_ttft_ms,
       coalesce(cold_ttft_ms / nullif(warm_ttft_ms, 0), 0) AS speedup,
       CASE WHEN cold_ttft_ms / nullif(warm_ttft_ms, 0) >= 1.5::DOUBLE THEN 'CACHE ACTIVE'
            WHEN cold_ttft_ms / nullif(warm_ttft_ms, 0) >= 1.1::DOUBLE THEN 'CACHE LIKELY ACTIVE'
            ELSE 'CACHE NOT CONFIRMED' END AS verdict
FROM (SELECT {keys},
        count(*) FILTER (cond = 'COLD') AS cold_runs,
        count(*) FILTER (cond = 'WARM' AND n > 1) AS warm_reads,
        CAST(sum(ttft_ms) FILTER (cond = 'COLD') AS DOUBLE)
          / nullif(count(*) FILTER (cond = 'COLD'), 0) AS cold_ttft_ms,
        CAST(sum(ttft_ms) FILTER (cond = 'WARM' AND n > 1) AS DOUBLE)
          / nullif(count(*) FILTER (cond = 'WARM' AND n > 1), 0) AS warm_ttft_ms
      FROM (SELECT *, row_number() OVER (
              PARTITION BY {keys}, cache_key, cond ORDER BY started_at, call_id) AS n
            FROM ({source})) GROUP BY {keys})"""


_SUMMARY = """
SELECT run_id, count(*) AS warm_calls, CAST(any_value(cold) AS DOUBLE) AS cold_latency_ms,
       CAST(sum(latency_ms) AS DOUBLE) / count(*) AS warm_latency_ms,
       coalesce(CAST(any_value(cold) AS DOUBLE)
         / nullif(CAST(sum(latency_ms) AS DOUBLE) / count(*), 0), 0) AS speedup
FROM ({rows}) GROUP BY run_id"""

_BASELINE = _SUMMARY.format(
    rows="SELECT run_id, latency_ms, cold_latency_ms AS cold FROM warmed WHERE error IS NULL"
)


def _item(role: str, text: str, extra: str = "") -> str:
    return (
        f"""'{{"type":"message","role":"{role}","content":[{{"type":"input_text","text":' """
        f"""|| CAST(to_json({text}) AS VARCHAR) || '{extra}}}]}}'"""
    )


_USER = _item("user", "'User message to classify: ' || text")

_REPLY = f"""
SELECT call_id, response_text, {label("response_text")} AS label, input_tokens,
       CASE WHEN call_id % 11 = 0 THEN 0 ELSE cached_tokens END AS cached_tokens, output_tokens
FROM ({{rows}})"""
_FAILED = "(error IS NOT NULL OR call_id % 97 = 0)"


def _parsed(api: str, text: str) -> str:
    rows = f"""SELECT call_id, CASE WHEN NOT {_FAILED} THEN {text} END AS response_text,
        CASE WHEN NOT {_FAILED} THEN input_tokens END AS input_tokens,
        CASE WHEN NOT {_FAILED} THEN cached_tokens END AS cached_tokens,
        CASE WHEN NOT {_FAILED} THEN user_tokens END AS output_tokens,
        {_FAILED} AS failed FROM calls WHERE api = '{api}'"""
    return f"""SELECT call_id, response_text,
        CASE WHEN NOT failed THEN {label("response_text")} END AS label, input_tokens,
        CASE WHEN NOT failed AND call_id % 11 = 0 THEN 0 ELSE cached_tokens END AS cached_tokens,
        output_tokens FROM ({rows})"""


_CHAT_TEXT = "CASE WHEN call_id % 13 = 0 THEN '' ELSE response_text END"


def _ttft(typed: bool) -> str:
    text = "ev = 'response.output_text.delta'" if typed else "true"
    token = text if typed else "delta <> ''"
    read = (
        """SELECT c.* FROM chunks c LEFT JOIN (SELECT request_id, min(seq) AS done FROM chunks
        WHERE ev = 'response.completed' GROUP BY request_id) USING (request_id)
        WHERE done IS NULL OR seq <= done"""
        if typed
        else "SELECT * FROM chunks"
    )
    ttft = "epoch_us(token_at) - sent_us"
    total = "epoch_us(end_at) - sent_us"
    if typed:
        ttft = f"coalesce({ttft}, {total})"
    return f"""
SELECT request_id, coalesce(chunks, 0) AS chunks, {ttft} AS ttft_us, {total} AS total_us,
       token_at IS NULL AS no_token, length(text) AS text_chars, {label("text")} AS label
FROM (SELECT request_id, sent_us, chunks, token_at, end_at, coalesce(text, '') AS text
      FROM sent FULL JOIN (SELECT request_id, count(*) AS chunks, max(ts) AS end_at,
             arg_min(ts, seq) FILTER ({token}) AS token_at,
             coalesce(string_agg(delta, '' ORDER BY seq) FILTER ({text}), '') AS text
      FROM ({read}) GROUP BY request_id) USING (request_id))"""


_GAPS = """
SELECT call_id, cache_key, started_at, cached_tokens,
       epoch_us(started_at) - epoch_us(before) AS gap_us,
       coalesce(started_at > before + INTERVAL 1 HOUR, true) AS expected_cold,
       cached_tokens = 0 AS observed_cold
FROM (SELECT *, lag(started_at) OVER (PARTITION BY cache_key ORDER BY started_at, call_id) AS before
      FROM calls)"""

_HEALTH = """
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, started_at, TIMESTAMP '1970-01-01')) AS window_start,
       cache_key, count(*) AS calls, count(*) FILTER (error IS NOT NULL) AS errors,
       CAST(count(*) FILTER (error IS NULL AND cached_tokens > 0) AS DOUBLE)
         / nullif(count(*) FILTER (error IS NULL), 0) AS hit_rate,
       CAST(sum(latency_ms) FILTER (error IS NULL) AS DOUBLE)
         / nullif(count(*) FILTER (error IS NULL), 0) AS mean_latency_ms
FROM calls GROUP BY 1, 2"""

_REPORT = f"""
SELECT run_id, rn AS call_no, {label("response_text")} AS label,
       CAST(CAST(round_even(latency_ms, 0) AS BIGINT) AS VARCHAR) || ' ms' AS latency,
       input_tokens, cached_tokens, {PCT} AS cache_pct
FROM ordered WHERE error IS NULL"""

BODIES: dict[str, str] = {
    "read_messages": "SELECT doc_id AS msg_id, text FROM documents",
    "requests_responses": f"""
        SELECT msg_id, cache_key, '{{"model":"classifier-model","input":['
          || CASE WHEN prompt_text IS NULL THEN '' ELSE {_item("system", "prompt_text")} || ',' END
          || {_USER} || '],"max_output_tokens":512,"store":true,"prompt_cache_key":"'
          || cache_key || '"' || CASE WHEN previous_response_id IS NULL THEN ''
             ELSE ',"previous_response_id":"' || previous_response_id || '"' END || '}}' AS body
        FROM prompted""",
    "requests_breakpoint": f"""
        SELECT msg_id, '{{"model":"classifier-model","input":['
          || CASE WHEN prompt_text IS NULL THEN ''
             ELSE {_item("developer", "prompt_text", ',"prompt_cache_breakpoint":{"mode":"explicit"}')}
             || ',' END
          || {_USER} || '],"stream":false,"store":false}}' AS body
        FROM prompted""",
    "requests_chat": """
        SELECT msg_id, cache_key, '{"model":"classifier-model","messages":['
          || CASE WHEN prompt_text IS NULL THEN ''
             ELSE '{"role":"system","content":' || CAST(to_json(prompt_text) AS VARCHAR) || '},' END
          || '{"role":"user","content":'
          || CAST(to_json('User message to classify: ' || text) AS VARCHAR)
          || '}],"max_tokens":512,"temperature":0.0,"stream":true,"prompt_cache_key":"'
          || cache_key || '"' || CASE WHEN isolation_key IS NULL THEN ''
             ELSE ',"prompt_cache_isolation_key":"' || isolation_key || '"' END || '}' AS body
        FROM prompted""",
    "requests_roundtrip": """
        SELECT msg_id, cache_key, 'classifier-model' AS model,
          CASE WHEN prompt_text IS NULL THEN 1 ELSE 2 END::BIGINT AS items,
          'User message to classify: ' || text AS user_item, previous_response_id
        FROM prompted""",
    "parse_responses": _parsed("responses", "response_text"),
    "parse_chat": _parsed("chat", _CHAT_TEXT),
    "normalize_usage": f"""
        SELECT call_id, api, CASE WHEN {_FAILED} THEN 0 ELSE input_tokens END AS input_tokens,
          CASE WHEN {_FAILED} OR call_id % 11 = 0 THEN 0 ELSE cached_tokens END AS cached_tokens
        FROM calls""",
    "error_rows": f"""
        SELECT call_id, api, coalesce(error, 'malformed body') AS error,
          CASE WHEN error IS NULL THEN '{{"output": ['
               ELSE substr('upstream failure ' || repeat('x', 290) || call_id, 1, 300) END
            AS error_body,
          CAST(latency_ms AS DOUBLE) AS latency_ms
        FROM calls WHERE {_FAILED}""",
    "parse_replies": f"""
        SELECT api, CASE WHEN error IS NOT NULL THEN error WHEN call_id % 97 = 0
               THEN 'malformed body' ELSE {label("text")} END AS outcome,
          count(*) AS calls,
          CAST(sum(CASE WHEN NOT {_FAILED} THEN input_tokens END) AS BIGINT) AS input_tokens,
          CAST(sum(latency_ms) AS DOUBLE) AS latency_ms
        FROM (SELECT *, CASE WHEN api = 'chat' THEN {_CHAT_TEXT} ELSE response_text END AS text
              FROM calls) GROUP BY 1, 2""",
    "report_table": _REPORT,
    "report_roundtrip": f"""
        SELECT run_id, call_no, label,
          CAST(replace(latency, ' ms', '') AS BIGINT) AS latency_ms,
          input_tokens, cached_tokens, cache_pct
        FROM ({_REPORT})""",
    "extract_label": f"""
        SELECT 'calls' AS source, call_id AS id, {label("response_text")} AS label FROM calls
        UNION ALL SELECT 'documents', doc_id, {label("text")} FROM documents
        UNION ALL SELECT 'stored', response_id, {label("text")} FROM stored""",
    "extract_label_sql": f"""
        SELECT call_id, {label("response_text")} AS label, {PCT} AS cache_pct FROM calls""",
    "cache_hit_pct": f"SELECT call_id, {PCT} AS cache_pct FROM calls",
    "warm_tag_tokens": f"""
        SELECT call_id, CASE WHEN cached_tokens = 0 THEN 'COLD' ELSE {PCT_TAG} END AS warm_tag
        FROM good""",
    "warm_tag_latency": f"SELECT call_id, {LATENCY_TAG} AS warm_tag FROM warmed WHERE error IS NULL",
    "warm_tag_hybrid": f"""
        SELECT call_id, CASE WHEN cached_tokens > 0 THEN {PCT_TAG} ELSE {LATENCY_TAG} END AS warm_tag
        FROM warmed WHERE error IS NULL""",
    "warm_tag_stored": """
        SELECT call_id, CASE WHEN cached_tokens > 0
          THEN 'WARM (' || cached_tokens || ' cached tkns)' ELSE 'WARM (key active)' END AS warm_tag
        FROM good""",
    "preview": "SELECT response_id, substr(text, 1, 55) AS preview FROM stored",
    "long_preview": """
        SELECT doc_id, CASE WHEN length(text) > 120
          THEN substr(text, 1, 120) || ' … [' || length(text) || ' chars stored in full]'
          ELSE text END AS preview
        FROM documents""",
    "flatten_content": """
        SELECT response_id, CASE WHEN role = 'system' THEN '?' ELSE role END AS role,
          CASE WHEN role = 'user' THEN text ELSE replace(text, chr(10), ' ') || ' ' END AS content
        FROM stored""",
    "created_ts": "SELECT response_id, created_at * 1000000 AS created_us FROM stored",
    "condition_check": """
        SELECT api, cond, count(*) AS calls, count(DISTINCT bucket) AS buckets,
          count(*) = count(DISTINCT bucket) AS all_unique
        FROM (SELECT api, coalesce(isolation_key, cache_key) AS bucket,
                CASE WHEN isolation_key IS NOT NULL OR cache_key LIKE 'iso-%' THEN 'COLD'
                     ELSE 'WARM' END AS cond FROM proof)
        GROUP BY api, cond""",
    "billed_tokens": """
        SELECT call_id, input_tokens - 0.5::DOUBLE * cached_tokens AS billed_tokens,
          coalesce(0.5::DOUBLE * cached_tokens * 100 / nullif(input_tokens, 0), 0) AS saving_pct
        FROM calls""",
    "prefix_eligible": """
        SELECT call_id, greatest(input_tokens - user_tokens, 0) AS prefix_tokens,
          greatest(input_tokens - user_tokens, 0) >= 1024 AS eligible
        FROM calls""",
    "format_compliance": """
        SELECT api, count(*) AS replies,
          count(*) FILTER (response_text IN ('BLOCK', 'ALLOW', 'REVIEW')) AS strict,
          CAST(count(*) FILTER (response_text IN ('BLOCK', 'ALLOW', 'REVIEW')) AS DOUBLE)
            / count(*) AS compliance
        FROM calls GROUP BY api""",
    "attach_baseline": """
        SELECT call_id, run_id, CAST(cold_latency_ms AS DOUBLE) AS cold_latency_ms
        FROM calls JOIN warmups USING (run_id)""",
    "with_warmup": """
        SELECT run_id, call_id, CAST(cold_latency_ms AS DOUBLE) AS cold_latency_ms FROM warmed
        UNION ALL SELECT run_id, warmup_call_id, NULL FROM warmups""",
    "retrieve": """
        SELECT s.response_id, l.response_id IS NOT NULL AS found,
          CASE WHEN l.response_id IS NOT NULL THEN 'completed' END AS status,
          CASE WHEN l.response_id IS NOT NULL THEN 'in_memory' END AS retention,
          l.input_tokens, l.output_tokens, l.created_at * 1000000 AS created_us,
          CASE WHEN length(l.text) > 120
            THEN substr(l.text, 1, 120) || ' … [' || length(l.text) || ' chars stored in full]'
            ELSE l.text END AS shown
        FROM stored s LEFT JOIN live l USING (response_id)""",
    "delete_outcomes": """
        SELECT response_id, 'deleted' AS outcome FROM deleted
        UNION ALL SELECT -1 - response_id, 'not found' FROM deleted""",
    "delete_stored": "SELECT response_id, role FROM live",
    "leak_audit": """
        SELECT role, count(*) AS leaked, CAST(sum(input_tokens) AS BIGINT) AS input_tokens
        FROM live GROUP BY role""",
    "leak_ids": "SELECT response_id FROM stored EXCEPT SELECT response_id FROM deleted",
    "dangling_parents": """
        SELECT response_id, previous_response_id FROM live l
        WHERE previous_response_id IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM live p WHERE p.response_id = l.previous_response_id)""",
    "chain_context": """
        SELECT response_id, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)
          AS BIGINT) AS context_chars FROM stored""",
    "chain_depth": """,
        tree AS (
          SELECT response_id, response_id AS root_id, 0::BIGINT AS depth,
            CAST(length(text) AS BIGINT) AS context_chars,
            previous_response_id IS NOT NULL AS dangling
          FROM live l WHERE previous_response_id IS NULL OR previous_response_id NOT IN
            (SELECT response_id FROM live)
          UNION ALL
          SELECT c.response_id, t.root_id, t.depth + 1, t.context_chars + length(c.text), t.dangling
          FROM live c JOIN tree t ON c.previous_response_id = t.response_id)
        SELECT * FROM tree""",
    "rebuild_context": """
        SELECT e.conv_id AS request_id, s.response_id, e.last_turn - s.turn + 1 AS hops_back, s.text
        FROM (SELECT conv_id, max(turn) AS last_turn FROM stored GROUP BY conv_id) e
        JOIN stored s USING (conv_id)""",
    "compare_apis": """
        SELECT cache_key,
          coalesce(CAST(sum(latency_ms) FILTER (api = 'responses') AS DOUBLE)
            / nullif(count(*) FILTER (api = 'responses'), 0), 0) AS responses_latency_ms,
          coalesce(CAST(sum(latency_ms) FILTER (api = 'chat') AS DOUBLE)
            / nullif(count(*) FILTER (api = 'chat'), 0), 0) AS chat_latency_ms
        FROM good GROUP BY cache_key""",
    "accuracy": f"""
        SELECT expected, count(*) AS items, count(*) FILTER (label = expected) AS right,
          CAST(count(*) FILTER (label = expected) AS DOUBLE) / count(*) AS accuracy
        FROM {_judged()} JOIN expected USING (doc_id) GROUP BY expected""",
    "confusion": f"""
        SELECT expected, label, count(*) AS items
        FROM {_judged()} JOIN expected USING (doc_id) GROUP BY expected, label""",
    "apply_policy": f"""
        SELECT doc_id, {WORDS} AS verdict, coalesce(categories, '') AS categories
        FROM ({_verdict("documents", "doc_id")})""",
    "run_summary_first": _SUMMARY.format(
        rows="""SELECT run_id, latency_ms, cold FROM (SELECT run_id, latency_ms,
            first_value(latency_ms) OVER w AS cold, row_number() OVER w AS n FROM good
            WINDOW w AS (PARTITION BY run_id ORDER BY started_at, call_id)) WHERE n > 1"""
    ),
    "run_summary_baseline": _BASELINE,
    "summary_against": _BASELINE,
    "ttft_ab": _ab("SELECT * FROM ttft", "api"),
    "ttft_ab_per_group": _ab(
        """SELECT api, call_id % 7 AS test_group, cache_key, call_id, started_at, ttft_ms,
           CASE WHEN isolation_key IS NOT NULL OR cache_key LIKE 'iso-%' THEN 'COLD'
                ELSE 'WARM' END AS cond FROM proof""",
        "api, test_group",
    ),
    "hit_rate": """
        SELECT cache_key, count(*) AS calls, count(*) FILTER (cached_tokens > 0) AS hits,
          CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
          CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
          CAST(count(*) FILTER (cached_tokens > 0) AS DOUBLE) / count(*) AS call_hit_rate,
          CAST(sum(cached_tokens) AS DOUBLE) / nullif(CAST(sum(input_tokens) AS DOUBLE), 0)
            AS token_hit_rate
        FROM good GROUP BY cache_key""",
    "cost_summary": """
        SELECT cache_key, input_tokens, cached_tokens,
          input_tokens - 0.5::DOUBLE * cached_tokens AS billed_tokens,
          coalesce(0.5::DOUBLE * cached_tokens * 100 / nullif(input_tokens, 0), 0) AS saving_pct
        FROM (SELECT cache_key, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
                CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens FROM good GROUP BY cache_key)""",
    "label_distribution": f"""
        SELECT api, {label("response_text")} AS label, count(*) AS calls FROM good GROUP BY 1, 2""",
    "key_hygiene": """
        SELECT 'key with several prefixes' AS finding, cache_key AS value,
          count(DISTINCT text) AS others
        FROM calls JOIN conversations ON conv_id = prompt_version AND turn = 0
        GROUP BY cache_key HAVING count(DISTINCT text) > 1
        UNION ALL
        SELECT 'prefix under several keys', sha256(text), count(DISTINCT cache_key)
        FROM calls JOIN conversations ON conv_id = prompt_version AND turn = 0
        GROUP BY text HAVING count(DISTINCT cache_key) > 1""",
    "output_tokens": """
        SELECT role, count(*) AS responses, min(output_tokens) AS min_tokens,
          CAST(sum(output_tokens) AS DOUBLE) / count(*) AS mean_tokens,
          max(output_tokens) AS max_tokens,
          quantile_disc(output_tokens, 0.5) AS p50_tokens,
          quantile_disc(output_tokens, 0.95) AS p95_tokens
        FROM stored GROUP BY role""",
    "column_widths": f"""
        SELECT greatest(length('call_no'), max(length(CAST(call_no AS VARCHAR)))) AS call_no,
          greatest(length('label'), max(length(label))) AS label,
          greatest(length('latency'), max(length(latency))) AS latency,
          greatest(length('cache_pct'), max(length(CAST(cache_pct AS VARCHAR)))) AS cache_pct
        FROM ({_REPORT})""",
    "layout_lines": """
        SELECT call_id, rpad(CAST(call_id AS VARCHAR), CAST(w.a AS INTEGER), ' ') || '  |  '
          || rpad(api, CAST(w.b AS INTEGER), ' ') || '  |  '
          || rpad(cache_key, CAST(w.c AS INTEGER), ' ') || '  |  '
          || rpad(response_text, CAST(w.d AS INTEGER), ' ') AS line
        FROM calls, (SELECT greatest(7, max(length(CAST(call_id AS VARCHAR)))) AS a,
          greatest(3, max(length(api))) AS b, greatest(9, max(length(cache_key))) AS c,
          greatest(13, max(length(response_text))) AS d FROM calls) w""",
    "prompt_size": """
        SELECT prompt_version, length(prompt_text) AS prompt_chars,
          (SELECT count(*) FROM messages m WHERE m.prompt_version = p.prompt_version) AS messages
        FROM prompts p""",
    "call_ordinal": "SELECT call_id, rn AS call_no FROM ordered",
    "ttft_tag": """
        SELECT call_id, api, cond, CASE WHEN cond = 'COLD' THEN 'run ' || n
          WHEN n = 1 THEN 'write' ELSE 'read ' || (n - 1) END AS tag,
          CASE WHEN cond = 'WARM' AND n > 1
               THEN coalesce(cold / nullif(CAST(ttft_ms AS DOUBLE), 0), 0) END AS read_speedup
        FROM (SELECT *, row_number() OVER (
                PARTITION BY api, cache_key, cond ORDER BY started_at, call_id) AS n
              FROM ttft)
        JOIN (SELECT api, cache_key, CAST(sum(ttft_ms) FILTER (cond = 'COLD') AS DOUBLE)
                / nullif(count(ttft_ms) FILTER (cond = 'COLD'), 0) AS cold
              FROM ttft GROUP BY api, cache_key) USING (api, cache_key)""",
    "call_speedup": """
        SELECT call_id, coalesce(CAST(first_value(latency_ms) OVER (PARTITION BY run_id
          ORDER BY started_at, call_id) AS DOUBLE) / nullif(CAST(latency_ms AS DOUBLE), 0), 0)
          AS speedup
        FROM good""",
    "retention_gaps": f"SELECT call_id, gap_us, expected_cold, observed_cold FROM ({_GAPS})",
    "gap_summary": f"""
        SELECT cache_key, count(*) AS calls, count(*) FILTER (expected_cold) AS expected_cold,
          count(*) FILTER (observed_cold) AS observed_cold,
          count(*) FILTER (expected_cold AND observed_cold) AS both, max(gap_us) AS longest_gap_us
        FROM ({_GAPS}) GROUP BY cache_key""",
    "first_stored": """
        SELECT conv_id, response_id FROM stored s
        WHERE turn = (SELECT min(turn) FROM stored f WHERE f.conv_id = s.conv_id)""",
    "slowest_calls": """
        SELECT cache_key, rank, call_id, CAST(latency_ms AS DOUBLE) AS latency_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY cache_key
                ORDER BY latency_ms DESC, cached_tokens, call_id) AS rank FROM good)
        WHERE rank <= 10""",
    "slowest_overall": """
        SELECT call_id, CAST(latency_ms AS DOUBLE) AS latency_ms FROM good
        ORDER BY good.latency_ms DESC, cached_tokens, call_id LIMIT 20""",
    "ttft_from_chunks": _ttft(typed=False),
    "ttft_typed_events": _ttft(typed=True),
    "ttft_from_chunks_stream": _ttft(typed=False),
    "ttft_typed_events_stream": _ttft(typed=True),
    "cache_health": _HEALTH,
    "cache_health_stream": _HEALTH,
    "warm_sessions": f"""
        SELECT cache_key, CAST(session_no AS BIGINT) AS session_no,
          epoch_us(min(started_at)) AS first_call_at, epoch_us(max(started_at)) AS last_call_at,
          count(*) AS calls, count(*) FILTER (cached_tokens > 0) AS hits,
          bool_or(expected_cold AND observed_cold) AS first_was_cold
        FROM (SELECT *, sum(CAST(expected_cold AS BIGINT)) OVER (PARTITION BY cache_key
                ORDER BY started_at, call_id) AS session_no FROM ({_GAPS}))
        GROUP BY cache_key, session_no""",
    "warm_sessions_stream": f"""
        SELECT cache_key, epoch_us(min(started_at)) AS first_call_at,
          epoch_us(max(started_at)) AS last_call_at,
          count(*) AS calls, count(*) FILTER (cached_tokens > 0) AS hits
        FROM (SELECT *, sum(CAST(expected_cold AS BIGINT)) OVER (PARTITION BY cache_key
                ORDER BY started_at, call_id) AS session_no FROM ({_GAPS}))
        GROUP BY cache_key, session_no""",
    "classify_stream": f"""
        SELECT d.msg_id, {WORDS} AS verdict, coalesce(categories, '') AS categories
        FROM ({_verdict("messages", "msg_id")}) d""",
    "label_stream": f"SELECT call_id, {label('response_text')} AS label FROM calls",
    "classify_batch": f"""
        SELECT doc_id, label, length(text) AS input_tokens, CAST(0 AS BIGINT) AS cached_tokens,
          CAST(NULL AS VARCHAR) AS error FROM {_judged()} JOIN documents USING (doc_id)""",
}

BODIES["parse_by_layout"] = BODIES["parse_replies"]
BODIES["report_files"] = BODIES["report_roundtrip"]
BODIES["shared_prefix"] = f"""
    SELECT cache_key, requests, shortest_chars,
      len(list_filter(range(1, shortest_chars + 1), lambda n: left(low, n) = left(high, n))) AS shared_chars
    FROM (SELECT cache_key, count(body) AS requests, min(body) AS low, max(body) AS high,
        min(length(body)) AS shortest_chars FROM ({BODIES["requests_responses"]}) GROUP BY cache_key)"""
BODIES["retrieve_by_id"] = """
    SELECT s.response_id, l.response_id IS NOT NULL AS found,
      CASE WHEN l.response_id IS NOT NULL THEN 'completed' END AS status, l.input_tokens, l.output_tokens
    FROM stored s LEFT JOIN live l USING (response_id) WHERE s.conv_id % 10 = 0"""
BODIES["delete_by_id"] = """
    SELECT response_id, role FROM stored
    WHERE response_id NOT IN (SELECT response_id FROM deleted WHERE response_id % 3 != 0)"""
BODIES["chain_depth_incremental"] = BODIES["chain_depth"]
BODIES["classify_once"] = BODIES["classify_batch"]

# A pattern matches where its phrase does once line ends are blanks.
BODIES["apply_policy_table"] = r"""
    SELECT doc_id, CASE max(severity) WHEN 3 THEN 'BLOCK' WHEN 2 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict,
      coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories
    FROM documents LEFT JOIN (
      SELECT DISTINCT 'category ' || item_id % 20 AS category, phrase, 3 - length(phrase) % 3 AS severity
      FROM (
        SELECT item_id, unnest(list_concat(regexp_extract_all(text, '[A-Za-z]{3,} [A-Za-z]{3,}'),
          regexp_extract_all(regexp_replace(text, '^[^ ]* ', ''), '[A-Za-z]{3,} [A-Za-z]{3,}'))) AS phrase
        FROM benchmark)
    ) ON contains(replace(text, chr(10), ' '), phrase)
    GROUP BY doc_id"""

# The cut variants answer the same questions.
BODIES |= {f"{name}_cut": BODIES[name] for name in ("call_ordinal", "warm_sessions", "attach_baseline")}

ORACLE = {name: VIEWS + body for name, body in BODIES.items()}
