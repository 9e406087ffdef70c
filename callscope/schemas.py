"""Row shapes, as DDL: one explicit schema per JSON layout, none inferred."""

# Both reply layouts in one schema, so that a mixed log is parsed in one pass.
REPLY = (
    "output ARRAY<STRUCT<type STRING, content ARRAY<STRUCT<type STRING, text STRING>>>>, "
    "choices ARRAY<STRUCT<message STRUCT<content STRING>>>, "
    "usage STRUCT<input_tokens BIGINT, output_tokens BIGINT, "
    "input_tokens_details STRUCT<cached_tokens BIGINT>, "
    "prompt_tokens BIGINT, completion_tokens BIGINT, "
    "prompt_tokens_details STRUCT<cached_tokens BIGINT>>, "
    "_corrupt_record STRING"
)

REQUEST_RESPONSES = (
    "model STRING, input ARRAY<STRUCT<type STRING, role STRING, "
    "content ARRAY<STRUCT<type STRING, text STRING, "
    "prompt_cache_breakpoint STRUCT<mode STRING>>>>>, "
    "max_output_tokens INT, stream BOOLEAN, store BOOLEAN, "
    "prompt_cache_key STRING, previous_response_id STRING"
)

REQUEST_CHAT = (
    "model STRING, messages ARRAY<STRUCT<role STRING, content STRING>>, "
    "max_tokens INT, temperature DOUBLE, stream BOOLEAN, "
    "prompt_cache_key STRING, prompt_cache_isolation_key STRING"
)

CALLS = (
    "call_id BIGINT, run_id BIGINT, api STRING, cache_key STRING, isolation_key STRING, "
    "started_at TIMESTAMP, user_text STRING, response_text STRING, label STRING, "
    "latency_ms DECIMAL(18,2), input_tokens BIGINT, cached_tokens BIGINT, error STRING"
)

CHUNKS = (
    "request_id BIGINT, api STRING, seq BIGINT, ts TIMESTAMP, event_type STRING, delta STRING"
)

STORED = (
    "response_id STRING, previous_response_id STRING, output_text STRING, status STRING, "
    "created_at DOUBLE, input_tokens BIGINT, output_tokens BIGINT, retention STRING"
)
