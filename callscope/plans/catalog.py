"""The registered queries: each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope import schemas
from callscope.functions import metrics as M
from callscope.functions import text as X
from callscope.functions.registry import register
from callscope.operators import cache, id_store, infer, layout, lineage, once, policy, runs, store, ttft
from callscope.operators import policy_table as policy_tables
from callscope.plans import views as V
from callscope.session import configure, new_path
from callscope.sources import layouts, replies, reports, requests
from callscope.streaming import arrivals, live, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function's name, with the session set up first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def _double(*columns: str):
    return [F.col(c).cast("double").alias(c) for c in columns]


# Sources and sinks


@query
def read_messages(spark, sf_dir):
    """Whole documents as messages to classify."""
    return requests.read_messages(spark, f"{sf_dir}/documents.parquet", id_col="doc_id")


@query
def requests_responses(spark, sf_dir):
    return requests.build_responses_requests(
        V.load_messages(spark, sf_dir), V.load_prompts(spark, sf_dir), model=V.MODEL, store=True
    )


@query
def shared_prefix(spark, sf_dir):
    """What all request bodies of a cache key begin with."""
    return cache.shared_prefix(QUERIES["requests_responses"](spark, sf_dir))


@query
def requests_breakpoint(spark, sf_dir):
    plain = V.load_messages(spark, sf_dir).drop("cache_key", "previous_response_id")
    built = requests.build_responses_requests(
        plain,
        V.load_prompts(spark, sf_dir),
        model=V.MODEL,
        role="developer",
        breakpoint_mode="explicit",
        max_output_tokens=None,
        stream=False,
        store=False,
    )
    return built.select("msg_id", "body")


@query
def requests_chat(spark, sf_dir):
    return requests.build_chat_requests(
        V.load_messages(spark, sf_dir), V.load_prompts(spark, sf_dir), model=V.MODEL, stream=True
    )


@query
def requests_roundtrip(spark, sf_dir):
    """Requests written as JSON shards per key, read back and taken apart."""
    built = requests.build_responses_requests(
        V.load_messages(spark, sf_dir), V.load_prompts(spark, sf_dir), model=V.MODEL
    )
    path = new_path(spark, "requests")
    requests.write_requests(built, path)
    body = F.from_json("body", schemas.REQUEST_RESPONSES)
    items = F.col("r.input")
    return (
        requests.read_requests(spark, path)
        .withColumn("r", body)
        .select(
            "msg_id",
            "cache_key",
            F.col("r.model").alias("model"),
            F.size(items).cast("bigint").alias("items"),
            F.element_at(items, -1)["content"][0]["text"].alias("user_item"),
            F.col("r.previous_response_id").alias("previous_response_id"),
        )
    )


def _raw(spark, sf_dir):
    return V.raw_replies(V.load_calls(spark, sf_dir))


@query
def parse_responses(spark, sf_dir):
    raw = _raw(spark, sf_dir).where(F.col("api") == replies.RESPONSES)
    parsed = replies.parse_responses(raw)
    return parsed.select(
        "call_id", "response_text", "label", "input_tokens", "cached_tokens", "output_tokens"
    )


@query
def parse_chat(spark, sf_dir):
    parsed = replies.parse_chat(_raw(spark, sf_dir).where(F.col("api") == replies.CHAT))
    return parsed.select(
        "call_id", "response_text", "label", "input_tokens", "cached_tokens", "output_tokens"
    )


@query
def normalize_usage(spark, sf_dir):
    """Token counts of every reply; failed and broken ones have none."""
    usage = replies.normalize_usage(_raw(spark, sf_dir))
    return usage.select("call_id", "api", "input_tokens", "cached_tokens")


@query
def error_rows(spark, sf_dir):
    failed = replies.capture_errors(_raw(spark, sf_dir))
    return failed.select("call_id", "api", "error", "error_body", *_double("latency_ms"))


@query
def parse_replies(spark, sf_dir):
    """Both layouts in one pass, summed up per API and label."""
    parsed = replies.parse_replies(_raw(spark, sf_dir))
    return parsed.groupBy("api", F.coalesce("error", "label").alias("outcome")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("latency_ms").cast("double").alias("latency_ms"),
    )


@query
def parse_by_layout(spark, sf_dir):
    """The same with the layouts read from a table."""
    parsed = layouts.parse_by_layout(_raw(spark, sf_dir), layouts.layout_table(spark))
    return parsed.groupBy("api", F.coalesce("error", "label").alias("outcome")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("latency_ms").cast("double").alias("latency_ms"),
    )


def _report(spark, sf_dir):
    numbered = runs.call_ordinal(V.labelled(V.load_calls(spark, sf_dir)))
    return reports.report_table(numbered)


@query
def report_table(spark, sf_dir):
    return _report(spark, sf_dir)


@query
def report_roundtrip(spark, sf_dir):
    """Report rows written as console lines and parsed back."""
    lines = reports.render_call_lines(_report(spark, sf_dir)).select("run_id", "line")
    return reports.parse_call_rows(lines)


@query
def report_files(spark, sf_dir):
    """Report rows written as text files, each behind a header with its run, and read back in splits."""
    lines = reports.render_call_lines(_report(spark, sf_dir))
    header = F.concat(F.lit("  MODEL: run-"), F.col("run_id").cast("string"))
    path = new_path(spark, "reports")
    lines.select(F.explode(F.array(header, F.col("line"))).alias("line")).write.text(path)
    parsed = reports.parse_call_rows(reports.read_split_reports(spark, path))
    run = F.regexp_extract(reports.section_model(F.col("header")), r"run-(\d+)", 1).cast("bigint")
    return parsed.select(
        run.alias("run_id"), "call_no", "label", "latency_ms", "input_tokens", "cached_tokens", "cache_pct"
    )


# Projections and predicates


@query
def extract_label(spark, sf_dir):
    """Labels of replies, and of every whole document and conversation turn."""
    texts = [
        ("calls", V.load_calls(spark, sf_dir), "call_id", "response_text"),
        ("documents", V.table(spark, sf_dir, "documents"), "doc_id", "text"),
        ("stored", V.load_stored(spark, sf_dir), "response_id", "text"),
    ]
    parts = [
        df.select(
            F.lit(name).alias("source"),
            F.col(key).alias("id"),
            X.extract_label(F.col(c)).alias("label"),
        )
        for name, df, key, c in texts
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def extract_label_sql(spark, sf_dir):
    register(spark)
    V.load_calls(spark, sf_dir).createOrReplaceTempView("callscope_calls")
    return spark.sql(
        """SELECT call_id, extract_label(response_text) AS label,
        cache_hit_pct(cached_tokens, input_tokens) AS cache_pct FROM callscope_calls"""
    )


@query
def cache_hit_pct(spark, sf_dir):
    pct = M.cache_hit_pct(F.col("cached_tokens"), F.col("input_tokens"))
    return V.load_calls(spark, sf_dir).select("call_id", pct.alias("cache_pct"))


def _tags(calls, policy_name):
    return runs.tagged(calls, policy_name).select("call_id", "warm_tag")


def _warmed(spark, sf_dir):
    return runs.ok_calls(runs.calls_after_warmup(V.load_calls(spark, sf_dir)))


@query
def warm_tag_tokens(spark, sf_dir):
    return _tags(runs.ok_calls(V.load_calls(spark, sf_dir)), "tokens")


@query
def warm_tag_latency(spark, sf_dir):
    return _tags(_warmed(spark, sf_dir), "latency")


@query
def warm_tag_hybrid(spark, sf_dir):
    return _tags(_warmed(spark, sf_dir), "tokens_then_latency")


@query
def warm_tag_stored(spark, sf_dir):
    return _tags(runs.ok_calls(V.load_calls(spark, sf_dir)), "stored")


@query
def preview(spark, sf_dir):
    return V.load_stored(spark, sf_dir).select(
        "response_id", X.preview(F.col("text")).alias("preview")
    )


@query
def long_preview(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", X.long_preview(F.col("text")).alias("preview")
    )


@query
def flatten_content(spark, sf_dir):
    """User items are plain strings, the others arrays of parts, one of them without text."""
    plain = F.when(F.col("role") == "user", F.col("text"))
    parts = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text")))
    missing = F.array(F.struct(F.lit(None).cast("string").alias("text")))
    parts = F.when(F.col("role") != "user", F.concat(parts, missing))
    role = X.item_role(F.when(F.col("role") != "system", F.col("role")))
    return V.load_stored(spark, sf_dir).select(
        "response_id", role.alias("role"), X.flatten_content(plain, parts).alias("content")
    )


@query
def created_ts(spark, sf_dir):
    return V.load_stored(spark, sf_dir).select(
        "response_id", F.unix_micros(M.created_ts(F.col("created_at"))).alias("created_us")
    )


@query
def condition_check(spark, sf_dir):
    return cache.condition_check(V.proof_calls(V.load_calls(spark, sf_dir)))


@query
def billed_tokens(spark, sf_dir):
    billed = M.billed_tokens(F.col("input_tokens"), F.col("cached_tokens"))
    return V.load_calls(spark, sf_dir).select(
        "call_id",
        billed.cast("double").alias("billed_tokens"),
        M.saving_pct(F.col("input_tokens"), billed).alias("saving_pct"),
    )


@query
def prefix_eligible(spark, sf_dir):
    prefix = F.greatest(F.col("input_tokens") - F.col("user_tokens"), F.lit(0))
    return V.load_calls(spark, sf_dir).select(
        "call_id", prefix.alias("prefix_tokens"), M.prefix_eligible(prefix).alias("eligible")
    )


@query
def format_compliance(spark, sf_dir):
    return policy.format_compliance(V.load_calls(spark, sf_dir), ("api",))


# Joins


@query
def attach_baseline(spark, sf_dir):
    """Every call of a run with a good warm-up, warm-ups as a table of their own."""
    call_rows = V.load_calls(spark, sf_dir)
    based = runs.attach_baseline(call_rows, runs.warmups(call_rows))
    return based.select("call_id", "run_id", *_double("cold_latency_ms"))


@query
def with_warmup(spark, sf_dir):
    """Calls with their baseline, and the warm-ups after them without one."""
    call_rows = V.load_calls(spark, sf_dir)
    results = runs.calls_after_warmup(call_rows).select("run_id", "call_id", "cold_latency_ms")
    warm = runs.warmups(call_rows).select("run_id", F.col("warmup_call_id").alias("call_id"))
    return runs.with_warmup(results, warm).select("run_id", "call_id", *_double("cold_latency_ms"))


def _store(spark, sf_dir):
    created = V.load_stored(spark, sf_dir)
    return created, V.deleted(created)


@query
def retrieve(spark, sf_dir):
    created, gone = _store(spark, sf_dir)
    ids = created.select("response_id")
    # Only what is shown of a text goes through the look-up.
    created = created.withColumn("shown", X.long_preview(F.col("text"))).drop("text")
    got = store.retrieve(ids, store.delete(created, gone))
    return got.select(
        "response_id",
        "found",
        "status",
        "retention",
        "input_tokens",
        "output_tokens",
        F.unix_micros("created_ts").alias("created_us"),
        "shown",
    )


@query
def delete_outcomes(spark, sf_dir):
    """Outcome per id; some ids to delete were never stored."""
    created, gone = _store(spark, sf_dir)
    ids = gone.unionByName(gone.select((-1 - F.col("response_id")).alias("response_id")))
    return store.delete_outcomes(created, ids)


def _id_store(spark, sf_dir):
    """The responses on disk by id, in two appends."""
    created, gone = _store(spark, sf_dir)
    kept = id_store.IdStore(spark, new_path(spark, "responses"), buckets=16)
    early = F.col("turn") < 2
    for part in (created.where(early), created.where(~early)):
        kept.append(part)
    return kept, gone


@query
def retrieve_by_id(spark, sf_dir):
    """The responses of the first chats of each ten, by their ids."""
    kept, gone = _id_store(spark, sf_dir)
    kept.delete(gone)
    wanted = V.load_stored(spark, sf_dir).where(F.col("conv_id") % 10 == 0).select("response_id")
    return kept.retrieve(wanted).select("response_id", "found", "status", "input_tokens", "output_tokens")


@query
def delete_by_id(spark, sf_dir):
    """What is left after deletions that rewrite nothing; every third call failed."""
    kept, gone = _id_store(spark, sf_dir)
    status = F.when(F.col("response_id") % 3 == 0, 503).otherwise(200)
    kept.delete(gone.withColumn("status", status))
    return kept.rows().select("response_id", "role")


@query
def delete_stored(spark, sf_dir):
    created, gone = _store(spark, sf_dir)
    return store.delete(created, gone).select("response_id", "role")


@query
def leak_audit(spark, sf_dir):
    created, gone = _store(spark, sf_dir)
    return store.leak_audit(created, gone).groupBy("role").agg(
        F.count(F.lit(1)).alias("leaked"), F.sum("input_tokens").alias("input_tokens")
    )


@query
def leak_ids(spark, sf_dir):
    return store.leak_ids(*_store(spark, sf_dir))


@query
def dangling_parents(spark, sf_dir):
    live_rows = store.delete(*_store(spark, sf_dir))
    return store.dangling_parents(live_rows).select("response_id", "previous_response_id")


@query
def chain_context(spark, sf_dir):
    """Context size along numbered chats."""
    sized = store.chat_context(V.load_stored(spark, sf_dir))
    return sized.select("response_id", "context_chars")


@query
def chain_depth(spark, sf_dir):
    """Root, depth and context of what is left of the chains after the deletions."""
    return store.chain_links(store.delete(*_store(spark, sf_dir)))


@query
def chain_depth_incremental(spark, sf_dir):
    """The same, kept up to date: early turns, then the later ones and the deletions."""
    created, gone = _store(spark, sf_dir)
    early = F.col("turn") < 3
    changes = [(created.where(early), None), (created.where(~early), gone)]
    return lineage.lineage_of(spark, changes, buckets=16)


@query
def rebuild_context(spark, sf_dir):
    """The stored context a follow-up to the end of each chat would bring back."""
    created = V.load_stored(spark, sf_dir)
    parents = created.select(F.col("previous_response_id").alias("response_id"))
    ends = created.join(parents, "response_id", "left_anti")
    follow_ups = ends.select(
        F.col("conv_id").alias("request_id"), F.col("response_id").alias("previous_response_id")
    )
    context = store.rebuild_context(follow_ups, created)
    return context.select("request_id", "response_id", "hops_back", "text")


@query
def compare_apis(spark, sf_dir):
    return runs.compare_apis(V.load_calls(spark, sf_dir), ("cache_key",))


def _judged(spark, sf_dir):
    """Verdicts of the documents that have a label; only those are judged."""
    labelled = V.table(spark, sf_dir, "labels").select("doc_id")
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    verdict = policy.policy_verdict(F.col("text"), V.RULES)
    wanted = documents.join(labelled, "doc_id", "left_semi")
    return wanted.select("doc_id", verdict.alias("label"))


def _expected(spark, sf_dir):
    return V.expected(V.table(spark, sf_dir, "labels"))


@query
def accuracy(spark, sf_dir):
    judged, wanted = _judged(spark, sf_dir), _expected(spark, sf_dir)
    return policy.accuracy(judged, wanted, "doc_id", ("expected",))


@query
def confusion(spark, sf_dir):
    return policy.confusion(_judged(spark, sf_dir), _expected(spark, sf_dir), "doc_id")


@query
def apply_policy(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return policy.apply_policy(documents, V.RULES).select(
        "doc_id", "verdict", F.array_join("categories", ",").alias("categories")
    )


@query
def apply_policy_table(spark, sf_dir):
    """Whole documents under a policy of many rules that is read from a table."""
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = V.policy_table(V.table(spark, sf_dir, "benchmark"))
    return policy_tables.apply_policy_table(documents, rules).select(
        "doc_id", "verdict", F.array_join("categories", ",").alias("categories")
    )


# Aggregations


@query
def run_summary_first(spark, sf_dir):
    return runs.run_summary(V.load_calls(spark, sf_dir), "first_vs_rest")


@query
def run_summary_baseline(spark, sf_dir):
    return runs.run_summary(V.load_calls(spark, sf_dir), "baseline")


@query
def summary_against(spark, sf_dir):
    """The baseline summary with the warm-ups as a table of their own."""
    call_rows = V.load_calls(spark, sf_dir)
    measured = runs.calls_after_warmup(call_rows).drop("cold_latency_ms")
    return runs.summary_against(measured, runs.warmups(call_rows))


@query
def ttft_ab(spark, sf_dir):
    return ttft.ttft_ab(V.ttft(V.load_calls(spark, sf_dir)))


@query
def ttft_ab_per_group(spark, sf_dir):
    """The A/B test per API and test group, cold calls told by their isolation."""
    proof = V.proof_calls(V.load_calls(spark, sf_dir))
    cond = M.condition_of(F.col("isolation_key"), F.col("cache_key"))
    rows = proof.withColumn("cond", cond).withColumn("test_group", F.col("call_id") % 7)
    return ttft.ttft_ab(rows, ("api", "test_group"))


@query
def hit_rate(spark, sf_dir):
    return cache.hit_rate(V.load_calls(spark, sf_dir))


@query
def cost_summary(spark, sf_dir):
    cost = cache.cost_summary(V.load_calls(spark, sf_dir))
    return cost.withColumn("billed_tokens", F.col("billed_tokens").cast("double"))


@query
def label_distribution(spark, sf_dir):
    good = runs.ok_calls(V.labelled(V.load_calls(spark, sf_dir)))
    return policy.label_distribution(good, ("api",))


@query
def key_hygiene(spark, sf_dir):
    """Keys against prompt texts; each version is one row before its text is joined."""
    used = V.load_calls(spark, sf_dir).select("cache_key", "prompt_version").distinct()
    return cache.key_hygiene(used.join(V.load_openings(spark, sf_dir), "prompt_version"), "text")


@query
def output_tokens(spark, sf_dir):
    return store.output_token_stats(V.load_stored(spark, sf_dir), ("role",))


@query
def column_widths(spark, sf_dir):
    columns = ["call_no", "label", "latency", "cache_pct"]
    return layout.column_widths(_report(spark, sf_dir), columns)


@query
def layout_lines(spark, sf_dir):
    calls = V.load_calls(spark, sf_dir)
    return layout.layout_lines(
        calls, ["call_id", "api", "cache_key", "response_text"], keep=["call_id"]
    )


@query
def prompt_size(spark, sf_dir):
    return layout.prompt_size(V.load_prompts(spark, sf_dir), V.load_messages(spark, sf_dir))


# Windows, sort, top-k


@query
def call_ordinal(spark, sf_dir):
    return runs.call_ordinal(V.load_calls(spark, sf_dir)).select("call_id", "call_no")


#: Settings under which the keys of small tables are cut, as hot keys of large ones are.
CUT = {"share": 500, "floor": 0}


@query
def call_ordinal_cut(spark, sf_dir):
    """Numbered in slices: every run that holds more than 1 in 500 calls is cut."""
    return runs.call_ordinal(V.load_calls(spark, sf_dir), **CUT).select("call_id", "call_no")


@query
def warm_sessions_cut(spark, sf_dir):
    sessions = cache.warm_sessions(V.load_calls(spark, sf_dir), RETENTION, **CUT)
    return _micros(sessions, "first_call_at", "last_call_at")


@query
def attach_baseline_cut(spark, sf_dir):
    """Joined by broadcast for every run that holds more than 1 in 500 calls."""
    call_rows = V.load_calls(spark, sf_dir)
    based = runs.attach_baseline(call_rows, runs.warmups(call_rows), **CUT)
    return based.select("call_id", "run_id", *_double("cold_latency_ms"))


@query
def ttft_tag(spark, sf_dir):
    tagged = ttft.ttft_tag(V.ttft(V.load_calls(spark, sf_dir)), ("api", "cache_key"))
    return tagged.select("call_id", "api", "cond", "tag", "read_speedup")


@query
def call_speedup(spark, sf_dir):
    return runs.call_speedup(V.load_calls(spark, sf_dir)).select("call_id", "speedup")


RETENTION = "1 HOUR"


@query
def retention_gaps(spark, sf_dir):
    gaps = cache.retention_gaps(V.load_calls(spark, sf_dir), RETENTION)
    return gaps.select("call_id", "gap_us", "expected_cold", "observed_cold")


@query
def gap_summary(spark, sf_dir):
    return cache.gap_summary(cache.retention_gaps(V.load_calls(spark, sf_dir), RETENTION))


@query
def first_stored(spark, sf_dir):
    return store.first_stored(V.load_stored(spark, sf_dir), ("conv_id",), ("turn",))


@query
def slowest_calls(spark, sf_dir):
    slow = runs.slowest_calls(V.load_calls(spark, sf_dir), 10)
    return slow.select("cache_key", F.col("rank").cast("bigint"), "call_id", *_double("latency_ms"))


@query
def slowest_overall(spark, sf_dir):
    slow = runs.slowest_overall(V.load_calls(spark, sf_dir), 20)
    return slow.select("call_id", *_double("latency_ms"))


# Streams and sessions


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query
def ttft_from_chunks(spark, sf_dir):
    return ttft.ttft_from_chunks(V.load_chunks(spark, sf_dir), V.load_requests(spark, sf_dir))


@query
def ttft_typed_events(spark, sf_dir):
    requests_sent = V.load_requests(spark, sf_dir)
    timed = ttft.ttft_from_chunks(V.load_chunks(spark, sf_dir), requests_sent, typed=True)
    return ttft.fill_missing_first_token(timed)


WINDOW, DELAY = "1 DAY", "1 HOUR"


def _replies_stream(spark, sf_dir, typed: bool):
    """Chunks read as a stream; replies as written, and those still open from the log."""
    path = new_path(spark, "chunks")
    V.load_chunks(spark, sf_dir).write.parquet(path)
    stream = arrivals.reply_stream(live.read_log(spark, path), WINDOW, DELAY, typed)
    written = live.run_once(stream, "replies", live.ROCKSDB)
    return arrivals.reply_view(written, spark.read.parquet(path), V.load_requests(spark, sf_dir), typed)


@query
def ttft_from_chunks_stream(spark, sf_dir):
    return _replies_stream(spark, sf_dir, typed=False)


@query
def ttft_typed_events_stream(spark, sf_dir):
    """A typed reply is written at its completion event."""
    return ttft.fill_missing_first_token(_replies_stream(spark, sf_dir, typed=True))


@query
def cache_health(spark, sf_dir):
    health = cache.cache_health(V.load_calls(spark, sf_dir), WINDOW)
    return _micros(cache.health_rates(health), "window_start")


@query
def cache_health_stream(spark, sf_dir):
    """The log read as a stream into a table of sums, which is all the view reads."""
    log = V.calls(live.read_log(spark, V.log_path(sf_dir, "events")))
    table = tables.health_table(spark, new_path(spark, "cache-health"))
    held = table.follow_once(log, lambda rows: cache.cache_health(rows, WINDOW))
    return _micros(cache.health_rates(held), "window_start")


@query
def warm_sessions(spark, sf_dir):
    sessions = cache.warm_sessions(V.load_calls(spark, sf_dir), RETENTION)
    return _micros(sessions, "first_call_at", "last_call_at")


@query
def warm_sessions_stream(spark, sf_dir):
    """The log read as a stream into a table of stretches, which the view joins to sessions."""
    log = V.calls(live.read_log(spark, V.log_path(sf_dir, "events")))
    table = tables.session_table(spark, new_path(spark, "sessions"), RETENTION)
    sessions = table.follow_once(log, lambda rows: tables.stretches(rows, RETENTION))
    return _micros(sessions, "first_call_at", "last_call_at")


@query
def classify_stream(spark, sf_dir):
    log = V.messages(live.read_log(spark, V.log_path(sf_dir, "conversations")))
    judged = live.classify_stream(log, V.RULES).select(
        "msg_id", "verdict", F.array_join("categories", ",").alias("categories")
    )
    return live.run_once(judged, "verdicts")


@query
def label_stream(spark, sf_dir):
    log = V.calls(live.read_log(spark, V.log_path(sf_dir, "events")))
    return live.run_once(live.label_stream(log).select("call_id", "label"), "labels")


@query
def classify_batch(spark, sf_dir):
    """Whole documents sent to a model stand-in, one client per partition."""
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    answered = infer.classify_batch(documents, infer.rule_predictor(V.RULES))
    return answered.select("doc_id", "label", "input_tokens", "cached_tokens", "error")


@query
def classify_once(spark, sf_dir):
    """The same with a ledger, in which every different document is sent once."""
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    answered = once.classify_once(documents, infer.rule_predictor(V.RULES), new_path(spark, "ledger"), "v1")
    return answered.select("doc_id", "label", "input_tokens", "cached_tokens", "error")
