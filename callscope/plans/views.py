"""Call-log views over the given tables.

None of the tables is a call log, so these views read one out of them: events
become calls, token chunks and replies, conversations become messages, prompts
and stored responses. Each is a projection, apart from the chunks, which are
numbered per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions.text import extract_label
from callscope.operators.ordered import ordinal
from callscope.operators.policy import Rule
from callscope.sources.replies import CHAT, RESPONSES

MODEL = "classifier-model"

RULES = [
    Rule("secrets", "BLOCK", "(password|api[_-]?key|secret)"),
    Rule("contact", "REVIEW", "[a-z0-9._]+@[a-z0-9]+[.][a-z]+"),
    Rule("license", "ALLOW", "(license|copyright)"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policy_table(benchmark: DataFrame) -> DataFrame:
    """Pairs of neighbouring words of the benchmark as rules of twenty categories.

    A category has rules of all three verdicts; words may be parted by a blank or a line end.
    """
    text, pair = F.col("text"), r"[A-Za-z]{3,} [A-Za-z]{3,}"
    later = F.regexp_replace(text, r"^[^ ]* ", "")  # the pairs between those
    found = F.array_union(
        F.regexp_extract_all(text, F.lit(pair), F.lit(0)), F.regexp_extract_all(later, F.lit(pair), F.lit(0))
    )
    phrases = benchmark.select("item_id", F.explode(found).alias("phrase"))
    verdict = F.element_at(F.array(F.lit("BLOCK"), F.lit("REVIEW"), F.lit("ALLOW")), (F.length("phrase") % 3 + 1).cast("int"))
    return phrases.select(
        F.concat(F.lit("category "), (F.col("item_id") % 20).cast("string")).alias("category"),
        verdict.alias("verdict"),
        F.replace("phrase", F.lit(" "), F.lit(r"[ \n]")).alias("pattern"),
    ).distinct()


def log_path(sf_dir: str, name: str) -> str:
    """A table's path for a stream, as a pattern: it may be a single file or a folder."""
    return f"{sf_dir}/{name}.parque[t]"


def _pick(number: Column, texts: list[str]) -> Column:
    """One of the texts by number."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number + 1).cast("int"))


REPLY_TEXTS = [
    "BLOCK",
    "Final answer: allow.",
    "review or allow",
    "Allow? No, block",
    "  blocked item number 12345678901234567890",
    "  ",
]


def calls(events: DataFrame) -> DataFrame:
    """One call per event; a user's calls are a run."""
    event, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.withColumn("k", k)
    zero = F.lit(0).cast("bigint")
    return base.select(
        event.alias("call_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        user.alias("run_id"),
        F.when(event % 2 == 0, RESPONSES).otherwise(CHAT).alias("api"),
        F.concat(F.lit("classifier-v"), (user % 7).cast("string")).alias("cache_key"),
        F.when(user % 7 < 5, user % 7).otherwise(user % 14).alias("prompt_version"),
        F.when(F.col("event_type") == "error", F.lit("HTTP 500")).alias("error"),
        (F.col("value").cast("decimal(18,2)") * 10).cast("decimal(18,2)").alias("latency_ms"),
        F.when(F.col("k") == 0, zero).otherwise(F.col("k") + 1280).alias("input_tokens"),
        F.when(F.col("k") % 5 == 0, zero).otherwise(F.lit(1280)).alias("cached_tokens"),
        F.col("k").alias("user_tokens"),
        _pick(event % 6, REPLY_TEXTS).alias("response_text"),
    )


def load_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(table(spark, sf_dir, "events"))


def labelled(call_rows: DataFrame) -> DataFrame:
    return call_rows.withColumn("label", extract_label(F.col("response_text")))


def proof_calls(call_rows: DataFrame) -> DataFrame:
    """Calls of an A/B test: half of them isolated, by key or by a bucket of their own."""
    cold = F.col("user_tokens") < 50
    chat = F.col("api") == CHAT
    number = F.floor(F.col("call_id") / 4).cast("string")
    return call_rows.select(
        "api",
        "call_id",
        "started_at",
        F.when(cold & chat, F.concat(F.lit("u"), F.col("call_id").cast("string"))).alias(
            "isolation_key"
        ),
        F.when(cold & ~chat, F.concat(F.lit(K.ISOLATED_BUCKET_PREFIX), number))
        .otherwise(F.col("cache_key"))
        .alias("cache_key"),
        F.col("latency_ms").alias("ttft_ms"),
    )


def ttft(call_rows: DataFrame) -> DataFrame:
    cond = F.when(F.col("user_tokens") < 50, K.COLD).otherwise(K.WARM)
    return call_rows.select(
        "api",
        "cache_key",
        "call_id",
        "started_at",
        F.col("latency_ms").alias("ttft_ms"),
        cond.alias("cond"),
    )


# Deltas per event type, for requests 0, 1 and 2 modulo 3; label words are split.
DELTAS = {
    "view": ["", "", ""],
    "click": [" bl", " re", "  "],
    "signup": ["ock", "view", "\n"],
    "error": [".", "\n", "word"],
    "purchase": ["x", "al", "\t"],
}


def chunks(events: DataFrame) -> DataFrame:
    """A user's events as the token chunks of one request."""
    kind = F.col("event_type")
    delta = F.coalesce(
        *[
            F.when(kind == name, _pick(F.col("user_id") % 3, texts))
            for name, texts in DELTAS.items()
        ]
    )
    done = F.when(kind == "purchase", K.DONE_EVENT).otherwise(K.TEXT_EVENT)
    rows = events.select(
        F.col("user_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        done.alias("event_type"),
        delta.alias("delta"),
    )
    return ordinal(rows, ["request_id"], ("ts", "event_id"), "seq").drop("event_id")


def load_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "events"))


def chunk_requests(events: DataFrame) -> DataFrame:
    """When the requests of the chunks were sent: 250 to 650 ms before their first chunk.

    Every fiftieth user sent another request, which was never answered.
    """
    user = F.col("user_id")
    first = events.groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"))
    sent = F.timestamp_micros(F.col("at") - 250_000 - (user % 5) * 100_000).alias("sent_at")
    unanswered = first.where(user % 50 == 0).select((-1 - user).alias("request_id"), sent)
    return first.select(user.alias("request_id"), sent).unionByName(unanswered)


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_requests(table(spark, sf_dir, "events"))


def _response_id(turn: Column) -> Column:
    return F.col("conv_id") * 1000 + turn


def messages(conversations: DataFrame) -> DataFrame:
    """User turns as messages to classify; the conversation names the prompt version."""
    return conversations.where(F.col("role") == "user").select(
        _response_id(F.col("turn")).alias("msg_id"),
        F.col("conv_id").alias("prompt_version"),
        F.concat(F.lit("classifier-v"), (F.col("conv_id") % 3).cast("string")).alias("cache_key"),
        F.when(F.col("turn") > 1, _response_id(F.col("turn") - 1).cast("string")).alias(
            "previous_response_id"
        ),
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).alias("isolation_key"),
        "text",
    )


def load_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(table(spark, sf_dir, "conversations"))


def prompts(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("role") == "system").select(
        F.col("conv_id").alias("prompt_version"), "text"
    )


def load_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(table(spark, sf_dir, "conversations"))


def load_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of every conversation, as the prompt its number stands for."""
    first = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    return first.select(F.col("conv_id").alias("prompt_version"), "text")


def stored(conversations: DataFrame) -> DataFrame:
    """Every turn as a stored response that follows the turn before."""
    turn = F.col("turn")
    return conversations.select(
        _response_id(turn).alias("response_id"),
        F.when(turn > 0, _response_id(turn - 1)).alias("previous_response_id"),
        "conv_id",
        "turn",
        "role",
        "text",
        F.lit("completed").alias("status"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 100 + turn).cast("double").alias("created_at"),
        F.length("text").cast("bigint").alias("input_tokens"),
        (F.length("text") % 211).cast("bigint").alias("output_tokens"),
        F.lit("in_memory").alias("retention"),
    )


def load_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "conversations"))


def deleted(store: DataFrame) -> DataFrame:
    """The first response of every fifth chat was deleted."""
    return store.where((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)).select("response_id")


def expected(labels: DataFrame) -> DataFrame:
    verdict = (
        F.when(F.col("toxic") == 1, "BLOCK")
        .when(F.col("quality") == 0, "REVIEW")
        .otherwise("ALLOW")
    )
    return labels.select("doc_id", verdict.alias("expected"))


def _reply_responses() -> Column:
    """A typed-item body: a reasoning item, then the reply in two parts."""
    text = F.col("response_text")

    def part(value: Column) -> Column:
        return F.struct(F.lit(K.TEXT_PART).alias("type"), value.alias("text"))

    cached = F.when(F.col("call_id") % 11 != 0, F.col("cached_tokens"))
    usage = F.struct(
        F.col("input_tokens").alias("input_tokens"),
        F.col("user_tokens").alias("output_tokens"),
        F.struct(cached.alias("cached_tokens")).alias("input_tokens_details"),
    )
    thinking = F.struct(
        F.lit("reasoning").alias("type"), F.array(part(F.lit("block"))).alias("content")
    )
    reply = F.struct(
        F.lit(K.MESSAGE_ITEM).alias("type"),
        F.array(part(F.substring(text, 1, 3)), part(F.expr("substring(response_text, 4)"))).alias("content"),
    )
    return F.to_json(
        F.struct(F.array(thinking, reply).alias("output"), usage.alias("usage"))
    )


def _reply_chat() -> Column:
    """A chat body; every thirteenth has no choices."""
    message = F.struct(F.struct(F.col("response_text").alias("content")).alias("message"))
    cached = F.when(F.col("call_id") % 11 != 0, F.col("cached_tokens"))
    usage = F.struct(
        F.col("input_tokens").alias("prompt_tokens"),
        F.col("user_tokens").alias("completion_tokens"),
        F.struct(cached.alias("cached_tokens")).alias("prompt_tokens_details"),
    )
    choices = F.when(F.col("call_id") % 13 == 0, F.array()).otherwise(F.array(message))
    return F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))


def raw_replies(call_rows: DataFrame) -> DataFrame:
    """The calls as the replies they came from, failures and broken bodies included."""
    failed = F.col("error").isNotNull()
    broken = F.col("call_id") % 97 == 0
    filler = F.repeat(F.lit("x"), F.lit(290))
    upstream = F.concat(F.lit("upstream failure "), filler, F.col("call_id").cast("string"))
    body = (
        F.when(failed, upstream)
        .when(broken, F.lit('{"output": ['))
        .when(F.col("api") == RESPONSES, _reply_responses())
        .otherwise(_reply_chat())
    )
    status = F.when(failed, F.lit(500)).otherwise(F.lit(200))
    return call_rows.select(
        "call_id", "run_id", "api", "latency_ms", status.alias("status"), body.alias("body")
    )
