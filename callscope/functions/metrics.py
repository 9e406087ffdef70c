"""Number expressions: cache share, speedup, verdicts, tags, cost, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions import constants as K


_INFINITE = float("inf")


def is_error(error: Column) -> Column:
    """Whether a call failed."""
    return error.isNotNull()


def cache_hit_pct(cached: Column, total: Column) -> Column:
    """Cached share of the input tokens in whole per cent, halves to even; 0 without input."""
    share = cached.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100
    return F.coalesce(F.bround(share, 0).cast("bigint"), F.lit(0).cast("bigint"))


def speedup(cold: Column, value: Column) -> Column:
    """How many times ``value`` fits into ``cold``; 0 when ``value`` is zero or missing."""
    return F.coalesce(F.try_divide(cold.cast("double"), value.cast("double")), F.lit(0.0))


def verdict(ratio: Column) -> Column:
    """Reading of a time-to-first-token speedup. Pass the unrounded ratio."""
    return (
        F.when(ratio >= K.ACTIVE_FROM, F.lit(K.ACTIVE))
        .when(ratio >= K.LIKELY_FROM, F.lit(K.LIKELY))
        .otherwise(F.lit(K.NOT_CONFIRMED))
    )


def mean(total: Column, n: Column) -> Column:
    """Mean from an exact sum and a count, NULL over nothing."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def fmt_ms(value: Column, unit: str = "s") -> Column:
    """A duration as whole milliseconds, halves to even."""
    ms = value * 1000 if unit == "s" else value
    return F.concat(F.bround(ms, 0).cast("bigint").cast("string"), F.lit(" ms"))


def fmt_ratio(ratio: Column) -> Column:
    """A ratio of at least 1 with one decimal, rounded on its binary value.

    The fraction of a double above 1 times 2**52 is a whole number, so the tenth
    and the rest below it are exact; decimal rounding would act on the shortest
    decimal form instead and turn 1.15 (in truth a little less) into 1.2.
    """
    bits = 52
    frac = ((ratio - F.floor(ratio)) * float(1 << bits)).cast("bigint") * 10
    tenth = F.shiftright(frac, bits)
    rest = frac.bitwiseAND(F.lit((1 << bits) - 1))
    half = F.lit(1 << (bits - 1))
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    tenths = F.floor(ratio) * 10 + tenth + up.cast("bigint")
    exact = F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))
    return (
        F.when(ratio == _INFINITE, F.lit("inf"))
        .when(ratio >= 1, exact)
        .otherwise(F.format_string("%.1f", ratio))
    )


def _tag_pct(cached: Column, total: Column) -> Column:
    return F.format_string(K.WARM_PCT, cache_hit_pct(cached, total))


def _is_faster(latency: Column, cold: Column) -> Column:
    return latency.cast("double") < cold.cast("double") * K.FASTER_SHARE


def _tag_latency(latency: Column, cold: Column) -> Column:
    # Not guarded as `speedup` is: a call that took no time at all is endlessly faster.
    plain = F.when(latency == 0, _INFINITE).otherwise(speedup(cold, latency))
    faster = F.format_string(K.WARM_FASTER, fmt_ratio(plain))
    return F.when(_is_faster(latency, cold), faster).otherwise(F.lit(K.WARM_ACTIVE))


def warm_tag(
    policy: str,
    *,
    cached: Column | None = None,
    total: Column | None = None,
    latency: Column | None = None,
    cold: Column | None = None,
) -> Column:
    """How warm a call was.

    ``tokens``               from the cached tokens alone; none means cold.
    ``latency``              from the latency against the warm-up; never cold.
    ``tokens_then_latency``  cached tokens if any, else the latency rule.
    ``stored``               cached tokens if any, else that the key is active.
    """
    if policy == "tokens":
        return F.when(cached == 0, F.lit(K.COLD)).otherwise(_tag_pct(cached, total))
    if policy == "latency":
        return _tag_latency(latency, cold)
    if policy == "tokens_then_latency":
        return F.when(cached > 0, _tag_pct(cached, total)).otherwise(_tag_latency(latency, cold))
    if policy == "stored":
        return F.when(cached > 0, F.format_string(K.WARM_TOKENS, cached)).otherwise(
            F.lit(K.WARM_KEY)
        )
    raise ValueError(f"unknown warm-tag policy: {policy}")


def billed_tokens(total: Column, cached: Column, discount: str = K.CACHED_DISCOUNT) -> Column:
    """Input tokens at full price after the discount on cached ones, exact."""
    return total.cast("decimal(18,0)") - cached.cast("decimal(18,0)") * F.lit(discount).cast(
        "decimal(6,4)"
    )


def saving_pct(total: Column, billed: Column) -> Column:
    """Share of the input cost saved, in per cent; 0 without input."""
    saved = (total.cast("decimal(38,4)") - billed.cast("decimal(38,4)")).cast("double")
    return F.coalesce(F.try_divide(saved * 100, total.cast("double")), F.lit(0.0))


def prefix_eligible(prefix_tokens: Column, minimum: int = K.MIN_PREFIX_TOKENS) -> Column:
    """Whether the static prefix is long enough to be cached."""
    return prefix_tokens >= minimum


def condition_of(isolation_key: Column, cache_key: Column) -> Column:
    """Cold when a call was kept apart by its own isolation key or bucket, else warm."""
    apart = isolation_key.isNotNull() | cache_key.startswith(K.ISOLATED_BUCKET_PREFIX)
    return F.when(apart, F.lit(K.COLD)).otherwise(F.lit(K.WARM))


def created_ts(epoch_seconds: Column) -> Column:
    """Creation time of a stored response."""
    return F.timestamp_seconds(epoch_seconds)
