from __future__ import annotations

import random

from pyspark.sql import functions as F

from callscope.functions import metrics as M


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cache_hit_pct_rounds_halves_to_even(spark):
    rows = [(c, t) for t in (0, 1, 3, 8, 40, 200, 1346) for c in range(0, t + 1)]
    df = spark.createDataFrame(rows, "c bigint, t bigint")
    got = df.withColumn("p", M.cache_hit_pct(F.col("c"), F.col("t"))).collect()
    assert [r for r in got if r.p != (round(r.c / r.t * 100) if r.t else 0)] == []


def test_fmt_ratio_equals_binary_rounding(spark):
    random.seed(7)
    values = [1.0, 1.05, 1.15, 1.25, 1.35, 1.45, 1.75, 9.95, 9.949999999999999, 99.95, 2000.25]
    values += [random.uniform(1, 30) for _ in range(500)]
    values += [k / 20 for k in range(20, 400)] + [123456.75, 5e8 + 0.25, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.withColumn("s", M.fmt_ratio(F.col("v"))).collect()
    assert [r for r in got if r.s != f"{r.v:.1f}"] == []


def test_latency_tag_at_its_edges(spark):
    """The 0.85 threshold is strict; a call that took no time is endlessly faster."""
    rows = [
        (0.0, 10.0, "WARM (inf× faster than cold)"),
        (8.5, 10.0, "WARM (prompt_cache_key active)"),
        (8.4, 10.0, "WARM (1.2× faster than cold)"),
        (0.0, 0.0, "WARM (prompt_cache_key active)"),
    ]
    df = spark.createDataFrame(rows, "ms double, cold double, want string")
    tag = M.warm_tag("latency", latency=F.col("ms"), cold=F.col("cold"))
    assert df.where(tag != F.col("want")).isEmpty()


def test_fmt_ms(spark):
    values = [0.0, 0.0005, 0.0015, 0.0025, 1.2345, 2.8464999, 2.8465, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.withColumn("s", M.fmt_ms(F.col("v"))).collect()
    assert [r for r in got if r.s != f"{r.v * 1000:.0f} ms"] == []
    assert _one(spark, M.fmt_ms(F.lit("2.50").cast("decimal(18,2)"), unit="ms")) == "2 ms"


def test_speedup_is_zero_without_a_divisor(spark):
    assert _one(spark, M.speedup(F.lit(3.0), F.lit(0.0))) == 0.0
    assert _one(spark, M.speedup(F.lit(3.0), F.lit(None).cast("double"))) == 0.0


def test_verdict_uses_the_unrounded_ratio(spark):
    cases = {1.5: "CACHE ACTIVE", 1.4999: "CACHE LIKELY ACTIVE", 1.1: "CACHE LIKELY ACTIVE"}
    cases |= {1681.75 / 1537: "CACHE NOT CONFIRMED", 0.0: "CACHE NOT CONFIRMED"}
    for ratio, want in cases.items():
        assert _one(spark, M.verdict(F.lit(ratio))) == want


def test_condition_of(spark):
    null = F.lit(None).cast("string")
    assert _one(spark, M.condition_of(F.lit("u1"), F.lit("key"))) == "COLD"
    assert _one(spark, M.condition_of(null, F.lit("iso-1"))) == "COLD"
    assert _one(spark, M.condition_of(null, F.lit("key"))) == "WARM"
    assert _one(spark, M.condition_of(null, null)) == "WARM"


def test_billing(spark):
    row = spark.range(1).select(
        M.billed_tokens(F.lit(1345), F.lit(1280), "0.5").alias("b"),
        M.saving_pct(F.lit(1345), M.billed_tokens(F.lit(1345), F.lit(1280), "0.5")).alias("s"),
        M.saving_pct(F.lit(0), M.billed_tokens(F.lit(0), F.lit(0))).alias("z"),
        M.prefix_eligible(F.lit(1024)).alias("e"),
        M.prefix_eligible(F.lit(1023)).alias("n"),
    ).first()
    assert (float(row.b), round(row.s, 4), row.z, row.e, row.n) == (705.0, 47.5836, 0.0, True, False)
