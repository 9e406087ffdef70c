"""The whole-run reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import runs
from callscope.plans import lifecycle
from callscope.plans import views as V
from callscope.session import durable, shared_dir


def test_caching_reports(spark, sf_dir):
    calls = V.load_calls(spark, sf_dir)
    ok = runs.ok_calls(calls)
    plain = lifecycle.caching_report(calls, "first_vs_rest")
    assert plain.table.count() == plain.tags.count() == ok.count()
    warmed = lifecycle.caching_report(calls)
    good_runs = runs.warmups(calls).count()
    assert warmed.summary.count() == good_runs
    assert warmed.table.count() == runs.ok_calls(runs.calls_after_warmup(calls)).count()
    assert {r.warm_tag.split(" ")[0] for r in warmed.tags.select("warm_tag").distinct().collect()} == {"WARM"}
    assert warmed.hit_rate.count() == warmed.cost.count() == 7


def test_api_comparison(spark, sf_dir):
    calls = V.load_calls(spark, sf_dir)
    parts = [calls.where(F.col("api") == api).drop("api") for api in ("responses", "chat")]
    got = lifecycle.api_comparison(*parts, V.ttft(calls))
    assert got.latency.collect() == runs.compare_apis(calls).collect()
    assert got.proof.count() == 2 and got.summary.count() == runs.warmups(calls).count()


def test_store_audit(spark, sf_dir):
    created = V.load_stored(spark, sf_dir)
    follow_ups = created.where("turn = 1").select(
        F.col("conv_id").alias("request_id"), F.col("response_id").alias("previous_response_id")
    )
    audit = lifecycle.store_audit(created, V.deleted(created), follow_ups)
    gone = V.deleted(created).count()
    assert audit.retrieved.where("NOT found").count() == gone
    assert audit.leaked.count() == created.count() - gone
    assert audit.context.count() == 2 * follow_ups.count()
    assert audit.dangling.count() == gone


def test_durable_keeps_rows_in_the_shared_folder(spark):
    kept = durable(spark.range(10))
    assert kept.count() == 10
    assert spark.sparkContext.getCheckpointDir() is not None
    assert shared_dir(spark)
