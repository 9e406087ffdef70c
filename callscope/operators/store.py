"""Stored responses: look-up, deletion, leaks, chains.

A store has ``response_id``, ``previous_response_id`` and whatever describes the
response. Every id is unique, so the look-ups below join on a unique right side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import metrics as M
from callscope.operators.lookup import lookup
from callscope.operators.ordered import order_key, running_sum
from callscope.session import durable


def retrieve(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Stored completion, status and usage per id; an id that is not stored stays, not found."""
    kept = store.withColumn("_found", F.lit(True))
    joined = ids.select("response_id").join(kept, "response_id", "left")
    found = F.coalesce("_found", F.lit(False))
    return joined.withColumn("found", found).withColumn(
        "created_ts", M.created_ts(F.col("created_at"))
    ).drop("_found")


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the given ids; ids that are not stored change nothing."""
    return store.join(ids.select("response_id"), "response_id", "left_anti")


def delete_outcomes(store: DataFrame, ids: DataFrame) -> DataFrame:
    """What became of each id to delete: ``deleted``, ``not found`` or ``failed``.

    Where ``ids`` has the HTTP ``status`` of the call, one of 400 and more other than 404 is a failure, unless
    another call for the id went through. 404 is what a store says of an id it does not have.
    """
    stored = store.select("response_id", F.lit(True).alias("_stored"))
    failed = (F.col("status") >= 400) & (F.col("status") != 404) if "status" in ids.columns else F.lit(False)
    asked = ids.groupBy("response_id").agg(F.bool_and(F.coalesce(failed, F.lit(False))).alias("_failed"))
    return asked.join(stored, "response_id", "left").select(
        "response_id",
        F.when(F.col("_failed"), "failed")
        .when(F.col("_stored"), "deleted")
        .otherwise("not found")
        .alias("outcome"),
    )


def leak_audit(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """Responses created but never deleted."""
    return created.join(deleted.select("response_id"), "response_id", "left_anti")


def leak_ids(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """The same as a set of ids."""
    return created.select("response_id").subtract(deleted.select("response_id"))


def dangling_parents(live: DataFrame, **cut: int) -> DataFrame:
    """Live responses whose parent is no longer stored."""
    parents = live.select(F.col("response_id").alias("previous_response_id"))
    followers = live.where(F.col("previous_response_id").isNotNull())
    return lookup(followers, parents, "previous_response_id", "left_anti", **cut).select(
        *live.columns
    )


def first_stored(store: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Id of the first response of each run, if it completed: what a follow-up chains to."""
    at = order_key(store, order)
    done = F.col("status") == "completed" if "status" in store.columns else F.lit(True)
    first = store.groupBy(*keys).agg(
        F.min_by("response_id", at).alias("response_id"), F.min_by(done, at).alias("_done")
    )
    return first.where("_done").drop("_done")


def output_token_stats(store: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Spread of the output tokens per completion; the quantiles are exact at any size.

    A quantile's aggregate holds one count per distinct number of tokens, not per row.
    """

    def quantile(share: float) -> Column:
        return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY output_tokens)").cast("bigint")

    return store.groupBy(*keys).agg(
        F.count("output_tokens").alias("responses"),
        F.min("output_tokens").alias("min_tokens"),
        M.mean(F.sum("output_tokens"), F.count("output_tokens")).alias("mean_tokens"),
        F.max("output_tokens").alias("max_tokens"),
        quantile(0.5).alias("p50_tokens"),
        quantile(0.95).alias("p95_tokens"),
    )


def chat_context(
    store: DataFrame,
    keys: tuple[str, ...] = ("conv_id",),
    order: tuple[str, ...] = ("turn",),
    **cut: int,
) -> DataFrame:
    """Context size at each turn of a chat whose turns are numbered.

    A linear chain needs no walk along its links: the context of a turn is what
    the turns up to it add up to.
    """
    chars = F.length("text").cast("bigint")
    return running_sum(store, list(keys), list(order), chars, "context_chars", **cut)


def _links(store: DataFrame, text: str, **cut: int) -> DataFrame:
    """Each response with what it alone adds to a chain, and its parent as next stop.

    A parent that is not stored ends the chain here and now.
    """
    rows = store.select(
        F.col("response_id").alias("id"),
        F.col("previous_response_id").alias("up"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"),
    )
    stored = rows.select(F.col("id").alias("up"), F.lit(True).alias("_stored"))
    checked = lookup(rows, stored, "up", "left", **cut)
    return checked.select(
        "id",
        F.when(F.col("_stored"), F.col("up")).alias("up"),
        F.col("id").alias("root"),
        F.lit(1).cast("bigint").alias("links"),
        "chars",
        (F.col("up").isNotNull() & F.col("_stored").isNull()).alias("dangling"),
    )


def _moving(links: DataFrame) -> DataFrame:
    return links.where(F.col("up").isNotNull())


def _double(links: DataFrame, **cut: int) -> DataFrame:
    """Let every response jump twice as far, adding up what lies between."""
    far = links.select(F.col("id").alias("up"), F.struct(*links.columns[1:]).alias("far"))
    moved = lookup(_moving(links), far, "up", **cut).select(
        "id",
        F.col("far.up").alias("up"),
        F.col("far.root").alias("root"),
        (F.col("links") + F.col("far.links")).alias("links"),
        (F.col("chars") + F.col("far.chars")).alias("chars"),
        F.col("far.dangling").alias("dangling"),
    )
    return links.where(F.col("up").isNull()).unionByName(moved)


def _keep(links: DataFrame) -> DataFrame:
    """Keep one round. By id, so that the next round's far side is in place already."""
    return durable(links.repartition("id"))


def _rounds(links: DataFrame) -> range:
    """As many doublings as the longest possible chain needs, and one to notice a circle."""
    return range(links.count().bit_length() + 2)


def chain_links(store: DataFrame, text: str = "text", **cut: int) -> DataFrame:
    """Root, depth and context size of every response in any tree of chains.

    Responses jump to their ancestors in doubling steps, so the number of rounds
    grows with the logarithm of the longest chain; each round is one equi-join,
    kept in the shared folder so that a lost executor repeats one round at most.
    A chain whose parent was deleted ends there and is marked dangling.
    """
    links = _keep(_links(store, text, **cut))
    for _ in _rounds(links):
        if _moving(links).isEmpty():
            break
        links = _keep(_double(links, **cut))
    else:
        raise ValueError("responses refer to each other in a circle")
    return links.select(
        F.col("id").alias("response_id"),
        F.col("root").alias("root_id"),
        (F.col("links") - 1).alias("depth"),
        F.col("chars").alias("context_chars"),
        "dangling",
    )


def rebuild_context(
    follow_ups: DataFrame, store: DataFrame, text: str = "text", **cut: int
) -> DataFrame:
    """The stored context each follow-up refers to, one row per ancestor.

    ``follow_ups`` has ``request_id`` and ``previous_response_id``; ``hops_back``
    is 1 for the response it names. With every doubling of the jumps the known
    ancestors of all follow-ups double as well.
    """
    links = _keep(_links(store, text, **cut))
    asked = follow_ups.select("request_id", F.col("previous_response_id").alias("id"))
    start = lookup(asked, links.select("id"), "id", **cut)
    paths = start.withColumn("hops", F.lit(1).cast("bigint"))
    for _ in _rounds(links):
        # A response that still moves has jumped the full length of this round.
        jumps = _moving(links).select("id", "up", F.col("links").alias("far"))
        further = lookup(paths, jumps, "id", **cut).select(
            "request_id", F.col("up").alias("id"), (F.col("hops") + F.col("far")).alias("hops")
        )
        paths = durable(paths.unionByName(further).hint("rebalance"))
        if _moving(links).isEmpty():
            break
        links = _keep(_double(links, **cut))
    else:
        raise ValueError("responses refer to each other in a circle")
    back = paths.select(
        "request_id", F.col("id").alias("response_id"), F.col("hops").alias("hops_back")
    )
    return lookup(back, store, "response_id", **cut)
