"""Replies whose layout is data: a table says where each layout keeps what.

A body is parsed once, to a variant. The first layout of the table whose marker it has is its layout; text and
token counts are read along that layout's paths. A new layout is a new row of the table, no code. A body that
is JSON of no known layout stays a row with that as its error, like failed calls and broken bodies.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions.text import extract_label

UNKNOWN, MALFORMED = "unknown layout", "malformed body"


class Layout(NamedTuple):
    """Paths of one layout; those of items, parts and texts are from one to the next.

    ``items`` is an array, of which the first only counts if ``first_item``, and those of ``item_type`` if
    it is given. An item has its text at ``text``, or an array ``parts`` of such, of ``part_type`` if given.
    """

    layout: str
    marker: str
    items: str
    first_item: bool
    item_type: str | None
    parts: str | None
    part_type: str | None
    text: str
    input_tokens: str
    cached_tokens: str
    output_tokens: str


SCHEMA = (
    "layout string, marker string, items string, first_item boolean, item_type string, parts string, "
    "part_type string, text string, input_tokens string, cached_tokens string, output_tokens string"
)

#: The two layouts in use.
KNOWN = (
    Layout(
        "chat", "$.choices", "$.choices", True, None, None, None, "$.message.content",
        "$.usage.prompt_tokens", "$.usage.prompt_tokens_details.cached_tokens", "$.usage.completion_tokens",
    ),
    Layout(
        "responses", "$.output", "$.output", False, K.MESSAGE_ITEM, "$.content", K.TEXT_PART, "$.text",
        "$.usage.input_tokens", "$.usage.input_tokens_details.cached_tokens", "$.usage.output_tokens",
    ),
)


def layout_table(spark: SparkSession, layouts: tuple[Layout, ...] = KNOWN) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in layouts], SCHEMA)


def _list(value: Column, path: str, kind: str | None) -> Column:
    """An array of variants, of one type if given; empty where there is none."""
    found = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    if kind is None:
        return found
    return F.filter(found, lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == kind, F.lit(False)))


def _text(value: Column, layout: Layout) -> Column:
    items = _list(value, layout.items, layout.item_type)
    if layout.first_item:
        items = F.slice(items, 1, 1)

    def texts(item: Column) -> Column:
        if layout.parts is None:
            return F.coalesce(F.try_variant_get(item, layout.text, "string"), F.lit(""))
        parts = _list(item, layout.parts, layout.part_type)
        each = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, layout.text, "string"), F.lit("")))
        return F.array_join(each, "")

    return F.array_join(F.transform(items, texts), "")


def parse_by_layout(raw: DataFrame, layouts: DataFrame) -> DataFrame:
    """Call rows of raw replies (``call_id, status, body`` and more), with the ``layout`` each had.

    The layouts, in order of their names, come to the driver as literals of the plan; people write them. An
    object that has a key twice is a malformed body.
    """
    known = [Layout(*row) for row in layouts.select(*Layout._fields).orderBy("layout").collect()]
    value = F.col("_value")
    names = [
        F.when(F.try_variant_get(value, x.marker, "variant").isNotNull(), F.lit(x.layout)) for x in known
    ]
    kept = [c for c in raw.columns if c not in ("body", "layout")]
    # A generated column: filters on what is read from it are not pushed below, where they would parse again.
    parsed = raw.select(*kept, "body", F.explode_outer(F.array(F.try_parse_json("body"))).alias("_value"))
    named = parsed.select(
        *kept, "body", "_value", F.coalesce(*names, F.lit(None).cast("string")).alias("layout")
    )

    def pick(of) -> Column:
        return F.coalesce(*[F.when(F.col("layout") == x.layout, of(x)) for x in known], F.lit(None))

    counts = {
        c: pick(lambda x, c=c: F.coalesce(F.try_variant_get(value, getattr(x, c), "bigint"), F.lit(0).cast("bigint")))
        for c in ("input_tokens", "cached_tokens", "output_tokens")
    }
    error = (
        F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(value.isNull(), MALFORMED)
        .when(F.col("layout").isNull(), UNKNOWN)
    )
    read = named.select(
        *kept,
        "body",
        "layout",
        error.alias("error"),
        pick(lambda x: _text(value, x)).cast("string").alias("response_text"),
        *[of.cast("bigint").alias(c) for c, of in counts.items()],
    )
    failed = F.col("error").isNotNull()
    return read.select(
        *kept,
        F.when(~failed, F.col("layout")).alias("layout"),
        "error",
        F.when(failed, F.substring("body", 1, K.ERROR_PREVIEW)).alias("error_body"),
        *[F.when(~failed, F.col(c)).alias(c) for c in ("response_text", *counts)],
        F.when(~failed, extract_label(F.col("response_text"))).alias("label"),
    )
