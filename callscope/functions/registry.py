"""Expressions as SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from callscope.functions import constants as K
from callscope.functions.text import FIRST_LINE, word_pattern


def register(spark: SparkSession) -> None:
    """Create ``extract_label`` and ``cache_hit_pct`` as temporary SQL functions.

    Their bodies are SQL expressions, so the optimizer sees through the calls.
    """
    words = " ".join(f"WHEN text RLIKE r'{word_pattern(w)}' THEN '{w}'" for w in K.LABELS)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION extract_label(text STRING) RETURNS STRING
        RETURN CASE WHEN text IS NULL THEN '' {words}
        ELSE substring(regexp_extract(text, r'{FIRST_LINE}', 0), 1, {K.LABEL_FALLBACK_CHARS}) END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION cache_hit_pct(cached BIGINT, total BIGINT)
        RETURNS BIGINT RETURN coalesce(CAST(bround(
        CAST(cached AS DOUBLE) / nullif(total, 0) * 100, 0) AS BIGINT), 0)"""
    )
