"""Run reports: call rows to text and captured console reports back to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from callscope.functions import metrics as M
from callscope.functions.constants import LINE_ENDS
from callscope.operators.ordered import known_along

# The line formats of a captured report.
SECTION = r"^\s*(?:MODEL: |STEP 1 )"
MODEL = r"MODEL: (\S+)"
MODEL_TAIL = r"model=(\S+)"
WARMUP = r"\[warmup\].*?(\d+) ms \(cold write\)"
CALL_ROW = r"^\s+(\d+)\s+(.+?)\s+(\d+) ms\s+(\d+)\s+(\d+)\s+(\d+)%\s*$"
TTFT_SECTION = r"^\s*(?:CACHE PROOF|Responses API\s+— |Chat Completions\s+— )"
TTFT_ROW = r"^\s*Run (write|read \d+|\d+)\s*: TTFT=\s*(\d+) ms\s+total=\s*(\d+) ms\s+\[(.*?)\]"
CREATED = r"(?:^\s*response_id = |^\s*New response_id\s+= )(\S+)"
FOLLOWS = r"^\s*previous_response_id = (\S+)"
DELETED = r"^\s*DELETED\s+(\S+)"
CALL_LINE = "  %-6s %-8s %8s %11s %12s %7s%%"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Captured reports as numbered lines with the section each line is in.

    A report is one run on one console, so a file is the natural row: its
    sections are carried down inside the row, and no shuffle is needed.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("report"), F.col("value").alias("text")
    )
    return report_lines(files)


def report_lines(files: DataFrame) -> DataFrame:
    """Lines of whole reports (``report``, ``text``) with their section header."""
    sections = files.select(
        "report",
        F.posexplode(F.split("text", rf"(?m)(?={SECTION}|{TTFT_SECTION})")).alias("section", "part"),
    )
    return sections.select(
        "report",
        "section",
        F.trim(F.regexp_extract("part", rf"^\s*([^{LINE_ENDS}]*)", 1)).alias("header"),
        F.posexplode(F.split("part", rf"\r\n|[{LINE_ENDS}]")).alias("line_no", "line"),
    )


def read_split_reports(spark: SparkSession, path: str) -> DataFrame:
    """The same lines from files of any size, which Spark reads in splits.

    Rows of a split are in the file's order, and splits are by their place in it, so sections, headers and
    line numbers are running sums and last known values along file, split and row. A section begins at
    its header line, or at a blank line that only blank ones part from it, as in
    :func:`report_lines`; the empty line behind a section's last line end is not listed.
    """
    splits = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("report"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # Line ends that Spark does not read as such; only behind these may a section begin.
    rows = splits.select(
        "file", "report", "split", "row", F.posexplode(F.split("value", "[\\x85\u2028\u2029]")).alias("part", "text")
    )
    place = ["row", "part"]
    header = F.col("text").rlike(rf"{SECTION}|{TTFT_SECTION}")
    blank = F.col("text").rlike(r"^\s*\z")
    ahead = known_along(
        rows.withColumn("blank", blank).withColumn("header_here", header),
        ["file"], ["split"], place, {}, {"next_header": F.when(~F.col("blank"), F.col("header_here"))}, backwards=True,
    )
    # The row before the first of a file would end a preamble, so the first begins no section of its own.
    first = (F.col("split") == 0) & (F.row_number().over(_first_rows()) == 1)
    marked = ahead.withColumn("begins", F.coalesce("next_header", F.lit(False)) & (F.col("blank") | F.col("header_here")))
    marked = marked.withColumn("lines", F.split("text", rf"\r\n|[{LINE_ENDS}]")).withColumn("first", first)
    shown = F.trim(F.regexp_extract("text", rf"^\s*([^{LINE_ENDS}]*)", 1))
    along = known_along(
        marked,
        ["file"],
        ["split"],
        place,
        {"section": (F.col("begins") & ~F.col("first")).cast("int"), "upto": F.size("lines").cast("bigint")},
        {"header": F.when(F.col("begins"), shown)},
    )
    start = F.when(F.col("begins"), F.col("upto") - F.size("lines"))
    along = known_along(along, ["file"], ["split"], place, {}, {"start": start})
    opening = (
        along.where("NOT blank")
        .groupBy("file")
        .agg(F.min_by(F.when(~F.col("begins"), shown), F.struct("split", *place)).alias("opening"))
    )
    along = along.join(opening, "file", "left")
    numbered = along.select(
        "report",
        F.col("section").cast("int").alias("section"),
        F.coalesce("header", "opening", F.lit("")).alias("header"),
        (F.col("upto") - F.size("lines") - F.coalesce("start", F.lit(0))).alias("before"),
        F.posexplode("lines").alias("nth", "line"),
    )
    return numbered.select(
        "report", "section", "header", (F.col("before") + F.col("nth")).cast("int").alias("line_no"), "line"
    )


def _first_rows() -> WindowSpec:
    return Window.partitionBy("file", "split").orderBy("row", "part")


def _int(column: str, pattern: str, group: int) -> Column:
    return F.regexp_extract(column, pattern, group).cast("bigint")


def parse_call_rows(lines: DataFrame) -> DataFrame:
    """Call rows of the report tables, other columns carried along."""
    kept = [c for c in lines.columns if c not in ("line", "line_no")]
    return lines.where(F.col("line").rlike(CALL_ROW)).select(
        *kept,
        _int("line", CALL_ROW, 1).alias("call_no"),
        F.trim(F.regexp_extract("line", CALL_ROW, 2)).alias("label"),
        _int("line", CALL_ROW, 3).alias("latency_ms"),
        _int("line", CALL_ROW, 4).alias("input_tokens"),
        _int("line", CALL_ROW, 5).alias("cached_tokens"),
        _int("line", CALL_ROW, 6).alias("cache_pct"),
    )


def parse_warmups(lines: DataFrame) -> DataFrame:
    """The warm-up latency of each section that had one."""
    return lines.where(F.col("line").rlike(WARMUP)).select(
        "report", "section", _int("line", WARMUP, 1).alias("cold_latency_ms")
    )


def parse_ttft_rows(lines: DataFrame) -> DataFrame:
    """Time-to-first-token rows; numbered runs are cold, the write and reads warm."""
    tag = F.regexp_extract("line", TTFT_ROW, 1)
    return lines.where(F.col("line").rlike(TTFT_ROW)).select(
        "report",
        "section",
        "line_no",
        F.when(tag.rlike(r"^\d+$"), F.lit("COLD")).otherwise(F.lit("WARM")).alias("cond"),
        tag.alias("tag"),
        _int("line", TTFT_ROW, 2).alias("ttft_ms"),
        _int("line", TTFT_ROW, 3).alias("total_ms"),
        F.regexp_extract("line", TTFT_ROW, 4).alias("label"),
    )


def parse_store_events(lines: DataFrame) -> DataFrame:
    """Stored responses a report created, followed up on or deleted."""
    events = [("created", CREATED), ("followed", FOLLOWS), ("deleted", DELETED)]
    matched = F.coalesce(
        *[
            F.when(
                F.col("line").rlike(pattern),
                F.struct(
                    F.lit(event).alias("event"),
                    F.regexp_extract("line", pattern, 1).alias("response_id"),
                ),
            )
            for event, pattern in events
        ]
    )
    return (
        lines.withColumn("_event", matched)
        .where(F.col("_event").isNotNull())
        .select("report", "section", "line_no", "_event.event", "_event.response_id")
    )


def section_model(header: Column) -> Column:
    """The model a section header names."""
    named = F.regexp_extract(header, MODEL, 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(header, MODEL_TAIL, 1))


def report_table(calls: DataFrame, ordinal: str = "call_no") -> DataFrame:
    """The successful calls as report columns."""
    return calls.where(F.col("error").isNull()).select(
        "run_id",
        F.col(ordinal).alias("call_no"),
        "label",
        M.fmt_ms(F.col("latency_ms"), unit="ms").alias("latency"),
        "input_tokens",
        "cached_tokens",
        M.cache_hit_pct(F.col("cached_tokens"), F.col("input_tokens")).alias("cache_pct"),
    )


def render_call_lines(report: DataFrame) -> DataFrame:
    """Report rows as text lines of the table layout."""
    columns = ("call_no", "label", "latency", "input_tokens", "cached_tokens", "cache_pct")
    line = F.format_string(CALL_LINE, *[F.col(c).cast("string") for c in columns])
    return report.withColumn("line", line)
