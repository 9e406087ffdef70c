"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Method: every version of a file is addressed by the SHA-256 of its content. A ledger
says which pairs of blob and rule version have been scanned, and what was found. A scan reads
only blobs with a pair that the ledger lacks, applies only the rules lacking, adds
both to the ledger, and joins the findings back to every path whose version is the blob.

A span's place is the running sum of the lengths of what lies before it: the text
between the matches (the text split at the pattern) and the matches themselves. Sums
run over rows, one per match, so texts with very many matches stay linear.

Defined results: a null text is an empty one and has no spans; offsets count code
points, ends are exclusive; repeated rows share their blob and get equal findings;
other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.common import keep


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. A run of hex digits or of an access key is matched in
# whole, so its least length can be part of the pattern; an assignment that fails still
# uses up its text, so its length is checked afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)

LEDGER = "blob string, kind string, version int, found array<struct<start: bigint, end: bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """Per match: length of the text before it, its own length, whether it counts."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = {"gap": F.transform(F.split(text, rule.pattern, -1), F.length), "hit": F.transform(hits, F.length)}
    if rule.group:
        parts["value"] = F.transform(
            F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length
        )
    zipped = F.arrays_zip(*[v.alias(k) for k, v in parts.items()])
    value = "value" if rule.group else "hit"
    listed = F.transform(
        F.slice(zipped, F.lit(1), F.size(hits)),
        lambda m: F.struct(
            m["gap"].cast("bigint").alias("gap"),
            m["hit"].cast("bigint").alias("hit"),
            (m[value] >= rule.least).alias("counts"),
        ),
    )
    return F.when(F.rlike(text, pattern), listed)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, text, kinds``: each blob with rules not yet applied to it, once, and those rules."""
    every = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    blobs = versions.select("blob", "text")
    if ledger is None:
        return blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    done = ledger.groupBy("blob").agg(
        F.collect_set(F.concat_ws(":", "kind", "version")).alias("done")
    )
    left = blobs.join(done, "blob", "left").withColumn(
        "todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
    )
    return (
        left.where(F.size("todo") > 0)
        .groupBy("blob")
        .agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows of ``blobs`` (``blob, text, todo``): one per blob and rule applied."""
    named = [f"{r.kind}:{r.version}" for r in rules]
    per_rule = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.array_contains("todo", n).alias("due"),
                F.when(F.array_contains("todo", n), _matches(F.col("text"), r)).alias("matches"),
            )
            for r, n in zip(rules, named)
        ]
    )
    pairs = blobs.select("blob", F.explode(per_rule).alias("r")).where("r.due")
    rows = pairs.select("blob", "r.kind", "r.version", F.posexplode_outer("r.matches").alias("n", "m"))
    upto = Window.partitionBy("blob", "kind").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.hit")).over(upto)
    placed = rows.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("m.hit")).alias("start"), "end")
    return placed.groupBy("blob", "kind", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("m.counts"), span))).alias("found")
    )


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger with what this scan has added.

    The findings are ``versions`` with ``blob`` and, per rule, an array of spans
    ``{kind}_spans``.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    new = scan(unseen(versions.select(blob_of(content).alias("blob"), content.alias("text")), ledger, rules), rules)
    new = keep(new, "ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings(versions, whole, rules, text), whole


def scan_in_waves(
    versions: DataFrame, earlier: Column, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The same for versions that come in two waves: the ledger of the ``earlier`` ones is written
    and read back, and of the others only blobs that it lacks are scanned. Versions of which
    it is not known (null) come later. Findings are those of all."""
    first = F.coalesce(earlier, F.lit(False))
    _, ledger = scan_versions(versions.where(first), None, rules, text)
    _, whole = scan_versions(versions.where(~first), ledger, rules, text)
    return findings(versions, whole, rules, text), whole


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``versions`` with ``blob`` and ``{kind}_spans`` from a ledger that has all their blobs."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    per_blob = (
        ledger.where(F.array_contains(current, F.concat_ws(":", "kind", "version")))
        .where(F.size("found") > 0)
        .groupBy("blob")
        .agg(*[F.first(F.when(F.col("kind") == r.kind, F.col("found")), True).alias(f"{r.kind}_spans") for r in rules])
    )
    added = ["blob", *[f"{r.kind}_spans" for r in rules]]
    kept = [c for c in versions.columns if c.lower() not in added]
    marked = versions.select(*[F.col(f"`{c}`") for c in kept], blob_of(content).alias("blob"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return marked.join(per_blob, "blob", "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "blob",
        *[F.coalesce(f"{r.kind}_spans", none).alias(f"{r.kind}_spans") for r in rules],
    )


def _numbered(n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"))


def listed(rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a row of findings as ``kind:start:end``, by start, then by rule."""
    every = F.concat(*[F.transform(f"{r.kind}_spans", _numbered(n)) for n, r in enumerate(rules)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.transform(
        F.sort_array(every),
        lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["n"] + 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A text with every span of its findings masked; overlapping spans are one."""
    every = F.sort_array(
        F.concat(*[F.transform(F.col(f"{r.kind}_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in rules])
    )
    step = F.aggregate(
        every,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["parts"],
                    F.array(
                        F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                        F.lit("[secret]"),
                    ),
                ),
            )
            .otherwise(done["parts"])
            .alias("parts"),
        ),
        lambda done: F.concat(
            F.array_join(done["parts"], ""),
            F.substring(text, (done["at"] + 1).cast("int"), F.length(text)),
        ),
    )
    return F.when(F.size(every) == 0, text).otherwise(step)
