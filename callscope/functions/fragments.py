"""Label extraction over a text that arrives in pieces.

A reply is a sequence of deltas. Joining them all into one string would put a
whole reply, however long, into one row, so pieces are summarised instead: a
summary has a bounded size, two neighbours merge into one, and the label of the
whole text follows from the summary of the whole. Grouping pieces by hundreds,
level after level, then needs no task to hold more than one such group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions import constants as K

# A label word with the characters on both sides of it spans at most EDGE + 1
# characters, so EDGE characters on each side of a seam are enough to see it.
EDGE = max(map(len, K.LABELS)) + 1
_LINE = K.LABEL_FALLBACK_CHARS

_INNER = rf"(?iu)[^{K.WORD_CHARS}]%s[^{K.WORD_CHARS}]"
_LEADING = rf"(?iu)^%s(?:[^{K.WORD_CHARS}]|$)"
_TRAILING = rf"(?iu)(?:^|[^{K.WORD_CHARS}])%s$"
_NOT_BLANK = rf"[^{K.SPACE_CHARS}]"
_LINE_END = rf"[{K.LINE_ENDS}]"


def _left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _right(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def _line(text: Column, more: Column, open_: Column) -> Column:
    """Start of a line: its first characters, whether text follows them, whether it goes on."""
    return F.struct(
        _left(text, _LINE).alias("text"),
        (more | F.substring(text, F.lit(_LINE + 1), F.length(text)).rlike(_NOT_BLANK)).alias("more"),
        open_.alias("open"),
    )


def _line_of(text: Column) -> Column:
    start = F.regexp_extract(text, rf"^[^{K.LINE_ENDS}]*", 0)
    return _line(start, F.lit(False), ~text.rlike(_LINE_END))


def summarize(text: Column) -> Column:
    """Summary of one piece of text."""
    from_content = F.regexp_extract(text, rf"(?s){_NOT_BLANK}.*", 0)
    return F.struct(
        _left(text, EDGE).alias("head"),
        _right(text, EDGE).alias("tail"),
        *[text.rlike(_INNER % word).alias(word) for word in K.LABELS],
        # Up to the first line end, blank or not: it may go on a line begun before.
        _line_of(text).alias("lead"),
        # The first line that is not blank; its text is empty while there is none.
        _line_of(from_content).alias("line"),
        F.length(text).cast("bigint").alias("chars"),
    )


def empty() -> Column:
    """Summary of no text."""
    return summarize(F.lit(""))


def _extend(line: Column, piece: Column) -> Column:
    joined = F.concat(line["text"], piece["text"])
    longer = _line(joined, line["more"] | piece["more"], piece["open"])
    return F.when(line["open"], longer).otherwise(line)


def merge(a: Column, b: Column) -> Column:
    """Summary of the text of ``a`` followed by that of ``b``."""
    seam = F.concat(a["tail"], b["head"])
    return F.struct(
        _left(F.concat(a["head"], b["head"]), EDGE).alias("head"),
        _right(F.concat(a["tail"], b["tail"]), EDGE).alias("tail"),
        *[(a[word] | b[word] | seam.rlike(_INNER % word)).alias(word) for word in K.LABELS],
        _extend(a["lead"], b["lead"]).alias("lead"),
        F.when(a["line"]["text"] == "", b["line"])
        .otherwise(_extend(a["line"], b["lead"]))
        .alias("line"),
        (a["chars"] + b["chars"]).alias("chars"),
    )


def label_of(whole: Column) -> Column:
    """The label of the text a summary stands for."""

    def stated(word: str) -> Column:
        return (
            whole[word]
            | whole["head"].rlike(_LEADING % word)
            | whole["tail"].rlike(_TRAILING % word)
        )

    line = whole["line"]
    stripped = F.regexp_extract(line["text"], rf"(?s)^.*{_NOT_BLANK}", 0)
    found = F.when(stated(K.LABELS[0]), F.lit(K.LABELS[0]))
    for word in K.LABELS[1:]:
        found = found.when(stated(word), F.lit(word))
    return found.otherwise(F.when(line["more"], line["text"]).otherwise(stripped))
