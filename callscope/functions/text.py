"""Text expressions: verdict extraction, previews, request and stored-item text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions import constants as K

FIRST_LINE = rf"[^{K.SPACE_CHARS}](?:[^{K.LINE_ENDS}]*[^{K.SPACE_CHARS}])?"
_STRICT = rf"^(?:{'|'.join(K.LABELS)})$"


def word_pattern(word: str) -> str:
    """A pattern that looks for the word first and only then at what stands before it."""
    return rf"(?iu){word}(?<![{K.WORD_CHARS}]{word})(?![{K.WORD_CHARS}])"


def has_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands alone anywhere in ``text``, in any case."""
    return text.rlike(word_pattern(word))


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; empty when there is none."""
    return F.regexp_extract(text, FIRST_LINE, 0)


def extract_label(text: Column) -> Column:
    """The verdict a reply states: the first of the label words it contains.

    The order is that of ``LABELS``, not that of the words in the text. Without
    any, the start of the first line that is not blank; NULL counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.when(has_word(text, K.LABELS[0]), F.lit(K.LABELS[0]))
    for word in K.LABELS[1:]:
        found = found.when(has_word(text, word), F.lit(word))
    return found.otherwise(F.substring(first_line(text), 1, K.LABEL_FALLBACK_CHARS))


def strict_format(text: Column) -> Column:
    """Whether a reply is exactly one label word and nothing else."""
    # `$` would also match before a closing line end.
    return F.coalesce(text.rlike(_STRICT) & ~text.rlike(rf"[{K.LINE_ENDS}]"), F.lit(False))


def preview(text: Column, chars: int = K.MESSAGE_PREVIEW) -> Column:
    """The leftmost ``chars`` characters."""
    return F.substring(text, 1, chars)


def long_preview(text: Column, chars: int = K.LONG_PREVIEW) -> Column:
    """The whole text, or its start and a note of the full length."""
    note = F.format_string(K.LONG_PREVIEW_NOTE, F.length(text))
    return F.when(F.length(text) > chars, F.concat(preview(text, chars), note)).otherwise(text)


def wrap_user_text(text: Column) -> Column:
    """The user item of a classification request."""
    return F.concat(F.lit(K.USER_PREFIX), text)


def flatten_content(plain: Column, parts: Column) -> Column:
    """Text of an item whose content is a string or an array of text parts."""
    texts = F.transform(parts, lambda part: F.coalesce(part["text"], F.lit("")))
    return F.coalesce(plain, F.array_join(texts, " "), F.lit(""))


def item_role(role: Column) -> Column:
    """Role of a stored input item, with a stand-in when it has none."""
    return F.coalesce(role, F.lit(K.NO_ROLE))
