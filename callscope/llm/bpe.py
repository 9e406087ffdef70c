"""Byte-pair encoding and decoding in batched numpy merge rounds.

Method: the symbols of many distinct words lie in one flat array. A round finds the
rank of every adjacent pair by binary search over the sorted pair keys, takes each
word's lowest rank, and merges all places of that pair in the word, left to right.
Words without a known pair leave the array. Texts become ids by gathering the ids of
their words, so every distinct word is merged once per task.

The vocabulary file is a parameter: a JSON file of a BPE model with word ends, lower
case, byte-level symbols, and special tokens that are cut out of the raw text first.

Where this code's Unicode tables and the library's may differ (beyond the scripts of ``PLAIN``), the
library itself normalises the text and parts it into words; merging stays the same.

Defined results: a null or empty text has no ids and decodes to the empty string;
unknown ids in ``decode`` are skipped and null ids too; repeated rows are encoded like any other; other
columns are kept, and an old column with a result's name is replaced.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from callscope.llm.common import with_columns

# The word pattern of the vocabulary, and what counts as white space in it.
BLANK = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"

#: Characters that letters, digits, blanks and lower case are alike of in all tables: Latin, Greek,
#: Cyrillic, punctuation, Kana, ideographs, Hangul.
PLAIN = r"\x00-\u0557\u2000-\u2063\u3000-\u30FE\u4E00-\u9FA5\uAC00-\uD7A3"

#: Distinct words remembered per task; more only costs merging some of them again.
MEMORY = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in symbols)
    symbols |= {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class Merges:
    """A vocabulary as arrays: byte ids, sorted pair keys with rank and product."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.width = max(self.tokens) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + WORD_END] for s in symbols], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        born = {int(m): r for r, m in reversed(list(enumerate(made)))}
        #: All places of a word's lowest pair may merge in one round only if no product
        #: takes part in an earlier merge.
        self.ordered = all(
            max(born.get(vocab[a], -1), born.get(vocab[b], -1)) < r for r, (a, b) in enumerate(pairs)
        )

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted keys, -1 where the pair is unknown."""
        key = left * self.width + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, place, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            place = np.full(len(symbol), -1)
            inside = np.flatnonzero(word[1:] == word[:-1])
            place[inside] = self.find(symbol[inside], symbol[inside + 1])
            rank = np.where(place >= 0, self.ranks[place], len(self.keys))
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbol)])
            least = np.repeat(least, sizes)
            active = least < len(self.keys)
            if not active.all():
                done.append((word[~active], symbol[~active]))
                word, symbol, rank, least, place = (
                    x[active] for x in (word, symbol, rank, least, place)
                )
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            if self.ordered:
                # Of places side by side (as in "aaa") every other one merges.
                run = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
                start = np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))
                hit = hit[(hit - start) % 2 == 0]
            else:
                hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
            symbol[hit] = self.made[place[hit]]
            left = np.ones(len(symbol), bool)
            left[hit + 1] = False
            word, symbol = word[left], symbol[left]
        word = np.concatenate([w for w, _ in done]) if done else word
        symbol = np.concatenate([s for _, s in done]) if done else symbol
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


def lowered(text: str) -> str:
    """Composed and in lower case, character by character (no final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class LibraryWords:
    """Words as the tokenizers library parts them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.parts = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}

    def of(self, text: str) -> list[str]:
        found = self.parts.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in word).decode("utf-8") for word, _ in found]


@functools.lru_cache(maxsize=4)
def library_words(path: str) -> LibraryWords:
    return LibraryWords(path)


class WordIds:
    """Ids of distinct words, kept in flat arrays from batch to batch."""

    def __init__(self, ids_of_words):
        self.ids_of_words = ids_of_words
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        ids, sizes = self.ids_of_words(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, ids]

    def gather(self, words: list, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as words, ``counts`` words each, with list offsets."""
        if len(self.index) > MEMORY:
            self.clear()
        self.learn(dict.fromkeys(words))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        total = np.r_[0, np.cumsum(sizes)]
        flat = np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[flat], total[np.r_[0, np.cumsum(counts, dtype=np.int64)]]


def _encoder(path: str) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def make():
        merges = load(path)
        find_plain = regex.compile(PIECES).findall
        strange = regex.compile(f"[^{PLAIN}]").search

        def find(part: str) -> list[str]:
            if not part.isascii() and strange(part):
                return library_words(path).of(part)
            return find_plain(lowered(part))

        cut = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")").split

        def ids_of(words: list) -> tuple[np.ndarray, np.ndarray]:
            # A special token is kept as a tuple, which no word of a text can equal.
            plain = [w.encode("utf-8") for w in words if isinstance(w, str)]
            found, sizes = merges.merge(plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            special = np.array([w[0] if isinstance(w, tuple) else -1 for w in words])
            if (special < 0).all():
                return found, sizes
            each = np.ones(len(words), np.int64)
            each[special < 0] = sizes
            out = np.zeros(each.sum(), np.int32)
            ordinary = np.repeat(special < 0, each)
            out[ordinary], out[~ordinary] = found, special[special >= 0]
            return out, each

        words_of = WordIds(ids_of)

        def work(texts: pa.Array) -> list[pa.Array]:
            words, counts = [], []
            for value in texts.to_pylist():
                before = len(words)
                if value and "<|" in value:
                    for part in cut(value):
                        if part in merges.special:
                            words.append((merges.special[part],))
                        else:
                            words += find(part)
                elif value:
                    words += find(value)
                counts.append(len(words) - before)
            flat, offsets = words_of.gather(words, counts)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]

        return work

    return make


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text, an array of integers."""
    return with_columns(docs, text, [(ids, "array<int>")], _encoder(path))


def _decoder(path: str) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def make():
        merges = load(path)
        tokens = pa.array([merges.tokens.get(i) for i in range(merges.width)], pa.string())

        def work(lists: pa.Array) -> list[pa.Array]:
            lists = lists.cast(pa.list_(pa.int64()))
            flat = lists.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, merges.width)), False)
            found = tokens.take(pc.if_else(known, flat, pa.scalar(None, pa.int64())))
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            if found.null_count:
                keep = ~np.asarray(found.is_null())
                counts = np.diff(np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(counts)]])
                found = found.drop_null()
            offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            return [pc.binary_join(pa.ListArray.from_arrays(offsets, found), " ")]

        return work

    return make


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the tokens of its ids, special ones too, joined by a blank."""
    return with_columns(docs, ids, [(text, "string")], _decoder(path))


def encode_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop: str | None = None
) -> DataFrame:
    """``encode``, then ``decode`` of its ids, by the same worker."""

    def make():
        forth, back = _encoder(path)(), _decoder(path)()

        def work(texts: pa.Array) -> list[pa.Array]:
            found = forth(texts)
            return found + back(found[0])

        return work

    return with_columns(docs, text, [(ids, "array<int>"), (decoded, "string")], make, drop=drop)
