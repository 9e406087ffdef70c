"""Spelling variants: words within one edit of a much more frequent one.

Method: a vocabulary is sorted, and its neighbours' common prefixes cut it into nested
ranges. A word's edit-distance matrix against the list is filled row by row along
those prefixes: the row of a range is computed once and handed on to every
range within, whatever words share it. Only the three cells around the
diagonal are kept (one edit leaves no others), and a range whose prefix has no cell below two is
skipped with all its words. All words of a batch go down the list together, in numpy arrays.

What meets in a list: one edit leaves either the front or the back half of a word alone. With
the shorter of two words having ``c`` letters, an edit within its letters ``s`` to ``e``
leaves ``s`` letters in front and ``c - e`` behind, so words are posted under those
letters; only what lies between is compared. A list of more than ``LIST`` words has its
stretch halved, as often as needed, down to a single letter: of words with the same letters around one
or two there are no more than the alphabet squared. So lists are bounded without leaving a pair out. A pair counts
in the list whose stretch holds the place where its words part, and in no other.

Forms are followed by pointer doubling; as each is five times as frequent as the word, a chain has
some 27 links at most in any corpus, and no circle.

Defined results: runs are maximal in ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; a null text has
none; a null id stands as the empty string before the colon. Repeated rows count like
any other. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import forget, keep, slices

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
TYPO_EVERY = 199

#: Words of a list; a longer one is cut.
LIST = 4096
#: Postings compared at once, and bytes of their letters.
BATCH = 20_000
BATCH_BYTES = 4 << 20
#: Distinct runs remembered per task.
MEMORY = 300_000
#: Runs of more bytes are hashed one by one.
LONG = 64

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LETTERS)


class Runs:
    """Counts runs, with the letter that a document's hash deletes now and then.

    A crc is linear in what it reads: that of ``<id>:<run>`` is the crc of the run, of zeros
    of its length after ``<id>:``, and of zeros alone, all combined by exclusive or. So a
    batch needs one crc per distinct run, and one per document and length.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.cut: Counter = Counter()

    def add(self, ids: list, texts: list) -> None:
        runs, counts = [], []
        for value in texts:
            found = _RUN.findall(value.encode("utf-8").lower()) if value else []
            runs += found
            counts.append(len(found))
        new = [r for r in dict.fromkeys(runs) if r not in self.index]
        self.index.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        self.crc = np.r_[self.crc, np.array([zlib.crc32(r) for r in new], np.uint32)]
        self.size = np.r_[self.size, np.array([len(r) for r in new], np.int64)]
        self.count = np.r_[self.count, np.zeros(len(new), np.int64)]
        at = np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs))
        doc = np.repeat(np.arange(len(texts)), counts)
        heads = [b"%s:" % (b"" if i is None else str(i).encode()) for i in ids]
        hit = self._hash(at, doc, heads) % TYPO_EVERY == 0
        self.count += np.bincount(at[~hit], minlength=len(self.words))
        for run, of in zip(at[hit].tolist(), doc[hit].tolist()):
            self.cut[self._without(self.words[run], heads[of])] += 1

    def _hash(self, at: np.ndarray, doc: np.ndarray, heads: list[bytes]) -> np.ndarray:
        size = self.size[at]
        out = np.zeros(len(at), np.uint32)
        short = size <= LONG
        used = np.unique(size[short])
        column = np.zeros(LONG + 1, np.int64)
        column[used] = np.arange(len(used))
        zeros = [bytes(int(n)) for n in used]
        alone = np.array([zlib.crc32(z) for z in zeros], np.uint32)
        after = np.array([[zlib.crc32(z, start) for z in zeros] for start in map(zlib.crc32, heads)], np.uint32)
        of = column[size[short]]
        out[short] = self.crc[at[short]] ^ after[doc[short], of] ^ alone[of] if short.any() else 0
        for k in np.flatnonzero(~short).tolist():
            out[k] = zlib.crc32(self.words[at[k]], zlib.crc32(heads[doc[k]]))
        return out

    @staticmethod
    def _without(run: bytes, head: bytes) -> bytes:
        letters = run.decode("utf-8")
        at = zlib.crc32(run, zlib.crc32(head)) % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode("utf-8")

    def rows(self) -> pa.RecordBatch:
        counts = Counter(dict(zip(self.words, self.count.tolist()))) + self.cut
        # A run of six letters that lost one is no word.
        kept = [(w.decode("utf-8"), n) for w, n in counts.items()]
        kept = [(w, n) for w, n in kept if len(w) >= MIN_LETTERS]
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
            names=["word", "n"],
        )


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of every word with at least ``MIN_COUNT`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            for part in slices(batch, 1):
                runs.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if len(runs.words) + len(runs.cut) > MEMORY:
                    yield runs.rows()
        yield runs.rows()

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _stretch(c, s, e):
    """The key of the list a word is in, and its letters between."""
    length = F.length("word")
    front, back = F.substring("word", F.lit(1), s), F.substring("word", length - (c - e) + 1, c - e)
    key = F.xxhash64(c, s, e, front, back)
    return key.alias("key"), F.substring("word", s + 1, length - (c - e) - s).alias("middle")


def postings(words: DataFrame, limit: int = LIST) -> DataFrame:
    """``c, s, e, key, middle, word, n``: every list a word is in, none longer than ``limit``
    unless its stretch is a single letter."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("s"), F.floor(F.col("c") / 2).cast("int").alias("e")),
            F.struct(F.floor(F.col("c") / 2).cast("int").alias("s"), F.col("c").alias("e")),
        )
    )
    # The shorter of two words may have all letters of this one, or one fewer; the shortest words are
    # never the longer ones.
    open_ = words.select("word", "n", sizes.alias("c")).where(F.col("c") >= MIN_LETTERS)
    open_ = open_.select("word", "n", "c", halves.alias("h")).select("word", "n", "c", "h.s", "h.e")
    done = []
    while True:
        placed = open_.select("c", "s", "e", *_stretch(F.col("c"), F.col("s"), F.col("e")), "word", "n")
        counts = placed.groupBy("key").agg(
            F.count("*").alias("size"), F.max(F.col("e") - F.col("s")).alias("letters")
        )
        full = keep(counts.where((F.col("size") > limit) & (F.col("letters") > 1)).select("key"), "full")
        if full.isEmpty():
            forget(full)
            done.append(placed)
            break
        # At most one in ``limit`` of the postings, so mostly few; else the planner shuffles.
        done.append(placed.join(full, "key", "left_anti").select(*placed.columns))
        middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        parts = F.explode(
            F.array(
                F.struct(F.col("s"), middle.alias("e")),
                F.struct(middle.alias("s"), F.col("e")),
            )
        )
        open_ = placed.join(full, "key", "left_semi").select("word", "n", "c", parts.alias("h"))
        open_ = keep(open_.select("word", "n", "c", "h.s", "h.e"), "halved")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _matrix(values: list[bytes]) -> np.ndarray:
    """Letters as rows, with zeros behind (all letters have one byte in Latin-1)."""
    width = max(map(len, values), default=0) + 1
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)


def _one_edit(middles: list[bytes], first: np.ndarray, last: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a word of ``asking`` and a word of its list (``first`` to ``last``) whose
    middles are one edit apart; lists are sorted by middle."""
    letters = _matrix(middles)
    width = letters.shape[1]
    size = np.array([len(m) for m in middles])
    padded = np.pad(letters, ((0, 0), (1, 2)))  # the letter before the first is none
    # Letters a word shares with the one before it.
    same = letters[1:] == letters[:-1]
    shared = np.r_[0, np.where(same.all(axis=1), width, same.argmin(axis=1))] if len(letters) else np.zeros(0, int)
    shared[first[asking]] = -1

    word, lo, hi = asking, first[asking], last[asking]
    # Cells before, on and behind the diagonal, for the empty prefix.
    row = np.tile(np.array([2, 0, 1], np.int8), (len(word), 1))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth in range(width):
        if not len(word):
            break
        # Ranges of one longer prefix: cut where neighbours share just so many letters.
        cuts = np.flatnonzero(shared == depth)
        left, right = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi)
        pieces = right - left + 1
        of = np.repeat(np.arange(len(word)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.where(nth == 0, lo[of], cuts[np.minimum(left[of] + nth - 1, max(len(cuts) - 1, 0))] if len(cuts) else lo[of])
        more = nth + 1 < pieces[of]
        end = np.where(more, cuts[np.minimum(left[of] + nth, max(len(cuts) - 1, 0))] if len(cuts) else hi[of], hi[of])
        word, row = word[of], row[of]
        letter = letters[start, depth]

        over = letter == 0  # the words of these ranges end here
        off = size[word] - depth
        cell = np.where(np.abs(off) <= 1, row[np.arange(len(word)), np.clip(off + 1, 0, 2)], 2)
        near = np.flatnonzero(over & (cell == 1))
        found_a.append(word[near])
        found_b.append(start[near])

        go = np.flatnonzero(~over)
        word, lo, hi, row, letter = word[go], start[go], end[go], row[go], letter[go]
        beside = [(padded[word, depth + k] != letter).astype(np.int8) for k in range(3)]
        new = np.empty_like(row)
        new[:, 0] = np.minimum(row[:, 0] + beside[0], row[:, 1] + 1)
        new[:, 1] = np.minimum(np.minimum(row[:, 1] + beside[1], row[:, 2] + 1), new[:, 0] + 1)
        new[:, 2] = np.minimum(row[:, 2] + beside[2], new[:, 1] + 1)
        # Cells beyond the word's letters are none.
        at = depth + np.arange(3)
        new[(at[None, :] > size[word][:, None]) | (at[None, :] < 0)] = 2
        np.minimum(new, 2, out=new)
        alive = new.min(axis=1) <= 1
        word, lo, hi, row = word[alive], lo[alive], hi[alive], new[alive]
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Near words of whole lists, per word: how many, and the most frequent one."""
    c, s, e, key, n = (np.asarray(rows.column(x)) for x in ("c", "s", "e", "key", "n"))
    middles = [m.encode("latin-1") for m in rows.column("middle").to_pylist()]
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    size = np.array([len(w) for w in words])
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[begins, len(key)])
    first, last = np.repeat(begins, lengths), np.repeat(begins + lengths, lengths)
    asking = np.flatnonzero((size == c) & (lengths.repeat(lengths) > 1))
    a, b = _one_edit(middles, first, last, asking)
    # The pair's place is where its words part; it counts in the stretch that holds it.
    if len(a):
        whole = _matrix(words)
        differ = whole[a] != whole[b]
        place = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), c[a]), c[a])
        here = (s[a] <= place) & ((place < e[a]) | (e[a] == c[a]))
        a, b = a[here], b[here]
    # A longer word learns of the shorter one from it.
    longer = size[b] > size[a] if len(a) else np.zeros(0, bool)
    of, other = np.r_[a, b[longer]], np.r_[b, a[longer]]
    text = np.array(words, dtype=object)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], of))
    of, other = of[order], other[order]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    decode = lambda at: [text[k].decode("latin-1") for k in at.tolist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(decode(of[start]), pa.string()),
            pa.array(np.diff(np.r_[start, len(of)]), pa.int64()),
            pa.array(n[other[start]], pa.int64()),
            pa.array(decode(other[start]), pa.string()),
        ],
        names=["word", "near", "best_n", "best"],
    )


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole lists: all rows of a key follow one another."""
    held: list[pa.RecordBatch] = []

    def size() -> tuple[int, int]:
        rows = sum(b.num_rows for b in held)
        return rows, rows * max((int(np.asarray(b.column("c")).max()) + 2 for b in held if b.num_rows), default=0)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, letters = size()
        if rows >= BATCH or letters >= BATCH_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(table["key"])
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if last:
                yield table.slice(0, last).combine_chunks().to_batches()[0]
                held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_words(words: DataFrame, limit: int = LIST) -> DataFrame:
    """``word, n_near, best, best_n`` of every word that has a near one."""
    lists = postings(words, limit).repartition("key").sortWithinPartitions("c", "s", "e", "key", "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _whole_lists(batches):
            yield _compare(lists)

    found = lists.mapInArrow(run, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form (``word, form``)."""
    step = keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = step.select(F.col("word").alias("root"), F.col("root").alias("up"))
        joined = step.join(up, "root", "left")
        if joined.where("up IS NOT NULL").isEmpty():
            return step
        shorter = keep(joined.select("word", F.coalesce("up", "root").alias("root")), "roots")
        forget(step)
        step = shorter


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = keep(vocabulary(docs, id, text), "words")
    near = words.join(near_words(words, limit), "word", "left")
    frequent = F.col("best_n") >= RATIO * F.col("n")
    formed = keep(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best")).alias("form"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
