"""The pipeline against a plain Python version of its stages, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from callscope.llm import bpe, quality
from callscope.llm.common import keep, ready, released
from callscope.llm.queries import VOCABULARY
from test_llm_pairs import connected, linked, shingles
from test_llm_text import PLAIN

SMALL = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")), "sf0.001")
COLUMNS = corpus_pipeline.COLUMNS


def masked(text):
    spans = sorted(
        (m.start(), m.end()) for pattern, fits in PLAIN.values() for m in pattern.finditer(text) if fits(m)
    )
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def taken(rows):
    """How often the mix takes each document, by sorting each source."""
    sizes, total = defaultdict(int), 0
    for r in rows:
        n = len(r["text"].encode().split())
        sizes[r["source"]] += n
        total += n
    names = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * total
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= share * weight[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    copies = Counter()
    for s in names:
        def place(r):
            n = len(r["text"].encode().split())
            digest = hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()
            bits = n.bit_length()
            band = n if n < 8 else bits * 8 + ((n >> (bits - 4)) & 7)
            return band, digest[:2], n, digest

        each = int(target[s] / sizes[s] * 2**24)
        at = int(hashlib.md5(f"mix:offset:{s}".encode()).hexdigest()[:6], 16)
        for r in sorted((r for r in rows if r["source"] == s), key=place):
            copies[r["doc_id"]] += ((at + each) >> 24) - (at >> 24)
            at += each
    return copies


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and what it made."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(keep(stage(spark, made[-1], SMALL), name))
    return [[r.asDict() for r in df.collect()] for df in made]


def test_stages_equal_plain_python(spark, stages):
    docs, good, single, clean, mixed, tokens = stages
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    machine = quality.train(frame, spark.read.parquet(f"{SMALL}/labels.parquet"))
    fits = {r["doc_id"] for r in quality.score(frame, machine).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in good} == fits
    by_id = {r["doc_id"]: r for r in docs}
    assert all(r == {c: by_id[r["doc_id"]][c] for c in COLUMNS} for r in good)

    sets = {r["doc_id"]: shingles(r["text"]) for r in good}
    roots = connected(list(sets), linked(sets))
    assert {r["doc_id"] for r in single} == {i for i, root in roots.items() if i == root}

    assert {r["doc_id"]: r["text"] for r in clean} == {r["doc_id"]: masked(r["text"]) for r in single}
    assert all(r["n_chars"] == len(r["text"]) for r in clean)

    wanted = taken(clean)
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, n in wanted.items() if n})
    assert all(set(r) == set(COLUMNS) for r in mixed)

    library = Tokenizer.from_file(VOCABULARY)
    text = {r["doc_id"]: r["text"] for r in clean}
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_run_is_all_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r["doc_id"], r["decoded"])
    assert sorted(map(key, rows)) == sorted(map(key, stages[-1]))


def test_stages_keep_odd_rows(spark):
    ready(spark)
    rows = [
        (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", None, None, None),
        (None, None, None, None, None), (3, "", "en", "s", 0), (4, "token = abcdefghijklmnop", "en", "s", 24),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    single = corpus_pipeline.deduplicate(spark, docs, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in single) == ["1", "3", "4", "None"]
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact(spark, docs, SMALL).collect()}
    assert clean[4] == "[secret]" and clean[None] is None and clean[3] == ""
    assert corpus_pipeline.mix(spark, docs.limit(0), SMALL).count() == 0
    assert corpus_pipeline.tokenize(spark, docs, SMALL).count() == len(rows)


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    ready(spark)
    x, y, z, p = (" ".join(f"{w}{n}" for n in range(12)) for w in "xyzp")
    texts = [
        (5, x), (9, x.upper()), (9, y), (7, p), (7, p.upper()),
        (None, z), (None, z), (None, z.upper()), (None, x), (None, None), (None, None),
    ]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    single = corpus_pipeline.deduplicate(spark, docs, SMALL).collect()
    found = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in single)
    assert found == sorted([("5", x), ("9", y), ("7", p), ("None", z), ("None", ""), ("None", "")])


def test_tokens_take_one_worker_a_task(spark):
    """Texts are encoded and decoded by one Python step, with the results of the two steps."""
    ready(spark)
    docs = spark.createDataFrame([(1, "a", "One  two"), (2, None, None), (3, "b", "")], "doc_id bigint, source string, text string")
    got = corpus_pipeline.tokenize(spark, docs, SMALL)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    coded = bpe.decode(bpe.encode(docs, VOCABULARY).drop("text"), VOCABULARY)
    assert got.columns == coded.columns and sorted(got.collect(), key=lambda r: r.doc_id) == sorted(coded.collect(), key=lambda r: r.doc_id)


def test_arrow_batches_are_bounded(spark):
    """Rows of any size come to Python a few MB at a time, and a task ends with its results complete."""
    ready(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    big = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 500000) AS t")
    sizes = big.mapInArrow(released(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs)), "n bigint").collect()
    assert sum(r.n for r in sizes) == 40 and max(r.n for r in sizes) <= 12
