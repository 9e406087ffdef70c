"""Near duplicates, components, vector searches and page texts against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from callscope.llm import minhash, nndescent, templates, toplists
from callscope.llm.components import components
from callscope.llm.queries import QUERIES


def connected(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(sets):
    return [
        (a, b)
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    chance = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)] + [(7, 7)],
        "random": [(chance.randrange(90), chance.randrange(90)) for _ in range(60)],
        "empty": [],
    }[shape]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    expected = connected(nodes, links)
    roots = {r["node"]: r["root"] for r in found}
    assert set(roots) == nodes and len(found) == len(nodes)
    for a, b in combinations(sorted(nodes), 2):
        assert (roots[a] == roots[b]) == (expected[a] == expected[b])


def test_near_duplicates_of_edited_copies(spark):
    chance = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [chance.choice(words) for _ in range(80)]
        for _ in range(25):  # variants on both sides of the border
            text = list(base)
            for _ in range(chance.randrange(0, 6)):
                text[chance.randrange(len(text))] = chance.choice(words)
            rows.append(" ".join(text))
    rows += [rows[0], rows[0].upper(), "", None, " \n", "one two", "One  two", "one two three", "x " * 9000]
    ids = list(range(len(rows)))
    chance.shuffle(ids)
    frame = spark.createDataFrame(list(zip(ids, rows, ["c"] * len(rows))), "doc_id bigint, text string, class string")
    found = {r["doc_id"]: r for r in minhash.near_duplicates(frame).collect()}
    sets = {i: shingles(t) for i, t in zip(ids, rows)}
    expected = connected(ids, linked(sets))
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "q")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(frame).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [
        ("4", "4"), ("4", "4"), ("9", "9"), ("None", "4"), ("None", "None"),
    ]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_op9_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sets = {i: shingles(t) for i, t in docs.items()}
    expected = connected(list(docs), linked(sets))
    rows = QUERIES["op9_near_duplicates"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def vectors_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}


def test_op10_equals_brute_force(spark, sf_dir):
    whole = {i: np.floor(1024 * v).astype(np.int64) for i, v in vectors_of(spark, sf_dir).items()}
    expected = set()
    for q in (i for i in whole if i % 100 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    found = QUERIES["op10_top_lists"](spark, sf_dir).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == expected


@pytest.mark.parametrize("width", [1, 3, 40])
def test_top_lists_with_ties_and_zeros(width):
    noise = np.random.default_rng(width)
    rows = noise.integers(-3, 4, (700, width))
    lists = toplists.SortedLists(np.arange(700), rows)
    for query_id, query in enumerate([*rows[:20], np.zeros(width, np.int64)]):
        ids, scores = lists.top(query_id, query, 10)
        best = sorted((-int(rows[i] @ query), i) for i in range(700) if i != query_id)[:10]
        assert [(-s, i) for s, i in zip(scores, ids)] == best


def test_top_lists_of_huge_numbers_and_floors():
    chance = np.random.default_rng(4)
    rows = chance.integers(-(2**61), 2**61, (300, 3))
    lists = toplists.SortedLists(np.arange(300), rows)
    clipped = lambda x: max(-(2**63), min(2**63 - 1, x))
    for query_id in (0, 7):
        ids, scores = lists.top(query_id, rows[query_id], 5)
        exact = [(clipped(sum(int(a) * int(b) for a, b in zip(r, rows[query_id]))), -i) for i, r in enumerate(rows) if i != query_id]
        assert [(s, -i) for s, i in zip(scores.tolist(), ids.tolist())] == sorted(exact, reverse=True)[:5]
    rows = chance.integers(-1000, 1000, (500, 8))
    lists = toplists.SortedLists(np.arange(500), rows)
    ids, scores = lists.top(3, rows[3], 10)
    floored = lists.best(np.array([3]), rows[3:4], 10, [int(scores[4])])[0]
    assert floored[1].tolist()[:5] == scores.tolist()[:5] and (floored[1] >= scores[4]).sum() >= 5
    assert len(lists.best(np.array([3]), rows[3:4], 10, [10**12])[0][0]) == 0


ODD = [
    (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [None, 1.0]),
    (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, []), (200, [-1.0, 0.25]),
]


def odd_table(spark, tmp_path, rows=ODD):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_searches_of_odd_vectors(spark, tmp_path):
    folder = odd_table(spark, tmp_path)
    near = [tuple(r) for r in QUERIES["op2_nn_descent"](spark, folder).orderBy("query_id", "rank").collect()]
    assert [(q, n, v) for q, n, v, _ in near] == [
        (100, 1, 1), (100, 2, 2), (100, 3, 3), (100, 4, 200), (200, 1, 3), (200, 2, 1), (200, 3, 2), (200, 4, 100),
    ]
    top = [tuple(r) for r in QUERIES["op10_top_lists"](spark, folder).orderBy("query_id", "rank").collect()]
    assert top[:4] == [(100, 1, 1, 1024**2), (100, 2, 2, 1024**2), (100, 3, 3, 512 * 1024), (100, 4, 8, 0)]


def test_searches_of_no_vectors(spark, tmp_path):
    folder = odd_table(spark, tmp_path, [])
    assert QUERIES["op2_nn_descent"](spark, folder).count() == 0
    assert QUERIES["op10_top_lists"](spark, folder).count() == 0


def test_op2_recall(spark, sf_dir):
    rows = vectors_of(spark, sf_dir)
    ids = np.array(sorted(rows))
    whole = np.stack([rows[i] for i in ids])
    hits = total = 0
    found = {}
    for r in QUERIES["op2_nn_descent"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in ids[ids % 100 == 0]:
        apart = np.sqrt(((whole - rows[q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, apart))] if i != q][:10]
        hits += len(set(best) & set(found[q]))
        total += len(best)
        assert all(s == pytest.approx(np.sqrt(((rows[v] - rows[q]) ** 2).sum()), abs=1e-12) for v, s in found[q].items())
    assert hits / total >= 0.9


def op2_recall_of(spark, tmp_path, whole, more=()):
    """Recall at 10 of op2 on the rows of a matrix, whose ids are their numbers."""
    rows = [(i, v.tolist()) for i, v in enumerate(whole)] + list(more)
    folder = odd_table(spark, tmp_path, rows)
    found = {}
    for r in QUERIES["op2_nn_descent"](spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in range(0, len(whole), 100):
        apart = ((whole.astype(float) - whole[q]) ** 2).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(len(whole)), apart)) if i != q][:10]
        hits += len(found.get(q, set()) & {int(i) for i in best})
        total += len(best)
    assert set(found) <= set(range(0, len(whole), 100))
    return hits / total


def test_op2_with_one_long_vector_and_other_widths(spark, tmp_path):
    whole = np.random.default_rng(1).normal(size=(1500, 6)).astype(np.float32)
    whole[7] *= 1e8
    odd = [(5000, [1.0, 2.0]), (5001, [0.5] * 7), (5100, [0.25] * 12)]
    assert op2_recall_of(spark, tmp_path, whole, odd) >= 0.9


def test_op2_enters_tight_groups(spark, tmp_path):
    noise = np.random.default_rng(2)
    centres = 10 * noise.normal(size=(50, 8))
    # Each group of 40 near copies lists only itself; there are far fewer landmarks than groups.
    whole = np.repeat(centres, 40, axis=0) + 1e-3 * noise.normal(size=(2000, 8))
    assert op2_recall_of(spark, tmp_path, whole.astype(np.float32)) >= 0.95


def test_op2_with_more_landmarks_and_entries_than_travel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nndescent, "LANDMARKS", 6)
    monkeypatch.setattr(nndescent, "SPREAD", 64)
    whole = np.random.default_rng(3).normal(size=(1500, 6)).astype(np.float32)
    assert op2_recall_of(spark, tmp_path, whole) >= 0.9


def test_op2_every_node_can_be_reached(spark):
    whole = np.random.default_rng(4).normal(size=(800, 24)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "vec_id bigint, vector array<float>")
    graph = nndescent.build(vectors)
    onward = {}
    for r in graph.links.collect():
        onward.setdefault(r["node"], []).append(r["other"])
    seen = set(graph.entries.ids.tolist())
    todo = list(seen)
    while todo:
        new = set(onward.get(todo.pop(), ())) - seen
        seen |= new
        todo += new
    assert seen == set(range(800))


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>A &amp; B</h1></header><p><b>First&nbsp;  one<br>line<p>Second &lt;x&gt;</p>
<div class="share"><a>Share</a></div><ul><li>item<li>more</ul><section class="comments"><article class="comment">No!</article></section>
</article><footer>(c)</footer>"""


def test_main_text_of_one_page():
    assert templates.main_text(PAGE) == "A & B\nFirst one line\nSecond <x>\nitem\nmore"
    assert templates.main_text(None) == templates.main_text("") == ""
    assert templates.main_text("no <b>markup</b>") == "no markup"
    assert templates.main_text("<p>a</p><p>b &am") == "a\nb &am"
    assert templates.main_text("<article><p>cut</p><p") == "cut"
    assert templates.main_text("<div>" * 3000 + "deep") == "deep"
    assert templates.main_text("<a '" * 2000) is not None


def test_role_main_alone_marks_the_article():
    page = '<body><div>menu</div><div role="main" class="no-sidebar widget"><h1>A</h1><p>text</p></div><p>end</p></body>'
    assert templates.main_text(page) == "A\ntext"
    assert templates.main_text("<a><div role=main><p>one</a> two</p></div><p>end</p>") == "one two"
    assert templates.main_text("<form role=main>all</form>rest") == "all"


def test_recurring_subtrees_go(spark):
    def page(n, host):
        box = "<div><b>Read our magazine</b></div>" if host == "a" else ""
        return f"<body>{box}<p>same words</p><div>text {n}</div><table><tr><td>{n}</table></body>"

    rows = [(n, f"https://{'A' if n % 2 else 'b'}.org/{n}", page(n, "a" if n % 2 else "b"), "x") for n in range(40)]
    rows += [(90, None, None, "x"), (91, "", "<p>alone</p>", "x"), (91, "", "<p>alone</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = templates.extract(frame)
    assert found.columns == ["page_id", "url", "host", "text"]
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts[1] == "same words\ntext 1\n1" and texts[2] == "same words\ntext 2\n2"
    assert texts[90] == "" and texts[91] == "alone"
    assert found.count() == len(rows)
    assert templates.extract(frame.limit(0)).count() == 0


def test_templates_of_small_and_of_hot_hosts(spark):
    def page(n, box="", marked=True):
        text = f"<p>text {n}</p>"
        return f"<body>{box}{f'<article>{text}</article>' if marked else text}</body>"

    box = "<section>The box of a section</section>"
    # 12 of 200 pages, far below the share; the box stands within the article.
    rows = [(n, "https://hot.org/", f"<article>{box if n < 12 else ''}<p>text {n}</p></article>") for n in range(200)]
    rows += [(300 + n, "https://small.org/", page(n, "<h2>Our site</h2><div>Menu of all</div>", False)) for n in range(4)]
    # Copies of one page are one page, and headings of an article stay.
    rows += [(400 + n, "https://copies.org/", "<div><h2>Same</h2>all of it</div>") for n in range(12)]
    rows += [(500 + n, "https://heads.org/", f"<article><h2>History</h2><p>text {n}</p></article>") for n in range(12)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r["page_id"]: r["text"] for r in templates.extract(frame).collect()}
    assert all(texts[n] == f"text {n}" for n in range(200))
    assert all(texts[300 + n] == f"text {n}" for n in range(4))
    assert all(texts[400 + n] == "Same\nall of it" for n in range(12))
    assert all(texts[500 + n] == f"History\ntext {n}" for n in range(12))


def test_pairs_of_a_join_come_in_small_batches():
    """What many groups find is not held at once."""
    chance = np.random.default_rng(2)
    n, groups = 40, 200
    each = {
        "others": [list(range(g * n, g * n + n)) for g in range(groups)],
        "worst": [[float("inf")] * n] * groups,
        "fresh": [[True] * n] * groups,
        "vectors": [[chance.normal(size=4).astype(np.float32).tobytes() for _ in range(n)] for _ in range(groups)],
    }
    found = list(nndescent._compare([pa.RecordBatch.from_pydict(each)]))
    assert sum(b.num_rows for b in found) == groups * n * (n - 1)
    assert max(b.num_rows for b in found) < nndescent.FOUND + n * n
