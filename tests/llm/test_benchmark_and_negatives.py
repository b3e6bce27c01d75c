"""Decontamination, ranked lexical search and hard negatives against plain versions."""

import math
import re

import numpy as np
import pytest

from tillwise.llm import decontam, lexical, negatives
from tillwise.llm.decontam import contamination, decontaminated
from tillwise.llm.lexical import ranked_search
from tillwise.llm.negatives import hard_negatives, spanning_tree

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=repr)


def small_corpus(rng, n_docs=60, n_items=12):
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Ünï", "A1", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary, n)).replace("w3 ", "W3, ")
    items = [(str(i), text(rng.integers(1, 9))) for i in range(n_items)]
    docs = [(i, text(rng.integers(0, 40))) for i in range(n_docs)]
    docs += [(100 + i, f"{text(3)}; {items[i][1].upper() if i % 2 else items[i][1]} {text(4)}") for i in range(n_items)]
    return docs, items


@pytest.mark.parametrize("max_bytes", [1 << 20, 700])
def test_contamination(spark, max_bytes):
    docs, items = small_corpus(np.random.default_rng(1))
    docs += [(None, items[0][1]), (7, items[1][1]), (500, None), (501, ""), (502, " .,; ")]
    items += [("0", items[1][1]), (None, "w1 w2 w3 w4 w5"), ("90", None), ("91", ""), ("92", "--")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, found string, items int").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id string, text string, window string")
    rows = contamination(frame, bench, width=4, max_bytes=max_bytes).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=repr)
    expected = plain_contamination(docs, items, 4)
    assert got == expected
    assert 0 < sum(r[2] > 0 for r in expected) < len(expected)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    clean = decontaminated(frame, bench, width=4, max_bytes=max_bytes)
    assert clean.schema == frame.schema
    keep = sorted((i, "" if t is None else t) for (i, t), r in zip(docs, [plain_contamination([d], items, 4)[0] for d in docs]) if r[2] == 0)
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == keep
    cut = decontaminated(frame, bench, remove="spans", width=4, max_bytes=max_bytes).collect()
    hits = {(r[0], r[1]): r[2] for r in expected}
    assert len(cut) == len(docs) and all(r["found"] == "x" and r["items"] == 1 for r in cut)
    before = sorted(n - h for (_, n), h in hits.items())
    assert sorted({(r["doc_id"], r["text"]): len(plain_words(r["text"])) for r in cut}.values())[-5:] == before[-5:]


def test_spans_are_cut_whole(spark):
    docs = spark.createDataFrame([(1, "Keep é this. One, TWO three! four; and  that"), (2, "one two three"), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id int, text string")
    rows = {r["doc_id"]: r["text"] for r in decontaminated(docs, bench, remove="spans").collect()}
    assert rows == {1: "Keep é this. ; and  that", 2: "one two three", 3: None}
    with pytest.raises(ValueError):
        decontaminated(docs, bench, remove="words")


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    """Known words in another order, or a window with a foreign word, are no hits whatever their hashes."""
    table = decontam.HashSet(["a", "b"], [b"x y z", b"z y x"])
    for text, expected in [(b"x y z", 1), (b"y x z", 0), (b"x y q z", 0), (b"x x y z z y x", 2)]:
        ids = table.numbers(text.split())
        assert sum(len(p) for _, p, _, _ in table.hits(ids)) == expected
    zero = lambda values: np.where(np.arange(len(values[0])) >= 0, np.uint64(5), np.uint64(5))
    table = decontam.HashSet(["a"], [b"x y z"])
    table.lengths = [(n, np.array([5], np.uint64), rows, names, np.ones(1 << 20, bool)) for n, _, rows, names, _ in table.lengths]
    table.rolled = zero
    assert [p.tolist() for _, p, _, _ in table.hits(table.numbers(b"y x y z x".split()))] == [[1]]


def test_contamination_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "beta gamma delta epsilon"), (2, " ".join(f"w{i}" for i in range(40, 60)))], "item_id int, text string")
    rows = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in contamination(odd_docs, bench, width=10).collect()}
    assert rows[(1, 6)] == rows[(None, 6)] == 4 and rows[(3, 0)] == rows[(4, 0)] == 0
    assert rows[(6, 60_000)] == 20 * math.ceil((60_000 - 60) / 977)
    assert contamination(no_docs, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in contamination(odd_docs, bench.limit(0)).collect())
    assert decontaminated(odd_docs, bench).count() == odd_docs.count() - 5


def plain_search(docs, items, k):
    counted = [(i, plain_words(t)) for i, t in docs]
    full = [w for _, w in counted if w]
    n_docs, length, df = len(full), sum(map(len, full)), {}
    for w in full:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(plain_words(t))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, w in counted:
            score = 0
            for t in terms & set(w):
                tf, m = w.count(t), 100 - 90 + (90 * len(w) * n_docs) // length
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,width,max_bytes", [(10, 1024, 1 << 20), (3, 8, 300), (1, 1, 1 << 20)])
def test_ranked_search(spark, monkeypatch, k, width, max_bytes):
    monkeypatch.setattr(lexical, "WIDTH", width)
    docs, items = small_corpus(np.random.default_rng(k), 300, 20)
    docs += [(None, items[0][1]), (7, items[1][1]), (500, None), (501, ""), (502, " .,; ")]
    items += [("0", items[1][1]), (None, "w1 w2"), ("90", None), ("91", ""), ("92", "unknown words")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, term int")
    got = ranked_search(frame, bench, k=k, max_bytes=max_bytes)
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items, k)


def test_sketches_bound_and_prune():
    """A query's coordinates never add up to less than its score; the search rescores few of many documents."""
    rng = np.random.default_rng(5)
    doc, term = np.nonzero(rng.random((50, 400)) < 0.2)
    impact, slots = rng.integers(1, 10**9, len(doc)), rng.integers(0, lexical.WIDTH, 400)
    sketch = lexical.sketched(doc, slots[term], impact, 50)
    for _ in range(20):
        own = rng.choice(400, 30, replace=False)
        score = np.bincount(doc, np.where(np.isin(term, own), impact, 0), 50)
        assert (sketch[slots[own]].sum(axis=0) >= score).all()


def test_ranked_search_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "beta w7 one"), (2, None)], "item_id int, text string")
    assert ranked_search(no_docs, bench).collect() == []
    assert ranked_search(odd_docs, bench.limit(0)).collect() == []
    rows = [tuple(r) for r in ranked_search(odd_docs, bench).collect()]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(rows) == plain_search(docs, [(1, "beta w7 one")], 10)
    assert {r[2] for r in rows} == {1, 2, 6, 7, 9} and sorted(r[1] for r in rows) == list(range(1, 7))


def plain_negatives(rows, anchors, k_pos, k_neg, percent=(80, 100)):
    usable = [
        (i, y, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    top = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b))))
    out = []
    for i, y, v in usable:
        if i in anchors:
            same = sorted((-top(v, w), j) for j, z, w in usable if z == y and j != i and len(w) == len(v))[:k_pos]
            other = sorted((-top(v, w), j) for j, z, w in usable if z != y and len(w) == len(v))
            for s, j in same:
                fit = [(m, n) for m, n in other if percent[0] * -s <= 100 * -m <= percent[1] * -s][:k_neg]
                out += [(i, j, r, n, -s, -m) for r, (m, n) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims,spread", [(16, 0.2), (4, 1.0), (1, 1.0)])
def test_hard_negatives(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(5, dims))
    rows = [(i, i % 5, [float(x) for x in np.round(centres[i * 7 % 5 if i % 3 else i % 5] + spread * rng.normal(size=dims), 1)]) for i in range(700)]
    rows += [(1000, 1, None), (1010, 1, [None] * dims), (1020, 1, [float("nan")] * dims), (1030, 1, [float("inf")] * dims), (None, 1, [1.0] * dims)]
    rows += [(1040, None, [1.0] * dims), (1050, 1, [1.0] * (dims + 1)), (1060, 2, [1.0] * (dims + 1)), (1070, 1, [1.0] * (dims + 1)), (1080, 1, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, rank int").repartition(5)
    got = hard_negatives(frame, frame.where("vec_id % 10 = 0"))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, set(range(0, 2000, 10)), 5, 5)


def test_hard_negatives_of_large_values_and_repeats(spark):
    rows = [(0, 1, [3e9, 1.0]), (1, 1, [3e9, 1.0]), (2, 2, [2.9e9, 2.0]), (3, 2, [3e38, 0.0]), (4, 2, [-3e9, 0.0]), (5, 1, [1e9, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted(map(tuple, hard_negatives(frame, frame.where("vec_id = 0")).collect()))
    assert got == plain_negatives(rows, {0}, 5, 5)
    assert hard_negatives(frame.limit(0), frame.limit(0)).collect() == []
    assert hard_negatives(frame, frame.limit(0)).collect() == []
    repeated = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [1.0, 0.0])]
    again = spark.createDataFrame(repeated, "vec_id long, label int, embedding array<float>")
    rows = sorted(map(tuple, hard_negatives(again, again.where("vec_id = 0")).collect()))
    assert [r[:4] for r in rows] == [(0, 1, 1, 3), (0, 1, 2, 2), (0, 1, 3, 2)]


def test_bounds_hold_and_save_work():
    """Close anchors: most candidates are never rescored, and the windows hold what a full product gives."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(32, 4000)))
    a = np.floor(256 * (rng.normal(size=(32, 1)) + 0.02 * rng.normal(size=(32, 40))))
    tree = spanning_tree(a)
    assert [p for _, p, _ in tree].count(-1) == 1 and {i for i, _, _ in tree} == set(range(40))
    place = {i: n for n, (i, _, _) in enumerate(tree)}
    assert all(p < 0 or place[p] < place[i] for i, p, _ in tree)
    windows = [[negatives.Window(-negatives.LONG, negatives.LONG, 5)] for _ in range(40)]
    ids = np.arange(4000)
    rescored = 0
    for low in range(0, 4000, 500):
        rescored += negatives.walk(tree, a, x[:, low : low + 500], lambda i: np.ones(500, bool), windows, ids[low : low + 500])
    for i, (w,) in enumerate(windows):
        assert w.rows == sorted(zip((-(a[:, i] @ x)).astype(int).tolist(), ids.tolist()))[:5]
    assert rescored < 0.5 * 40 * 4000
