"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillwise.llm.exact import exact_groups, without_copies
from tillwise.llm.graphs import components
from tillwise.llm.queries import QUERIES
from tillwise.llm.simhash import near_groups, near_links, spanning_links, without_near
from tillwise.llm.suffixes import without_earlier


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def test_exact_groups_of_odd_rows(odd_docs):
    rows = exact_groups(odd_docs, first_block=4, growth=3).collect()
    assert len(rows) == 11
    by_text = defaultdict(list)
    for r in rows:
        by_text[r["text"] or ""].append(r)
    for group in by_text.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {max(ids)}
        assert {r["group_size"] for r in group} == {len(group)}
        assert [r["doc_id"] for r in group if r["kept"]] == [max(ids)]
    assert rows[0].asDict().keys() >= {"rank", "keep_text"}


def test_exact_groups_tell_texts_with_common_beginnings_apart(spark):
    texts = ["a" * n for n in range(40)] + ["a" * 39 + "b", "a" * 39 + "é", "a" * 20, "a" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_groups(docs, first_block=2, growth=2).collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}


def test_exact_groups_of_nothing(no_docs):
    assert exact_groups(no_docs).collect() == []
    assert without_copies(no_docs).collect() == []


def test_exact_groups_with_clashing_names(spark):
    rows = [(1, "a", 8, 9, "x", 1, 2), (2, "a", 10, 11, "y", 3, 4), (3, "b" * 900, 12, 13, "z", 5, 6), (4, "b" * 900, 14, 15, "z", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_size int, kept int, KEEP_ID string, c0 int, row int")
    kept = without_copies(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[3]]
    out = exact_groups(docs)
    assert out.columns == ["doc_id", "text", "c0", "row", "keep_id", "group_size", "kept"]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["c0"], r["row"]) for r in out.collect()) == [
        (1, 2, 2, False, 1, 2), (2, 2, 2, True, 3, 4), (3, 4, 2, False, 5, 6), (4, 4, 2, True, 5, 6)
    ]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    links += [(7, 7), (500, None)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if b is not None and a != b]
    nodes = {n for pair in real for n in pair}
    assert {r["node"]: r["component"] for r in got} == plain_components(nodes, real)
    assert len(got) == len(nodes)


def test_near_groups_match_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = plain_components(prints, links)
    got = QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {
        i: (prints[i], expected[i]) for i in prints
    }
    assert len(links) > 0


@pytest.mark.parametrize("limit", [10**6, 40])
def test_links_of_fingerprints_near_each_other(spark, limit):
    """Clusters of many fingerprints within a few bits, also with cells dealt in chunks."""
    rng = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values = sorted(values)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    got = near_links(spark.createDataFrame(signed, "fp long"), cell_limit=limit).collect()
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in got]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    real = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    assert plain_components(values, links) == plain_components(values, real)


def test_spanning_links_are_few():
    values = np.array([(1 << i) for i in range(60)], np.uint64)
    a, b = spanning_links(values, values[:0], block=64)
    assert len(a) == 59


def test_near_groups_of_odd_rows(odd_docs):
    rows = near_groups(odd_docs).collect()
    assert len(rows) == 11
    zero = {r["doc_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {3, 4, 5}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, None)} == {1}
    kept = without_near(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "6", "8", "9", "9", "None"])


def test_near_groups_of_nothing(no_docs):
    assert near_groups(no_docs).collect() == []


def plain_cut(texts, length):
    """(kept bytes, spans) per document, in the order given."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((kept, spans, int(gone.sum())))
    return out


@pytest.mark.parametrize("length,limit", [(100, 50_000), (100, 1), (64, 50_000)])
def test_earlier_passages(spark, length, limit):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [None, "", "short", "x" * 700, "xy" * 300, "x" * 650]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            low = rng.randrange(len(p) // 2)
            parts += [p[low : low + rng.randrange(40, 260)], word()]
        texts.append(" ".join(parts))
    texts += texts[6:10]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = {r["doc_id"]: r for r in without_earlier(docs, length=length, group_limit=limit).collect()}
    for i, (kept, spans, removed) in enumerate(plain_cut(texts, length)):
        assert bytes(got[i]["kept"]) == kept, i
        assert (got[i]["n_spans"], got[i]["n_removed"], got[i]["n_bytes"]) == (spans, removed, len((texts[i] or "").encode()))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_earlier_passages_of_odd_rows(odd_docs, no_docs):
    rows = without_earlier(odd_docs).collect()
    assert len(rows) == 11
    assert {r["doc_id"]: r["n_removed"] for r in rows}[1] == 0
    long = {r["doc_id"]: r for r in rows if r["doc_id"] in (6, 7)}
    assert long[6]["n_removed"] > 0 and long[7]["n_bytes"] - long[7]["n_removed"] < 100
    assert without_earlier(no_docs).collect() == []


def test_queries_keep_every_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = QUERIES["op8_exact_dedup"](spark, sf_dir)
    assert out.count() == n and out.where(F.col("kept") != (F.col("doc_id") == F.col("keep_id"))).isEmpty()
