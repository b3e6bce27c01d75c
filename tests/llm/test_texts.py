"""Packing, toxicity, licenses and mixing against plain rules."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwise.llm import mixing, toxicity
from tillwise.llm.licenses import license_scan
from tillwise.llm.packing import ChunkTokenizer, pack_documents
from tillwise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def check_pieces(rows, texts, length):
    """Each id in exactly one piece, sequences without gaps and within their length."""
    tokenizer = plain_tokenizer()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return sum(r["length"] for r in rows) / (len(by_sequence) * length)


def test_packing_of_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_pieces(QUERIES["op10_packing"](spark, sf_dir).collect(), texts, 2048) > 0.97


def test_packing_merges_windows_of_many_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pack_documents(docs.repartition(23), PATH, length=512, windows=4, fan_in=3).collect()
    assert check_pieces(rows, texts, 512) > 0.97


def test_packing_of_odd_rows(odd_docs, no_docs):
    once = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(pack_documents(once, PATH, length=256).collect(), {r["doc_id"]: r["text"] for r in once.collect()}, 256)
    rows = pack_documents(odd_docs, PATH).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 9) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 9)
    assert any(r["doc_id"] is None for r in rows)
    assert pack_documents(no_docs, PATH).collect() == []


def test_chunks_give_the_tokenizers_ids():
    fast, plain = ChunkTokenizer(PATH), plain_tokenizer()
    fast.compared = 4
    for text in ["", " ", "  a  b ", "a \n b", "it's  'll\t x", "a   b\n\n  c ", "é　  x  ", "<|endoftext|> a", "\0 a \0b", " " * 70 + "x", "a\x1c b \x1d c"]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_index_finds_the_nearest_exactly():
    rng = np.random.default_rng(2)
    chance = 1 / np.arange(1, 61)  # frequent and rare terms
    rows = []
    for i in range(700):
        terms = np.sort(rng.choice(60, rng.integers(1, 12), replace=False, p=chance / chance.sum()))
        w = rng.random(len(terms))
        rows.append((terms, w / np.sqrt((w * w).sum())))
    rows += rows[:20]  # ties
    ids = rng.permutation(720)
    sizes = [len(t) for t, _ in rows]
    index = toxicity.Index(720, 60, np.repeat(np.arange(720), sizes), np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows]), ids)
    assert (index.column >= 0).any() and (index.column < 0).any()
    dense = np.zeros((720, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for n, (t, w) in enumerate(rows[::13]):
        without = int(ids[13 * n]) if n % 2 else None
        cosine = dense[:, t] @ w
        expected = sorted((-round(c, 9), i) for c, i in zip(cosine.tolist(), ids.tolist()) if i != without and c > 0)[:15]
        near, found = index.nearest(t, w, 15, without)
        assert sorted((-round(c, 9), i) for c, i in zip(found.tolist(), index.ids[near].tolist())) == expected
        assert all(found[i] >= found[i + 1] for i in range(len(found) - 1))
    assert index.completed < 55 * 720
    none = toxicity.Index(0, 60, *(np.empty(0, t) for t in (int, int, float)), [])
    assert len(none.nearest(np.array([3]), np.array([1.0]), 5)[0]) == 0


def plain_terms(text):
    counts = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)})))
    terms = Counter()
    for w, n in counts.items():
        terms["=" + w] += n
        for k in (3, 4, 5, 6, 7):
            if len(w) >= k:
                terms["^" + w[:k]] += n
    return {**terms, **{f"{m}{t}": 1 for t, n in terms.items() for m in (2, 3) if t[0] == "^" and n >= m}}


def plain_scores(texts, labels):
    """Scores by the definition: every labelled text is an example, every cosine is computed."""
    learnt = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 and i in texts}
    terms = {i: plain_terms(t or "") for i, t in texts.items()}
    total, sizes = len(texts), Counter(learnt.values())
    df, seen = Counter(t for own in terms.values() for t in own), Counter((t, y) for i, y in learnt.items() for t in terms[i])
    marks = set()
    for t in {t for t, _ in seen}:
        p1, p0 = (seen[t, 1] + 0.5) / (sizes[1] + 1), (seen[t, 0] + 0.5) / (sizes[0] + 1)
        pooled = (seen[t, 1] + seen[t, 0] + 1) / (sizes[0] + sizes[1] + 2)
        z = (p1 - p0) / (pooled * (1 - pooled) * (1 / (sizes[0] + 1) + 1 / (sizes[1] + 1))) ** 0.5
        if seen[t, 1] >= 5 and z >= 4 and p1 / p0 >= 3:
            marks.add(t)
    known = {t for i in learnt for t in terms[i] if t[0] == "="} | marks

    def vector(own):
        idf = lambda t: np.log((1 + total) / (1 + df[t])) + 1 if t in known else np.log((1 + total) / 2) + 1
        full = {t: (1 + np.log(n)) * idf(t) * (1 if t in marks else 0.03) for t, n in own.items() if t[0] == "=" or t in marks}
        length = sum(w * w for w in full.values()) ** 0.5
        return {t: w / length for t, w in full.items() if t in known}

    vectors = {i: vector(t) for i, t in terms.items()}
    per_class = {y: list(labels[i] for i in labels if zlib.crc32(str(i).encode()) % 5).count(y) / max(1, sum(1 for i in learnt if learnt[i] == y and terms[i])) for y in (0, 1)}
    bare = {y: per_class[y] * (0.5 + sum(1 for i in learnt if learnt[i] == y and terms[i] and not terms[i].keys() & marks)) for y in (0, 1)}
    out, base = {}, bare[1] / sum(bare.values())
    for i, own in vectors.items():
        cosines = [(-sum(w * vectors[j].get(t, 0) for t, w in own.items()), j) for j in learnt if j != i]
        votes = [(per_class[learnt[j]] / max(per_class.values()) * -c / (1.05 + max(c, -1.0)), learnt[j]) for c, j in sorted(cosines)[:15] if c < 0]
        out[i] = (sum(v for v, y in votes if y) + 0.25 * base) / (sum(v for v, _ in votes) + 0.25)
    return out, marks


def test_scores_match_all_cosines(spark):
    rng = np.random.default_rng(9)
    texts, labels = {}, {}
    for i in range(260):
        body = [f"w{x}" for x in rng.integers(0, 150, rng.integers(3, 60))]
        if i % 4 == 0:
            body[1:1] = rng.choice(["vile", "vileness", "scum", "réeuxa", "réeuxb"], rng.integers(1, 4)).tolist()
        texts[i] = " ".join(body).replace("w7 ", "W7, ")
        if i % 9 != 5:
            labels[i] = int(i % 4 == 0)
    texts |= {300: "", 301: None, 302: texts[0], 303: "unheard of", 304: texts[3]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, frame).collect()}
    expected, marks = plain_scores(texts, labels)
    assert {"=vile", "^vil", "^réeux"} <= marks
    assert {i: round(r["score"], 6) for i, r in rows.items()} == {i: round(float(v), 6) for i, v in expected.items()}
    assert rows[302]["neighbours"][0] == 0 and 0 not in rows[0]["neighbours"]  # an example does not vote on itself


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = QUERIES["op2_toxicity"](spark, sf).join(labels, "doc_id").select("held_out", "score", "toxic").collect()
    for held in (True, False):  # no label has a vote on its own document, so both folds are fair
        own = [(r["score"], r["toxic"]) for r in rows if r["held_out"] == held]
        toxic = [s for s, y in own if y]
        assert len(toxic) > 90 and sum(s >= 0.5 for s in toxic) / len(toxic) >= 0.9
        assert sum(s >= 0.5 for s, y in own if not y) <= 0.01 * len(own)
        assert sum((s - y) ** 2 for s, y in own) / len(own) < 0.02
        # Calibration: in each third of the range, scores average near the share of toxic labels.
        for low, high in ((0, 1 / 3), (2 / 3, 1.01)):
            part = [(s, y) for s, y in own if low <= s < high]
            assert abs(np.mean([s for s, _ in part]) - np.mean([y for _, y in part])) < 0.1
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    words = spark.createDataFrame([(i, "you vile creature" if i % 2 else "a fine day out", None) for i in range(100, 180)], "doc_id long, text string, lang string")
    docs = words.unionByName(odd_docs.select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 180)] + [(3, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 91
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if (r["doc_id"] or 0) >= 100)
    assert all(r["predicted"] == 0 for r in rows if (r["doc_id"] or 0) < 100)
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 51
    assert toxicity.toxicity_scores(no_docs, labels).collect() == []
    unlearnt = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlearnt} == {0.0}


def test_texts_without_marks_are_searched(spark):
    """Neighbours come from all words: a text's copy among the examples is its nearest, at cosine one."""
    rng = np.random.default_rng(6)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 400, 30)) for _ in range(120)]
    learnt = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5][:120]
    held = [i for i in range(1000) if not zlib.crc32(str(i).encode()) % 5][:2]
    texts = dict(zip(learnt, plain)) | dict(zip(held, (plain[7], "unheard of")))
    toxic = {i: int(k % 10 == 7) for k, i in enumerate(learnt)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    copy = rows[held[0]]
    assert copy["neighbours"][0] == learnt[7] and abs(copy["cosines"][0] - 1) < 1e-9
    assert rows[held[1]]["neighbours"] == [] and 0.05 < rows[held[1]]["score"] < 0.15


def test_the_whole_text_counts(spark):
    """One slur among thousands of unknown words is less like a short toxic text than the slur alone."""
    texts = {i: "you vile creature" if i % 2 else "a fine day out" for i in range(100, 180)}
    texts |= {1: "vile", 2: "vile " + " ".join(f"u{i}" for i in range(5000)), 3: " ".join(f"u{i}" for i in range(5000)) + " vile"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 180)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert rows[1]["cosines"][0] > 2 * rows[2]["cosines"][0] > 0 and rows[1]["score"] > rows[2]["score"]
    assert rows[2]["cosines"] == rows[3]["cosines"]


def test_all_marks_are_kept(spark):
    """A word in a twentieth of the toxic texts and in no other stays a mark when another word is in all of them."""
    texts = [f"slur and {'vile' if i % 40 == 1 else 'thing'} n{i}" if i % 2 else f"fine thing n{i}" for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, label int")
    vocabulary = toxicity.fit(docs, labelled).vocabulary
    assert all(vocabulary.relevance[vocabulary.words[w]] == 1 for w in (b"slur", b"vile"))
    assert vocabulary.relevance[vocabulary.words[b"fine"]] == toxicity.NEUTRAL


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    learnt = {r["doc_id"] for r in toxicity.labelled_ids(labels).collect()}
    assert learnt == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


def test_license_places(spark, odd_docs, no_docs):
    texts = [
        "All rights reserved. ALL-RIGHTS reserved; all rights",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the newer MIT License",
        "cc",
        "cc by cc by é ccé by",
        None,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    rows = {r["doc_id"]: r for r in license_scan(docs).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (2, 0, 3, "reserved")
    assert rows[1]["base_labels"] == "cc-by" and rows[1]["labels"] == "cc-by,cc-by-nc"
    assert rows[2]["labels"] == "gpl,gpl-3" and rows[2]["first_word"] == 7 and rows[2]["score"] == 1.0
    assert rows[3]["labels"] == "mit" and rows[3]["n_base"] == 0 and rows[3]["first_word"] is None
    assert rows[4]["n_words"] == 1 and rows[4]["labels"] == "" and rows[4]["score"] == 0.0
    assert rows[5]["n_base"] == 2 and rows[5]["n_words"] == 7
    assert rows[6]["n_words"] == 0
    assert license_scan(odd_docs).count() == 11
    assert license_scan(no_docs).collect() == []


def test_rates_meet_their_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.2], 2000)
    tokens = rng.integers(0, 400, 2000)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "n_tokens long, posterior array<double>")
    targets = [0.2, 0.3, 0.5]
    fit = mixing.fit_rates(members, targets)
    rates = np.array([r[0] for r in members.select(fit.rate(F.col("posterior"))).collect()])
    assert fit.converged and (rates >= 0).all() and (rates == 0).any()
    got = (rates * tokens) @ p
    assert np.allclose(got / tokens.sum(), targets, atol=1e-4)


def test_mixing_of_documents(spark, sf_dir):
    rows = QUERIES["op6_source_mixing"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = sum(r["n_tokens"] for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{domain}"] for r in rows) / total - share) < 1e-3
    assert all(abs(r["p_high"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    low = [r["p_low"] for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 0]
    high = [r["p_low"] for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1]
    assert np.mean(low) > np.mean(high)


def test_omitted_domains_have_target_zero(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mixing_rates(docs, labels, {"low": 0.3, "high": 0.7}).collect()
    shares = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    total = sum(r["n_tokens"] for r in rows)
    assert abs(shares["low"] / total - 0.3) < 0.02 and shares["toxic"] / total < 0.02


def test_rates_meet_what_a_plain_gradient_meets(spark):
    """Against plain projected gradient steps on the same misses. Targets outside of all posteriors are approached only."""
    rng = np.random.default_rng(4)
    for peak, targets in ((0.4, [0.2, 0.3, 0.5]), (8.0, [0.9, 0.1, 0.0])):
        p, tokens = rng.dirichlet([peak] * 3, 300), rng.integers(1, 200, 300)
        members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "n_tokens long, posterior array<double>")
        fit = mixing.fit_rates(members, targets)
        rates = np.array([r[0] for r in members.select(fit.rate(F.col("posterior"))).collect()])
        a, goal = (p * tokens[:, None]).T, np.array(targets) * tokens.sum()
        plain, step = np.ones(300), 1.0 / np.linalg.norm(a, 2) ** 2
        miss = lambda r: float(np.abs(a @ r - goal).max() / tokens.sum())
        start = miss(plain)
        for _ in range(20_000):
            plain = np.maximum(0, plain - step * (a.T @ (a @ plain - goal)))
        assert (rates >= 0).all() and abs(miss(rates) - fit.gap) < 1e-6
        if fit.converged:
            assert miss(rates) <= miss(plain) + 1e-4
        assert fit.converged == (peak < 8) and miss(rates) < start


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, None, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixing_rates(odd_docs, labels).collect()
    assert len(rows) == 11 and all(r["rate"] >= 0 for r in rows)
    out = mixing.mixed(odd_docs, labels)
    assert out.columns == odd_docs.columns
    counts = sum(r["copies"] for r in rows)
    assert out.count() == counts
    assert mixing.mixing_rates(no_docs, labels).collect() == []
