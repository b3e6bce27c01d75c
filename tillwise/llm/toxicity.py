"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms of a text are its words, and those beginnings of words (also where several words share one) that set toxic labels
apart in the sample. A term weighs (1 + log tf) * idf, with document frequencies counted over all documents, times its
relevance: 1 if it sets labels apart, NEUTRAL if not. A text's vector covers all its words; a word that no example has
counts in its length as one that a single document holds.

The examples, a bounded sample of labelled texts, are ordered so that similar ones share a block. Terms of few examples
have postings, which are read whole; of frequent terms each block knows its largest weight. Postings and block maxima give
each example an upper bound; examples are completed in the order of falling bounds, until none can reach the k-th best cosine.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.words import ranges, texts, words
from tillwise.session import staged

#: Bounds of the labelled sample that is learnt from; everything else covers all documents.
MAX_LABELLED = 20_000
MAX_EXAMPLES = 4_000
#: Longer labelled texts are no examples; they count for the terms, and are scored whole like any other.
MAX_EXAMPLE_BYTES = 1 << 18
MIN_SUPPORT, MIN_LIFT, MIN_Z = 5, 3.0, 4.0
BEGINNINGS, REPEATS = (3, 4, 5, 6, 7), (2, 3)
#: Weight of a term that does not set labels apart, where one that does has 1.
NEUTRAL = 0.03
NEIGHBOURS = 15
#: Examples in a block; terms of more than one in FREQUENT examples are bounded by block; examples completed at a time.
BLOCK, FREQUENT, STEP = 32, 8, 128
#: Weight among the votes of how often texts without marks are toxic.
PRIOR_WEIGHT = 0.25
#: Texts and words taken together; words remembered with their terms.
CHUNK_TEXTS, CHUNK_WORDS, REMEMBERED = 1024, 1 << 17, 200_000

#: Scored texts whose copies are told the same.
TOLD = 10_000

TERM_COLUMNS = 1 + len(BEGINNINGS)
NO_BEGINNINGS = (-1,) * len(BEGINNINGS)


def chunks(data: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of some texts at a time, and the place of the first of them."""
    low, held, size = 0, [], 0
    for i, text in enumerate(data):
        held.append(words(text))
        size += len(held[-1])
        if len(held) == CHUNK_TEXTS or size >= CHUNK_WORDS:
            yield low, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, held


def grouped(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of ``n``."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n[:0]


def spread(doc: np.ndarray, rows: np.ndarray, n: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences), from the terms of each text's words, -1 for none; several words may share a beginning."""
    own, begun = rows[:, 0] >= 0, np.nonzero((rows[:, 1:] >= 0).any(axis=1))[0]
    rest = rows[begun, 1:]
    real = rest >= 0
    key, count = grouped((doc[begun, None] * n_terms + rest)[real], np.broadcast_to(n[begun, None], rest.shape)[real])
    parts = (doc[own], key // n_terms), (rows[own, 0], key % n_terms), (n[own], count)
    return tuple(np.concatenate(p) for p in parts)


class WordTerms:
    """Looks up the terms of words; what a word stands for is worked out once while it is remembered."""

    def __init__(self, of_word: Callable[[bytes], list[int]]):
        self.of_word = of_word
        self._forget()

    def _forget(self) -> None:
        self.seen: defaultdict = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.table = np.empty((0, TERM_COLUMNS), np.int32)

    def counts(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, terms of a word, occurrences of the word) for the distinct words of each text."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        entry = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        new = len(self.seen) - len(self.table)
        if new:
            fresh = list(islice(reversed(self.seen), new))[::-1]
            rows = np.fromiter(chain.from_iterable(map(self.of_word, fresh)), np.int32, new * TERM_COLUMNS)
            self.table = np.concatenate([self.table, rows.reshape(-1, TERM_COLUMNS)])
        key, n = np.unique(np.repeat(np.arange(len(lists)), sizes) * max(1, len(self.seen)) + entry, return_counts=True)
        return key // max(1, len(self.seen)), self.table[key % max(1, len(self.seen))], n


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label a term occurs, beginnings also how often twice and three times; the empty
    term counts the texts."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__

    def of_word(word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        return [numbers["=" + text], *(numbers["^" + text[:k]] if len(text) >= k else -1 for k in BEGINNINGS)]

    terms, totals, found = WordTerms(of_word), [0, 0], {}
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, lists in chunks(texts(batch.column(0))):
            doc, rows, n = terms.counts(lists)
            doc, term, n = spread(doc, rows, n, max(1, len(numbers)))
            label = labels[low + doc]
            for least in (1, *REPEATS):
                for y in (0, 1):
                    held = found.setdefault((least, y), np.zeros(0, np.int64))
                    now = np.bincount(term[(label == y) & (n >= least)], minlength=len(numbers))
                    now[: len(held)] += held
                    found[least, y] = now
            for y in (0, 1):
                totals[y] += int((labels[low : low + len(lists)] == y).sum())
    names = list(numbers)
    out: tuple[list, list, list] = ([""], [totals[0]], [totals[1]])
    for least in (1, *REPEATS):
        clean, toxic = (found.get((least, y), np.zeros(0, np.int64)) for y in (0, 1))
        for i in np.nonzero(clean + toxic)[0].tolist():
            if least == 1 or names[i][0] == "^":
                out[0].append(names[i] if least == 1 else f"{least}{names[i]}")
                out[1].append(int(clean[i])), out[2].append(int(toxic[i]))
    types = (pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["term", "clean", "toxic"])


class Vocabulary:
    """Numbers of the terms of the examples and of all marks: words and beginnings first, repeated beginnings after them."""

    def __init__(self, own_words: list[bytes], marks: list[str]):
        self.words = {w: i for i, w in enumerate(own_words)}
        self.beginnings: dict[str, int] = {}
        repeated: dict[tuple[int, str], None] = {}
        marked = set()
        for mark in marks:
            if mark[0] == "=":
                marked.add(self.words.setdefault(mark[1:].encode(), len(self.words)))
        for mark in marks:
            if mark[0] != "=":
                least, begin = mark.split("^", 1)
                number = self.beginnings.setdefault(begin, len(self.words) + len(self.beginnings))
                if least:
                    repeated[int(least), begin] = None
                else:
                    marked.add(number)
        self.plain = len(self.words) + len(self.beginnings)
        self.repeats = {m: np.full(self.plain, -1, np.int64) for m in REPEATS}
        for i, (least, begin) in enumerate(repeated):
            self.repeats[least][self.beginnings[begin]] = self.plain + i
        self.size = self.plain + len(repeated)
        # Beginnings that only matter when repeated weigh nothing themselves.
        self.relevance = np.full(self.size, NEUTRAL)
        self.relevance[len(self.words) : self.plain] = 0
        self.relevance[self.plain :] = 1
        self.relevance[sorted(marked)] = 1
        # Beginnings by their first bytes; as bytes they are whole letters, so a word starts with them or not.
        self.heads: dict[bytes, list[tuple[bytes, int]]] = {}
        for begin, number in self.beginnings.items():
            self.heads.setdefault(begin.encode()[: BEGINNINGS[0]], []).append((begin.encode(), number))

    def of_word(self, word: bytes) -> list[int]:
        own = self.words.get(word, -1)
        likely = self.heads.get(word[: BEGINNINGS[0]])
        if likely is None:
            return [own, *NO_BEGINNINGS]
        begun = [i for begin, i in likely if word.startswith(begin)]
        return [own, *begun, *NO_BEGINNINGS[len(begun) :]]

    def terms(self, doc: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences), repeated beginnings as terms that occur once."""
        doc, term, n = spread(doc, rows, n, max(1, self.plain))
        parts = [(doc, term, n)]
        for least, other in self.repeats.items():
            more = other[term]
            yes = (more >= 0) & (n >= least)
            parts.append((doc[yes], more[yes], np.ones(int(yes.sum()), n.dtype)))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def known(self) -> WordTerms:
        """Words looked up by this process so far; tasks that share the broadcast share them."""
        if not hasattr(self, "_known"):
            self._known = WordTerms(self.of_word)
        return self._known


def _document_counts(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents each term occurs; term -1 counts the documents."""
    v = vocabulary.value
    terms, total = v.known(), np.zeros(v.size + 1, np.int64)
    for batch in batches:
        for _, lists in chunks(texts(batch.column(0))):
            total[:-1] += np.bincount(v.terms(*terms.counts(lists))[1], minlength=v.size)
            total[-1] += len(lists)
    names = np.r_[np.arange(v.size), -1]
    yield pa.RecordBatch.from_arrays([pa.array(names[total > 0], pa.int32()), pa.array(total[total > 0])], names=["term", "n"])


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, distinct words, occurrences) of the examples; words joined by blanks, numbers as 32-bit integers."""
    for batch in batches:
        counted = [np.unique(np.array(words(t), object), return_counts=True) for t in texts(batch.column(2))]
        joined = pa.array([b" ".join(own.tolist()) for own, _ in counted], pa.binary())
        numbers = pa.array([n.astype("<i4").tobytes() for _, n in counted], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined, numbers], names=["doc_id", "label", "words", "n"])


def similar_order(rows: np.ndarray, centres: int = 32, rounds: int = 4) -> np.ndarray:
    """An order of the rows in which similar directions lie together, longer rows of each first."""
    length = np.sqrt((rows**2).sum(axis=1))
    unit = rows / np.maximum(length, 1e-12)[:, None]
    middle = unit[np.linspace(0, len(unit) - 1, min(centres, len(unit))).astype(int)]
    near = np.zeros(len(unit), int)
    for _ in range(rounds):
        near = np.argmax(unit @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, unit)
        middle = sums / np.maximum(np.sqrt((sums**2).sum(axis=1)), 1e-12)[:, None]
    return np.lexsort((-length, near))


class Index:
    """Block-max inverted index over unit vectors, given as (vector, term, weight) in order of the vectors."""

    def __init__(self, n: int, size: int, vector: np.ndarray, term: np.ndarray, weight: np.ndarray, ids):
        held = np.bincount(term, minlength=size)
        common = np.nonzero(held * FREQUENT > n)[0]
        self.column = np.full(size, -1, np.int64)
        self.column[common] = np.arange(len(common))
        dense = np.zeros((n, len(common)))
        often = self.column[term] >= 0
        dense[vector[often], self.column[term[often]]] = weight[often]
        self.order = similar_order(dense) if n else np.empty(0, np.int64)  # the vector at each place
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.dense = dense[self.order]
        blocks = -(-n // BLOCK)
        self.most = np.array([self.dense[i * BLOCK : (i + 1) * BLOCK].max(axis=0) for i in range(blocks)]).reshape(blocks, len(common)).T.copy()
        self.length = np.sqrt((self.dense**2).sum(axis=1)) * (1 + 1e-12)
        at, term, weight = place[vector[~often]], term[~often], weight[~often]
        by_term = np.lexsort((at, term))
        self.at, self.weight = at[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(size + 1))
        self.ids = np.asarray(ids)[self.order] if n else np.empty(0, np.int64)
        self.completed = 0

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k largest positive cosines, ties to the smaller id, leaving the id ``without`` out; exact."""
        n = len(self.ids)
        column = self.column[term]
        rare = column < 0
        places, of_term = ranges(self.first[term[rare]], self.first[term[rare] + 1])
        score = np.bincount(self.at[places], weight[rare][of_term] * self.weight[places], n)
        column, x = column[~rare], weight[~rare]
        reach = np.repeat(x @ self.most[column], BLOCK)[:n]
        bound = (score + np.minimum(reach, self.length * math.sqrt(float(x @ x)))) * (1 + 1e-9)
        if without is not None:
            bound[self.ids == without] = 0
        likely = np.nonzero(bound > 0)[0]
        if len(likely) > STEP:  # the best few first, the others only if they can still count
            likely = likely[np.argpartition(-bound[likely], STEP - 1)]
        found, cosines, least, low, high = likely[:0], score[:0], 0.0, 0, STEP
        while low < len(likely):
            some = likely[low:high]
            if low:
                some = some[bound[some] >= least]
            value = score[some] + self.dense[some[:, None], column] @ x
            self.completed += len(some)
            found, cosines = np.concatenate((found, some)), np.concatenate((cosines, value))
            if len(found) > k:
                best = np.lexsort((self.ids[found], -cosines))[:k]
                found, cosines = found[best], cosines[best]
            if len(found) == k:
                least = float(cosines.min())
            if not low:
                rest = likely[high:]
                rest = rest[bound[rest] >= least]
                likely = np.concatenate((likely[:high], rest[np.argsort(-bound[rest], kind="stable")]))
            elif len(some) < high - low:
                break
            low, high = high, high + STEP
        best = np.lexsort((self.ids[found], -cosines))
        best = best[cosines[best] > 0]
        return found[best], cosines[best]


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    unseen: float  # idf of a word that one document holds
    examples: tuple  # ids, labels, and (example, term, weight) in order
    shares: dict[int, float]  # what a vote of each class stands for, so that classes weigh as they occur
    base_rate: float
    neighbours: int = NEIGHBOURS

    def vectors(self, doc: np.ndarray, rows: np.ndarray, n: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit length over all words, those without a number included."""
        unknown = rows[:, 0] < 0
        length = np.bincount(doc[unknown], (NEUTRAL * self.unseen * (1 + np.log(n[unknown]))) ** 2, count)
        doc, term, n = self.vocabulary.terms(doc, rows, n)
        weight = (1 + np.log(n)) * self.idf[term] * self.vocabulary.relevance[term]
        length = np.sqrt(length + np.bincount(doc, weight**2, count))
        order = np.argsort(doc.astype(np.uint16), kind="stable")  # CHUNK_TEXTS of them at most
        order = order[weight[order] > 0]
        return doc[order], term[order], weight[order] / length[doc[order]]

    def scorer(self) -> Callable[[list, list[bytes | None]], list[tuple]]:
        """A function of ids and texts: (score, ids of the neighbours, their cosines) of each. Made once per process."""
        if not hasattr(self, "_scorer"):
            self._scorer = self._make_scorer()
        return self._scorer

    def _make_scorer(self):
        ids, labels, vectors = self.examples
        self.examples = ((), (), ())  # the index holds them from now on
        index = Index(len(ids), self.vocabulary.size, *vectors, ids)
        label = np.asarray(labels, float)[index.order] if len(ids) else np.empty(0)
        share = np.where(label > 0, self.shares[1], self.shares[0])
        examples, terms, told = set(ids), self.vocabulary.known(), {}

        def score(near: np.ndarray, cosine: np.ndarray) -> tuple:
            vote = share[near] * cosine / (1.05 - np.minimum(cosine, 1.0))  # nearer examples weigh more
            value = (float(vote @ label[near]) + PRIOR_WEIGHT * self.base_rate) / (float(vote.sum()) + PRIOR_WEIGHT)
            return min(1.0, max(0.0, value)), index.ids[near].tolist(), cosine.tolist()

        def scores(names: list, data: list[bytes | None]) -> list[tuple]:
            # Equal texts score alike, unless one of them is an example itself: it has no vote on its own row.
            keys = [(t or b"", i if i in examples else None) for i, t in zip(names, data)]
            if len(told) > TOLD or sum(len(t) for t, _ in told) > 1 << 23:
                told.clear()
            fresh = [key for key in dict.fromkeys(keys) if key not in told]
            for low, lists in chunks([t for t, _ in fresh]):
                doc, term, weight = self.vectors(*terms.counts(lists), len(lists))
                first = np.searchsorted(doc, np.arange(len(lists) + 1))
                for i in range(len(lists)):
                    own = slice(first[i], first[i + 1])
                    told[fresh[low + i]] = score(*index.nearest(term[own], weight[own], self.neighbours, fresh[low + i][1]))
            return [told[key] for key in keys]

        return scores


def labelled_ids(labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, label) of rows to learn from: not in the held-out fold, label 0 or 1; contradictory rows count as 1."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != held_out))
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the rows (doc_id, label), half of them for each label, by a hash of the id."""
    ids = [
        tuple(r)
        for y in (0, 1)
        for r in rows.where(F.col("label") == y).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2).collect()
    ]
    return rows.sparkSession.createDataFrame(ids, "doc_id long, label int")


def fit(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """Learn from at most MAX_LABELLED labelled documents, half of them for each label where there are enough.

    Sampling is by a hash of the id, so it repeats. Without labelled documents the model scores everything 0. Null
    texts are empty; of rows that repeat an id the smallest text is learnt; an id that no document has is ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # The samples are bounded rows of two numbers each.
    train = source.join(F.broadcast(_sampled(labelled, MAX_LABELLED)), "doc_id")
    train = staged(train.groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "labelled")
    counted = train.select("text", "label").mapInArrow(_term_labels, "term string, clean long, toxic long")
    counted = staged(counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "term-labels")
    share = dict(map(tuple, labelled.groupBy("label").count().collect()))
    n = (counted.where("term = ''").select("clean", "toxic").collect() or [(0, 0)])[0]
    p1, p0 = (F.col("toxic") + 0.5) / (n[1] + 1), (F.col("clean") + 0.5) / (n[0] + 1)
    pooled = (F.col("toxic") + F.col("clean") + 1) / (n[0] + n[1] + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1.0 / (n[0] + 1) + 1.0 / (n[1] + 1)))
    chosen = counted.where((F.col("term") != "") & (F.col("toxic") >= MIN_SUPPORT) & (z >= MIN_Z) & (p1 / p0 >= MIN_LIFT))
    marks = [r[0] for r in chosen.select("term").orderBy("term").collect()]

    # Examples: at most MAX_EXAMPLES of the sample that hold any word; the words of that many bounded texts.
    worded = train.where((F.octet_length("text") <= MAX_EXAMPLE_BYTES) & F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    examples = worded.join(F.broadcast(_sampled(worded, MAX_EXAMPLES)), ["doc_id", "label"]).select("doc_id", "label", "text")
    held = examples.mapInArrow(_example_words, "doc_id long, label int, words binary, n binary").toArrow().sort_by("doc_id")
    own: dict[bytes, int] = {}
    entries = [np.array([own.setdefault(w, len(own)) for w in row.as_py().split(b" ")], np.int32) for row in held.column("words")]
    vocabulary = Vocabulary(list(own), marks)
    shared = spark.sparkContext.broadcast(vocabulary)
    frequencies = source.select("text").mapInArrow(lambda it: _document_counts(it, shared), "term int, n long")
    counts = frequencies.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(vocabulary.size + 1, np.int64)
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()  # the last is term -1, all documents
    total = 1 + int(df[-1])
    idf = np.log(total / (1 + df[:-1])) + 1

    ids, labels = (held.column(c).to_numpy() for c in ("doc_id", "label"))
    taken = np.bincount(labels, minlength=2)
    # A vote of class y stands for its labelled documents.
    per_class = {y: share.get(y, 0) / max(1, int(taken[y])) for y in (0, 1)}
    shares = {y: v / (max(per_class.values()) or 1.0) for y, v in per_class.items()}
    model = ToxicityModel(vocabulary, idf, math.log(total / 2) + 1 if total > 1 else 1.0, ((), (), ()), shares, 0.0)
    table = np.fromiter(chain.from_iterable(map(vocabulary.of_word, own)), np.int32, len(own) * TERM_COLUMNS).reshape(-1, TERM_COLUMNS)
    parts = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))]
    for low in range(0, len(ids), CHUNK_TEXTS):
        some = entries[low : low + CHUNK_TEXTS]
        at = np.repeat(np.arange(len(some)), [len(e) for e in some])
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in held.column("n")[low : low + CHUNK_TEXTS]])
        at, term, weight = model.vectors(at, table[np.concatenate(some)].astype(np.int64), n, len(some))
        parts.append(((at + low).astype(np.int32), term.astype(np.int32), weight))
    vectors = tuple(np.concatenate(p) for p in zip(*parts))
    model.examples = (ids.tolist(), labels.tolist(), vectors)
    # How often examples without any mark are toxic: what a text without evidence scores.
    bare = np.ones(len(ids), bool)
    bare[vectors[0][vocabulary.relevance[vectors[1]] == 1]] = False
    without = {y: per_class[y] * (int((bare & (labels == y)).sum()) + 0.5) for y in (0, 1)}
    model.base_rate = without[1] / (sum(without.values()) or 1.0)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    """doc_id and the other columns but the text, which is the last; then what the model says."""
    scores = model.value.scorer()
    for batch in batches:
        rows = scores(batch.column(0).to_pylist(), texts(batch.column(batch.num_columns - 1)))
        value = [r[0] for r in rows]
        said = [
            pa.array(value, pa.float64()),
            pa.array([int(v >= 0.5) for v in value], pa.int32()),
            pa.array([r[1] for r in rows], pa.list_(pa.int64())),
            pa.array([r[2] for r in rows], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *said], names=names)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours, cosines.

    Only labels outside the held-out fold (crc32 of the id's digits mod 5 = 0) are learnt from, and none has a vote on the
    document it belongs to. A text is scored by all its words; null and empty texts, and those that share no word with any
    example, get the share of toxic labels among examples without marks. Rows with null ids have ``held_out`` null. Repeated rows each give a row;
    extra columns are ignored; an empty table gives no rows; without usable labels all scores are 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled_ids(labels), id_column, text_column))
    held_out = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    names = ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"]
    schema = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"
    return source.mapInArrow(lambda it: _scored(it, model, names), schema)


def _kept(batches: Iterator[pa.RecordBatch], model, at: int, text: int) -> Iterator[pa.RecordBatch]:
    scores = model.value.scorer()
    for batch in batches:
        rows = scores(batch.column(at).cast(pa.int64()).to_pylist(), texts(batch.column(text)))
        yield batch.filter(pa.array([r[0] < 0.5 for r in rows], pa.bool_()))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns of any name, whose score is below one half. Judged by text, so null and repeated ids are too."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled_ids(labels), id_column, text_column))
    at, text = docs.columns.index(id_column), docs.columns.index(text_column)
    return docs.mapInArrow(lambda it: _kept(it, model, at, text), docs.schema)
