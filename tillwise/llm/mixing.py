"""Mix sources to target weights through soft membership in labelled domains.

A naive Bayes classifier, learnt from a bounded sample of the labels table, gives every document posteriors
over the domains. Nonnegative rates per document are then fitted by projected gradient steps so that the
expected tokens of each domain, sum of rate * tokens * posterior, meet the targets in the least-squares sense.
Each step needs one aggregate of a few numbers over all documents; what the driver keeps are those numbers, and a
document's rate is a fold over the steps so far. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.session import staged

#: Labelled documents learnt from, at most; hashed words told apart.
MAX_LABELLED = 20_000
BUCKETS = 8_192
DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}
MAX_STEPS, TOLERANCE = 40, 1e-6


def words(text: Column) -> Column:
    """Words at ASCII white space; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) per labelled document: toxic if any row says so, else high or low quality; null labels are left out."""
    per_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.max("quality").alias("q"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "high").when(F.col("q") == 0, "low")
    return per_doc.select("doc_id", domain.alias("domain")).where("domain is not null")


@dataclass
class DomainClassifier:
    """Log weights per hashed word and domain; a longer text's evidence is tempered, so that memberships stay soft."""

    domains: tuple[str, ...]
    prior: list[float]
    weights: list[list[float]]

    def member(self, text: Column) -> Column:
        """Struct of ``n_tokens`` and ``posterior``, an array; texts without words get the priors."""

        def of_words(own: Column) -> Column:
            temper = F.pow(F.greatest(F.size(own), F.lit(1)).cast("double"), F.lit(0.75))

            def logit(prior: float, weights: list[float]) -> Column:
                # Written as text, the table is one constant that Spark folds once, not thousands of expressions.
                table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
                return F.aggregate(own, F.lit(0.0), lambda acc, b: acc + F.get(table, b)) / temper + F.lit(prior)

            logits = F.array(*(logit(p, w) for p, w in zip(self.prior, self.weights)))
            return F.struct(F.size(own).cast("long").alias("n_tokens"), _with(logits, _softmax).alias("posterior"))

        return _with(F.transform(words(text), bucket), of_words)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def _softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return _with(raised, lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, y: a + y)))


def fit_domains(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, text_column: str = "text") -> DomainClassifier:
    """Learn from at most MAX_LABELLED labelled documents, chosen by a hash of the id. No labels: even priors, no evidence."""
    spark = docs.sparkSession
    known = domain_labels(labels)
    shares = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    rows = [tuple(r) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()]
    sample = spark.createDataFrame(rows, "doc_id long, domain string")
    # The sample is bounded by MAX_LABELLED short rows.
    train = docs.select("doc_id", F.col(text_column).alias("text")).join(F.broadcast(sample), "doc_id")
    counted = train.select("domain", F.explode(F.transform(words(F.col("text")), bucket)).alias("b")).groupBy("domain", "b").count()
    counts = np.full((len(domains), BUCKETS), 0.5)
    for r in counted.collect():  # at most domains * BUCKETS numbers
        counts[domains.index(r["domain"]), r["b"]] += r["count"]
    log = np.log(counts / counts.sum(axis=1, keepdims=True))
    log -= log.mean(axis=0)
    n = np.array([shares.get(d, 0) + 1.0 for d in domains])
    return DomainClassifier(domains, np.log(n / n.sum()).tolist(), np.round(log, 4).tolist())


@dataclass
class Fit:
    """Steps of the projection: a document's rate folds over them. ``gap`` is the largest miss as a share of all tokens."""

    steps: list[list[float]]
    gap: float
    converged: bool

    def rate(self, posterior: Column) -> Column:
        one = F.lit(1.0)
        if not self.steps:
            return one

        def step(r: Column, z: Column) -> Column:
            move = F.aggregate(F.zip_with(posterior, z, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
            return F.greatest(F.lit(0.0), r - move)

        return F.aggregate(F.lit(self.steps), one, step)


def fit_rates(members: DataFrame, weights: list[float], tokens: float | None = None) -> Fit:
    """Projected gradient over (n_tokens, posterior) rows from rates of one.

    Steps go along the gradient in the metric of the documents that are not at zero (their domain Gram matrix), so few
    are needed. If a step does not lessen the squared misses it is halved. Targets that no rates can meet are approached.
    """
    k = len(weights)
    fit = Fit([], float("inf"), False)

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        p = [F.col("posterior")[i] for i in range(k)]
        t = F.col("n_tokens").cast("double")
        now = members.withColumn("rate", Fit(steps, 0, False).rate(F.col("posterior")))
        mass = [F.sum(F.col("rate") * t * p[i]) for i in range(k)]
        gram = [F.sum(F.when(F.col("rate") > 0, t * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        row = [float(x or 0.0) for x in now.agg(*[c.alias(f"c{i}") for i, c in enumerate(mass + gram)]).first()]
        return np.array(row[:k]), np.array(row[k:]).reshape(k, k)

    mass, gram = sums([])
    total = mass.sum() if tokens is None else tokens
    if total <= 0:
        return Fit([], 0.0, True)
    goal = np.array(weights, float) / sum(weights) * total
    scale = 1.0
    for _ in range(MAX_STEPS):
        miss = mass - goal
        fit.gap = float(np.abs(miss).max() / total)
        if fit.gap <= TOLERANCE:
            fit.converged = True
            break
        move = scale * np.linalg.solve(gram + np.eye(k) * 1e-9 * max(gram.trace(), 1.0), miss)
        tried = [*fit.steps, [float(x) for x in move]]
        new_mass, new_gram = sums(tried)
        if ((new_mass - goal) ** 2).sum() < (miss**2).sum() * (1 - 1e-6):
            fit.steps, mass, gram, scale = tried, new_mass, new_gram, min(1.0, scale * 2)
        elif scale < 1e-3:
            break
        else:
            scale /= 4
    return fit


def members_of(docs: DataFrame, classifier: DomainClassifier, *columns: str) -> DataFrame:
    return docs.select(*columns, classifier.member(F.col("text")).alias("m")).select(*columns, "m.n_tokens", "m.posterior")


def _domains(targets: Mapping[str, float]) -> tuple[str, ...]:
    """The targets' domains, and those of the labels that they omit: a target of zero."""
    return (*targets, *(d for d in DOMAINS if d not in targets))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, p_<domain>, rate, copies, converged.

    ``rate`` is how often the document should be read; ``copies`` rounds it up or down by a hash of its id, so that the
    expectation holds and the choice repeats. Tokens are words at white space. Null and empty texts have no tokens, priors
    as posteriors and a rate like others. A labelled domain without a target has the target zero. Rows with null or repeated ids each give a row; ``source`` may be null; other columns
    are ignored; an empty table gives no rows.
    """
    domains = _domains(targets)
    classifier = fit_domains(docs, labels, domains)
    members = staged(members_of(docs, classifier, "doc_id", "source"), "members")
    fit = fit_rates(members, [targets.get(d, 0.0) for d in domains])
    rate = members.withColumn("rate", fit.rate(F.col("posterior")))
    shares = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    return rate.select("doc_id", "source", "n_tokens", *shares, "rate", copies(F.col("rate")).alias("copies"), F.lit(fit.converged).alias("converged"))


def copies(rate: Column) -> Column:
    """The rate, rounded at random by the id's hash."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """The documents, all columns of any name, each as often as its rate says (none, once or several times)."""
    domains = _domains(targets)
    classifier = fit_domains(docs, labels, domains)
    members = staged(members_of(docs, classifier), "members")
    fit = fit_rates(members, [targets.get(d, 0.0) for d in domains])
    name = "copy"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    times = copies(fit.rate(classifier.member(F.col("text"))["posterior"]))
    return docs.withColumn(name, F.explode(F.array_repeat(F.lit(1), times))).drop(name)
