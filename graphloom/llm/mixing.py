r"""Mixing to target weights by soft membership.

A multinomial logistic regression, fitted on a bounded sample of a table of labelled documents,
gives each document a posterior over the labels (domains). Rates r >= 0 for the documents are then
fitted by projected-gradient least squares: from r = 1 on, each step goes against the gradient of the
squared gap between the expected tokens of the domains, sum(r * tokens * posterior), and the target
weights times all tokens, and rates below 0 become 0. The gap is measured in the inverse of the Gram
matrix of the rows that the step moves, in which one step closes it where no rate is cut; of several step
lengths the best is taken. Since the gradient of a row is its posterior times one vector of a number for
each domain, a step is that vector, a rate is worked out from a row's posterior and the vectors of all
steps, and a step needs a few small sums from the whole table. The steps go on until the domain shares
are within TOLERANCE of the targets. Targets that no rates reach (soft posteriors) are approached as
far as STEPS steps go, and a warning gives the remaining gap.

draw() applies the rates: scaled so that a sure document of the favoured domain stands once, a rate
gives its whole part as copies and one more with the probability of the rest. reached() gives the
expected shares of the domains before and after.

Defined results: null and blank texts have no tokens and weigh nothing (draw() keeps them once);
equal texts get equal rates; without labels every document has rate 1 and no posterior; target
weights of domains that no label names, and domains that have no tokens, are left out and the rest
scaled; each row counts, whether its id is null, repeated or stands on other texts; of a labelled id
with several texts the smallest text, and with several labels the smallest label, is learned from;
extra columns are ignored by op1 and kept by draw(); an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, first_by_hash, keyed, load, materialize, utf8

#: Bounds of the training sample (documents, at least so many of each domain) and of the word features.
TRAIN_DOCS, OF_EACH, WORDS = 4_000, 50, 400
STEPS, TOLERANCE = 60, 1e-7
#: Lengths of the trial steps of one pass, and what is added to the Gram diagonal, as a part of its mean.
LENGTHS, RIDGE = (1.5, 1.25, 1.0, 0.75, 0.5, 0.25, 0.1, 0.02, 0.004), 1e-9
TARGETS = {"good": 0.9, "junk": 0.05, "toxic": 0.05}
_PUNCT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


@dataclass
class Classifier:
    domains: list[str]
    words: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None  # features x domains
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, features): shape of the text, then presence of the chosen words."""
        index = {w: k for k, w in enumerate(self.words)}
        vocabulary = frozenset(index)
        tokens, x = np.zeros(len(texts)), np.zeros((len(texts), 9 + len(self.words)))
        for i, t in enumerate(texts):
            t = t or b""
            raw = t.split()
            n = tokens[i] = len(raw)
            if not n:
                continue
            low = set(t.lower().translate(_PUNCT).split())
            x[i, :9] = (
                1.0,
                sum(map(t.count, (b"#", b"*", b"$", b"%", b"&"))) / n,
                t.count(b"|") / n,
                t.count(b"!") / n,
                (len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / len(t),
                1 - len(set(raw)) / n,
                sum(a == b for a, b in zip(raw, raw[1:])) / n if n < 2000 else np.mean([a == b for a, b in zip(raw[:-1], raw[1:])]),
                np.log1p(n) / 10,
                len(t) / n / 10,
            )
            for w in low & vocabulary:
                x[i, 9 + index[w]] = 1.0
        return tokens, x

    def posterior(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        tokens, x = self.features(texts)
        z = ((x - self.centre) / self.scale) @ self.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return tokens, p / p.sum(axis=1, keepdims=True)


def fit_classifier(domains: list[str], words: list[bytes], x: np.ndarray, labels: list[str], rounds: int = 300) -> Classifier:
    """Weights from the features x of labelled documents, by accelerated gradient steps; x is overwritten."""
    y = np.array([[d == l for d in domains] for l in labels], float)
    c = Classifier(domains, words)
    c.centre, c.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    c.centre[0], c.scale[0] = 0, 1
    z = x
    z -= c.centre
    z /= c.scale
    w = np.zeros((z.shape[1], len(domains)))
    momentum, step = w.copy(), 4.0 / max(1.0, np.linalg.norm(z, 2) ** 2 / len(z))
    for k in range(rounds):
        a = z @ momentum
        p = np.exp(a - a.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = momentum - step * (z.T @ (p - y) / len(z) + 1e-4 * momentum)
        momentum, w = new + k / (k + 3) * (new - w), new
    c.weights = w
    return c


def telling_words(texts: DataFrame, of: dict[str, int]) -> list[bytes]:
    """The WORDS words whose presence in texts (text, domain) differs most between a domain and all,
    in standard errors (more than 4); of has the number of texts of each domain."""
    domains, total = sorted(of), sum(of.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, d in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                words = list(set(t.lower().translate(_PUNCT).split()))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([d] * len(words), pa.string())], names=["word", "domain"])

    seen = texts.select("text", "domain").mapInArrow(run, "word binary, domain string")
    n = seen.groupBy("word").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("domain") == d) for d in domains]).alias("of")).filter("n >= 5")
    p = F.col("n") / total
    gaps = [F.abs(F.col("of")[i] / of[d] - p) / F.sqrt(p / of[d] + 1 / of[d] ** 2) for i, d in enumerate(domains)]
    n = n.select("word", F.array_max(F.array(*gaps)).alias("gap")).filter("gap > 4")
    return [bytes(r["word"]) for r in n.orderBy(F.desc("gap"), "word").limit(WORDS).collect()]


def train(docs: DataFrame, labelled: DataFrame) -> Classifier:
    """Fit on rows of labelled (doc_id, domain): TRAIN_DOCS by hash of the id, and OF_EACH domain.

    Their whole texts stay on the executors; the driver gets the words that are chosen and a row of
    features for each document.
    """
    arrow_ready(docs.sparkSession)
    lab = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    lab = lab.join(docs.filter("length(text) > 0").select("doc_id").distinct(), "doc_id", "left_semi")
    lab = materialize(lab.select("doc_id", "domain", F.xxhash64("doc_id").alias("h"), F.lit(0).alias("all")), "labelled")
    some = first_by_hash(lab, ["all"], ["h", "doc_id"], TRAIN_DOCS).select("doc_id", "domain")
    some = materialize(some.unionByName(first_by_hash(lab, ["domain"], ["h", "doc_id"], OF_EACH).select("doc_id", "domain")).distinct(), "sample")
    # at most TRAIN_DOCS ids and OF_EACH of each domain
    texts = docs.select("doc_id", "text").filter("length(text) > 0").join(F.broadcast(some), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    texts = materialize(texts, "training")
    of = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not of:
        return Classifier([])
    plain = Classifier(sorted(of), telling_words(texts, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = plain.features(utf8(b.column(2)))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["doc_id", "domain", "x"])

    got = texts.select("doc_id", "domain", "text").mapInArrow(run, "doc_id long, domain string, x array<double>").toArrow()
    # the rows of features go to one array, in which they are fitted; Arrow's copy of them goes before that
    order = got.column("doc_id").to_numpy().argsort()
    labels = got.column("domain").take(pa.array(order)).to_pylist()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, at = np.empty((len(order), 9 + len(plain.words))), 0
    for chunk in got.column("x").chunks:
        x[place[at : at + len(chunk)]] = chunk.flatten().to_numpy().reshape(len(chunk), -1)
        at += len(chunk)
        del chunk
    del got
    pa.default_memory_pool().release_unused()
    return fit_classifier(plain.domains, plain.words, x, labels)


def memberships(docs: DataFrame, model: Classifier, id: str = "doc_id") -> DataFrame:
    """id, n_tokens, p: posterior of each domain in the order of model.domains."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(**shared.value)
        for b in batches:
            texts = utf8(b.column(1))
            for i in range(0, len(texts), 500):
                part = texts[i : i + 500]
                if c.domains:
                    n, p = c.posterior(part)
                else:
                    n, p = np.array([len((t or b"").split()) for t in part]), np.zeros((len(part), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel().astype(float)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(n.astype(np.int64)), lists], names=[id, "n_tokens", "p"])

    return docs.select(id, "text").mapInArrow(run, f"{id} long, n_tokens long, p array<double>")


def _rate(steps: np.ndarray):
    """The rate of a document with posterior p after steps (one row each)."""
    if not len(steps):
        return F.lit(1.0)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(rows, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((F.col("p")[i] * s[i] for i in range(steps.shape[1])), F.lit(0.0))))


def rate_of(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """_rate() of posteriors (rows of p)."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def _dot(v: np.ndarray):
    return sum((F.col("p")[i] * float(x) for i, x in enumerate(v)), F.lit(0.0))


def _gram(rated: DataFrame, active, d: int, total: float) -> tuple[np.ndarray, int]:
    """The Gram matrix of the posteriors of active rows, by tokens, and how many rows have the rate 0."""
    cells = [F.sum(F.when(active, F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)) for i in range(d) for j in range(i, d)]
    *got, cut = rated.agg(*cells, F.count_if(F.col("r") == 0)).first()
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = [float(x) / total for x in got]
    gram = np.maximum(gram, gram.T)
    return gram + np.eye(d) * max(np.trace(gram) / d, 1e-9) * RIDGE, cut


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float]) -> np.ndarray:
    """The steps whose _rate() is each document's rate."""
    d = len(domains)
    w, steps = np.array([targets.get(x, 0.0) for x in domains]), np.zeros((0, d))
    if not d or w.sum() <= 0:
        return steps
    n = F.col("n_tokens")
    first = rows.agg(F.sum("n_tokens"), *[F.sum(n * F.col("p")[i]) for i in range(d)]).first()
    total = float(first[0] or 0)
    if not total:
        return steps
    held = np.array([float(x) for x in first[1:]])
    w = np.where(held > 0, w, 0.0)
    if w.sum() <= 0:
        return steps
    w = w / w.sum()
    gap = held / total - w
    for _ in range(STEPS):
        if np.abs(gap).max() < TOLERANCE:
            break
        rated = rows.withColumn("r", _rate(steps))
        gram, cut = _gram(rated, F.col("r") > 0, d, total)
        ahead = np.linalg.solve(gram, gap)
        if cut:  # rows at 0 that the step takes up again belong to those it moves
            gram, _ = _gram(rated, (F.col("r") > 0) | (_dot(ahead) < 0), d, total)
            ahead = np.linalg.solve(gram, gap)
        sums = [F.sum(n * F.greatest(F.lit(0.0), F.col("r") - _dot(k * ahead)) * F.col("p")[i]) for k in LENGTHS for i in range(d)]
        gaps = np.array([float(x) for x in rated.agg(*sums).first()]).reshape(len(LENGTHS), d) / total - w
        size = lambda g: g @ np.linalg.solve(gram, g)
        best = min(range(len(LENGTHS)), key=lambda k: size(gaps[k]))
        if size(gaps[best]) >= size(gap) * (1 - 1e-9):
            break
        steps, gap = np.vstack([steps, LENGTHS[best] * ahead]), gaps[best]
    if np.abs(gap).max() >= TOLERANCE:
        warnings.warn(f"mixing: the domain shares of {dict(zip(domains, w.round(6).tolist()))} are missed by up to {np.abs(gap).max():.3g}", stacklevel=2)
    return steps


def reached(rows: DataFrame, domains: list[str]) -> dict[str, tuple[float, float]]:
    """Expected share of tokens of each domain in rows (n_tokens, p, rate): before, and at the rates."""
    cells = [F.sum(F.col("n_tokens") * w * F.col("p")[i]) for w in (F.lit(1.0), F.col("rate")) for i in range(len(domains))]
    got = [float(x or 0) for x in rows.agg(*cells).first()] if domains else []
    before, after = got[: len(domains)], got[len(domains) :]
    return {d: (x / (sum(before) or 1), y / (sum(after) or 1)) for d, x, y in zip(domains, before, after)}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p, rate) and the domains in the order of p."""
    model = train(docs, labelled)
    rows = materialize(memberships(docs, model), "posterior")
    return rows.withColumn("rate", _rate(fit_rates(rows, model.domains, targets))), model.domains


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else junk or good by quality."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'junk' when quality = 1 then 'good' end").alias("domain"))


def op1(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, domains = mix(docs, domains_of(labels), TARGETS)
    return rows.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, favoured: str | None = None) -> DataFrame:
    """docs in the mix: rates are scaled so that a sure document of the favoured domain (that with
    the largest target) has rate 1; a document stands as often as its rate says, the part after the
    point decided by a hash."""
    cols = docs.columns
    model = train(docs, domains_of(labels))
    if not model.domains:
        return docs
    docs, _ = keyed(docs)
    rows = materialize(memberships(docs, model, "__key"), "posterior")
    steps = fit_rates(rows, model.domains, targets)
    favoured = favoured or max(model.domains, key=lambda d: targets.get(d, 0.0))
    one = rate_of(np.array([[float(d == favoured) for d in model.domains]]), steps)[0]
    rate = _rate(steps) / (float(one) if one > 1e-9 else 1.0)
    u = F.pmod(F.xxhash64(F.lit(97), "__key"), F.lit(1_000_003)) / 1_000_003.0
    times = F.when(F.col("n_tokens") > 0, F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).otherwise(1).cast("int")
    other = rows.select("__key", times.alias("__times")).filter("__times <> 1")
    out = docs.join(other, "__key", "left").withColumn("__copy", F.explode(F.expr("array_repeat(0, coalesce(__times, 1))")))
    return out.select(*cols)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
