r"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier learns from confirmed toxic texts (positives) and an unlabelled sample of all texts, labelled or
not, which therefore holds toxic ones at the class prior p. The risk is p R+(positives) + max(0, R-(unlabelled) - p
R-(positives)): the unlabelled texts' risk as negatives, less the share that hidden positives take in it, never below zero
(when it is, the step runs the other way). Several classifiers, from different halves of the unlabelled sample, are averaged;
a logistic curve, fitted on a sample of labelled texts, turns the mean into a probability.

Features are the distinct words of a text (A-Z lower-cased, ASCII punctuation dropped) and their byte prefixes, hashed.
Their weights are signed; a soft threshold, in proportion to the noise that a feature's share of the positives has by
chance, keeps weights at zero that the risk does not need. The fit sees the features
that tell the two samples apart best (a G test on counts made by the executors); only these are sent to the driver.

Bounds (parameters): at most `most_positive` toxic, `most_unlabelled` unlabelled and `most_negative` texts labelled as not
toxic (for the curve only) are used for the fit, those with the smallest hash of id and text, and `most_features` features;
every text is scored. Labels are taken from the rows for which `learn` holds only.

Edge cases: null and empty texts have no features and get the model's score of an empty text; without any toxic label
every score is the prior (0 without labels); ids that repeat in labels count as toxic if one row says so; equal hashes of id
and text stand for equal rows, of which the samples take one; features that tell equally much are taken by their number;
repeated and null ids are scored each; an empty table gives an empty result; clashing column names in docs are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, tidy
from loomgraph.llm.decontam import words
from loomgraph.storage import dropped, materialise

BITS = 20
PREFIXES = (4, 5, 6, 7, 8, 9)


class Settings(NamedTuple):
    most_positive: int = 3000
    most_unlabelled: int = 9000
    most_negative: int = 3000
    most_features: int = 20_000
    least_texts: int = 4
    models: int = 3
    epochs: int = 120
    rate: float = 0.05
    sparsity: float = 1.0
    seed: int = 7


def features_of(word: bytes) -> list[int]:
    """Feature ids of a word: itself and its shorter prefixes."""
    h = [xxhash.xxh3_64_intdigest(word, seed=1) >> (64 - BITS)]
    return h + [xxhash.xxh3_64_intdigest(word[:n], seed=2) >> (64 - BITS) for n in PREFIXES if n < len(word)]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature ids of a text."""
    return np.unique(np.fromiter((f for w in set(words(text)) for f in features_of(w)), np.uint32))


class Model(NamedTuple):
    weights: dict[int, float]
    bias: float
    slope: float
    shift: float

    def probability(self, g: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * g + self.shift, -40, 40)))


class Csr(NamedTuple):
    """Binary rows."""

    row: np.ndarray
    col: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], width)

    def take(self, keep: np.ndarray) -> Csr:
        new = np.cumsum(keep, dtype=np.int32) - 1
        on = keep[self.row]
        return Csr(new[self.row[on]], self.col[on], int(keep.sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Of the logits of positives and unlabelled texts: the positives' part of the risk, and the rest before it is cut at zero."""
    return float(prior * np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def nnpu(p: Csr, u: Csr, width: int, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss, full batches; a soft threshold after each step."""
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    share = (p.back(np.ones(p.n), width) + u.back(np.ones(u.n), width) + 1) / (p.n + u.n + 1)
    least = s.sparsity * prior * np.sqrt(share / p.n)  # of the size of the gradient's noise
    for t in range(1, s.epochs + 1):
        gp, gu = p.dot(theta[:-1]) + theta[-1], u.dot(theta[:-1]) + theta[-1]
        dp, du = _sigmoid(gp), _sigmoid(gu)  # of the loss as negatives
        if risk(gp, gu, prior)[1] >= 0:
            cp, cu = prior * (dp - 1) / p.n - prior * dp / p.n, du / u.n
        else:
            cp, cu = prior * dp / p.n, -du / u.n
        g = np.append(p.back(cp, width) + u.back(cu, width), cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = s.rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta -= step * (m / (1 - 0.9**t))
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - step[:-1] * least, 0)
    return theta[:-1], float(theta[-1])


#: Parts that a text can have in the fit.
POSITIVE, UNLABELLED, NEGATIVE = 1, 2, 4


def constant(prior: float) -> Model:
    level = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return Model({}, 0.0, 1.0, float(np.log(level / (1 - level))))


def chosen_features(f: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, s: Settings) -> np.ndarray:
    """Of features f in in_p of n_p positives and in_u of n_u unlabelled texts, the sorted ones that tell most about the sample."""
    share = (in_p + in_u) / (n_p + n_u)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        a, b = k / n, 1 - k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return n * (np.where(a > 0, a * np.log(a / share), 0) + np.where(b > 0, b * np.log(b / (1 - share)), 0))

    gain = part(in_p, n_p) + part(in_u, n_u)
    return np.sort(f[np.lexsort((f, -gain))[: s.most_features]])


def fit(sets: list[np.ndarray], part: np.ndarray, prior: float, s: Settings = Settings(), chosen: np.ndarray | None = None) -> Model:
    """sets: (chosen) features of each sampled text; part: sums of POSITIVE, UNLABELLED, NEGATIVE; chosen: sorted features."""
    pos, unl, neg = (part & x > 0 for x in (POSITIVE, UNLABELLED, NEGATIVE))
    if not pos.any() or not unl.any():
        return constant(prior)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    col = np.concatenate(sets)
    if chosen is None:
        f, at = np.unique(col, return_inverse=True)
        in_p, in_u = (np.bincount(at[on[row]], minlength=len(f)) for on in (pos, unl))
        on = in_p + in_u >= s.least_texts
        chosen = chosen_features(f[on], in_p[on], in_u[on], pos.sum(), unl.sum(), s)
    at = np.searchsorted(chosen, col)
    at[at == len(chosen)] = 0
    on = chosen[at] == col if len(chosen) else np.zeros(len(col), bool)
    x = Csr(row[on], at[on].astype(np.int32), len(sets))
    prior = float(np.clip(prior, 1e-4, 0.5))
    rng, w, bias = np.random.default_rng(s.seed), np.zeros(len(chosen)), 0.0
    for _ in range(s.models):
        half = unl & (rng.random(len(sets)) < (0.5 if unl.sum() >= 200 else 2))
        wi, bi = nnpu(x.take(pos), x.take(half), len(chosen), prior, s)
        w, bias = w + wi / s.models, bias + bi / s.models
    known = pos | neg
    slope, shift = _curve(x.dot(w)[known] + bias, pos[known], prior)
    return Model({int(f): float(v) for f, v in zip(chosen, w, strict=True) if v}, bias, slope, shift)


def _curve(g: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression on one variable by Newton's method, weighted to the prior; the identity where a class is missing."""
    if len(y) < 20 or y.all() or not y.any() or g.std() < 1e-9:
        return 1.0, 0.0
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    wt = np.where(y, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    mean, sd = g.mean(), g.std()
    x, ab = np.stack([(g - mean) / sd, np.ones_like(g)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(ab @ x)
        grad = x @ (wt * (p - t)) + 1e-3 * ab
        hess = (x * (wt * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if ab[0] <= 0:
        return 1.0, 0.0
    return float(ab[0] / sd), float(ab[1] - ab[0] * mean / sd)


class Weighted(dict):
    """word -> those of its features that have a weight; emptied when it has grown to 100,000 words."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        f = self[word] = tuple(x for x in features_of(word) if x in self.weights)
        return f


def logit(model: Model, known: Weighted, text: str | None) -> float:
    """As the fit sees a text: each distinct feature once."""
    return model.bias + sum(map(model.weights.__getitem__, set().union(*map(known.__getitem__, set(words(text))))))


def learn_rows(id_col: Column) -> Column:
    """The contract's training rows: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on a sample that is bounded by s."""
    spark = docs.sparkSession
    lab = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn_rows(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    prior = lab.agg(F.avg("y")).first()[0] or 0.0
    base = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter(F.col("id").isNotNull() & learn_rows(F.col("id"))).withColumn("h", F.xxhash64("id", "t"))
    # only ids and hashes are shuffled; the sample, bounded by s, is then looked up in a second scan
    keyed = base.select("id", "h").join(lab.withColumnRenamed("doc_id", "id"), "id", "left")
    first = lambda rows, most, part: rows.orderBy("h").limit(most).select("id", "h", F.lit(part).alias("part"))
    taken = first(keyed.filter("y = 1"), s.most_positive, POSITIVE).unionByName(first(keyed, s.most_unlabelled, UNLABELLED)).unionByName(first(keyed.filter("y = 0"), s.most_negative, NEGATIVE))
    sample = materialise(taken.groupBy("id", "h").agg(F.bit_or("part").alias("part")), "sample")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([features(t.as_py()).view(np.int32) for t in b.column("t")], pa.list_(pa.int32()))], ["part", "f"])

    rows = base.join(F.broadcast(sample), ["id", "h"]).dropDuplicates(["id", "h"]).select("part", "t").mapInArrow(tidy(featured), "part int, f array<int>")
    rows = materialise(rows, "features")
    n_p, n_u = (rows.filter(F.col("part").bitwiseAND(x) > 0).count() for x in (POSITIVE, UNLABELLED))
    if not n_p or not n_u:
        return constant(prior)
    of = lambda x: F.sum((F.col("part").bitwiseAND(x) > 0).cast("int"))
    counts = rows.select("part", F.explode("f").alias("f")).groupBy("f").agg(of(POSITIVE).alias("p"), of(UNLABELLED).alias("u")).filter(F.col("p") + F.col("u") >= s.least_texts)
    got = counts.toArrow()  # 2 ** BITS rows at most
    f, in_p, in_u = (got.column(c).to_numpy() for c in "fpu")
    chosen = chosen_features(f.astype(np.uint32), in_p, in_u, n_p, n_u, s)
    shared = spark.sparkContext.broadcast(chosen)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            on = [np.flatnonzero(np.isin(shared.value, x.values.to_numpy().view(np.uint32))).astype("<u4").tobytes() for x in b.column("f")]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(on, pa.binary())], ["part", "on"])

    got = rows.mapInArrow(tidy(picked), "part int, on binary").toArrow()
    model = fit([chosen[np.frombuffer(x.as_buffer(), "<u4")] for x in got.column("on")], got.column("part").to_numpy(), prior, s, chosen)
    dropped(sample, rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(_scores(shared)), f"doc_id {kind}, score double")


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Weighted(model)
        for b in slices(batches):
            g = np.array([logit(model, known, t.as_py()) for t in b.column("t")])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.probability(g), pa.float64())], ["doc_id", "score"])

    return run


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, whose score is below threshold: one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Weighted(model)
        for b in slices(batches):
            g = np.array([logit(model, known, t.as_py()) for t in b.column("text")])
            yield b.filter(pa.array(model.probability(g) < threshold, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
