"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are examples of a class; all other texts are unlabelled, toxic ones among
them. The risk of a classifier g is estimated as prior * R(toxic texts as toxic) + max(0, R(unlabelled as
clean) - prior * R(toxic as clean)): what toxic texts among the unlabelled add to their risk is taken
off, and where that goes below zero, the step climbs back (Kiryo et al., 2017). Several linear
classifiers, each on its own part of the unlabelled texts, give the mean of their logits.

Features are the presence, anywhere in the text, of lower-cased words (runs of letters) and of words'
first three to six bytes, as hashes. Those that mark toxic texts of the sample beyond chance are kept, so that
long clean texts don't add up many small weights.

Defined cases: null and empty texts have no features and score what a text without them does, below 0.5;
very long texts are read whole; repeated rows score alike; a doc_id that labels name repeatedly is toxic
if one row says so; rows without a doc_id have no label; without confirmed toxic texts every score is
0; an empty table gives no rows; score() carries other columns, and its own columns replace those of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.shared import places, runs_of_texts, small_batches, word_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    """positives and unlabelled bound the rows that are fitted: about so many, chosen by hash, twice as many at most."""

    positives: int = 3000
    unlabelled: int = 6000
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    #: A feature is kept if so many toxic texts have it, if it is so many times as frequent in them as in clean
    #: ones, if chance would do that once in exp(evidence) features, and if unlabelled texts have at least this
    #: share of the cases that their toxic texts alone should bring.
    least: int = 3
    lift: float = 4.0
    evidence: float = 8.0
    share: float = 0.5
    features: int = 20_000
    classifiers: int = 3
    rounds: int = 400
    rate: float = 0.05
    #: Weights are held back by this over the number of toxic texts, by most_decay at most.
    decay: float = 0.35
    most_decay: float = 1e-3
    #: The share of toxic texts; None: that of the labelled rows, or, if those are all toxic, 0.1.
    prior: float | None = None
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Sorted hashes of the kept features, their weights and the bias; all of bounded size."""

    settings: Settings
    keys: np.ndarray
    weights: np.ndarray
    bias: float | None
    prior: float


def _features(texts: list[str | None], s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, number of the text in the run, 64-bit feature) of runs of texts; features may repeat."""
    for first, end, data, offsets in runs_of_texts(texts):
        solid = _LETTER[data]
        starts, whole = word_hashes(data, solid)
        which = np.searchsorted(offsets, starts, side="right") - 1
        low = _LOWER[data].astype(np.uint64)
        texts_, found = [which], [whole]
        for n in s.prefixes:
            at = starts[starts <= len(data) - n]
            code = np.full(len(at), n, np.uint64)
            inside = np.ones(len(at), bool)
            for k in range(n):
                code = (code << np.uint64(8)) | low[at + k]
                inside &= solid[at + k]
            texts_.append(which[: len(at)][inside])
            found.append(code[inside])  # below 2**56, where a word's hash is with a chance of 1 in 256 and then of 2**-48
        yield first, np.concatenate(texts_), np.concatenate(found)


def _sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """About n rows, chosen by a hash of their values; 2 n at most."""
    share = min(1.0, n / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).limit(2 * n)


def _vectors(texts: DataFrame, s: Settings) -> list[np.ndarray]:
    """The distinct features of each text of a bounded sample, in an order that doesn't depend on tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, which, found in _features(b.column("text").to_pylist(), s):
                order = np.lexsort((found, which))
                which, found = which[order], found[order]
                keep = np.concatenate([[True], (which[1:] != which[:-1]) | (found[1:] != found[:-1])]) if len(which) else np.zeros(0, bool)
                which, found = which[keep], found[keep]
                cuts = np.flatnonzero(np.diff(which, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(found, cuts[1:])] if len(cuts) else [], pa.binary())], names=["f"])

    got = texts.select("text").mapInArrow(run, "f binary").toArrow().column("f").to_pylist()
    return [np.frombuffer(x, np.uint64) for x in sorted(got)]


def _kept(toxic: list[np.ndarray], other: list[np.ndarray], prior: float, s: Settings) -> np.ndarray:
    """The features that mark toxic texts, the most frequent ones if there are many.

    What clean texts have is what unlabelled ones have less what toxic ones among them should.
    """
    keys, n = np.unique(np.concatenate(toxic), return_counts=True)
    keys, n = keys[n >= s.least], n[n >= s.least]
    m = np.zeros(len(keys), np.int64)
    for v in other:
        at = places(keys, v)
        m[at[at >= 0]] += 1
    theirs = prior * n / len(toxic) * len(other)
    clean = np.maximum(m - theirs, 1 - prior) / ((1 - prior) * len(other))
    by_chance = len(toxic) * clean
    evidence = n * np.log(n / by_chance) - (n - by_chance)  # of Poisson's tail
    good = (n >= s.lift * by_chance) & (evidence >= s.evidence) & (m >= s.share * theirs)
    keys, n = keys[good], n[good]
    return np.sort(keys[np.argsort(-n, kind="stable")[: s.features]])


def _columns(vectors: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The places of each text's kept features; the others are let go text by text."""
    return [at[at >= 0] for at in (places(keys, v) for v in vectors)]


def _rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of a sparse matrix of presences, and its number of rows."""
    return np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate([np.zeros(0, np.int64), *columns]), len(columns)


def _train(p: tuple, u: tuple, n: int, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    logits = lambda x: np.bincount(x[0], w[x[1]], x[2]) + w[n]
    down = lambda x, g: np.append(np.bincount(x[1], g[x[0]], n), g.sum())
    for i in range(1, s.rounds + 1):
        gp, gu = logits(p), logits(u)
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_clean = down(u, sigmoid(gu)) / u[2] - prior * down(p, sigmoid(gp)) / p[2]
        grad = prior * down(p, sigmoid(gp) - 1) / p[2] + as_clean if clean >= 0 else -as_clean
        grad[:n] += min(s.most_decay, s.decay / p[2]) * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= s.rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on the texts of docs(doc_id, text) that labels(doc_id, toxic) confirms, and on unlabelled ones.

    docs are those that may be learned from. Sampled features alone come to the driver.
    """
    s = settings
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    n = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not n["toxic"]:
        return Model(s, np.zeros(0, np.uint64), np.zeros(0), None, 0.0)
    prior = s.prior or (n["toxic"] / n["n"] if n["toxic"] < n["n"] else 0.1)
    prior = min(0.9, max(1e-3, prior))
    confirmed = F.broadcast(_sample(known.where("toxic = 1").select("doc_id"), s.positives, s.seed))  # twice positives at most
    toxic = _vectors(docs.where("text is not null").join(confirmed, "doc_id").limit(2 * s.positives), s)
    other = _vectors(_sample(docs.where("text is not null").select("doc_id", "text"), s.unlabelled, s.seed), s)
    if not toxic or not other:
        return Model(s, np.zeros(0, np.uint64), np.zeros(0), None, prior)
    keys = _kept(toxic, other, prior, s)
    p, u = _rows(_columns(toxic, keys)), _columns(other, keys)
    order = np.random.default_rng(s.seed).permutation(len(u))
    found = [_train(p, _rows([u[i] for i in order[k :: s.classifiers]] or u), len(keys), prior, s) for k in range(s.classifiers)]
    return Model(s, keys, np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found])), prior)


def predict(texts: list[str | None], model: Model) -> np.ndarray:
    """The score, 0 to 1, of each text."""
    if model.bias is None:
        return np.zeros(len(texts))
    total, size = np.full(len(texts), model.bias), len(model.keys)
    for first, which, found in _features(texts, model.settings):
        at = places(model.keys, found)
        pairs = np.unique(which[at >= 0] * size + at[at >= 0])  # a feature counts once in a text
        np.add.at(total, first + pairs // max(1, size), model.weights[pairs % max(1, size)])
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted. The model has a bounded size and goes with the tasks."""
    carried = docs.drop("score", "predicted")
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    names = [f.name for f in carried.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = predict(b.column(names.index(text)).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.float64()), pa.array((x >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return carried.mapInArrow(run, f"{kinds}, score double, predicted int")


def held_out(key: Column) -> Column:
    """Rows that the contract keeps from training."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
