"""Language identification by the nearest of several centroids for each language.

Features are hashed byte n-grams of the lower-cased text, weighted by 1 + log(count) and inverse
document frequency, of unit length. Spherical k-means gives each language several centroids; the
language of the nearest (by cosine) is predicted, and a text further from it than any training
text of that cluster was, by a wide margin, is rejected.

Defined cases: a null text, or one without letters, gets the language "und", score 0 and is
rejected; very long texts are read whole; repeated rows are predicted alike; an empty table, or
one without labelled rows, gives "und" for every row; other columns are carried through by
identify(), whose own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.shared import chunked, mapped, runs_of_texts, small_batches

UNKNOWN = "und"
#: Texts whose features are held at a time.
_ROWS = 256
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48


@dataclass(frozen=True)
class Settings:
    """per_language bounds the labelled rows that are fitted: about so many for each language.

    most_rows bounds them for all languages together, and most_labels the languages.
    """

    dimensions: int = 4096
    sizes: tuple[int, ...] = (2, 3)
    per_language: int = 400
    most_rows: int = 8000
    most_labels: int = 1000
    clusters: int = 3
    rounds: int = 8
    #: A text is rejected below this share of the lowest cosine in its cluster's training texts.
    slack: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """weights: inverse document frequencies; centroids: one row each; floors: least cosine."""

    settings: Settings
    weights: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    floors: np.ndarray


def _counts(texts: list[str | None], s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first text, matrix of feature counts) for runs of texts."""
    for first, end, data, offsets in runs_of_texts(texts, most=_ROWS):
        b = _FOLD[data]  # n-grams end with the line feed behind their text
        n, parts = end - first, []
        for size in s.sizes:
            if len(b) < size:
                continue
            code = b[: len(b) - size + 1].copy()
            for k in range(1, size):
                code = code * np.uint32(257) + b[k : len(b) - size + 1 + k]
            code = ((code + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(15)
            parts.append((size, code % np.uint32(s.dimensions)))
        out = np.zeros((n, s.dimensions), np.float32)
        for i in range(n):
            a, z = offsets[i], offsets[i + 1]
            for size, part in parts:
                out[i] += np.bincount(part[a : max(a, z - size + 1)], minlength=s.dimensions)
        yield first, out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * weights)


def fit(labelled: DataFrame, text: str, label: str, key: str, settings: Settings = Settings()) -> Model:
    """Fits the centroids on about per_language rows of each language, chosen by a hash of key.

    With many languages it is fewer rows of each, most_rows in all; more than most_labels distinct
    labels are an error. So what reaches the driver is bounded.
    """
    s = settings
    small_batches(labelled.sparkSession)
    named = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = named.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(s.most_labels + 1).collect()
    if len(counts) > s.most_labels:
        raise ValueError(f"{label} has more than {s.most_labels} values, so they are no languages")
    each = min(s.per_language, s.most_rows / max(1, len(counts)))
    shares = {r[label]: min(1.0, each / r["n"]) for r in counts}
    if not shares:
        return Model(s, np.ones(s.dimensions, np.float32), np.zeros((0, s.dimensions), np.float32), (), np.zeros(0))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col(label)]
    chosen = named.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(s.seed)), F.lit(1_000_000)) < share * 1_000_000)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["t"].tolist()
            for first, m in _counts(texts, s):
                at = [np.flatnonzero(row).astype(np.int32) for row in m]
                some = frame.iloc[first : first + len(m)]
                yield pd.DataFrame({"l": some["l"].tolist(), "k": some["k"].astype(str).tolist(), "at": at, "n": [row[a] for row, a in zip(m, at, strict=True)]})

    got = chosen.select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"), F.col(key).cast("string").alias("k")).mapInPandas(features, "l string, k string, at array<int>, n array<float>").toPandas()
    got = got.sort_values(["l", "k"], kind="stable").reset_index(drop=True)
    counts = np.zeros((len(got), s.dimensions), np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[i, at] = n
    weights = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors, rng = _vectors(counts, weights), np.random.default_rng(s.seed)
    centroids, languages, floors = [], [], []
    for language in sorted(got["l"].unique()):
        v = vectors[(got["l"] == language).to_numpy()]
        c = v[rng.permutation(len(v))[: min(s.clusters, len(v))]]
        for _ in range(s.rounds):
            near = (v @ c.T).argmax(axis=1)
            c = _unit(np.stack([v[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))]))
        cosine = v @ c.T
        near = cosine.argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                centroids.append(c[k])
                languages.append(language)
                floors.append(s.slack * cosine[near == k, k].min())
    return Model(s, weights, np.stack(centroids), tuple(languages), np.array(floors))


def predict(texts: list[str | None], model: Model) -> pd.DataFrame:
    """lang_pred, score (the cosine, 0 to 1) and rejected of each text."""
    n = len(texts)
    names = np.full(n, UNKNOWN, object)
    score, rejected = np.zeros(n), np.ones(n, bool)
    if len(model.languages):
        for first, counts in _counts(texts, model.settings):
            cosine = _vectors(counts, model.weights) @ model.centroids.T
            near = cosine.argmax(axis=1)
            best = cosine[np.arange(len(near)), near]
            for i in range(len(near)):
                t = texts[first + i]
                if t is not None and any(map(str.isalpha, t)):
                    names[first + i] = model.languages[near[i]]
                    score[first + i] = min(1.0, max(0.0, float(best[i])))
                    rejected[first + i] = best[i] < model.floors[near[i]]
    return pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected. The model has a fixed size and goes with the task."""
    carried = docs.drop("lang_pred", "score", "rejected")
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunked(frames, text, 1_000_000):
            yield pd.concat([frame, predict(frame[text].tolist(), held.value)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return mapped(carried, run, f"{kinds}, lang_pred string, score double, rejected boolean")


def held_out(key: Column) -> Column:
    """Rows that the contract keeps from training."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")), "text", "lang", "doc_id")
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
