"""Quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: a linear model that minimises the non-negative unbiased risk

    prior * mean loss(positives, +) + max(0, mean loss(unlabelled, -) - prior * mean loss(positives, -))

with logistic loss, so that its sigmoid estimates the probability of the positive class. Rows labelled 0 are not used. The
prior, the positive share of unlabelled text, is estimated first: of a plain classifier of positives against unlabelled
text, the best bin is the top score range in which the share of unlabelled text is least beside that of positives held
back, with an allowance for chance; their ratio is the prior.

Both samples are bounded (POSITIVES and UNLABELLED rows, taken by a hash of the id), so the fit is on the driver. All
documents are scored. A score depends on the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._classes import CAPITAL, CLASSES, SPACE, SYMBOL, classes
from ._shared import carried, fold, ship
from ._text import runs, utf8
from .rules import base_counts

POSITIVES, UNLABELLED = 8000, 12000
PAIRS = 512
#: Shares of a text that are cut into steps: the model is linear, their effect need not be.
SHARES, STEPS = 8, 12
WIDTH = CLASSES + PAIRS + SHARES * STEPS + 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each text: roots of the shares of character classes and of hashed pairs of classes, and steps."""
    n = len(offsets) - 1
    kinds, at = classes(data, offsets)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, WIDTH), np.float32)
    one = np.bincount(owner * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    pair = (kinds[:-1].astype(np.int64) * 40503 + kinds[1:].astype(np.int64) * 30011) % PAIRS
    inside = owner[1:] == owner[:-1]
    two = np.bincount(owner[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    chars = np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.sqrt(one / chars)
    out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(two / chars)
    words, word_chars, symbols, dup_lines, repeat, echo = base_counts(data, offsets)
    some = np.maximum(words, 1)
    breaks = np.bincount(owner[1:][inside & (kinds[1:] == kinds[:-1]) & (kinds[1:] != SPACE)], minlength=n)
    shares = [
        repeat / some,
        echo / some,
        symbols / some,
        one[:, CAPITAL] / chars[:, 0] * 2,
        dup_lines / some * 5,
        breaks / chars[:, 0] * 2,
        word_chars / some / 20,
        np.log2(some) / 16,
    ]
    for k, x in enumerate(shares):
        step = np.clip((np.sqrt(x) * STEPS).astype(int), 0, STEPS - 1)
        out[np.arange(n), CLASSES + PAIRS + k * STEPS + step] = 0.5
    out[:, -1] = 1
    return out


def sampled_features(docs: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """The features of each named group, from rows of (grp, id, text). For bounded samples only."""

    def of(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in runs(offsets):
                rows = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in rows], pa.binary())], ["grp", "id", "x"])

    got = docs.mapInArrow(of, "grp string, id long, x binary").toArrow().sort_by([("grp", "ascending"), ("id", "ascending"), ("x", "ascending")])
    group = np.array(got["grp"].to_pylist(), object)
    rows = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return {g: rows[group == g] if len(group) else np.zeros((0, WIDTH), np.float32) for g in names}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, n: int, rate: float):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.w -= self.rate * self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _batches(p: np.ndarray, u: np.ndarray, epochs: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        i, j = rng.permutation(len(p)), rng.permutation(len(u))
        count = max(1, -(-len(u) // size))
        for a, b in zip(np.array_split(i, count), np.array_split(j, count)):
            if len(a) and len(b):
                yield p[a], u[b]


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 0) -> float:
    """Share of positives in u, by the best bin. Half of each sample trains the classifier that ranks, half is ranked."""
    model = Adam(p.shape[1], 0.02)
    for a, b in _batches(p[::2], u[::2], 15, 512, seed):
        model.step(-(a.T @ (1 - sigmoid(a @ model.w))) / len(a) / 2 + b.T @ sigmoid(b @ model.w) / len(b) / 2 + 1e-4 * model.w)
    sp, su = np.sort(p[1::2] @ model.w), np.sort(u[1::2] @ model.w)
    if not len(sp) or not len(su):
        return 0.5
    at = np.quantile(sp, np.linspace(0, 0.95, 200))
    share_p, share_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = int(np.argmin((share_u + slack) / np.maximum(share_p, 1e-9)))
    return float(np.clip(share_u[best] / max(share_p[best], 1e-9), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights that minimise the non-negative risk. While the estimated negative risk is below zero, only its negative is descended."""
    model = Adam(p.shape[1], 0.02)
    total = epochs * max(1, -(-len(u) // 512))
    for a, b in _batches(p, u, epochs, 512, seed):
        model.rate = 0.02 * (1 - 0.95 * model.t / max(total, 1))
        sp, su = sigmoid(a @ model.w), sigmoid(b @ model.w)
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        of_negative = b.T @ su / len(b) - prior * (a.T @ sp) / len(a)
        if negative < 0:
            g = -of_negative
        else:
            g = of_negative - prior * (a.T @ (1 - sp)) / len(a)
        model.step(g + 1e-5 * model.w)
    return model.w


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> tuple[np.ndarray, float]:
    """Weights and prior, from documents and labels outside the held-out fold."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where(fold("id", folds) != held_out)
    good = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality = 1").select("id").where(fold("id", folds) != held_out).distinct()

    def part(df: DataFrame, most: int, salt: int) -> DataFrame:
        """Rows whose hash is small, about `most` of them, or all rows where there are no more."""
        whole = df.count()
        return df if whole <= most else df.where(F.expr(f"pmod(xxhash64(id, {salt}), 1000000)") < int(1_000_000 * most / whole))

    positive = docs.join(part(good, POSITIVES, 11), "id", "left_semi").select(F.lit("p").alias("grp"), "id", "text")
    unlabelled = part(docs, UNLABELLED, 12).select(F.lit("u").alias("grp"), "id", "text")
    found = sampled_features(positive.unionByName(unlabelled), ["p", "u"])
    if not len(found["p"]) or not len(found["u"]):
        return np.zeros(WIDTH), 0.5
    prior = estimate_prior(found["p"], found["u"])
    return fit(found["p"], found["u"], prior), prior


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Null and empty texts have the features of no characters and get a score like any other. Without positives or without
    documents to learn from, every score is 0.5. Repeated rows stay rows; repeated labels count once, labels of unknown
    documents not at all. Extra columns are ignored, but with `carry` each row has its text and a `row` of all else.
    """
    weights, _ = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # WIDTH numbers

    def of(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in runs(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, *more = (batch.column(i).slice(lo, hi - lo) for i in (0, *kept))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sigmoid(x.astype(np.float64) @ shared.value)), *more], ["doc_id", "score", *extra])

    extra, kept = (["text", "row"], (1, 2)) if carry else ([], ())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([carried(docs)] if carry else []))
    scored = rows.mapInArrow(of, S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("score", S.DoubleType()), *(rows.schema[c] for c in extra)]))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *extra)
