"""Quality by Bradley-Terry ranking.

The chance that one document is preferred to another is the logistic function of their score difference.
Scores are linear in text statistics; the weights come from preference pairs (a good document over a poor
one) by logistic loss on feature differences. The score at a quantile of the training documents is the
threshold, which the curve puts at 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, is_fold, map_slices

# Byte classes: 0 other sign, 1 blank, 2 lower letter or part of one above ASCII, 3 upper, 4 digit, 5 plain punctuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
N_FEATURES = 19


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text and of its worst line; zeros for an empty text."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    count = np.bincount(kind, minlength=6)
    n, chars = len(words), max(1, len(raw) - count[1])
    letters = max(1, count[2] + count[3])
    out[:6] = np.log1p(n), chars / n, count[0] / chars, count[3] / letters, count[4] / chars, count[5] / n
    for k, sign in enumerate(b"!|#"):
        out[6 + k] = data.count(sign) / n
    repeats = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, n - 1)
    out[9] = repeats.mean() if n > 1 else 0.0
    blocks = [words[a:a + 50] for a in range(0, n, 50)]
    fresh = [len(set(b)) / len(b) for b in blocks if len(b) >= 20]
    out[10] = 1 - np.mean(fresh) if fresh else 0.0
    out[11] = 1 - min(fresh) if fresh else 0.0
    lines = data.split(b"\n")
    out[12] = 1 - len(set(lines)) / len(lines)
    out[13] = np.log1p(n / len(lines))
    # The line with most signs, most capitals, and most repeats, among lines of 40 bytes or more.
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    long = ends - starts >= 40
    if long.any():
        size = (ends - starts)[long]
        total = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (0, 3)]
        worst = [((t[ends] - t[starts])[long] / size).max() for t in total]
        out[14], out[15] = worst
    out[16] = np.mean([len(w) <= 3 for w in words])
    out[17] = repeats[-50:].mean() if n > 1 else 0.0
    out[18] = max((np.mean(repeats[a:a + 50]) for a in range(0, n - 1, 50)), default=0.0)
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Statistics and their square roots: small shares matter."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


@dataclass
class QualityModel:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expanded(x) - self.middle) / self.spread, -8, 8) @ self.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = (self.raw(np.array([features(t) for t in texts])) - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(good: np.ndarray, poor: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of the logistic loss on feature differences of preferred and other documents, by Newton steps."""
    x = good - poor
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, pairs: int = 60_000, seed: int = 5) -> QualityModel:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1.

    About `train_rows` of them at most are used, chosen by a hash of the id, and `pairs` preference pairs of
    them. Without both kinds of labels nothing is learned: every score is 0.5.
    """
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
              .filter("doc_id is not null and label in (0, 1)").filter(~is_fold("doc_id", 3, 1)))
    chosen = bounded_share(marked.count(), train_rows, F.col("doc_id"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .filter(chosen).join(marked.filter(chosen), "doc_id"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), values, batch.column("label")], ["doc_id", "x", "label"])

    found = map_slices(rows, "text", work, "doc_id long, x array<double>, label int").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = expanded(np.stack(found["x"].to_numpy())) if len(found) else np.zeros((0, 2 * N_FEATURES))
    y = found["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return QualityModel(np.zeros(2 * N_FEATURES), np.ones(2 * N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, 1.0)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - middle) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    good, poor = (rng.choice(np.flatnonzero(y == k), pairs) for k in (1, 0))
    weights = bradley_terry(z[good], z[poor])
    raw = np.sort(z @ weights)
    order = np.argsort(z @ weights, kind="stable")
    # Balanced: each kind counts half. The quantile that separates best, its score half way to the next.
    miss_good = np.concatenate([[0], np.cumsum(y[order] == 1)]) / (y == 1).sum()
    miss_poor = 1 - np.concatenate([[0], np.cumsum(y[order] == 0)]) / (y == 0).sum()
    quantile = int((miss_good + miss_poor).argmin())
    below, above = raw[max(quantile - 1, 0)], raw[min(quantile, len(raw) - 1)]
    return QualityModel(middle, spread, weights, float((below + above) / 2), float(raw.std() / 4 + 1e-9))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; null and blank texts have one score."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.scores(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, "text", work, "doc_id long, score double")
