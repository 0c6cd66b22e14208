"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character 1- to 3-grams, scaled to length one. Each language has
several centroids, clustered by spherical k-means from a bounded sample of its documents. The nearest
centroid by cosine gives the language; a text further than `reject` from all of them is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_fold, slices, staged

DIMENSIONS = 4096
CHUNK, CHUNK_ROWS = 1 << 20, 512


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def gram_matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1- to 3-grams of letters and blanks per text, and the number of letters per text."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 2 for t in lowered])
    row = np.repeat(np.arange(len(texts)), lengths)
    letter = letter_table()[codes]
    letters = np.bincount(row, letter, len(texts))
    keep = letter | np.concatenate([[True], letter[:-1]])  # one blank for each run of others
    x, row = np.where(letter, codes, 32)[keep].astype(np.uint64), row[keep]
    counts = np.zeros(len(texts) * DIMENSIONS)
    key = np.zeros(len(x), np.uint64)
    for n in range(1, 4):
        key = key[:len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1:] + np.uint64(n)
        mixed = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed >> np.uint64(52)).astype(np.int64)
        whole = row[:len(at)] == row[n - 1:]
        counts += np.bincount((row[:len(at)] * DIMENSIONS + at)[whole], minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS), letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = (np.log1p(counts) * idf).astype(np.float32)
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        centers = np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centers: np.ndarray
    reject: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1 and rejection of each text; und, 0 and true for a text without letters."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        counts, letters = gram_matrix(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.centers.T
        best = cosine.argmax(axis=1)
        none = letters == 0
        score = np.where(none, 0.0, np.clip(cosine[np.arange(len(texts)), best], 0, 1)).astype(np.float64)
        names = ["und" if empty else self.languages[b] for empty, b in zip(none, best)]
        return names, score, none | (1 - score > self.reject)


def fit(docs: DataFrame, per_language: int = 400, clusters: int = 3, reject: float = 0.9) -> LanguageModel:
    """Learn from documents with text and lang whose crc32(doc_id) mod 3 is not 1.

    Document frequencies come from all of these; centroids from about `per_language` documents of each
    language, chosen by a hash of the id. Without any, every text is und.
    """
    known = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
             .filter("text is not null and lang is not null").filter(~is_fold("doc_id", 3, 1)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK, CHUNK_ROWS):
                counts, _ = gram_matrix(part.column("text").to_pylist())
                total += (counts > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.append(n, total))], ["gram", "n"])

    counted = (known.select("text").mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    seen = np.zeros(DIMENSIONS + 1)
    seen[counted["gram"].to_numpy() + 1] = counted["n"].to_numpy()
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    # Written first, so that its size is known and texts are not dealt out by language.
    sizes = staged(known.groupBy("lang").count(), "language-sizes")
    share = F.lit(float(1 << 30) * per_language) / F.col("count")
    sample = (known.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share)
              .select("lang", "text"))

    def embed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(gram_matrix(batch.column("text").to_pylist())[0], idf)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * DIMENSIONS, pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("lang"), values], ["lang", "vector"])

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        centers = spherical_kmeans(np.stack(frame["vector"].to_numpy()), clusters)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "center": [c.astype(np.float32) for c in centers]})

    def run_embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK, CHUNK_ROWS):
                yield embed(part)

    found = (sample.mapInArrow(run_embed, "lang string, vector array<float>").groupBy("lang")
             .applyInPandas(cluster, "lang string, center array<float>").toPandas().sort_values("lang", kind="stable"))
    centers = np.stack(found["center"].to_numpy()) if len(found) else np.zeros((0, DIMENSIONS))
    return LanguageModel(idf, found["lang"].tolist(), centers.astype(np.float32), reject)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from its whole text alone."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, values, far = model.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(values, pa.float64()),
                                           pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK, CHUNK_ROWS):
                yield work(part)

    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
