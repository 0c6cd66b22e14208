"""Approximate nearest neighbours by adaptive dimension scan inside probed lists.

Vectors are dealt to the lists of a k-means fitted on a bounded sample; a query probes the lists with
the nearest centers. In a list, vectors and queries are rotated at random and compared in blocks of
columns: after each block a candidate is abandoned if its partial distance, scaled up, exceeds the best
k so far by more than a hypothesis test allows. Survivors get their exact distance on the original vectors.
The nearest list of a query is searched first; its k-th distance is the bound with which all others begin.
A list with more than `part_rows` vectors is split into parts, its queries into blocks, that are searched apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_share, staged

BLOCK = 16


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows that take part: an id, and a vector of finite numbers that is not zero,
    of the most frequent length (the larger on a tie)."""
    v = F.col(vector).cast("array<double>")
    good = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
            .filter("vec_id is not null and vector is not null")
            .filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)))
    width = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.filter(F.size("vector") == (width["d"] if width else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T - 0.5 * (centers ** 2).sum(axis=1)).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        found, begins = np.unique(nearest[order], return_index=True)
        centers = centers.copy()
        centers[found] = np.add.reduceat(x[order], begins) / np.diff(np.append(begins, len(x)))[:, None]
    return centers


def rotation(width: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, epsilon: float,
         turn: np.ndarray, bounds: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query, row of vectors, distance) of the k nearest survivors of each query, none beyond its bound (a distance)."""
    a, b = queries @ turn, vectors @ turn
    width, out = vectors.shape[1], []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != own[q])
        if not len(alive):
            continue
        # The bound starts from the candidates that lead after the first block.
        part = ((b[alive, :BLOCK] - a[q, :BLOCK]) ** 2).sum(axis=1)
        lead = alive[np.argpartition(part, min(k, len(alive)) - 1)[:k]]
        bound = ((b[lead] - a[q]) ** 2).sum(axis=1).max() if len(alive) > k else np.inf
        if bounds is not None:
            bound = min(bound, bounds[q] ** 2 + 1e-12 * (a[q] @ a[q]))  # rotating rounds
        done = min(BLOCK, width)
        while True:
            stay = part * (width / done) <= bound * (1 + epsilon / np.sqrt(done)) ** 2 if done < width else part <= bound * (1 + 1e-9)
            alive, part = alive[stay], part[stay]
            if done >= width:
                break
            to = min(done + BLOCK, width)
            part = part + ((b[alive, done:to] - a[q, done:to]) ** 2).sum(axis=1)
            done = to
        exact = np.sqrt(((vectors[alive] - queries[q]) ** 2).sum(axis=1))
        best = np.lexsort((ids[alive], exact))[:k]
        out += [(q, int(alive[j]), float(exact[j])) for j in best]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probe_share: float = 0.6,
            sample_rows: int = 20_000, part_rows: int = 20_000, block_rows: int = 20_000, epsilon: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by Euclidean distance.

    `rows` and `queries` are (vec_id, vector) as from `usable`; a row is no candidate for a query of its own id.
    Ties go to the smaller vec_id. Fewer than k candidates give fewer rows, an empty table none. The lists are
    fitted on about `sample_rows` rows; every row is indexed. Repeated rows are candidates each. Query rows of one
    vec_id and vector are one query; of one vec_id and different vectors, each is a query with ranks of its own.
    """
    rows = staged(rows, "vectors")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = lists or max(1, int(np.sqrt(n)))
    sample = _matrix(rows.filter(bounded_share(n, sample_rows, F.col("vec_id"))).orderBy("vec_id", "vector").toPandas()["vector"])
    if not len(sample):
        sample = _matrix(rows.orderBy("vec_id", "vector").limit(1).toPandas()["vector"])
    centers = kmeans(sample, min(lists, len(sample)))
    turn = rotation(sample.shape[1])
    probes = max(1, int(np.ceil(len(centers) * probe_share)))

    def assigned(frames, width: int):
        for batch in frames:
            x = _matrix(batch.column("vector").to_pandas())
            if not len(x):
                continue
            gap = 0.5 * (centers ** 2).sum(axis=1) - x @ centers.T
            chosen = np.argsort(gap, axis=1, kind="stable")[:, :width] if width > 1 else gap.argmin(axis=1)[:, None]
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(chosen.ravel().astype(np.int32)))
            yield batch.append_column("lists", column)

    with_lists = "vec_id long, vector array<double>, lists array<int>"
    indexed = staged(rows.mapInArrow(lambda b: assigned(b, 1), with_lists).select("vec_id", "vector", F.col("lists")[0].alias("list")), "ann-index")
    parts = indexed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    base = (indexed.join(F.broadcast(parts), "list")  # one row per list, and lists are bounded by the sample
            .withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int")).drop("parts"))
    wanted = staged(queries.dropDuplicates(["vec_id", "vector"]), "ann-queries")
    blocks = max(1, -(-wanted.count() // block_rows))
    asked = staged(wanted.mapInArrow(lambda b: assigned(b, probes), with_lists).withColumn("key", F.monotonically_increasing_id())
                   .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
                   .select("key", "block", F.col("vec_id").alias("query_id"), "vector", F.posexplode("lists").alias("place", "list")), "ann-probes")
    schema = "key long, query_id long, vec_id long, score double"
    found_empty = pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []}).astype({"key": "int64", "query_id": "int64", "vec_id": "int64"})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return found_empty
        own, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        found = scan(_matrix(left["vector"]), own, _matrix(right["vector"]), ids, k, epsilon, turn, left["bound"].to_numpy())
        q, r, d = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        return pd.DataFrame({"key": left["key"].to_numpy()[q], "query_id": own[q], "vec_id": ids[r], "score": d.astype(np.float64)})

    where = ["list", "part", "block"]
    spread = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(probing: DataFrame) -> DataFrame:
        placed = probing.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return placed.groupBy(*where).cogroup(spread.groupBy(*where)).applyInPandas(search, schema)

    order = Window.partitionBy("key").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)

    first = staged(ranked(searched(asked.filter("place = 0").withColumn("bound", F.lit(float("inf"))))), "ann-nearest-lists")
    # Beyond the k-th distance found there nothing can be among the k nearest; ties with it can.
    reached = first.filter(F.col("rank") == k).select("key", (F.col("score") * (1 + 1e-9)).alias("bound"))
    rest = asked.filter("place > 0").join(reached, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return ranked(first.drop("rank").unionByName(searched(rest))).select("query_id", "rank", "vec_id", "score")
