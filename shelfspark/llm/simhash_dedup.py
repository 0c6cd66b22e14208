"""Near-duplicates by SimHash fingerprints and a binary-trie self-join.

Fingerprints of equal documents meet first, so copies never form pairs. Distinct fingerprints are
cut into m blocks; two that differ in at most `budget` bits agree on some m - budget blocks, so
each choice of that many blocks is one forest of tries whose first levels are walked by a shuffle
on the block values (zero errors there). Below, node pairs are walked together: errors add up,
pairs over the budget are pruned, small pairs are compared directly. A trie with more than
`group_rows` fingerprints is split into chunks, and every pair of chunks is one group of its own,
so no group is unbounded and no pair is lost. A group returns a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, staged
from .components import components

BITS = 64
LEAF_PAIRS = 256
SLICE_PAIRS = 4_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; the whole sequence if it is shorter."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, hasher = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hasher(joined, 42)], np.uint64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(parts) - words]]
    return np.fromiter((hasher(joined[a:b - 1], 42) for a, b in zip(starts, ends[words - 1:])),
                       np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Majority vote of each bit; 0 where there are no hashes. Returned as a signed 64-bit number."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document; null and empty texts have fingerprint zero."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [simhash(shingle_hashes(text.as_py(), words)) for text in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, "text", work, "doc_id long, fp long")


class Forest:
    """Union of pairs over positions 0..n-1; every label is the smallest position of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _split(lo, hi, ones):
    return hi - (ones[hi] - ones[lo])


def _compare(keys, alo, ahi, blo, bhi, budget, forest):
    """Compare all members of the given node pairs, a bounded number at a time."""
    size = (ahi - alo) * (bhi - blo)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + SLICE_PAIRS, "right")))
        n = size[at:to]
        pair = np.repeat(np.arange(at, to), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (bhi - blo)[pair]
        a, b = alo[pair] + k // width, blo[pair] + k % width
        close = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        forest.add(a[close], b[close])
        at = to


def trie_forest(keys: np.ndarray, starts: np.ndarray, fixed: int, budget: int) -> np.ndarray:
    """Labels of the components of keys within `budget` bits, inside each group.

    `keys` (uint64) are sorted within groups that begin at `starts`; bits of `fixed` are equal there.
    """
    forest = Forest(len(keys))
    alo = starts.astype(np.int64)
    ahi = np.append(alo[1:], len(keys))
    blo, bhi, err = alo.copy(), ahi.copy(), np.zeros(len(alo), np.int64)
    for bit in range(BITS - 1, -2, -1):
        alone = (alo == blo) & (ahi - alo < 2)
        leaf = ~alone & ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS if bit >= 0 else True)
        _compare(keys, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget, forest)
        go = ~alone & ~leaf
        if not go.any():
            break
        alo, ahi, blo, bhi, err = (x[go] for x in (alo, ahi, blo, bhi, err))
        if fixed >> bit & 1:
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
        am, bm, own = _split(alo, ahi, ones), _split(blo, bhi, ones), alo == blo
        pairs = [(alo, am, blo, bm, err, None), (am, ahi, bm, bhi, err, None),
                 (alo, am, bm, bhi, err + 1, None), (am, ahi, blo, bm, err + 1, ~own)]
        kept = []
        for a, b, c, d, e, also in pairs:
            ok = (b > a) & (d > c) & (e <= budget)
            ok = ok if also is None else ok & also
            kept.append([x[ok] for x in (a, b, c, d, e)])
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kept))
    return forest.label


def block_masks(budget: int, blocks: int) -> list[int]:
    """Bit masks of the `blocks - budget` blocks that one trie forest holds equal, for every choice."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(mask[k] for k in chosen) for chosen in combinations(range(blocks), blocks - budget)]


def blocks_for(distinct: int, budget: int) -> int:
    """Fewest blocks with which random fingerprints leave about 64 in a trie. Any choice is exact."""
    for blocks in range(budget + 1, 2 * budget + 1):
        if distinct >> (BITS * (blocks - budget) // blocks) <= 64:
            return blocks
    return 2 * budget


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole groups: runs of rows that agree in the named columns, collected to about 100,000 rows or 32 MB."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 100_000 and sum(b.nbytes for b in held) < 32 << 20:
            continue
        rows = pa.Table.from_batches(held)
        keys = [rows.column(n).to_numpy() for n in names]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def fingerprint_links(distinct: DataFrame, budget: int = 4, group_rows: int = 4096) -> DataFrame:
    """(node, fp) with distinct fp -> (u, v): links whose components are those of all pairs of
    fingerprints within `budget` bits."""
    blocks = blocks_for(distinct.count(), budget)
    masks = block_masks(budget, blocks)
    array = F.array(*[F.struct(F.lit(k).alias("forest"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
                      for k, m in enumerate(masks)])
    rows = distinct.select("node", "fp", F.explode(array).alias("t")).select("node", "fp", "t.forest", "t.part")
    large = (rows.groupBy("forest", "part").count().filter(F.col("count") > group_rows)
             .select("forest", "part", F.ceil(F.col("count") / group_rows).cast("int").alias("chunks")))
    rows = (rows.join(staged(large, "large-tries"), ["forest", "part"], "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            # Two chunks that meet are compared within each, too, so a chunk needs no group of its own.
            .filter("chunks = 1 or mine <> other")
            .select("node", "fp", "forest", "part", F.least("mine", "other").alias("ci"),
                    F.greatest("mine", "other").alias("cj"))
            .repartition("forest", "part", "ci", "cj")
            .sortWithinPartitions("forest", "part", "ci", "cj"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["forest", "part", "ci", "cj"]):
            node, fp = group.column("node").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            parts = [group.column(n).to_numpy() for n in ("forest", "part", "ci", "cj")]
            change = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
            begins = np.append(0, change)
            number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(node))))
            order = np.lexsort((fp, number))
            node, fp = node[order], fp[order]
            kind = parts[0][begins]
            for forest in np.unique(kind):
                mine = np.flatnonzero(kind == forest)
                lo, hi = begins[mine[0]], np.append(begins, len(node))[mine[-1] + 1]
                label = trie_forest(fp[lo:hi], begins[mine] - lo, masks[int(forest)], budget)
                linked = np.flatnonzero(label != np.arange(hi - lo))
                if len(linked):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[lo:hi][linked]), pa.array(node[lo:hi][label[linked]])], ["u", "v"])

    return rows.mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, group_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id reachable over links of at most `budget` differing bits. Null,
    empty and blank texts have fingerprint 0 and link like any other. Rows with a null doc_id have their
    fingerprint and a null component_id. Repeated doc_ids are rows of their own. An empty table gives none.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")),
                      "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, budget, group_rows))
    classes = (distinct.join(roots, "node", "left")
               .select(F.col("fp").alias("class_fp"), F.coalesce("root", "node").alias("component_id")))
    return (prints.join(classes, F.col("fp") == F.col("class_fp"), "left")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one left of each group: the one with the smallest doc_id, whole and unchanged.

    Of rows that repeat that doc_id one stays. Rows with a null doc_id stay as they are.
    """
    kept = near_duplicates(docs, **settings).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))
