"""Benchmark decontamination with DataFrame functions only.

A window of as many words as an item can only reach the similarity if enough of its shingles are the item's,
and the window that starts at the first of these is as good. So windows are taken where a shingle of an item
stands and enough others follow. Every window content gets a SimHash of its shingles, repeats counted; cut
into radius + 1 blocks, two fingerprints within the radius agree on one block, so an equal join on item, block
and value keeps all windows within the radius of the item whose shingles they hold. Candidates are verified by
the exact weighted Jaccard similarity of their shingles (weights are counts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keys_for_join, staged

BLANKS = r"[\x20\x09-\x0D]+"
SIMHASH = """aggregate(sequence(0, 63), 0L, (fp, b) -> fp |
    CASE WHEN 2 * size(filter(hashes, h -> (shiftright(h, b) & 1L) = 1L)) > size(hashes) THEN shiftleft(1L, b) ELSE 0L END)"""
COMMON = """aggregate(array_distinct(shingles), 0, (n, s) -> n +
    least(size(filter(shingles, x -> x = s)), size(filter(item_shingles, x -> x = s))))"""


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), BLANKS), "")


def _shingle_hashes(words: str, k: int) -> Column:
    """xxhash64 of each run of k words."""
    starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
    return F.when(F.size(words) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)])))


def _shingles(words: str, k: Column) -> Column:
    """Each run of k words, joined by a blank."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, k)))


def _block(fp: str, blocks: int) -> Column:
    """Number and value of each block of the fingerprint."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
                     for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 24,
                 item_shingles_at_once: int = 1_000_000) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): for each document and item the best window that reaches the similarity.

    start is the first word's place, from 0, among windows that begin at a shingle of the item; of equal ones the first. An item shorter than `words`
    words is one shingle of all its words; a document shorter than an item is compared whole. Null, empty and blank
    texts match nothing. Rows of one doc_id with different texts are apart by text_key, a hash of the text; null ids
    are kept. At similarity 0.8 fingerprints differ in 10 bits on average (standard deviation 3), so a radius of 24
    misses no pair but with a chance below one in a million. Item shingles meet the documents by broadcast, at
    most about `item_shingles_at_once` at a time.
    """
    listed = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("item_words"))
              .withColumn("n", F.size("item_words")).filter("n > 0")
              .withColumn("k", F.least("n", F.lit(words))).withColumn("m", F.col("n") - F.col("k") + 1)
              .withColumn("item_shingles", _shingles("item_words", F.col("k"))))
    items = staged(listed, "benchmark-items")
    total, = items.agg(F.sum("m")).first()
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most `words` values
    parts = max(1, -(-(total or 0) // item_shingles_at_once))
    raw = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .filter("text is not null").withColumn("text_key", F.xxhash64("text")))
    text = raw.select("doc_id", "text_key", words_of(F.col("text")).alias("w"))
    hits = []
    for k in sizes:
        known = (items.filter(F.col("k") == k).select("item_id", "n", "k", "m", F.explode(_shingle_hashes("item_words", k)).alias("hash")).distinct())
        for part in range(parts):
            some = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
            # Positions alone are exploded, not the words next to each of them.
            found = (text.select("doc_id", "text_key", F.posexplode(_shingle_hashes("w", k)).alias("pos", "hash"))
                     .join(F.broadcast(some), "hash"))
            hits.append(found.select("doc_id", "text_key", "item_id", "n", "k", "m", "pos"))
    if not hits:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, start int, similarity double")
    places = staged(reduce(DataFrame.unionByName, hits).distinct(), "shingle-places")
    row = F.struct("doc_id", "text_key").alias("id")
    met = staged(places.select(row).distinct(), "documents-met")
    words = (raw.select(row, "text").join(keys_for_join(met), "id", "left_semi").dropDuplicates(["id"])
             .select("id", words_of(F.col("text")).alias("w")))
    start = F.greatest(F.least(F.col("pos"), F.size("w") - F.col("n")), F.lit(0))
    hits = staged(places.withColumn("id", row).join(words, "id")
                  .select("doc_id", "text_key", "item_id", "n", "k", "m", "pos", start.alias("start"),
                          F.slice("w", start + 1, F.col("n")).alias("window")), "shingle-hits")
    # Enough hits from this one on: the c-th stands inside the window, c from the similarity of two multisets.
    per = ["doc_id", "text_key", "item_id"]
    least = F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.size("window") - F.col("k") + 1) - 1e-9), F.lit(1))
    placed = hits.withColumn("turn", F.row_number().over(Window.partitionBy(*per).orderBy("pos"))).withColumn("id", F.struct(*per))
    ahead = placed.select("id", F.col("turn").alias("far"), F.col("pos").alias("far_pos"))
    windows = staged(placed.withColumn("far", (F.col("turn") + least - 1).cast("int"))
                     .join(ahead, ["id", "far"]).filter(F.col("far_pos") <= F.col("start") + F.size("window") - F.col("k"))
                     .select(*per, "n", "k", "start", "window"), "item-windows")
    blocks = radius + 1
    contents = (windows.select("n", "k", "window").distinct().withColumn("shingles", _shingles("window", F.col("k")))
                .withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s))).withColumn("fp", F.expr(SIMHASH)).drop("hashes"))
    contents = staged(contents, "window-contents")
    wanted = staged(items.withColumn("hashes", F.transform("item_shingles", lambda s: F.xxhash64(s))).withColumn("item_fp", F.expr(SIMHASH))
                    .select("item_id", "n", "item_shingles", "item_fp"), "item-fingerprints")
    known = windows.select("item_id", "n", "window").distinct().join(contents.select("n", "window", "fp"), ["n", "window"])
    left = known.select("item_id", "window", "fp", F.explode(_block("fp", blocks)).alias("at")).select("item_id", "window", "fp", "at.*")
    right = wanted.select("item_id", "item_fp", F.explode(_block("item_fp", blocks)).alias("at")).select("item_id", "item_fp", "at.*")
    close = (left.join(right, ["item_id", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
             .select("item_id", "window").distinct())
    common = F.expr(COMMON)
    verified = (close.join(wanted.select("item_id", "n", "item_shingles"), "item_id").join(contents.select("n", "window", "shingles"), ["n", "window"])
                .withColumn("common", common)
                .withColumn("similarity", F.col("common") / (F.size("shingles") + F.size("item_shingles") - F.col("common")))
                .filter(F.col("similarity") >= similarity).select("n", "window", "item_id", "similarity"))
    return (windows.select(*per, "n", "start", "window").distinct().join(verified, ["item_id", "n", "window"])
            .groupBy(*per).agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .select(*per, (-F.col("best.back")).cast("int").alias("start"), F.col("best.similarity").alias("similarity")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without any window that reaches the similarity to an item, every column unchanged."""
    name = "found key of the document"  # apart from any column of the documents
    found = contaminated(docs, benchmark, **settings).select(F.struct("doc_id", "text_key").alias(name)).distinct()
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_key"))
    return docs.withColumn(name, key).join(found, name, "left_anti").select(docs.columns)
