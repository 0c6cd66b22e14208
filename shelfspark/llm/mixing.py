"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear multiplier over training time 0..1.
The integral of the schedule, scaled to the source's target, is its cumulative demand for words;
a document taken at c words into its source stands where that demand reaches c. Documents are
range-sorted by this position.

Running sums never gather a source: documents fall into hash buckets of their source, bucket sums
are run up over the few bucket rows, and only rows of one bucket are summed one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS = (3.0, 1.0, 2.0)
# Knots (time, multiplier) of the schedules, repeating over the sources like the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)))


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, place): sources by code point, null last, numbered from 0 without a global window."""
    ordered = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                     .sort(F.col("source").asc_nulls_last())
                     .withColumn("slot", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftright("slot", 33), F.col("slot").bitwiseAND((1 << 33) - 1)
    before = (ordered.groupBy(part.alias("part")).count()
              .withColumn("skip", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    return (ordered.withColumn("part", part).withColumn("row", row)
            .join(before.select("part", F.coalesce("skip", F.lit(0)).alias("skip")), "part")
            .select("source", "source_size", (F.col("row") + F.col("skip")).alias("place")))


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (place % len(values) + 1).cast("int"))


def with_targets(sources: DataFrame, share: float, epochs: float, weights: tuple) -> DataFrame:
    """Adds weight and target: shares of share x all words by weight, none above epochs x its source.

    What a full source can't take is reshared among the others by weight, round by round.
    """
    sources = staged(sources.withColumn("weight", _cycle(weights, F.col("place"))), "weighted-sources")
    most = F.col("source_size") * epochs
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, full = (total or 0) * share, 0.0, None
    while free:
        level = (budget - (full or 0.0)) / free
        is_full = F.col("weight") * level >= most
        then, free = sources.agg(F.sum(F.when(is_full, most)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if not free:
            level = float("inf")
        if then == full:
            break
        full = then
    wanted = most if level == float("inf") else F.least(F.col("weight") * level, most)
    return sources.withColumn("target", wanted.cast("double"))


def inverse_demand(knots: tuple, part: Column) -> Column:
    """Time at which the share `part` (0..1) of the demand under a piecewise-linear schedule is met."""
    pieces = list(zip(knots, knots[1:]))
    whole = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in pieces)
    area, done, time = part * whole, 0.0, None
    for (t0, m0), (t1, m1) in pieces:
        rest, slope = F.greatest(area - done, F.lit(0.0)), (m1 - m0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(m0 * m0) + rest * (2 * slope), F.lit(0.0)))
        here = F.when(rest > 0, F.least(F.lit(t1), F.lit(t0) + rest * 2 / (root + m0))).otherwise(F.lit(t0))
        time = here if time is None else F.when(area > done, here).otherwise(time)
        done += (t1 - t0) * (m0 + m1) / 2
    return time


def curriculum_mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS,
                   schedules: tuple = SCHEDULES, bucket_digits: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions) of every row, in no order.

    size: words of the text, 0 for null. taken: words the mix takes, repeats counted; passes over a source
    follow one another in an order by md5 of doc_id, and the last one stops at the target, inside a
    document if need be. positions: when each pass over the document begins (0..1); empty if none is taken.
    Null sources are one source, the last. Rows with equal or null doc_id are taken one by one. If there
    are no words, targets are 0. An empty table gives no rows.
    """
    sized = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("turn"))
        .withColumn("bucket", F.substring("turn", 1, bucket_digits)), "sized")
    sources = with_targets(ranked_sources(sized), share, epochs, weights)
    # An equal join must find null sources too.
    named = sources.withColumn("source", F.struct("source"))
    buckets = (sized.groupBy(F.struct("source").alias("source"), "bucket").agg(F.sum("size").alias("words"))
               .withColumn("before", F.coalesce(F.sum("words").over(
                   Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .join(named, "source"))
    in_bucket = (Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size")
                 .rowsBetween(Window.unboundedPreceding, -1))
    rows = (sized.withColumn("source", F.struct("source"))
            .join(buckets.drop("words"), ["source", "bucket"])
            .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))))
    goal, begins = F.floor("target"), []
    taken = F.lit(0).cast("long")
    for turn in range(int(-(-epochs // 1))):
        begin = F.col("start") + F.col("source_size") * turn
        words = F.greatest(F.least(F.col("size"), goal - begin), F.lit(0))
        taken = taken + words
        part = F.try_divide(begin, F.col("target"))
        time = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            time = F.when(F.col("place") % len(schedules) == k, inverse_demand(knots, part)).otherwise(time)
        begins.append(F.when(words > 0, time))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
                       F.filter(F.array(*begins), lambda t: t.isNotNull()).alias("positions"))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by position: (doc_id, pass, position)."""
    passes = mix.select("doc_id", F.posexplode("positions").alias("pass", "position"))
    return passes.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


def ordered_mix(mix: DataFrame) -> DataFrame:
    """The documents of a mix, range-sorted by the position of their first pass; those not taken come last."""
    first = F.coalesce(F.element_at(F.concat("positions", F.array(F.lit(2.0))), 1), F.lit(2.0))
    return (mix.withColumn("position", first).repartitionByRange("position", "doc_id")
            .sortWithinPartitions("position", "doc_id"))
