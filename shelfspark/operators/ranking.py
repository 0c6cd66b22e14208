"""ROC-AUC and average precision over any number of rows.

Both need the positives and negatives above each score. Rows are first reduced to one
per distinct score. The counts above a score are then put together from three short
running sums: over coarse score buckets, over fine buckets inside a coarse one, and over
the scores inside a fine one. No window spans the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import staged

COARSE, FINE = 2 ** 12, 2 ** 24


def score_counts(rows: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """Positives and negatives per distinct score in [0, 1]. A missing score is an error, not a lost row."""
    value = F.coalesce(F.col(score).cast("double"), F.raise_error(F.lit(f"{score}: a row has no score")).cast("double"))
    return (
        rows.groupBy(*by, value.alias("score"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"),
             F.sum(1 - F.col(label).cast("long")).alias("neg"))
        .withColumns({"coarse": F.floor(F.col("score") * COARSE),
                      "fine": F.floor(F.col("score") * FINE)})
    )


def _above(df: DataFrame, within, order: str, prefix: str) -> DataFrame:
    higher = (
        Window.partitionBy(*within).orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumns({
        f"{prefix}_{side}": F.coalesce(F.sum(side).over(higher), F.lit(0))
        for side in ("pos", "neg")
    })


def counts_above(counts: DataFrame, by=()) -> DataFrame:
    """Each distinct score with the positives and negatives of all higher scores."""
    by = list(by)
    sums = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    coarse_keys, fine_keys = [*by, "coarse"], [*by, "coarse", "fine"]
    coarse = _above(counts.groupBy(*coarse_keys).agg(*sums), by, "coarse", "c").drop("pos", "neg")
    fine = _above(counts.groupBy(*fine_keys).agg(*sums), coarse_keys, "fine", "f")
    offsets = fine.drop("pos", "neg").join(coarse, coarse_keys).select(
        *fine_keys,
        (F.col("c_pos") + F.col("f_pos")).alias("o_pos"),
        (F.col("c_neg") + F.col("f_neg")).alias("o_neg"),
    )
    return _above(counts, fine_keys, "score", "s").join(offsets, fine_keys).select(
        *by, "score", "pos", "neg",
        (F.col("o_pos") + F.col("s_pos")).alias("pos_above"),
        (F.col("o_neg") + F.col("s_neg")).alias("neg_above"),
    )


def ranking_metrics(rows: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) per group.

    NULL where a class is missing: the area without both classes, the precision without
    positives.
    """
    return metrics_of_counts(score_histogram(rows, label, score, by), by)


def metrics_of_counts(counts: DataFrame, by=()) -> DataFrame:
    """The areas from ``score_counts``, which are read three times: store costly ones first."""
    return areas_of_running_counts(counts_above(counts, by), by)


def areas_of_running_counts(ranked: DataFrame, by=(), more=()) -> DataFrame:
    """The areas from ``counts_above``, and ``more`` aggregates of its rows in the same pass."""
    hits = F.col("pos_above") + F.col("pos")
    taken = hits + F.col("neg_above") + F.col("neg")
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / F.lit(2.0))).alias("pairs_won"),
        F.sum(F.col("pos") * (hits / taken)).alias("precision_sum"),
        *more,
    )
    return sums.select(
        *by,
        "positives",
        "negatives",
        ratio(F.col("pairs_won"),
              F.col("positives").cast("double") * F.col("negatives")).alias("roc_auc"),
        ratio(F.col("precision_sum"), F.col("positives")).alias("pr_auc"),
        *[name for name in sums.columns
          if name not in {*by, "positives", "negatives", "pairs_won", "precision_sum"}],
    )


def score_histogram(rows: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """``score_counts`` written once: the one scan of the scored rows for every metric of theirs."""
    return staged(score_counts(rows, label, score, by), "score-histogram")


def at_threshold(threshold, name: str):
    """(true positives, false positives) at a threshold as an aggregate over ``counts_above``: the
    running counts at the lowest score that reaches it; 0 if none does."""
    found = F.min_by(
        F.struct((F.col("pos_above") + F.col("pos")).alias("true_positive"),
                 (F.col("neg_above") + F.col("neg")).alias("false_positive")),
        F.when(F.col("score") >= threshold, F.col("score")))
    none = F.struct(F.lit(0).cast("long").alias("true_positive"), F.lit(0).cast("long").alias("false_positive"))
    return F.coalesce(found, none).alias(name)


def threshold_metrics(histogram: DataFrame, thresholds: dict[str, float], by=()) -> DataFrame:
    """One row per group and named threshold (column ``at``): confusion counts and both areas, from
    one pass over the running counts of a histogram."""
    by = list(by)
    more = [at_threshold(value, f"at_{k}") for k, value in enumerate(thresholds.values())]
    areas = areas_of_running_counts(counts_above(histogram, by), by, more)
    each = F.inline(F.array(*[
        F.struct(F.lit(name).alias("at"), F.col(f"at_{k}.true_positive"), F.col(f"at_{k}.false_positive"))
        for k, name in enumerate(thresholds)]))
    rows = areas.select(*by, "positives", "negatives", "roc_auc", "pr_auc", each)
    return rows.select(
        *by, "at",
        (F.col("negatives") - F.col("false_positive")).alias("true_negative"), "false_positive",
        (F.col("positives") - F.col("true_positive")).alias("false_negative"), "true_positive",
        "roc_auc", "pr_auc")
