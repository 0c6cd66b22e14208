"""From the feature table to predictions, decisions, KPIs and dashboard tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEMAND_TARGET, STOCKOUT_TARGET
from ..operators import modeling
from ..operators.baselines import (
    demand_result, stockout_result, with_demand_baseline, with_stockout_baseline,
)
from ..operators.decisions import decision_inputs, order_constraints, reorder_actions
from ..operators.metrics import demand_metrics, stockout_metrics
from ..operators.serving import kpi_summary
from ..operators.splits import holdout_start, labelled_rows, split_metadata
from ..session import staged
from .features import feature_table
from .model_store import ModelStore


@dataclass
class Labelled:
    """Labelled rows of one target and where their hold-out starts."""

    rows: DataFrame
    start: date

    @classmethod
    def of(cls, features: DataFrame, target: str) -> "Labelled":
        rows = labelled_rows(features, target)
        return cls(rows, holdout_start(rows))

    @property
    def metadata(self) -> DataFrame:
        return split_metadata(self.rows, self.start)


class Stages:
    """Features once, durably; everything downstream lazily on top of them."""

    def __init__(self, features: DataFrame):
        self.features = features
        self.demand = Labelled.of(features, DEMAND_TARGET)
        self.stockout = Labelled.of(features, STOCKOUT_TARGET)

    @classmethod
    def from_sources(cls, sources, scope) -> "Stages":
        return cls(staged(feature_table(sources, scope), "features"))

    def demand_predictions(self) -> DataFrame:
        raise NotImplementedError

    def stockout_predictions(self) -> DataFrame:
        raise NotImplementedError

    def predictions(self) -> tuple[DataFrame, DataFrame]:
        return self.demand_predictions(), self.stockout_predictions()

    def inputs(self) -> DataFrame:
        # Both predictions exist from the later hold-out start on; as a literal, that week
        # prunes the scan of the feature table.
        since = max(self.demand.start, self.stockout.start)
        return decision_inputs(
            self.features.filter(F.col("week_start_date") >= F.lit(since)),
            *self.predictions())

    def constrained(self) -> DataFrame:
        return order_constraints(self.inputs())

    def decisions(self) -> DataFrame:
        return reorder_actions(self.constrained())

    def demand_metrics(self) -> DataFrame:
        return demand_metrics(self.demand_predictions(), self.demand.metadata)

    def stockout_metrics(self) -> DataFrame:
        return stockout_metrics(self.stockout_predictions(), self.stockout.metadata)

    def kpis(self) -> DataFrame:
        decided = self.decisions()
        return kpi_summary(self.demand_metrics(), self.stockout_metrics(), decided)


class FormulaStages(Stages):
    """Predictions from closed formulas on the features.

    The decision layer needs some forecast and some probability, not a particular
    model. Formulas make everything downstream reproducible in SQL.
    """

    def demand_predictions(self) -> DataFrame:
        scored = with_demand_baseline(self.demand.rows, self.demand.start)
        formula = F.coalesce("stockout_adjusted_sales_rolling_mean_4w", "baseline_pred")
        return demand_result(scored.withColumn("demand_pred", formula))

    def stockout_predictions(self) -> DataFrame:
        scored = with_stockout_baseline(self.stockout.rows, self.stockout.start)
        cover = F.col("inventory_cover_weeks")
        level = F.when(cover < 2, 35).when(cover < 8, 20).otherwise(5)
        percent = level + 15 * F.col("stockout_days_last_4w")
        return stockout_result(
            scored.withColumn("stockout_risk_pred_proba", percent / F.lit(100.0)))


class ModelStages(Stages):
    """Predictions from the fitted boosted-tree models.

    The predictions are written out once, as every downstream table reads them again. With a
    model store, models and predictions of an earlier process are loaded instead.
    """

    def __init__(self, features: DataFrame, rounds: int = 250, depth: int = 5, keep=None,
                 store: ModelStore | None = None):
        """``keep`` stores a table under a name and reads it back; by default a stage table."""
        super().__init__(features)
        self.keep = keep or (lambda name, df: staged(df, name))
        self.store = store
        self.rounds, self.depth = rounds, depth
        self._made: dict[str, object] = {}

    @classmethod
    def from_sources(cls, sources, scope, rounds: int = 250, depth: int = 5) -> "ModelStages":
        return cls(staged(feature_table(sources, scope), "features"), rounds, depth)

    @classmethod
    def stored(cls, store: ModelStore, build_features, rounds: int = 250, depth: int = 5) -> "ModelStages":
        """On the features of the store; ``build_features`` makes them if there are none."""
        return cls(store.table("features", build_features), rounds, depth, store=store)

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _model(self, name: str, fit, labelled: Labelled):
        def fitted():
            return fit(labelled.rows, labelled.start, self.rounds, self.depth)
        return self._once(name, lambda: self.store.model(name, fitted) if self.store else fitted())

    def _table(self, name: str, build):
        return self._once(name, lambda: self.store.table(name, build) if self.store
                          else self.keep(name, build()))

    @property
    def demand_model(self):
        return self._model("demand_model", modeling.fit_demand_model, self.demand)

    @property
    def stockout_model(self):
        return self._model("stockout_model", modeling.fit_stockout_model, self.stockout)

    def demand_predictions(self) -> DataFrame:
        return self._table("demand_forecast_result", lambda: modeling.forecast_demand(
            self.demand_model, self.demand.rows, self.demand.start))

    def stockout_predictions(self) -> DataFrame:
        return self._table("stockout_risk_result", lambda: modeling.predict_stockout(
            self.stockout_model, self.stockout.rows, self.stockout.start))

    def predictions(self) -> tuple[DataFrame, DataFrame]:
        """Both tables. Models still missing are fitted side by side: a round of boosting is many
        short jobs, which leave room for those of the other model."""
        made = {"demand_forecast_result": "demand_model", "stockout_risk_result": "stockout_model"}
        missing = [model for table, model in made.items() if table not in self._made
                   and not (self.store and self.store.has(table))]
        if len(missing) > 1:
            fit = inheritable_thread_target(self.features.sparkSession)(lambda name: getattr(self, name))
            with ThreadPoolExecutor(len(missing)) as pool:
                list(pool.map(fit, missing))
        return super().predictions()
