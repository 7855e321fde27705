"""Boosted quantile regression on Spark ML trees (M1, M4, M6).

Gradient boosting for the pinball loss at level alpha:

* start from the alpha-quantile of the label;
* each round fits a ``DecisionTreeRegressor`` (distributed, histogram based)
  to the negative gradient ``alpha - 1{y < f}``, reads every row's leaf
  (``leafCol``) and replaces each leaf's output by the alpha-quantile of the
  residuals in that leaf (exact, per-leaf, via ``exact_quantiles``);
* ``f += learning_rate * leaf_value``.

The new ``f`` is one projection (tree transform and a literal map from leaf to
value, at most 2^depth entries), so a round adds no scan and no join; the
working table is reliably checkpointed every few rounds, since the chain of
projections is evaluated anew in each round.  A fitted model is a list of (tree, leaf -> value) pairs; prediction is one
projection chain (tree transforms + literal maps), no joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlake.operators.quantiles import exact_quantiles
from coverlake.session import cut_lineage

FEATURES = ("S", "sigma", "tau", "r")


def _session():
    from pyspark.sql import SparkSession
    # the active session is thread-local; fits may run in driver threads
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def leaf_lookup(values: dict, leaf):
    """Leaf index -> value as a literal map; an unknown leaf adds nothing."""
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(float(k)), F.lit(float(v)))])
    return F.coalesce(table[leaf], F.lit(0.0))


@dataclass
class QuantileGBMModel:
    alpha: float
    features: tuple
    init: float
    learning_rate: float
    trees: list = field(default_factory=list)        # DecisionTreeRegressionModel
    leaf_values: list = field(default_factory=list)  # dict leaf index -> value

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        vec = "__qgbm_features"
        cur = VectorAssembler(inputCols=list(self.features), outputCol=vec, handleInvalid="keep").transform(df)
        total = F.lit(self.init)
        for m, (tree, values) in enumerate(zip(self.trees, self.leaf_values)):
            leaf = f"__leaf_{m}"
            t = tree.copy().setFeaturesCol(vec).setPredictionCol(f"__tp_{m}").setLeafCol(leaf)
            cur = t.transform(cur)
            total = total + self.learning_rate * leaf_lookup(values, F.col(leaf))
        drop = [vec] + [c for c in cur.columns if c.startswith("__leaf_") or c.startswith("__tp_")]
        return cur.withColumn(out, total).drop(*drop)

    # --- M6: persistence ------------------------------------------------------
    def save(self, path: str) -> None:
        for m, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree_{m}")
        meta = {"alpha": self.alpha, "features": list(self.features), "init": self.init,
                "learning_rate": self.learning_rate, "n_trees": len(self.trees),
                "leaf_values": [{str(k): v for k, v in d.items()} for d in self.leaf_values]}
        ss = _session()
        ss.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "QuantileGBMModel":
        ss = _session()
        meta = json.loads(ss.read.text(f"{path}/meta").first()[0])
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree_{m}") for m in range(meta["n_trees"])]
        values = [{float(k): v for k, v in d.items()} for d in meta["leaf_values"]]
        return cls(meta["alpha"], tuple(meta["features"]), meta["init"], meta["learning_rate"], trees, values)


@dataclass
class QuantileGBM:
    alpha: float = 0.5
    n_rounds: int = 8
    max_depth: int = 4
    learning_rate: float = 0.3
    max_bins: int = 32
    min_instances: int = 20
    features: tuple = FEATURES
    label: str = "y"
    checkpoint_every: int = 5

    def fit(self, df: DataFrame) -> QuantileGBMModel:
        vec = "__qgbm_features"
        y = F.col(self.label).cast("double")
        data = VectorAssembler(inputCols=list(self.features), outputCol=vec).transform(
            df.select(*self.features, y.alias("__y")).na.drop())
        data = cut_lineage(data.select(vec, "__y"))
        init = exact_quantiles(data, "__y", [self.alpha], prefix="q").first()[0]
        cur = data.withColumn("__f", F.lit(init))
        model = QuantileGBMModel(self.alpha, tuple(self.features), float(init), self.learning_rate)
        for m in range(self.n_rounds):
            grad = cur.withColumn("__g", F.when(F.col("__y") < F.col("__f"), self.alpha - 1.0)
                                           .otherwise(float(self.alpha)))
            tree = DecisionTreeRegressor(featuresCol=vec, labelCol="__g", maxDepth=self.max_depth,
                                         maxBins=self.max_bins, minInstancesPerNode=self.min_instances,
                                         leafCol="__leaf", seed=m).fit(grad)
            leafed = tree.transform(grad).withColumn("__res", F.col("__y") - F.col("__f"))
            gam = exact_quantiles(leafed, "__res", [self.alpha], by=["__leaf"], prefix="g")
            gname = [c for c in gam.columns if c != "__leaf"][0]
            values = {r["__leaf"]: (r[gname] if r[gname] is not None else 0.0) for r in gam.collect()}
            model.trees.append(tree)
            model.leaf_values.append(values)
            step = self.learning_rate * leaf_lookup(values, F.col("__leaf"))
            cur = leafed.select(vec, "__y", (F.col("__f") + step).alias("__f"))
            if (m + 1) % self.checkpoint_every == 0 and m + 1 < self.n_rounds:
                cur = cut_lineage(cur)
        return model


def fit_interval_models(train: DataFrame, label: str, alpha: float = 0.1, **kw):
    """The three models of a CQR / NQR run: q_{alpha/2}, median, q_{1-alpha/2}."""
    lo = QuantileGBM(alpha=alpha / 2, label=label, **kw).fit(train)
    md = QuantileGBM(alpha=0.5, label=label, **kw).fit(train)
    hi = QuantileGBM(alpha=1 - alpha / 2, label=label, **kw).fit(train)
    return lo, md, hi


def predict_intervals(models, df: DataFrame) -> DataFrame:
    """M4: raw quantile interval (lb, pp, ub) as one projection chain."""
    lo, md, hi = models
    return hi.predict(md.predict(lo.predict(df, "lb"), "pp"), "ub")
