"""The whole fitted predictor as one versioned folder, written by Spark and read back into a scorer.

``<path>/version=N`` holds the effect forest and the quantile trees (Parquet tables) and, written
last, ``parts``: one row with the column roles, the scaler, the OLS and 2SLS coefficients. A version without a complete
``parts`` table is not there for readers, so a writer that dies leaves the versions before it in force.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators.histtrees import TreeModel
from pricelens.operators.quantile_trees import QuantileModel
from pricelens.operators.scenario import ScoringModel


@dataclass
class Bundle:
    """Everything a scorer needs. ``scaler`` maps a feature to (mean, population sd; 1 for a constant one); the effect
    forest reads ``effect_features``."""
    features: list[str]
    treatment: str
    outcome: str
    scaler: dict[str, tuple[float, float]]
    linear: ScoringModel
    tsls: ScoringModel
    effect_features: list[str]
    forest: TreeModel
    quantiles: QuantileModel

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with z_<feature>, ols_prediction, tsls_prediction, treatment_effect and q_<quantile> (0.1 gives q_10).

        A null in a feature gives nulls in what needs it; columns of ``df`` with these names are replaced."""
        new = [f"z_{f}" for f in self.features] + ["ols_prediction", "tsls_prediction", "treatment_effect", "_effect_x"]
        names = {q: f"q_{round(100 * q)}" for q in self.quantiles.quantiles}
        df = df.drop(*new, *names.values())
        x = {f: F.col(f"`{f}`") for f in self.features}
        df = df.select("*", *[((x[f].cast("double") - F.lit(m)) / F.lit(sd)).alias(f"z_{f}") for f, (m, sd) in self.scaler.items()],
                       self.linear.predict(x).alias("ols_prediction"), self.tsls.predict(x).alias("tsls_prediction"))
        vec = VectorAssembler(inputCols=self.effect_features, outputCol="_effect_x", handleInvalid="keep")
        forest = self.forest.copy().setFeaturesCol("_effect_x").setPredictionCol("treatment_effect")
        whole = F.lit(True)
        for f in self.effect_features:
            whole = whole & F.col(f"`{f}`").isNotNull()
        df = forest.transform(vec.transform(df)).withColumn("treatment_effect", F.when(whole, F.col("treatment_effect"))).drop("_effect_x")
        return self.quantiles.score(df, x, names)


def _line(model: ScoringModel) -> dict:
    return {"intercept": model.intercept, "coefs": model.coefs, "tsls_coef": model.tsls_coef, "features": model.features}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under ``path``, ascending."""
    root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = [st.getPath().getName() for st in fs.listStatus(root)]
    numbers = [int(n[8:]) for n in found if n.startswith("version=") and n[8:].isdigit()]
    return sorted(n for n in numbers if fs.exists(_fs(spark, f"{path}/version={n}/parts/_SUCCESS")[0]))


def save(spark: SparkSession, path: str, bundle: Bundle) -> int:
    """Write the next version (an incomplete one of that number is overwritten) and return its number. Numbers go as
    JSON, whose doubles read back to the same bits."""
    version = max(versions(spark, path), default=0) + 1
    here = f"{path}/version={version}"
    bundle.forest.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{here}/forest")
    bundle.quantiles.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{here}/quantiles")
    q = bundle.quantiles
    parts = {"features": bundle.features, "treatment": bundle.treatment, "outcome": bundle.outcome, "scaler": bundle.scaler,
             "linear": _line(bundle.linear), "tsls": _line(bundle.tsls), "effect_features": bundle.effect_features,
             "quantiles": {"features": q.features, "quantiles": q.quantiles, "rounds": int(q.feature.shape[1]),
                           "depth": (q.feature.shape[2] + 1).bit_length() - 2, "rate": q.rate}}
    spark.createDataFrame([(json.dumps(parts),)], "parts string").coalesce(1).write.mode("overwrite").parquet(f"{here}/parts")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Bundle:
    """The given version, or the newest complete one; FileNotFoundError if there is none."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no complete version {'' if version is None else version} under {path}")
    here = f"{path}/version={version or there[-1]}"
    p = json.loads(spark.read.parquet(f"{here}/parts").first()["parts"])
    trees = QuantileModel.from_table(spark.read.parquet(f"{here}/quantiles"), **p["quantiles"])
    return Bundle(p["features"], p["treatment"], p["outcome"], {f: tuple(v) for f, v in p["scaler"].items()}, ScoringModel(**p["linear"]),
                  ScoringModel(**p["tsls"]), p["effect_features"], TreeModel.from_table(spark.read.parquet(f"{here}/forest")), trees)
