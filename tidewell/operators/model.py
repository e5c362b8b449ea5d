"""A demand model and its explanations: Poisson regression in log space, whose contributions are exact and additive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import COARSE_COLUMNS, Windows, tag, unpivot_slices, within
from .localise import top_k

NUMERIC, CATEGORICAL = ("sell_price", "wday", "is_weekend", "snap", "month"), ("cat_id", "store_id")


def _stages(numeric: Sequence[str], categorical: Sequence[str]):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical])
    return [index, hot, VectorAssembler(inputCols=[*numeric, *(f"{c}_oh" for c in categorical)], outputCol="features")]


def train(panel: DataFrame, w: Windows, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL):
    """A pipeline model fitted on the reference window only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = panel.where(within(w.ref_start, w.ref_end)).withColumn("month", F.month("date")).where("sales >= 0")
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="sales", predictionCol="y_pred", maxIter=15, regParam=1e-3)
    return Pipeline(stages=[*_stages(numeric, categorical), glm]).fit(rows)


def score(model, panel: DataFrame) -> DataFrame:
    """panel with y_pred, residual, abs_error."""
    out = model.transform(panel.withColumn("month", F.month("date")))
    keep = [*panel.columns, "y_pred"]
    return out.select(*keep).withColumns({"residual": F.col("sales") - F.col("y_pred"), "abs_error": F.abs(F.col("sales") - F.col("y_pred"))})


def contributions(model, panel: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """panel with phi_<feature> of the numeric features: coefficient times distance from the mean, in log space."""
    beta = list(model.stages[-1].coefficients)[: len(numeric)]
    rows = panel.withColumn("month", F.month("date"))
    means = rows.agg(*(F.avg(c).alias(f"_{c}") for c in numeric))
    return rows.crossJoin(F.broadcast(means)).select(*panel.columns, *((F.lit(float(b)) * (F.col(c) - F.col(f"_{c}"))).alias(f"phi_{c}") for c, b in zip(numeric, beta, strict=True)))  # one row


def mean_shift(panel: DataFrame, phi: str, w: Windows | None, columns: Sequence[str] = COARSE_COLUMNS, k: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The k slices whose mean of phi differs most between the windows; with keys (a trial id; w None: the rows are tagged) the k of each, with their rank. A slice without rows in both windows has no score."""
    rows = panel.select(*keys, phi, "win", *columns) if w is None else tag(panel.select(*keys, phi, "date", *columns), w)
    g = unpivot_slices(rows, columns, [*keys, "win", phi]).groupBy(*keys, "slice_col", "slice_ord", "slice_val").agg(F.abs(F.avg(F.when(F.col("win") == "cur", F.col(phi))) - F.avg(F.when(F.col("win") == "ref", F.col(phi)))).alias("score"))
    return top_k(g.where("score is not null"), k, keys)


def harm(scored: DataFrame, clean: DataFrame, w: Windows, at: float = 1.05) -> DataFrame:
    """mae_clean, mae_drifted, ratio, harmful: whether drift makes the model's errors in the current window worse by `at`."""
    mae = lambda df, name: df.where(within(w.cur_start, w.cur_end)).agg(F.avg("abs_error").alias(name))
    both = mae(clean, "mae_clean").crossJoin(mae(scored, "mae_drifted"))  # one row each
    return both.withColumn("ratio", F.col("mae_drifted") / F.nullif("mae_clean", F.lit(0.0))).withColumn("harmful", F.col("ratio") >= at)
