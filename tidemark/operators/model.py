"""Gradient-boosted trees on the feature table, judged by daily rank IC on the last dates."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import calendar, with_calendar_index
from tidemark.operators.features import FEATURE_ORDER
from tidemark.operators.ic import daily_rank_ic
from tidemark.session import store_intermediate

LABEL = "label_ret_1f"
INPUTS = [c for c in FEATURE_ORDER if c not in ("symbol", "date", LABEL)]


def split_by_time(features: DataFrame, test_ratio: float = 0.2, test_start=None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part is the last ``test_ratio`` of the dates, or everything from ``test_start``."""
    if test_start is not None:
        return features.where(F.col("date") < F.lit(test_start)), features.where(F.col("date") >= F.lit(test_start))
    cal = calendar(features)
    first_test = F.floor(cal.agg(F.max("di")).scalar() * F.lit(1 - test_ratio))
    rows = with_calendar_index(features, cal)
    return rows.where(F.col("di") <= first_test).drop("di"), rows.where(F.col("di") > first_test).drop("di")


def fit(train: DataFrame, max_iter: int = 10, max_depth: int = 3, seed: int = 7) -> GBTRegressionModel:
    """Missing inputs count as zero; rows without a label are left out.

    The fit reads its rows several times (size, split points, trees), so they are stored once.
    """
    rows = train.where(F.col(LABEL).isNotNull()).fillna(0.0, subset=INPUTS).select(*INPUTS, LABEL)
    rows = store_intermediate(rows, "model-rows")
    vectors = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows).select("features", LABEL)
    return GBTRegressor(
        featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth, seed=seed
    ).fit(vectors)


def score(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """(symbol, date, score, label)."""
    ready = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows.fillna(0.0, subset=INPUTS))
    return model.transform(ready).select(
        "symbol", "date", F.col("prediction").alias("score"), F.col(LABEL).alias("label")
    )


def model_rank_ic(scored: DataFrame, min_symbols: int = 2) -> DataFrame:
    """Daily rank IC of the scores against the labels (days with at least two names)."""
    pairs = scored.select(
        F.lit("model").alias("factor"), "date", F.col("symbol").alias("instrument"),
        F.col("score").alias("value"), F.col("label").alias("fwd"),
    )
    return daily_rank_ic(pairs, min_symbols)
