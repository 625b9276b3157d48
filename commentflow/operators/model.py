"""A weighted text classifier trained on the token windows with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentflow.operators.evaluate import macro_metrics


@dataclass(frozen=True)
class Params:
    features: int = 1 << 16
    reg: float = 0.01
    elastic: float = 0.0
    iterations: int = 30


def fit(windows: DataFrame, params: Params = Params()) -> PipelineModel:
    """Multinomial classifier over (tokens, label_id, weight)."""
    stages = [
        HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=params.features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="label_id", weightCol="weight",
            rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="yhat",
            family="multinomial", maxIter=params.iterations,
            regParam=params.reg, elasticNetParam=params.elastic,
        ),
    ]
    return Pipeline(stages=stages).fit(windows)


def chunk_logits(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Adds ``logits`` and ``yhat`` to token windows."""
    out = model.transform(windows).withColumn("logits", vector_to_array("_raw"))
    return out.withColumn("yhat", F.col("yhat").cast("bigint")).drop(
        "_tf", "_features", "_raw", "_probability"
    )


@dataclass
class Choice:
    params: Params
    model: PipelineModel
    metrics: dict[str, float]


def fit_best(
    train: DataFrame, dev: DataFrame, grid: Iterable[Params], security_id: int, patience: int = 2
) -> Choice:
    """The candidate with the best class-F1 on the dev split.

    Stops after ``patience`` candidates in a row without an improvement. Keep
    ``train`` and ``dev`` as written tables: every candidate reads them.
    """
    best: Choice | None = None
    worse = 0
    for params in grid:
        model = fit(train, params)
        scored = chunk_logits(model, dev)
        metrics = macro_metrics(scored, security_id, "label_id", "yhat").first().asDict()
        if best is None or metrics["security_f1"] > best.metrics["security_f1"]:
            best, worse = Choice(params, model, metrics), 0
        else:
            worse += 1
            if worse >= patience:
                break
    if best is None:
        raise ValueError("no candidates")
    return best
