"""Saving and loading fitted models of every kind: MLlib pipelines, linear fits, fits of many steps, neighbours.

A stored model is a folder: a small JSON text with its kind and numbers, and beside it the pipeline or
the train rows where the model has such. All of it goes through Spark, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import Model, PipelineModel
from pyspark.sql import SparkSession

from tidemill.ml.gram import LinearFit
from tidemill.ml.knn import NearestNeighbours
from tidemill.ml.models import Fitted, MultiOutput


def save(model: Model, path: str) -> None:
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    pipeline.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_model(spark: SparkSession, model: Fitted | LinearFit | MultiOutput | NearestNeighbours, path: str) -> None:
    if isinstance(model, Fitted):
        save(model.pipeline, f"{path}/pipeline")
        about = {"kind": "pipeline", "features": model.features, "fill": model.fill}
    elif isinstance(model, LinearFit):
        about = {"kind": "linear", "fits": [asdict(model)]}
    elif isinstance(model, MultiOutput):
        about = {"kind": "steps", "fits": [asdict(f) for f in model.fits]}
    elif isinstance(model, NearestNeighbours):
        model.train.select(model.key, model.y, *[f"`{f}`" for f in model.features]).write.mode("overwrite").parquet(f"{path}/train")
        about = {"kind": "neighbours", **{k: getattr(model, k) for k in ("features", "y", "key", "k", "weights", "p")}}
    else:
        raise TypeError(f"no way to store a {type(model).__name__}")
    # written last: a folder with it is whole
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Fitted | LinearFit | MultiOutput | NearestNeighbours:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    kind = about.pop("kind")
    if kind == "pipeline":
        return Fitted(load(f"{path}/pipeline"), tuple(about["features"]), tuple(about.get("fill", ())))
    if kind == "neighbours":
        return NearestNeighbours(spark.read.parquet(f"{path}/train"), tuple(about.pop("features")), **about)
    fits = [LinearFit(tuple(f["features"]), tuple(f["coef"]), f["intercept"], tuple(f["fill"])) for f in about["fits"]]
    return fits[0] if kind == "linear" else MultiOutput(fits)
