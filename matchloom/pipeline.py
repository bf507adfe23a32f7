"""A matching run from files to figures."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.blocking import generate_candidates, recall_ceiling
from .operators.features import ENCODERS, pair_features, precompute_embeddings
from .operators.model import calibrate, evaluate, evaluate_naive_baseline, to_vectors, train_model
from .runtime import stored
from .sources.files import ENTITY, cached_embeddings, ingest, input_hash, read_csv, read_pairs, write_json


log = logging.getLogger("matchloom")
Settings = Mapping[str, Any]


def run_download(settings: Settings) -> list[Path]:
    """Fetch every table that ``dataset.sources`` names to the place where the run reads it, unless it is there as the digest says."""
    got = []
    for name, source in settings["dataset.sources"].items():
        got.append(ingest(source["from"], settings[f"dataset.{name}"], source["sha256"]))
        log.info("%s: %s", name, got[-1])
    return got


def load_data(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """The five tables, from Parquet or CSV by the file's ending; the columns that the settings name come out as id, title, manufacturer and price."""
    own = dict(zip(("id", "title", "manufacturer", "price"), (settings["dataset.id_col"], settings["dataset.text_col"], *settings["dataset.structured_cols"]), strict=True))

    def entities(path: str) -> DataFrame:
        df = spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path, T.StructType([T.StructField(own[f.name], f.dataType) for f in ENTITY]))
        return df.select(*[F.col(f"`{own[f.name]}`").cast(f.dataType).alias(f.name) for f in ENTITY])

    def labelled(path: str, split: str) -> DataFrame:
        return spark.read.parquet(path) if path.endswith(".parquet") else read_pairs(spark, path, split)

    return {t: entities(settings[f"dataset.table_{t}"]) for t in "ab"} | {s: labelled(settings[f"dataset.{s}"], s) for s in ("train", "valid", "test")}


def run_blocking(data: dict[str, DataFrame], settings: Settings) -> tuple[DataFrame, float]:
    """Candidates and the share of labelled matches among them."""
    found = stored(generate_candidates(data["a"], data["b"], settings["blocking.threshold"]))
    labels = data["train"].select("ltable_id", "rtable_id", "label")
    for s in ("valid", "test"):
        labels = labels.unionByName(data[s].select("ltable_id", "rtable_id", "label"))
    return found, recall_ceiling(found, labels).head().ceiling


def run_features(spark: SparkSession, data: dict[str, DataFrame], settings: Settings) -> dict[str, DataFrame]:
    """Feature vectors of the three labelled splits; embeddings come from the cache if data and encoder are the same."""
    name = settings["pipeline.embedding_model"]
    if name not in ENCODERS:
        raise ValueError(f"pipeline.embedding_model: no encoder {name!r} is registered in features.ENCODERS, only {', '.join(ENCODERS)}")
    folder = settings["pipeline.artifacts_dir"]
    emb = {t: cached_embeddings(spark, folder, f"{name} {input_hash(data[t])}", lambda t=t: precompute_embeddings(data[t], ENCODERS[name])) for t in "ab"}
    labelled = {s: data[s].where("label is not null") for s in ("train", "valid", "test")}
    return {s: stored(pair_features(df.select("ltable_id", "rtable_id", "label"), data["a"], data["b"], emb["a"], emb["b"])) for s, df in labelled.items()}


def run_train(features: dict[str, DataFrame], settings: Settings) -> GBTClassificationModel:
    p = settings["model.params"]
    model = train_model(
        to_vectors(features["train"]), to_vectors(features["valid"]), rounds=p["n_estimators"], patience=settings["model.early_stopping_rounds"], rate=float(p["learning_rate"]),
        depth=max(1, math.ceil(math.log2(p["num_leaves"]))), seed=settings["pipeline.random_seed"], weight=p["scale_pos_weight"],
    )
    model.write().overwrite().save(f"{settings['pipeline.artifacts_dir']}/model")
    log.info("trained %d trees", model.getNumTrees)
    return model


def run_evaluate(model: GBTClassificationModel, features: dict[str, DataFrame], settings: Settings, ceiling: float | None = None) -> dict:
    """Calibrate on valid, measure on test, write metrics.json and results.json."""
    calibrated, threshold = calibrate(model, to_vectors(features["valid"]))
    figures = evaluate(calibrated, to_vectors(features["test"]), threshold)
    results = {"model": figures, "baseline": evaluate_naive_baseline(features["test"], features["valid"])}
    if ceiling is not None:
        results["blocking_recall_ceiling"] = ceiling
    out = Path(settings["pipeline.output_dir"])
    write_json({k: v for k, v in figures.items() if k != "brier_score_raw"}, out / "metrics.json")
    write_json(results, out / "results.json")
    return results


def run_pipeline(spark: SparkSession, settings: Settings, step: str = "all") -> dict:
    """``train``, ``evaluate`` (with the saved model) or ``all``."""
    data = load_data(spark, settings)
    features = run_features(spark, data, settings)
    if step == "evaluate":
        return run_evaluate(GBTClassificationModel.load(f"{settings['pipeline.artifacts_dir']}/model"), features, settings)
    _, ceiling = run_blocking(data, settings)
    model = run_train(features, settings)
    if step == "train":
        return {"blocking_recall_ceiling": ceiling, "trees": model.getNumTrees}
    return run_evaluate(model, features, settings, ceiling)
