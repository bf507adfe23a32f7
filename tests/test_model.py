import json
import random

import pytest

from matchloom.config import settings_of
from matchloom.operators.features import FEATURE_NAMES
from matchloom.operators.model import evaluate_naive_baseline, feature_importance, to_vectors, train_model
from matchloom.pipeline import run_pipeline


def make(spark, folder, n=40):
    r = random.Random(7)
    words = ["disk", "drive", "photo", "office", "tax", "game", "audio", "pro", "kit", "word"]
    title = lambda i: " ".join(r.sample(words, 3)) + f" {i}"
    a = [(i, title(i), "acme" if i % 3 else None, float(10 + i)) for i in range(n)]
    b = [(i, t + " new", m, p) for i, t, m, p in a]
    entity = "id long, title string, manufacturer string, price double"
    paths = {}
    for name, rows in (("a", a), ("b", b)):
        paths[name] = f"{folder}/{name}.parquet"
        spark.createDataFrame(rows, entity).write.parquet(paths[name])
    for k, name in enumerate(("train", "valid", "test")):
        rows = [(i, i, 1) for i in range(n)] + [(i, (i + 1 + k + j) % n, 0) for i in range(n) for j in range(2)] + [(0, 1, None)]
        paths[name] = f"{folder}/{name}.parquet"
        spark.createDataFrame(rows, "ltable_id long, rtable_id long, label int").write.parquet(paths[name])
    return paths


def test_pipeline(spark, tmp_path):
    p = make(spark, tmp_path)
    config = settings_of({
        "dataset": {"name": "toys", "table_a": p["a"], "table_b": p["b"], "train": p["train"], "valid": p["valid"], "test": p["test"]}, "blocking": {"threshold": 0.3},
        "model": {"params": {"n_estimators": 3, "num_leaves": 7}, "early_stopping_rounds": 2}, "pipeline": {"output_dir": str(tmp_path / "out"), "artifacts_dir": str(tmp_path / "art")},
    })
    out = run_pipeline(spark, config)
    assert out["model"]["f1"] > 0.9 and out["blocking_recall_ceiling"] > 0.5 and out["baseline"]["f1"] > 0
    assert set(json.loads((tmp_path / "out" / "metrics.json").read_text())) == {"threshold", "precision", "recall", "f1", "auc_roc", "average_precision", "brier_score", "n_test", "n_positive", "n_predicted_positive"}
    again = run_pipeline(spark, config, "evaluate")
    assert again["model"] == out["model"] and "blocking_recall_ceiling" not in again


def frame(spark, labels):
    return spark.createDataFrame([(y, *[float(y)] * len(FEATURE_NAMES)) for y in labels], "label int, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))


def test_training_needs_positives(spark):
    with pytest.raises(ValueError, match="no positive"):
        train_model(to_vectors(frame(spark, [0, 0, 0])), to_vectors(frame(spark, [0, 1])))


def test_importance_and_baseline(spark):
    df = frame(spark, [0, 1] * 40)
    model = train_model(to_vectors(df), to_vectors(df), rounds=2)
    assert feature_importance(model, spark).count() == 20
    assert evaluate_naive_baseline(df, df)["f1"] == 1.0


def test_trees_grow_until_patience_ends(spark, monkeypatch):
    from matchloom.operators import model as M

    assert M.best_round([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (1, True) and M.best_round([3.0, 2.0, 2.5], 2) == (1, False)
    monkeypatch.setattr(M, "FIRST", 1)
    df = to_vectors(frame(spark, [0, 1] * 40))
    assert train_model(df, df, rounds=7, patience=2).getNumTrees == 7


def test_scores_train_to_the_reference_limits(spark, monkeypatch):
    import matchloom.operators.model as M
    from matchloom.plans import queries as Q

    seen = {}

    def train(*_, **limits):
        seen.update(limits)
        raise InterruptedError

    monkeypatch.setattr(M, "train_model", train)
    monkeypatch.setattr(Q, "_features", lambda *_: frame(spark, [0, 1]))
    with pytest.raises(InterruptedError):
        Q.er_gbt_scores(spark, "")
    assert seen == {"rounds": 1000, "patience": 50}


def test_trees_are_grown_in_one_job_and_spread_over_tasks(spark, monkeypatch):
    from matchloom.operators import boosting as B

    r = random.Random(3)
    rows = [(int(x > 0.5) if r.random() < 0.9 else r.randint(0, 1), x, *[r.random() for _ in FEATURE_NAMES[1:]]) for x in (r.random() for _ in range(600))]
    df = to_vectors(spark.createDataFrame(rows, "label int, " + ", ".join(f"{n} double" for n in FEATURE_NAMES)))
    train, valid = df.where("abs(hash(features)) % 3 > 0"), df.where("abs(hash(features)) % 3 = 0")
    began = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    one = train_model(train, valid, rounds=1000, patience=10)
    # MLlib took several jobs for each tree
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - began < 60
    monkeypatch.setattr(B, "ROWS_PER_TASK", 150)
    parted = train_model(train, valid, rounds=1000, patience=10)
    assert 1 < one.getNumTrees == parted.getNumTrees < 1000 and one.featureImportances.toArray().argmax() == 0
    losses = one.evaluateEachIteration(valid.selectExpr("*", "1.0D w"))
    assert min(losses) == losses[-1]
    assert one.toDebugString.split(")", 1)[1].count("If") == parted.toDebugString.split(")", 1)[1].count("If")
