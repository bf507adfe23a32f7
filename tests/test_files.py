import json

import pytest

from matchloom.config import load_config
from matchloom.operators.trees import probability, read_trees, tree_nodes
from matchloom.sources import files as S
from matchloom.streaming.scoring import freeze_index, score_batch, score_stream

YAML = """
dataset: {name: toys, table_a: A, table_b: B, train: T, valid: V, test: X}
blocking: {threshold: 0.38}
model: {params: {n_estimators: 3}}
"""
MODEL = """tree
version=v4
feature_names=x y

Tree=0
num_leaves=3
split_feature=0 1
threshold=0.5 2
decision_type=10 8
left_child=1 -1
right_child=-3 -2
leaf_value=0.25 -0.5 1

Tree=1
num_leaves=1
leaf_value=0.125

end of trees
"""


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,title,manufacturer,price,more\n1,"a ""b"", c",NA,5.5,x\n2,"two\nlines",maker,NaN,y\n')
    rows = S.read_entities(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b", c', None, 5.5), (2, "two\nlines", "maker", None)]
    path.write_text("ltable_id,rtable_id,label\n1,2,1\n3,4,\n")
    assert sorted(tuple(r) for r in S.read_pairs(spark, str(path), "train").fillna(-1).collect()) == [(1, 2, 1, "train"), (3, 4, -1, "train")]


def test_checksums_and_ingest(spark, tmp_path):
    source = tmp_path / "s.txt"
    source.write_text("hello")
    digest = S.sha256(source)
    assert S.checksums(spark, str(source)).head().sha256 == digest
    assert S.ingest(str(source), tmp_path / "t" / "t.txt", digest).read_text() == "hello"
    with pytest.raises(ValueError, match="wrong checksum"):
        S.ingest(str(source), tmp_path / "u.txt", "0" * 64)
    assert not (tmp_path / "u.txt").exists()


def test_results(spark, tmp_path):
    S.write_json({"model": {"f1": 0.5}}, tmp_path / "out" / "results.json")
    assert json.loads((tmp_path / "out" / "results.json").read_text()) == {"model": {"f1": 0.5}}
    assert S.read_results(spark, str(tmp_path / "out" / "results.json")).head().model.f1 == 0.5


def test_cache_is_keyed_by_content(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert S.cached_embeddings(spark, str(tmp_path), key, make).count() == 3
    assert len(made) == 2
    one, two = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,)], "x int")
    assert S.input_hash(one) == S.input_hash(two) != S.input_hash(one.limit(1))


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    config = load_config(path)
    assert (config["dataset.name"], config["blocking.threshold"], config["model.params"]["n_estimators"], config["pipeline.random_seed"]) == ("toys", 0.38, 3, 42)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    path.write_text("blocking: {}")
    with pytest.raises(KeyError):
        load_config(path)
    path.write_text(YAML + "pipeline: {nothing: 1}")
    with pytest.raises(TypeError):
        load_config(path)
    for more, error in (("blocking: {method: other}", ValueError), ("model: {type: svm}", ValueError), ("model: {params: {max_bin: 3}}", TypeError), ("model: {early_stopping_rounds: x}", TypeError)):
        path.write_text("\n".join(x for x in YAML.splitlines() if not x.startswith(more.split(":")[0])) + "\n" + more)
        with pytest.raises(error):
            load_config(path)


def test_download_step(tmp_path, capsys):
    from matchloom.__main__ import main

    source, target = tmp_path / "s.csv", tmp_path / "data" / "a.csv"
    source.write_text("id,title\n1,x\n")
    path = tmp_path / "c.yaml"
    path.write_text(YAML.replace("table_a: A", f"table_a: {target}").replace("test: X}", f"test: X, sources: {{table_a: {{from: {source}, sha256: {S.sha256(source)}}}}}}}"))
    assert main(["--config", str(path), "--step", "download", "-v"]) == 0 and target.read_text() == source.read_text()
    assert "tables: 1" in capsys.readouterr().out
    assert main(["--config", str(path), "--step", "evaluate"]) == 1


def test_own_columns(spark, tmp_path):
    from matchloom.config import settings_of
    from matchloom.pipeline import load_data

    (tmp_path / "a.csv").write_text("key,name,brand,cost\n1,x y,acme,2.5\n")
    (tmp_path / "p.csv").write_text("ltable_id,rtable_id,label\n1,1,1\n")
    paths = {t: str(tmp_path / "a.csv") for t in ("table_a", "table_b")} | {s: str(tmp_path / "p.csv") for s in ("train", "valid", "test")}
    data = load_data(spark, settings_of({"dataset": {"name": "own", **paths, "id_col": "key", "text_col": "name", "structured_cols": ["brand", "cost"]}}))
    assert [tuple(r) for r in data["a"].collect()] == [(1, "x y", "acme", 2.5)] and data["a"].columns == ["id", "title", "manufacturer", "price"]


def test_model_text(spark, tmp_path):
    path = tmp_path / "model.txt"
    path.write_text(MODEL)
    names, trees = read_trees(path)
    df = spark.createDataFrame([(0.4, 1.0), (0.4, 3.0), (0.6, 0.0), (None, 1.0), (0.4, None)], "x double, y double")
    logit = lambda p: round(__import__("math").log(p / (1 - p)), 6)
    got = [logit(r.p) for r in df.select(probability(names, trees).alias("p")).collect()]
    assert got == [0.375, -0.375, 1.125, 0.375, -0.375]
    assert tree_nodes(spark, trees, names).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    reference = spark.createDataFrame([(1, "adobe photoshop cs3"), (2, "norton antivirus 2023"), (3, None)], "id long, title string")
    postings, idf = freeze_index(reference)
    new = spark.createDataFrame([(10, "photoshop cs3 adobe"), (11, "zzz"), (12, None)], "id long, title string")
    batch = score_batch(new, postings, idf, 0.3)
    assert [(r.new_id, r.ref_id) for r in batch.collect()] == [(10, 1)]
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, postings, idf, 0.3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [(r.new_id, r.ref_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(10, 1)]
