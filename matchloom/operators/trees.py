"""Boosted trees in the public text format, scored as Column expressions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trees(path: str | Path) -> tuple[list[str], list[dict]]:
    """Feature names and trees of a model file (see ``parse_trees``)."""
    return parse_trees(Path(path).read_text())


def parse_trees(text: str) -> tuple[list[str], list[dict]]:
    """Feature names and trees of a model's text; a tree has split_feature, threshold, decision_type, left/right_child and leaf_value."""
    names, trees, tree = [], [], None
    for line in text.splitlines():
        key, _, value = line.partition("=")
        if key == "feature_names":
            names = value.split()
        elif key == "Tree":
            trees.append(tree := {})
        elif line.startswith("end of trees"):
            break
        elif tree is not None and key in ("split_feature", "decision_type", "left_child", "right_child"):
            tree[key] = [int(x) for x in value.split()]
        elif tree is not None and key in ("threshold", "leaf_value"):
            tree[key] = [float(x) for x in value.split()]
    return names, trees


def _node(tree: dict, names: list[str], at: int) -> Column:
    if at < 0:
        return F.lit(tree["leaf_value"][~at])
    c, kind = F.col(names[tree["split_feature"][at]]), tree["decision_type"][at]
    if kind & 1:
        raise ValueError("categorical splits are not supported")
    missing = c.isNull() | F.isnan(c)
    how = kind >> 2 & 3  # 0: a missing value is compared as zero, 1: zero counts as missing, 2: NaN is missing
    if how == 0:
        left = F.coalesce(F.when(missing, F.lit(0.0)).otherwise(c) <= tree["threshold"][at], F.lit(False))
    else:
        lost = missing | (F.abs(c) <= 1e-35) if how == 1 else missing
        left = F.when(lost, F.lit(bool(kind & 2))).otherwise(c <= tree["threshold"][at])
    return F.when(left, _node(tree, names, tree["left_child"][at])).otherwise(_node(tree, names, tree["right_child"][at]))


def raw_score(names: list[str], trees: list[dict]) -> Column:
    """Sum of the trees' leaves; leaf values already hold the learning rate."""
    total = F.lit(0.0)
    for tree in trees:
        total = total + (_node(tree, names, 0) if tree.get("split_feature") else F.lit(tree["leaf_value"][0]))
    return total


def probability(names: list[str], trees: list[dict]) -> Column:
    return 1 / (1 + F.exp(-raw_score(names, trees)))


def tree_nodes(spark: SparkSession, trees: list[dict], names: list[str]) -> DataFrame:
    """``(tree, node, feature, threshold, left, right)``: the splits as rows."""
    rows = [
        (t, i, names[tree["split_feature"][i]], tree["threshold"][i], tree["left_child"][i], tree["right_child"][i]) for t, tree in enumerate(trees) for i in range(len(tree.get("split_feature", [])))
    ]
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int")
