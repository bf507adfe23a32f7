"""Groups of records that are linked directly or over others (connected components on a two-dimensional grid)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import dropped, joined, stored

#: Links that one cell of the grid takes on average.
LINKS_PER_CELL = 400_000


def local_representatives(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the links u-v with the smallest vertex of its group, by vectorised union-find."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(names))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return names, names[parent]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cell(frame: pd.DataFrame) -> pd.DataFrame:
    name, rep = local_representatives(frame["u"].to_numpy(np.int64), frame["v"].to_numpy(np.int64))
    keep = name != rep
    return pd.DataFrame({"v": name[keep], "r": rep[keep]})


def block_of(c: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(blocks)).cast("int")


def exchanged(found: DataFrame, moved: DataFrame, blocks: int) -> DataFrame:
    """``(u, v, row, col)``: each representative u that now points to v, for the cells of its column in which it stands.

    ``found(v, p)`` has every vertex's representative.  A representative goes to no more cells than it has vertices, so
    the exchange is bounded by the vertices whatever the number of blocks.
    """
    cells = found.select(F.col("p").alias("u"), block_of("v", blocks).alias("row")).distinct()
    return joined(moved, cells, "u").select("u", "v", "row", block_of("u", blocks).alias("col"))


def connected_components(links: DataFrame, u: str, v: str, blocks: int | None = None) -> DataFrame:
    """One row ``(vertex BIGINT, component BIGINT)`` for every vertex of ``links``; component is its group's smallest vertex.

    Vertices are hashed into ``blocks`` blocks and each link u-v goes to the grid cell (block of u, block of v), so the
    links of one vertex, however many, spread over a whole row of cells.  Each round runs union-find inside every cell,
    takes the smallest representative that any cell found for a vertex, and sends what a representative itself now points
    to down its column, to the cells in which it stands.  It ends when no vertex has two representatives and
    every representative points to itself.

    Links with a null end are ignored, a link of a vertex to itself makes it a group of its own, repeated links count
    once, and an empty table gives an empty result.  Other columns of ``links`` are not looked at.
    """
    pairs = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if blocks is None:
        blocks = max(2, math.ceil(math.sqrt(pairs.count() / LINKS_PER_CELL)))

    def block(c: str) -> Column:
        return block_of(c, blocks)

    placed = pairs.where("u <> v").select("u", "v", block("u").alias("row"), block("v").alias("col"))
    before = None
    while True:
        inside = placed.groupBy("row", "col").applyInPandas(lambda frame: _cell(frame), "v long, r long")
        found = stored(inside.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("all")))
        if before is not None:
            dropped(before)
        # a vertex sits in at most 2 x blocks cells, which bounds the set of its representatives
        merged = found.where("size(all) > 1").select(F.explode("all").alias("u"), F.col("p").alias("v")).where("u <> v").distinct()
        parents = found.select(F.col("p").alias("u")).distinct()
        moved = joined(found.select(F.col("v").alias("u"), F.col("p").alias("v")), parents, "u", "left_semi")
        open_ends = merged.select(F.lit(1).alias("x")).unionByName(moved.select(F.lit(1).alias("x"))).limit(1).count()
        if not open_ends:
            break
        stars = found.select(F.col("v").alias("u"), F.col("p").alias("v")).unionByName(merged)
        placed = stars.select("u", "v", block("u").alias("row"), block("v").alias("col")).unionByName(exchanged(found, moved, blocks))
        before = found
    ends = pairs.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    return joined(ends, found.select(F.col("v").alias("vertex"), "p"), "vertex", "left").select("vertex", F.coalesce("p", "vertex").alias("component"))


#: Records of the right-hand table are numbered above those of the left-hand one, so a group's smallest vertex is its
#: smallest left-hand id.  Ids must lie within +-2**61.
RIGHT = 1 << 62


def link_groups(pairs: DataFrame, left: str = "ltable_id", right: str = "rtable_id", label: str = "label") -> DataFrame:
    """``(side, id, group_id)`` for every record in a pair with label 1; ``group_id`` is the group's smallest left id.

    A pair labelled 0 elsewhere stays a link; null labels and pairs without one of the ids are no links.
    """
    links = pairs.where(F.col(label) == 1).select(F.col(left).alias("u"), (F.col(right) + F.lit(RIGHT)).alias("v"))
    groups = connected_components(links, "u", "v")
    side = F.when(F.col("vertex") >= RIGHT >> 1, "b").otherwise("a")
    return groups.select(side.alias("side"), F.when(side == "b", F.col("vertex") - F.lit(RIGHT)).otherwise(F.col("vertex")).alias("id"), F.col("component").alias("group_id"))
