"""Boosted regression trees under the logistic loss, grown by one barrier job whose tasks add their histograms up over sockets."""

from __future__ import annotations

import secrets
import socket
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Bins of a feature.
BINS = 255
#: Rows of training and validation for each task; their features take one byte each.
ROWS_PER_TASK = 20_000
#: A node of the result: -1 as ``feature`` marks a leaf; ``loss`` is that of the validation rows after the tree.
NODES = "tree int, node int, prediction double, impurity double, weight double, total double, squares double, rows long, gain double, left int, right int, feature int, threshold double, loss double"


class Sum:
    """Adds up arrays of all tasks of a barrier stage, in the tasks' order; the first task gathers and sends the sum back."""

    def __init__(self, context: BarrierTaskContext):
        self.peers, rank, n = [], context.partitionId(), len(context.getTaskInfos())
        server = socket.create_server(("", 0), backlog=n) if rank == 0 else None
        said = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")
        port, token = said[0].split()
        if server:
            found = {}
            server.settimeout(300)
            while len(found) < n - 1:
                peer, _ = server.accept()
                peer.settimeout(300)
                hello = self._got(peer, 40).decode()
                if secrets.compare_digest(hello[:32], token):
                    found[int(hello[32:])] = peer
            self.peers = [found[k] for k in sorted(found)]
            server.close()
        else:
            peer = socket.create_connection((context.getTaskInfos()[0].address.split(":")[0], int(port)), timeout=300)
            peer.sendall(f"{token}{rank:08d}".encode())
            self.peers = [peer]
        self.first = rank == 0
        for peer in self.peers:
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _got(peer: socket.socket, n: int) -> bytearray:
        out, at = bytearray(n), 0
        while at < n:
            k = peer.recv_into(memoryview(out)[at:])
            if not k:
                raise ConnectionError("another task of the training has ended")
            at += k
        return out

    def __call__(self, own: np.ndarray) -> np.ndarray:
        own = np.ascontiguousarray(own, dtype=np.float64)
        if self.first:
            for peer in self.peers:
                own = own + np.frombuffer(self._got(peer, own.nbytes)).reshape(own.shape)
            for peer in self.peers:
                peer.sendall(own.tobytes())
            return own
        self.peers[0].sendall(own.tobytes())
        return np.frombuffer(self._got(self.peers[0], own.nbytes)).reshape(own.shape)


def grown(bins: np.ndarray, cuts: list[np.ndarray], w: np.ndarray, target: np.ndarray, depth: int, least: int, total) -> tuple[list[dict], np.ndarray]:
    """A tree that fits ``target`` by least weighted squares, level by level, as rows of nodes, and what it predicts for each row of ``bins``.

    ``bins(feature, row)``; rows of weight 0 take no part, but get predictions.  A node is split where the weighted variance falls most, the
    first such feature and bin, if both sides keep ``least`` rows of weight; ``total`` adds up over tasks.
    """
    own = w > 0
    at, nodes, level = np.zeros(len(w), np.int32), [], [0]
    wt = w * target
    for d in range(depth + 1):
        k, base = len(level), level[0]
        live = np.flatnonzero((at >= base) & own)
        local = at[live] - base
        sums = [np.bincount(local, v, k) for v in (np.ones(len(live)), w[live], wt[live], wt[live] * target[live])]
        hist = np.zeros((0,))
        if d < depth:
            hist = np.zeros((3, len(bins), k, BINS + 1))
            for f, b in enumerate(bins):
                key = local * (BINS + 1) + b[live]
                for s, v in enumerate((None, w[live], wt[live])):
                    hist[s, f] = np.bincount(key, v, k * (BINS + 1)).reshape(k, BINS + 1)
        both = total(np.concatenate([np.concatenate(sums), hist.ravel()]))
        n, weight, summed, squares = both[: 4 * k].reshape(4, k)
        mean = summed / np.maximum(weight, 1e-300)
        impurity = np.maximum(squares / np.maximum(weight, 1e-300) - mean * mean, 0.0)
        best, where = np.zeros(k), np.zeros(k, np.int64)
        if d < depth:
            left = np.cumsum(both[4 * k :].reshape(hist.shape), axis=3)
            right = left[..., -1:] - left
            with np.errstate(all="ignore"):
                gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - (summed**2 / weight)[None, :, None]
            gain = np.where((left[0] >= least) & (right[0] >= least) & np.isfinite(gain), gain, 0.0)
            flat = gain.transpose(1, 0, 2).reshape(k, -1)
            where = flat.argmax(axis=1)
            best = flat[np.arange(k), where] / np.maximum(weight, 1e-300)
        following, split = base + k, {}
        for i in range(k):
            row = {"node": base + i, "prediction": mean[i], "impurity": impurity[i], "weight": weight[i], "total": summed[i], "squares": squares[i], "rows": int(n[i]), "gain": -1.0, "left": -1, "right": -1, "feature": -1, "threshold": 0.0}
            if best[i] > 1e-12 * max(1.0, impurity[i]):
                f, b = divmod(int(where[i]), BINS + 1)
                row |= {"gain": best[i], "left": following, "right": following + 1, "feature": f, "threshold": float(cuts[f][b])}
                split[base + i] = f, b, following
                following += 2
            nodes.append(row)
        if not split:
            break
        for i, (f, b, to) in split.items():
            rows = np.flatnonzero(at == i)
            at[rows] = to + (bins[f][rows] > b)
        level = list(range(base + k, following))
    return nodes, np.array([r["prediction"] for r in nodes])[at]


def _trainer(cuts: list[np.ndarray], weight: float, rounds: int, patience: int, rate: float, depth: int, least: int):
    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        total = Sum(context)
        parts = [(np.vstack([np.searchsorted(c, x, side="left").astype(np.uint8) for c, x in zip(cuts, np.stack(f["x"].to_numpy()).T, strict=True)]), f["y"].to_numpy(float), f["held"].to_numpy(bool)) for f in frames if len(f)]
        bins, y, held = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3)) if parts else (np.zeros((len(cuts), 0), np.uint8), np.zeros(0), np.zeros(0, bool))
        order = np.lexsort([*bins, y, held])  # sums must not depend on the order in which rows arrive
        bins, y, held = np.ascontiguousarray(bins[:, order]), y[order], held[order]
        sign, w = 2 * y - 1, np.where(held, 0.0, np.where(y == 1, weight, 1.0))
        score, lowest, best = np.zeros(len(y)), np.inf, 0
        for t in range(rounds):
            target = 4 * sign / (1 + np.exp(2 * sign * score)) if t else sign
            nodes, predicted = grown(bins, cuts, w, target, depth, least, total)
            score = score + predicted * (rate if t else 1.0)
            loss = total(np.array([(2 * np.logaddexp(0, -2 * sign[held] * score[held])).sum(), held.sum()]))
            loss = loss[0] / max(loss[1], 1)
            if total.first:
                yield pd.DataFrame(nodes).assign(tree=t, loss=loss)[[c.split()[0] for c in NODES.split(", ")]]
            if loss < lowest:
                lowest, best = loss, t
            elif t - best >= patience:
                break

    return train


def boosted_trees(train: DataFrame, valid: DataFrame, weight: float, rounds: int, patience: int, rate: float, depth: int, least: int = 20) -> DataFrame:
    """Nodes of all trees that were grown (see ``NODES``) from ``features``/``y``, until the loss on ``valid`` has not fallen for ``patience`` trees.

    As in MLlib, the first tree fits the labels -1 and 1 and counts in full, the others fit the negative gradient of twice the
    logistic loss and count ``rate``.  A feature is cut at its quantiles over ``train`` into at most ``BINS`` bins.  The rows are spread over
    tasks of one barrier stage, as many as its cores allow; a task keeps a byte for each feature of its rows, and what tasks exchange
    depends on the nodes and bins alone.
    """
    spark = train.sparkSession
    ship(spark)
    wide = train.select(vector_to_array("features").alias("x"))
    size = len(wide.head().x)
    steps = [i / BINS for i in range(1, BINS)]
    cuts = [np.unique(np.array(c, float)) for c in wide.agg(*[F.percentile_approx(F.col("x")[i], steps, 100_000).alias(f"q{i}") for i in range(size)]).head()]
    rows = train.select(F.lit(False).alias("held"), "y", vector_to_array("features").alias("x")).unionByName(valid.select(F.lit(True).alias("held"), "y", vector_to_array("features").alias("x")))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)))
    return rows.repartition(tasks, F.xxhash64("x")).mapInPandas(_trainer(cuts, weight, rounds, patience, rate, depth, least), NODES, barrier=True)
