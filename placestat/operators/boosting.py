"""Histogram gradient boosting for many groups of rows together.

Feature values are binned once. A level of the trees of all groups is one job: the partitions add up residuals and rows by (group, node,
feature, bin), and the driver picks every node's best split from the sums, whose size depends on groups, nodes and bins only. Rows
carry their predictions up to the last checkpoint; later trees are applied on the fly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from placestat.operators.graph import checkpoint, ensure_checkpoint_dir


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: (trees, nodes) of feature and threshold (at most goes left), (trees, leaves) of value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                right = ~(x[rows, f[node]] <= t[node])
                node = 2 * node + 1 + right
            out += v[node - (len(f))]
        return out


def bin_edges(rows: DataFrame, group: str, features: list[str], bins: int) -> dict:
    """group -> for each feature the sorted midpoints between values at its quantiles, fewer than ``bins``."""
    at = [i / bins for i in range(bins + 1)]
    found = rows.groupBy(group).agg(*[F.percentile_approx(F.col(c).cast("double"), at, 20 * bins).alias(c) for c in features]).collect()
    out = {}
    for r in found:
        out[r[group]] = []
        for c in features:
            v = np.unique(np.array(r[c] or [0.0], dtype=float))
            out[r[group]].append((v[1:] + v[:-1]) / 2)
    return out


def _kept(key: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """The rows that a tree learns from, the same in every job."""
    h = (key.astype(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _walk(block: dict, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Each row's node after ``depth`` levels, by bins."""
    rows, g = np.arange(len(block["y"])), block["g"]
    node = np.zeros(len(rows), dtype=np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (block["bins"][rows, feature[g, node]] > cut[g, node])
    return node


def _margins(block: dict, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    out = block["margin"]
    for feature, cut, value in trees:
        out = out + value[block["g"], _walk(block, feature, cut, depth) - feature.shape[1]]
    return out


def fit_boosted(rows: DataFrame, group: str, features: list[str], target: str, trees: int = 300, depth: int = 3, step: float = 0.05, subsample: float = 0.9, bins: int = 128, seed: int = 42, every: int = 25, rows_a_part: int = 50_000) -> dict[object, Trees]:
    """Trees by group for squared error, each tree fitted to the residuals of those before on a hashed ``subsample`` of the rows.

    Null features are a bin of their own, right of all values; rows with a null group or target are left out. Every ``every`` trees the predictions are
    checkpointed. Groups are few (their split sums are held by the driver).
    """
    used = checkpoint(rows.where(F.col(group).isNotNull() & F.col(target).isNotNull()).select(group, *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("__y")))
    stats = {r[group]: r for r in used.groupBy(group).agg(F.avg("__y").alias("base"), F.count("*").alias("n")).collect()}
    groups, edges = sorted(stats, key=str), bin_edges(used, group, features, bins)
    index, base = {g: i for i, g in enumerate(groups)}, np.array([stats[g]["base"] for g in groups])
    names = [group, "__y", *features]

    def pack(batches: Iterator) -> Iterator[dict]:
        """One block of arrays a partition."""
        parts = []
        for b in batches:
            g = np.array([index[x] for x in b.column(0).to_pylist()], dtype=np.int32)
            found = np.zeros((b.num_rows, len(features)), dtype=np.int16)
            for k in range(len(features)):
                x = b.column(2 + k).to_numpy(zero_copy_only=False).astype(float)
                for name, i in index.items():
                    found[g == i, k] = np.where(np.isnan(x[g == i]), len(edges[name][k]) + 1, np.searchsorted(edges[name][k], x[g == i], "left"))
            parts.append((g, found, b.column(1).to_numpy()))
        if parts:
            g, found, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            h = np.zeros(len(y), dtype=np.uint64)
            for k in range(found.shape[1]):
                h = h * np.uint64(1_000_003) + found[:, k].astype(np.uint64)
            h += y.view(np.uint64) + g.astype(np.uint64) + np.arange(len(y), dtype=np.uint64)
            yield {"g": g, "bins": found, "y": y, "key": h, "margin": base[g]}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    total = sum(r["n"] for r in stats.values())
    parts = 1 + total // rows_a_part
    # one element a partition: a block of arrays that every level's job passes over
    blocks = used.select(*names).coalesce(parts).mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(rows.sparkSession)
    sc, size, nodes, width = rows.sparkSession.sparkContext, len(features), 2**depth - 1, bins + 2
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    recent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tree in range(trees):
        feature, cut = np.zeros((len(groups), nodes), dtype=np.int64), np.full((len(groups), nodes), width, dtype=np.int64)
        value = np.zeros((len(groups), nodes + 1))
        for level in range(depth):
            here, first = 2**level, 2**level - 1

            def sums(part: Iterator[dict], level=level, here=here, first=first, feature=feature, cut=cut, recent=tuple(recent), tree=tree) -> Iterator[np.ndarray]:
                out = np.zeros(2 * len(groups) * here * size * width)
                for b in part:
                    keep = _kept(b["key"], tree, seed, subsample)
                    b = {k: v[keep] for k, v in b.items()}
                    gap = b["y"] - _margins(b, list(recent), depth)
                    cell = (b["g"].astype(np.int64) * here + _walk(b, feature, cut, level) - first)[:, None] * size + np.arange(size)
                    cell = (cell * width + b["bins"]).ravel()
                    n = len(out) // 2
                    out[:n] += np.bincount(cell, np.repeat(gap, size), minlength=n)
                    out[n:] += np.bincount(cell, minlength=n)
                yield out

            found = blocks.mapPartitions(sums)
            got = found.treeReduce(lambda a, b: a + b) if parts > 16 else found.reduce(lambda a, b: a + b)
            s, n = got.reshape(2, len(groups), here, size, width)
            left, count = s.cumsum(axis=-1), n.cumsum(axis=-1)
            whole, rows_of = left[..., -1:], count[..., -1:]
            right, others = whole - left, rows_of - count
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((count > 0) & (others > 0), count * others / np.maximum(rows_of, 1) * (left / count - right / others) ** 2, 0.0)
                best = gain.reshape(len(groups), here, -1).argmax(axis=-1)
                most = gain.reshape(len(groups), here, -1).max(axis=-1)
                f, c = np.divmod(best, width)
                split = most > 1e-15
                feature[:, first : first + here] = np.where(split, f, 0)
                cut[:, first : first + here] = np.where(split, c, width)
                if level == depth - 1:
                    pick = np.ogrid[: len(groups), :here]
                    ls, ln = left[(*pick, f, c)], count[(*pick, f, c)]
                    rs, rn = right[(*pick, f, c)], others[(*pick, f, c)]
                    mean = np.where(rows_of[:, :, 0, 0] > 0, whole[:, :, 0, 0] / np.maximum(rows_of[:, :, 0, 0], 1), 0.0)
                    value[:, 0::2] = step * np.where(split, ls / np.maximum(ln, 1), mean)
                    value[:, 1::2] = step * np.where(split, rs / np.maximum(rn, 1), mean)
        recent.append((feature, cut, value))
        done.append(recent[-1])
        if len(recent) == every and tree + 1 < trees:
            def moved(b: dict, recent=tuple(recent)) -> dict:
                return b | {"margin": _margins(b, list(recent), depth)}

            old, blocks = blocks, blocks.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.checkpoint()
            blocks.count()
            old.unpersist()
            recent = []
    blocks.unpersist()
    out = {}
    for i, g in enumerate(groups):
        feature = np.stack([f[i] for f, _, _ in done])
        cuts = np.stack([c[i] for _, c, _ in done])
        bounds = [np.append(edges[g][k], np.inf) for k in range(size)]
        threshold = np.array([[bounds[f][min(c, len(bounds[f]) - 1)] for f, c in zip(fs, cs, strict=True)] for fs, cs in zip(feature, cuts, strict=True)])
        out[g] = Trees(float(base[i]), feature, threshold, np.stack([v[i] for _, _, v in done]))
    return out


def predict_boosted(models: dict[object, Trees], rows: DataFrame, group: str, features: list[str], out: str = "prediction") -> DataFrame:
    """``rows`` of the known groups with the prediction of their group's trees, in Arrow batches."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [schema.names.index(c) for c in (group, *features)]
        for b in batches:
            if not b.num_rows:
                continue
            g = np.array(b.column(at[0]).to_pylist(), dtype=object)
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at[1:]], axis=1)
            p = np.zeros(b.num_rows)
            for name, m in sent.value.items():
                p[g == name] = m.predict(x[g == name])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=schema.names)

    return rows.where(F.col(group).isin(list(models))).mapInArrow(run, schema)
