"""Toxicity by a classifier chain.

A linear model for each category, in order; each later model has the probabilities of the earlier categories
among its features. So that they mean the same in training as in use, the training values are out of fold:
each row's comes from a model fitted on the other folds. The models are logistic regressions with an L1
penalty over the words and word beginnings of a text, which leaves the few that tell.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import LETTERS, sized_broadcast
from placestat.operators.graph import checkpoint

WORDS = re.compile(LETTERS)
#: Lengths of the word beginnings that are features beside the words, for inflected forms.
PREFIXES = (4, 5)


def text_features(text: str | None) -> set[str]:
    """Distinct lower-case words and beginnings of longer words; none for null."""
    words = set(WORDS.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Binary features of texts as rows of column numbers, with dense columns beside them."""

    starts: np.ndarray
    cols: np.ndarray
    width: int
    dense: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)
        return Rows(np.concatenate([[0], np.cumsum(sizes[keep])]), self.cols[np.repeat(keep, sizes)], self.width, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(w.take(self.cols))])
        return np.diff(run[self.starts])

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=np.repeat(r, np.diff(self.starts)), minlength=self.width)


def fit_l1(x: Rows, y: np.ndarray, reg: float, iterations: int, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of binary columns, of dense columns, intercept) by accelerated proximal gradient steps.

    Columns are scaled to unit deviation, so the penalty treats rare and frequent words alike; the dense
    columns and the intercept are not penalised.
    """
    n, share = len(y), x.transposed(np.ones(len(y))) / max(1, len(y))
    scale = np.where(share > 0, np.sqrt(np.maximum(share * (1 - share), 0.5 / n)), 1.0)
    d_mean, d_scale = (x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-9) if x.dense.size else (np.zeros(x.dense.shape[1]), np.ones(x.dense.shape[1]))
    dense = (x.dense - d_mean) / d_scale

    def forward(w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        s = w / scale
        return x.times(s) - share @ s + dense @ v + b

    def gradient(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return (x.transposed(r) - share * r.sum()) / scale / n, dense.T @ r / n, float(r.mean())

    if start is None:
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        start = (np.zeros(x.width), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    w, v, b = (np.array(start[0]), np.array(start[1]), start[2])
    probe = np.random.default_rng(1).standard_normal(x.width)
    for _ in range(6):
        probe /= np.linalg.norm(probe) + 1e-12
        probe = gradient(forward(probe, np.zeros(dense.shape[1]), 0.0))[0]
    step = 1 / (0.25 * max(np.linalg.norm(probe) * 1.1, 1 + dense.shape[1]))
    ow, ov, ob, momentum = w, v, b, 1.0
    for _ in range(iterations):
        g_w, g_v, g_b = gradient(sigmoid(forward(ow, ov, ob)) - y)
        moved = ow - step * g_w
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * reg, 0)
        new_v, new_b = ov - step * g_v, ob - step * g_b
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        k = (momentum - 1) / after
        ow, ov, ob, momentum = new_w + k * (new_w - w), new_v + k * (new_v - v), new_b + k * (new_b - b), after
        w, v, b = new_w, new_v, new_b
    out_w, out_v = w / scale, v / d_scale
    return out_w, out_v, float(b - share @ out_w - d_mean @ out_v)


def fit_chain(texts: list[str | None], labels: np.ndarray, folds: np.ndarray, vocabulary: int, min_texts: int, reg: float, iterations: int) -> list:
    """A model a column of ``labels`` (nan: not known): a constant, or (weights by feature, weights of the earlier, intercept)."""
    found = [text_features(t) for t in texts]
    seen = Counter(f for s in found for f in s)
    common = sorted((f for f, c in seen.items() if c >= min_texts), key=lambda f: (-seen[f], f))[:vocabulary]
    ids = {f: i for i, f in enumerate(common)}
    rows = [sorted(ids[f] for f in s if f in ids) for s in found]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    cols = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=int(starts[-1]))
    earlier, models = np.zeros((len(texts), 0)), []

    def constant(y: np.ndarray) -> float | None:
        return None if 0 < y.sum() < len(y) else float(len(y) > 0 and y[0] > 0)

    for j in range(labels.shape[1]):
        x, y = Rows(starts, cols, len(common), earlier), labels[:, j]
        known = ~np.isnan(y)
        alone = constant(y[known])
        if alone is not None:
            models.append(alone)
            earlier = np.column_stack([earlier, np.full(len(texts), alone)])
            continue
        whole = fit_l1(x.take(known), y[known], reg, iterations)
        models.append(({common[i]: float(whole[0][i]) for i in np.flatnonzero(whole[0])}, whole[1].tolist(), whole[2]))
        out = np.zeros(len(texts))
        for fold in np.unique(folds) if j < labels.shape[1] - 1 else []:
            mine, rest = folds == fold, known & (folds != fold)
            part = constant(y[rest])
            if part is None:
                w, v, b = fit_l1(x.take(rest), y[rest], reg, iterations)
                held = x.take(mine)
                out[mine] = sigmoid(held.times(w) + held.dense @ v + b)
            else:
                out[mine] = part
        earlier = np.column_stack([earlier, out])
    return models


def chain_predict(models: list, text: str | None) -> list[float]:
    """Probabilities of the categories in order, each fed to the next."""
    found, out = text_features(text), []
    for m in models:
        if isinstance(m, float):
            out.append(m)
        else:
            weights, before, b = m
            z = b + sum(weights[f] for f in weights.keys() & found) + sum(w * p for w, p in zip(before, out, strict=True))
            out.append(float(sigmoid(np.float64(z))))
    return out


def chain_probabilities(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = 10_000,
    folds: int = 3,
    vocabulary: int = 100_000,
    min_texts: int = 3,
    reg: float = 0.002,
    iterations: int = 120,
) -> DataFrame:
    """Ids of ``docs`` with p_<category> for each of ``categories``, columns of ``labels`` with 0 or 1.

    Fitted in one task on at most ``max_train`` labelled documents (those with the least MD5 of the id), with
    at most ``vocabulary`` words and word beginnings found in ``min_texts`` of them as yes-or-no features. A
    null label leaves its row out of that category; a category without both classes has probability 0 or 1,
    0 if it has no row. Null and empty texts have no words. Repeated rows each give a row; null ids are
    scored but not learned from.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(c).cast("double").alias(c) for c in categories])
    known = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    chosen = sized_broadcast(known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_train), max_train)
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(chosen, "id").dropDuplicates(["id"])
    train = train.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        y = pdf[categories].to_numpy(dtype=float)
        models = fit_chain(list(pdf["t"]), y, pdf["fold"].to_numpy(), vocabulary, min_texts, reg, iterations)
        return pd.DataFrame({"model": [pickle.dumps(models)]})

    found = checkpoint(train.groupBy().applyInPandas(fit, "model binary")).collect()
    models = pickle.loads(bytes(found[0].model)) if found else [0.0] * len(categories)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"p_{c}" for c in categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([chain_predict(shared.value, t) for t in s], columns=names)

    scored: Column = score(F.col("__t"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")).select("doc_id", scored.alias("p")).select("doc_id", "p.*")
