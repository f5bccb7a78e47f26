"""Language of words and texts by a linear-chain conditional random field.

Each word (a run of letters) has affix, n-gram, whole-word and lexicon features, hashed into a weight table
with a column a language; transitions between the languages of neighbouring words are learned as well. The
model is fitted on labelled texts from which short runs are interleaved, so that the sequences switch
language. Forward-backward gives every word's language probabilities; a text's are their mean. Chains are
the lines of a text, cut after every 256 words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import LETTERS, sized_broadcast

WORDS = re.compile(LETTERS + r"|\n")
CHAIN = 256
SLOTS = 1 << 16
UNKNOWN = "und"


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Slots of a word's features: itself, prefixes, suffixes, n-grams with its ends marked, lexicon entry.

    Affixes and n-grams are taken from its UTF-8 bytes, n-grams from all of them; each kind of feature hashes from its own start value.
    """
    b = word.encode("utf-8", "surrogatepass")
    w, crc = b"^" + b + b"$", zlib.crc32
    out = [crc(b, 1), *[crc(b[:k], 2) for k in (1, 2, 3)], *[crc(b[-k:], 3) for k in (1, 2, 3)]]
    n = len(w)
    out += [crc(w[i : i + 2], 4) for i in range(n - 1)]
    out += [crc(w[i : i + 3], 5) for i in range(n - 2)]
    if word in lexicon:
        out.append(crc(b"%d" % lexicon[word], 6))
    return [x & (SLOTS - 1) for x in out]


@dataclass
class Crf:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def forward_backward(em: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, scaled forward and backward values of words in chains; all chains advance together."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    a = np.exp(em - em.max(axis=1, keepdims=True))
    tr = np.exp(trans)
    alpha, beta = np.empty_like(a), np.ones_like(a)
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")
    cur = a[at] * np.exp(start)
    cur /= cur.sum(axis=1, keepdims=True)
    alpha[at] = cur
    for t in range(1, int(size[0])):
        idx = at[: live[t]] + t
        cur = (cur[: live[t]] @ tr) * a[idx]
        cur /= cur.sum(axis=1, keepdims=True)
        alpha[idx] = cur
    for t in range(int(size[0]) - 2, -1, -1):
        idx = at[: live[t + 1]] + t
        b = (a[idx + 1] * beta[idx + 1]) @ tr.T
        beta[idx] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), alpha, beta


def training_chains(sample: list[tuple[str, str]], langs: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, their languages, and chain sizes: runs of 4 to 24 words from the texts, interleaved at random."""
    rng = np.random.default_rng(seed)
    runs = []
    for text, lang in sample:
        ws = [w for w in WORDS.findall(text.lower()) if w != "\n"]
        i = 0
        while i < len(ws):
            n = int(rng.integers(4, 25))
            runs.append((ws[i : i + n], langs.index(lang)))
            i += n
    words, labels, sizes, n = [], [], [], 0
    for k in rng.permutation(len(runs)):
        ws, lang = runs[k]
        words += ws
        labels += [lang] * len(ws)
        n += len(ws)
        if n >= 64:
            sizes.append(n)
            n = 0
    if n:
        sizes.append(n)
    return words, np.array(labels, dtype=np.int64), np.array(sizes, dtype=np.int64)


def fit_crf(sample: list[tuple[str, str]], epochs: int = 3, rate: float = 0.25, batch: int = 64, decay: float = 1e-6) -> Crf:
    """Maximum conditional likelihood by AdaGrad over mini-batches of chains."""
    langs = sorted({lang for _, lang in sample})
    k = len(langs)
    words, labels, sizes = training_chains(sample, langs)
    seen: dict[str, Counter] = {}
    for w, y in zip(words, labels, strict=True):
        seen.setdefault(w, Counter())[int(y)] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if sum(c.values()) >= 5 and c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
    model = Crf(langs, lexicon, np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    ids = {w: i for i, w in enumerate(seen)}
    feats = [np.array(features(w, lexicon)) for w in seen]
    word = np.array([ids[w] for w in words])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    g_w, g_t, g_s = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    for _ in range(epochs):
        for b in range(0, len(sizes), batch):
            lo, hi = first[b], first[b : b + batch][-1] + sizes[b : b + batch][-1]
            used, place = np.unique(word[lo:hi], return_inverse=True)
            flat = np.concatenate([feats[u] for u in used])
            owner = np.repeat(np.arange(len(used)), [len(feats[u]) for u in used])
            scores = np.zeros((len(used), k))
            np.add.at(scores, owner, model.weights[flat])
            em, size, start = scores[place], sizes[b : b + batch], first[b : b + batch] - lo
            post, alpha, beta = forward_backward(em, start, size, model.transitions, model.start)
            gold = np.eye(k)[labels[lo:hi]]
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, place, gold - post)
            grad = np.zeros((SLOTS, k))
            np.add.at(grad, flat, by_word[owner])
            later = np.ones(hi - lo, dtype=bool)
            later[start] = False
            later = np.flatnonzero(later)
            a = np.exp(em - em.max(axis=1, keepdims=True))
            xi = alpha[later - 1][:, :, None] * np.exp(model.transitions)[None] * (a[later] * beta[later])[:, None, :]
            xi /= xi.sum(axis=(1, 2), keepdims=True)
            d_t = gold[later - 1].T @ gold[later] - xi.sum(axis=0)
            d_s = (gold[start] - post[start]).sum(axis=0)
            rows = np.unique(flat)
            for g, d, p in ((g_t, d_t / 8, model.transitions), (g_s, d_s / 8, model.start)):
                g += d * d
                p += rate * d / np.sqrt(g)
            d = grad[rows] - decay * model.weights[rows]
            g_w[rows] += d * d
            model.weights[rows] += rate * d / np.sqrt(g_w[rows])
    return model


class WordScores:
    """Emission scores of the words met so far, in one growing array; starts afresh beyond ``most`` words."""

    def __init__(self, model: Crf, most: int = 250_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.ids = {"\n": 0}
        self.rows = np.zeros((4096, len(self.model.langs)))

    def of(self, words: list[str]) -> list[int]:
        ids, weights, lexicon = self.ids, self.model.weights, self.model.lexicon
        for w in {w for w in words if w not in ids}:
            i = ids[w] = len(ids)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[i] = weights.take(features(w, lexicon), axis=0).sum(axis=0)
        return [ids[w] for w in words]


def text_languages(model: Crf, texts: list[str | None], scores: WordScores) -> list[tuple[str, float]]:
    """(language, mean probability) of each text."""
    ids, owners = [], []
    if len(scores.ids) > scores.most:
        scores.clear()
    for text in texts:
        got = scores.of(WORDS.findall(text.lower())) if text else []
        ids += got
        owners.append(len(got))
    out = [(UNKNOWN, 0.0)] * len(texts)
    ids, owner = np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), owners)
    newline = ids == 0
    line = np.cumsum(newline)
    real = ~newline
    ids, owner, line = ids[real], owner[real], line[real]
    if not len(ids):
        return out
    change = np.concatenate([[True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])])
    since = np.arange(len(ids)) - np.maximum.accumulate(np.where(change, np.arange(len(ids)), 0))
    starts = np.flatnonzero(since % CHAIN == 0)
    sizes = np.diff(np.concatenate([starts, [len(ids)]]))
    post, _, _ = forward_backward(scores.rows[ids], starts, sizes, model.transitions, model.start)
    n = np.bincount(owner, minlength=len(texts))
    mean = np.stack([np.bincount(owner, weights=post[:, j], minlength=len(texts)) for j in range(post.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
    best = mean.argmax(axis=1)
    return [(model.langs[b], min(1.0, float(m[b]))) if c else (UNKNOWN, 0.0) for b, m, c in zip(best, mean, n, strict=True)]


def predict(text: Column, model) -> Column:
    """Struct of lang_pred and score; ``model`` is a broadcast Crf."""

    @F.pandas_udf("lang_pred string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = model.value
        scores = WordScores(crf)
        for s in batches:
            out = []
            for i in range(0, len(s), 256):
                out += text_languages(crf, list(s.iloc[i : i + 256]), scores)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return udf(text)


def training_sample(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, those with the least MD5 of the id."""
    from pyspark.sql import Window

    usable = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    key = F.md5(F.col(id_col).cast("string"))
    ranked = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), key.alias("k"))
    w = Window.partitionBy("lang").orderBy("k", "id")
    chosen = sized_broadcast(ranked.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("id", "lang").distinct())
    texts = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(chosen, "id")
    return [(r.t, r.lang) for r in texts.select("t", "lang", "id").orderBy("id").collect()]


def label_languages(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250
) -> DataFrame:
    """``docs`` with lang_pred and score, by a CRF fitted on rows where ``train`` holds.

    The fit takes at most ``per_language`` whole texts of each language. Null texts and texts without a
    letter get ``und`` and 0; so does all if there is nothing to learn from. With one language in training,
    that one is predicted. Rows keep their columns; lang_pred and score replace columns of that name.
    """
    sample = training_sample(docs, train, id_col, text_col, lang_col, per_language)
    if not sample:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(fit_crf(sample))
    return docs.withColumn("__p", predict(F.col(text_col), model)).withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")
