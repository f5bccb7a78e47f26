"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences. An equality join on hashed token windows (seeds) finds
the pairs that share text; a pair goes on only if the item's seeds in the document could cover enough of the
item. Greedy string tiling then marks, longest first, matches that overlap neither in the document nor in
the item; matches of a length are found by running Karp-Rabin hashes (Wise, 1993). The share of the item's
tokens inside tiles is its coverage: since tiles may lie in any order, a reordered passage is caught as well.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import let, sized_broadcast
from placestat.operators.graph import checkpoint

TOKEN = r"[\p{L}\p{N}]+"
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def seeds(toks: Column, size: int) -> Column:
    """Hash of every window of ``size`` tokens."""
    return let(
        toks,
        lambda w: F.when(F.size(w) < size, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        ),
    )


def _windows(seq: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of ``length`` unmarked tokens, the hash rolled from one to the next."""
    top, h, run = pow(BASE, length, MODULUS), 0, 0
    for i, x in enumerate(seq):
        if not free[i]:
            h = run = 0
            continue
        h, run = (h * BASE + x) % MODULUS, run + 1
        if run > length:
            h = (h - seq[i - length] * top) % MODULUS
        if run >= length:
            yield i - length + 1, h


def _longest_run(free: list[bool]) -> int:
    best = run = 0
    for x in free:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


def _matches(doc: list[int], item: list[int], free_d: list[bool], free_i: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Heap of (minus length, start in item, start in doc) of the unmarked matches of ``size`` tokens or more, each as long as it goes."""
    at = defaultdict(list)
    for d, h in _windows(doc, free_d, size):
        at[h].append(d)
    found = []
    for i, h in _windows(item, free_i, size):
        for d in at.get(h, ()):
            if d and i and free_d[d - 1] and free_i[i - 1] and doc[d - 1] == item[i - 1] or doc[d : d + size] != item[i : i + size]:
                continue
            n = size
            while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                n += 1
            found.append((-n, i, d))
    heapq.heapify(found)
    return found


def greedy_tiles(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of at least ``least`` tokens, marked longest first.

    Ties: the match that starts first in the item, then in the document. Tokens are positive integers; those
    of the document that the item lacks only part its runs. Matches are searched by Karp-Rabin hashes of a
    length that starts at the longest unmarked run and is halved down to ``least``; of a match that a longer
    one has cut, what is left takes its turn by its own length, if it still has the searched one.
    """
    known = set(item)
    free_d, free_i, tiles = [x in known for x in doc], [True] * len(item), []
    size = max(least, min(_longest_run(free_d), len(item)))
    while True:
        found = _matches(doc, item, free_d, free_i, size)
        while found:
            n, i, d = heapq.heappop(found)
            begin = 0
            for k in range(1 - n):
                if k < -n and free_d[d + k] and free_i[i + k]:
                    continue
                if k == -n and begin == 0:
                    tiles.append((d, i, k))
                    free_d[d : d + k] = free_i[i : i + k] = [False] * k
                elif k - begin >= size:
                    heapq.heappush(found, (begin - k, i + begin, d + begin))
                begin = k + 1
        if size <= least:
            return tiles
        size = max(least, min(size // 2, _longest_run(free_d), _longest_run(free_i)))


def _near_seeds(doc: list[str], item: list[str], least: int) -> tuple[list[int], list[int]]:
    """Both as integers, the document cut down to tokens inside windows that the item has too."""
    grams = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
    code = {t: n + 1 for n, t in enumerate(dict.fromkeys(item))}
    kept, until, gap = [], 0, len(code) + 1
    for i in range(len(doc) - least + 1):
        if tuple(doc[i : i + least]) in grams:
            if kept and i > until:
                kept.append(gap)
                gap += 1
            kept += [code[t] for t in doc[max(i, until) : i + least]]
            until = i + least
    return kept, [code[t] for t in item]


def tiling(doc_tokens: Column, item_tokens: Column, least: int) -> Column:
    """Struct of covered item tokens, number of tiles and longest tile."""

    @F.pandas_udf("covered long, n_tiles long, longest long")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for docs, items in batches:
            out = []
            for d, i in zip(docs, items, strict=True):
                tiles = greedy_tiles(*_near_seeds(list(d), list(i), least), least)
                out.append((sum(t[2] for t in tiles), len(tiles), max((t[2] for t in tiles), default=0)))
            yield pd.DataFrame(out, columns=["covered", "n_tiles", "longest"])

    return udf(doc_tokens, item_tokens)


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = 5,
    coverage: float = 0.8,
    max_broadcast_seeds: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, coverage, n_tiles, longest_tile) of leaked items.

    A pair is returned if tiles of ``seed`` tokens or more cover at least ``coverage`` of the item's tokens.
    Items of fewer than ``seed`` tokens can't be matched. Null or empty texts match nothing; rows with a
    null id are left out. If an id repeats, its best row counts. The benchmark's distinct seeds are
    broadcast if a count finds at most ``max_broadcast_seeds`` of them, else the join is shuffled.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("it"))
    items = checkpoint(items.where(F.size("it") >= seed))
    item_seeds = items.select("item_id", F.size("it").alias("n"), F.posexplode(seeds(F.col("it"), seed)).alias("at", "h"))
    known = sized_broadcast(item_seeds.select("h").distinct(), max_broadcast_seeds)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    hits = texts.select("doc_id", F.explode(seeds(tokens(F.col("t")), seed)).alias("h")).join(known, "h").distinct()
    reach = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda p: F.sequence(p, p + (seed - 1))))))
    pairs = hits.join(item_seeds, "h").groupBy("doc_id", "item_id").agg(F.max("n").alias("n"), reach.alias("reach"))
    pairs = checkpoint(pairs.where(F.col("reach") >= coverage * F.col("n")).select("doc_id", "item_id"))
    matched = texts.join(pairs, "doc_id").join(items, "item_id").select("doc_id", "item_id", F.size("it").alias("item_tokens"), tiling(tokens(F.col("t")), F.col("it"), seed).alias("g"))
    best = matched.groupBy("doc_id", "item_id", "item_tokens").agg(F.max("g").alias("g"))
    share = F.col("g.covered") / F.col("item_tokens")
    return best.where(share >= coverage).select(
        "doc_id", "item_id", "item_tokens", F.col("g.covered").alias("covered_tokens"), share.alias("coverage"),
        F.col("g.n_tiles").alias("n_tiles"), F.col("g.longest").alias("longest_tile"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents of any contaminated pair; rows with a null id stay."""
    bad = contaminated_pairs(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("__bad"), "left_anti")
