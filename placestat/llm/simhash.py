"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than a block-permutation index needs: for a radius of 4,
two segments that may differ by one bit and one that may not. If two fingerprints differed by two bits or
more in both wildcard segments and by one or more in the exact one, they would differ by five, so any pair
within the radius agrees on one segment up to its tolerance. Each fingerprint is indexed under every
segment with each single bit of it masked (the one-wildcard variants); an equality join on these keys,
with the exact distance in the join condition, finds all links.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.llm.common import sized_broadcast
from placestat.operators.graph import checkpoint, connected_components

ONE64 = (1 << 64) - 1
SKETCH = 16  # longs
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between the ASCII blanks; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """Space-joined word windows, repeats included; fewer words than ``size`` give the whole sequence."""
    if len(tokens) <= size:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(t) for t in zip(*(tokens[i:] for i in range(size)), strict=False)]


def majority(h: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bit i is 1 if it is set in over half the (weighted) 64-bit hashes; zero without hashes. Signed."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    if weights is None:
        on = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    else:
        on = 2 * (weights @ bits) > weights.sum()
    return int(np.packbits(on).view(">i8")[0])


def simhash(features: list[bytes], seed: int = 42) -> int:
    """Fingerprint of features, repeats included, by their XXH64."""
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in features), dtype=np.uint64, count=len(features)))


def shingle_fingerprint(text: Column, shingle: int = 4) -> Column:
    """Signed 64-bit fingerprint of the word shingles of a whole text."""

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([simhash(shingles(words(t), shingle)) for t in s], dtype="int64")

    return udf(text)


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, tolerated bits) so that the tolerances plus one add up to over the radius."""
    if not 0 <= radius <= 15:
        raise ValueError("radius must be between 0 and 15")
    wild, exact = (radius + 1) // 2, 1 - radius % 2
    narrow = max(1, 64 // (wild + exact) - 3) if exact and wild else 64
    out, low = [], 0
    if exact:
        out.append((0, narrow, 0))
        low = narrow
    for i in range(wild):
        width = (64 - low) // (wild - i)
        out.append((low, width, 1))
        low += width
    return out[::-1]


def _mask(low: int, width: int) -> int:
    m = ((1 << width) - 1) << low
    return m - (1 << 64) if m >= 1 << 63 else m


def _variants(radius: int) -> list[tuple[int, int, int, int]]:
    """(segment number, lowest bit, width, mask of what is kept) of each index key."""
    out = []
    for s, (low, width, tolerated) in enumerate(segments(radius)):
        full = ((1 << width) - 1) << low
        for bit in range(low, low + width) if tolerated else [None]:
            kept = full & ~(1 << bit) if bit is not None else full
            out.append((s, low, width, kept - (1 << 64) if kept >= 1 << 63 else kept))
    return out


def _keyed(fps: DataFrame, node: str, fp: str, radius: int) -> DataFrame:
    """(node, fp, tag, bits): a row for each index key."""
    keys = F.array(*[F.col(fp).bitwiseAND(F.lit(kept)) for *_, kept in _variants(radius)])
    return fps.select(F.col(node).alias("node"), F.col(fp).alias("fp"), F.posexplode(keys).alias("tag", "bits"))


def links(fps: DataFrame, node: str, fp: str, radius: int = 4) -> DataFrame:
    """(src, dst) with src < dst for nodes whose fingerprints differ by at most ``radius`` bits.

    A pair is emitted only under the first variant that it shares, so it comes out once.
    """
    variants, segs = _variants(radius), segments(radius)
    # merged by name: Spark sizes the keys by the rows before the explode, and would broadcast some fifty times what it expects
    key = _keyed(fps, node, fp, radius).hint("merge")
    a, b = key.alias("a"), key.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    differ = [F.bit_count(diff.bitwiseAND(F.lit(_mask(low, width)))) for low, width, _ in segs]
    first_of = {s: next(i for i, v in enumerate(variants) if v[0] == s) for s in range(len(segs))}
    count_of = Counter(v[0] for v in variants)
    canonical = F.lit(False)
    for s in range(len(segs)):
        here = F.col("a.tag").between(first_of[s], first_of[s] + count_of[s] - 1)
        for r in range(s):
            here = here & (differ[r] > segs[r][2])
        canonical = canonical | (here & ((differ[s] == 1) | (F.col("a.tag") == first_of[s])))
    same = (F.col("a.tag") == F.col("b.tag")) & (F.col("a.bits") == F.col("b.bits"))
    return a.join(b, same & (F.col("a.node") < F.col("b.node")) & (F.bit_count(diff) <= radius) & canonical).select(
        F.col("a.node").alias("src"), F.col("b.node").alias("dst")
    )


def hub_links(fps: DataFrame, node: str, fp: str, radius: int) -> DataFrame:
    """(src, dst): under each index key the least node with every other within ``radius`` bits of it.

    As many rows at most as there are keys, however many nodes share one; not all links, but enough of them
    to join most large groups. The keys are dealt out once; a node has one row under each variant, so a key that
    many share is a small part of them.
    """
    hub = F.min(F.struct("node", "fp")).over(Window.partitionBy("tag", "bits"))
    keyed = _keyed(fps, node, fp, radius).withColumn("hub", hub)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= radius
    return keyed.where((F.col("hub.node") < F.col("node")) & near).select(F.col("hub.node").alias("src"), F.col("node").alias("dst")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the least id reachable. Null or blank
    texts have fingerprint zero and are linked like any other. Rows may repeat: each input row gives a row.
    A null id takes its group's component (null if the group has no id). Other columns are ignored.
    Copies are folded to one row per fingerprint before the index is built.
    """
    f = checkpoint(docs.select(F.col(id_col).alias("doc_id"), shingle_fingerprint(F.col(text_col), shingle).alias("fp")))
    reps = f.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(links(reps, "fp", "fp", radius))
    rooted = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = checkpoint(rooted)
    label = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return f.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class _WordHashes(dict):
    """XXH64 of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_set(tokens: list[bytes], size: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows, as signed numbers; a short text has one, of all its words."""
    if len(known) > 500_000:
        known.clear()
    w = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1 if size else 0, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C17) + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def mixed(h: np.ndarray, order: int) -> np.ndarray:
    x = h.view(np.uint64) * np.uint64(MIX[order] | 1)
    return (x ^ (x >> np.uint64(29))) * np.uint64(MIX[(order + 1) % len(MIX)] | 1)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Bits dealt to the elements by hash, each set if an odd number of elements has it, in ``SKETCH`` longs.

    Two sets' sketches differ in no more bits than the sets in elements, as common elements change the same bits of both.
    """
    at = ((mixed(h, 3) >> np.uint64(32)) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


def _shingle_hashes(text: Column, size: int) -> Column:
    @F.pandas_udf("array<long>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for s in batches:
            yield pd.Series([shingle_set(words(t), size, known) for t in s])

    return udf(text)


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int, sample: int = 20_000, seen: int = 3, most: int = 100_000) -> np.ndarray:
    """Sorted hashes of shingles that ``seen`` texts or more of about ``sample`` hold, ``most`` at most.

    They only come last in the order of the prefixes; any order finds the same pairs, at another cost.
    """
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < F.lit(round(1_000_000 * share)))
    each = some.select(F.explode(_shingle_hashes(F.col(text_col), shingle)).alias("h"))
    counts = checkpoint(each.groupBy("h").count().where(F.col("count") >= seen))
    cut, total = 0, 0
    for r in counts.groupBy(F.floor(F.log2("count")).alias("k")).count().orderBy(F.desc("k")).collect():
        total += r["count"]
        if total > most:
            cut = r["k"] + 1
            break
    hs = [r["h"] for r in counts.where(F.log2("count") >= cut).select("h").collect()]
    return np.array(sorted(hs), dtype=np.int64)


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets with at least ``similarity``, these many first elements of each, in any common order, share one."""
    return n - int(np.ceil(similarity * n - 1e-6)) + 1 if n else 0


def text_signatures(text: Column, size: int, similarity: float, frequent: np.ndarray) -> Column:
    """(fp, n, prefix, sketch): fingerprint of the distinct words, each weighted by the root of its count; number of
    distinct shingles; the first of them, by hash, the ``frequent`` last; their parity sketch."""

    @F.pandas_udf("struct<fp:long,n:int,prefix:array<long>,sketch:array<long>>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for s in batches:
            fps, ns, out, sketches = [], [], [], []
            for t in s:
                ws = words(t)
                c = Counter(ws)
                h = np.fromiter(map(known.__getitem__, c), dtype=np.uint64, count=len(c))
                fps.append(majority(h, np.sqrt(np.fromiter(c.values(), dtype=np.float64, count=len(c)))))
                hs = shingle_set(ws, size, known)
                sketches.append(parity_sketch(hs))
                if len(frequent):
                    last = frequent[np.minimum(np.searchsorted(frequent, hs), len(frequent) - 1)] == hs
                    hs = np.concatenate([hs[~last], hs[last]])
                ns.append(len(hs))
                out.append(hs[: prefix_length(len(hs), similarity)])
            yield pd.DataFrame({"fp": np.array(fps, dtype=np.int64), "n": np.array(ns, dtype=np.int32), "prefix": pd.Series(out, dtype=object), "sketch": pd.Series(sketches, dtype=object)})

    return udf(text)


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of all sets in different groups that can be as similar as that: a superset, complete.

    ``sets`` has id, n, prefix and grp. A pair shares an element of its prefixes, and at the first shared one
    each has enough elements left for the overlap that its sizes ask for.
    """
    rows = sets.select("id", "grp", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "id", "grp", F.struct("n", "pos").alias("x"))
    rows = rows.select("h", "id", "grp", (F.shiftleft(F.col("x.n").cast("long"), 32) + F.col("x.pos")).alias("x"))
    n = lambda side: F.shiftright(F.col(f"{side}.x"), 32)
    left = lambda side: n(side) - F.col(f"{side}.x").bitwiseAND(F.lit((1 << 32) - 1))
    least = F.lit(similarity / (1 + similarity)) * (n("a") + n("b")) - F.lit(1e-6)
    smaller = (n("a") < n("b")) | ((n("a") == n("b")) & (F.col("a.id") < F.col("b.id")))
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.grp") != F.col("b.grp"))
    pairs = rows.alias("a").join(rows.alias("b"), same & smaller & (left("a") >= least) & (left("b") >= least) & (n("a") >= least))
    return pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches (id, n, sketch) differ in no more bits than sets of their sizes with that similarity do in elements."""
    side = lambda node, c: sketches.select(F.col("id").alias(node), F.struct("n", "sketch").alias(c))
    bits = F.aggregate(F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    met = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return met.where((1 + similarity) * bits <= (1 - similarity) * (F.col("a.n") + F.col("b.n")) + 1e-6).select("src", "dst").distinct()


def _similar(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have at least that Jaccard similarity. Whole sets are made only where the sketches allow it."""
    pairs = checkpoint(_likely(pairs, sketches, similarity))
    wanted = sized_broadcast(pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct(), 2_000_000)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, "id", "left_semi")
    sets = checkpoint(texts.select("id", _shingle_hashes(F.col("t"), shingle).alias("hs"))).dropDuplicates(["id"])
    a = sets.select(F.col("id").alias("src"), F.col("hs").alias("ha"))
    b = sets.select(F.col("id").alias("dst"), F.col("hs").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    near = (
        pairs.join(a, "src").join(b, "dst").withColumn("common", common)
        .where(F.col("common") >= similarity * (F.size("ha") + F.size("hb") - F.col("common")))
        .select("src", "dst")
    )
    return checkpoint(near)


def near_duplicate_survivors(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 3,
) -> DataFrame:
    """The rows of ``docs`` with one document, the least id, of each near-duplicate group.

    A pair is a link if the Jaccard similarity of the sets of ``shingle``-word windows is at least
    ``similarity``; equal texts are always linked. Candidates: word fingerprints within ``radius`` bits of the
    least of their deletion-variant key, which link most large groups cheaply; then every pair not yet in one
    group that shares a shingle of its prefixes (prefix filter), which leaves out no pair of that similarity,
    wherever the texts differ. Every candidate is verified. Groups are the connected components. Texts without
    a word are equal only to the same text. Rows with a null id are kept as they are; a row that repeats
    another with its id and text is kept once. All columns stay.
    """
    digest = F.concat(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.when(F.col(text_col).isNull(), "n").otherwise(""))
    frequent = frequent_shingles(docs, id_col, text_col, shingle)
    signed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), digest.alias("digest"), text_signatures(F.col(text_col), shingle, similarity, frequent).alias("s"))
    f = checkpoint(signed.select("id", "digest", "s.*", F.monotonically_increasing_id().alias("row")))
    reps = checkpoint(f.groupBy("digest").agg(F.min(F.struct("id", "row", "fp")).alias("x")).select("x.*", "digest"))
    # prefixes and texts stay where they are as long as what is taken from or put to them is small enough to be sent there
    copies = checkpoint(f.select("id", "row", "digest").join(reps.select("digest", F.col("row").alias("first")), "digest").where("row <> first").select("id", "row"))
    whole = f.join(sized_broadcast(copies.select("row"), 1_000_000), "row", "left_anti")
    sketches = whole.select("id", "n", "sketch")
    pairs = checkpoint(hub_links(reps.where("fp <> 0"), "id", "fp", radius))
    groups = checkpoint(connected_components(_similar(pairs, sketches, docs, id_col, text_col, shingle, similarity)))
    known = sized_broadcast(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), 1_000_000)
    sets = whole.select("id", "n", "prefix").join(known, "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    rest = checkpoint(prefix_pairs(sets, similarity))
    near = _similar(rest, sketches, docs, id_col, text_col, shingle, similarity)
    comp = connected_components(near.union(groups.select("node", "component")))
    gone = comp.where("node <> component").select(F.col("node").alias("id"))
    if f.groupBy("id").count().where("count > 1").limit(1).count() == 0:
        dropped = sized_broadcast(gone.union(copies.select("id")).select(F.col("id").alias("__id")), 2_000_000)
        return docs.join(dropped, F.col(id_col) == F.col("__id"), "left_anti")
    keep = reps.select("id", "digest").join(gone, "id", "left_anti")
    marked = docs.withColumn("__digest", digest)
    kept = marked.join(
        keep.select(F.col("id").alias("__id"), F.col("digest").alias("__kept")),
        (F.col(id_col) == F.col("__id")) & (F.col("__digest") == F.col("__kept")),
        "left_semi",
    ).dropDuplicates([id_col, "__digest"])
    return kept.unionByName(marked.where(F.col(id_col).isNull())).drop("__digest")
