"""N-gram Jaccard join with several global token orders.

Two sets with at least p % similarity share one of their first n - ceil(p n / 100) + 1 elements under every
total order of the elements. Candidates come from an equality join on the prefixes of a first order, whose condition
also bounds the symmetric difference of the two sets from below by their parity sketches; each must then share a prefix element under the other orders too; what all orders let through is verified. The orders sort
by hashes of their own, so a pair that meets by chance under one seldom meets under all; elements that stand in very many
prefixes come last in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import sized_broadcast, stored
from placestat.llm.simhash import SKETCH, _WordHashes, mixed, parity_sketch, shingle_set, words
from placestat.operators.graph import checkpoint, connected_components


def overlap_length(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set of that similarity."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - overlap_length(n, percent) + 1 if n else 0


Shared = tuple[np.ndarray, np.ndarray]  # elements, sorted, and the class of each


def prefix(h: np.ndarray, order: int, percent: int, shared: Shared) -> np.ndarray:
    """The prefix of a set under a global order: by class, elements that aren't in ``shared`` first, then by a hash of the order's own."""
    k = prefix_length(len(h), percent)
    place = mixed(h, order)
    if len(shared[0]):
        at = np.minimum(np.searchsorted(shared[0], h), len(shared[0]) - 1)
        kind = np.where(shared[0][at] == h, shared[1][at], 0)
        if kind.any():
            return h[np.lexsort((place, kind))[:k]]
    if 4 * k < 3 * len(h):
        some = np.argpartition(place, k - 1)[:k] if k else np.zeros(0, dtype=np.int64)
        h, place = h[some], place[some]
    return h[np.argsort(place)[:k]]


def _sets(column: pa.Array, size: int, known: _WordHashes) -> Iterator[np.ndarray]:
    for t in column:
        yield shingle_set(words(t.as_py()), size, known)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, shared: Shared, sketched: bool = True) -> DataFrame:
    """(doc_id, n, digest, prefix, sketch; null unless ``sketched``) of each row: size, digest and sketch of its set and the first order's prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            sets = list(_sets(b.column(1), shingle, known))
            first = [prefix(h, 0, percent, sent.value) for h in sets]
            cols = [b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(list(map(_digest, sets)), pa.binary()), _lists(first, pa.int64()), _lists(list(map(parity_sketch, sets)), pa.int64()) if sketched else pa.nulls(len(sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "digest", "prefix", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(sign, f"doc_id {kind}, n long, digest binary, prefix array<long>, sketch array<long>")


def other_prefixes(docs: DataFrame, text_col: str, shingle: int, percent: int, orders: int, shared: Shared) -> DataFrame:
    """(digest, p1, ..., hs): the prefixes under the other orders, as 32-bit values, and the whole set."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)
    names = [f"p{k}" for k in range(1, orders)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            sets = list(_sets(b.column(0), shingle, known))
            more = [_lists([prefix(h, k, percent, sent.value).astype(np.int32) for h in sets], pa.int32()) for k in range(1, orders)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, sets)), pa.binary()), *more, _lists(sets, pa.int64())], names=["digest", *names, "hs"])

    return docs.select(text_col).mapInArrow(sign, ", ".join(["digest binary", *(f"{x} array<int>" for x in names), "hs array<long>"]))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _enough(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes with so many common prefix elements can have the similarity.

    Of the common elements, those up to the end of the prefix that ends first are in both prefixes; the others are in the rest of that
    set. So there are ``common`` plus the longer rest at most.
    """
    rest = F.floor((percent * F.greatest(a, b) + 99) / 100) - 1
    return (common + rest) * (100 + percent) >= percent * (a + b)


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): each node with one other at most, the least node of its size class under most of its prefix elements.

    Not all candidates, but enough of them to join most large groups without listing their pairs.
    """
    keyed = rows.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) if percent < 100 else 1.0)))
    hubs = keyed.groupBy("h", "cls").agg(F.min("node").alias("src"), F.count("*").alias("c"), F.min(F.struct("node", "n"))["n"].alias("m")).where("c > 1").drop("c")
    met = keyed.join(hubs, ["h", "cls"]).where("src < node").groupBy("node", "src").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("m").alias("m"))
    met = met.where(_sizes_fit(F.col("n"), F.col("m"), percent) & _enough(F.col("c"), F.col("n"), F.col("m"), percent))
    return met.groupBy("node").agg(F.max(F.struct("c", (-F.col("src")).alias("s"))).alias("m")).select((-F.col("m.s")).alias("src"), F.col("node").alias("dst"))


def _sketch_distance(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH)]
    return sum(bits[1:], bits[0])


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sizes allow the similarity, and the sketches differ in no more bits than sets of these sizes with it do in elements."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _sizes_fit(n, m, percent) & ((100 + percent) * _sketch_distance(a, b) <= (100 - percent) * (n + m))


def meeting_groups(rows: DataFrame, groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """(h, node, n, grp, s0, ...) of the rows whose element is in prefixes of several groups.

    Elements whose nodes are all of one group are taken out by map-side minima first, so that groups of any size cost nothing after this.
    """
    grouped = checkpoint(rows.select("h", "node", "n").join(groups.select("node", F.col("component").alias("grp")), "node", "left").withColumn("grp", F.coalesce("grp", "node")))
    several = grouped.groupBy("h").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("h")
    some = grouped.join(several, "h", "left_semi").join(sketches, "node")
    return checkpoint(some.select("h", "node", "n", "grp", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]))


def likely_pairs(some: DataFrame, percent: int, seed: int, hubs: int = 4) -> DataFrame:
    """(node, src, d): each node and those of ``hubs`` nodes drawn for each of its elements that may be linked to it and are of another group.

    Not all candidates; their number follows the rows'. Draws differ by element, so a node of a large family meets many of its members.
    Sets of more elements than the sketch has bits are left to the comparison of all candidates, as sketches tell too little of them.
    """
    some = some.where(F.col("n") <= 64 * SKETCH)
    what = ["node", "n", "grp", *[f"s{k}" for k in range(SKETCH)]]
    drawn = some.groupBy("h").agg(*[F.min(F.struct(F.xxhash64("node", "h", F.lit(seed * hubs + k)).alias("o"), *what)).alias(f"m{k}") for k in range(hubs)])
    drawn = drawn.select("h", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"m{k}")[c].alias(c) for c in what]) for k in range(hubs)]))).alias("m")).select("h", "m.*")
    a, b = some.alias("a"), drawn.alias("b")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.grp") != F.col("b.grp")) & _may_link("a", "b", percent))
    return met.select(F.col("a.node").alias("node"), F.col("b.node").alias("src"), _sketch_distance("a", "b").alias("d")).distinct()


def rest_pairs(some: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of all candidates in different groups; complete.

    The join lets through only pairs whose sketches allow the similarity, so texts of one family that are mostly below it make no rows.
    Pairs whose common prefix elements are too few for the similarity go.
    """
    a, b = some.alias("a"), some.alias("b")
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.grp") < F.col("b.grp")) & _may_link("a", "b", percent)
    met = a.join(b, apart).groupBy(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).agg(F.count("*").alias("c"), F.min("a.n").alias("n"), F.min("b.n").alias("m"))
    return met.where(_enough(F.col("c"), F.col("n"), F.col("m"), percent)).select("src", "dst")


def shared_elements(counts: DataFrame, most: int) -> Shared:
    """The elements of (h, c) with the highest counts, ``most`` of them at most, and a class of the log2 of its count for each.

    Counts under a power of two are left out until the rest is few enough. What is left out is of class 0 like any unshared element; any
    classes find the same pairs, at another cost.
    """
    level, total = 1, 0
    for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect():
        total += r["count"]
        if total > most:
            level = r["k"] + 1
            break
    found = counts.where(F.col("c") >= F.lit(1 << level)).select("h", F.floor(F.log2("c")).cast("tinyint").alias("k")).toArrow()
    h, kind = found["h"].to_numpy(), found["k"].to_numpy()
    order = np.argsort(h)
    return h[order], kind[order]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, orders: int = 3, most_shared: int = 500_000, rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of word shingles and the least id reachable by links.

    A set has the distinct ``shingle``-word windows of the A-Z lower-cased words; a text of fewer words has one element, all
    its words. Documents are linked if 100 times their common elements are at least ``percent`` times all of theirs. Null
    and blank texts have no set, are linked with nothing and are their own component. Equal sets are folded to one node before
    the join. Rows may repeat, each gives a row; a null id takes its component's least id, null if it has none. Elements
    are compared by 64-bit hashes. Columns other than id and text are ignored.

    Prefixes are made by hash first. Elements in two or more of them (the ``most_shared`` most frequent, whatever the input) then go last in every
    order, the most frequent at the end: texts that differ in over a fifth have prefixes of their own elements only and never meet. Just the
    documents with such an element in their prefix get a new one, as for others nothing changes.

    Groups are joined by likely links first, in up to ``rounds`` more passes while nodes have many candidates in other groups; then all
    candidates between groups are compared.
    """
    if not 0 < percent <= 100 or not 1 <= orders <= 3:
        raise ValueError("percent must be in 1..100 and orders in 1..3")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int8)
    f = stored(signatures(docs, "doc_id", "text", shingle, percent, none).withColumn("row", F.monotonically_increasing_id()), "jaccard-signatures")
    classes = f.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = stored(classes, "jaccard-classes")
    copies = f.where("n > 0").select("row", "digest").join(classes, "digest").where("row <> node").select("row")
    reps = f.where("n > 0").join(sized_broadcast(copies, 1_000_000), "row", "left_anti").select("row", "n", "prefix")
    spread = lambda df: df.select(F.explode("prefix").alias("h"), F.col("row").alias("node"), "n")
    counts = stored(spread(reps).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-counts")
    shared = shared_elements(counts, most_shared)

    # rows with one id can have one text, which must then be taken once
    repeated = f.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0

    def texts_of(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents with the ids of the ``wanted`` rows, and (row, digest) of these to tell them by."""
        who = sized_broadcast(f.join(wanted, "row").select("row", "doc_id", "digest"), 1_000_000)
        ids = who.select(F.col("doc_id").alias("wanted")).distinct()
        return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi"), who.select("row", "digest")

    if len(shared[0]):
        sent = docs.sparkSession.sparkContext.broadcast(shared[0])

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                h = b.column(1).values.to_numpy()[b.column(1).offsets[0].as_py() :]
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.unique(row[hit[: len(row)]])))], names=["row"])

        moved = checkpoint(reps.select("row", "prefix").mapInArrow(touched, "row long"))
        texts, who = texts_of(moved)
        again = signatures(texts, "doc_id", "text", shingle, percent, shared, False).drop("doc_id", "sketch").join(who, "digest")
        again = again.dropDuplicates(["row"]) if repeated else again
        again = stored(again.select("row", "n", "prefix"), "jaccard-signatures")
        reps = reps.join(sized_broadcast(moved, 1_000_000), "row", "left_anti").unionByName(again)
    rows = spread(reps)
    meeting = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    rows = stored(rows.join(meeting, "h", "left_semi"), "jaccard-index")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that share prefix elements under the other orders too and have the similarity."""
        pairs = checkpoint(pairs)
        texts, who = texts_of(checkpoint(pairs.select(F.col("src").alias("row")).union(pairs.select(F.col("dst").alias("row"))).distinct()))
        made = other_prefixes(texts, "text", shingle, percent, orders, shared)
        made = made.join(who.withColumnRenamed("row", "node"), "digest").drop("digest")
        sides = stored(made.dropDuplicates(["node"]) if repeated else made, "jaccard-sides")
        names = [f"p{k}" for k in range(1, orders)]
        side = lambda node, cols: sides.select(F.col("node").alias(node), *[F.col(c).alias(f"{node}_{c}") for c in cols])
        if names:
            met = pairs.join(side("src", names), "src").join(side("dst", names), "dst")
            for c in names:
                met = met.where(F.arrays_overlap(f"src_{c}", f"dst_{c}"))
            pairs = checkpoint(met.select("src", "dst"))
        both = pairs.join(side("src", ["hs"]), "src").join(side("dst", ["hs"]), "dst")
        both = both.select("src", "dst", F.size("src_hs").alias("na"), F.size("dst_hs").alias("nb"), F.size(F.array_intersect("src_hs", "dst_hs")).cast("long").alias("c"))
        return checkpoint(both.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("src", "dst"))

    near = verified(hub_pairs(rows, percent))
    sketches = f.select(F.col("row").alias("node"), "sketch")
    some = None
    for seed in range(rounds + 1):
        some = meeting_groups(rows if some is None else some, checkpoint(connected_components(near)), sketches)
        if seed == rounds:
            break
        likely = checkpoint(likely_pairs(some, percent, seed))
        pairs, nodes = likely.agg(F.count("*"), F.count_distinct("node")).first()
        if pairs <= 2 * nodes:
            break
        # the nearest alone would leave many small groups
        few = likely.groupBy("node").agg(F.array_distinct(F.array(F.min(F.struct("d", "src"))["src"], F.min("src"), F.max("src"))).alias("few"))
        few = few.select(F.explode("few").alias("src"), "node").select(F.least("src", "node").alias("src"), F.greatest("src", "node").alias("dst"))
        near = near.union(verified(few.distinct()))
    more = verified(rest_pairs(some, percent))
    comp = connected_components(near.union(more))
    rooted = checkpoint(classes.join(comp, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("root")))
    label = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    out = f.select("doc_id", "n", "digest").join(label, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
