"""Joins. Region-sized sides are left to Spark's own size check for broadcasting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from placestat.operators.ranking import first_rows


def join_region(df: DataFrame, regions: DataFrame, key: str = "ward_id") -> DataFrame:
    """Facts with their region; facts without one go."""
    return df.join(regions, key)


def regions_with_counts(regions: DataFrame, df: DataFrame, key: str = "ward_id", out: str = "n") -> DataFrame:
    """Every region with its number of facts, 0 included; facts are counted before the join."""
    return regions.join(df.groupBy(key).agg(F.count("*").alias(out)), key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def latest_value(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """The value at the greatest ``ts`` of each key, without a self-join."""
    return df.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def attach_dimensions(regions: DataFrame, *dims: DataFrame, key: str = "ward_id") -> DataFrame:
    """Regions left-joined to frames with one row a region."""
    for d in dims:
        regions = regions.join(d, key, "left")
    return regions


def assign_region(df: DataFrame, given: Column, located: Column, mentioned: Column, out: str = "ward_id") -> DataFrame:
    """First known of the given, the located and the mentioned region."""
    return df.withColumn(out, F.coalesce(given, located, mentioned))


def map_codes(df: DataFrame, code: Column, mapping: DataFrame, width: int = 4) -> DataFrame:
    """Rows whose code, trimmed and zero-padded, is in ``mapping`` (code, target)."""
    return df.withColumn("code", F.lpad(F.trim(code), width, "0")).join(mapping, "code")


def zero_fill_panel(counts: DataFrame, regions: DataFrame, key: str = "ward_id", month: str = "month", value: str = "value") -> DataFrame:
    """Every region in every month that occurs, missing values 0. The grid is regions times months, both small sets."""
    grid = regions.select(key).distinct().crossJoin(counts.select(month).distinct())
    return grid.join(counts, [key, month], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long"))


def grams(x: Column, n: Column | int) -> Column:
    """Distinct runs of ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(x) - n + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(x, i, n))).otherwise(F.array().cast("array<string>")))


def names_containing(wants: DataFrame, names: DataFrame, want: str, name: str, key: str, q: int = 3) -> DataFrame:
    """(want, key): for each distinct ``want`` the least key whose name contains it, by an index of the names' runs of up to ``q`` characters.

    A want's rarest run gives its candidates, and ``contains`` is the check. An empty want is in every name.
    """
    known = names.where(F.col(name).isNotNull() & F.col(key).isNotNull()).select(key, name)
    index = known.select(key, name, F.explode(F.concat(*[grams(F.col(name), n) for n in range(1, q + 1)])).alias("__gram"))
    often = index.groupBy("__gram").agg(F.count("*").alias("__often"))
    each = wants.where(F.length(want) > 0).select(want).distinct()
    runs = each.select(want, F.explode(grams(F.col(want), F.least(F.length(want), F.lit(q)))).alias("__gram")).join(often, "__gram", "left")
    rarest = runs.groupBy(want).agg(F.min_by("__gram", F.struct(F.coalesce("__often", F.lit(0)), "__gram")).alias("__gram"))
    hit = rarest.join(index, "__gram").where(F.col(name).contains(F.col(want))).groupBy(want).agg(F.min(key).alias(key))
    least = known.agg(F.min(key).alias(key)).where(F.col(key).isNotNull())
    return hit.unionByName(least.select(F.lit("").alias(want), key))


def resolve_region(refs: DataFrame, regions: DataFrame, ref: str = "ref", code: str = "ward_code", name: str = "zone", key: str = "ward_id") -> DataFrame:
    """refs with the region of that code, else the least region whose name contains the reference."""
    want = F.upper(F.trim(F.col(ref)))
    by_code = regions.select(F.upper(code).alias("__code"), F.col(key).alias("__by_code"))
    exact = refs.withColumn("__want", want).join(by_code, F.col("__want") == F.col("__code"), "left")
    rest = exact.where("__by_code IS NULL").select("__want")
    part = names_containing(rest, regions.select(F.col(key).alias("__by_name"), F.upper(name).alias("__name")), "__want", "__name", "__by_name")
    return exact.join(part, "__want", "left").withColumn(key, F.coalesce("__by_code", "__by_name")).drop("__want", "__code", "__by_code", "__by_name")


def filter_scope(df: DataFrame, scope: DataFrame | None, key: str = "ward_id") -> DataFrame:
    """Rows of the regions in ``scope``; None keeps all."""
    return df if scope is None else df.join(scope.select(key).distinct(), key, "left_semi")


def best_of(s: np.ndarray, k: int, group: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value rounded to twelve places) of the ``k`` greatest of each row, ties by column; NaN never counts."""
    bar = np.full((len(s), 1), -np.inf)
    whole = s.shape[1] // group
    if whole >= k:
        # k groups have a greatest value of at least this, so k values do
        tops = np.fmax.reduce(s[:, : whole * group].reshape(len(s), whole, group), axis=2)
        bar = np.partition(np.where(np.isnan(tops), -np.inf, tops), whole - k, axis=1)[:, whole - k : whole - k + 1]
    row, col = np.nonzero(s >= bar - (1e-11 + 1e-12 * np.abs(np.where(np.isfinite(bar), bar, 0.0))))
    value = np.round(s[row, col], 12) + 0.0
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(len(s)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep], value[keep]


def dot_product_join(queries: DataFrame, vectors: DataFrame, query_id: str, query_vec: str, vec_id: str, vec: str, k: int | None = None, block: int = 16_384, cells: int = 1 << 20) -> DataFrame:
    """(query_id, vec_id, similarity) of a stated query set against all vectors, or of the ``k`` best of each query (ties by vec_id).

    Both sides are dealt into blocks of about ``block`` rows by a hash of their ids; a block of queries meets a block of vectors in one task, as a
    product of matrices in slices of about ``cells`` similarities, and a slice's rows leave the task before the next one is made. With ``k`` at most
    that many rows of a query leave a task, and those are merged. Vectors of unlike lengths are skipped; null ids and vectors are left out.
    Similarities are rounded to twelve places, so that equal vectors tie.
    """
    kinds = [queries.schema[query_vec].dataType, vectors.schema[vec].dataType]
    kind = "array<float>" if all(t.simpleString() == "array<float>" for t in kinds) else "array<double>"
    q = queries.where(F.col(query_id).isNotNull() & F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast(kind).alias("e"))
    v = vectors.where(F.col(vec_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(vec).cast(kind).alias("e"))
    nq, nv = (max(1, -(-df.count() // block)) for df in (q, v))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    schema = StructType([q.schema["query_id"], v.schema["vec_id"], StructField("similarity", DoubleType())])
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("vb", every(nv))
    v = v.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(nv)).cast("int")).withColumn("qb", every(nq))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        sides = []
        for name in ("query_id", "vec_id"):
            t = both.filter(both[name].is_valid())
            sides += [t[name].combine_chunks(), t["e"].combine_chunks()]
        qi, qs, vi, vs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in sides)
        del both, sides
        ql, vl = qs.value_lengths().to_numpy(), vs.value_lengths().to_numpy()
        matrix = lambda x, at, size: x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size).astype(np.float64)
        for size in np.intersect1d(ql, vl):
            at_q, at_v = np.flatnonzero(ql == size), np.flatnonzero(vl == size)
            # vectors in the order of their ids, so that columns break ties
            at_v = at_v[np.argsort(vi.take(pa.array(at_v)).to_numpy(zero_copy_only=False), kind="stable")]
            b, ids = matrix(vs, at_v, size), vi.take(pa.array(at_v))
            step = max(1, cells // len(at_v))
            for low in range(0, len(at_q), step):
                rows = at_q[low : low + step]
                s = matrix(qs, rows, size) @ b.T
                if k is None:
                    row, col, value = np.repeat(np.arange(len(rows)), len(at_v)), np.tile(np.arange(len(at_v)), len(rows)), np.round(s.ravel(), 12) + 0.0
                else:
                    row, col, value = best_of(s, k)
                for cut in range(0, len(row), cells):
                    at = slice(cut, cut + cells)
                    yield pa.RecordBatch.from_arrays([qi.take(pa.array(rows[row[at]])), ids.take(pa.array(col[at])), pa.array(value[at])], names=schema.names)

    both = q.withColumn("vec_id", F.lit(None).cast(schema["vec_id"].dataType)).unionByName(v.withColumn("query_id", F.lit(None).cast(schema["query_id"].dataType)))
    pairs = both.groupBy("vb", "qb").applyInArrow(product, schema)
    return pairs if k is None else first_rows(pairs, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def unresolved_references(df: DataFrame, regions: DataFrame, key: str = "ward_id") -> DataFrame:
    """Facts whose region is unknown."""
    return df.join(regions, key, "left_anti")


def lookup_place(phrases: DataFrame, gazetteer: DataFrame, suffixes: list[str], phrase: str = "phrase") -> DataFrame:
    """phrases with the gazetteer row (key, ...) of the phrase without a leading preposition, else without one suffix."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(phrase))), r"^(next to|near|outside|at|opposite|behind|in|on)\s+", "")
    tries = [plain, *[F.when(plain.endswith(" " + s), F.expr(f"left(__p, length(__p) - {len(s) + 1})")) for s in suffixes]]
    spread = phrases.withColumn("__p", plain).select("*", F.posexplode(F.array(*tries)).alias("__rank", "key")).where("key IS NOT NULL")
    hit = spread.join(gazetteer, "key")
    best = hit.groupBy(phrase).agg(F.min_by(F.struct("key", *[c for c in gazetteer.columns if c != "key"]), "__rank").alias("place"))
    return phrases.join(best, phrase, "left")


def geocode_with_cache(phrases: DataFrame, gazetteer: DataFrame, cache: DataFrame, phrase: str = "phrase") -> DataFrame:
    """lat, lng from the gazetteer, else from the cache; ``miss`` is true if neither knows the phrase at all."""
    g = gazetteer.select(F.col("key").alias(phrase), F.col("lat").alias("__glat"), F.col("lng").alias("__glng"))
    c = cache.select(F.col("key").alias(phrase), F.col("lat").alias("__clat"), F.col("lng").alias("__clng"), F.lit(True).alias("__cached"))
    out = phrases.join(g, phrase, "left").join(c, phrase, "left")
    return out.select(
        *phrases.columns, F.coalesce("__glat", "__clat").alias("lat"), F.coalesce("__glng", "__clng").alias("lng"),
        (F.col("__glat").isNull() & F.col("__cached").isNull()).alias("miss"),
    )
