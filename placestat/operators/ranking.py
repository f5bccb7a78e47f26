"""Windows, order, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.operators.graph import checkpoint


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each task's rows to ``n`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_by_region(df: DataFrame, order: str, tie: str, key: str = "ward_id") -> DataFrame:
    return first_rows(df, [key], [F.desc(order), F.desc(tie)])


def top_scenes(df: DataFrame, tile: str, date: str, cloud: str, n: int = 3) -> DataFrame:
    """The clearest scenes of a tile on distinct dates."""
    clearest = df.groupBy(tile, date).agg(F.min(cloud).alias(cloud))
    return first_rows(clearest, [tile], [F.asc(cloud), F.asc(date)], n)


def lag_features(df: DataFrame, keys: list[str], order: str, value: str, lags: tuple[int, ...] = (1, 2, 3, 12)) -> DataFrame:
    """lag_k of each series; lag_12 falls back to lag_1 where history is short."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
    return out.withColumn("lag_12", F.coalesce("lag_12", "lag_1")) if 12 in lags and 1 in lags else out


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int = 3) -> DataFrame:
    """Mean of the ``n`` values before each."""
    return df.withColumn(f"rolling_{n}", F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)))


def series_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """scale, the series' mean (1 if 0), and the value over it."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return df.withColumn("scale", F.when(mean != 0, mean).otherwise(1.0)).withColumn("scaled", F.col(value) / F.col("scale"))


def positions(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """df with each row's place from 0 within its ``keys`` in ``order``, without a task for a whole key.

    Rows are range-partitioned by keys and order and sorted; a row's place in its key and partition is added to the number of the key's rows
    in partitions before. Those numbers are one row a partition and key in it.
    """
    at = checkpoint(df.repartitionByRange(*[F.col(k) for k in keys], F.col(order)).sortWithinPartitions(*keys, order).withColumn("__id", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__id", 33))
    held = at.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"), F.min("__id").alias("__first"))
    w = Window.partitionBy(*(F.col(k) for k in keys)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return at.join(before, same).withColumn(out, F.col("__before") + F.col("__id") - F.col("__first")).select(*df.columns, out)


def ordinal_rank_fraction(df: DataFrame, value: str, tie: str, out: str = "rank_fraction") -> DataFrame:
    """position / (n - 1) over all rows without a single-task window.

    Rows are range-partitioned and sorted; each row's place in its partition is added to the number of rows
    in the partitions before, a table of one row a partition.
    """
    part = checkpoint(df.repartitionByRange(F.col(value), F.col(tie)).sortWithinPartitions(value, tie).withColumn("__id", F.monotonically_increasing_id()))
    part = part.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = part.groupBy("__part").agg(F.count("*").alias("__rows")).withColumn("__all", F.lit(0))
    before = Window.partitionBy("__all").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy("__all")).alias("__total"))
    place = F.col("__before") + F.col("__at")
    return part.join(F.broadcast(offsets), "__part").withColumn(out, place / F.greatest(F.col("__total") - 1, F.lit(1))).drop("__id", "__part", "__at", "__before", "__total")


def min_max_normalise(df: DataFrame, cols: list[str]) -> DataFrame:
    """<col>_n: (v - lo) / (hi - lo), all 0.5 on a span under 1e-9; the bounds are one row."""
    bounds = df.agg(*[f(c).cast("double").alias(f"__{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.col(f"__{c}_hi") - F.col(f"__{c}_lo")
    out = df.crossJoin(F.broadcast(bounds))
    out = out.withColumns({f"{c}_n": F.when(span(c) < 1e-9, 0.5).otherwise((F.col(c) - F.col(f"__{c}_lo")) / span(c)) for c in cols})
    return out.drop(*[x for x in out.columns if x.startswith("__")])


def dedupe_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    return first_rows(df, [key], order)


def first_last_epoch(df: DataFrame, key: str, year: str, cols: list[str]) -> DataFrame:
    """Earliest and latest row of a region side by side."""
    s = F.struct(*cols)
    out = df.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min_by(s, year).alias("a"), F.max_by(s, year).alias("b"))
    return out.select(key, "first_year", "last_year", *[F.col(f"a.{c}").alias(f"first_{c}") for c in cols], *[F.col(f"b.{c}").alias(f"last_{c}") for c in cols])


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int = 12) -> DataFrame:
    return first_rows(df, keys, [F.desc(order)], n).groupBy(*keys).agg(F.avg(value).alias("trailing_mean"), F.count("*").alias("points"))


def rank_regions(df: DataFrame, by: str, limit: int, tie: str = "ward_id") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(max(1, limit))


def page(df: DataFrame, order: str, tie: str, limit: int, offset: int) -> DataFrame:
    """Newest first, a page of them."""
    return df.orderBy(F.desc(order), F.desc(tie)).offset(offset).limit(limit)


def top_k_similar(similarities: DataFrame, k: int) -> DataFrame:
    return first_rows(similarities, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def most_common(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each key, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return first_rows(counts, keys, [F.desc("n"), F.asc(value)], k)


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_counts(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    return a.select(key, n).unionByName(b.select(key, n)).groupBy(key).agg(F.sum(n).alias(n))


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.select(key).subtract(found.select(key))
