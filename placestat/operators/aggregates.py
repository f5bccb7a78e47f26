"""Grouped figures. All combine map-side; none gathers a group's rows, but medians, which sort them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facility_counts(assets: DataFrame, key: str = "ward_id") -> DataFrame:
    """Region, type, count; schools count again under EDUCATION_SCHOOL."""
    kinds = F.array(F.col("asset_type"), F.when((F.col("asset_type") == "EDUCATION") & (F.col("subtype") == "school"), "EDUCATION_SCHOOL"))
    return assets.select(key, F.explode(kinds).alias("kind")).where("kind IS NOT NULL").groupBy(key, "kind").agg(F.count("*").alias("n"))


def counts_by_category(df: DataFrame, since: Column | None = None, key: str = "ward_id") -> DataFrame:
    df = df if since is None else df.where(F.col("created_at") >= since)
    return df.where(F.col(key).isNotNull()).groupBy(key, "category").agg(F.count("*").alias("n"))


def monthly_volume(df: DataFrame, key: str = "ward_id") -> DataFrame:
    """Facts of each region and month that has any."""
    return df.where(F.col(key).isNotNull()).groupBy(key, F.trunc("created_at", "MM").alias("month")).agg(F.count("*").alias("value"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def monthly_trend(df: DataFrame, last: int = 24) -> DataFrame:
    """Total and settled facts of the last months."""
    by = df.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("RESOLVED", "CLOSED")).alias("resolved")
    )
    return by.orderBy(F.desc("month")).limit(last)


def median_resolution_days(df: DataFrame, days: str = "resolution_days", approximate: bool = False) -> DataFrame:
    f = F.percentile_approx(days, 0.5).cast("double") if approximate else F.median(days)
    return df.agg(F.round(f, 1).alias("median_days"))


def distinct_months(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.agg(F.countDistinct(F.date_format(ts, "yyyy-MM")).alias("months"))


def complaint_statistics(df: DataFrame, group_by: str, **equal) -> DataFrame:
    """Filtered counts by region, category, month or status, largest first."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v) if v is not None else df
    key = F.date_format("created_at", "yyyy-MM") if group_by == "month" else F.col(group_by)
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def two_period_growth(df: DataFrame, now: Column, key: str = "ward_id") -> DataFrame:
    """Facts of the last 12 and the 12 months before in one pass, and the change in percent."""
    day, mid = F.to_date("created_at"), F.add_months(F.trunc(now, "MM"), -12)
    start = F.add_months(F.trunc(now, "MM"), -24)
    out = df.where(F.col(key).isNotNull() & (day >= start)).groupBy(key).agg(F.count_if(day >= mid).alias("recent"), F.count_if(day < mid).alias("previous"))
    return out.withColumn("growth_pct", F.when(F.col("previous") > 0, F.round(100.0 * (F.col("recent") - F.col("previous")) / F.col("previous"), 2)))


def weighted_mean(df: DataFrame, value: str, weight: str, out: str = "mean") -> DataFrame:
    """Mean over rows that have the value; 0 without weight."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.agg(F.coalesce(F.try_divide(F.sum(F.col(value) * w), F.sum(w).cast("double")), F.lit(0.0)).alias(out))


def confidence_weighted_deficit(gaps: DataFrame, key: str = "ward_id") -> DataFrame:
    """Mean deficit percentage, low-confidence gaps at 60 %."""
    w = F.when(F.col("data_confidence") == "LOW", 0.6).otherwise(1.0)
    return gaps.groupBy(key).agg((F.sum(F.col("deficit_percentage") * w) / F.sum(w)).alias("deficit"))


def provenance_summary(df: DataFrame, tag: str, quality: str) -> DataFrame:
    """Sources and mean quality of each tag and, tag null, of all."""
    return df.rollup(tag).agg(F.count("*").alias("sources"), F.round(F.avg(quality), 4).alias("quality"))


def rollup_with_ratios(df: DataFrame, key: str, sums: list[str], ratios: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Sums by key and ratios (numerator, denominator at least 1, factor)."""
    out = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumns({r: F.round(f * F.col(a) / F.greatest(F.lit(1), F.col(b)), 2) for r, (a, b, f) in ratios.items()})


def totals(df: DataFrame, skip: tuple[str, ...] = ("ward_id",)) -> DataFrame:
    """Sum of every numeric column."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float") and f.name not in skip]
    return df.agg(*[F.round(F.sum(c), 2).alias(c) for c in numeric])


def deficit_mean(regions: DataFrame, gaps: DataFrame, key: str = "ward_id") -> DataFrame:
    means = gaps.groupBy(key).agg(F.avg("deficit_percentage").alias("deficit"))
    return regions.select(key).join(means, key, "left").withColumn("deficit", F.coalesce("deficit", F.lit(0.0)))


def min_max_layer(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def road_km_by_class(roads: DataFrame, key: str = "ward_id") -> DataFrame:
    """Length of each class as a map and in total; few classes, so a region's map is small."""
    by = roads.groupBy(key, "road_class").agg(F.sum("km").alias("km"))
    return by.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("road_class", "km")))).alias("by_class"), F.sum("km").alias("total_km"))
