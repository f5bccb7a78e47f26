"""Demand panels: features, boosted trees, back-tests, recursive forecasts and their aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from placestat.functions.scalars import season
from placestat.operators.boosting import Trees, fit_boosted, predict_boosted
from placestat.operators.ranking import first_rows, lag_features, rolling_mean, series_scale

KEYS = ["ward_id", "metric"]
FEATURES = ["lag_1", "lag_2", "lag_3", "lag_12", "rolling_3", "month_sin", "month_cos", "monsoon", "t", "log_density"]


def load_panel(series: DataFrame, regions: DataFrame, min_points: int = 18) -> DataFrame:
    """Series with at least ``min_points`` values, with the region's density."""
    n = series.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_points).drop("n")
    density = regions.select("ward_id", (F.col("population") / F.col("area_sq_km")).alias("density"))
    return series.join(n, KEYS, "left_semi").join(density, "ward_id")


def panel_features(panel: DataFrame) -> DataFrame:
    """Features and the scaled target ``y`` from the 13th value of a series on."""
    w = Window.partitionBy(*KEYS).orderBy("month")
    s = series_scale(panel, KEYS, "value").withColumn("__t", F.row_number().over(w) - 1)
    s = rolling_mean(lag_features(s, KEYS, "month", "scaled"), KEYS, "month", "scaled")
    s = s.withColumns(season(F.col("month"), F.col("__t"), F.col("density")))
    return s.where(F.col("__t") >= 12).select(*KEYS, "month", "scale", F.col("scaled").alias("y"), *FEATURES)


def time_split(features: DataFrame, test_steps: int = 6) -> DataFrame:
    """``features`` with is_test: the last time steps of the metric."""
    last = features.groupBy("metric").agg(F.max("t").alias("__last"))
    return features.join(last, "metric").withColumn("is_test", F.col("t") > F.col("__last") - test_steps).drop("__last")


def fit_metrics(features: DataFrame, metrics: list[str], **options) -> dict[str, Trees]:
    """The boosted trees of each metric, grown together: a level of the trees of all metrics is one job."""
    return fit_boosted(features.where(F.col("metric").isin(metrics)), "metric", FEATURES, "y", **options)


def fit_gbt(features: DataFrame, **options) -> Trees:
    """Boosted trees on the rows of one metric."""
    (model,) = fit_boosted(features, "metric", FEATURES, "y", **options).values()
    return model


def predict_metrics(models: dict[str, Trees], features: DataFrame) -> DataFrame:
    """``features`` with the prediction of each row's own metric's trees."""
    return predict_boosted(models, features, "metric", FEATURES)


def backtest_metrics(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and the seasonal-naive MAPE in original units, by metric."""
    y, p, naive = F.col("y") * F.col("scale"), F.col("prediction") * F.col("scale"), F.col("lag_12") * F.col("scale")
    g = predicted.groupBy("metric").agg(
        F.count("*").alias("rows"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"), (100 * F.avg(F.abs(y - p) / F.nullif(F.abs(y), F.lit(0.0)))).alias("mape"),
        F.sum(F.pow(y - p, 2)).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"), (100 * F.avg(F.abs(y - naive) / F.nullif(F.abs(y), F.lit(0.0)))).alias("naive_mape"), F.stddev_pop(F.col("y") - F.col("prediction")).alias("sigma"),
    )
    return g.withColumn("r2", 1 - F.try_divide("sse", "sst")).drop("sse", "sst")


def seasonal_naive(tested: DataFrame) -> DataFrame:
    """MAPE of the value a year before, on the held-out rows."""
    y, naive = F.col("y") * F.col("scale"), F.col("lag_12") * F.col("scale")
    return tested.where("is_test").groupBy("metric").agg((100 * F.avg(F.abs(y - naive) / F.nullif(F.abs(y), F.lit(0.0)))).alias("naive_mape"))


def forecast_metrics(models: dict[str, Trees], panel: DataFrame, horizon: int) -> DataFrame:
    """(keys, month, step, scale, p): every series step by step, each value feeding the next; at most 24 steps.

    A series' last year is one row, and all steps of the rows of a batch are made in one pass.
    """
    if not 1 <= horizon <= 24:
        raise ValueError("horizon must be between 1 and 24")
    mean = panel.where(F.col("metric").isin(list(models))).groupBy(*KEYS).agg(F.avg("value").alias("scale"), F.count("*").alias("points"), F.first("density").alias("density")).withColumn("scale", F.when(F.col("scale") != 0, F.col("scale")).otherwise(1.0))
    recent = first_rows(panel, KEYS, [F.desc("month")], 12)
    state = recent.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("h"), F.max("month").alias("last")).join(mean, KEYS)
    state = state.select(*KEYS, "scale", "last", F.col("points").cast("double").alias("points"), F.col("density").cast("double").alias("density"), F.month("last").alias("month"), F.transform(F.col("h.value"), lambda v: v / F.col("scale")).cast("array<double>").alias("h"))
    sent = panel.sparkSession.sparkContext.broadcast(models)
    schema = StructType([*(state.schema[c] for c in (*KEYS, "scale", "last")), StructField("ps", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            metric = np.array(b.column(1).to_pylist(), dtype=object)
            points, density, month = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5, 6))
            lists = [np.array(x, dtype=float) for x in b.column(7).to_pylist()]
            n = np.array(list(map(len, lists)))
            h = np.full((b.num_rows, 12 + horizon), np.nan)
            for i, x in enumerate(lists):
                h[i, 12 - len(x) : 12] = x
            for step in range(1, horizon + 1):
                at = 11 + step
                m = (month - 1 + step) % 12 + 1
                year = np.where(n + step - 1 >= 12, h[:, at - 12], h[:, at - 1])
                x = np.stack([h[:, at - 1], h[:, at - 2], h[:, at - 3], year, h[:, at - 3 : at].mean(axis=1), np.sin(2 * np.pi * m / 12), np.cos(2 * np.pi * m / 12), ((m >= 6) & (m <= 9)) * 1.0, points + step - 1, np.log1p(density)], axis=1)
                for name, model in sent.value.items():
                    h[metric == name, at] = model.predict(x[metric == name])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * horizon + 1, horizon).astype(np.int32)), pa.array(h[:, 12:].ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], flat], names=schema.names)

    made = state.mapInArrow(run, schema).select(*KEYS, "scale", "last", F.posexplode("ps").alias("at", "p"))
    step = F.col("at") + 1
    return made.select(*KEYS, F.add_months("last", step).alias("month"), step.alias("step"), "scale", "p")


def forecast(model: Trees, panel: DataFrame, horizon: int) -> DataFrame:
    """``forecast_metrics`` of a panel of one metric."""
    return forecast_metrics({panel.select("metric").first()[0]: model}, panel, horizon)


def interval_bands(predicted: DataFrame, sigma) -> DataFrame:
    """Value and 95 % band in original units, the band widening with the root of the step, never below 0."""
    band = 1.96 * sigma * F.sqrt(F.col("step"))
    return predicted.withColumns({
        "value": F.round(F.col("p") * F.col("scale"), 2), "lower": F.round(F.greatest(F.lit(0.0), (F.col("p") - band) * F.col("scale")), 2), "upper": F.round((F.col("p") + band) * F.col("scale"), 2),
    })


def city_forecast(bands: DataFrame) -> DataFrame:
    """Sum over regions; half widths add in quadrature."""
    half = F.col("upper") - F.col("value")
    g = bands.groupBy("metric", "step").agg(F.sum("value").alias("value"), F.sqrt(F.sum(F.pow(half, 2))).alias("half"))
    return g.select("metric", "step", F.round("value", 2).alias("value"), F.round(F.greatest(F.lit(0.0), F.col("value") - F.col("half")), 2).alias("lower"), F.round(F.col("value") + F.col("half"), 2).alias("upper"))


def demand_growth(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean over metrics of the forecast mean against the mean of the last 12 values, in percent, by region."""
    last = first_rows(history, KEYS, [F.desc("month")], 12).groupBy(*KEYS).agg(F.avg("value").alias("last"), F.count("*").alias("n")).where("n >= 12 AND last > 0")
    ahead = predicted.groupBy(*KEYS).agg(F.avg("value").alias("ahead"))
    each = last.join(ahead, KEYS).withColumn("g", 100 * (F.col("ahead") - F.col("last")) / F.col("last"))
    return each.groupBy("ward_id").agg(F.round(F.avg("g"), 2).alias("growth_pct"))


def forecast_summary(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """Last-12 and forecast averages of each series and the growth."""
    last = first_rows(history, KEYS, [F.desc("month")], 12).groupBy(*KEYS).agg(F.avg("value").alias("last"))
    j = last.join(predicted.groupBy(*KEYS).agg(F.avg("value").alias("ahead")), KEYS)
    return j.withColumn("growth_pct", F.when(F.col("last") != 0, F.round(100 * (F.col("ahead") - F.col("last")) / F.col("last"), 1)))
