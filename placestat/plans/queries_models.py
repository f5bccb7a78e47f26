"""Queries of raster, scenario and forecast operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from placestat.operators import forecasting as FC
from placestat.operators import planning as M
from placestat.operators import raster as X
from placestat.operators import scenarios as SC
from placestat.operators import spatial as S
from placestat.operators.graph import checkpoint
from placestat.plans.queries_planning import ALL_GAPS, FLOOD, INPUT_FIXTURES, inputs
from placestat.plans.registry import query

MASK = "mk AS (SELECT * FROM pixels WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND green <> 0 AND red <> 0 AND nir <> 0 AND swir <> 0)"
COMP = "cm AS (SELECT pixel_id, ward_id, epoch, median(green) AS green, median(red) AS red, median(nir) AS nir, median(swir) AS swir FROM mk GROUP BY 1, 2, 3)"
ND = "greatest(-1e0, least(1e0, ({a} - {b}) / ({a} + {b})))"
IDX = f"ix AS (SELECT *, {ND.format(a='nir', b='red')} AS ndvi, {ND.format(a='swir', b='nir')} AS ndbi, {ND.format(a='green', b='nir')} AS ndwi FROM cm)"
COVER = "lc AS (SELECT *, CASE WHEN ndwi > 0.05e0 THEN 'water' WHEN ndvi > 0.3e0 THEN 'vegetation' WHEN ndbi > 0.12e0 AND ndvi > 0.15e0 THEN 'bare_soil' WHEN ndvi < 0.25e0 THEN 'built_up' END AS cover FROM ix)"
PIX = f"{MASK}, {COMP}, {IDX}, {COVER}"


def composite(t):
    return X.median_composite(X.mask_scenes(t.pixels))


def covered(t):
    return X.land_cover(X.spectral_indices(composite(t)))


@query("ras1_mask_scenes", "SELECT scene_id, pixel_id, round(nir, 8) AS nir FROM mk", "pixels", MASK)
def _(t):
    return X.mask_scenes(t.pixels).select("scene_id", "pixel_id", F.round("nir", 8).alias("nir"))


@query("agg20_median_composite", "SELECT pixel_id, ward_id, epoch, round(green, 9) AS green, round(red, 9) AS red, round(nir, 9) AS nir, round(swir, 9) AS swir FROM cm", "pixels", f"{MASK}, {COMP}")
def _(t):
    return composite(t).select("pixel_id", "ward_id", "epoch", *[F.round(b, 9).alias(b) for b in X.BANDS])


@query("ras2_spectral_indices", "SELECT pixel_id, epoch, round(ndvi, 6) + 0.0 AS ndvi, round(ndbi, 6) + 0.0 AS ndbi, round(ndwi, 6) + 0.0 AS ndwi FROM ix", "pixels", f"{MASK}, {COMP}, {IDX}")
def _(t):
    return X.spectral_indices(composite(t)).select("pixel_id", "epoch", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ndvi", "ndbi", "ndwi")])


@query("ras3_land_cover", "SELECT pixel_id, epoch, cover FROM lc", "pixels", PIX)
def _(t):
    return covered(t).select("pixel_id", "epoch", "cover")


@query(
    "ras4_normalise_epoch",
    "SELECT count(*) AS pixels, round(regr_slope(b.nir, a.nir), 6) AS nir_gain, round(regr_intercept(b.nir, a.nir), 6) AS nir_offset FROM (SELECT *, (row_number() OVER (ORDER BY ndvi, pixel_id) - 1) / (count(*) OVER () - 1) AS r FROM ix WHERE epoch = 1996) a JOIN (SELECT *, (row_number() OVER (ORDER BY ndvi, pixel_id) - 1) / (count(*) OVER () - 1) AS r FROM ix WHERE epoch = 1995) b USING (pixel_id) WHERE abs(a.r - b.r) < 0.05",
    "pixels", f"{MASK}, {COMP}, {IDX}",
)
def _(t):
    fit = X.normalise_epoch(X.spectral_indices(composite(t)), 1996, 1995, moved=0.05)
    return fit.select("pixels", F.round("nir_gain", 6).alias("nir_gain"), F.round("nir_offset", 6).alias("nir_offset"))


@query(
    "ras5_zonal_stats",
    "SELECT ward_id, epoch, count(*) AS pixels, round(avg(ndvi), 6) AS mean_ndvi, round(count(*) FILTER (cover = 'water') * any_value(area_sq_km) / count(ndvi), 6) AS water_sq_km, round(count(*) FILTER (cover = 'built_up') * any_value(area_sq_km) / count(ndvi), 6) AS built_up_sq_km FROM lc JOIN wards USING (ward_id) GROUP BY 1, 2",
    "pixels wards", PIX,
)
def _(t):
    z = X.zonal_stats(covered(t), t.wards)
    return z.select("ward_id", "epoch", "pixels", F.round("mean_ndvi", 6).alias("mean_ndvi"), F.round("water_sq_km", 6).alias("water_sq_km"), F.round("built_up_sq_km", 6).alias("built_up_sq_km"))


@query(
    "ras6_elevation_stats",
    "SELECT l_partkey % 25 AS ward_id, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(quantile_cont(l_quantity, 0.1), 4) AS p10, round(avg(CASE WHEN l_quantity < 5 THEN 1.0 ELSE 0.0 END), 6) AS below_5, round(avg(CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0.0 END), 6) AS below_10 FROM lineitem GROUP BY 1",
)
def _(t):
    e = X.elevation_stats(t.lineitem.select((F.col("l_partkey") % 25).alias("ward_id"), "l_quantity"), "ward_id", "l_quantity")
    return e.select("ward_id", *[F.round(c, d).alias(c) for c, d in (("mean", 4), ("median", 4), ("p10", 4), ("below_5", 6), ("below_10", 6))])


@query("ras7_mosaic_first_valid", "SELECT l_partkey AS pixel, min_by(v, o) FILTER (v IS NOT NULL) AS v FROM (SELECT l_partkey, l_orderkey * 8 + l_linenumber + l_quantity / 1e3 + l_extendedprice / 1e9 AS o, CASE WHEN l_discount > 0.02 THEN l_discount END AS v FROM lineitem) GROUP BY 1")
def _(t):
    tiles = t.lineitem.select(F.col("l_partkey").alias("pixel"), F.expr("l_orderkey * 8 + l_linenumber + l_quantity / 1e3 + l_extendedprice / 1e9").alias("o"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("v"))
    return X.mosaic_first_valid(tiles, "pixel", "o", "v")


@query("ras8_new_built_up", "SELECT pixel_id FROM lc GROUP BY 1 HAVING count(DISTINCT epoch) > 1 AND arg_max_null(cover, epoch) = 'built_up' AND coalesce(arg_min_null(cover, epoch), '') <> 'built_up'", "pixels", PIX)
def _(t):
    return X.new_built_up(covered(t))


@query(
    "ras9_landuse_shares",
    "SELECT c_nationkey AS ward_id, b AS bucket, round(100.0 * count(*) / any_value(n), 4) AS share FROM (SELECT c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'water' WHEN c_custkey % 3 = 0 THEN 'green' WHEN c_custkey % 2 = 0 THEN 'residential' ELSE 'unmapped' END AS b, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) GROUP BY 1, 2",
)
def _(t):
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("ward_id"))
    k = F.col("cell_id")
    found = F.array(F.when(k % 2 == 0, "residential"), F.when(k % 3 == 0, "green"), F.when(k % 5 == 0, "water"))
    covers = cells.select("cell_id", F.explode(found).alias("bucket")).where("bucket IS NOT NULL")
    return X.landuse_shares(cells, covers).withColumn("share", F.round("share", 4))


@query(
    "ras10_rasterise_regions",
    "SELECT w.ward_id, ix, iy FROM wards w, range(7270, 7310) a(ix), range(1880, 1935) b(iy) WHERE (ix + 0.5e0) * 0.01e0 > west AND (ix + 0.5e0) * 0.01e0 < west + 0.06e0 AND (iy + 0.5e0) * 0.01e0 > south AND (iy + 0.5e0) * 0.01e0 < south + 0.09e0",
    "wards",
)
def _(t):
    return X.rasterise_regions(t.wards.select("ward_id", S.rectangle(F.col("south"), F.col("west"), 0.09, 0.06).alias("rings")), 0.01)


# scenarios

SCN = " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, " + ", ".join(f"{float(v.get(x, 0))!r}e0 AS {x}" for x in SC.LEVERS)
    for n, v in {
        "none": {}, "transit": {"transit_pct": 20, "new_bus_stops": 150}, "drains": {"drainage_pct": 60, "green_pct": 2}, "growth": {"population_pct": 12, "rezoning_pct": 5},
        "services": {"water_mld": 120, "waste_pct": 40, "new_health": 25, "new_schools": 30},
    }.items()
)
SCOPES = "sp AS (SELECT 'city' AS scope, ward_id FROM wards UNION ALL SELECT zone, ward_id FROM wards)"
INDICATORS = f"""si AS (SELECT i.*, 1000 + ward_id * 37 AS ridership, 1e0 + (ward_id % 10) / 5e0 AS congestion, fl.exposure AS flood_risk, c_flooding AS flood_12m, g.required_capacity AS drain_required, g.existing_capacity AS drain_capacity, 0.5e0 + (ward_id % 4) / 1e1 AS runoff, green_share_pct / 100 * area_sq_km AS green_sq_km
 FROM i JOIN fl USING (ward_id) JOIN (SELECT * FROM gaps WHERE sector = 'Drainage & Storm Water') g USING (ward_id))"""
BASELINE = """bl AS (SELECT scope, sum(population)::BIGINT AS population, round(sum(area_sq_km), 2) AS area_sq_km, sum(ridership)::BIGINT AS ridership, round(sum(congestion * population) / sum(population), 3) AS congestion, sum(n_bus_stop)::BIGINT AS bus_stops, round(sum(flood_risk * population) / sum(population), 3) AS flood_risk, round(sum(flood_12m) / 12, 1) AS flood_complaints,
 round(sum(drain_required), 2) AS drain_required, round(sum(drain_capacity), 2) AS drain_capacity, round(avg(runoff), 3) AS runoff, round(sum(population)::BIGINT * 135 / 1e6, 2) AS water_required, round(coalesce(sum(water_mld), 0), 2) AS water_supplied, round(sum(population)::BIGINT * 0.45e0 / 1000, 2) AS waste_generated, round(coalesce(sum(waste_tpd), 0), 2) AS waste_processed, sum(n_healthcare)::BIGINT AS health, sum(n_education_school)::BIGINT AS schools,
 round(100 * sum(green_sq_km) / round(sum(area_sq_km), 2), 2) AS green_share, round(sum(green_sq_km) * 1e6 / sum(population)::BIGINT, 2) AS open_space FROM sp JOIN si USING (ward_id) GROUP BY 1)"""
LEVERED = """l0 AS (SELECT *, (1 + population_pct / 100) * (1 + rezoning_pct / 100) AS gr, new_bus_stops / greatest(1e0, bus_stops) AS ra, transit_pct / 100 AS cap, greatest(0e0, drain_required - drain_capacity) AS gap FROM bl CROSS JOIN sn),
l1 AS (SELECT *, round(population * gr, 0) AS s_population, round(ridership * (1 + 0.65e0 * cap) * (1 + 0.3e0 * ra) * gr, 0) AS s_ridership, round(greatest(1e0, least(3e0, 1 + (congestion - 1) * (1 - 0.32e0 * cap - 0.5e0 * 0.32e0 * ra) * pow(gr, 0.5e0))), 3) AS s_congestion, bus_stops + new_bus_stops AS s_bus_stops,
 round(drain_capacity + gap * drainage_pct / 100, 2) AS s_drain_capacity, round(drain_required * (1 - 0.65e0 * green_pct / 100 / greatest(0.3e0, runoff)), 2) AS s_drain_required, round(least(100e0, green_share + green_pct), 2) AS s_green_share,
 round(greatest(0.02e0, flood_risk * (1 - 0.6e0 * CASE WHEN gap > 0 THEN drainage_pct / 100 ELSE 0 END) * (1 - 0.015e0 * green_pct)), 3) AS s_flood_risk, round(water_supplied + water_mld, 2) AS s_water_supplied, round(waste_processed * (1 + waste_pct / 100), 2) AS s_waste_processed, health + new_health AS s_health, schools + new_schools AS s_schools FROM l0),
l2 AS (SELECT *, round(flood_complaints * s_flood_risk / greatest(0.01e0, flood_risk) * gr, 1) AS s_flood_complaints, round(s_population * 135 / 1e6, 2) AS s_water_required, round(s_population * 0.45e0 / 1000, 2) AS s_waste_generated, round(s_green_share / 100 * area_sq_km * 1e6 / greatest(1e0, s_population), 2) AS s_open_space,
 45e0 * greatest(0e0, transit_pct) * (population / 12.4e6) + 0.08e0 * new_bus_stops + 6e0 * gap * drainage_pct / 100 + 3e0 * green_pct / 100 * area_sq_km * 100 + 1.2e0 * water_mld + 0.25e0 * (s_waste_processed - waste_processed) + 4e0 * new_health + 6e0 * new_schools AS cost FROM l1)"""


def _score(p: str) -> str:
    c = lambda x: f"greatest(0e0, least(1e0, {x}))"
    terms = {
        0.15: [c(f"{p}water_supplied / greatest(0.01e0, {p}water_required)"), c(f"{p}drain_capacity / greatest(0.01e0, {p}drain_required)"), c(f"1 - {p}flood_risk")],
        0.10: [c(f"{p}waste_processed / greatest(0.01e0, {p}waste_generated)"), c(f"{p}schools * 5000 / greatest(1e0, {p}population)"), c(f"{p}open_space / 10")],
        0.12: [c(f"{p}health * 15000 / greatest(1e0, {p}population)")], 0.13: [c(f"(3 - {p}congestion) / 2")],
    }
    return "round(100 * (" + " + ".join(f"{w}e0 * {x}" for w, xs in terms.items() for x in xs) + "), 2)"


SCORED = f"ls AS (SELECT *, {_score('')} AS base_score, {_score('s_')} AS score FROM l2)"
SCN_SQL = f"{ALL_GAPS}, {FLOOD}, {SCOPES}, {INDICATORS}, {BASELINE}, sn AS ({SCN}), {LEVERED}, {SCORED}"


def baseline(t):
    i = inputs(t)
    drain = M.recompute_gaps(i, [M.gap_drainage]).select("ward_id", F.col("required_capacity").alias("drain_required"), F.col("existing_capacity").alias("drain_capacity"))
    w = F.col("ward_id")
    si = i.join(M.flood_scores(i).withColumnRenamed("exposure", "flood_risk"), "ward_id").join(drain, "ward_id").withColumns(
        {"ridership": 1000 + w * 37, "congestion": 1.0 + (w % 10) / 5.0, "flood_12m": F.col("c_flooding"), "runoff": 0.5 + (w % 4) / 10.0, "green_sq_km": F.col("green_share_pct") / 100 * F.col("area_sq_km")}
    )
    scopes = t.wards.select(F.lit("city").alias("scope"), "ward_id").union(t.wards.select("zone", "ward_id"))
    return SC.scenario_baseline(si.drop("scope"), scopes)


def simulated(t):
    return SC.apply_levers(baseline(t), t.spark.sql(SCN))


BASE_COLS = ["scope", "population", "ridership", "congestion", "bus_stops", "flood_risk", "flood_complaints", "drain_required", "water_required", "water_supplied", "health", "schools", "green_share", "open_space"]


@query("scn1_scenario_baseline", f"SELECT {', '.join(BASE_COLS)} FROM bl", INPUT_FIXTURES, SCN_SQL)
def _(t):
    return baseline(t).select(*BASE_COLS)


SIM_COLS = ["scope", "scenario", "s_population", "s_ridership", "s_congestion", "s_drain_capacity", "s_drain_required", "s_flood_risk", "s_flood_complaints", "s_water_supplied", "s_waste_processed", "s_open_space"]


@query("scn2_apply_levers", f"SELECT {', '.join(SIM_COLS)}, round(cost, 1) AS cost FROM l2", INPUT_FIXTURES, SCN_SQL)
def _(t):
    return simulated(t).select(*SIM_COLS, F.round("cost", 1).alias("cost"))


@query("scn3_adequacy_score", "SELECT scope, scenario, base_score, score FROM ls", INPUT_FIXTURES, SCN_SQL)
def _(t):
    return SC.scored(simulated(t)).select("scope", "scenario", "base_score", "score")


@query(
    "scn4_scenario_deltas",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT scope, scenario, '{x}' AS indicator, round(s_{x} - {x}, 3) AS delta FROM l2" for x in SC.INDICATORS) + ") WHERE delta <> 0",
    INPUT_FIXTURES, SCN_SQL,
)
def _(t):
    return SC.scenario_deltas(simulated(t))


def _compared(p: str) -> dict[str, str]:
    """SQL of what is compared, of columns with a prefix."""
    return {x: f"{p}{x}" for x in SC.INDICATORS} | {
        "water_gap": f"round(greatest(0e0, {p}water_required - {p}water_supplied), 2)", "uncollected_waste": f"round(greatest(0e0, 100 * (1 - {p}waste_processed / greatest(0.01e0, {p}waste_generated))), 1)",
        "residents_per_health": f"round({p}population / greatest(1e0, {p}health), 0)", "residents_per_school": f"round({p}population / greatest(1e0, {p}schools), 0)",
    }


COMPARED = ["transit", "drains", "growth", "services"]


@query(
    "scn5_compare_scenarios",
    " UNION ALL ".join(
        f"SELECT scope, '{x}' AS indicator, max({before})::DOUBLE AS baseline, " + ", ".join(f"(max({after}) FILTER (scenario = '{n}'))::DOUBLE AS {n}" for n in COMPARED) + " FROM l2 GROUP BY 1"
        for (x, before), after in zip(_compared("").items(), _compared("s_").values(), strict=True)
    ),
    INPUT_FIXTURES, SCN_SQL,
)
def _(t):
    return SC.compare_scenarios(simulated(t), COMPARED)


@query(
    "scn5_rank_scenarios",
    "SELECT scope, scenario, score, score_change, capital_cost, gain_per_100, row_number() OVER (PARTITION BY scope ORDER BY score DESC, scenario)::INT AS rank, row_number() OVER (PARTITION BY scope ORDER BY coalesce(gain_per_100, -1) DESC, score DESC, scenario) = 1 AS most_effective FROM (SELECT *, round(score - base_score, 2) AS score_change, round(cost, 1) AS capital_cost, CASE WHEN cost > 0 THEN round((score - base_score) / (cost / 100), 3) END AS gain_per_100 FROM ls)",
    INPUT_FIXTURES, SCN_SQL,
)
def _(t):
    return SC.rank_scenarios(SC.scored(simulated(t)))


@query("scn6_assumption_list", "SELECT c_custkey::VARCHAR AS scenario, CASE WHEN c_custkey % 3 <> 0 THEN 'drainage' ELSE '' END AS used, CASE WHEN c_custkey % 2 = 0 THEN 'magic' ELSE '' END AS unknown FROM customer")
def _(t):
    k = F.col("c_custkey")
    p = F.create_map(F.lit("drainage_pct"), (k % 3).cast("double"), F.when(k % 2 == 0, "magic").otherwise("green_pct"), F.lit(0.0))
    a = SC.assumption_list(t.customer.select(k.cast("string").alias("scenario"), p.alias("parameters")))
    return a.select("scenario", F.array_join("used", ",").alias("used"), F.array_join("unknown", ",").alias("unknown"))


# forecasting

PANEL = "pn AS (SELECT s.*, w.population / w.area_sq_km AS density FROM service s JOIN wards w USING (ward_id) QUALIFY count(*) OVER (PARTITION BY ward_id, metric) >= 18)"
W = "OVER (PARTITION BY ward_id, metric ORDER BY month"
FEAT = f"ft AS (SELECT * FROM (SELECT ward_id, metric, month, avg(value) OVER (PARTITION BY ward_id, metric) AS scale, value / avg(value) OVER (PARTITION BY ward_id, metric) AS y, row_number() {W}) - 1 AS t, lag(value) {W}) / avg(value) OVER (PARTITION BY ward_id, metric) AS lag_1, lag(value, 12) {W}) / avg(value) OVER (PARTITION BY ward_id, metric) AS lag_12, avg(value) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / avg(value) OVER (PARTITION BY ward_id, metric) AS rolling_3, ln(1 + density) AS log_density FROM pn) WHERE t >= 12)"
SPLIT = "st AS (SELECT *, t > max(t) OVER (PARTITION BY metric) - 6 AS is_test FROM ft)"


def panel(t):
    return FC.load_panel(t.service, t.wards)


@query("fc1_load_panel", "SELECT ward_id, metric, month, round(density, 4) AS density FROM pn", "service wards", PANEL)
def _(t):
    return panel(t).select("ward_id", "metric", "month", F.round("density", 4).alias("density"))


@query("fc2_panel_features", "SELECT ward_id, metric, month, CAST(t AS DOUBLE) AS t, round(y, 6) AS y, round(lag_1, 6) AS lag_1, round(lag_12, 6) AS lag_12, round(rolling_3, 6) AS rolling_3, round(log_density, 6) AS log_density FROM ft", "service wards", f"{PANEL}, {FEAT}")
def _(t):
    return FC.panel_features(panel(t)).select("ward_id", "metric", "month", "t", *[F.round(c, 6).alias(c) for c in ("y", "lag_1", "lag_12", "rolling_3", "log_density")])


@query("fc3_time_split", "SELECT metric, is_test, count(*) AS n FROM st GROUP BY 1, 2", "service wards", f"{PANEL}, {FEAT}, {SPLIT}")
def _(t):
    return FC.time_split(FC.panel_features(panel(t))).groupBy("metric", "is_test").agg(F.count("*").alias("n"))


METRICS = ["water_demand_mld", "waste_generation_tpd", "transit_ridership"]


def backtest(t):
    """The held-out rows of every metric, predicted by trees fitted on the rows before."""
    s = checkpoint(FC.time_split(FC.panel_features(panel(t))))
    return FC.predict_metrics(FC.fit_metrics(s.where("NOT is_test"), METRICS), s.where("is_test"))


@query("fc4_fit_gbt")
def _(t):
    return backtest(t).select("ward_id", "metric", "month", "y", "prediction", "scale", "lag_12")


@query("fc5_backtest_metrics")
def _(t):
    return FC.backtest_metrics(backtest(t))


@query("fc6_seasonal_naive", "SELECT metric, round(100 * avg(abs(y - lag_12) * scale / (abs(y) * scale)), 4) AS naive_mape FROM st WHERE is_test GROUP BY 1", "service wards", f"{PANEL}, {FEAT}, {SPLIT}")
def _(t):
    return FC.seasonal_naive(FC.time_split(FC.panel_features(panel(t)))).withColumn("naive_mape", F.round("naive_mape", 4))


@query("fc7_forecast")
def _(t):
    p = checkpoint(panel(t))
    return FC.forecast_metrics(FC.fit_metrics(checkpoint(FC.panel_features(p)), METRICS), p, 12)


PRED = "pd AS (SELECT ward_id, metric, 1 + s AS step, scale * 1e0 AS scale, 1e0 + s * 0.05e0 AS p FROM (SELECT DISTINCT ward_id, metric, scale FROM ft), range(0, 3) r(s))"
BANDS = "bd AS (SELECT *, round(p * scale, 2) AS value, round(greatest(0e0, (p - 1.96e0 * 0.1e0 * sqrt(step)) * scale), 2) AS lower, round((p + 1.96e0 * 0.1e0 * sqrt(step)) * scale, 2) AS upper FROM pd)"


def bands(t):
    base = FC.panel_features(panel(t)).select("ward_id", "metric", "scale").groupBy("ward_id", "metric").agg(F.first("scale").alias("scale"))
    p = base.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    return FC.interval_bands(p.select("ward_id", "metric", (F.col("s") + 1).alias("step"), "scale", (1.0 + F.col("s") * 0.05).alias("p")), F.lit(0.1))


FC_SQL = f"{PANEL}, {FEAT}, {PRED}, {BANDS}"


@query("fc8_interval_bands", "SELECT ward_id, metric, step, round(value) AS value, round(lower) AS lower, round(upper) AS upper FROM bd", "service wards", FC_SQL)
def _(t):
    return bands(t).select("ward_id", "metric", F.col("step").cast("long").alias("step"), *[F.round(c).alias(c) for c in ("value", "lower", "upper")])


@query("fc9_city_forecast", "SELECT metric, step, round(sum(value), 0) AS value, round(greatest(0e0, sum(value) - sqrt(sum(pow(upper - value, 2)))), 0) AS lower, round(sum(value) + sqrt(sum(pow(upper - value, 2))), 0) AS upper FROM bd GROUP BY 1, 2", "service wards", FC_SQL)
def _(t):
    return FC.city_forecast(bands(t)).select("metric", F.col("step").cast("long").alias("step"), *[F.round(c, 0).alias(c) for c in ("value", "lower", "upper")])


LAST = f"la AS (SELECT ward_id, metric, avg(value) AS last, count(*) AS n FROM (SELECT *, row_number() {W} DESC) AS k FROM service) WHERE k <= 12 GROUP BY 1, 2), ah AS (SELECT ward_id, metric, avg(value) AS ahead FROM bd GROUP BY 1, 2)"


@query("fc10_demand_growth", "SELECT ward_id, round(avg(100 * (ahead - last) / last), 2) AS growth_pct FROM la JOIN ah USING (ward_id, metric) WHERE n >= 12 AND last > 0 GROUP BY 1", "service wards", f"{FC_SQL}, {LAST}")
def _(t):
    return FC.demand_growth(t.service, bands(t))


@query("fc11_forecast_summary", "SELECT ward_id, metric, round(100 * (ahead - last) / last, 1) AS growth_pct FROM la JOIN ah USING (ward_id, metric)", "service wards", f"{FC_SQL}, {LAST}")
def _(t):
    return FC.forecast_summary(t.service, bands(t)).select("ward_id", "metric", "growth_pct")
