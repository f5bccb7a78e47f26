"""Queries of planning metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from placestat.operators import aggregates as A
from placestat.operators import planning as M
from placestat.plans.registry import query

CATEGORY = "CASE category WHEN '1-URGENT' THEN 'FLOODING' WHEN '2-HIGH' THEN 'WATER_SUPPLY' WHEN '3-MEDIUM' THEN 'HEALTHCARE' WHEN '5-LOW' THEN 'PARKS' ELSE 'EDUCATION' END"
METRIC = "CASE metric WHEN 'water_demand_mld' THEN 'water_supplied_mld' WHEN 'waste_generation_tpd' THEN 'waste_processed_tpd' ELSE metric END"
INPUT_FIXTURES = "wards assets cases satellite land service"
INPUTS = f"""cp AS (SELECT ward_id, {CATEGORY} AS category, created_at FROM cases), sv AS (SELECT ward_id, {METRIC} AS metric, month, value / 1e5 AS value FROM service),
i AS (SELECT w.*, coalesce(a.health, 0) AS n_healthcare, coalesce(a.edu, 0) AS n_education, coalesce(a.school, 0) AS n_education_school, coalesce(a.bus, 0) AS n_bus_stop, coalesce(a.rail, 0) AS n_rail_station,
 coalesce(c.flood, 0) AS c_flooding, coalesce(c.water, 0) AS c_water_supply, coalesce(c.health, 0) AS c_healthcare, coalesce(c.parks, 0) AS c_parks, coalesce(c.edu, 0) AS c_education,
 s.built_up_sq_km, l.forest_green_pct AS green_share_pct, v.water_mld, v.waste_tpd
 FROM wards w LEFT JOIN (SELECT ward_id, count(*) FILTER (asset_type = 'HEALTHCARE') AS health, count(*) FILTER (asset_type = 'EDUCATION') AS edu, count(*) FILTER (asset_type = 'EDUCATION' AND subtype = 'school') AS school, count(*) FILTER (asset_type = 'BUS_STOP') AS bus, count(*) FILTER (asset_type = 'RAIL_STATION') AS rail FROM assets GROUP BY 1) a USING (ward_id)
 LEFT JOIN (SELECT ward_id, count(*) FILTER (category = 'FLOODING') AS flood, count(*) FILTER (category = 'WATER_SUPPLY') AS water, count(*) FILTER (category = 'HEALTHCARE') AS health, count(*) FILTER (category = 'PARKS') AS parks, count(*) FILTER (category = 'EDUCATION') AS edu FROM cp GROUP BY 1) c USING (ward_id)
 LEFT JOIN (SELECT ward_id, max_by(built_up_sq_km, year) AS built_up_sq_km FROM satellite GROUP BY 1) s USING (ward_id) LEFT JOIN land l USING (ward_id)
 LEFT JOIN (SELECT ward_id, max_by(value, month) FILTER (metric = 'water_supplied_mld') AS water_mld, max_by(value, month) FILTER (metric = 'waste_processed_tpd') AS waste_tpd FROM sv GROUP BY 1) v USING (ward_id))"""
BAND = "CASE WHEN {p} >= 40 THEN 'CRITICAL' WHEN {p} >= 20 THEN 'HIGH' WHEN {p} >= 5 THEN 'MODERATE' ELSE 'LOW' END"
RUNOFF = "(0.9e0 * least(area_sq_km, bu) + 0.25e0 * gr + 0.6e0 * greatest(0e0, area_sq_km - least(area_sq_km, bu) - gr)) / area_sq_km"
GAP_ROWS = f"""x AS (SELECT *, coalesce(built_up_sq_km, area_sq_km * 0.6e0) AS bu, coalesce(green_share_pct, 0) / 1e2 * area_sq_km AS gr FROM i),
g0 AS (SELECT ward_id, area_sq_km, low_lying_share, 'Healthcare Capacity' AS sector, population / 15e3 AS req, n_healthcare * 1e0 AS have, c_healthcare AS c, 'LOW' AS data_confidence FROM x
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Education', population / 5e3, CASE WHEN n_education_school > 0 THEN n_education_school ELSE n_education END * 1e0, c_education, 'LOW' FROM x
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Public Transit Access', bu * 4e0, (n_bus_stop + 3 * n_rail_station) * 1e0, 0, 'LOW' FROM x
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Open Space', population * 1e1 / 1e4, area_sq_km * 100 * green_share_pct / 100, c_parks, 'MEDIUM' FROM x WHERE green_share_pct IS NOT NULL
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Drainage & Storm Water', {RUNOFF} * (50e0 / 1000 / 3600) * (area_sq_km * 1e6), {RUNOFF} * (25e0 / 1000 / 3600) * (area_sq_km * 1e6), c_flooding, 'MEDIUM' FROM x
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Water Supply', population * 135 / 1e6, water_mld, c_water_supply, 'DEMO' FROM x WHERE water_mld IS NOT NULL
 UNION ALL SELECT ward_id, area_sq_km, low_lying_share, 'Waste Management', population * 0.45e0 / 1000, waste_tpd, 0, 'DEMO' FROM x WHERE waste_tpd IS NOT NULL),
g1 AS (SELECT *, CASE WHEN req > 0 THEN round(100 * greatest(0e0, req - have) / req, 1) ELSE 0e0 END AS deficit_percentage, round(c / greatest(0.1e0, area_sq_km), 3) AS complaint_density FROM g0),
gaps AS (SELECT ward_id, sector, CAST(round(CAST(req AS DECIMAL(18, 6)), 2) AS DOUBLE) AS required_capacity, round(have, 2) AS existing_capacity, round(greatest(0e0, req - have), 2) AS deficit_amount, deficit_percentage, complaint_density, data_confidence,
 CASE WHEN sector = 'Drainage & Storm Water' THEN CASE WHEN low_lying_share >= 0.22e0 OR complaint_density >= 2 THEN 'CRITICAL' WHEN low_lying_share >= 0.12e0 OR complaint_density >= 1 THEN 'HIGH' ELSE 'MODERATE' END ELSE {BAND.format(p='deficit_percentage')} END AS severity FROM g1)"""
ALL_GAPS = f"{INPUTS}, {GAP_ROWS}"
COLS = ["ward_id", "sector", "required_capacity", "existing_capacity", "deficit_amount", "deficit_percentage", "complaint_density", "data_confidence", "severity"]


def complaints(t):
    return t.cases.select("ward_id", F.expr(CATEGORY).alias("category"), "created_at")


def inputs(t):
    served = t.service.select("ward_id", F.expr(METRIC).alias("metric"), "month", (F.col("value") / 1e5).alias("value"))
    return M.region_inputs(t.wards, t.assets, complaints(t), t.satellite, t.land, served)


def gaps(t):
    return M.recompute_gaps(inputs(t)).select(*COLS)


for number, (function, sector) in enumerate(zip(M.GAPS, ("Healthcare Capacity", "Education", "Public Transit Access", "Open Space", "Drainage & Storm Water", "Water Supply", "Waste Management"), strict=True), 1):
    query(f"met{number}_{function.__name__}", f"SELECT {', '.join(COLS)} FROM gaps WHERE sector = '{sector}'", INPUT_FIXTURES, ALL_GAPS)(lambda t, f=function: M.recompute_gaps(inputs(t), [f]).select(*COLS))


@query("met8_recompute_gaps", f"SELECT {', '.join(COLS)} FROM gaps", INPUT_FIXTURES, ALL_GAPS)
def _(t):
    return gaps(t)


CLASS = "CASE WHEN b >= 8 OR (b >= 5 AND v <= -5) THEN 'RAPID_EXPANSION' WHEN s >= 55 AND (b > 0 OR c >= 15) THEN 'DENSIFYING' WHEN v >= 10 AND b <= 0 THEN 'GREENING' ELSE 'STABLE' END"
PROFILE = f"""tp AS (SELECT ward_id, CASE WHEN p > 0 THEN round(100.0 * (r - p) / p, 2) END AS g FROM (SELECT ward_id, count(*) FILTER (created_at >= date '2000-08-01') AS r, count(*) FILTER (created_at < date '2000-08-01') AS p FROM cases WHERE created_at >= date '1999-08-01' GROUP BY 1)),
e AS (SELECT ward_id, min(year) AS start_year, max(year) AS end_year, min_by(built_up_sq_km, year) AS b0, max_by(built_up_sq_km, year) AS b1, min_by(vegetation_sq_km, year) AS v0, max_by(vegetation_sq_km, year) AS v1, min_by(water_sq_km, year) AS w0, max_by(water_sq_km, year) AS w1, min_by(mean_ndvi, year) AS n0, max_by(mean_ndvi, year) AS n1 FROM satellite GROUP BY 1),
p0 AS (SELECT e.*, tp.g, w.area_sq_km, CASE WHEN b0 <> 0 THEN round(100 * (b1 - b0) / b0, 2) END AS bp, CASE WHEN v0 <> 0 THEN round(100 * (v1 - v0) / v0, 2) END AS vp FROM e JOIN wards w USING (ward_id) LEFT JOIN tp USING (ward_id)),
prof AS (SELECT ward_id, start_year, end_year, b0 AS built_up_start, b1 AS built_up_end, round(b1 - b0, 3) AS built_up_change, bp AS built_up_change_pct, round(100 * b1 / area_sq_km, 1) AS built_up_share_pct, round(v1 - v0, 3) AS vegetation_change, vp AS vegetation_change_pct, round(w1 - w0, 3) AS water_change, round(n1 - n0, 4) AS ndvi_change,
 round((pow(b1 / b0, 1e0 / greatest(1, end_year - start_year)) - 1) * 100, 2) AS annual_growth_pct, g AS complaint_growth_pct,
 {CLASS.replace('b >', 'coalesce(bp, 0) >').replace('b <=', 'coalesce(bp, 0) <=').replace('v ', 'coalesce(vp, 0) ').replace('s >=', '100 * b1 / area_sq_km >=').replace('c >=', 'coalesce(g, 0) >=')} AS growth_class FROM p0)"""


def profiles(t):
    return M.growth_profile(t.satellite, t.wards, A.two_period_growth(t.cases, F.lit("2001-08-01").cast("date")))


@query("met9_growth_profile", "SELECT * FROM prof", "satellite wards cases", PROFILE)
def _(t):
    return profiles(t)


@query("met10_classify_growth", f"SELECT c_custkey, {CLASS} AS class FROM (SELECT c_custkey, c_acctbal / 500 AS b, c_custkey % 31 - 15 AS v, c_custkey % 100 AS s, c_custkey % 23 AS c FROM customer)")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", M.classify_growth(F.col("c_acctbal") / 500, k % 31 - 15, k % 100, k % 23).alias("class"))


@query(
    "met11_city_growth_summary",
    "SELECT round(sum(built_up_start), 2) AS built_up_start, round(sum(built_up_end), 2) AS built_up_end, round(100 * (sum(built_up_end) - sum(built_up_start)) / sum(built_up_start), 2) AS expansion_pct, round(sum(vegetation_change), 2) AS vegetation_change, (SELECT string_agg(ward_id::VARCHAR, ',' ORDER BY ward_id) FROM (SELECT ward_id FROM prof ORDER BY built_up_change_pct DESC NULLS LAST, ward_id LIMIT 3)) AS fastest FROM prof",
    "satellite wards cases", PROFILE,
)
def _(t):
    return M.city_growth_summary(profiles(t))


@query("agg14_growth_class_counts", "SELECT growth_class, count(*) AS n FROM prof GROUP BY 1", "satellite wards cases", PROFILE)
def _(t):
    return A.value_counts(profiles(t), "growth_class")


FLOOD = "fl AS (SELECT ward_id, round(0.5e0 * least(1e0, coalesce(nullif(low_lying_share, 0), 0.1e0) / 0.35e0) + 0.3e0 * least(1e0, coalesce(100 * built_up_sq_km / area_sq_km, 55e0) / 100) + 0.2e0 * (c_flooding / area_sq_km) / (max(c_flooding / area_sq_km) OVER ()), 3) AS exposure FROM i)"


@query("met12_flood_exposure", "SELECT * FROM fl", INPUT_FIXTURES, f"{INPUTS}, {FLOOD}")
def _(t):
    return M.flood_scores(inputs(t))


RISK = "rk AS (SELECT ward_id, month, CASE WHEN rainfall_mm > 50 THEN round(least(1e0, exposure * (0.55e0 + 0.45e0 * least(1e0, rainfall_mm / 600))), 3) ELSE round(exposure * 0.5e0, 3) END AS risk FROM environment JOIN fl USING (ward_id))"


@query(
    "met13_seasonal_flood_risk",
    "SELECT ward_id, month, CASE WHEN month = max(month) OVER (PARTITION BY ward_id) THEN max(risk) OVER (PARTITION BY ward_id) ELSE risk END AS risk FROM rk",
    INPUT_FIXTURES + " environment", f"{INPUTS}, {FLOOD}, {RISK}",
)
def _(t):
    return M.seasonal_flood_risk(M.flood_scores(inputs(t)), t.environment)


RAW = "raw AS (SELECT i.ward_id, 1000e0 * (c_flooding + c_water_supply + c_healthcare + c_parks + c_education) / greatest(1, population) AS complaint_density, d.deficit AS infrastructure_deficit, population / area_sq_km AS population_density, fl.exposure AS flood_exposure, (i.ward_id % 7) * 1e0 AS demand_growth FROM i JOIN fl USING (ward_id) JOIN (SELECT ward_id, sum(deficit_percentage * w) / sum(w) AS deficit FROM (SELECT *, CASE WHEN data_confidence = 'LOW' THEN 0.6e0 ELSE 1e0 END AS w FROM gaps) GROUP BY 1) d USING (ward_id))"
NORM = "CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN 0.5e0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
SCORE = "sc AS (SELECT ward_id, round(100 * (" + " + ".join(f"{w} * {NORM.format(c=c)}" for c, w in M.K.PRIORITY_WEIGHTS.items()) + "), 2) AS score FROM raw)"


def raw_criteria(t):
    i = inputs(t)
    said = sum((F.col(f"c_{c.lower()}") for c in M.COMPLAINTS), F.lit(0))
    base = i.select("ward_id", (1000.0 * said / F.greatest(F.lit(1), F.col("population"))).alias("complaint_density"), (F.col("population") / F.col("area_sq_km")).alias("population_density"), ((F.col("ward_id") % 7) * 1.0).alias("demand_growth"))
    d = A.confidence_weighted_deficit(M.recompute_gaps(i)).withColumnRenamed("deficit", "infrastructure_deficit")
    return base.join(d, "ward_id").join(M.flood_scores(i).withColumnRenamed("exposure", "flood_exposure"), "ward_id")


@query("met14_priority_scores", "SELECT * FROM sc", INPUT_FIXTURES, f"{ALL_GAPS}, {FLOOD}, {RAW}, {SCORE}")
def _(t):
    return M.priority_scores(raw_criteria(t)).select("ward_id", "score")


SECTORS = " UNION ALL ".join(f"SELECT '{s}' AS sector, '{c}' AS category" for s, cs in M.SECTOR_CATEGORIES.items() for c in cs)
RECS = f"""sec AS ({SECTORS}), pr AS (SELECT ward_id, sector, {NORM.format(c='v')} AS cn FROM (SELECT w.ward_id, s.sector, count(cp.category) / greatest(0.1e0, any_value(w.area_sq_km)) AS v FROM wards w CROSS JOIN sec s LEFT JOIN cp ON cp.ward_id = w.ward_id AND cp.category = s.category GROUP BY 1, 2)),
pp AS (SELECT ward_id, {NORM.format(c='population')} AS pn, (ward_id % 9) / 8e0 AS gn FROM wards),
recs AS (SELECT g.ward_id, g.sector, g.severity, g.deficit_amount, round(100 * (0.35e0 * (CASE g.severity WHEN 'CRITICAL' THEN 1e0 ELSE 0.7e0 END * least(1e0, 0.5e0 + g.deficit_percentage / 100) * CASE g.data_confidence WHEN 'LOW' THEN 0.6e0 WHEN 'DEMO' THEN 0.9e0 ELSE 1e0 END) + 0.25e0 * pn + 0.2e0 * cn + 0.2e0 * gn), 2) AS score FROM gaps g JOIN pr USING (ward_id, sector) JOIN pp USING (ward_id) WHERE g.severity IN ('CRITICAL', 'HIGH'))"""


def recs(t):
    growth = t.wards.select("ward_id", ((F.col("ward_id") % 9) * 1.0).alias("growth_raw"))
    return M.recommendations(M.recompute_gaps(inputs(t)), t.wards, complaints(t), growth)


@query("met15_recommendations", "SELECT *, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level FROM recs", INPUT_FIXTURES, f"{ALL_GAPS}, {RECS}")
def _(t):
    return recs(t)


COST = "CASE sector " + " ".join(f"WHEN '{s}' THEN {M.K.UNIT_COST[u]}e0" for s, u in M.SECTOR_COST.items()) + " END"


@query(
    "met16_intervention_cost_text",
    f"SELECT ward_id, sector, quantity, round({COST} * quantity, 2) AS cost FROM (SELECT *, CASE WHEN sector IN ('Healthcare Capacity', 'Education', 'Public Transit Access') THEN round(deficit_amount, 0) WHEN sector = 'Open Space' THEN round(deficit_amount * 0.1e0, 1) ELSE deficit_amount END AS quantity FROM recs)",
    INPUT_FIXTURES, f"{ALL_GAPS}, {RECS}",
)
def _(t):
    return M.intervention_cost_text(recs(t)).select("ward_id", "sector", "quantity", "cost")


@query(
    "met17_transport_indicators",
    "SELECT ward_id, CAST(floor(population * 1.35e0 * 0.52e0 * least(1.25e0, 0.8e0 + 0.05e0 * n_rail_station + 0.002e0 * n_bus_stop)) AS BIGINT) AS ridership, round(least(3e0, greatest(1.1e0, 1e0 + 1.6e0 * (population / area_sq_km / 60000) + 0.6e0 / greatest(0.15e0, (area_sq_km * 7) / greatest(1e0, population / 1000)) * 0.1e0)), 3) AS congestion, round(area_sq_km * 7 / area_sq_km, 2) AS road_density, n_bus_stop FROM i",
    INPUT_FIXTURES, INPUTS,
)
def _(t):
    return M.transport_indicators(inputs(t), F.col("area_sq_km") * 7)


DEMAND = f"dm AS (SELECT ward_id, population, projected, round(projected * 135 / 1e6, 2) AS water_required, CAST(ceil(projected / 15e3) AS BIGINT) AS health_required, CAST(ceil(projected / 5e3) AS BIGINT) AS schools_required, round(greatest(0e0, round(projected * 135 / 1e6, 2) - round(coalesce(water_mld, 0), 2)), 2) AS additional_water, greatest(0, CAST(ceil(projected / 15e3) AS BIGINT) - n_healthcare) AS additional_health, greatest(0, CAST(ceil(projected / 5e3) AS BIGINT) - n_education_school) AS additional_schools FROM (SELECT *, CAST(round(population * pow({1 + M.K.ANNUAL_GROWTH!r}, 24)) AS BIGINT) AS projected FROM i))"


@query("met18_infrastructure_demand", "SELECT * FROM dm", INPUT_FIXTURES, f"{INPUTS}, {DEMAND}")
def _(t):
    return M.infrastructure_demand(inputs(t), 2035)


CENSUS = "cs AS (SELECT c_nationkey AS ward_id, count(*) * 1000 AS population, count(*) * 480 AS females, count(*) * 230 AS households, 2011 AS census_year FROM customer GROUP BY 1)"


def census(t):
    n = F.count("*")
    return t.customer.groupBy(F.col("c_nationkey").alias("ward_id")).agg((n * 1000).alias("population"), (n * 480).alias("females"), (n * 230).alias("households")).withColumn("census_year", F.lit(2011))


@query("met19_demographic_profile", "SELECT ward_id, round(100.0 * females / population, 2) AS female_pct, round(population / households, 2) AS household_size, residential_pct FROM cs LEFT JOIN land USING (ward_id)", "land", CENSUS)
def _(t):
    return M.demographic_profile(census(t), t.land).select("ward_id", "female_pct", "household_size", F.col("land_use.residential_pct").alias("residential_pct"))


@query(
    "met20_current_estimate",
    f"SELECT ward_id, census_year, population, females, households, provenance, round(population / area_sq_km, 1) AS density FROM (SELECT ward_id, census_year, population, females, households, 'CENSUS' AS provenance FROM cs UNION ALL SELECT ward_id, 2026, p, CAST(floor(females * (p / population)) AS BIGINT), CAST(floor(households * (p / population)) AS BIGINT), 'ESTIMATED' FROM (SELECT *, CAST(round(population * pow({1 + M.K.ANNUAL_GROWTH!r}, 15)) AS BIGINT) AS p FROM cs)) JOIN wards w USING (ward_id)".replace("SELECT ward_id, census_year, population, females, households, provenance, round(population", "SELECT x.ward_id, census_year, x.population, females, households, provenance, round(x.population").replace(") JOIN wards w USING (ward_id)", ") x JOIN wards w ON w.ward_id = x.ward_id"),
    "wards", CENSUS,
)
def _(t):
    return M.current_estimate(census(t), t.wards, 2026, ["females", "households"])


# reports on gaps and regions


@query("rep5_gap_listing", "SELECT w.ward_code, g.sector, g.severity, g.deficit_percentage FROM gaps g JOIN wards w USING (ward_id) WHERE g.severity = 'CRITICAL' ORDER BY g.deficit_percentage DESC, g.ward_id, g.sector LIMIT 30", INPUT_FIXTURES, ALL_GAPS)
def _(t):
    g = gaps(t).where("severity = 'CRITICAL'").join(t.wards.select("ward_id", "ward_code"), "ward_id")
    return g.orderBy(F.desc("deficit_percentage"), "ward_id", "sector").limit(30).select("ward_code", "sector", "severity", "deficit_percentage")


@query("rep6_growth_report", "SELECT w.ward_code, p.built_up_change_pct, p.growth_class FROM prof p JOIN wards w USING (ward_id)", "satellite wards cases", PROFILE)
def _(t):
    return profiles(t).join(t.wards.select("ward_id", "ward_code"), "ward_id").select("ward_code", "built_up_change_pct", "growth_class")


@query("rep7_recommendation_listing", "SELECT w.ward_code, r.sector, r.score FROM recs r JOIN wards w USING (ward_id) WHERE r.score >= 40", INPUT_FIXTURES, f"{ALL_GAPS}, {RECS}")
def _(t):
    return recs(t).where("score >= 40").join(t.wards.select("ward_id", "ward_code"), "ward_id").select("ward_code", "sector", "score")


@query(
    "rep2_region_summaries",
    "SELECT w.ward_id, w.ward_code, coalesce(c.total, 0) AS total, coalesce(c.open, 0) AS open, coalesce(g.severe, 0) AS severe, s.score FROM wards w LEFT JOIN (SELECT ward_id, count(*) AS total, count(*) FILTER (status = 'OPEN') AS open FROM cases GROUP BY 1) c USING (ward_id) LEFT JOIN (SELECT ward_id, count(*) AS severe FROM gaps WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1) g USING (ward_id) LEFT JOIN sc s USING (ward_id)",
    INPUT_FIXTURES, f"{ALL_GAPS}, {FLOOD}, {RAW}, {SCORE}",
)
def _(t):
    c = t.cases.groupBy("ward_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OPEN").alias("open"))
    g = gaps(t).where(F.col("severity").isin("CRITICAL", "HIGH")).groupBy("ward_id").agg(F.count("*").alias("severe"))
    out = t.wards.select("ward_id", "ward_code").join(c, "ward_id", "left").join(g, "ward_id", "left").join(M.priority_scores(raw_criteria(t)).select("ward_id", "score"), "ward_id", "left")
    return out.withColumns({x: F.coalesce(F.col(x), F.lit(0)) for x in ("total", "open", "severe")}).orderBy(F.desc("score"), "ward_id")


@query(
    "rep4_choropleth",
    "SELECT w.ward_id, w.population / w.area_sq_km AS v, min(w.population / w.area_sq_km) OVER () AS low, max(w.population / w.area_sq_km) OVER () AS high FROM wards w",
    "wards",
)
def _(t):
    layer = t.wards.select("ward_id", (F.col("population") / F.col("area_sq_km")).alias("v"))
    return layer.crossJoin(F.broadcast(A.min_max_layer(layer, "v")))


@query("rep3_region_profile", "SELECT w.ward_id, w.population, i.green_share_pct, i.built_up_sq_km, i.n_healthcare, (SELECT count(*) FROM gaps g WHERE g.ward_id = w.ward_id) AS gaps FROM wards w JOIN i USING (ward_id) WHERE w.ward_id = 5", INPUT_FIXTURES, ALL_GAPS)
def _(t):
    i = inputs(t).where("ward_id = 5")
    g = M.recompute_gaps(i).groupBy("ward_id").agg(F.count("*").alias("gaps"))
    return i.join(g, "ward_id").select("ward_id", "population", "green_share_pct", "built_up_sq_km", "n_healthcare", "gaps")


