"""Norm-based gaps, growth, flood exposure, priorities and recommendations, as expressions over region rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.functions import constants as K
from placestat.functions.scalars import pct_change, project_population, severity_band
from placestat.operators.aggregates import counts_by_category, facility_counts
from placestat.operators.joins import attach_dimensions, latest_value
from placestat.operators.ranking import min_max_normalise

FACILITIES = ("HEALTHCARE", "EDUCATION", "EDUCATION_SCHOOL", "BUS_STOP", "RAIL_STATION", "METRO_STATION")
COMPLAINTS = ("WATER_SUPPLY", "WASTE_MANAGEMENT", "DRAINAGE", "FLOODING", "HEALTHCARE", "EDUCATION", "PARKS", "PUBLIC_TRANSPORT", "TRAFFIC")


def _wide(df: DataFrame, key: str, kind: str, names: tuple[str, ...], prefix: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == n, F.col("n"))), F.lit(0)).alias(f"{prefix}{n.lower()}") for n in names])


def region_inputs(regions: DataFrame, assets: DataFrame, complaints: DataFrame, satellite: DataFrame, land: DataFrame, service: DataFrame) -> DataFrame:
    """One row a region with all that the gap formulas need; each fact table is grouped to regions first."""
    have = _wide(facility_counts(assets), "ward_id", "kind", FACILITIES, "n_")
    said = _wide(counts_by_category(complaints), "ward_id", "category", COMPLAINTS, "c_")
    built = latest_value(satellite, ["ward_id"], "built_up_sq_km", "year").select("ward_id", "built_up_sq_km")
    green = latest_value(land, ["ward_id"], "forest_green_pct", "year").select("ward_id", F.col("forest_green_pct").alias("green_share_pct"))
    last = latest_value(service, ["ward_id", "metric"], "value", "month")
    served = last.groupBy("ward_id").agg(
        F.max(F.when(F.col("metric") == "water_supplied_mld", F.col("value"))).alias("water_mld"),
        F.max(F.when(F.col("metric") == "waste_processed_tpd", F.col("value"))).alias("waste_tpd"),
    )
    out = attach_dimensions(regions, have, said, built, green, served)
    counts = [f"n_{n.lower()}" for n in FACILITIES] + [f"c_{n.lower()}" for n in COMPLAINTS]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def _gap(sector: str, required: Column, existing: Column, unit: str, complaints: Column, confidence: str, when: Column | None = None, severity=None) -> Column:
    required, existing = required.cast("double"), existing.cast("double")
    deficit = F.greatest(F.lit(0.0), required - existing)
    pct = F.when(required > 0, F.round(100 * deficit / required, 1)).otherwise(0.0)
    density = F.round(complaints / F.greatest(F.lit(0.1), F.col("area_sq_km")), 3)
    s = F.struct(
        F.lit(sector).alias("sector"), F.round(required, 2).alias("required_capacity"), F.round(existing, 2).alias("existing_capacity"), F.round(deficit, 2).alias("deficit_amount"),
        pct.alias("deficit_percentage"), F.lit(unit).alias("unit"), (severity(pct, density) if severity else severity_band(pct)).alias("severity"), density.alias("complaint_density"), F.lit(confidence).alias("data_confidence"),
    )
    return s if when is None else F.when(when, s)


def gap_health() -> Column:
    return _gap("Healthcare Capacity", F.col("population") / K.PERSONS_PER_HEALTH, F.col("n_healthcare"), "facilities", F.col("c_healthcare"), "LOW")


def gap_education() -> Column:
    have = F.when(F.col("n_education_school") > 0, F.col("n_education_school")).otherwise(F.col("n_education"))
    return _gap("Education", F.col("population") / K.PERSONS_PER_SCHOOL, have, "schools", F.col("c_education"), "LOW")


def _built() -> Column:
    return F.coalesce(F.col("built_up_sq_km"), F.col("area_sq_km") * 0.6)


def gap_transit() -> Column:
    have = F.col("n_bus_stop") + 3 * (F.col("n_rail_station") + F.col("n_metro_station"))
    return _gap("Public Transit Access", _built() * K.STOPS_PER_SQKM, have, "stop equivalents", F.col("c_public_transport") + F.col("c_traffic"), "LOW")


def gap_open_space() -> Column:
    green_ha = F.col("area_sq_km") * 100 * F.col("green_share_pct") / 100
    return _gap("Open Space", F.col("population") * K.OPEN_SPACE_SQM / 1e4, green_ha, "hectares", F.col("c_parks"), "MEDIUM", F.col("green_share_pct").isNotNull())


def runoff_coefficient() -> Column:
    area, built = F.col("area_sq_km"), F.least(F.col("area_sq_km"), _built())
    green = F.coalesce(F.col("green_share_pct"), F.lit(0.0)) / 100 * area
    other = F.greatest(F.lit(0.0), area - built - green)
    return (K.RUNOFF["built"] * built + K.RUNOFF["green"] * green + K.RUNOFF["other"] * other) / F.greatest(F.lit(0.01), area)


def gap_drainage() -> Column:
    """Peak flow at the design and the legacy rainfall; severity follows low-lying land and flood complaints."""
    flow = lambda mm: runoff_coefficient() * (mm / 1000 / 3600) * (F.col("area_sq_km") * 1e6)
    low = F.col("low_lying_share")

    def severity(pct: Column, density: Column) -> Column:
        exposed = F.when((low >= 0.22) | (density >= 2.0), "CRITICAL").when((low >= 0.12) | (density >= 1.0), "HIGH").otherwise("MODERATE")
        return F.when(low.isNull(), severity_band(pct)).otherwise(exposed)

    return _gap("Drainage & Storm Water", flow(K.RAIN_DESIGN_MM), flow(K.RAIN_LEGACY_MM), "m3/s", F.col("c_flooding") + F.col("c_drainage"), "MEDIUM", severity=severity)


def gap_water() -> Column:
    return _gap("Water Supply", F.col("population") * K.WATER_LPCD / 1e6, F.col("water_mld"), "MLD", F.col("c_water_supply"), "DEMO", F.col("water_mld").isNotNull())


def gap_waste() -> Column:
    return _gap("Waste Management", F.col("population") * K.WASTE_KG / 1000, F.col("waste_tpd"), "TPD", F.col("c_waste_management"), "DEMO", F.col("waste_tpd").isNotNull())


GAPS = (gap_health, gap_education, gap_transit, gap_open_space, gap_drainage, gap_water, gap_waste)


def recompute_gaps(inputs: DataFrame, which=GAPS) -> DataFrame:
    """All gaps of all regions, one row each."""
    gaps = F.filter(F.array(*[g() for g in which]), lambda g: g.isNotNull())
    return inputs.select("ward_id", F.explode(gaps).alias("g")).select("ward_id", "g.*")


def classify_growth(built: Column, vegetation: Column, share: Column, complaints: Column) -> Column:
    """RAPID_EXPANSION, DENSIFYING, GREENING or STABLE; unknown changes count as 0."""
    b, v, s, c = (F.coalesce(x, F.lit(0.0)) for x in (built, vegetation, share, complaints))
    return F.when((b >= 8) | ((b >= 5) & (v <= -5)), "RAPID_EXPANSION").when((s >= 55) & ((b > 0) | (c >= 15)), "DENSIFYING").when((v >= 10) & (b <= 0), "GREENING").otherwise("STABLE")


def growth_profile(epochs: DataFrame, regions: DataFrame, complaint_growth: DataFrame) -> DataFrame:
    """Change from the first to the last epoch of each region."""
    cols = ["built_up_sq_km", "vegetation_sq_km", "water_sq_km", "mean_ndvi", "mean_ndbi"]
    s = F.struct(*cols)
    e = epochs.groupBy("ward_id").agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.min_by(s, "year").alias("a"), F.max_by(s, "year").alias("b"))
    j = e.join(regions.select("ward_id", "area_sq_km"), "ward_id").join(complaint_growth.select("ward_id", F.col("growth_pct").alias("complaint_growth_pct")), "ward_id", "left")
    built, veg = pct_change(F.col("b.built_up_sq_km"), F.col("a.built_up_sq_km")), pct_change(F.col("b.vegetation_sq_km"), F.col("a.vegetation_sq_km"))
    share = 100 * F.col("b.built_up_sq_km") / F.nullif(F.col("area_sq_km"), F.lit(0.0))
    span = F.greatest(F.lit(1), F.col("end_year") - F.col("start_year"))
    annual = F.when(F.col("a.built_up_sq_km") != 0, (F.pow(F.col("b.built_up_sq_km") / F.col("a.built_up_sq_km"), 1 / span) - 1) * 100).otherwise(0.0)
    change = lambda c, d: F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), d)
    return j.select(
        "ward_id", "start_year", "end_year", F.col("a.built_up_sq_km").alias("built_up_start"), F.col("b.built_up_sq_km").alias("built_up_end"),
        change("built_up_sq_km", 3).alias("built_up_change"), built.alias("built_up_change_pct"), F.round(share, 1).alias("built_up_share_pct"),
        change("vegetation_sq_km", 3).alias("vegetation_change"), veg.alias("vegetation_change_pct"), change("water_sq_km", 3).alias("water_change"),
        change("mean_ndvi", 4).alias("ndvi_change"), F.round(annual, 2).alias("annual_growth_pct"), "complaint_growth_pct",
        classify_growth(built, veg, share, F.col("complaint_growth_pct")).alias("growth_class"),
    )


def city_growth_summary(profiles: DataFrame) -> DataFrame:
    """Totals and the three fastest regions in one row."""
    total = profiles.agg(
        F.round(F.sum("built_up_start"), 2).alias("built_up_start"), F.round(F.sum("built_up_end"), 2).alias("built_up_end"),
        pct_change(F.sum("built_up_end"), F.sum("built_up_start")).alias("expansion_pct"), F.round(F.sum("vegetation_change"), 2).alias("vegetation_change"),
    )
    top = profiles.orderBy(F.desc_nulls_last("built_up_change_pct"), "ward_id").limit(3).agg(F.array_join(F.array_sort(F.collect_list(F.col("ward_id").cast("int"))), ",").alias("fastest"))
    return total.crossJoin(top)


def flood_exposure(low_share: Column, built_pct: Column, density: Column, most: Column) -> Column:
    """Half low-lying land, three tenths imperviousness, a fifth flood complaints relative to the worst region."""
    seen = F.when(most > 0, density / most).otherwise(0.0)
    return F.round(0.5 * F.least(F.lit(1.0), low_share / 0.35) + 0.3 * F.least(F.lit(1.0), built_pct / 100) + 0.2 * seen, 3)


def flood_scores(inputs: DataFrame) -> DataFrame:
    """(ward_id, exposure): a built-up share of 55 % and a low-lying share of 0.1 are assumed where unknown."""
    built = F.coalesce(100 * F.col("built_up_sq_km") / F.col("area_sq_km"), F.lit(55.0))
    d = inputs.select("ward_id", F.coalesce(F.when(F.col("low_lying_share") != 0, F.col("low_lying_share")), F.lit(0.1)).alias("low"), built.alias("built"), ((F.col("c_flooding") + F.col("c_drainage")) / F.col("area_sq_km")).alias("density"))
    most = d.agg(F.max("density").alias("most"))
    return d.crossJoin(F.broadcast(most)).select("ward_id", flood_exposure(F.col("low"), F.col("built"), F.col("density"), F.col("most")).alias("exposure"))


def seasonal_flood_risk(exposure: DataFrame, environment: DataFrame) -> DataFrame:
    """Monthly risk by rainfall; the latest month of a region gets its worst month's."""
    e = environment.join(exposure, "ward_id")
    factor = 0.55 + 0.45 * F.least(F.lit(1.0), F.col("rainfall_mm") / 600)
    e = e.withColumn("risk", F.when(F.col("rainfall_mm") > 50, F.round(F.least(F.lit(1.0), F.col("exposure") * factor), 3)).otherwise(F.round(F.col("exposure") * 0.5, 3)))
    w = Window.partitionBy("ward_id")
    last = F.col("month") == F.max("month").over(w)
    return e.select("ward_id", "month", F.when(last, F.max("risk").over(w)).otherwise(F.col("risk")).alias("risk"))


def priority_scores(raw: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(ward_id, score, one contribution a criterion): weighted sum of min-max normalised criteria, 0 to 100."""
    weights = weights or K.PRIORITY_WEIGHTS
    n = min_max_normalise(raw, list(weights))
    score = sum((F.col(f"{c}_n") * 100 * w for c, w in weights.items()), F.lit(0.0))
    return n.select("ward_id", F.round(score, 2).alias("score"), *[F.round(F.col(f"{c}_n") * 100 * w, 2).alias(f"{c}_part") for c, w in weights.items()])


# The complaint categories that press on each sector.
SECTOR_CATEGORIES = {
    "Water Supply": ["WATER_SUPPLY"], "Waste Management": ["WASTE_MANAGEMENT"], "Drainage & Storm Water": ["FLOODING", "DRAINAGE"], "Healthcare Capacity": ["HEALTHCARE"],
    "Education": ["EDUCATION"], "Public Transit Access": ["PUBLIC_TRANSPORT", "TRAFFIC"], "Open Space": ["PARKS", "ENVIRONMENT", "AIR_QUALITY"],
}


def recommendations(gaps: DataFrame, regions: DataFrame, complaints: DataFrame, growth: DataFrame) -> DataFrame:
    """Scored interventions for severe gaps.

    ``growth`` has ward_id and growth_raw. Complaints are normalised over regions and sectors together,
    population and growth over regions.
    """
    spark = gaps.sparkSession
    sectors = spark.createDataFrame([(s, c) for s, cs in SECTOR_CATEGORIES.items() for c in cs], "sector string, category string")
    by = counts_by_category(complaints).join(F.broadcast(sectors), "category").groupBy("ward_id", "sector").agg(F.sum("n").alias("n"))
    grid = regions.select("ward_id", "area_sq_km").crossJoin(F.broadcast(sectors.select("sector").distinct()))
    press = grid.join(by, ["ward_id", "sector"], "left").withColumn("complaints", F.coalesce("n", F.lit(0)) / F.greatest(F.lit(0.1), F.col("area_sq_km")))
    press = min_max_normalise(press, ["complaints"]).select("ward_id", "sector", "complaints_n")
    people = min_max_normalise(regions.select("ward_id", "population"), ["population"]).select("ward_id", "population_n")
    grow = min_max_normalise(growth.select("ward_id", "growth_raw"), ["growth_raw"]).select("ward_id", "growth_raw_n")
    pick = lambda table, c: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    severity = pick(K.SEVERITY_SCORE, "severity") * F.least(F.lit(1.0), 0.5 + F.col("deficit_percentage") / 100) * pick(K.CONFIDENCE, "data_confidence")
    w = K.RECOMMENDATION_WEIGHTS
    j = gaps.where(F.col("severity").isin("CRITICAL", "HIGH")).join(press, ["ward_id", "sector"]).join(people, "ward_id").join(grow, "ward_id")
    score = F.round(100 * (w["severity"] * severity + w["population"] * F.col("population_n") + w["complaints"] * F.col("complaints_n") + w["growth"] * F.col("growth_raw_n")), 2)
    out = j.withColumn("score", score)
    return out.select("ward_id", "sector", "severity", "deficit_amount", "score", F.when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW").alias("priority_level"))


# Unit cost of closing a unit of each sector's gap.
SECTOR_COST = {"Water Supply": "water_mld", "Waste Management": "waste_tpd", "Drainage & Storm Water": "drain_m3s", "Healthcare Capacity": "health", "Education": "school", "Public Transit Access": "bus_stop", "Open Space": "open_space_ha"}
COUNTED = ("Healthcare Capacity", "Education", "Public Transit Access")


def intervention_cost_text(recs: DataFrame) -> DataFrame:
    """recs with quantity, cost and a title; whole units where facilities are counted, a tenth of missing open space."""
    q, s = F.col("deficit_amount"), F.col("sector")
    amount = F.when(s.isin(*COUNTED), F.round(q, 0)).when(s == "Open Space", F.round(q * 0.1, 1)).otherwise(q)
    unit = F.create_map(*[F.lit(x) for k, v in SECTOR_COST.items() for x in (k, K.UNIT_COST[v])])[s]
    title = F.format_string("%s: add %s", s, F.format_number("quantity", 1))
    return recs.withColumn("quantity", amount).withColumns({"cost": F.round(unit * F.col("quantity"), 2), "title": title})


def transport_indicators(inputs: DataFrame, road_km: Column) -> DataFrame:
    """Estimated ridership and congestion, and road density."""
    access = F.least(F.lit(1.25), 0.8 + 0.05 * (F.col("n_rail_station") + F.col("n_metro_station")) + 0.002 * F.col("n_bus_stop"))
    per_1000 = road_km / F.greatest(F.lit(1.0), F.col("population") / 1000)
    density = F.col("population") / F.col("area_sq_km")
    congestion = F.least(F.lit(3.0), F.greatest(F.lit(1.1), 1.0 + 1.6 * (density / 60000) + 0.6 / F.greatest(F.lit(0.15), per_1000) * 0.1))
    return inputs.select("ward_id", F.floor(F.col("population") * 1.35 * 0.52 * access).alias("ridership"), F.round(congestion, 3).alias("congestion"), F.round(road_km / F.col("area_sq_km"), 2).alias("road_density"), "n_bus_stop")


def infrastructure_demand(inputs: DataFrame, year: int) -> DataFrame:
    """Requirements of a projected population against what exists."""
    p = inputs.withColumn("projected", project_population(F.col("population"), year))
    need = lambda per: F.ceil(F.col("projected") / per)
    more = lambda a, b: F.greatest(F.lit(0.0), a - b)
    water = F.round(F.col("projected") * K.WATER_LPCD / 1e6, 2)
    return p.select(
        "ward_id", "population", "projected", water.alias("water_required"), need(K.PERSONS_PER_HEALTH).alias("health_required"), need(K.PERSONS_PER_SCHOOL).alias("schools_required"),
        F.round(more(water, F.round(F.coalesce("water_mld", F.lit(0.0)), 2)), 2).alias("additional_water"),
        F.greatest(F.lit(0), need(K.PERSONS_PER_HEALTH) - F.col("n_healthcare")).alias("additional_health"), F.greatest(F.lit(0), need(K.PERSONS_PER_SCHOOL) - F.col("n_education_school")).alias("additional_schools"),
    )


def demographic_profile(demographics: DataFrame, land: DataFrame) -> DataFrame:
    """Shares and household size beside the land-use mix."""
    d = demographics.select("ward_id", F.round(100 * F.col("females") / F.col("population"), 2).alias("female_pct"), F.round(F.col("population") / F.greatest(F.lit(1), F.col("households")), 2).alias("household_size"))
    return d.join(land.select("ward_id", F.struct("residential_pct", "forest_green_pct", "waterbody_pct").alias("land_use")), "ward_id", "left")


def current_estimate(census: DataFrame, area: DataFrame, year: int, scaled: list[str]) -> DataFrame:
    """Census rows and rows scaled to ``year``, tagged CENSUS and ESTIMATED."""
    now = census.withColumn("__now", project_population(F.col("population"), year)).withColumn("__f", F.col("__now") / F.col("population"))
    now = now.withColumns({c: F.floor(F.col(c) * F.col("__f")).cast(census.schema[c].dataType) for c in scaled} | {"population": F.col("__now"), "census_year": F.lit(year), "provenance": F.lit("ESTIMATED")}).drop("__now", "__f")
    both = census.withColumn("provenance", F.lit("CENSUS")).unionByName(now)
    return both.join(area.select("ward_id", "area_sq_km"), "ward_id").withColumn("density", F.round(F.col("population") / F.col("area_sq_km"), 1)).drop("area_sq_km")


def worst_first(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), "ward_id").limit(n)


