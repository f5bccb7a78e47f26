"""Tables of what-if scenarios: every scenario on every scope as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placestat.functions import constants as K
from placestat.functions.scalars import clip01

LEVERS = ("transit_pct", "new_bus_stops", "drainage_pct", "population_pct", "rezoning_pct", "water_mld", "waste_pct", "new_health", "new_schools", "green_pct")
# Elasticities of indicators to levers, and the weights of the adequacy criteria.
RIDERSHIP, CONGESTION, STOPS, FLOOD_DRAINAGE, FLOOD_GREEN, CONGESTION_POP = 0.65, 0.32, 0.30, 0.60, 0.015, 0.5
CRITERIA = {"water": 0.15, "waste": 0.10, "health": 0.12, "education": 0.10, "drainage": 0.15, "mobility": 0.13, "flood_safety": 0.15, "open_space": 0.10}
INDICATORS = (
    "population", "ridership", "congestion", "bus_stops", "flood_risk", "flood_complaints", "drain_required", "drain_capacity", "water_required", "water_supplied",
    "waste_generated", "waste_processed", "health", "schools", "green_share", "open_space",
)


def scenario_baseline(inputs: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row a scope of its indicators. ``scopes`` has (scope, ward_id); a region may be in several."""
    pop, area = F.col("population"), F.col("area_sq_km")
    weighted = lambda c: F.coalesce(F.sum(F.col(c) * pop) / F.sum(F.when(F.col(c).isNotNull(), pop)), F.lit(0.0))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = scopes.join(inputs, "ward_id").groupBy("scope").agg(
        F.sum(pop).alias("population"), F.round(F.sum(area), 2).alias("area_sq_km"), add("ridership").alias("ridership"), F.round(weighted("congestion"), 3).alias("congestion"),
        add("n_bus_stop").alias("bus_stops"), F.round(weighted("flood_risk"), 3).alias("flood_risk"), F.round(add("flood_12m") / 12, 1).alias("flood_complaints"),
        F.round(add("drain_required"), 2).alias("drain_required"), F.round(add("drain_capacity"), 2).alias("drain_capacity"), F.round(F.coalesce(F.avg("runoff"), F.lit(0.7)), 3).alias("runoff"),
        F.round(F.sum(pop) * K.WATER_LPCD / 1e6, 2).alias("water_required"), F.round(add("water_mld"), 2).alias("water_supplied"), F.round(F.sum(pop) * K.WASTE_KG / 1000, 2).alias("waste_generated"),
        F.round(add("waste_tpd"), 2).alias("waste_processed"), add("n_healthcare").alias("health"), add("n_education_school").alias("schools"),
        (add("green_sq_km") * 1.0).alias("green_sq_km"),
    )
    return g.withColumns({
        "green_share": F.round(100 * F.col("green_sq_km") / F.greatest(F.lit(0.01), F.col("area_sq_km")), 2),
        "open_space": F.round(F.col("green_sq_km") * 1e6 / F.greatest(F.lit(1), F.col("population")), 2),
    })


def apply_levers(baseline: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each scenario on each scope: s_<indicator> after the levers, and the capital cost. Levers that are null are 0."""
    j = baseline.crossJoin(F.broadcast(scenarios.select("scenario", *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(f"l_{x}") for x in LEVERS])))
    lever, b = (lambda n: F.col(f"l_{n}")), F.col
    grown = (1 + lever("population_pct") / 100) * (1 + lever("rezoning_pct") / 100)
    j = j.withColumns({"__grown": grown, "__ratio": lever("new_bus_stops") / F.greatest(F.lit(1.0), b("bus_stops")), "__cap": lever("transit_pct") / 100, "__gap": F.greatest(F.lit(0.0), b("drain_required") - b("drain_capacity"))})
    excess = (b("congestion") - 1) * (1 - CONGESTION * b("__cap") - 0.5 * CONGESTION * b("__ratio")) * F.pow("__grown", F.lit(CONGESTION_POP))
    added = b("__gap") * lever("drainage_pct") / 100
    closed = F.when(b("__gap") > 0, added / b("__gap")).otherwise(0.0)
    green = lever("green_pct")
    pervious = (K.RUNOFF["built"] - K.RUNOFF["green"]) * green / 100 / F.greatest(F.lit(0.3), b("runoff"))
    j = j.withColumns({
        "__added": added, "s_population": F.round(b("population") * b("__grown"), 0),
        "s_ridership": F.round(b("ridership") * (1 + RIDERSHIP * b("__cap")) * (1 + STOPS * b("__ratio")) * b("__grown"), 0),
        "s_congestion": F.round(F.greatest(F.lit(1.0), F.least(F.lit(3.0), 1 + excess)), 3), "s_bus_stops": b("bus_stops") + lever("new_bus_stops"),
        "s_drain_capacity": F.round(b("drain_capacity") + added, 2), "s_drain_required": F.round(b("drain_required") * (1 - pervious), 2),
        "s_green_share": F.round(F.least(F.lit(100.0), b("green_share") + green), 2),
        "s_flood_risk": F.round(F.greatest(F.lit(0.02), b("flood_risk") * (1 - FLOOD_DRAINAGE * closed) * (1 - FLOOD_GREEN * green)), 3),
        "s_water_supplied": F.round(b("water_supplied") + lever("water_mld"), 2), "s_waste_processed": F.round(b("waste_processed") * (1 + lever("waste_pct") / 100), 2),
        "s_health": b("health") + lever("new_health"), "s_schools": b("schools") + lever("new_schools"),
    })
    j = j.withColumns({
        "s_flood_complaints": F.round(b("flood_complaints") * b("s_flood_risk") / F.greatest(F.lit(0.01), b("flood_risk")) * b("__grown"), 1),
        "s_water_required": F.round(b("s_population") * K.WATER_LPCD / 1e6, 2), "s_waste_generated": F.round(b("s_population") * K.WASTE_KG / 1000, 2),
        "s_open_space": F.round(b("s_green_share") / 100 * b("area_sq_km") * 1e6 / F.greatest(F.lit(1.0), b("s_population")), 2),
    })
    c = K.UNIT_COST
    cost = (
        c["transit_pct"] * F.greatest(F.lit(0.0), lever("transit_pct")) * (b("population") / 12.4e6) + c["bus_stop"] * lever("new_bus_stops") + c["drain_m3s"] * b("__added")
        + c["open_space_ha"] * green / 100 * b("area_sq_km") * 100 + c["water_mld"] * lever("water_mld") + c["waste_tpd"] * (b("s_waste_processed") - b("waste_processed"))
        + c["health"] * lever("new_health") + c["school"] * lever("new_schools")
    )
    return j.withColumn("cost", cost).drop("__grown", "__ratio", "__cap", "__gap", "__added")


def adequacy_score(prefix: str = "") -> Column:
    """0 to 100 from eight clipped criteria of the indicator columns with ``prefix``."""
    c = lambda n: F.col(f"{prefix}{n}")
    over = lambda a, b: clip01(c(a) / F.greatest(F.lit(0.01), c(b)))
    people = F.greatest(F.lit(1.0), c("population"))
    parts = {
        "water": over("water_supplied", "water_required"), "waste": over("waste_processed", "waste_generated"), "health": clip01(c("health") * K.PERSONS_PER_HEALTH / people),
        "education": clip01(c("schools") * K.PERSONS_PER_SCHOOL / people), "drainage": over("drain_capacity", "drain_required"), "mobility": clip01((3 - c("congestion")) / 2),
        "flood_safety": clip01(1 - c("flood_risk")), "open_space": clip01(c("open_space") / K.OPEN_SPACE_SQM),
    }
    return F.round(100 * sum((w * parts[k] for k, w in CRITERIA.items()), F.lit(0.0)), 2)


def scored(simulated: DataFrame) -> DataFrame:
    """Scores before and after, their difference, and the gain for 100 of cost (null where free)."""
    s = simulated.withColumns({"base_score": adequacy_score(), "score": adequacy_score("s_")}).withColumn("score_change", F.round(F.col("score") - F.col("base_score"), 2))
    return s.withColumn("gain_per_100", F.when(F.col("cost") > 0, F.round((F.col("score") - F.col("base_score")) / (F.col("cost") / 100), 3)))


def scenario_deltas(simulated: DataFrame) -> DataFrame:
    """(scope, scenario, indicator, delta) of what changed."""
    pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.round(F.col(f"s_{i}") - F.col(i), 3).alias("delta")) for i in INDICATORS])
    return simulated.select("scope", "scenario", F.explode(pairs).alias("d")).select("scope", "scenario", "d.*").where("delta <> 0")


#: What is compared besides ``INDICATORS``: made from them, before and after.
DERIVED = ("water_gap", "uncollected_waste", "residents_per_health", "residents_per_school")


def derived(prefix: str = "") -> dict[str, Column]:
    """Water short of demand, percent of waste not processed, and residents per facility and per school."""
    c = lambda n: F.col(f"{prefix}{n}")
    return {
        "water_gap": F.round(F.greatest(F.lit(0.0), c("water_required") - c("water_supplied")), 2),
        "uncollected_waste": F.round(F.greatest(F.lit(0.0), 100 * (1 - c("waste_processed") / F.greatest(F.lit(0.01), c("waste_generated")))), 1),
        "residents_per_health": F.round(c("population") / F.greatest(F.lit(1.0), c("health")), 0), "residents_per_school": F.round(c("population") / F.greatest(F.lit(1.0), c("schools")), 0),
    }


def compare_scenarios(simulated: DataFrame, names: list[str]) -> DataFrame:
    """One row a scope and indicator (``INDICATORS`` and ``DERIVED``), one column a scenario."""
    before, after = ({i: F.col(f"{p}{i}") for i in INDICATORS} | derived(p) for p in ("", "s_"))
    values = F.array(*[F.struct(F.lit(i).alias("indicator"), before[i].cast("double").alias("baseline"), after[i].cast("double").alias("value")) for i in before])
    long = simulated.select("scope", "scenario", F.explode(values).alias("v")).select("scope", "scenario", "v.*")
    return long.groupBy("scope", "indicator", "baseline").pivot("scenario", names).agg(F.first("value"))


def rank_scenarios(scored: DataFrame) -> DataFrame:
    """(scope, scenario, score, score_change, capital_cost, gain_per_100, rank, most_effective) by score, ties by name.

    The most effective scenario of a scope gains most for its cost; free ones come last.
    """
    by = Window.partitionBy("scope")
    best = by.orderBy(F.desc(F.coalesce("gain_per_100", F.lit(-1.0))), F.desc("score"), "scenario")
    return scored.select(
        "scope", "scenario", "score", "score_change", F.round("cost", 1).alias("capital_cost"), "gain_per_100",
        F.row_number().over(by.orderBy(F.desc("score"), "scenario")).alias("rank"), (F.row_number().over(best) == 1).alias("most_effective"),
    )


def assumption_list(scenarios: DataFrame, parameters: str = "parameters") -> DataFrame:
    """scenario, the groups of levers used and the levers of the map that are not known."""
    p = F.col(parameters)
    used = lambda *names: F.exists(F.map_entries(p), lambda e: e["key"].isin(*names) & (e["value"] != 0))
    groups = {"population": ("population_pct", "rezoning_pct"), "transit": ("transit_pct", "new_bus_stops"), "drainage": ("drainage_pct",), "green": ("green_pct",)}
    listed = F.filter(F.array(*[F.when(used(*names), g) for g, names in groups.items()]), lambda x: x.isNotNull())
    return scenarios.select("scenario", F.array_distinct(listed).alias("used"), F.array_sort(F.filter(F.map_keys(p), lambda k: ~k.isin(*LEVERS))).alias("unknown"))
