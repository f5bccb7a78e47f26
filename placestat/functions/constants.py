"""Planning norms, unit costs, bands, weights and thresholds."""

WATER_LPCD, WASTE_KG = 135, 0.45
PERSONS_PER_HEALTH, PERSONS_PER_SCHOOL = 15_000, 5_000
OPEN_SPACE_SQM, STOPS_PER_SQKM = 10.0, 4.0
RAIN_DESIGN_MM, RAIN_LEGACY_MM = 50.0, 25.0
RUNOFF = {"built": 0.90, "green": 0.25, "other": 0.60}
UNIT_COST = {"drain_m3s": 6.0, "water_mld": 1.2, "waste_tpd": 0.25, "health": 4.0, "school": 6.0, "bus_stop": 0.08, "open_space_ha": 3.0, "transit_pct": 45.0}
SEVERITY = [(40.0, "CRITICAL"), (20.0, "HIGH"), (5.0, "MODERATE")]
POPULATION_2001, POPULATION_2011 = 11_978_450, 12_442_373
ANNUAL_GROWTH = (POPULATION_2011 / POPULATION_2001) ** 0.1 - 1
BBOX = (18.85, 72.75, 19.30, 73.05)
R_KM, R_MEAN_KM = 6371.0, 6371.0088
NDVI_VEGETATION, NDWI_WATER, NDVI_BUILT_MAX = 0.30, 0.05, 0.20
INVALID_SCENE_CLASSES = [0, 1, 3, 8, 9, 10, 11]
PRIORITY_WEIGHTS = {"complaint_density": 0.25, "infrastructure_deficit": 0.25, "population_density": 0.20, "flood_exposure": 0.15, "demand_growth": 0.15}
RECOMMENDATION_WEIGHTS = {"severity": 0.35, "population": 0.25, "complaints": 0.20, "growth": 0.20}
SEVERITY_SCORE = {"CRITICAL": 1.0, "HIGH": 0.7, "MODERATE": 0.4, "LOW": 0.1}
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 1.0, "DEMO": 0.9, "LOW": 0.6}
# Hotspots are HIGH from so many points or beyond such a density a square km, MEDIUM from so many points.
HOTSPOT_HIGH_POINTS, HOTSPOT_HIGH_DENSITY, HOTSPOT_MEDIUM_POINTS = 15, 40.0, 6
