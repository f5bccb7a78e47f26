"""Queries of filters, joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from placestat.functions import scalars as S
from placestat.operators import aggregates as A
from placestat.operators import filters as P
from placestat.operators import joins as J
from placestat.operators import ranking as R
from placestat.plans.registry import query



def now():
    return F.lit("2001-08-01").cast("date")


@query("prj1_filter_requests", "SELECT request_id, ward_id, category, status FROM requests WHERE ward_id = 3 AND status = 'OPEN' AND contains(lower(category), 'cl')", "requests")
def _(t):
    return P.filter_requests(t.requests, q="CL", text_col="category", ward_id=3, status="OPEN").select("request_id", "ward_id", "category", "status")


@query("prj2_contains_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widg')")
def _(t):
    return t.part.where(S.contains_ci(F.col("p_name"), "WIDG")).select("p_partkey", "p_name")


@query("prj3_lookback_months", "SELECT request_id FROM cases WHERE created_at >= timestamp '2001-02-01'", "cases")
def _(t):
    return P.lookback_months(t.cases, "created_at", now(), 6).select("request_id")


@query("prj4_in_bbox", "SELECT request_id, coalesce(lat BETWEEN 18.9 AND 19.1 AND lng BETWEEN 72.8 AND 72.95, false) AS inside FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.in_bbox(F.col("lat"), F.col("lng"), (18.9, 72.8, 19.1, 72.95)).alias("inside"))


@query("prj5_request_points", "SELECT request_id, lat, lng, category, status, strftime(created_at, '%Y-%m-%d') AS day FROM requests WHERE lat IS NOT NULL AND lng IS NOT NULL", "requests")
def _(t):
    return P.request_points(t.requests)


SAFE = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(value AS VARCHAR) END AS lat, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'odd' END AS status, CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN '' ELSE '2024-01-0' || CAST(1 + event_id % 9 AS VARCHAR) || ' 10:00:00' END AS created_at FROM events"


@query(
    "prj6_safe_parse",
    "SELECT event_id, try_cast(nullif(trim(lat), '') AS DOUBLE) AS lat, CASE WHEN upper(status) IN ('OPEN','IN_PROGRESS','RESOLVED','CLOSED') THEN upper(status) ELSE 'OPEN' END AS status, coalesce(try_cast(nullif(created_at, '') AS TIMESTAMP), timestamp '2024-02-01') AS created_at FROM raw",
    more=f"raw AS ({SAFE})",
)
def _(t):
    e, i = t.events, F.col("event_id")
    raw = e.select(
        "event_id",
        F.when(i % 4 == 0, "").when(i % 4 == 1, "x").otherwise(F.col("value").cast("string")).alias("lat"),
        F.lit("").alias("lng"),
        F.when(i % 3 == 0, "open").when(i % 3 == 1, "resolved").otherwise("odd").alias("status"),
        F.when(i % 5 == 0, "bad").when(i % 5 == 1, "").otherwise(F.concat(F.lit("2024-01-0"), (1 + i % 9).cast("string"), F.lit(" 10:00:00"))).alias("created_at"),
    )
    return P.safe_parse(raw, F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id", "lat", "status", "created_at")


TAGS = {
    "amenity": "CASE p_partkey % 24 WHEN 0 THEN 'hospital' WHEN 1 THEN 'doctors' WHEN 2 THEN 'school' WHEN 3 THEN 'university' WHEN 4 THEN 'library' WHEN 5 THEN 'fire_station' WHEN 6 THEN 'police' WHEN 7 THEN 'recycling' WHEN 8 THEN 'toilets' WHEN 9 THEN 'kindergarten' END",
    "leisure": "CASE p_partkey % 5 WHEN 3 THEN 'park' WHEN 2 THEN 'garden' WHEN 1 THEN 'sports_centre' END",
    "railway": "CASE WHEN p_partkey % 24 IN (12, 13, 14) THEN 'station' WHEN p_partkey % 24 = 15 THEN 'halt' END",
    "station": "CASE p_partkey % 24 WHEN 13 THEN 'monorail' WHEN 16 THEN 'subway' END",
    "subway": "CASE WHEN p_partkey % 24 = 17 THEN 'yes' END",
    "highway": "CASE WHEN p_partkey % 24 = 18 THEN 'bus_stop' END",
    "man_made": "CASE p_partkey % 24 WHEN 19 THEN 'water_works' WHEN 20 THEN 'wastewater_plant' WHEN 21 THEN 'mast' END",
}


def tagged(t):
    tags = F.map_filter(F.create_map(*[x for k, e in TAGS.items() for x in (F.lit(k), F.expr(e))]), lambda k, v: v.isNotNull())
    return t.part.select("p_partkey", "p_name", tags.alias("tags"))


@query(
    "prj7_classify_facility",
    f"""SELECT p_partkey, CASE WHEN amenity IN ('hospital', 'doctors') THEN 'HEALTHCARE' WHEN amenity IN ('school', 'university', 'library') THEN 'EDUCATION' WHEN amenity = 'fire_station' THEN 'EMERGENCY'
 WHEN amenity = 'police' THEN 'PUBLIC_SAFETY' WHEN amenity = 'recycling' THEN 'WASTE_MANAGEMENT' WHEN amenity = 'toilets' THEN 'SANITATION' WHEN highway = 'bus_stop' THEN 'BUS_STOP'
 WHEN station = 'subway' OR subway = 'yes' OR (railway = 'station' AND station = 'monorail') THEN 'METRO_STATION' WHEN railway = 'station' THEN 'RAIL_STATION'
 WHEN man_made = 'water_works' THEN 'WATER_SUPPLY' WHEN man_made = 'wastewater_plant' THEN 'DRAINAGE' WHEN leisure IN ('park', 'sports_centre') THEN 'PARKS' END AS kind,
 CASE WHEN amenity = 'doctors' THEN 'clinic' WHEN amenity = 'toilets' THEN 'public_toilet' WHEN amenity <> 'kindergarten' THEN amenity WHEN highway = 'bus_stop' THEN highway WHEN station = 'subway' OR subway = 'yes' THEN 'metro'
 WHEN railway = 'station' THEN coalesce(station, 'suburban_rail') WHEN man_made <> 'mast' THEN man_made WHEN leisure <> 'garden' THEN leisure END AS subtype
 FROM (SELECT p_partkey, {', '.join(f'{e} AS {k}' for k, e in TAGS.items())} FROM part)""",
)
def _(t):
    kind = P.classify_facility(F.col("tags"))
    return tagged(t).select("p_partkey", kind["type"].alias("kind"), kind["subtype"].alias("subtype"))


@query("prj8_landuse_bucket", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'green' WHEN p_size % 4 = 1 THEN 'residential' WHEN p_size % 3 = 0 THEN 'water' END AS bucket FROM part")
def _(t):
    s = F.col("p_size")
    tags = F.map_filter(
        F.create_map(F.lit("landuse"), F.when(s % 4 == 0, "forest").when(s % 4 == 1, "residential"), F.lit("natural"), F.when(s % 3 == 0, "water")), lambda k, v: v.isNotNull()
    )
    return t.part.select("p_partkey", P.landuse_bucket(tags, {"forest": "green", "residential": "residential", "water": "water"}).alias("bucket"))


@query("prj9_severity_band", "SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 40 THEN 'CRITICAL' WHEN c_acctbal / 100 >= 20 THEN 'HIGH' WHEN c_acctbal / 100 >= 5 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.severity_band(F.col("c_acctbal") / 100).alias("severity"))


@query("prj10_normalize_region_code", "SELECT n_nationkey, chr(65 + n_nationkey) || CASE n_nationkey % 3 WHEN 0 THEN '/E' WHEN 1 THEN '/W' ELSE '' END AS code FROM nation")
def _(t):
    k = F.col("n_nationkey")
    raw = F.concat(F.lower(F.char(65 + k.cast("long"))), F.when(k % 3 == 0, "-East ward").when(k % 3 == 1, " West").otherwise(" Ward"))
    return t.nation.select("n_nationkey", S.normalize_region_code(raw).alias("code"))


@query("prj11_display_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Unnamed bus stop' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS beds FROM part")
def _(t):
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(k % 2 == 0, F.col("p_name"))), lambda a, b: b.isNotNull())
    beds = F.when(k % 3 > 0, F.col("p_size").cast("string")).otherwise("many")
    return t.part.select("p_partkey", P.display_name(tags, F.lit("bus_stop")).alias("name"), P.digits_only(beds).alias("beds"))


# joins


@query("join1_join_region", "SELECT r.request_id, r.ward_id, w.zone FROM requests r JOIN wards w ON r.ward_id = w.ward_id", "requests, wards".replace(",", ""))
def _(t):
    return J.join_region(t.requests, t.wards.select("ward_id", "zone")).select("request_id", "ward_id", "zone")


@query("join2_regions_with_counts", "SELECT w.ward_id, count(r.request_id) AS n FROM wards w LEFT JOIN requests r ON r.ward_id = w.ward_id AND r.value > 99 GROUP BY 1", "requests wards")
def _(t):
    return J.regions_with_counts(t.wards.select("ward_id"), t.requests.where("value > 99"))


@query(
    "join3_attach_dimensions",
    "SELECT w.ward_id, w.ward_code, l.forest_green_pct, e.pm25, n.n AS assets FROM wards w LEFT JOIN land l USING (ward_id) LEFT JOIN (SELECT ward_id, max_by(pm25, month) AS pm25 FROM environment GROUP BY 1) e USING (ward_id) LEFT JOIN (SELECT ward_id, count(*) AS n FROM assets GROUP BY 1) n USING (ward_id)",
    "wards land environment assets",
)
def _(t):
    pm = J.latest_value(t.environment, ["ward_id"], "pm25", "month").select("ward_id", "pm25")
    n = t.assets.groupBy("ward_id").agg(F.count("*").alias("assets"))
    return J.attach_dimensions(t.wards.select("ward_id", "ward_code"), t.land.select("ward_id", "forest_green_pct"), pm, n)


@query("join4_latest_value", "SELECT ward_id, metric, max_by(value, month) AS value, max(month) AS month FROM service GROUP BY 1, 2", "service")
def _(t):
    return J.latest_value(t.service, ["ward_id", "metric"], "value", "month")


@query("join8_map_codes", "SELECT c_custkey, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_nationkey < 20")
def _(t):
    mapping = t.nation.where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"), "n_name")
    return J.map_codes(t.customer, F.concat(F.lit(" "), F.col("c_nationkey").cast("string")), mapping).select("c_custkey", "n_name")


VOLUME = "SELECT ward_id, CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS value FROM cases WHERE ward_id IS NOT NULL GROUP BY 1, 2"


@query(
    "join9_zero_fill_panel",
    "SELECT w.ward_id, m.month, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT ward_id FROM wards) w CROSS JOIN (SELECT DISTINCT month FROM v) m LEFT JOIN v ON v.ward_id = w.ward_id AND v.month = m.month",
    "cases wards",
    f"v AS ({VOLUME} HAVING count(*) > 2)",
)
def _(t):
    return J.zero_fill_panel(A.monthly_volume(t.cases).where("value > 2"), t.wards)


@query(
    "join10_resolve_region",
    "SELECT s_suppkey, coalesce(a.n_nationkey, (SELECT min(n_nationkey) FROM nation x WHERE contains(x.n_name, upper(r.ref)))) AS ward_id FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE substr(n_name, 1, 2) END AS ref FROM supplier JOIN nation ON n_nationkey = s_nationkey) r LEFT JOIN nation a ON a.n_name = upper(r.ref)",
)
def _(t):
    refs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.substring("n_name", 1, 2)).alias("ref"))
    regions = t.nation.select(F.col("n_nationkey").alias("ward_id"), F.col("n_name").alias("ward_code"), F.col("n_name").alias("zone"))
    return J.resolve_region(refs, regions).select("s_suppkey", "ward_id")


@query(
    "join11_lookup_place",
    "SELECT s_suppkey, n_nationkey AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def _(t):
    gaz = t.nation.select(F.lower("n_name").alias("key"), "n_nationkey")
    ph = t.supplier.join(t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Near ").otherwise(""), F.col("n_name"), F.when(F.col("s_suppkey") % 2 == 0, " station").otherwise("")).alias("phrase")
    )
    found = J.lookup_place(ph.select("phrase").distinct(), gaz, ["station", "road"])
    return ph.join(found, "phrase").select("s_suppkey", F.col("place.n_nationkey").alias("place"))


@query(
    "join12_geocode_with_cache",
    "SELECT phrase, CASE WHEN k % 4 < 3 THEN 18.0 + k * 0.01 END AS lat, k % 4 = 3 AS miss FROM (SELECT n_name AS phrase, n_nationkey AS k FROM nation)",
)
def _(t):
    n = t.nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("k")).withColumns({"lat": 18.0 + F.col("k") * 0.01, "lng": F.lit(72.9)})
    out = J.geocode_with_cache(n.select(F.col("key").alias("phrase")), n.where("k % 4 < 2"), n.where("k % 4 = 2"))
    return out.select("phrase", "lat", "miss")


@query("join13_filter_scope", "SELECT request_id FROM requests WHERE ward_id IN (SELECT ward_id FROM wards WHERE zone = 'ASIA')", "requests wards")
def _(t):
    return J.filter_scope(t.requests, t.wards.where("zone = 'ASIA'")).select("request_id")


SIM = "SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS DOUBLE) AS s FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q CROSS JOIN embeddings v WHERE len(q.embedding) = len(v.embedding)"


@query("join14_dot_product_join", f"SELECT query_id, vec_id, round(s, 4) + 0.0 AS similarity FROM ({SIM})")
def _(t):
    e = t.embeddings
    return J.dot_product_join(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 4) + 0.0)


@query("join15_unresolved_references", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return J.unresolved_references(t.events, t.supplier.select(F.col("s_suppkey").alias("user_id")), "user_id").select("event_id")


# aggregates


@query("agg1_facility_counts", "SELECT ward_id, asset_type AS kind, count(*) AS n FROM assets GROUP BY 1, 2 UNION ALL SELECT ward_id, 'EDUCATION_SCHOOL', count(*) FROM assets WHERE asset_type = 'EDUCATION' AND subtype = 'school' GROUP BY 1", "assets")
def _(t):
    return A.facility_counts(t.assets)


@query("agg2_counts_by_category", "SELECT ward_id, category, count(*) AS n FROM requests WHERE ward_id IS NOT NULL GROUP BY 1, 2", "requests")
def _(t):
    return A.counts_by_category(t.requests)


@query("agg3_monthly_volume", VOLUME, "cases")
def _(t):
    return A.monthly_volume(t.cases)


@query("agg4_status_counts", "SELECT status, count(*) AS n FROM requests GROUP BY 1", "requests")
def _(t):
    return A.value_counts(t.requests, "status")


@query("agg4_category_counts", "SELECT category, count(*) AS n FROM requests GROUP BY 1", "requests")
def _(t):
    return A.value_counts(t.requests, "category")


@query("agg4_language_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return A.value_counts(t.documents, "lang")


@query("agg5_monthly_trend", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (status IN ('RESOLVED', 'CLOSED')) AS resolved FROM cases GROUP BY 1 ORDER BY 1 DESC LIMIT 24", "cases")
def _(t):
    return A.monthly_trend(t.cases)


@query("agg6_median_resolution_days", "SELECT round(median(resolution_days), 1) AS median_days FROM cases", "cases")
def _(t):
    return A.median_resolution_days(t.cases)


@query("agg7_distinct_months", "SELECT count(DISTINCT strftime(created_at, '%Y-%m')) AS months FROM cases", "cases")
def _(t):
    return A.distinct_months(t.cases)


@query("agg8_complaint_statistics", "SELECT strftime(created_at, '%Y-%m') AS key, count(*) AS n FROM cases WHERE status = 'OPEN' GROUP BY 1", "cases")
def _(t):
    return A.complaint_statistics(t.cases, "month", status="OPEN")


GROWTH2 = "SELECT *, CASE WHEN previous > 0 THEN round(100.0 * (recent - previous) / previous, 2) END AS growth_pct FROM (SELECT ward_id, count(*) FILTER (created_at >= date '2000-08-01') AS recent, count(*) FILTER (created_at < date '2000-08-01') AS previous FROM cases WHERE created_at >= date '1999-08-01' GROUP BY 1)"


@query("agg9_two_period_growth", GROWTH2, "cases")
def _(t):
    return A.two_period_growth(t.cases, now())


@query("agg10_weighted_mean", "SELECT round(sum(forest_green_pct * population) / sum(population), 4) AS mean FROM land JOIN wards USING (ward_id)", "land wards")
def _(t):
    return A.weighted_mean(t.land.join(t.wards, "ward_id"), "forest_green_pct", "population").select(F.round("mean", 4).alias("mean"))


GAPLIKE = "SELECT s_suppkey, s_nationkey AS ward_id, round(abs(s_acctbal) / 100, 1) AS deficit_percentage, CASE WHEN s_suppkey % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS data_confidence FROM supplier"


def gaplike(t):
    return t.supplier.selectExpr("s_suppkey", "s_nationkey AS ward_id", "round(abs(s_acctbal) / 100, 1) AS deficit_percentage", "CASE WHEN s_suppkey % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS data_confidence")


@query(
    "agg11_confidence_weighted_deficit",
    "SELECT ward_id, round(sum(deficit_percentage * w) / sum(w), 4) AS deficit FROM (SELECT *, CASE WHEN data_confidence = 'LOW' THEN 0.6e0 ELSE 1e0 END AS w FROM g) GROUP BY 1",
    more=f"g AS ({GAPLIKE})",
)
def _(t):
    return A.confidence_weighted_deficit(gaplike(t)).withColumn("deficit", F.round("deficit", 4))


@query("agg12_provenance_summary", "SELECT c_mktsegment AS tag, count(*) AS sources, round(avg(c_acctbal), 4) AS quality FROM customer GROUP BY ROLLUP (c_mktsegment)")
def _(t):
    return A.provenance_summary(t.customer.withColumnRenamed("c_mktsegment", "tag"), "tag", "c_acctbal")


@query(
    "agg13_census_rollup",
    "SELECT c_nationkey AS ward_id, sum(c_custkey) AS males, sum(c_custkey % 7) AS females, count(*) AS households, round(1000.0 * sum(c_custkey % 7) / greatest(1, sum(c_custkey)), 2) AS sex_ratio, round(1.0 * sum(c_custkey) / greatest(1, count(*)), 2) AS household_size FROM customer GROUP BY 1",
)
def _(t):
    d = t.customer.select(F.col("c_nationkey").alias("ward_id"), F.col("c_custkey").alias("males"), (F.col("c_custkey") % 7).alias("females"), F.lit(1).alias("households"))
    return A.rollup_with_ratios(d, "ward_id", ["males", "females", "households"], {"sex_ratio": ("females", "males", 1000.0), "household_size": ("males", "households", 1.0)})


@query("agg15_city_totals", "SELECT CAST(sum(population) AS BIGINT) AS population, round(sum(area_sq_km), 2) AS area_sq_km FROM wards", "wards")
def _(t):
    return A.totals(t.wards.select("ward_id", "population", "area_sq_km"))


@query(
    "agg16_environment_12m",
    "SELECT ward_id, round(avg(pm25), 4) AS pm25, round(sum(rainfall_mm), 2) AS rain FROM (SELECT *, row_number() OVER (PARTITION BY ward_id ORDER BY month DESC) AS n FROM environment) WHERE n <= 12 GROUP BY 1",
    "environment",
)
def _(t):
    last = R.first_rows(t.environment, ["ward_id"], [F.desc("month")], 12)
    return last.groupBy("ward_id").agg(F.round(F.avg("pm25"), 4).alias("pm25"), F.round(F.sum("rainfall_mm"), 2).alias("rain"))


@query("agg21_deficit_mean", "SELECT w.ward_id, round(coalesce(avg(g.deficit_percentage), 0), 4) AS deficit FROM wards w LEFT JOIN g ON g.ward_id = w.ward_id AND g.deficit_percentage > 50 GROUP BY 1", "wards", f"g AS ({GAPLIKE})")
def _(t):
    return A.deficit_mean(t.wards, gaplike(t).where("deficit_percentage > 50")).withColumn("deficit", F.round("deficit", 4))


@query("agg22_min_max_layer", "SELECT min(population) AS low, max(population) AS high FROM wards", "wards")
def _(t):
    return A.min_max_layer(t.wards, "population")


@query(
    "agg23_road_km_by_class",
    "SELECT n_nationkey AS ward_id, round(sum(q), 2) AS total_km, count(DISTINCT l_returnflag) AS classes, round(sum(q) FILTER (l_returnflag = 'A'), 2) AS a_km FROM (SELECT l_suppkey % 25 AS n_nationkey, l_returnflag, l_quantity AS q FROM lineitem) GROUP BY 1",
)
def _(t):
    roads = t.lineitem.select((F.col("l_suppkey") % 25).alias("ward_id"), F.col("l_returnflag").alias("road_class"), F.col("l_quantity").alias("km"))
    return A.road_km_by_class(roads).select("ward_id", F.round("total_km", 2).alias("total_km"), F.size("by_class").cast("long").alias("classes"), F.round(F.col("by_class")["A"], 2).alias("a_km"))


# windows, order, sets


@query("win1_latest_by_region", "SELECT ward_id, request_id FROM cases QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY created_at DESC, request_id DESC) = 1", "cases")
def _(t):
    return R.latest_by_region(t.cases, "created_at", "request_id").select("ward_id", "request_id")


@query(
    "win2_top_n_per_group",
    "SELECT tile, day, cloud FROM (SELECT l_suppkey AS tile, l_shipdate AS day, min(l_discount) AS cloud FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY tile ORDER BY cloud, day) <= 3",
)
def _(t):
    return R.top_scenes(t.lineitem.select(F.col("l_suppkey").alias("tile"), F.col("l_shipdate").alias("day"), F.col("l_discount").alias("cloud")), "tile", "day", "cloud")


W = "OVER (PARTITION BY ward_id, metric ORDER BY month"


@query("win3_lag_features", f"SELECT ward_id, metric, month, lag(value, 1) {W}) AS lag_1, lag(value, 2) {W}) AS lag_2, lag(value, 3) {W}) AS lag_3, coalesce(lag(value, 12) {W}), lag(value, 1) {W})) AS lag_12 FROM service", "service")
def _(t):
    return R.lag_features(t.service, ["ward_id", "metric"], "month", "value").drop("value")


@query("win4_rolling_mean_3", f"SELECT ward_id, metric, month, round(avg(value) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2) AS rolling_3 FROM service", "service")
def _(t):
    return R.rolling_mean(t.service, ["ward_id", "metric"], "month", "value").select("ward_id", "metric", "month", F.round("rolling_3", 2).alias("rolling_3"))


@query("win5_series_scale", "SELECT ward_id, metric, month, round(value / avg(value) OVER (PARTITION BY ward_id, metric), 6) AS scaled FROM service", "service")
def _(t):
    return R.series_scale(t.service, ["ward_id", "metric"], "value").select("ward_id", "metric", "month", F.round("scaled", 6).alias("scaled"))


@query("win6_ordinal_rank_fraction", "SELECT p_partkey, round((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) / (count(*) OVER () - 1), 8) AS rank_fraction FROM part")
def _(t):
    return R.ordinal_rank_fraction(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").select("p_partkey", F.round("rank_fraction", 8).alias("rank_fraction"))


@query("win7_min_max_normalise", "SELECT ward_id, round((population - min(population) OVER ()) / (max(population) OVER () - min(population) OVER ())::DOUBLE, 6) AS population_n FROM wards", "wards")
def _(t):
    return R.min_max_normalise(t.wards.select("ward_id", "population"), ["population"]).select("ward_id", F.round("population_n", 6).alias("population_n"))


@query("win8_first_per_key", "SELECT c_nationkey AS key, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END, c_custkey) = 1")
def _(t):
    road = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    return R.dedupe_by(t.customer.select(F.col("c_nationkey").alias("key"), "c_custkey", "c_mktsegment"), "key", [road.asc(), F.asc("c_custkey")]).select("key", "c_custkey")


@query("win9_dedupe_by_uid", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return R.dedupe_by(t.events, "user_id", [F.asc("event_id")]).select("user_id", "event_id")


@query("win10_first_last_epoch", "SELECT ward_id, min(year) AS first_year, max(year) AS last_year, min_by(built_up_sq_km, year) AS first_built_up_sq_km, max_by(built_up_sq_km, year) AS last_built_up_sq_km FROM satellite GROUP BY 1", "satellite")
def _(t):
    return R.first_last_epoch(t.satellite, "ward_id", "year", ["built_up_sq_km"])


@query("win11_trailing_mean", f"SELECT ward_id, metric, round(avg(value), 2) AS trailing_mean, count(*) AS points FROM (SELECT *, row_number() {W} DESC) AS n FROM service) WHERE n <= 12 GROUP BY 1, 2", "service")
def _(t):
    return R.trailing_mean(t.service, ["ward_id", "metric"], "month", "value").withColumn("trailing_mean", F.round("trailing_mean", 2))


@query("sort1_rank_regions", "SELECT ward_id, population FROM wards ORDER BY population DESC, ward_id LIMIT 5", "wards")
def _(t):
    return R.rank_regions(t.wards.select("ward_id", "population"), "population", 5)


@query("sort2_page", "SELECT request_id FROM cases ORDER BY created_at DESC, request_id DESC LIMIT 50 OFFSET 100", "cases")
def _(t):
    return R.page(t.cases.select("request_id", "created_at"), "created_at", "request_id", 50, 100).select("request_id")


@query("sort3_top_k_similar", f"SELECT query_id, vec_id FROM ({SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5")
def _(t):
    e = t.embeddings
    return R.top_k_similar(J.dot_product_join(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 5), 5).select("query_id", "vec_id")


@query("sort4_most_common", "SELECT ward_id, category, count(*) AS n FROM cases GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY count(*) DESC, category) <= 3", "cases")
def _(t):
    return R.most_common(t.cases, ["ward_id"], "category", 3)


@query("set1_union_sources", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return R.union_sources(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("set2_merge_counts", "SELECT category, count(*) AS n FROM (SELECT category FROM requests UNION ALL SELECT category FROM cases) GROUP BY 1", "requests cases")
def _(t):
    return R.merge_counts(A.value_counts(t.requests, "category"), A.value_counts(t.cases, "category"), "category")


@query("set3_missing_regions", "SELECT n_nationkey AS ward_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    return R.missing_keys(t.nation.select(F.col("n_nationkey").alias("ward_id")), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("ward_id")), "ward_id")


@query("set4_dedupe_ordered", "SELECT o_orderkey, array_to_string(list_distinct_ordered, ',') AS flags FROM (SELECT l_orderkey AS o_orderkey, list_transform(list_sort(list_transform(list_distinct(fs), lambda x: lpad(list_position(fs, x)::VARCHAR, 3, '0') || x)), lambda y: substr(y, 4)) AS list_distinct_ordered FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS fs FROM lineitem GROUP BY 1))")
def _(t):
    by = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return by.select("o_orderkey", F.array_join(F.array_distinct("x.l_returnflag"), ",").alias("flags"))


# scalar functions

HAV = "2 * {r} * asin(sqrt(least(1.0, pow(sin(radians(19.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.0)) * pow(sin(radians(72.9 - lng) / 2), 2))))"


@query("fn1_haversine_km", f"SELECT request_id, CASE WHEN lat IS NOT NULL THEN round({HAV.format(r='6371.0')}, 6) END AS km FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", F.round(S.haversine(F.col("lat"), F.col("lng"), F.lit(19.0), F.lit(72.9)), 6).alias("km"))


@query("fn2_haversine_mean_km", f"SELECT request_id, CASE WHEN lat IS NOT NULL THEN round({HAV.format(r='6371.0088')}, 6) END AS km FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", F.round(S.haversine(F.col("lat"), F.col("lng"), F.lit(19.0), F.lit(72.9), S.K.R_MEAN_KM), 6).alias("km"))


@query(
    "fn3_polyline_km",
    "SELECT user_id, round(coalesce(sum(CASE WHEN la IS NOT NULL THEN km END), 0), 4) AS km FROM (SELECT user_id, la, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - lo) / 2), 2)))) AS km FROM (SELECT e.user_id, r.lat, r.lng, lag(r.lat) OVER w AS la, lag(r.lng) OVER w AS lo FROM requests r JOIN events e ON e.event_id = r.request_id WHERE r.lat IS NOT NULL WINDOW w AS (PARTITION BY e.user_id ORDER BY e.event_id)) WHERE la IS NOT NULL OR lo IS NULL) GROUP BY 1",
    "requests",
)
def _(t):
    p = t.requests.where("lat IS NOT NULL").join(t.events.select("event_id", "user_id"), F.col("request_id") == F.col("event_id"))
    by = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("lng").alias("x"), F.col("lat").alias("y")))).alias("ps"))
    return by.select("user_id", F.round(S.polyline_km(F.col("ps")), 4).alias("km"))


@query(
    "fn4_polygon_area_km2",
    "SELECT ward_id, round(abs((x2s + x2s2) ) , 4) AS km2 FROM (SELECT ward_id, r * r * (radians(0.06) * radians(0.09)) * (cos(radians(south)) + cos(radians(south + 0.09))) / 2 AS x2s, 0.0 AS x2s2 FROM (SELECT *, 6371.0088 AS r FROM wards))",
    "wards",
)
def _(t):
    s, w = F.col("south"), F.col("west")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    # the west edge at x = 0: the projected quadrilateral is then a trapezium whose area SQL can give
    z = F.lit(0.0)
    ring = F.array(corner(z, s), corner(z + 0.06, s), corner(z + 0.06, s + 0.09), corner(z, s + 0.09), corner(z, s))
    return t.wards.select("ward_id", F.round(S.ring_area_km2(ring) + 0 * w, 4).alias("km2"))


@query("fn5_pct_change", "SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN round(100 * (c_acctbal - c_nationkey) / c_nationkey, 2) END AS change FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.pct_change(F.col("c_acctbal"), F.col("c_nationkey")).alias("change"))


@query("fn6_clip01", "SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000)) AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.clip01(F.col("c_acctbal") / 5000).alias("v"))


@query("fn7_month_arithmetic", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH AS DATE) AS later FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.month_start(F.col("o_orderdate")).alias("month"), F.add_months(S.month_start(F.col("o_orderdate")), 5).alias("later"))


@query(
    "fn8_season_features",
    "SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 1.0 ELSE 0.0 END AS monsoon, round(ln(1 + o_totalprice), 6) AS log_density FROM orders",
)
def _(t):
    f = S.season(F.col("o_orderdate"), F.lit(0), F.col("o_totalprice"))
    return t.orders.select("o_orderkey", *[(F.round(f[k], 6) + 0.0 if k != "monsoon" else f[k]).alias(k) for k in ("month_sin", "month_cos", "monsoon", "log_density")])


@query("fn9_project_population", f"SELECT c_custkey, CAST(round(c_custkey * 100 * pow({1 + S.K.ANNUAL_GROWTH!r}, 15)) AS BIGINT) AS population FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.project_population(F.col("c_custkey") * 100, 2026).alias("population"))


@query("fn10_normalised_difference", "SELECT scene_id, CASE WHEN nir + red <> 0 THEN round(greatest(-1.0, least(1.0, (nir - red) / (nir + red))), 6) END AS ndvi FROM pixels", "pixels")
def _(t):
    return t.pixels.select("scene_id", F.round(S.normalised_difference(F.col("nir"), F.col("red")), 6).alias("ndvi"))


@query("fn11_request_uid", "SELECT event_id, printf('CR-%d-%06d', year(ts), event_id) AS uid FROM events")
def _(t):
    return t.events.select("event_id", S.request_uid(F.col("ts"), F.col("event_id")).alias("uid"))


@query("fn12_label", "SELECT event_id, CASE WHEN event_type = '' THEN '' ELSE array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label, format('{:,}', event_id) AS number FROM events")
def _(t):
    return t.events.select("event_id", S.label(F.col("event_type")).alias("label"), F.format_number("event_id", 0).alias("number"))


@query(
    "fn13_cosine_similarity",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _(t):
    a, b = t.embeddings, t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("fn14_json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.no_such'), 'MEDIUM') AS confidence FROM events")
def _(t):
    return t.events.select("event_id", S.json_field(F.col("props"), "$.no_such", "MEDIUM").alias("confidence"))


@query("fn15_pixel_area", "SELECT ward_id, round(pow(6371.0088 * radians(0.001), 2) * cos(radians(south)), 8) AS km2 FROM wards", "wards")
def _(t):
    return t.wards.select("ward_id", F.round(S.pixel_area_km2(F.col("south"), 0.001), 8).alias("km2"))
