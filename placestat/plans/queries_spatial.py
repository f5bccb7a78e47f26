"""Queries of spatial joins and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from placestat.operators import filters as P
from placestat.operators import joins as J
from placestat.operators import ranking as R
from placestat.operators import spatial as S
from placestat.plans.registry import query

INSIDE = "r.lat > w.south AND r.lat < w.south + 0.09e0 AND r.lng > w.west AND r.lng < w.west + 0.06e0"


def shapes(t, gap: float = 0.0):
    return t.wards.select("ward_id", S.rectangle(F.col("south") + gap, F.col("west"), 0.09 - 2 * gap, 0.06).alias("rings"))


@query("join5_points_in_regions", f"SELECT r.request_id, min(w.ward_id) AS ward_id FROM requests r JOIN wards w ON {INSIDE} GROUP BY 1", "requests wards")
def _(t):
    return S.points_in_regions(t.requests.drop("ward_id"), shapes(t), "request_id")


NEAR = "SELECT r.request_id, w.ward_id, sqrt(pow(greatest(w.south + 0.02e0 - r.lat, 0, r.lat - (w.south + 0.07e0)), 2) + pow(greatest(w.west - r.lng, 0, r.lng - (w.west + 0.06e0)), 2)) * 111.0 AS km FROM requests r CROSS JOIN wards w WHERE r.lat IS NOT NULL"


@query(
    "join6_snap_to_region",
    "SELECT request_id, ward_id, round(km, 6) AS km FROM near WHERE request_id NOT IN (SELECT request_id FROM near WHERE km < 1e-9) AND km <= 1 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(km, 9), ward_id) = 1",
    "requests wards",
    f"near AS ({NEAR})",
)
def _(t):
    r, g = t.requests.drop("ward_id"), shapes(t, 0.02)
    rest = r.join(S.points_in_regions(r, g, "request_id"), "request_id", "left_anti")
    on_edge = S.snap_to_region(rest, g, "request_id").where("km >= 1e-9")
    return on_edge.withColumn("km", F.round("km", 6))


@query(
    "join7_assign_region",
    f"SELECT r.request_id, coalesce(r.ward_id, l.ward_id, CASE WHEN r.request_id % 3 = 0 THEN 7 END) AS ward_id FROM requests r LEFT JOIN (SELECT r.request_id, min(w.ward_id) AS ward_id FROM requests r JOIN wards w ON {INSIDE} GROUP BY 1) l ON l.request_id = r.request_id",
    "requests wards",
)
def _(t):
    r = t.requests
    loc = S.points_in_regions(r.drop("ward_id"), shapes(t), "request_id").withColumnRenamed("ward_id", "located")
    j = r.select("request_id", F.col("ward_id").alias("given")).join(loc, "request_id", "left")
    return J.assign_region(j, F.col("given"), F.col("located"), F.when(F.col("request_id") % 3 == 0, 7)).select("request_id", "ward_id")


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
PAIRS = f"nb AS MATERIALIZED (SELECT a.request_id AS a, b.request_id AS b FROM requests a JOIN requests b ON a.category = b.category AND abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001 WHERE {KM} <= 0.06)"
CORE = "core AS MATERIALIZED (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= 6)"
REACH = "reach AS (SELECT id AS s, id AS x FROM core UNION SELECT r.s, e.b FROM reach r JOIN nb e ON e.a = r.x JOIN core c ON c.id = e.b)"
LABEL = "label AS MATERIALIZED (SELECT x AS id, min(s) AS cluster FROM reach GROUP BY 1)"
CLUSTERS = f"{PAIRS}, {CORE}, {REACH}, {LABEL}, clusters AS MATERIALIZED (SELECT id AS request_id, cluster, true AS is_core FROM label UNION ALL SELECT a, min_by(l.cluster, nb.b), false FROM nb JOIN label l ON l.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY a UNION ALL SELECT DISTINCT a, NULL::BIGINT, false FROM nb WHERE a NOT IN (SELECT id FROM core) AND a NOT IN (SELECT n.a FROM nb n JOIN core c ON c.id = n.b))"


def recursive(sql: str, fixtures: str, more: str) -> str:
    from placestat.sources.fixtures import ctes

    return f"WITH RECURSIVE {ctes(fixtures)}, {more} {sql}"


@query("geo1_eps_neighbours", "SELECT a, count(*) AS n FROM nb GROUP BY 1", "requests", PAIRS)
def _(t):
    return S.eps_neighbour_counts(t.requests, 0.06, group="category")


@query("geo2_dbscan", recursive("SELECT * FROM clusters", "requests", CLUSTERS))
def _(t):
    return S.dbscan(t.requests, 0.06, 6, group="category")


SUMMARY = """, m AS (SELECT c.cluster, r.* FROM clusters c JOIN requests r USING (request_id) WHERE c.cluster IS NOT NULL),
ce AS (SELECT cluster, avg(lat) AS clat, avg(lng) AS clng, count(*) AS n, count(DISTINCT ward_id) AS regions FROM m GROUP BY 1),
ra AS (SELECT m.cluster, greatest(0.1, max(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))))) AS radius_km FROM m JOIN ce USING (cluster) GROUP BY 1),
dm AS (SELECT cluster, category AS dominant FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category) = 1),
br AS (SELECT cluster, string_agg(category || ':' || k, ',' ORDER BY k DESC, category) AS breakdown FROM (SELECT cluster, category, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "geo3_hotspot_summary",
    recursive("SELECT cluster, n, regions, round(clat, 9) AS clat, round(clng, 9) AS clng, round(radius_km, 4) AS radius_km, round(n / greatest(0.1, 3.14159 * radius_km * radius_km), 3) AS density, CASE WHEN n >= 15 OR round(n / greatest(0.1, 3.14159 * radius_km * radius_km), 2) > 40 THEN 'HIGH' WHEN n >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(greatest(250, radius_km * 1000), 1) AS radius_m, breakdown, dominant FROM ce JOIN ra USING (cluster) JOIN dm USING (cluster) JOIN br USING (cluster)", "requests", CLUSTERS + SUMMARY),
)
def _(t):
    s = S.hotspot_summary(t.requests, S.dbscan(t.requests, 0.06, 6, group="category"))
    return s.select("cluster", "n", "regions", *[F.round(c, d).alias(c) for c, d in (("clat", 9), ("clng", 9), ("radius_km", 4), ("density", 3), ("radius_m", 1))], "severity", F.array_join(F.transform("breakdown", lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"))), ",").alias("breakdown"), "dominant")


@query(
    "geo4_assign_cluster_ids",
    recursive(
        "SELECT request_id, CAST((SELECT count(DISTINCT x.category) FROM requests x WHERE x.category < y.category) * 1000 + k AS BIGINT) AS cluster_id FROM (SELECT *, dense_rank() OVER (PARTITION BY category ORDER BY cluster) AS k FROM (SELECT r.request_id, r.category, c.cluster FROM clusters c JOIN requests r USING (request_id) WHERE c.cluster IS NOT NULL)) y",
        "requests", CLUSTERS,
    ),
)
def _(t):
    return S.cluster_numbers(S.dbscan(t.requests, 0.06, 6, group="category"), t.requests).select("request_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query(
    "geo5_hotspot_query",
    recursive("SELECT cluster, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY 1", "requests",
              CLUSTERS.replace("FROM requests a JOIN requests b ON a.category = b.category", "FROM (SELECT * FROM requests WHERE category = 'click' AND created_at >= timestamp '2024-01-01') a JOIN (SELECT * FROM requests WHERE category = 'click' AND created_at >= timestamp '2024-01-01') b ON true")),
)
def _(t):
    r = P.lookback_months(t.requests.where("category = 'click'"), "created_at", F.lit("2024-01-31").cast("date"), 0)
    return S.dbscan(r, 0.06, 6).where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))


@query(
    "geo6_locate_facilities",
    f"SELECT asset_id, ward_id FROM (SELECT r.asset_id, min(w.ward_id) AS ward_id FROM (SELECT s_suppkey AS asset_id, 18.86 + 0.0113 * (s_suppkey % 39) AS lat, 72.76 + 0.0071 * (s_suppkey % 41) AS lng FROM supplier WHERE s_suppkey % 4 < 2) r JOIN wards w ON {INSIDE} GROUP BY 1)",
    "wards",
)
def _(t):
    k = F.col("s_suppkey")
    tags = F.map_filter(F.create_map(F.lit("amenity"), F.when(k % 4 == 0, "hospital").when(k % 4 == 1, "school")), lambda a, b: b.isNotNull())
    a = t.supplier.select(k.alias("asset_id"), (18.86 + 0.0113 * (k % 39)).alias("lat"), (72.76 + 0.0071 * (k % 41)).alias("lng"), P.classify_facility(tags).alias("kind")).where("kind IS NOT NULL")
    return S.points_in_regions(R.dedupe_by(a, "asset_id", [F.asc("lat")]), shapes(t), "asset_id")


@query(
    "geo7_locate_places",
    f"SELECT p.place_id, p.name, l.ward_id FROM (SELECT p_name AS name, min(p_partkey) AS place_id FROM part WHERE length(p_name) >= 3 GROUP BY 1) p LEFT JOIN (SELECT r.place_id, min(w.ward_id) AS ward_id FROM (SELECT p_partkey AS place_id, 18.86 + 0.0113 * (p_partkey % 39) AS lat, 72.70 + 0.0171 * (p_partkey % 41) AS lng FROM part) r JOIN wards w ON {INSIDE} GROUP BY 1) l USING (place_id)",
    "wards",
)
def _(t):
    k = F.col("p_partkey")
    places = t.part.where(F.col("p_name").rlike(r"^[\x20-\x7E]{3,}$")).select(k.alias("place_id"), F.col("p_name").alias("name"), (18.86 + 0.0113 * (k % 39)).alias("lat"), (72.70 + 0.0171 * (k % 41)).alias("lng"))
    places = R.dedupe_by(places, "name", [F.asc("place_id")])
    return places.join(S.points_in_regions(places, shapes(t), "place_id"), "place_id", "left").select("place_id", "name", "ward_id")
