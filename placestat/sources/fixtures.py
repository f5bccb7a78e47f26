"""Projections of the driver's tables to the engine's inputs, the same text in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "wards": """SELECT CAST(n.n_nationkey AS INT) AS ward_id, n.n_name AS ward_code, r.r_name AS zone,
 count(c.c_custkey)*15000 AS population, CAST(12 + (n.n_nationkey % 7) * 5 AS DOUBLE) AS area_sq_km,
 CAST(n.n_nationkey % 10 AS DOUBLE) * 4e-2 AS low_lying_share,
 1.885e1 + 9e-2 * CAST(floor(n.n_nationkey / 5e0) AS INT) AS south, 7.275e1 + 6e-2 * (n.n_nationkey % 5) AS west
 FROM nation n JOIN region r ON n.n_regionkey=r.r_regionkey LEFT JOIN customer c ON c.c_nationkey=n.n_nationkey
 GROUP BY n.n_nationkey, n.n_name, r.r_name""",
    "requests": """SELECT event_id AS request_id, ts AS created_at, event_type AS category, value,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id % 25 AS INT) END AS ward_id,
 CASE WHEN event_id % 40 = 0 THEN NULL ELSE 1.887e1 + 1e-2 * (user_id % 40) + (event_id % 17 - 8) * 2e-4 END AS lat,
 CASE WHEN event_id % 40 = 0 THEN NULL ELSE 7.277e1 + 6.6e-3 * ((user_id * 7) % 40) + (event_id % 13 - 6) * 2e-4 END AS lng,
 CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'RESOLVED' ELSE 'CLOSED' END AS status,
 CASE WHEN event_id % 4 >= 2 THEN 1 + event_id % 30 END AS resolution_days FROM events""",
    "assets": """SELECT s_suppkey AS asset_id, s_name AS name, CAST(s_nationkey AS INT) AS ward_id,
 CASE s_suppkey % 5 WHEN 0 THEN 'HEALTHCARE' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'BUS_STOP' WHEN 3 THEN 'RAIL_STATION' ELSE 'PARKS' END AS asset_type,
 CASE WHEN s_suppkey % 5 = 1 AND s_suppkey % 10 = 1 THEN 'school' WHEN s_suppkey % 5 = 1 THEN 'college' END AS subtype FROM supplier""",
    "service": """SELECT CAST(c.c_nationkey AS INT) AS ward_id, CASE o.o_orderstatus WHEN 'O' THEN 'water_demand_mld' WHEN 'F' THEN 'waste_generation_tpd' ELSE 'transit_ridership' END AS metric,
 CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month, round(sum(o.o_totalprice), 2) AS value
 FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey GROUP BY 1,2,3""",
    "pixels": """SELECT l_partkey AS pixel_id, CAST(l_partkey % 25 AS INT) AS ward_id, CAST(extract(year FROM l_shipdate) AS INT) AS epoch,
 l_orderkey * 8 + l_linenumber AS scene_id, CAST(l_suppkey % 12 AS INT) AS scl, l_quantity / 1e2 AS green, l_discount * 3e0 AS red,
 l_extendedprice / 2e5 AS nir, (l_tax + 1e-2) * 4e0 AS swir FROM lineitem""",
    "cases": """SELECT o.o_orderkey AS request_id, o.o_orderdate AS created_at, o.o_orderpriority AS category, CAST(c.c_nationkey AS INT) AS ward_id,
 CASE o.o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'RESOLVED' ELSE 'IN_PROGRESS' END AS status, CASE WHEN o.o_orderstatus = 'F' THEN 1 + o.o_orderkey % 45 END AS resolution_days
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "environment": """SELECT CAST(s.s_nationkey AS INT) AS ward_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month, round(sum(l.l_quantity), 1) AS rainfall_mm,
 round(avg(l.l_discount) * 1e3, 1) AS pm25 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2""",
    "land": """SELECT CAST(n_nationkey AS INT) AS ward_id, 2026 AS year, CAST(40 + n_nationkey % 11 AS DOUBLE) AS residential_pct, CAST(n_nationkey % 9 AS DOUBLE) AS forest_green_pct,
 CAST(n_nationkey % 3 AS DOUBLE) AS waterbody_pct FROM nation""",
    "satellite": """SELECT CAST(l_partkey % 25 AS INT) AS ward_id, CAST(extract(year FROM l_shipdate) AS INT) AS year,
 round(avg(l_quantity) / 5e0, 4) AS built_up_sq_km, round(avg(l_discount) * 1e2, 4) AS vegetation_sq_km, round(avg(l_tax) * 1e1, 4) AS water_sq_km,
 round(avg(l_discount) * 5e0, 4) AS mean_ndvi, round(avg(l_tax) * 2e0, 4) AS mean_ndbi FROM lineitem GROUP BY 1, 2""",
}


class Tables:
    """Base tables and projections of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        sql = FIXTURES[name]
        for t in BASE:
            if f" {t} " in f"{sql} ".replace("\n", " "):
                self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return self.spark.sql(sql)


def ctes(names: str) -> str:
    """The named projections as the head of a WITH query, comma at the end left out."""
    return ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names.split())
