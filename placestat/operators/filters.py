"""Projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.functions.scalars import contains_ci

STATUSES = ("OPEN", "IN_PROGRESS", "RESOLVED", "CLOSED")


def filter_requests(df: DataFrame, q: str | None = None, text_col: str = "text", **equal) -> DataFrame:
    """Optional equality filters and a case-insensitive search; what is None doesn't filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.where(contains_ci(F.col(text_col), q)) if q else df


def lookback_months(df: DataFrame, ts: str, now: Column, n: int) -> DataFrame:
    """Rows since the first of the month ``n`` months before ``now``."""
    return df.where(F.col(ts) >= F.add_months(F.trunc(now, "MM"), -n))


def request_points(df: DataFrame) -> DataFrame:
    """Located requests with a formatted day."""
    return df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "request_id", "lat", "lng", "category", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day")
    )


def safe_parse(df: DataFrame, now: Column) -> DataFrame:
    """Strings lat, lng, status, created_at to types: bad numbers null, unknown status OPEN, bad time ``now``, empty null."""
    empty = lambda c: F.when(F.trim(c) != "", c)
    status = F.upper(F.trim(F.col("status")))
    return df.withColumns(
        {
            "lat": empty(F.col("lat")).try_cast("double"),
            "lng": empty(F.col("lng")).try_cast("double"),
            "status": F.when(status.isin(*STATUSES), status).otherwise("OPEN"),
            "created_at": F.coalesce(empty(F.col("created_at")).try_cast("timestamp_ntz"), now),
        }
    )


# Facility types by tag, in order; (tags that must hold, type, subtype).
FACILITY_RULES = [
    ({"amenity": "hospital"}, "HEALTHCARE", "hospital"),
    ({"amenity": "clinic"}, "HEALTHCARE", "clinic"),
    ({"amenity": "doctors"}, "HEALTHCARE", "clinic"),
    ({"amenity": "school"}, "EDUCATION", "school"),
    ({"amenity": "college"}, "EDUCATION", "college"),
    ({"amenity": "university"}, "EDUCATION", "university"),
    ({"amenity": "library"}, "EDUCATION", "library"),
    ({"amenity": "fire_station"}, "EMERGENCY", "fire_station"),
    ({"amenity": "police"}, "PUBLIC_SAFETY", "police"),
    ({"amenity": "waste_transfer_station"}, "WASTE_MANAGEMENT", "waste_transfer_station"),
    ({"amenity": "recycling"}, "WASTE_MANAGEMENT", "recycling"),
    ({"amenity": "toilets"}, "SANITATION", "public_toilet"),
    ({"highway": "bus_stop"}, "BUS_STOP", "bus_stop"),
    ({"station": "subway"}, "METRO_STATION", "metro"),
    ({"subway": "yes"}, "METRO_STATION", "metro"),
    ({"railway": "station", "station": "light_rail"}, "METRO_STATION", "light_rail"),
    ({"railway": "station", "station": "monorail"}, "METRO_STATION", "monorail"),
    ({"railway": "station"}, "RAIL_STATION", "suburban_rail"),
    ({"man_made": "water_tower"}, "WATER_SUPPLY", "water_tower"),
    ({"man_made": "water_works"}, "WATER_SUPPLY", "water_works"),
    ({"man_made": "reservoir_covered"}, "WATER_SUPPLY", "reservoir_covered"),
    ({"man_made": "pumping_station"}, "WATER_SUPPLY", "pumping_station"),
    ({"man_made": "wastewater_plant"}, "DRAINAGE", "wastewater_plant"),
    ({"leisure": "park"}, "PARKS", "park"),
    ({"leisure": "playground"}, "PARKS", "playground"),
    ({"leisure": "sports_centre"}, "PARKS", "sports_centre"),
]


def classify_facility(tags: Column, rules: list[tuple[dict, str, str]] = FACILITY_RULES) -> Column:
    """(type, subtype) of a map of tags by the first rule all of whose tags it has, or null."""

    def given(i: int) -> Column:
        want, kind, subtype = rules[i]
        holds = [F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False)) for k, v in want.items()]
        return F.when(reduce(lambda a, b: a & b, holds), F.struct(F.lit(kind).alias("type"), F.lit(subtype).alias("subtype")))

    return F.coalesce(*map(given, range(len(rules))))


def landuse_bucket(tags: Column, buckets: dict[str, str]) -> Column:
    """Bucket of the first of landuse, leisure and natural whose value has one."""
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    return F.coalesce(*[F.try_element_at(table, tags[k]) for k in ("landuse", "leisure", "natural")])


def display_name(tags: Column, subtype: Column) -> Column:
    """Name, else its English form, else 'Unnamed <subtype>'."""
    return F.coalesce(tags["name"], tags["name:en"], F.concat(F.lit("Unnamed "), F.replace(subtype, F.lit("_"), F.lit(" "))))


def digits_only(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
