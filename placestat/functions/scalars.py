"""Column expressions: geodesy, rates, dates, labels and similarities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placestat.functions import constants as K


def haversine(lat1, lng1, lat2, lng2, radius: float = K.R_KM) -> Column:
    """Great-circle km; null if any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def polyline_km(points: Column) -> Column:
    """Length of an array of (lng, lat) structs x, y; 0 below two points."""
    n = F.size(points)
    parts = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: haversine(F.element_at(points, i)["y"], F.element_at(points, i)["x"], F.element_at(points, i + 1)["y"], F.element_at(points, i + 1)["x"], K.R_MEAN_KM),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def ring_area_km2(ring: Column) -> Column:
    """Area of a closed ring of (x lng, y lat), sinusoidal projection and shoelace."""
    n = F.size(ring)
    to = lambda p: F.struct((F.radians(p["x"]) * F.cos(F.radians(p["y"])) * K.R_MEAN_KM).alias("x"), (F.radians(p["y"]) * K.R_MEAN_KM).alias("y"))
    flat = F.transform(ring, to)
    terms = F.transform(
        F.when(n > 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.element_at(flat, i)["x"] * F.element_at(flat, i + 1)["y"] - F.element_at(flat, i + 1)["x"] * F.element_at(flat, i)["y"],
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def pct_change(new: Column, old: Column) -> Column:
    """Percent change to two decimals; null on a null or zero base."""
    return F.when(old != 0, F.round(100 * (new - old) / old, 2))


def clip01(x: Column) -> Column:
    """Within 0 and 1; null stays null, which least and greatest alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def season(month: Column, t: Column, density: Column) -> dict[str, Column]:
    """Calendar features of a monthly series."""
    m = F.month(month)
    return {
        "month_sin": F.sin(2 * F.pi() * m / 12), "month_cos": F.cos(2 * F.pi() * m / 12),
        "monsoon": F.when(m.between(6, 9), 1.0).otherwise(0.0), "t": t.cast("double"), "log_density": F.log1p(density),
    }


def project_population(base: Column, year, base_year: int = 2011, growth: float = K.ANNUAL_GROWTH) -> Column:
    """Geometric projection, rounded."""
    return F.round(base * F.pow(F.lit(1 + growth), F.lit(year) - base_year)).cast("long")


def normalised_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b) within -1 and 1; null where it isn't finite."""
    d = F.try_divide(a - b, a + b)
    return F.when(d.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)))


def request_uid(ts: Column, number: Column) -> Column:
    return F.format_string("CR-%d-%06d", F.year(ts), number)


def label(name: Column) -> Column:
    """WATER_SUPPLY as Water Supply."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, within -1 and 1; 0 on a zero norm or unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def json_field(json: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def pixel_area_km2(lat: Column, step_deg: float) -> Column:
    """Area of a square grid cell of ``step_deg`` degrees at a latitude."""
    side = K.R_MEAN_KM * F.radians(F.lit(step_deg))
    return side * side * F.cos(F.radians(lat))


def in_bbox(lat: Column, lng: Column, box: tuple[float, float, float, float] = K.BBOX) -> Column:
    """Inside the box or on its edge; null coordinates are outside."""
    s, w, n, e = box
    return F.coalesce(lat.between(s, n) & lng.between(w, e), F.lit(False))


def severity_band(pct: Column) -> Column:
    out = None
    for least, name in K.SEVERITY:
        out = F.when(pct >= least, name) if out is None else out.when(pct >= least, name)
    return out.otherwise("LOW")


def normalize_region_code(ref: Column) -> Column:
    """'H-East ward' as 'H/E'."""
    x = F.upper(F.trim(ref))
    x = F.trim(F.regexp_replace(x, r"\bWARD\b", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"[\s/-]*\bEAST\b", "/E"), r"[\s/-]*\bWEST\b", "/W")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[\s/-]*\bNORTH\b", "/N"), r"[\s/-]*\bSOUTH\b", "/S"), r"[\s/-]*\bCENTRAL\b", "/C")
    return F.regexp_replace(x, r"[\s-]+", "/")


def contains_ci(col: Column, q: str) -> Column:
    """Case-insensitive literal substring; null is false."""
    return F.coalesce(F.lower(col).contains(q.lower()), F.lit(False))
