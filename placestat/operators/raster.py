"""Rasters as pixel tables: one row a pixel and scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placestat.functions import constants as K
from placestat.functions.scalars import normalised_difference
from placestat.operators.ranking import ordinal_rank_fraction
from placestat.operators.spatial import points_in_regions

BANDS = ("green", "red", "nir", "swir")


def mask_scenes(px: DataFrame, bands: tuple[str, ...] = BANDS, offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Valid scene classes and non-zero values only, as (value - offset) / scale."""
    keep = ~F.col("scl").isin(*K.INVALID_SCENE_CLASSES)
    for b in bands:
        keep = keep & (F.col(b) != 0)
    return px.where(keep).withColumns({b: (F.col(b) - offset) / scale for b in bands})


def median_composite(px: DataFrame, bands: tuple[str, ...] = BANDS, keys: tuple[str, ...] = ("pixel_id", "ward_id", "epoch")) -> DataFrame:
    """Median over the valid scenes of each pixel and epoch, by band."""
    return px.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def spectral_indices(px: DataFrame) -> DataFrame:
    nd = lambda a, b: normalised_difference(F.col(a), F.col(b))
    return px.withColumns({"ndvi": nd("nir", "red"), "ndbi": nd("swir", "nir"), "ndwi": nd("green", "nir")})


def land_cover(px: DataFrame) -> DataFrame:
    """cover: water, vegetation, bare_soil, built_up, or null if an index is missing or no rule holds."""
    ndvi, ndbi, ndwi = F.col("ndvi"), F.col("ndbi"), F.col("ndwi")
    known = ndvi.isNotNull() & ndbi.isNotNull() & ndwi.isNotNull()
    rules = F.when(ndwi > K.NDWI_WATER, "water").when(ndvi > K.NDVI_VEGETATION, "vegetation").when((ndbi > 0.12) & (ndvi > 0.15), "bare_soil").when(ndvi < K.NDVI_BUILT_MAX + 0.05, "built_up")
    return px.withColumn("cover", F.when(known, rules))


def normalise_epoch(px: DataFrame, epoch: int, reference: int, bands: tuple[str, ...] = BANDS, moved: float = 0.01) -> DataFrame:
    """Gain and offset a band that bring ``epoch`` to ``reference``, fitted on pixels whose NDVI rank hardly moved."""
    both = []
    for name, e in (("a", epoch), ("b", reference)):
        ranked = ordinal_rank_fraction(px.where((F.col("epoch") == e) & F.col("ndvi").isNotNull()), "ndvi", "pixel_id")
        both.append(ranked.select("pixel_id", F.col("rank_fraction").alias(f"rank_{name}"), *[F.col(b).alias(f"{b}_{name}") for b in bands]))
    still = both[0].join(both[1], "pixel_id").where(F.abs(F.col("rank_a") - F.col("rank_b")) < moved)
    return still.agg(F.count("*").alias("pixels"), *[f(f"{b}_b", f"{b}_a").alias(f"{b}_{n}") for b in bands for n, f in (("gain", F.regr_slope), ("offset", F.regr_intercept))])


def zonal_stats(px: DataFrame, areas: DataFrame, key: str | None = "ward_id", area: str = "area_sq_km") -> DataFrame:
    """Per region and epoch (all together without ``key``): valid share, mean indices, class areas scaled to the region's."""
    keys = [key, "epoch"] if key else ["epoch"]
    g = px.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.count("ndvi").alias("valid"), *[F.avg(i).alias(f"mean_{i}") for i in ("ndvi", "ndbi", "ndwi")],
        *[F.count_if(F.col("cover") == c).alias(f"n_{c}") for c in ("water", "vegetation", "built_up", "bare_soil")],
    )
    a = areas.select(key, area) if key else areas.agg(F.sum(area).alias(area))
    j = g.join(a, key) if key else g.crossJoin(F.broadcast(a))
    share = F.col(area) / F.nullif(F.col("valid"), F.lit(0))
    return j.withColumns({"valid_fraction": F.col("valid") / F.col("pixels")} | {f"{c}_sq_km": F.col(f"n_{c}") * share for c in ("water", "vegetation", "built_up", "bare_soil")})


def elevation_stats(px: DataFrame, key: str, value: str, approximate: bool = False) -> DataFrame:
    """Mean, median, tenth percentile and shares under 5 and 10; percentiles approximate for very large regions."""
    q = (lambda p: F.percentile_approx(value, p)) if approximate else (lambda p: F.percentile(value, p))
    return px.groupBy(key).agg(
        F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.1).alias("p10"), F.avg((F.col(value) < 5).cast("double")).alias("below_5"), F.avg((F.col(value) < 10).cast("double")).alias("below_10")
    )


def mosaic_first_valid(tiles: DataFrame, pixel: str, order: str, value: str) -> DataFrame:
    """First non-null value of each pixel in tile order; null where no tile has one."""
    return tiles.groupBy(pixel).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def new_built_up(px: DataFrame) -> DataFrame:
    """Pixels built up in their last epoch but not in their first."""
    e = px.groupBy("pixel_id").agg(F.min_by("cover", "epoch").alias("first"), F.max_by("cover", "epoch").alias("last"), F.countDistinct("epoch").alias("epochs"))
    return e.where("epochs > 1 AND last = 'built_up' AND coalesce(first, '') <> 'built_up'").select("pixel_id")


# Which land use wins where several cover a cell.
PRECEDENCE = ("water", "green", "industrial", "commercial", "residential", "agricultural", "mixed")


def landuse_shares(cells: DataFrame, covers: DataFrame, key: str = "ward_id", cell: str = "cell_id") -> DataFrame:
    """Share of a region's cells by bucket of highest precedence; cells without any are unmapped."""
    order = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("bucket"))
    best = covers.where(order > 0).groupBy(cell).agg(F.min_by("bucket", order).alias("bucket"))
    j = cells.join(best, cell, "left").withColumn("bucket", F.coalesce("bucket", F.lit("unmapped")))
    total = cells.groupBy(key).agg(F.count("*").alias("cells"))
    return j.groupBy(key, "bucket").agg(F.count("*").alias("n")).join(total, key).select(key, "bucket", (100 * F.col("n") / F.col("cells")).alias("share"))


def rasterise_regions(regions: DataFrame, step: float, key: str = "ward_id", rings: str = "rings") -> DataFrame:
    """(key, ix, iy): cells of ``step`` degrees whose centre is inside the region."""
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    span = lambda v: F.sequence(F.floor(F.array_min(v) / step), F.floor(F.array_max(v) / step))
    grid = regions.select(F.explode(span(xs)).alias("ix"), span(ys).alias("__y")).select("ix", F.explode("__y").alias("iy")).distinct()
    centre = lambda c: (F.col(c) + 0.5) * step
    p = grid.select(F.struct("ix", "iy").alias("cell"), centre("iy").alias("lat"), centre("ix").alias("lng"))
    return points_in_regions(p, regions, "cell", key, rings).select(key, "cell.ix", "cell.iy")


