"""Points in regions, snapping, and density clusters, all by equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.functions import constants as K
from placestat.functions.scalars import haversine
from placestat.operators.graph import checkpoint, connected_components
from placestat.operators.ranking import first_rows, positions

KM_PER_DEGREE = 111.0
#: Of a great circle of the mean radius.
KM_OF_DEGREE = math.pi * K.R_MEAN_KM / 180


def rectangle(south: Column, west: Column, height: float, width: float) -> Column:
    """Rings of one closed rectangle, as an array of arrays of (x lng, y lat)."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    n, e = south + height, west + width
    return F.array(F.array(at(west, south), at(e, south), at(e, n), at(west, n), at(west, south)))


def edges(rings: Column) -> Column:
    """All edges (x1, y1, x2, y2) of rings; holes and parts alike, the even-odd rule sorts them out."""

    def of(ring: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
            return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))

        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), edge)

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), of))


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on an edge is outside."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    odd = F.aggregate(edge_list, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    on = lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
        F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    )
    return odd & ~F.exists(edge_list, on)


def edge_distance(edge_list: Column, x: Column, y: Column) -> Column:
    """Least distance to an edge, in degrees."""

    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(x - (e["x1"] + s * dx), 2) + F.pow(y - (e["y1"] + s * dy), 2))

    return F.array_min(F.transform(edge_list, one))


def region_cells(regions: DataFrame, key: str, rings: str, cell: float, margin: float = 0.0) -> DataFrame:
    """(key, cx, cy): cells that a region's bounding box, grown by ``margin`` degrees, touches."""
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    span = lambda v: F.sequence(F.floor((F.array_min(v) - margin) / cell), F.floor((F.array_max(v) + margin) / cell))
    return regions.select(key, F.explode(span(xs)).alias("cx"), span(ys).alias("__ys")).select(key, "cx", F.explode("__ys").alias("cy"))


def _located(points: DataFrame, pid: str, lat: str, lng: str, cell: float) -> DataFrame:
    p = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(pid, F.col(lng).alias("__x"), F.col(lat).alias("__y"))
    return p.withColumns({"cx": F.floor(F.col("__x") / cell), "cy": F.floor(F.col("__y") / cell)})


def points_in_regions(points: DataFrame, regions: DataFrame, pid: str, key: str = "ward_id", rings: str = "rings", lat: str = "lat", lng: str = "lng", cell: float = 0.02) -> DataFrame:
    """(pid, key) of points inside a region, the least key if several hold one.

    Candidates share a grid cell; geometry, prepared once a region, is joined to candidates only.
    """
    candidates = _located(points, pid, lat, lng, cell).join(region_cells(regions, key, rings, cell), ["cx", "cy"])
    shapes = regions.select(key, edges(F.col(rings)).alias("__e"))
    hit = candidates.join(shapes, key).where(contains(F.col("__e"), F.col("__x"), F.col("__y")))
    return hit.groupBy(pid).agg(F.min(key).alias(key))


def snap_to_region(points: DataFrame, regions: DataFrame, pid: str, key: str = "ward_id", rings: str = "rings", lat: str = "lat", lng: str = "lng", max_km: float = 1.0, cell: float = 0.02) -> DataFrame:
    """(pid, key, km) of the nearest region within ``max_km`` of its border; ties to the least key."""
    near = _located(points, pid, lat, lng, cell).join(region_cells(regions, key, rings, cell, max_km / KM_PER_DEGREE), ["cx", "cy"])
    shapes = regions.select(key, edges(F.col(rings)).alias("__e"))
    far = near.join(shapes, key).withColumn("km", edge_distance(F.col("__e"), F.col("__x"), F.col("__y")) * KM_PER_DEGREE).where(F.col("km") <= max_km)
    return far.groupBy(pid).agg(F.min(F.struct("km", key)).alias("m")).select(pid, F.col(f"m.{key}").alias(key), "m.km")


def locate(points: DataFrame, regions: DataFrame, pid: str, max_km: float = 1.0, **names) -> DataFrame:
    """(pid, ward_id) inside a region or else snapped to one."""
    inside = points_in_regions(points, regions, pid, **names)
    rest = points.join(inside, pid, "left_anti")
    return inside.unionByName(snap_to_region(rest, regions, pid, max_km=max_km, **names).drop("km"))


def eps_neighbours(points: DataFrame, eps_km: float, pid: str = "request_id", group: str | None = None, max_abs_lat: float = 60.0) -> DataFrame:
    """(a, b, group) with great-circle distance at most ``eps_km``, a = b included; null coordinates are out.

    Cells are eps high and wide at ``max_abs_lat``, so that neighbours are in the 3 x 3 cells around.
    """
    g = F.col(group) if group else F.lit(0)
    p = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col(pid).alias("id"), g.alias("g"), "lat", "lng")
    return near_pairs(p, eps_km, max_abs_lat).select("a", "b", "g")


def near_pairs(p: DataFrame, eps_km: float, max_abs_lat: float) -> DataFrame:
    """(a, g, b, and b's other columns) of points (id, g, lat, lng, ...) within ``eps_km``."""
    high = 1.001 * eps_km / 111.19
    wide = high / math.cos(math.radians(max_abs_lat))
    p = p.withColumns({"cy": F.floor(F.col("lat") / high), "cx": F.floor(F.col("lng") / wide)})
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = p.withColumn("d", F.explode(around)).select(F.col("id").alias("a"), "g", F.col("lat").alias("alat"), F.col("lng").alias("alng"), (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    km = haversine(F.col("alat"), F.col("alng"), F.col("lat"), F.col("lng"), K.R_MEAN_KM)
    return left.join(p, ["g", "cx", "cy"]).where(km <= eps_km).drop("alat", "alng", "lat", "lng", "cx", "cy").withColumnRenamed("id", "b")


def eps_neighbour_counts(points: DataFrame, eps_km: float, pid: str = "request_id", group: str | None = None, max_abs_lat: float = 60.0) -> DataFrame:
    """(a, n): how many pairs of ``eps_neighbours`` each id has, without listing them.

    Points at one place have the same neighbours, so only places are compared, each with its number of points.
    """
    g = F.col(group) if group else F.lit(0)
    p = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col(pid).alias("a"), g.alias("g"), "lat", "lng")
    places = checkpoint(p.groupBy("g", "lat", "lng").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    near = near_pairs(places, eps_km, max_abs_lat).groupBy("a").agg(F.sum("n").alias("n"))
    counts = places.drop("n").join(near, F.col("id") == F.col("a")).drop("id", "a")
    return p.join(counts, ["g", "lat", "lng"]).groupBy("a").agg(F.sum("n").alias("n"))


def dbscan(points: DataFrame, eps_km: float, min_samples: int, pid: str = "request_id", group: str | None = None) -> DataFrame:
    """(pid, cluster, is_core) of every located point; cluster is its least core point, null for noise.

    A border point goes to the cluster of its least core neighbour. With ``group`` only points of one
    group are neighbours. Points at one place have the same neighbours, so they are folded to a site with
    their number and least id before anything else.

    Sites lie in cells whose points are all neighbours. A cell of ``min_samples`` points is all core, with no pair looked at; only the
    few sites of the other cells are compared with those around. Core sites of a cell are one node of the cluster graph, and
    two cells are linked if a pair of their core sites is near, see ``near_cells``.
    """
    g = F.col(group) if group else F.lit(0)
    place = [F.col("lat").alias("slat"), F.col("lng").alias("slng"), g.alias("sg")]
    at = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col(pid).alias("p"), *place)
    sites = checkpoint(at.where(g.isNotNull() if group else F.lit(True)).groupBy("slat", "slng", "sg").agg(F.min("p").alias("site"), F.count("*").alias("n")))
    found = _site_clusters(sites, eps_km, min_samples)
    back = at.join(sites, [at.slat.eqNullSafe(sites.slat), at.slng.eqNullSafe(sites.slng), at.sg.eqNullSafe(sites.sg)])
    return back.select("p", "site").join(found, "site").select(F.col("p").alias(pid), "cluster", "is_core")


CELL = ["g", "cx", "cy"]


def _around(side: float, eps_km: float, max_abs_lat: float) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of cells that can hold a neighbour."""
    high = side * KM_OF_DEGREE
    wide = high * math.cos(math.radians(min(89.0, max_abs_lat)))
    rx, ry = math.ceil(eps_km / wide), math.ceil(eps_km / high)
    gap = lambda d, unit: max(0, abs(d) - 1) * unit
    return [(dx, dy) for dx in range(-rx, rx + 1) for dy in range(-ry, ry + 1) if math.hypot(gap(dx, wide), gap(dy, high)) <= eps_km]


def _spread(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """df once for each cell around its own."""
    d = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets]))
    return df.withColumn("d", d).withColumns({"cx": F.col("cx") + F.col("d.x"), "cy": F.col("cy") + F.col("d.y")}).drop("d")


def _site_clusters(sites: DataFrame, eps_km: float, min_samples: int) -> DataFrame:
    """(site, cluster, is_core) of sites (site, slat, slng, sg, n)."""
    side = 0.999 * eps_km / (math.sqrt(2) * KM_OF_DEGREE)
    top = sites.agg(F.max(F.abs("slat"))).first()[0] or 0.0
    around = _around(side, eps_km, top + 2 * side)
    s = sites.select("site", "n", F.col("slat").alias("lat"), F.col("slng").alias("lng"), F.col("sg").alias("g"), F.floor(F.col("slng") / side).alias("cx"), F.floor(F.col("slat") / side).alias("cy"))
    crowd = s.groupBy(*CELL).agg((F.sum("n") >= min_samples).alias("crowded"))
    s = checkpoint(s.join(crowd, CELL))
    lone = s.where("NOT crowded").select(F.col("site").alias("a"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), *CELL)
    km = haversine(F.col("alat"), F.col("alng"), F.col("lat"), F.col("lng"), K.R_MEAN_KM)
    seen = _spread(lone, around).join(s.select("n", "lat", "lng", *CELL), CELL).where(km <= eps_km).groupBy("a").agg((F.sum("n") >= min_samples).alias("core"))
    seen = checkpoint(seen)
    more = s.join(seen.where("core").select(F.col("a").alias("site")), "site", "left_semi").select(*s.columns)
    core = checkpoint(s.where("crowded").unionByName(more).select("site", "lat", "lng", *CELL))
    nodes = core.groupBy(*CELL).agg(F.min("site").alias("node"))
    core = checkpoint(core.join(nodes, CELL))
    comp = connected_components(near_cells(core, eps_km, side, around), "a", "b")
    label = nodes.join(comp, "node", "left").select(*CELL, F.coalesce("component", "node").alias("cluster"))
    core = checkpoint(core.join(label, CELL).select("site", "lat", "lng", *CELL, "cluster"))
    edge = lone.join(seen.where("NOT core").select("a"), "a")
    border = _spread(edge, around).join(core, CELL).where(km <= eps_km).groupBy("a").agg(F.min_by("cluster", "site").alias("cluster"))
    found = core.select(F.col("site").alias("a"), "cluster", F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False)))
    return s.select(F.col("site").alias("a")).join(found, "a", "left").select(F.col("a").alias("site"), "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))


def near_cells(core: DataFrame, eps_km: float, side: float, around: list[tuple[int, int]], split: int = 4, levels: int = 6) -> DataFrame:
    """(a, b): nodes of neighbouring cells with a pair of sites within ``eps_km``; core has site, lat, lng, g, cx, cy, node.

    No pairs of sites of crowded cells are listed: boxes around each cell's sites are compared first. Two boxes that are near wherever their
    sites lie link the cells, two that are far are forgotten, and what is undecided is split into smaller boxes, ``split`` by ``split``, again and
    again; only sites of the smallest undecided boxes are compared.
    """

    def boxes(sites: DataFrame, level: int) -> DataFrame:
        unit = side / split**level
        at = sites.withColumns({"kx": F.floor(F.col("lng") / unit), "ky": F.floor(F.col("lat") / unit)})
        return at.groupBy(*CELL, "node", "kx", "ky").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))

    def bound(far: bool) -> Column:
        """Least or greatest great-circle distance of points in two boxes."""
        d = lambda lo, hi: F.radians(F.greatest(F.abs(F.col(f"b_{hi}") - F.col(f"a_{lo}")), F.abs(F.col(f"a_{hi}") - F.col(f"b_{lo}"))) if far else F.greatest(F.lit(0.0), F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}")))
        low = lambda x: F.when((F.col(f"{x}_s") <= 0) & (F.col(f"{x}_n") >= 0), 0.0).otherwise(F.least(F.abs(f"{x}_s"), F.abs(f"{x}_n")))
        lat = low if far else lambda x: F.greatest(F.abs(f"{x}_s"), F.abs(f"{x}_n"))
        h = F.pow(F.sin(d("s", "n") / 2), F.lit(2)) + F.cos(F.radians(lat("a"))) * F.cos(F.radians(lat("b"))) * F.pow(F.sin(d("w", "e") / 2), F.lit(2))
        return 2 * K.R_MEAN_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    named = lambda df, x, keep: df.select(*keep, *[F.col(c).alias(f"{x}_{c}") for c in ("node", "kx", "ky", "s", "n", "w", "e")])
    half = [(dx, dy) for dx, dy in around if (dy, dx) > (0, 0)]
    first = checkpoint(boxes(core, 0))
    met = _spread(named(first, "a", CELL), half).join(named(first, "b", CELL), CELL)
    found = None
    slack = 1e-9 * eps_km
    for level in range(levels + 1):
        judged = checkpoint(met.withColumns({"lo": bound(False), "hi": bound(True)}).where(F.col("lo") <= eps_km + slack).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_kx", "a_ky", "b_kx", "b_ky", "hi"))
        near = judged.where(F.col("hi") <= eps_km - slack).select("a", "b").distinct()
        found = near if found is None else checkpoint(found.unionByName(near))
        open_ = checkpoint(judged.join(near, ["a", "b"], "left_anti").drop("hi"))
        if open_.limit(1).count() == 0:
            return found
        wanted = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
        sites = checkpoint(core.join(wanted, "node", "left_semi"))
        unit = side / split**level
        if level == levels:
            cell = lambda x: sites.select(F.col("node").alias(x), F.floor(F.col("lng") / unit).alias(f"{x}_kx"), F.floor(F.col("lat") / unit).alias(f"{x}_ky"), F.col("lat").alias(f"{x}lat"), F.col("lng").alias(f"{x}lng"))
            pairs = open_.join(cell("a"), ["a", "a_kx", "a_ky"]).join(cell("b"), ["b", "b_kx", "b_ky"])
            km = haversine(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"), K.R_MEAN_KM)
            return found.unionByName(pairs.where(km <= eps_km).select("a", "b").distinct())
        small = boxes(sites, level + 1)
        parent = lambda x: named(small, x, []).withColumns({x: F.col(f"{x}_node"), f"p{x}x": F.floor(F.col(f"{x}_kx") / split), f"p{x}y": F.floor(F.col(f"{x}_ky") / split)})
        up = open_.select("a", "b", F.col("a_kx").alias("pax"), F.col("a_ky").alias("pay"), F.col("b_kx").alias("pbx"), F.col("b_ky").alias("pby"))
        met = up.join(parent("a"), ["a", "pax", "pay"]).join(parent("b"), ["b", "pbx", "pby"])
    return found


def hotspot_summary(points: DataFrame, clusters: DataFrame, pid: str = "request_id") -> DataFrame:
    """One row a cluster: centre, radius (0.1 km at least; radius_m for display, 250 m at least), count, density, severity,
    dominant category, number of points by category (``breakdown``), regions, three samples."""
    p = points.join(clusters.where("cluster IS NOT NULL").select(pid, "cluster"), pid)
    centre = p.groupBy("cluster").agg(F.avg("lat").alias("clat"), F.avg("lng").alias("clng"), F.count("*").alias("n"), F.countDistinct("ward_id").alias("regions"))
    radius = p.join(centre.select("cluster", "clat", "clng"), "cluster").groupBy("cluster").agg(F.greatest(F.lit(0.1), F.max(haversine(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng")))).alias("radius_km"))
    kinds = p.groupBy("cluster", "category").agg(F.count("*").alias("k"))
    top = kinds.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "category"))).alias("s"))
    top = top.select("cluster", F.col("s")[0]["category"].alias("dominant"), F.transform("s", lambda x: F.struct(x["category"].alias("category"), (-x["k"]).alias("n"))).alias("breakdown"))
    few = first_rows(p.select("cluster", pid), ["cluster"], [F.asc(pid)], 3).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.col(pid))), ",").alias("samples"))
    out = centre.join(radius, "cluster").join(top, "cluster").join(few, "cluster")
    out = out.withColumn("density", F.col("n") / F.greatest(F.lit(0.1), F.lit(3.14159) * F.pow("radius_km", F.lit(2))))
    severity = F.when((F.col("n") >= K.HOTSPOT_HIGH_POINTS) | (F.round("density", 2) > K.HOTSPOT_HIGH_DENSITY), "HIGH").when(F.col("n") >= K.HOTSPOT_MEDIUM_POINTS, "MEDIUM").otherwise("LOW")
    return out.withColumns({"severity": severity, "radius_m": F.round(F.greatest(F.lit(250.0), F.col("radius_km") * 1000), 1)})


def cluster_numbers(clusters: DataFrame, points: DataFrame, pid: str = "request_id", step: int = 1000) -> DataFrame:
    """(pid, cluster_id): clusters numbered within their category, ``step`` apart from category to category."""
    named = clusters.where("cluster IS NOT NULL").join(points.select(pid, "category"), pid)
    firsts = positions(named.select("category", "cluster").distinct(), ["category"], "cluster", "k")
    cats = positions(points.select("category").distinct(), [], "category", "c")
    ids = firsts.join(cats, "category")
    return named.join(ids.select("category", "cluster", (F.col("c") * step + F.col("k") + 1).alias("cluster_id")), ["category", "cluster"]).select(pid, "cluster_id")
