"""Polygons as ring arrays, and map projections, in column expressions.

A polygon is ``array<array<struct<x,y>>>``: the outer ring first, then holes; rings
are closed (the first point is repeated at the end).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rings_from_coordinates(coordinates: Column) -> Column:
    """GeoJSON polygon coordinates to rings."""
    return F.transform(
        coordinates,
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )


def segments(ring: Column) -> Column:
    """Edges of a ring as structs (a, b); repeated vertices make none."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.zip_with(
        F.slice(ring, 1, count),
        F.slice(ring, 2, count),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return F.filter(edges, lambda s: s["a"] != s["b"])


def all_segments(rings: Column) -> Column:
    return F.flatten(F.transform(rings, segments))


def bounds(rings: Column) -> Column:
    """[left, bottom, right, top] of the outer ring."""
    xs = F.transform(rings[0], lambda p: p["x"])
    ys = F.transform(rings[0], lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _turn(o: Column, a: Column, b: Column) -> Column:
    return _cross(o["x"], o["y"], a["x"], a["y"], b["x"], b["y"])


def signed_area(ring: Column) -> Column:
    """Shoelace sum, taken relative to the first point for precision."""
    origin = ring[0]
    return F.aggregate(
        segments(ring), F.lit(0.0), lambda total, s: total + _turn(origin, s["a"], s["b"]) / 2.0
    )


def polygon_area(rings: Column) -> Column:
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    holes = F.aggregate(areas, F.lit(0.0), lambda total, a: total + a)
    return areas[0] * 2.0 - holes


def centroid(rings: Column) -> Column:
    """Area-weighted centroid; holes count negative."""
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    origin = rings[0][0]

    def ring_moments(ring: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            w = _turn(origin, s["a"], s["b"]) / 2.0
            return F.struct(
                (acc["area"] + w).alias("area"),
                (acc["mx"] + w * (s["a"]["x"] + s["b"]["x"] - origin["x"] * 2.0) / 3.0).alias("mx"),
                (acc["my"] + w * (s["a"]["y"] + s["b"]["y"] - origin["y"] * 2.0) / 3.0).alias("my"),
            )

        return F.aggregate(segments(ring), start, add)

    def combine(acc: Column, item: Column) -> Column:
        sign = F.when(item["outer"], F.signum(item["m"]["area"])).otherwise(-F.signum(item["m"]["area"]))
        return F.struct(
            (acc["area"] + sign * item["m"]["area"]).alias("area"),
            (acc["mx"] + sign * item["m"]["mx"]).alias("mx"),
            (acc["my"] + sign * item["m"]["my"]).alias("my"),
        )

    moments = F.transform(rings, lambda r, i: F.struct(ring_moments(r).alias("m"), (i == 0).alias("outer")))
    total = F.aggregate(moments, start, combine)
    return F.struct(
        (origin["x"] + total["mx"] / total["area"]).alias("x"),
        (origin["y"] + total["my"] / total["area"]).alias("y"),
    )


def on_boundary(rings: Column, x: Column, y: Column) -> Column:
    def touches(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return (
            (_cross(a["x"], a["y"], b["x"], b["y"], x, y) == 0)
            & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )

    return F.exists(all_segments(rings), touches)


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast; holes work because all rings are counted together."""
    return crossed_oddly(all_segments(rings), x, y)


def crossed_oddly(edges: Column, x: Column, y: Column) -> Column:
    """``contains_point`` for rings that were cut into their edges before (``all_segments``)."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    hits = F.aggregate(edges, F.lit(0), lambda total, s: total + crosses(s))
    return F.pmod(hits, F.lit(2)) == 1


def _proper_crossing(s: Column, t: Column) -> Column:
    """Interiors of two segments cross in one point."""
    return (
        (F.signum(_turn(s["a"], s["b"], t["a"])) * F.signum(_turn(s["a"], s["b"], t["b"])) < 0)
        & (F.signum(_turn(t["a"], t["b"], s["a"])) * F.signum(_turn(t["a"], t["b"], s["b"])) < 0)
    )


def _within(p: Column, s: Column) -> Column:
    """Point on a closed segment."""
    a, b = s["a"], s["b"]
    return (
        (_turn(a, b, p) == 0)
        & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def _segments_touch(s: Column, t: Column) -> Column:
    return (
        _proper_crossing(s, t)
        | _within(s["a"], t) | _within(s["b"], t) | _within(t["a"], s) | _within(t["b"], s)
    )


def interior_point(ring: Column) -> Column:
    """A point inside a simple ring: halfway between its two left-most crossings with a line
    between its two lowest vertex heights."""
    heights = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    y = (heights[0] + heights[1]) / 2.0
    spans = F.filter(segments(ring), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    at = F.array_sort(F.transform(
        spans, lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])
    ))
    return F.struct(((at[0] + at[1]) / 2.0).alias("x"), y.alias("y"))


def _parts(s: Column, points: Column) -> Column:
    """Midpoints of the parts of an edge between the given points that lie on it."""
    along = lambda p: (p["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (p["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"])
    met = F.concat(F.array(s["a"], s["b"]), F.filter(points, lambda p: _within(p, s)))
    ordered = F.array_sort(F.array_distinct(F.transform(
        met, lambda p: F.struct(along(p).alias("at"), p["x"].alias("x"), p["y"].alias("y"))
    )))
    count = F.size(ordered) - 1
    return F.zip_with(
        F.slice(ordered, 1, count), F.slice(ordered, 2, count),
        lambda a, b: F.struct(((a["x"] + b["x"]) / 2.0).alias("x"), ((a["y"] + b["y"]) / 2.0).alias("y")),
    )


def covers(outer: Column, inner: Column) -> Column:
    """Every point of ``inner`` lies in ``outer``; touching boundaries are fine.

    No two edges may cross. Inner edges are cut where vertices of the outer polygon touch
    them; the inner vertices and the middle of each part must lie in the outer polygon.
    What is left are outer holes, which lie in the inner polygon or apart from it as a whole.
    """
    inside = lambda p: contains_point(outer, p["x"], p["y"]) | on_boundary(outer, p["x"], p["y"])
    edges, corners = all_segments(inner), F.flatten(outer)
    crossing = F.exists(all_segments(outer), lambda s: F.exists(edges, lambda t: _proper_crossing(s, t)))
    holes = F.slice(outer, 2, F.greatest(F.size(outer), F.lit(1)))

    def hole_inside(r: Column) -> Column:
        p = interior_point(r)
        return contains_point(inner, p["x"], p["y"])

    return (
        F.forall(F.flatten(inner), inside)
        & ~crossing
        & F.forall(edges, lambda s: F.forall(_parts(s, corners), inside))
        & ~F.exists(holes, hole_inside)
    )


def intersects(left: Column, right: Column) -> Column:
    """Any shared point: one polygon inside the other, or touching edges.

    The point tests come first because they are linear and usually decide.
    """
    return (
        contains_point(left, right[0][0]["x"], right[0][0]["y"])
        | contains_point(right, left[0][0]["x"], left[0][0]["y"])
        | F.exists(
            all_segments(left), lambda s: F.exists(all_segments(right), lambda t: _segments_touch(s, t))
        )
    )


def _vertices(ring: Column) -> Column:
    return F.array_distinct(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def is_valid(rings: Column) -> Column:
    """Closed rings with area that do not cross, holes inside the shell and apart from each other.

    A ring touches itself nowhere; two rings may touch in one point. Repeated vertices are fine.
    """
    closed = F.forall(
        rings, lambda r: (F.size(_vertices(r)) >= 3) & (r[0] == F.element_at(r, -1)) & (signed_area(r) != 0)
    )
    edges = all_segments(rings)
    crossed = F.exists(edges, lambda s: F.exists(edges, lambda t: _proper_crossing(s, t)))
    pinched = F.exists(
        rings, lambda r: F.exists(_vertices(r), lambda p: F.size(F.filter(segments(r), lambda s: _within(p, s))) > 2)
    )
    touching = lambda a, b: F.size(F.array_distinct(F.concat(
        F.filter(_vertices(a), lambda p: F.exists(segments(b), lambda s: _within(p, s))),
        F.filter(_vertices(b), lambda p: F.exists(segments(a), lambda s: _within(p, s))),
    )))
    holds = lambda a, b: contains_point(F.array(a), interior_point(b)["x"], interior_point(b)["y"])
    holes = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
    numbered = F.transform(rings, lambda r, i: F.struct(i.alias("i"), r.alias("ring")))
    joined = F.exists(numbered, lambda a: F.exists(
        numbered, lambda b: (a["i"] < b["i"]) & (touching(a["ring"], b["ring"]) > 1)
    ))
    nested = F.exists(numbered, lambda a: F.exists(
        numbered, lambda b: (a["i"] > 0) & (b["i"] > 0) & (a["i"] != b["i"]) & holds(a["ring"], b["ring"])
    ))
    stray = F.exists(holes, lambda h: ~holds(rings[0], h))
    return F.coalesce(
        F.when(~((F.size(rings) > 0) & closed), False).otherwise(~crossed & ~pinched & ~joined & ~stray & ~nested), F.lit(False)
    )


def is_box(rings: Column) -> Column:
    """One closed ring of four different corners whose edges follow the axes; cheap to see."""
    ring = rings[0]
    straight = F.forall(segments(ring), lambda s: (s["a"]["x"] == s["b"]["x"]) | (s["a"]["y"] == s["b"]["y"]))
    return F.coalesce(
        (F.size(rings) == 1) & (F.size(ring) == 5) & (ring[0] == ring[4]) & (F.size(F.array_distinct(ring)) == 4)
        & (ring[0] != ring[2]) & (ring[0]["x"] != ring[2]["x"]) & (ring[0]["y"] != ring[2]["y"]) & straight,
        F.lit(False),
    )


INNER_SCALES = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.35, 0.2)


def inner_box(rings: Column) -> Column:
    """Bounds of a large box inside the polygon, or NULL if none is found.

    Tries boxes around the middle of the bounds, so points in it need no polygon test.
    """
    box = bounds(rings)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def scaled(s: Column) -> Column:
        half = lambda low, high: (high - low) / 2.0 * s
        middle = lambda low, high: (low + high) / 2.0
        dx, dy, mx, my = half(box[0], box[2]), half(box[1], box[3]), middle(box[0], box[2]), middle(box[1], box[3])
        return F.array(mx - dx, my - dy, mx + dx, my + dy)

    def outline(q: Column) -> Column:
        return F.array(F.array(
            corner(q[0], q[1]), corner(q[2], q[1]), corner(q[2], q[3]), corner(q[0], q[3]), corner(q[0], q[1])
        ))

    boxes = F.transform(F.array(*[F.lit(s) for s in INNER_SCALES]), scaled)
    return F.get(F.filter(boxes, lambda q: covers(rings, outline(q))), F.lit(0))


def geojson(rings: Column) -> Column:
    """GeoJSON text of a polygon."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(coordinates.alias("coordinates"), F.lit("Polygon").alias("type")))


def multi_geojson(polygons: Column) -> Column:
    """GeoJSON text of several polygons; a single one is told as Polygon."""
    place = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    many = F.to_json(F.struct(F.transform(polygons, place).alias("coordinates"), F.lit("MultiPolygon").alias("type")))
    return F.when(F.size(polygons) == 1, geojson(polygons[0])).when(F.size(polygons) > 1, many)


def multi_bounds(polygons: Column) -> Column:
    """[left, bottom, right, top] of several polygons."""
    boxes = F.transform(polygons, bounds)
    side = lambda k: F.transform(boxes, lambda b: b[k])
    return F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3)))


def multi_corners(polygons: Column) -> Column:
    """Number of corners of all rings."""
    return F.aggregate(F.flatten(polygons), F.lit(0), lambda n, ring: n + F.size(ring) - 1)


# --- projections -----------------------------------------------------------------
# The WGS 84 ellipsoid, the UTM scale and the standard parallel of the
# global equal-area cylindrical grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH = 10000000.0
EQUAL_AREA_PARALLEL = 30.0

ECC2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(ECC2)
_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The Krüger series of the transverse Mercator projection, to order n⁴.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_zone(crs: Column) -> Column:
    """Zone of an EPSG:326zz or EPSG:327zz code."""
    return F.try_to_number(F.substring(crs, -2, 2), F.lit("99")).cast("int")


def _central_meridian(crs: Column) -> Column:
    return F.radians(utm_zone(crs) * 6.0 - 183.0)


def _false_northing(crs: Column) -> Column:
    return F.when(crs.startswith("EPSG:327"), UTM_SOUTH).otherwise(0.0)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; keeps nested formulas small."""
    return F.transform(F.array(value), body)[0]


def _pair(first: Column, second: Column) -> Column:
    return F.struct(first.alias("a"), second.alias("b"))


def _series(start: Column, coefficients: tuple[float, ...], sign: float) -> Column:
    """Krüger correction of (xi, eta), the struct fields a and b."""
    xi, eta = start["a"], start["b"]
    for j, c in enumerate(coefficients, start=1):
        xi = xi + F.sin(start["a"] * (2.0 * j)) * F.cosh(start["b"] * (2.0 * j)) * (sign * c)
        eta = eta + F.cos(start["a"] * (2.0 * j)) * F.sinh(start["b"] * (2.0 * j)) * (sign * c)
    return _pair(xi, eta)


def to_utm(lon: Column, lat: Column, crs: Column) -> Column:
    """Longitude and latitude in degrees to UTM metres."""
    scale = UTM_SCALE * RECTIFYING
    north = _false_northing(crs)
    conformal = lambda s: F.sinh(F.atanh(s) - F.atanh(s * ECC) * ECC)
    sphere = lambda v: _pair(
        F.atan2(v["a"], F.cos(v["b"])), F.atanh(F.sin(v["b"]) / F.sqrt(v["a"] * v["a"] + F.lit(1.0)))
    )
    start = _pair(_let(F.sin(F.radians(lat)), conformal), F.radians(lon) - _central_meridian(crs))
    corrected = _let(_let(start, sphere), lambda v: _series(v, ALPHA, 1.0))
    return _let(
        corrected,
        lambda v: F.struct((v["b"] * scale + UTM_EASTING).alias("x"), (v["a"] * scale + north).alias("y")),
    )


def from_utm(x: Column, y: Column, crs: Column) -> Column:
    """UTM metres to longitude and latitude in degrees."""
    scale = UTM_SCALE * RECTIFYING
    start = _pair((y - _false_northing(crs)) / scale, (x - UTM_EASTING) / scale)
    corrected = _let(start, lambda v: _series(v, BETA, -1.0))

    def latitude(chi: Column) -> Column:
        phi = chi
        for j, d in enumerate(DELTA, start=1):
            phi = phi + F.sin(chi * (2.0 * j)) * d
        return phi

    return _let(
        corrected,
        lambda v: F.struct(
            F.degrees(_central_meridian(crs) + F.atan2(F.sinh(v["b"]), F.cos(v["a"]))).alias("x"),
            F.degrees(_let(F.asin(F.sin(v["a"]) / F.cosh(v["b"])), latitude)).alias("y"),
        ),
    )


def to_equal_area(lon: Column, lat: Column) -> Column:
    """Longitude and latitude to the global equal-area cylindrical grid (EPSG:6933)."""
    parallel = math.radians(EQUAL_AREA_PARALLEL)
    k0 = math.cos(parallel) / math.sqrt(1 - ECC2 * math.sin(parallel) ** 2)
    authalic = lambda s: (s / (F.lit(1.0) - s * s * ECC2) + F.atanh(s * ECC) / ECC) * (1 - ECC2)
    return F.struct(
        (F.radians(lon) * (SEMI_MAJOR * k0)).alias("x"),
        (_let(F.sin(F.radians(lat)), authalic) * (SEMI_MAJOR / (2 * k0))).alias("y"),
    )


def looks_geographic(box: Column) -> Column:
    """Bounds that fit degrees; anything else is taken to be projected already."""
    return (
        box[0].between(-180.0, 180.0) & box[2].between(-180.0, 180.0)
        & box[1].between(-90.0, 90.0) & box[3].between(-90.0, 90.0)
    )


def project_rings(rings: Column, crs: Column) -> Column:
    """Lon/lat rings into a UTM grid; rings that are not lon/lat pass unchanged."""
    projected = F.transform(rings, lambda r: F.transform(r, lambda p: to_utm(p["x"], p["y"], crs)))
    return F.when(looks_geographic(bounds(rings)), projected).otherwise(rings)


def unproject_rings(rings: Column, crs: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: from_utm(p["x"], p["y"], crs)))


def pixel_area_m2(x: Column, y: Column, width: Column, height: Column, crs: Column) -> Column:
    """Equal-area size of the pixel whose upper-left corner is (x, y)."""
    corner = lambda cx, cy: F.struct(cx.alias("x"), cy.alias("y"))
    corners = F.array(corner(x, y), corner(x + width, y), corner(x + width, y - height), corner(x, y - height))
    geographic = F.transform(corners, lambda p: from_utm(p["x"], p["y"], crs))
    flat = F.transform(geographic, lambda p: to_equal_area(p["x"], p["y"]))
    diagonals = lambda c: (
        (c[2]["x"] - c[0]["x"]) * (c[3]["y"] - c[1]["y"]) - (c[2]["y"] - c[0]["y"]) * (c[3]["x"] - c[1]["x"])
    )
    return F.abs(_let(flat, diagonals)) / 2.0
