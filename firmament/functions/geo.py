"""Geometry as column expressions.

* Lambert-93 (EPSG:2154) to WGS84 longitude/latitude, inverse projection on
  GRS80 with a fixed number of latitude iterations.
* Geodesic distance on the WGS84 ellipsoid, the metric a spheroidal
  ``ST_Distance`` uses: Vincenty's inverse with a fixed number of steps, and a
  bracketed search for the azimuth of pairs so far apart (up to antipodes)
  that these steps do not settle.
* Bounding box and grid cells used to prune before the exact distance.

Intermediates are bound to lambda variables (``let``) and the iterations run
inside ``aggregate``; chaining them as projections makes the optimizer inline
every intermediate into the next and the plan explodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lambert-93 on GRS80 (standard parallels 44 and 49 degrees,
# origin 46.5N 3E, false origin 700000 / 6600000) and the WGS84 ellipsoid.
LAMBERT_N = 0.7256077650532682
LAMBERT_C = 11754255.42609601
LAMBERT_XS = 700000.0
LAMBERT_YS = 12655612.049875995
LAMBERT_E = 0.08181919104281579
LAMBERT_LON0_DEG = 3.0
LAMBERT_ITERATIONS = 5
NOT_DIFFUSED = "[ND]"

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
VINCENTY_ITERATIONS = 4
SETTLED_M = 5_000_000.0  # metres up to which these steps are right to 0.8 mm
AZIMUTH_HALVINGS = 50  # of 180 degrees

METRES_PER_DEG_LAT = 110574.0
METRES_PER_DEG_LNG = 111320.0
BOX_MARGIN = 1.01
CELL_DEG = 0.05


def let(bindings: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Bind named intermediates once: ``body(s)`` sees them as ``s[name]``."""
    packed = F.array(F.struct(*[v.cast("double").alias(k) for k, v in bindings.items()]))
    return F.element_at(F.transform(packed, body), 1)


def lambert93_to_wgs84(x: str | Column, y: str | Column) -> Column:
    """``struct<x: lng double, y: lat double>`` from Lambert-93 text or numbers.

    NULL when ``x = '[ND]'`` or either coordinate is NULL.  Other non-numeric
    text raises under ANSI casts, as a failed ``::float8`` does.
    """
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y

    def project(s: Column) -> Column:
        latitude = F.aggregate(
            F.sequence(F.lit(1), F.lit(LAMBERT_ITERATIONS)),
            2 * F.atan(s["L"]) - F.lit(math.pi / 2),
            lambda phi, _i: 2
            * F.atan(
                F.pow((1 + LAMBERT_E * F.sin(phi)) / (1 - LAMBERT_E * F.sin(phi)), F.lit(LAMBERT_E / 2)) * s["L"]
            )
            - F.lit(math.pi / 2),
        )
        return F.struct(
            (F.lit(LAMBERT_LON0_DEG) + F.degrees(s["gamma"] / LAMBERT_N)).alias("x"),
            F.degrees(latitude).alias("y"),
        )

    def polar(p: Column) -> Column:
        return let(
            {
                "gamma": F.atan2(p["dx"], p["dy"]),
                "L": F.exp(-F.log(F.hypot(p["dx"], p["dy"]) / LAMBERT_C) / LAMBERT_N),
            },
            project,
        )

    body = let(
        {
            "dx": xc.cast("double") - F.lit(LAMBERT_XS),
            "dy": F.lit(LAMBERT_YS) - yc.cast("double"),
        },
        polar,
    )
    return F.when(xc.isNull() | yc.isNull() | (xc.cast("string") == F.lit(NOT_DIFFUSED)), F.lit(None)).otherwise(
        body
    )


def _arc_length(ca: Column, cm: Column, ss: Column, cs: Column, sg: Column) -> Column:
    """Metres of a geodesic from its squared cosine at the equator, the cosine
    of twice its middle, and the sine, cosine and size of its arc."""
    u2 = ca * F.lit((WGS84_A * WGS84_A - WGS84_B * WGS84_B) / (WGS84_B * WGS84_B))
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    last = big_b / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)
    dsig = big_b * ss * (cm + big_b / 4 * (cs * (-1 + 2 * cm * cm) - last))
    return F.lit(WGS84_B) * big_a * (sg - dsig)


def geodesic_by_azimuth(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in metres for any pair, antipodes included.

    The pair is mirrored so that the first point is the one farther from the
    equator and lies south.  The longitude that a geodesic has covered when it
    arrives, northbound, at the second latitude then grows with its azimuth at
    the first point, so halving the azimuths finds the one that ends there.
    """
    f = WGS84_F

    def place(p: Column) -> Column:
        first_farther = F.abs(p["lat1"]) >= F.abs(p["lat2"])
        far, near = F.when(first_farther, p["lat1"]).otherwise(p["lat2"]), F.when(first_farther, p["lat2"]).otherwise(p["lat1"])
        south, north = F.radians(-F.abs(far)), F.radians(F.when(far > 0, -near).otherwise(near))
        reduced = {k: F.atan((1 - f) * F.tan(v)) for k, v in (("u1", south), ("u2", north))}
        apart = F.abs(F.pmod(p["lng2"] - p["lng1"] + 180, F.lit(360.0)) - 180)
        return let({**reduced, "L": F.radians(apart)}, sides)

    def sides(p: Column) -> Column:
        # just south of the equator, where a start on it has no side
        return let({"s1": F.least(F.sin(p["u1"]), F.lit(-1e-200)), "c1": F.cos(p["u1"]), "s2": F.sin(p["u2"]), "L": p["L"]}, search)

    def arrival(s: Column, azimuth: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of the arc with this azimuth: longitude ``lam`` and the parts of its length."""

        def toward(p: Column) -> Column:
            x2 = F.sqrt(F.greatest(p["x1"] * p["x1"] + (s["s1"] - s["s2"]) * (s["s1"] + s["s2"]), F.lit(0.0)))
            return let({"x1": p["x1"], "sa": p["sa"], "x2": x2}, angles)

        def angles(p: Column) -> Column:
            spherical = F.atan2(p["sa"] * s["s2"], p["x2"]) - F.atan2(p["sa"] * s["s1"], p["x1"])
            return let({"g1": F.atan2(s["s1"], p["x1"]), "g2": F.atan2(s["s2"], p["x2"]), "om": spherical, "sa": p["sa"], "ca": 1 - p["sa"] * p["sa"]}, arc)

        def arc(p: Column) -> Column:
            sg = p["g2"] - p["g1"]
            c = F.lit(f / 16) * p["ca"] * (4 + f * (4 - 3 * p["ca"]))
            return let({"om": p["om"], "sa": p["sa"], "ca": p["ca"], "c": c, "sg": sg, "ss": F.sin(sg), "cs": F.cos(sg), "cm": F.cos(p["g1"] + p["g2"])}, ended)

        def ended(p: Column) -> Column:
            more = p["sg"] + p["c"] * p["ss"] * (p["cm"] + p["c"] * p["cs"] * (-1 + 2 * p["cm"] * p["cm"]))
            lam = p["om"] - (1 - p["c"]) * f * p["sa"] * more
            return let({"lam": lam, **{k: p[k] for k in ("ca", "cm", "ss", "cs", "sg")}}, use)

        return let({"x1": F.cos(azimuth) * s["c1"], "sa": F.sin(azimuth) * s["c1"]}, toward)

    def search(s: Column) -> Column:
        def halve(acc: Column, _i: Column) -> Column:
            middle = (acc["low"] + acc["high"]) / 2
            short = arrival(s, middle, lambda a: (a["lam"] < s["L"]).cast("double")) > 0
            return F.struct(F.when(short, middle).otherwise(acc["low"]).alias("low"), F.when(short, acc["high"]).otherwise(middle).alias("high"))

        all_ = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi).alias("high"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(AZIMUTH_HALVINGS)), all_, halve, lambda acc: (acc["low"] + acc["high"]) / 2)
        return arrival(s, found, lambda a: _arc_length(a["ca"], a["cm"], a["ss"], a["cs"], a["sg"]))

    return let({"lng1": lng1, "lat1": lat1, "lng2": lng2, "lat2": lat2}, place)


def geodesic_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in metres.

    Identical points give 0.  NULL in, NULL out.
    """
    f, a, b = WGS84_F, WGS84_A, WGS84_B

    def iterate(s: Column) -> Column:
        # s: L, su1, cu1, su2, cu2 (reduced latitudes)
        def step(acc: Column, _i: Column) -> Column:
            def with_trig(t: Column) -> Column:
                def with_sigma(g: Column) -> Column:
                    def with_alpha(h: Column) -> Column:
                        c = F.lit(f / 16) * h["ca"] * (4 + f * (4 - 3 * h["ca"]))
                        lam = s["L"] + (1 - c) * f * h["sa"] * (
                            g["sg"]
                            + c * g["ss"] * (h["cm"] + c * g["cs"] * (-1 + 2 * h["cm"] * h["cm"]))
                        )
                        return F.struct(
                            lam.alias("lam"),
                            g["ss"].alias("ss"),
                            g["cs"].alias("cs"),
                            g["sg"].alias("sg"),
                            h["ca"].alias("ca"),
                            h["cm"].alias("cm"),
                        )

                    sa = F.when(g["ss"] == 0, F.lit(0.0)).otherwise(s["cu1"] * s["cu2"] * t["sl"] / g["ss"])
                    return let({"sa": sa}, lambda sa_s: let(
                        {
                            "sa": sa_s["sa"],
                            "ca": 1 - sa_s["sa"] * sa_s["sa"],
                        },
                        lambda h1: let(
                            {
                                "sa": h1["sa"],
                                "ca": h1["ca"],
                                "cm": F.when(h1["ca"] == 0, F.lit(0.0)).otherwise(
                                    g["cs"] - 2 * s["su1"] * s["su2"] / h1["ca"]
                                ),
                            },
                            with_alpha,
                        ),
                    ))

                ss = F.sqrt(
                    F.pow(s["cu2"] * t["sl"], 2) + F.pow(s["cu1"] * s["su2"] - s["su1"] * s["cu2"] * t["cl"], 2)
                )
                cs = s["su1"] * s["su2"] + s["cu1"] * s["cu2"] * t["cl"]
                return let({"ss": ss, "cs": cs, "sg": F.atan2(ss, cs)}, with_sigma)

            return let({"sl": F.sin(acc["lam"]), "cl": F.cos(acc["lam"])}, with_trig)

        init = F.struct(
            s["L"].alias("lam"),
            F.lit(0.0).alias("ss"),
            F.lit(0.0).alias("cs"),
            F.lit(0.0).alias("sg"),
            F.lit(0.0).alias("ca"),
            F.lit(0.0).alias("cm"),
        )

        def finish(r: Column) -> Column:
            return _arc_length(r["ca"], r["cm"], r["ss"], r["cs"], r["sg"])

        return F.aggregate(F.sequence(F.lit(1), F.lit(VINCENTY_ITERATIONS)), init, step, finish)

    def reduced(p: Column) -> Column:
        return let(
            {
                "L": p["L"],
                "su1": F.sin(p["u1"]),
                "cu1": F.cos(p["u1"]),
                "su2": F.sin(p["u2"]),
                "cu2": F.cos(p["u2"]),
            },
            iterate,
        )

    def start(p: Column) -> Column:
        body = let(
            {
                "L": F.radians(p["lng2"] - p["lng1"]),
                "u1": F.atan((1 - f) * F.tan(F.radians(p["lat1"]))),
                "u2": F.atan((1 - f) * F.tan(F.radians(p["lat2"]))),
            },
            reduced,
        )
        far = geodesic_by_azimuth(p["lng1"], p["lat1"], p["lng2"], p["lat2"])
        settled = F.transform(F.array(body), lambda m: F.when(m > SETTLED_M, far).otherwise(m))[0]
        missing = p["lng1"].isNull() | p["lat1"].isNull() | p["lng2"].isNull() | p["lat2"].isNull()
        return F.when(missing, F.lit(None).cast("double")).otherwise(settled)

    # Inputs are bound once so that a large input expression is not repeated.
    return let({"lng1": lng1, "lat1": lat1, "lng2": lng2, "lat2": lat2}, start)


def check_radius(radius_m: float) -> None:
    if radius_m is None or radius_m < 0:
        raise ValueError("radius must be a non-negative number of metres")


def box(lng: float, lat: float, radius_m: float) -> tuple[float, float, float | None, float | None]:
    """(lat_min, lat_max, lng_min, lng_max) enclosing the radius; lng bounds
    are None when the box reaches a pole or crosses the antimeridian."""
    dlat = BOX_MARGIN * radius_m / METRES_PER_DEG_LAT
    if abs(lat) + dlat >= 89.0:
        return lat - dlat, lat + dlat, None, None
    dlng = BOX_MARGIN * radius_m / (METRES_PER_DEG_LNG * math.cos(math.radians(abs(lat) + dlat)))
    if lng - dlng < -180.0 or lng + dlng > 180.0:
        return lat - dlat, lat + dlat, None, None
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def in_box(position: Column, lng: float, lat: float, radius_m: float) -> Column:
    """Cheap predicate that keeps every point within the radius (and more)."""
    lat_min, lat_max, lng_min, lng_max = box(lng, lat, radius_m)
    pred = position["y"].between(F.lit(lat_min), F.lit(lat_max))
    if lng_min is not None:
        pred = pred & position["x"].between(F.lit(lng_min), F.lit(lng_max))
    return pred


def box_columns(lng: Column, lat: Column, radius_m: Column) -> dict[str, Column]:
    """Column form of :func:`box` for a DataFrame of query points."""
    dlat = F.lit(BOX_MARGIN) * radius_m / F.lit(METRES_PER_DEG_LAT)
    polar = F.abs(lat) + dlat >= F.lit(89.0)
    dlng = F.lit(BOX_MARGIN) * radius_m / (F.lit(METRES_PER_DEG_LNG) * F.cos(F.radians(F.abs(lat) + dlat)))
    wraps = polar | (lng - dlng < F.lit(-180.0)) | (lng + dlng > F.lit(180.0))
    return {
        "lat_min": lat - dlat,
        "lat_max": lat + dlat,
        "lng_min": F.when(wraps, F.lit(-180.0)).otherwise(lng - dlng),
        "lng_max": F.when(wraps, F.lit(180.0)).otherwise(lng + dlng),
    }


def cell(deg: Column) -> Column:
    """Grid cell index of a coordinate (0.05 degree cells)."""
    return F.floor(deg / F.lit(CELL_DEG)).cast("int")


def with_geodesic(df, lng1: Column, lat1: Column, lng2: Column, lat2: Column, out: str = "meter_distance"):
    """DataFrame form of :func:`geodesic_m` for hot paths (joins, scans).

    Two projections per iteration: the first binds ``sin(lambda)``,
    ``sin(sigma)`` and ``cos(sigma)`` as columns, the second derives the rest
    inline from them (Spark's subexpression elimination evaluates shared
    pieces once).  Columns referenced several times are not inlined by the
    optimizer, so the plan stays linear, every projection is compiled, and
    the generated code stays small enough for the JIT (higher-order
    functions, as in :func:`geodesic_m`, are evaluated interpreted; a long
    chain of tiny projections fuses into one method too large to JIT).
    Pairs beyond ``SETTLED_M`` take :func:`geodesic_by_azimuth` (interpreted,
    those rows alone).  Their distance passes a one-element ``explode``, which
    the others skip as a null (handing every row's distance through it took four
    times as long as the steps): what uses the result later (filters, orderings,
    unions) reads two columns, and neither goes back into the chain nor carries
    copies of the azimuth search.
    Steps are SQL text: one JVM call per projection instead of one per operator.
    """
    f, a, b = repr(WGS84_F), WGS84_A, repr(WGS84_B)
    keep = list(df.columns)
    p = "_vg_"
    df = df.select("*", lng1.alias(p + "lng1"), lat1.alias(p + "lat1"), lng2.alias(p + "lng2"), lat2.alias(p + "lat2"))

    def reduced(lat: str) -> str:
        return f"atan((1 - {f}) * tan(radians({lat})))"

    steps = [[
        f"radians({p}lng2 - {p}lng1) AS {p}L",
        f"sin({reduced(p + 'lat1')}) AS {p}su1", f"cos({reduced(p + 'lat1')}) AS {p}cu1",
        f"sin({reduced(p + 'lat2')}) AS {p}su2", f"cos({reduced(p + 'lat2')}) AS {p}cu2",
    ]]
    lam = f"{p}L"
    for k in range(1, VINCENTY_ITERATIONS + 1):
        q = f"{p}{k}_"
        cl = f"cos({lam})"
        across, along = f"({p}cu2 * sin({lam}))", f"({p}cu1 * {p}su2 - {p}su1 * {p}cu2 * {cl})"
        steps.append([
            f"sin({lam}) AS {q}sl",
            f"sqrt({across} * {across} + {along} * {along}) AS {q}ss",
            f"{p}su1 * {p}su2 + {p}cu1 * {p}cu2 * {cl} AS {q}cs",
        ])
        ss, cs, sl = f"{q}ss", f"{q}cs", f"{q}sl"
        sa = f"(CASE WHEN {ss} = 0 THEN 0.0D ELSE {p}cu1 * {p}cu2 * {sl} / {ss} END)"
        ca = f"(1 - {sa} * {sa})"
        cm = f"(CASE WHEN {ca} = 0 THEN 0.0D ELSE {cs} - 2 * {p}su1 * {p}su2 / {ca} END)"
        kc = f"({repr(WGS84_F / 16)} * {ca} * (4 + {f} * (4 - 3 * {ca})))"
        sg = f"atan2({ss}, {cs})"
        steps.append([
            f"{sg} AS {q}sg", f"{ca} AS {q}ca", f"{cm} AS {q}cm",
            f"{p}L + (1 - {kc}) * {f} * {sa} * ({sg} + {kc} * {ss} * ({cm} + {kc} * {cs} * (-1 + 2 * {cm} * {cm}))) AS {q}lam",
        ])
        lam = f"{q}lam"
    z = f"{p}{VINCENTY_ITERATIONS}_"
    for exprs in steps:
        df = df.selectExpr("*", *exprs)
    usq = f"({z}ca * {repr((a * a - WGS84_B * WGS84_B) / (WGS84_B * WGS84_B))})"
    big_a = f"(1 + {usq} / 16384 * (4096 + {usq} * (-768 + {usq} * (320 - 175 * {usq}))))"
    big_b = f"({usq} / 1024 * (256 + {usq} * (-128 + {usq} * (74 - 47 * {usq}))))"
    dsig = (f"{big_b} * {z}ss * ({z}cm + {big_b} / 4 * ({z}cs * (-1 + 2 * {z}cm * {z}cm) - {big_b} / 6 * {z}cm * "
            f"(-3 + 4 * {z}ss * {z}ss) * (-3 + 4 * {z}cm * {z}cm)))")
    dist = (f"CASE WHEN {p}lng1 IS NULL OR {p}lat1 IS NULL OR {p}lng2 IS NULL OR {p}lat2 IS NULL THEN CAST(NULL AS DOUBLE) "
            f"ELSE {b} * {big_a} * ({z}sg - ({dsig})) END AS {p}dist")
    ends, rest = [f"{p}{x}" for x in ("lng1", "lat1", "lng2", "lat2")], [x for x in keep if x != out]
    df = df.select(*[F.col(x) for x in rest], *ends, F.expr(dist))
    far = geodesic_by_azimuth(*[F.col(x) for x in ends])
    searched = F.explode_outer(F.when(F.col(p + "dist") > SETTLED_M, F.array(far))).alias(p + "far")
    return df.select(*rest, p + "dist", searched).select(*rest, F.coalesce(p + "far", p + "dist").alias(out))
