import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from firmament.functions import geo
from firmament.operators import geo_join as GJ
from firmament.operators import search as S


def vincenty(l1, p1, l2, p2, it=4):
    a = 6378137.0
    f = 1 / 298.257223563
    b = a * (1 - f)
    L = math.radians(l2 - l1)
    U1 = math.atan((1 - f) * math.tan(math.radians(p1)))
    U2 = math.atan((1 - f) * math.tan(math.radians(p2)))
    su1, cu1, su2, cu2 = math.sin(U1), math.cos(U1), math.sin(U2), math.cos(U2)
    lam = L
    for _ in range(it):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
        cs = su1 * su2 + cu1 * cu2 * cl
        sg = math.atan2(ss, cs)
        sa = 0 if ss == 0 else cu1 * cu2 * sl / ss
        ca = 1 - sa * sa
        cm = 0 if ca == 0 else cs - 2 * su1 * su2 / ca
        C = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = L + (1 - C) * f * sa * (sg + C * ss * (cm + C * cs * (-1 + 2 * cm * cm)))
    u2 = ca * (a * a - b * b) / (b * b)
    A = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    B = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    ds = B * ss * (cm + B / 4 * (cs * (-1 + 2 * cm * cm) - B / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
    return b * A * (sg - ds)


def test_lambert_check_value_and_nulls(spark):
    df = spark.createDataFrame([("652469.023", "6862035.259"), ("[ND]", "[ND]"), (None, "1"), ("1", None)],
                               "x string, y string")
    rows = df.select(geo.lambert93_to_wgs84("x", "y").alias("p")).collect()
    assert rows[0].p.x == pytest.approx(2.3522, abs=1e-6)
    assert rows[0].p.y == pytest.approx(48.8566, abs=1e-6)
    assert [r.p for r in rows[1:]] == [None, None, None]


def test_lambert_numeric_x_with_nd_y_raises(spark):
    df = spark.createDataFrame([("652469.0", "[ND]")], "x string, y string")
    with pytest.raises(Exception):
        df.select(geo.lambert93_to_wgs84("x", "y").alias("p")).collect()


def test_geodesic_against_python_and_identity(spark):
    pts = [(2.3522, 48.8566, 3.0, 46.5), (3.0, 46.5, 3.0, 46.5), (-1.5, 43.3, 7.2, 48.5), (55.4, -21.1, 55.5, -21.0)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    got = [r.m for r in df.select(geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()]
    for g, p in zip(got, pts):
        assert g == pytest.approx(vincenty(*p), abs=1e-6)
    assert got[1] == 0.0
    nul = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert nul.select(geo.geodesic_m(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0)).alias("m")).first().m is None


def test_radius_must_not_be_negative():
    with pytest.raises(ValueError):
        geo.check_radius(-1.0)
    geo.check_radius(6_000_000.0)


def _points(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, (rnd.uniform(1.5, 4.5), rnd.uniform(45.5, 47.5))) for i in range(400)]
    df = spark.createDataFrame(rows, "siret long, position struct<x:double,y:double>")
    return df.withColumn("cell_y", geo.cell(F.col("position.y"))).withColumn("cell_x", geo.cell(F.col("position.x")))


def test_box_plus_exact_equals_exact(spark):
    df = _points(spark)
    boxed = {r.siret for r in S.apply_radius(df, 3.0, 46.5, 40_000.0).collect()}
    exact = {r.siret for r in df.collect() if vincenty(r.position.x, r.position.y, 3.0, 46.5) <= 40_000.0}
    assert boxed == exact and exact


def test_radius_join_equals_brute_force_and_plan(spark):
    df = _points(spark)
    q = spark.createDataFrame([(1, 3.0, 46.5, 30_000.0), (2, 2.0, 46.0, 50_000.0), (3, 10.0, 10.0, 1000.0)],
                              "point_id int, lng double, lat double, radius double")
    out = GJ.radius_join(q, df)
    got = {(r.point_id, r.siret) for r in out.collect()}
    pts = df.collect()
    expect = {(pid, r.siret) for pid, lng, lat, rad in q.collect() for r in pts
              if vincenty(r.position.x, r.position.y, lng, lat) <= rad}
    assert got == expect and expect
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


def lambert_forward(lng, lat):
    """Plain-Python forward Lambert-93 (for the round-trip check)."""
    e, n, c, xs, ys = geo.LAMBERT_E, geo.LAMBERT_N, geo.LAMBERT_C, geo.LAMBERT_XS, geo.LAMBERT_YS
    phi = math.radians(lat)
    iso = math.log(math.tan(math.pi / 4 + phi / 2) * ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2))
    r = c * math.exp(-n * iso)
    gamma = n * math.radians(lng - geo.LAMBERT_LON0_DEG)
    return xs + r * math.sin(gamma), ys - r * math.cos(gamma)


def test_forward_then_inverse_is_identity(spark):
    pts = [(2.3522, 48.8566), (-4.48, 48.39), (7.75, 48.58), (9.45, 42.7), (3.0, 46.5), (-1.0, 43.5)]
    rows = [tuple(map(repr, lambert_forward(*p))) for p in pts]
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select(geo.lambert93_to_wgs84("x", "y").alias("p")).collect()
    for (lng, lat), r in zip(pts, got):
        assert r.p.x == pytest.approx(lng, abs=1e-9) and r.p.y == pytest.approx(lat, abs=1e-9)


def test_column_and_dataframe_geodesic_agree(spark):
    df = _points(spark)
    a = {r.siret: r.d for r in df.select("siret", geo.geodesic_m(F.col("position.x"), F.col("position.y"),
                                                                 F.lit(3.1), F.lit(46.4)).alias("d")).collect()}
    b = {r.siret: r.meter_distance for r in geo.with_geodesic(df, F.col("position.x"), F.col("position.y"),
                                                               F.lit(3.1), F.lit(46.4)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_radius_join_of_mixed_radii(spark):
    """1 km to 7,000 km in one join: every pair once, few cells per point."""
    df = _points(spark)
    radii = [1_000.0, 30_000.0, 400_000.0, 6_000_000.0, 7_000_000.0]
    q = spark.createDataFrame([(i, 3.0 + i / 10, 46.5, r) for i, r in enumerate(radii)] + [(9, 3.0, 89.9, 6_000_000.0)],
                              "point_id int, lng double, lat double, radius double")
    got = sorted((r.point_id, r.siret) for r in GJ.radius_join(q, df).collect())
    d = df.crossJoin(q).withColumn("d", geo.geodesic_m(F.col("position.x"), F.col("position.y"), F.col("lng"), F.col("lat")))
    assert got == sorted((r.point_id, r.siret) for r in d.filter("d <= radius").collect())
    assert max(r["count"] for r in GJ.covering_cells(q).groupBy("point_id").count().collect()) <= 64


def test_radius_join_deals_dense_cells_out_in_blocks(spark, monkeypatch):
    """A crowded cell's pairs go to many tasks; ids repeat or are null on both sides."""
    monkeypatch.setattr(GJ, "BLOCK", 10)
    monkeypatch.setattr(GJ, "TASK_PAIRS", 500)
    rows = [(i % 90 if i % 7 else None, (3.0 + (i % 60) * 0.002, 46.5 + (i % 45) * 0.002)) for i in range(300)] + [(None, None), (5, None)]
    df = spark.createDataFrame(rows, "siret long, position struct<x:double,y:double>")
    df = df.withColumn("cell_y", geo.cell(F.col("position.y"))).withColumn("cell_x", geo.cell(F.col("position.x")))
    asked = [(i % 20 if i % 3 else None, 3.0 + (i % 8) * 0.01, 46.5, 4_000.0) for i in range(50)] + [(7, 3.0, 46.5, 4_000.0)] * 2
    q = spark.createDataFrame(asked, "point_id int, lng double, lat double, radius double").coalesce(1)
    out = GJ.radius_join(q, df)
    got = sorted(((r.point_id, r.siret, r.position) for r in out.collect()), key=str)
    expect = [(pid, siret, place) for pid, lng, lat, rad in asked for siret, place in rows if place and vincenty(*place, lng, lat) <= rad]
    assert got == sorted(expect, key=str) and len(got) > 500
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_near_distances_skip_the_explode(spark):
    """A row is handed through the generator's array only for the azimuth search."""
    df = spark.createDataFrame([(3.0, 46.5, 3.1, 46.6), (3.0, 46.5, -177.0, -46.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    out = geo.with_geodesic(df, *[F.col(c) for c in "abcd"], "m")
    near, far, missing = [r.m for r in out.orderBy(F.col("m").asc_nulls_last()).collect()]
    assert near == pytest.approx(vincenty(3.0, 46.5, 3.1, 46.6), abs=1e-6) and far > geo.SETTLED_M and missing is None
    assert "Generate explode(CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()


# Published distances on WGS84 (lng, lat, lng, lat, metres): Karney's example, the test
# sets of his library, a quarter meridian four times over.
FAR = [
    (0.0, -30.0, 179.8, 29.9, 19989832.827610),
    (0.0, 0.0, 179.5, 0.5, 19936288.579),
    (0.0, 88.202499451857, 179.981022032992859592, -88.202499451857, 20003898.214),
    (0.0, 89.333123580033, 179.99295812360148422, -89.333123580032997687, 20003926.881),
    (0.0, 56.320923501171, 179.664747671772880215, -56.320923501171, 19993558.287),
    (0.0, 52.784459512564, 179.634407464943777557, -52.784459512563990912, 19991596.095),
    (0.0, 48.522876735459, 179.599720456223079643, -48.52287673545898293, 19989144.774),
    (0.0, 0.0, 180.0, 0.0, 20003931.4586),
    (12.0, 90.0, -50.0, -90.0, 20003931.4586),
]


def test_antipodes_in_both_forms(spark):
    """Published values to the millimetre, whichever way the pair is turned."""
    turned = [(c, d, a, b, m) for a, b, c, d, m in FAR] + [(-a, -b, -c, -d, m) for a, b, c, d, m in FAR] + FAR
    df = spark.createDataFrame(turned, "a double, b double, c double, d double, m double")
    ends = [F.col(c) for c in "abcd"]
    for r in geo.with_geodesic(df.withColumn("column_form", geo.geodesic_m(*ends)), *ends, "joined_form").collect():
        assert r.column_form == pytest.approx(r.m, abs=1e-3) and r.joined_form == pytest.approx(r.m, abs=1e-3), r


def test_far_pairs_against_many_steps(spark):
    """Every distance up to a degree from the antipode, and the azimuth search on pairs the steps settle."""
    import random

    rnd = random.Random(5)
    pairs = [(rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for _ in range(300)]
    pairs += [(3.0, 46.5, -177.0 + x, -46.5 + y) for x, y in ((2.0, 1.0), (-1.5, 1.5), (5.0, 0.0), (0.0, 2.0))]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    rows = df.select("*", geo.geodesic_m(*ends).alias("m"), geo.geodesic_by_azimuth(*ends).alias("searched")).collect()
    for r in rows:
        apart = (r.c - r.a + 180) % 360 - 180
        exact = vincenty(0.0, r.b, apart, r.d, it=400)
        assert r.m == pytest.approx(exact, abs=1e-3) and r.searched == pytest.approx(exact, abs=1e-3), r
