from firmament.operators import lookup as LK


def tables(spark):
    est = spark.createDataFrame(
        [(11, 1, True), (12, 1, False), (13, 1, True), (21, 2, False), (31, 3, True)],
        "siret long, unit_id long, etablissement_siege boolean")
    units = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "unit_id long, name string")
    return est, units


def test_head_office_is_deterministic(spark):
    est, _ = tables(spark)
    assert {(r.unit_id, r.siret) for r in LK.head_office(est).collect()} == {(1, 11), (3, 31)}


def test_lookups_inner_and_not_found(spark):
    est, units = tables(spark)
    keys = spark.createDataFrame([(12,), (21,), (99,)], "siret long")
    got = LK.lookup_establishments(keys, est, units).collect()
    assert [(r.siret, r.etablissement_siege_siret) for r in got] == [(12, 11)]
    ukeys = units.select("unit_id")
    found = LK.lookup_units(ukeys, units, est)
    assert {(r.unit_id, r.nombre_etablissements) for r in found.collect()} == {(1, 3), (3, 1)}
    assert {r.unit_id for r in LK.not_found(ukeys, found, "unit_id").collect()} == {2}
    nested = {r.unit_id: r for r in LK.lookup_units_nested(ukeys, units, est).collect()}
    assert sorted(e.siret for e in nested[1].etablissements) == [11, 12, 13]
    assert nested[1].etablissement_siege.siret == 11


def test_every_nested_part_has_a_row(spark):
    est = spark.range(40).selectExpr("id AS siret", "1L AS unit_id", "id = 0 AS etablissement_siege")
    units = spark.createDataFrame([(1, "u1")], "unit_id long, name string")
    rows = LK.lookup_units_nested(units.select("unit_id"), units, est, chunk=1).collect()
    assert sorted(r.part for r in rows) == list(range(40)) and {r.parts for r in rows} == {40}
    assert any(r.etablissements == [] for r in rows)  # hashes leave some part empty
    assert sorted(e.siret for r in rows for e in r.etablissements) == list(range(40))


def test_succession_self_link_and_plan(spark):
    links = spark.createDataFrame([(1, 2), (2, 2), (1, 2), (3, 4)], "predecesseur long, successeur long")
    keys = spark.createDataFrame([(2,), (5,)], "siret long")
    out = LK.succession(keys, links)
    got = sorted((r.siret, r.predecesseur, r.successeur) for r in out.collect())
    assert got == [(2, 1, 2), (2, 1, 2), (2, 2, 2)]
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert LK.succession_one(links, 9).count() == 0


def test_validate_keys(spark):
    keys = spark.createDataFrame([("123456789",), ("12345678",), ("é2345678",), (None,)], "k string")
    assert [r.valid for r in LK.validate_keys(keys, "k", 9).collect()] == [True, False, True, False]


def test_render_json_omits_only_score_and_distance(spark):
    import json

    df = spark.createDataFrame([(1, None, None, None), (2, "x", 1.5, None)],
                               "siret long, name string, score double, meter_distance double")
    docs = [json.loads(r.json) for r in LK.render_json(df).collect()]
    assert docs[0] == {"siret": 1, "name": None}
    assert docs[1] == {"siret": 2, "name": "x", "score": 1.5}


def test_union_join_equals_or_join(spark):
    import random

    rnd = random.Random(3)
    links = spark.createDataFrame([(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(200)],
                                  "predecesseur long, successeur long")
    keys = spark.createDataFrame([(k,) for k in range(0, 30, 3)], "siret long")
    got = sorted(map(tuple, LK.succession(keys, links).select("siret", "predecesseur", "successeur").collect()))
    ks = {r.siret for r in keys.collect()}
    expect = sorted((k, r.predecesseur, r.successeur) for r in links.collect() for k in ks
                    if r.predecesseur == k or r.successeur == k)
    assert got == expect
