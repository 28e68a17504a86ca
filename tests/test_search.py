import datetime as dt

import pytest
from pyspark.sql import functions as F

from firmament.operators import search as S

D = dt.date


def est(spark, rows):
    schema = ("siret long, unit_id long, etat_administratif string, date_creation date, date_debut date, "
              "denomination_usuelle string, enseigne_1 string, enseigne_2 string, enseigne_3 string, "
              "code_postal string, libelle_commune string, code_commune string, activite_principale string, "
              "etablissement_siege boolean, position struct<x:double,y:double>")
    df = spark.createDataFrame(rows, schema)
    from firmament.functions.text import search_text
    return df.withColumn("search_denomination", search_text("denomination_usuelle", "enseigne_1", "enseigne_2", "enseigne_3"))


def row(siret, etat="A", dc=None, dd=None, name=None, cp="75001", commune="PARIS", siege=False, pos=None):
    return (siret, siret // 10, etat, dc, dd, name, None, None, None, cp, commune, "75101", "62.01Z", siege, pos)


@pytest.fixture()
def base(spark):
    rows = [
        row(1, dc=D(2020, 1, 1), dd=D(2021, 1, 1), name="reation bakery", pos=(2.3522, 48.8566)),
        row(2, etat="F", dc=None, dd=D(2019, 1, 1), name="bakery", pos=(2.36, 48.86)),
        row(3, dc=D(2020, 1, 1), dd=None, name="garage", cp="69001", commune="LYON", siege=True, pos=(4.83, 45.76)),
        row(4, dc=D(2018, 5, 5), dd=D(2018, 5, 5), name=None, pos=None),
        row(5, etat="C", dc=D(2022, 2, 2), dd=D(2022, 2, 2), name="reatif", commune="PARIS"),
    ]
    return est(spark, rows)


def keys(df):
    return [r.siret for r in df.collect()]


def test_default_sort_date_creation_desc_nulls_last_with_key_tiebreak(base):
    out = S.search(base, S.SearchParams())
    assert keys(out) == [5, 1, 3, 4, 2]


def test_sort_asc_nulls_last(base):
    out = S.search(base, S.SearchParams(sort="date_debut", direction="asc"))
    assert keys(out) == [4, 2, 1, 5, 3]


def test_equality_filters_and_combined(base):
    assert keys(S.search(base, S.SearchParams(filters={"etat_administratif": "F"}))) == [2]
    assert keys(S.search(base, S.SearchParams(filters={"code_postal": "69001", "etablissement_siege": True}))) == [3]
    assert keys(S.search(base, S.SearchParams(filters={"code_postal": "69001", "etablissement_siege": False}))) == []


def test_status_c_is_accepted_and_unknown_rejected(base):
    assert keys(S.search(base, S.SearchParams(filters={"etat_administratif": "C"}))) == [5]
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(filters={"etat_administratif": "Z"}), S.ESTABLISHMENT)


@pytest.mark.parametrize("limit,expected", [(-5, 1), (0, 1), (1, 1), (100, 100), (101, 100), (None, 20)])
def test_limit_clamp(limit, expected):
    assert S.validate(S.SearchParams(limit=limit), S.ESTABLISHMENT).limit == expected


@pytest.mark.parametrize("offset,expected", [(-1, 0), (None, 0), (20000, 10000), (7, 7)])
def test_offset_clamp(offset, expected):
    assert S.validate(S.SearchParams(offset=offset), S.ESTABLISHMENT).offset == expected


def test_pages_concatenate_to_full_sort_and_total_is_independent_of_page(base):
    full = keys(S.search(base, S.SearchParams(limit=100)))
    pages = []
    for off in range(0, 6, 2):
        page = S.search(base, S.SearchParams(limit=2, offset=off)).collect()
        pages += [r.siret for r in page]
        assert all(r.total == 5 for r in page)
    assert pages == full
    past = S.search(base, S.SearchParams(limit=2, offset=50))
    assert past.count() == 0
    assert S.matches(base, S.SearchParams(), S.ESTABLISHMENT).count() == 5


def test_geo_parameters_all_or_none():
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(lat=1.0), S.ESTABLISHMENT)
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(lat=1.0, lng=2.0), S.ESTABLISHMENT)
    S.validate(S.SearchParams(lat=1.0, lng=2.0, radius=3.0), S.ESTABLISHMENT)


def test_sort_preconditions():
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(sort="distance"), S.ESTABLISHMENT)
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(sort="relevance"), S.ESTABLISHMENT)
    with pytest.raises(ValueError):
        S.validate(S.SearchParams(sort="distance", lat=1.0, lng=1.0, radius=1.0), S.UNIT)
    r = S.validate(S.SearchParams(q="abcd"), S.ESTABLISHMENT)
    assert (r.sort, r.direction) == ("relevance", "desc")
    r = S.validate(S.SearchParams(lat=1.0, lng=1.0, radius=5.0, sort="distance"), S.ESTABLISHMENT)
    assert r.direction == "asc"


def test_text_match_any_field_and_short_query(base):
    out = S.search(base, S.SearchParams(q="paris", sort="date_creation"))
    assert set(keys(out)) == {1, 2, 4, 5}
    assert S.search(base, S.SearchParams(q="bak")).count() == 0
    out = S.search(base, S.SearchParams(q="reati"))
    assert keys(out)[:2] == [5, 1] or set(keys(out)) >= {1, 5}
    assert all(r.score is not None and r.score > 0 for r in out.collect())


def test_radius_filter_distance_and_null_positions(base):
    out = S.search(base, S.SearchParams(lat=48.8566, lng=2.3522, radius=2000.0, sort="distance"))
    rows = out.collect()
    assert [r.siret for r in rows] == [1, 2]
    assert rows[0].meter_distance == pytest.approx(0.0, abs=1e-6)
    assert 0 < rows[1].meter_distance <= 2000.0


def test_validate_requests_batch(spark):
    req = spark.createDataFrame(
        [(1.0, 2.0, 100.0, None, "distance", "A"), (1.0, None, None, None, None, None),
         (None, None, None, None, "relevance", None), (None, None, None, "abcd", "relevance", "C"),
         (None, None, None, None, None, "Z")],
        "lat double, lng double, radius double, q string, sort string, etat_administratif string")
    v = [r.valid for r in S.validate_requests(req).collect()]
    assert v == [True, False, False, True, False]
