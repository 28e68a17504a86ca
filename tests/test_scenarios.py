"""One test per WHEN/THEN search scenario of the reference specification
(establishments 1-31, legal units 32-55), on hand-made frames."""

import datetime as dt

import pytest

from firmament.functions.text import search_text
from firmament.operators import search as S

D = dt.date
P = S.SearchParams


@pytest.fixture(scope="module")
def est(spark):
    rows = []
    for i in range(1, 131):
        name = ["reation studio", "boulangerie", "garage central", None, "reatif"][i % 5]
        rows.append((i, 100 + i % 7, "A" if i % 3 else "F", D(2000 + i % 20, 1 + i % 12, 1) if i % 9 else None,
                     D(2001 + i % 19, 1, 1 + i % 27) if i % 8 else None, name, None, None, None,
                     ["75001", "69001"][i % 2], ["PARIS", "LYON", "Parisot"][i % 3], ["75101", "69381"][i % 2],
                     ["62.01Z", "10.71C"][i % 2], i % 10 == 0, (2.35 + (i % 13) * 0.01, 48.85 + (i % 11) * 0.01)))
    df = spark.createDataFrame(rows, "siret long, unit_id long, etat_administratif string, date_creation date, "
                               "date_debut date, denomination_usuelle string, enseigne_1 string, enseigne_2 string, "
                               "enseigne_3 string, code_postal string, libelle_commune string, code_commune string, "
                               "activite_principale string, etablissement_siege boolean, position struct<x:double,y:double>")
    return df.withColumn("search_denomination",
                         search_text("denomination_usuelle", "enseigne_1", "enseigne_2", "enseigne_3")).cache()


@pytest.fixture(scope="module")
def units(spark):
    rows = []
    for i in range(1, 61):
        rows.append((i, "A" if i % 4 else "C", D(1990 + i % 30, 1, 1) if i % 6 else None,
                     D(1995 + i % 25, 6, 1) if i % 5 else None, ["reation sarl", "dupont", None][i % 3],
                     None, None, None, ["62.01Z", "10.71C"][i % 2], ["5710", "5499"][i % 2], ["PME", "GE"][i % 2]))
    df = spark.createDataFrame(rows, "unit_id long, etat_administratif string, date_creation date, date_debut date, "
                               "denomination string, denomination_usuelle_1 string, denomination_usuelle_2 string, "
                               "denomination_usuelle_3 string, activite_principale string, categorie_juridique string, "
                               "categorie_entreprise string")
    return df.withColumn("search_denomination", search_text("denomination", "denomination_usuelle_1",
                                                            "denomination_usuelle_2", "denomination_usuelle_3")).cache()


def rows(df, params, entity=S.ESTABLISHMENT):
    return S.search(df, params, entity).collect()


def ordered(values, reverse=False):
    present = [v for v in values if v is not None]
    nulls = [v for v in values if v is None]
    return values == sorted(present, reverse=reverse) + nulls


def check_sort(df, params, col, reverse, entity=S.ESTABLISHMENT):
    got = rows(df, params, entity)
    assert got and ordered([r[col] for r in got], reverse)


# -- establishments ------------------------------------------------------------------------------
def e01(e):
    got = rows(e, P(q="reati"))
    assert got and all("reati" in (r.denomination_usuelle or "").lower() for r in got)
    assert all(r.score is not None for r in got)


def e02(e):
    got = rows(e, P(q="paris", limit=100))
    assert got and all("paris" in r.libelle_commune.lower() for r in got)


def e03(e):
    assert all(r.score is None for r in rows(e, P()))


def _filter(e, name, value, entity=S.ESTABLISHMENT):
    got = rows(e, P(filters={name: value}, limit=100), entity)
    base = {r[entity.key]: r[name] for r in e.collect()}
    expected = sorted(k for k, v in base.items() if v == value)
    assert got and all(base[r[entity.key]] == value for r in got)
    assert got[0].total == len(expected)


def e04(e): _filter(e, "etat_administratif", "A")
def e05(e): _filter(e, "code_postal", "75001")
def e06(e): _filter(e, "unit_id", 103)
def e07(e): _filter(e, "code_commune", "69381")
def e08(e): _filter(e, "activite_principale", "62.01Z")
def e09(e): _filter(e, "etablissement_siege", True)


def e10(e):
    got = rows(e, P(q="reati", filters={"etat_administratif": "A", "code_postal": "75001"}, limit=100))
    assert got and all(r.etat_administratif == "A" and r.code_postal == "75001" for r in got)


def e11(e):
    got = rows(e, P(lat=48.90, lng=2.40, radius=3000.0, limit=100))
    assert got and all(0 <= r.meter_distance <= 3000.0 for r in got)


def e12(e):
    with pytest.raises(ValueError):
        S.search(e, P(lat=48.9))


def e13(e):
    assert all(r.meter_distance is None for r in rows(e, P()))


def e14(e): check_sort(e, P(lat=48.9, lng=2.4, radius=5000.0, sort="distance", limit=100), "meter_distance", False)
def e15(e): check_sort(e, P(lat=48.9, lng=2.4, radius=5000.0, sort="distance", direction="desc", limit=100),
                       "meter_distance", True)
def e16(e): check_sort(e, P(q="reati", sort="relevance", limit=100), "score", True)
def e17(e): check_sort(e, P(q="reati", sort="relevance", direction="asc", limit=100), "score", False)
def e18(e): check_sort(e, P(sort="date_creation", limit=100), "date_creation", True)
def e19(e): check_sort(e, P(sort="date_creation", direction="asc", limit=100), "date_creation", False)


def e20(e):
    got = S.search(e, P(sort="date_debut", limit=100)).collect()
    keys = [r.siret for r in got]
    full = {r.siret: r.date_debut for r in e.collect()}
    assert ordered([full[k] for k in keys], True)


def e21(e):
    got = S.search(e, P(sort="date_debut", direction="asc", limit=100)).collect()
    full = {r.siret: r.date_debut for r in e.collect()}
    assert ordered([full[r.siret] for r in got], False)


def e22(e):
    assert S.page_meta(P(q="reati"))["sort"] == "relevance" and S.page_meta(P(q="reati"))["direction"] == "desc"
    check_sort(e, P(q="reati", limit=100), "score", True)


def e23(e):
    assert (S.page_meta(P())["sort"], S.page_meta(P())["direction"]) == ("date_creation", "desc")
    check_sort(e, P(limit=100), "date_creation", True)


def e24(e):
    with pytest.raises(ValueError):
        S.search(e, P(sort="distance"))


def e25(e):
    with pytest.raises(ValueError):
        S.search(e, P(sort="relevance"))


def e26(e):
    assert len(rows(e, P())) == 20


def e27(e):
    full = [r.siret for r in rows(e, P(limit=100))]
    assert [r.siret for r in rows(e, P(limit=50, offset=100))] == \
        [r.siret for r in S.search(e, P(limit=100, offset=100)).collect()][:50]
    assert [r.siret for r in rows(e, P(limit=50, offset=10))] == full[10:60]


def e28(e):
    assert len(rows(e, P(limit=200))) == 100 and S.page_meta(P(limit=200))["limit"] == 100


def e29(e):
    assert S.page_meta(P(offset=20000))["offset"] == 10000 and rows(e, P(offset=20000)) == []


def e30(e):
    got = rows(e, P(q="reati"))
    cols = set(got[0].asDict())
    assert {"siret", "unit_id", "etat_administratif", "date_creation", "denomination_usuelle", "enseigne_1",
            "enseigne_2", "enseigne_3", "code_postal", "libelle_commune", "activite_principale",
            "etablissement_siege", "total"} <= cols
    meta = S.search_meta(e, P(q="reati")).first()
    assert meta.total == got[0].total and (meta.limit, meta.offset, meta.sort, meta.direction) == (
        20, 0, "relevance", "desc")


def e31(e):
    assert rows(e, P(q="zzzzzz")) == [] and S.search_meta(e, P(q="zzzzzz")).first().total == 0


# -- legal units ---------------------------------------------------------------------------------
U = S.UNIT


def u32(u):
    got = rows(u, P(q="reation"), U)
    assert got and all("reation" in (r.denomination or "") for r in got)


def u33(u):
    assert all(r.score is None for r in rows(u, P(), U))


def u34(u): _filter(u, "etat_administratif", "C", U)
def u35(u): _filter(u, "activite_principale", "10.71C", U)
def u36(u): _filter(u, "categorie_juridique", "5710", U)
def u37(u): _filter(u, "categorie_entreprise", "GE", U)
def u38(u): _filter(u, "date_creation", D(1995, 1, 1), U)
def u39(u): _filter(u, "date_debut", D(2001, 6, 1), U)


def u40(u):
    got = rows(u, P(filters={"categorie_entreprise": "PME", "activite_principale": "62.01Z"}, limit=100), U)
    assert got and all(r.categorie_entreprise == "PME" and r.activite_principale == "62.01Z" for r in got)


def u41(u): check_sort(u, P(q="reation", sort="relevance", limit=100), "score", True, U)
def u42(u): check_sort(u, P(q="reation", sort="relevance", direction="asc", limit=100), "score", False, U)
def u43(u): check_sort(u, P(sort="date_creation", limit=100), "date_creation", True, U)
def u44(u): check_sort(u, P(sort="date_creation", direction="asc", limit=100), "date_creation", False, U)


def u45(u):
    full = {r.unit_id: r.date_debut for r in u.collect()}
    got = rows(u, P(sort="date_debut", limit=100), U)
    assert ordered([full[r.unit_id] for r in got], True)


def u46(u):
    full = {r.unit_id: r.date_debut for r in u.collect()}
    got = rows(u, P(sort="date_debut", direction="asc", limit=100), U)
    assert ordered([full[r.unit_id] for r in got], False)


def u47(u):
    assert S.validate(P(q="reation"), U).sort == "relevance"
    check_sort(u, P(q="reation", limit=100), "score", True, U)


def u48(u):
    check_sort(u, P(limit=100), "date_creation", True, U)


def u49(u):
    with pytest.raises(ValueError):
        S.search(u, P(sort="relevance"), U)


def u50(u):
    assert len(rows(u, P(), U)) == 20


def u51(u):
    full = [r.unit_id for r in rows(u, P(limit=100), U)]
    assert [r.unit_id for r in rows(u, P(limit=5, offset=7), U)] == full[7:12]


def u52(u):
    assert S.validate(P(limit=200), U).limit == 100


def u53(u):
    assert S.validate(P(offset=20000), U).offset == 10000


def u54(u):
    got = rows(u, P(q="reation"), U)
    assert {"unit_id", "etat_administratif", "date_creation", "denomination", "denomination_usuelle_1",
            "denomination_usuelle_2", "denomination_usuelle_3", "activite_principale", "categorie_juridique",
            "categorie_entreprise", "score", "total"} == set(got[0].asDict())


def u55(u):
    assert rows(u, P(q="zzzzzz"), U) == [] and S.search_meta(u, P(q="zzzzzz"), U).first().total == 0


EST = [e01, e02, e03, e04, e05, e06, e07, e08, e09, e10, e11, e12, e13, e14, e15, e16, e17, e18, e19, e20,
       e21, e22, e23, e24, e25, e26, e27, e28, e29, e30, e31]
UNITS = [u32, u33, u34, u35, u36, u37, u38, u39, u40, u41, u42, u43, u44, u45, u46, u47, u48, u49, u50, u51,
         u52, u53, u54, u55]


@pytest.mark.parametrize("scenario", EST, ids=[f.__name__ for f in EST])
def test_establishment_scenario(est, scenario):
    scenario(est)


@pytest.mark.parametrize("scenario", UNITS, ids=[f.__name__ for f in UNITS])
def test_unit_scenario(units, scenario):
    scenario(units)
