import json

import pytest
from pyspark.sql import functions as F

from firmament.plans import landing as LD
from firmament.sources import feed as FD


def pages_of(spark, tmp_dir, docs):
    path = f"{tmp_dir}/pages"
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").coalesce(1).write.text(path)
    return FD.read_pages(spark, path)


def unit(unit_id, periods, **extra):
    rec = {FD.UNIT_KEY: unit_id, "statutDiffusionUniteLegale": "O", "periodesUniteLegale": periods}
    rec.update(extra)
    return rec


def test_unit_periods_status_purge_and_lenient_ints(spark, tmp_dir):
    recs = [
        unit("1", []),                                                              # no period: dropped
        unit("2", [{"dateFin": "2020-01-01", "dateDebut": "2019-01-01", "etatAdministratifUniteLegale": "A"}]),
        unit("3", [{"dateFin": None, "dateDebut": "2019-01-01", "etatAdministratifUniteLegale": "A",
                    "denominationUniteLegale": "one"}], unitePurgeeUniteLegale=True, anneeEffectifsUniteLegale="2019"),
        unit("4", [{"dateFin": None, "dateDebut": "2018-01-01", "etatAdministratifUniteLegale": None,
                    "denominationUniteLegale": "first"},
                   {"dateFin": None, "dateDebut": "2019-01-01", "etatAdministratifUniteLegale": "A",
                    "denominationUniteLegale": "second"}], anneeEffectifsUniteLegale=2019),
        unit("5", [{"dateFin": None, "dateDebut": None, "etatAdministratifUniteLegale": "F"}],
             anneeEffectifsUniteLegale=None),
    ]
    pages = pages_of(spark, tmp_dir, [{"header": {"curseur": "a", "curseurSuivant": "a"}, "unitesLegales": recs}])
    out = {r.unit_id: r for r in FD.flatten_units(pages).collect()}
    assert set(out) == {"3", "4", "5"}
    assert out["3"].unite_purgee == "true" and out["4"].unite_purgee == "false"
    assert out["3"].annee_effectifs == 2019 and out["4"].annee_effectifs is None and out["5"].annee_effectifs is None
    assert out["4"].denomination == "first" and out["4"].etat_administratif == "C"
    assert len(FD.flatten_units(pages).columns) == 35


def test_lenient_int_rejects_bad_text(spark, tmp_dir):
    pages = pages_of(spark, tmp_dir, [{"header": {}, "unitesLegales": [
        unit("1", [{"dateFin": None, "etatAdministratifUniteLegale": "A"}], anneeEffectifsUniteLegale="x")]}])
    with pytest.raises(Exception):
        FD.flatten_units(pages).collect()


def test_establishment_defaults_and_second_address(spark, tmp_dir):
    rec = {FD.UNIT_KEY: "1", "nic": "00001", "siret": "100001", "statutDiffusionEtablissement": "O",
           "etablissementSiege": True, "adresseEtablissement": {"codePostalEtablissement": "75001"},
           "periodesEtablissement": [{"dateFin": None, "etatAdministratifEtablissement": None}]}
    pages = pages_of(spark, tmp_dir, [{"header": {}, "etablissements": [rec]}])
    r = FD.flatten_establishments(pages).first()
    assert r.etat_administratif == "F" and r.code_postal == "75001"
    assert all(r[c] is None for c in FD.SECOND_ADDRESS_COLUMNS)
    assert len(FD.flatten_establishments(pages).columns) == 54


def test_chain_gaps(spark):
    chain = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "x", "y"), (3, "y", "z")],
                                  "seq long, curseur string, curseur_suivant string")
    got = {(r.seq, r.status) for r in FD.chain_status(chain).collect() if r.status != "ok"}
    assert got == {(1, "gap"), (3, "chain not closed")}
    ok = spark.createDataFrame([(0, "a", "b"), (1, "b", "b")], "seq long, curseur string, curseur_suivant string")
    assert FD.chain_status(ok).filter("status <> 'ok'").count() == 0


def test_reconcile_default_zero(spark, tmp_dir):
    pages = pages_of(spark, tmp_dir, [{"header": {}}])
    rows = spark.range(0)
    r = FD.reconcile(FD.headers(pages), rows).first()
    assert (r.announced, r.landed, r.complete) == (0, 0, True)


def test_reconcile_takes_a_repeated_total_once(spark, tmp_dir):
    rec = {FD.UNIT_KEY: "1"}  # without a current period: landed all the same
    pages = pages_of(spark, tmp_dir, [{"header": {"total": 2}, FD.UNIT_ARRAY: [rec]}, {"header": {"total": 2}, FD.UNIT_ARRAY: [rec]}])
    r = FD.reconcile(FD.headers(pages), FD.records(pages, FD.UNIT_ARRAY)).first()
    assert (r.announced, r.landed, r.complete) == (2, 2, True)


def test_landed_pages_are_packed(spark, tmp_dir):
    build = lambda: spark.createDataFrame([('{"header": {"curseur": "0"}}',)], "value string")
    path = LD._text_dir(spark, tmp_dir, "packed-pages", build)
    files = [f for f in spark.read.text(path).inputFiles() if "/part-" in f]
    assert files and all(f.endswith(".gz") for f in files)
    assert [r.curseur for r in FD.headers(FD.read_pages(spark, path)).collect()] == ["0"]
