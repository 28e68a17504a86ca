"""Loaded and upserted tables: generated columns, index refresh, page order."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from firmament import schemas as SC
from firmament.operators import bm25 as BM
from firmament.operators import search as S
from firmament.plans import searchable as SB
from firmament.sources import feed as FD
from firmament.streaming import sync as SY

FULL = dict(unit_id="1", nic="1", statut_diffusion="O", etablissement_siege=False, etat_administratif="A")


def establishments(spark, rows, extra=""):
    names = SC.ESTABLISHMENT_SCHEMA.names + ([c.split()[0] for c in extra.split(",")] if extra else [])
    types = {f.name: f.dataType.simpleString() for f in SC.ESTABLISHMENT_SCHEMA.fields}
    ddl = ", ".join(f"{c} {types[c]}" for c in SC.ESTABLISHMENT_SCHEMA.names) + (f", {extra}" if extra else "")
    return spark.createDataFrame([tuple({**FULL, **r}.get(c) for c in names) for r in rows], ddl)


def snapshot(spark):
    return establishments(spark, [
        dict(siret="a", denomination_usuelle="Boulangerie Martin", coordonnee_lambert_x="700000", coordonnee_lambert_y="6600000"),
        dict(siret="b", enseigne_1="Garage du Port", coordonnee_lambert_x="[ND]", coordonnee_lambert_y="[ND]"),
        dict(siret="c"),
    ])


def day(spark):
    t = dt.datetime(2024, 1, 1)
    return establishments(spark, [
        dict(siret="b", denomination_usuelle="Fleuriste", coordonnee_lambert_x="700000", coordonnee_lambert_y="6600000",
             date_dernier_traitement=t, pos=1),
        dict(siret="b", denomination_usuelle="Boulangerie Neuve", coordonnee_lambert_x="800000",
             coordonnee_lambert_y="6600000", date_dernier_traitement=t, pos=2),
        dict(siret="d", denomination_usuelle="Boulangerie Dupont", date_dernier_traitement=t, pos=3),
    ], "pos int")


def versions(spark, tmp_dir):
    first = SB.load(snapshot(spark), S.ESTABLISHMENT, f"{tmp_dir}/v1")
    return first, SB.apply(first, day(spark), ["date_dernier_traitement", "pos"], f"{tmp_dir}/v2")


def found(version, **params):
    return [r.siret for r in SB.search(version, S.SearchParams(**params)).collect()]


def test_set_lists_are_the_full_ones():
    assert (len(SC.UNIT_SET), len(SC.ESTABLISHMENT_SET)) == (33, 52)


def test_loaded_rows_are_searchable(spark, tmp_dir):
    first, _ = versions(spark, tmp_dir)
    assert found(first, q="boulangerie") == ["a"]
    assert found(first, lat=46.5, lng=3.0, radius=1000.0) == ["a"]


def test_upserted_rows_are_searchable_at_once(spark, tmp_dir):
    _, second = versions(spark, tmp_dir)
    assert sorted(found(second, q="boulangerie")) == ["a", "b", "d"]  # changed, kept and new
    assert found(second, q="garage") == [] and found(second, q="fleuriste") == []
    rows = {r.siret: r for r in second.table.collect()}
    assert rows["b"].position.x > 4 and rows["b"].cell_x is not None and rows["b"].enseigne_1 is None
    assert rows["d"].position is None and rows["c"].search_denomination == "   "


def test_refreshed_index_equals_a_new_one(spark, tmp_dir):
    _, second = versions(spark, tmp_dir)
    built = BM.build_postings(second.table, "siret", list(S.ESTABLISHMENT.text_fields))
    for name in ("postings", "grams", "fields"):
        new, kept = getattr(built, name), getattr(second.index, name)
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, kept.select(*new.columns).collect()))


def test_refresh_handles_deleted_rows_and_equal_text(spark, tmp_dir):
    rows = spark.createDataFrame([(1, "alpha"), (2, "alphabet"), (3, None)], "k long, t string")
    index = BM.write_postings(BM.build_postings(rows, "k", ["t"]), f"{tmp_dir}/i1")
    after = BM.refresh_postings(index, rows.filter("k <> 3"), rows.filter("k = 1"), "k", ["t"], f"{tmp_dir}/i2")
    assert {r.key for r in after.postings.collect()} == {1}
    assert spark.read.parquet(f"{tmp_dir}/i2/changed").count() == 1
    assert after.fields.first().n == 2


def test_read_gives_the_written_version(spark, tmp_dir):
    _, second = versions(spark, tmp_dir)
    again = SB.read(spark, S.ESTABLISHMENT, second.path)
    assert sorted(found(again, q="boulangerie")) == ["a", "b", "d"]


def land(spark, path, pages):
    spark.createDataFrame([(p,) for p in pages], "value string").coalesce(1).write.mode("append").text(path)


LINK = ('{"siretEtablissementPredecesseur": "%s", "siretEtablissementSuccesseur": "%s", "dateLienSuccession": "2024-01-01", '
        '"transfertSiege": true, "continuiteEconomique": false, "dateDernierTraitementLienSuccession": "2024-01-02T00:00:00"}')


def test_page_and_position_order_records_of_one_key(spark, tmp_dir):
    page = '{"header": {"curseur": "%s"}, "liensSuccession": [%s]}'
    land(spark, f"{tmp_dir}/p", [page % ("x", LINK % (1, 2) + "," + LINK % (1, 3)), page % ("y", LINK % (1, 4))])
    rows = FD.flatten_links(FD.read_pages(spark, f"{tmp_dir}/p"), ordered=True).collect()
    assert sorted((r.curseur, r.pos, r.siret_etablissement_successeur) for r in rows) == [("x", 0, "2"), ("x", 1, "3"), ("y", 0, "4")]


def test_links_delivered_again_are_not_appended_again(spark, tmp_dir):
    page = '{"header": {"curseur": "*"}, "liensSuccession": [%s]}'
    root, landing, checkpoint = (f"{tmp_dir}/{n}-{uuid.uuid4().hex}" for n in ("t", "l", "c"))
    SY.init_table(spark, spark.createDataFrame([], SC.LINK_SCHEMA), root)
    land(spark, landing, [page % (LINK % (1, 2) + "," + LINK % (1, 2))])
    assert SY.sync_pages(spark, landing, root, checkpoint, "liens_succession").count() == 1
    land(spark, landing, [page % (LINK % (1, 2) + "," + LINK % (2, 3))])  # the boundary row again
    assert SY.sync_pages(spark, landing, root, checkpoint, "liens_succession").count() == 2
    # a lost checkpoint delivers everything again under ids already recorded
    assert SY.sync_pages(spark, landing, root, f"{checkpoint}-new", "liens_succession").count() == 2
    inserted = [r.inserted for r in SY.progress(spark, root).orderBy("batch_id").collect()]
    assert inserted == [1, 1]


def test_upsert_keeps_generated_columns_of_untouched_rows(spark, tmp_dir):
    from firmament.operators import merge as M

    base = spark.createDataFrame([(1, "a", "stored"), (2, "b", "stored")], "k long, v string, g string")
    delta = spark.createDataFrame([(2, "B", 1), (3, "C", 1)], "k long, v string, pos int")
    out = M.upsert(base, delta, "k", ["v"], ["pos"], generated={"g": F.concat(F.lit("of "), "v")}).result
    assert sorted(map(tuple, out.collect())) == [(1, "a", "stored"), (2, "B", "of B"), (3, "C", "of C")]
