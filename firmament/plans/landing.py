"""Feed pages and CSV snapshots derived from the driver's tables.

The registered ingest queries need landed input.  These builders write it
with Spark from the fixture views, under the shared checkpoint folder, the
way the downloader would land it: one JSON page per line, at most
``PAGE_SIZE`` records per page (page = key div PAGE_SIZE, so the bound holds
by key uniqueness), and CSV files with a header.

Each record carries the edge cases the parser must handle: lenient integers
as JSON strings, numbers or absent; a missing purge flag; NULL statuses;
records whose periods are all closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.sources import feed as FD
from firmament import fixtures
from firmament.session import drop_shuffles, scratch_path

# Fixed value: records per feed page.
PAGE_SIZE = 1000


def _lenient_year(key: Column, d: Column) -> Column:
    """JSON string for key % 3 = 0, JSON number for 1, absent for 2."""
    y = F.year(d).cast("string")
    return F.when(key % 3 == 0, F.parse_json(F.concat(F.lit('"'), y, F.lit('"')))).when(
        key % 3 == 1, F.parse_json(y)
    )


def _pages(records: DataFrame, key: str, array: str) -> DataFrame:
    """Group records into pages and render each page as one JSON line."""
    paged = records.withColumn("_page", F.floor(F.col(key) / PAGE_SIZE).cast("bigint"))
    last = paged.agg(F.max("_page")).scalar()
    total = records.agg(F.count(F.lit(1))).scalar()  # of the whole query, on every page
    pages = paged.groupBy("_page").agg(F.collect_list("rec").alias("recs"))
    header = F.struct(
        F.col("_page").cast("string").alias("curseur"),
        F.when(F.col("_page") == last, F.col("_page")).otherwise(F.col("_page") + 1).cast("string").alias("curseurSuivant"),
        total.cast("int").alias("total"),
    )
    return pages.select(F.to_json(F.struct(header.alias("header"), F.col("recs").alias(array))).alias("value"))


def _text_dir(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = f"{name}-path"
    cache = _text_dir.__dict__.setdefault("cache", {})
    k = (spark.sparkContext.applicationId, sf_dir, key)
    if k not in cache:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").text(path, compression="gzip")  # as pages come over the wire
        drop_shuffles(spark)
        cache[k] = path
    return cache[k]


def unit_pages(spark: SparkSession, sf_dir: str) -> str:
    """Unit feed pages from ``legal_unit``; returns the landing directory."""

    def build() -> DataFrame:
        u = fixtures.table(spark, sf_dir, "legal_unit")
        k = F.col("unit_id")
        period = lambda fin, debut, etat, denom, du1, cj, ap: F.struct(
            fin.alias("dateFin"), debut.alias("dateDebut"), etat.alias("etatAdministratifUniteLegale"),
            denom.alias("denominationUniteLegale"), du1.alias("denominationUsuelle1UniteLegale"),
            cj.alias("categorieJuridiqueUniteLegale"), ap.alias("activitePrincipaleUniteLegale"))
        none = F.lit(None).cast("string")
        old = period(F.col("date_debut"), F.col("date_creation"), F.lit("A"), F.lit("ancien nom"), none, none, none)
        cur = period(
            F.when(F.col("date_debut").isNull() | (k % 9 == 0), F.col("date_creation")),
            F.col("date_debut"),
            F.when(k % 8 != 0, F.col("etat_administratif")),
            F.col("denomination"), F.col("denomination_usuelle_1"), F.col("categorie_juridique"),
            F.col("activite_principale"),
        )
        rec = F.struct(
            k.cast("string").alias(FD.UNIT_KEY),
            F.lit("O").alias("statutDiffusionUniteLegale"),
            F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(False)).alias("unitePurgeeUniteLegale"),
            F.col("date_creation").alias("dateCreationUniteLegale"),
            _lenient_year(k, F.col("date_creation")).alias("anneeEffectifsUniteLegale"),
            F.lit(2).alias("nombrePeriodesUniteLegale"),
            F.col("categorie_entreprise").alias("categorieEntreprise"),
            F.array(old, cur).alias("periodesUniteLegale"),
        )
        return _pages(u.select("unit_id", rec.alias("rec")), "unit_id", "unitesLegales")

    return _text_dir(spark, sf_dir, "unit-pages", build)


def establishment_pages(spark: SparkSession, sf_dir: str) -> str:
    def build() -> DataFrame:
        e = fixtures.table(spark, sf_dir, "establishment")
        k = F.col("siret")
        none = F.lit(None).cast("string")

        def period(fin, debut, etat, e1, du, ap):
            return F.struct(fin.alias("dateFin"), debut.alias("dateDebut"), etat.alias("etatAdministratifEtablissement"),
                            e1.alias("enseigne1Etablissement"), du.alias("denominationUsuelleEtablissement"),
                            ap.alias("activitePrincipaleEtablissement"))

        old = period(F.col("date_debut"), F.col("date_creation"), F.lit("A"), none, none, none)
        cur = period(F.when(k % 9 == 0, F.col("date_debut")), F.col("date_debut"),
                     F.when(k % 8 != 0, F.col("etat_administratif")), F.col("enseigne_1"),
                     F.col("denomination_usuelle"), F.col("activite_principale"))
        rec = F.struct(
            F.col("unit_id").cast("string").alias(FD.UNIT_KEY),
            F.lpad((k % 100000).cast("string"), 5, "0").alias("nic"),
            k.cast("string").alias("siret"),
            F.lit("O").alias("statutDiffusionEtablissement"),
            F.col("date_creation").alias("dateCreationEtablissement"),
            _lenient_year(k, F.col("date_debut")).alias("anneeEffectifsEtablissement"),
            F.col("date_dernier_traitement").alias("dateDernierTraitementEtablissement"),
            F.col("etablissement_siege").alias("etablissementSiege"),
            F.struct(F.col("code_postal").alias("codePostalEtablissement"),
                     F.col("libelle_commune").alias("libelleCommuneEtablissement"),
                     F.col("code_commune").alias("codeCommuneEtablissement")).alias("adresseEtablissement"),
            F.array(old, cur).alias("periodesEtablissement"),
        )
        return _pages(e.select("siret", rec.alias("rec")), "siret", "etablissements")

    return _text_dir(spark, sf_dir, "establishment-pages", build)


def link_pages(spark: SparkSession, sf_dir: str) -> str:
    def build() -> DataFrame:
        s = fixtures.table(spark, sf_dir, "succession")
        rec = F.struct(
            F.col("predecesseur").cast("string").alias("siretEtablissementPredecesseur"),
            F.col("successeur").cast("string").alias("siretEtablissementSuccesseur"),
            F.col("date_lien_succession").alias("dateLienSuccession"),
            F.col("transfert_siege").alias("transfertSiege"),
            F.col("continuite_economique").alias("continuiteEconomique"),
            F.col("date_dernier_traitement").alias("dateDernierTraitementLienSuccession"),
        )
        return _pages(s.select("successeur", rec.alias("rec")), "successeur", "liensSuccession")

    return _text_dir(spark, sf_dir, "link-pages", build)
