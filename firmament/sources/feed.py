"""Incremental feed pages (JSON) to table rows.

Pages land as JSON documents, one per line (``read_pages``), or one per file
(``whole_files=True``).  Each page is ``{"header": {...}, "<records>": [...]}``.
Pages are parsed once with ``parse_json`` into VARIANT, because one rule
cannot be expressed with ``from_json`` coercion: a lenient integer accepts a
JSON *string* holding a number and maps any non-string value to NULL.

Per record type the flattening is one ``explode`` + ``select``:

* the current period is the first period whose ``dateFin`` is NULL; a record
  without one is dropped;
* a NULL period status becomes ``F`` (establishments) or ``C`` (units);
* a missing ``unitePurgeeUniteLegale`` is false, stored as text;
* the 14 second-address columns of establishments are always NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record array names, status defaults, and field names of the feed.
UNIT_ARRAY = "unitesLegales"
ESTABLISHMENT_ARRAY = "etablissements"
LINK_ARRAY = "liensSuccession"
UNIT_STATUS_DEFAULT = "C"
ESTABLISHMENT_STATUS_DEFAULT = "F"

# Fixed value: the public feed's key of a legal unit's number.
UNIT_KEY = "siren"

UNIT_FIELDS = [  # (output column, feed field, type); type "lenient_int" follows the string-only rule
    ("unit_id", UNIT_KEY, "string"),
    ("statut_diffusion", "statutDiffusionUniteLegale", "string"),
    ("date_creation", "dateCreationUniteLegale", "date"),
    ("sigle", "sigleUniteLegale", "string"),
    ("sexe", "sexeUniteLegale", "string"),
    ("prenom_1", "prenom1UniteLegale", "string"),
    ("prenom_2", "prenom2UniteLegale", "string"),
    ("prenom_3", "prenom3UniteLegale", "string"),
    ("prenom_4", "prenom4UniteLegale", "string"),
    ("prenom_usuel", "prenomUsuelUniteLegale", "string"),
    ("pseudonyme", "pseudonymeUniteLegale", "string"),
    ("identifiant_association", "identifiantAssociationUniteLegale", "string"),
    ("tranche_effectifs", "trancheEffectifsUniteLegale", "string"),
    ("annee_effectifs", "anneeEffectifsUniteLegale", "lenient_int"),
    ("date_dernier_traitement", "dateDernierTraitementUniteLegale", "timestamp_ntz"),
    ("nombre_periodes", "nombrePeriodesUniteLegale", "int"),
    ("categorie_entreprise", "categorieEntreprise", "string"),
    ("annee_categorie_entreprise", "anneeCategorieEntreprise", "lenient_int"),
]
UNIT_PERIOD_FIELDS = [
    ("date_debut", "dateDebut", "date"),
    ("etat_administratif", "etatAdministratifUniteLegale", "string"),
    ("nom", "nomUniteLegale", "string"),
    ("nom_usage", "nomUsageUniteLegale", "string"),
    ("denomination", "denominationUniteLegale", "string"),
    ("denomination_usuelle_1", "denominationUsuelle1UniteLegale", "string"),
    ("denomination_usuelle_2", "denominationUsuelle2UniteLegale", "string"),
    ("denomination_usuelle_3", "denominationUsuelle3UniteLegale", "string"),
    ("categorie_juridique", "categorieJuridiqueUniteLegale", "string"),
    ("activite_principale", "activitePrincipaleUniteLegale", "string"),
    ("nomenclature_activite_principale", "nomenclatureActivitePrincipaleUniteLegale", "string"),
    ("nic_siege", "nicSiegeUniteLegale", "string"),
    ("economie_sociale_solidaire", "economieSocialeSolidaireUniteLegale", "string"),
    ("societe_mission", "societeMissionUniteLegale", "string"),
    ("caractere_employeur", "caractereEmployeurUniteLegale", "string"),
]
UNIT_COLUMNS = (
    ["unit_id", "statut_diffusion", "unite_purgee"]
    + [c for c, _, _ in UNIT_FIELDS[2:]]
    + [c for c, _, _ in UNIT_PERIOD_FIELDS]
    + ["activite_principale_naf25"]
)

ESTABLISHMENT_FIELDS = [
    ("unit_id", UNIT_KEY, "string"),
    ("nic", "nic", "string"),
    ("siret", "siret", "string"),
    ("statut_diffusion", "statutDiffusionEtablissement", "string"),
    ("date_creation", "dateCreationEtablissement", "date"),
    ("tranche_effectifs", "trancheEffectifsEtablissement", "string"),
    ("annee_effectifs", "anneeEffectifsEtablissement", "lenient_int"),
    ("activite_principale_registre_metiers", "activitePrincipaleRegistreMetiersEtablissement", "string"),
    ("date_dernier_traitement", "dateDernierTraitementEtablissement", "timestamp_ntz"),
    ("etablissement_siege", "etablissementSiege", "boolean"),
    ("nombre_periodes", "nombrePeriodesEtablissement", "int"),
]
ADDRESS_FIELDS = [
    ("complement_adresse", "complementAdresseEtablissement"),
    ("numero_voie", "numeroVoieEtablissement"),
    ("indice_repetition", "indiceRepetitionEtablissement"),
    ("dernier_numero_voie", "dernierNumeroVoieEtablissement"),
    ("indice_repetition_dernier_numero_voie", "indiceRepetitionDernierNumeroVoieEtablissement"),
    ("type_voie", "typeVoieEtablissement"),
    ("libelle_voie", "libelleVoieEtablissement"),
    ("code_postal", "codePostalEtablissement"),
    ("libelle_commune", "libelleCommuneEtablissement"),
    ("libelle_commune_etranger", "libelleCommuneEtrangerEtablissement"),
    ("distribution_speciale", "distributionSpecialeEtablissement"),
    ("code_commune", "codeCommuneEtablissement"),
    ("code_cedex", "codeCedexEtablissement"),
    ("libelle_cedex", "libelleCedexEtablissement"),
    ("code_pays_etranger", "codePaysEtrangerEtablissement"),
    ("libelle_pays_etranger", "libellePaysEtrangerEtablissement"),
    ("identifiant_adresse", "identifiantAdresseEtablissement"),
    ("coordonnee_lambert_x", "coordonneeLambertAbscisseEtablissement"),
    ("coordonnee_lambert_y", "coordonneeLambertOrdonneeEtablissement"),
]
SECOND_ADDRESS_COLUMNS = [
    "complement_adresse2", "numero_voie_2", "indice_repetition_2", "type_voie_2", "libelle_voie_2",
    "code_postal_2", "libelle_commune_2", "libelle_commune_etranger_2", "distribution_speciale_2",
    "code_commune_2", "code_cedex_2", "libelle_cedex_2", "code_pays_etranger_2", "libelle_pays_etranger_2",
]
ESTABLISHMENT_PERIOD_FIELDS = [
    ("date_debut", "dateDebut", "date"),
    ("etat_administratif", "etatAdministratifEtablissement", "string"),
    ("enseigne_1", "enseigne1Etablissement", "string"),
    ("enseigne_2", "enseigne2Etablissement", "string"),
    ("enseigne_3", "enseigne3Etablissement", "string"),
    ("denomination_usuelle", "denominationUsuelleEtablissement", "string"),
    ("activite_principale", "activitePrincipaleEtablissement", "string"),
    ("nomenclature_activite_principale", "nomenclatureActivitePrincipaleEtablissement", "string"),
    ("caractere_employeur", "caractereEmployeurEtablissement", "string"),
]
ESTABLISHMENT_COLUMNS = (
    [c for c, _, _ in ESTABLISHMENT_FIELDS]
    + [c for c, _ in ADDRESS_FIELDS]
    + SECOND_ADDRESS_COLUMNS
    + [c for c, _, _ in ESTABLISHMENT_PERIOD_FIELDS]
    + ["activite_principale_naf25"]
)

LINK_FIELDS = [
    ("siret_etablissement_predecesseur", "siretEtablissementPredecesseur", "string"),
    ("siret_etablissement_successeur", "siretEtablissementSuccesseur", "string"),
    ("date_lien_succession", "dateLienSuccession", "date"),
    ("transfert_siege", "transfertSiege", "boolean"),
    ("continuite_economique", "continuiteEconomique", "boolean"),
    ("date_dernier_traitement_lien_succession", "dateDernierTraitementLienSuccession", "timestamp_ntz"),
]


def read_pages(spark: SparkSession, path: str, whole_files: bool = False, stream: bool = False,
               files_per_batch: int | None = None) -> DataFrame:
    """Landed pages → ``(source, page variant)``; a malformed page fails.
    ``stream`` reads them as a file stream, all new files in one micro-batch
    unless ``files_per_batch`` is given."""
    reader = spark.readStream if stream else spark.read
    if whole_files:
        reader = reader.option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )
    return raw.select("source", F.parse_json("text").alias("page"))


def lenient_int(v: Column) -> Column:
    """A JSON string holding an integer → int (other text fails, ANSI);
    JSON null, absent, or any non-string value → NULL."""
    kind = F.schema_of_variant(v)
    return F.when(kind == F.lit("STRING"), F.variant_get(v, "$", "string").cast("int")).otherwise(
        F.lit(None).cast("int")
    )


def _field(rec: Column, name: str, typ: str) -> Column:
    if typ == "lenient_int":
        return lenient_int(F.variant_get(rec, f"$.{name}", "variant"))
    return F.variant_get(rec, f"$.{name}", typ)


#: Where a record was landed; after its timestamp, the order in which records of one key apply.
ORDER_COLUMNS = ["source", "curseur", "pos"]


def records(pages: DataFrame, array: str) -> DataFrame:
    """One row per record of ``array`` in every page, as a variant ``rec`` with
    :data:`ORDER_COLUMNS`: file, the page's cursor and the place in the page."""
    return pages.select(
        "source",
        F.variant_get("page", "$.header.curseur", "string").alias("curseur"),
        F.posexplode(F.variant_get("page", f"$.{array}", "array<variant>")).alias("pos", "rec"),
    )


def _ordered(ordered: bool) -> list[Column]:
    return [F.col(c) for c in ORDER_COLUMNS] if ordered else []


def current_period(periods: Column) -> Column:
    """First period whose ``dateFin`` is NULL, or NULL if none (``get`` does
    not fail on a missing index, unlike ``arr[0]`` under ANSI)."""
    return F.get(F.filter(periods, lambda p: p["dateFin"].isNull()), 0)


def _period_type(fields) -> str:
    inner = ", ".join(f"{name}: {typ}" for _, name, typ in fields)
    return f"array<struct<dateFin: date, {inner}>>"


def flatten_units(pages: DataFrame, ordered: bool = False) -> DataFrame:
    """Unit pages → unit rows (35 loaded columns, and the order columns if asked for)."""
    r = records(pages, UNIT_ARRAY)
    r = r.withColumn("_p", current_period(F.variant_get("rec", "$.periodesUniteLegale", _period_type(UNIT_PERIOD_FIELDS))))
    r = r.filter(F.col("_p").isNotNull())
    cols = [F.variant_get("rec", f"$.{UNIT_KEY}", "string").alias("unit_id"),
            F.variant_get("rec", "$.statutDiffusionUniteLegale", "string").alias("statut_diffusion"),
            F.coalesce(F.variant_get("rec", "$.unitePurgeeUniteLegale", "boolean"), F.lit(False))
            .cast("string").alias("unite_purgee")]
    cols += [_field(F.col("rec"), name, typ).alias(c) for c, name, typ in UNIT_FIELDS[2:]]
    for c, name, _ in UNIT_PERIOD_FIELDS:
        v = F.col("_p")[name]
        if c == "etat_administratif":
            v = F.coalesce(v, F.lit(UNIT_STATUS_DEFAULT))
        cols.append(v.alias(c))
    cols.append(F.lit(None).cast("string").alias("activite_principale_naf25"))
    return r.select(*cols, *_ordered(ordered))


def flatten_establishments(pages: DataFrame, ordered: bool = False) -> DataFrame:
    """Establishment pages → establishment rows (54 loaded columns, and the order columns if asked for)."""
    r = records(pages, ESTABLISHMENT_ARRAY)
    r = r.withColumn(
        "_p", current_period(F.variant_get("rec", "$.periodesEtablissement", _period_type(ESTABLISHMENT_PERIOD_FIELDS)))
    ).filter(F.col("_p").isNotNull())
    cols = [_field(F.col("rec"), name, typ).alias(c) for c, name, typ in ESTABLISHMENT_FIELDS]
    cols += [F.variant_get("rec", f"$.adresseEtablissement.{name}", "string").alias(c) for c, name in ADDRESS_FIELDS]
    cols += [F.lit(None).cast("string").alias(c) for c in SECOND_ADDRESS_COLUMNS]
    for c, name, _ in ESTABLISHMENT_PERIOD_FIELDS:
        v = F.col("_p")[name]
        if c == "etat_administratif":
            v = F.coalesce(v, F.lit(ESTABLISHMENT_STATUS_DEFAULT))
        cols.append(v.alias(c))
    cols.append(F.lit(None).cast("string").alias("activite_principale_naf25"))
    return r.select(*cols, *_ordered(ordered))


def flatten_links(pages: DataFrame, ordered: bool = False) -> DataFrame:
    """Succession pages → link rows (flat 1:1 mapping)."""
    r = records(pages, LINK_ARRAY)
    return r.select(*[_field(F.col("rec"), name, typ).alias(c) for c, name, typ in LINK_FIELDS], *_ordered(ordered))


def headers(pages: DataFrame) -> DataFrame:
    """``(source, curseur, curseur_suivant, total)`` of every page."""
    return pages.select(
        "source",
        F.variant_get("page", "$.header.curseur", "string").alias("curseur"),
        F.variant_get("page", "$.header.curseurSuivant", "string").alias("curseur_suivant"),
        F.coalesce(F.variant_get("page", "$.header.total", "int"), F.lit(0)).alias("total"),
    )


def current_period_rows(periods: DataFrame, key: str, order_cols: list[str], end_col: str = "date_fin") -> DataFrame:
    """Flat form of :func:`current_period`: per key, the first open period
    row in period order.  ``min_by`` aggregates partially, so a key with a
    huge history is not sorted in one task.  Keys without an open period
    produce no row."""
    rest = [c for c in periods.columns if c != key]
    return (
        periods.filter(F.col(end_col).isNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_p"))
        .select(key, "_p.*")
    )


def chain_status(chain: DataFrame, seq: str = "seq") -> DataFrame:
    """Every page with ``next_curseur`` and ``status`` (ok, gap, chain not
    closed): a page's successor in landing order carries the announced cursor,
    the last page points to itself.  A self join on ``seq + 1``, no window."""
    nxt = chain.select((F.col(seq) - 1).alias(seq), F.col("curseur").alias("next_curseur"))
    j = chain.join(nxt, seq, "left")
    status = (
        F.when(F.col("next_curseur").isNull() & (F.col("curseur_suivant") != F.col("curseur")), F.lit("chain not closed"))
        .when(F.col("next_curseur").isNotNull() & (F.col("next_curseur") != F.col("curseur_suivant")), F.lit("gap"))
        .otherwise(F.lit("ok"))
    )
    return j.withColumn("status", status)


def reconcile(count_headers: DataFrame, landed: DataFrame, total_col: str = "total") -> DataFrame:
    """Announced total against the records landed (:func:`records`, before any
    are dropped for want of a current period).  Every page of a chain repeats
    the total of the whole query, so the announced total is the greatest."""
    announced = count_headers.agg(F.coalesce(F.max(total_col), F.lit(0)).cast("bigint").alias("announced"))
    n = landed.agg(F.count(F.lit(1)).alias("landed")).scalar()
    return announced.select("announced", n.alias("landed"), (F.col("announced") == n).alias("complete"))
