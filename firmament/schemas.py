"""Declared schemas of the stored registry tables, load constraints, and
``conform`` (the DataFrame form of a schema migration).

No schema is ever inferred: CSV snapshots are bound by position to these
types, and migrations are expressed as ``conform(df, target)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(cols: list[tuple[str, T.DataType, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


S, D, TS, I, B = T.StringType(), T.DateType(), T.TimestampNTZType(), T.IntegerType(), T.BooleanType()

# Column order (CSV binding order), types and nullability.
UNIT_SCHEMA = _schema([
    ("unit_id", S, False), ("statut_diffusion", S, False), ("unite_purgee", S, True), ("date_creation", D, True),
    ("sigle", S, True), ("sexe", S, True), ("prenom_1", S, True), ("prenom_2", S, True), ("prenom_3", S, True),
    ("prenom_4", S, True), ("prenom_usuel", S, True), ("pseudonyme", S, True), ("identifiant_association", S, True),
    ("tranche_effectifs", S, True), ("annee_effectifs", I, True), ("date_dernier_traitement", TS, True),
    ("nombre_periodes", I, True), ("categorie_entreprise", S, True), ("annee_categorie_entreprise", I, True),
    ("date_debut", D, True), ("etat_administratif", S, False), ("nom", S, True), ("nom_usage", S, True),
    ("denomination", S, True), ("denomination_usuelle_1", S, True), ("denomination_usuelle_2", S, True),
    ("denomination_usuelle_3", S, True), ("categorie_juridique", S, True), ("activite_principale", S, True),
    ("nomenclature_activite_principale", S, True), ("nic_siege", S, True), ("economie_sociale_solidaire", S, True),
    ("societe_mission", S, True), ("caractere_employeur", S, True), ("activite_principale_naf25", S, True),
])

ESTABLISHMENT_SCHEMA = _schema([
    ("unit_id", S, False), ("nic", S, False), ("siret", S, False), ("statut_diffusion", S, False),
    ("date_creation", D, True), ("tranche_effectifs", S, True), ("annee_effectifs", I, True),
    ("activite_principale_registre_metiers", S, True), ("date_dernier_traitement", TS, True),
    ("etablissement_siege", B, False), ("nombre_periodes", I, True), ("complement_adresse", S, True),
    ("numero_voie", S, True), ("indice_repetition", S, True), ("dernier_numero_voie", S, True),
    ("indice_repetition_dernier_numero_voie", S, True), ("type_voie", S, True), ("libelle_voie", S, True),
    ("code_postal", S, True), ("libelle_commune", S, True), ("libelle_commune_etranger", S, True),
    ("distribution_speciale", S, True), ("code_commune", S, True), ("code_cedex", S, True),
    ("libelle_cedex", S, True), ("code_pays_etranger", S, True), ("libelle_pays_etranger", S, True),
    ("identifiant_adresse", S, True), ("coordonnee_lambert_x", S, True), ("coordonnee_lambert_y", S, True),
    ("complement_adresse2", S, True), ("numero_voie_2", S, True), ("indice_repetition_2", S, True),
    ("type_voie_2", S, True), ("libelle_voie_2", S, True), ("code_postal_2", S, True),
    ("libelle_commune_2", S, True), ("libelle_commune_etranger_2", S, True), ("distribution_speciale_2", S, True),
    ("code_commune_2", S, True), ("code_cedex_2", S, True), ("libelle_cedex_2", S, True),
    ("code_pays_etranger_2", S, True), ("libelle_pays_etranger_2", S, True), ("date_debut", D, True),
    ("etat_administratif", S, False), ("enseigne_1", S, True), ("enseigne_2", S, True), ("enseigne_3", S, True),
    ("denomination_usuelle", S, True), ("activite_principale", S, True),
    ("nomenclature_activite_principale", S, True), ("caractere_employeur", S, True),
    ("activite_principale_naf25", S, True),
])

LINK_SCHEMA = _schema([
    ("siret_etablissement_predecesseur", S, False), ("siret_etablissement_successeur", S, False),
    ("date_lien_succession", D, False), ("transfert_siege", B, False), ("continuite_economique", B, False),
    ("date_dernier_traitement_lien_succession", TS, True),
])

# Bounded text lengths (characters) and table keys.
UNIT_LENGTHS = {"unit_id": 9, "statut_diffusion": 1, "etat_administratif": 1, "sexe": 4, "tranche_effectifs": 3,
                "societe_mission": 1, "caractere_employeur": 1}
ESTABLISHMENT_LENGTHS = {"unit_id": 9, "siret": 14, "statut_diffusion": 1, "etat_administratif": 1,
                         "tranche_effectifs": 3}
LINK_LENGTHS = {"siret_etablissement_predecesseur": 14, "siret_etablissement_successeur": 14}
KEYS = {"unites_legales": "unit_id", "etablissements": "siret", "liens_succession": None}

# Columns a daily upsert sets: all but the key and the newer activity code,
# which only the snapshots carry.
UNIT_SET = [c for c in UNIT_SCHEMA.names if c not in ("unit_id", "activite_principale_naf25")]
ESTABLISHMENT_SET = [c for c in ESTABLISHMENT_SCHEMA.names if c not in ("siret", "activite_principale_naf25")]


def conform(df: DataFrame, target: T.StructType, allow_unknown: bool = False) -> DataFrame:
    """Select ``target``'s columns in its order, cast each to its type, add
    missing ones as typed NULLs; raise on columns the target does not know."""
    names = {f.name for f in target.fields}
    unknown = [c for c in df.columns if c not in names]
    if unknown and not allow_unknown:
        raise ValueError(f"columns not in the target schema: {unknown}")
    cols = []
    for f in target.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def constraint_violations(df: DataFrame, schema: T.StructType, lengths: dict[str, int], key: str | None) -> DataFrame:
    """One row of violation counts: ``<col>_null`` for NOT NULL columns,
    ``<col>_too_long`` for bounded text, and ``duplicate_keys``.

    The per-column checks are one aggregate pass; key uniqueness needs a
    grouping on the key (partial counts, then a count of keys seen twice).
    """
    aggs = []
    for f in schema.fields:
        if not f.nullable:
            aggs.append(F.count_if(F.col(f.name).isNull()).alias(f"{f.name}_null"))
    for c, n in lengths.items():
        aggs.append(F.count_if(F.length(F.col(c)) > F.lit(n)).alias(f"{c}_too_long"))
    out = df.agg(*aggs)
    if key:
        dups = df.groupBy(key).count().filter(F.col("count") > 1).agg(F.count(F.lit(1)).alias("d")).scalar()
        out = out.select("*", dups.alias("duplicate_keys"))
    return out


def assert_no_violations(report: DataFrame) -> None:
    """Raise if any count in a :func:`constraint_violations` row is non-zero."""
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"load constraints violated: {bad}")
