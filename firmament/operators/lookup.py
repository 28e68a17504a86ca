"""Keyed lookups and enrichment joins (batch form of the point lookups).

The reference answers one key per request with three dependent point
queries.  Here a DataFrame of keys is joined once: each step is an inner join
(any missing part means "not found"), and misses are reported with an anti
join.  Joins carry no hint: adaptive execution broadcasts a small key list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Key lengths in bytes.
UNIT_ID_LENGTH = 9
SIRET_LENGTH = 14
NESTED_CHUNK = 1000
ROWS_PER_TASK = 100_000


def head_office(establishments: DataFrame, unit_key: str = "unit_id", key: str = "siret",
                flag: str = "etablissement_siege") -> DataFrame:
    """One head office per unit: among rows flagged as head office, the
    smallest key (the reference takes an arbitrary first row).

    ``min_by`` aggregates partially on the map side, so a unit with very many
    flagged rows never has to be sorted in one task.
    """
    cols = [c for c in establishments.columns if c != unit_key]
    picked = (
        establishments.filter(F.col(flag))
        .groupBy(unit_key)
        .agg(F.min_by(F.struct(*cols), F.col(key)).alias("_h"))
    )
    return picked.select(unit_key, "_h.*")


def lookup_establishments(keys: DataFrame, establishments: DataFrame, units: DataFrame,
                          unit_prefix: str = "unite_legale_", key: str = "siret",
                          unit_key: str = "unit_id") -> DataFrame:
    """Establishment + its unit + the unit's head-office key, inner at each step.

    Output: every establishment column, every unit column prefixed with
    ``unit_prefix`` and ``etablissement_siege_siret``.  Work is proportional
    to the key list: units and head offices are looked up only for the units
    of the found establishments.
    """
    k = keys.select(key).distinct()
    est = establishments.join(k, key, "inner")
    unit_ids = est.select(unit_key).distinct()
    u = units.join(unit_ids, unit_key, "left_semi")
    u = u.select(*[F.col(c).alias(c if c == unit_key else unit_prefix + c) for c in units.columns])
    candidates = establishments.select(unit_key, key, "etablissement_siege").join(unit_ids, unit_key, "left_semi")
    hq = head_office(candidates).select(unit_key, F.col(key).alias("etablissement_siege_siret"))
    return est.join(u, unit_key, "inner").join(hq, unit_key, "inner")


def lookup_units(keys: DataFrame, units: DataFrame, establishments: DataFrame, unit_key: str = "unit_id",
                 key: str = "siret") -> DataFrame:
    """Unit + head-office key + number of establishments; no head office → not found."""
    k = keys.select(unit_key).distinct()
    u = units.join(k, unit_key, "inner")
    mine = establishments.select(unit_key, key, "etablissement_siege").join(k, unit_key, "left_semi")
    hq = head_office(mine).select(unit_key, F.col(key).alias("etablissement_siege_siret"))
    counts = mine.groupBy(unit_key).agg(F.count(F.lit(1)).alias("nombre_etablissements"))
    return u.join(hq, unit_key, "inner").join(counts, unit_key, "left").fillna(0, ["nombre_etablissements"])


def unit_establishments(keys: DataFrame, units: DataFrame, establishments: DataFrame, unit_key: str = "unit_id",
                        key: str = "siret") -> DataFrame:
    """The establishments of found units, one row each (the scalable form of
    the nested list: a unit with millions of rows stays spread over tasks)."""
    found = lookup_units(keys, units, establishments, unit_key, key).select(unit_key)
    return establishments.join(found, unit_key, "inner")


def list_tasks(establishments: DataFrame) -> int:
    """Partitions in which lists are made, so that a task's rows don't grow with the table."""
    fixed = int(establishments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(fixed, -(-establishments.count() // ROWS_PER_TASK))


def lookup_units_nested(keys: DataFrame, units: DataFrame, establishments: DataFrame, unit_key: str = "unit_id",
                        key: str = "siret", chunk: int = NESTED_CHUNK) -> DataFrame:
    """Nested answer: unit columns, ``etablissement_siege`` struct and the
    ``etablissements`` list.

    A unit's list is split into ``parts`` parts of about ``chunk`` rows
    (``part`` is the row's, by key hash; both are on every row), so no single
    row or task has to hold the list of a giant unit.  Parts of one unit
    together hold all its establishments; each of 0 to ``parts`` - 1 has a row,
    with an empty list if the hash gives it none.
    """
    found = lookup_units(keys, units, establishments, unit_key, key)
    est = establishments.join(found.select(unit_key, "nombre_etablissements"), unit_key, "inner")
    parts = F.greatest(F.lit(1), F.ceil(F.col("nombre_etablissements") / F.lit(chunk)))
    found = found.withColumn("parts", parts)
    est = est.withColumn("part", F.pmod(F.xxhash64(F.col(key)), parts))
    est = est.repartition(list_tasks(establishments), unit_key, "part")
    cols = [c for c in establishments.columns if c != unit_key]
    lists = est.groupBy(unit_key, "part").agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("etablissements")
    )
    hq = head_office(establishments.join(found.select(unit_key), unit_key, "left_semi"), unit_key, key)
    hq = hq.select(unit_key, F.struct(*[c for c in hq.columns if c != unit_key]).alias("etablissement_siege"))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    out = found.join(hq, unit_key, "inner").join(lists, [unit_key, "part"], "left")
    listed = F.coalesce("etablissements", F.array().cast(lists.schema["etablissements"].dataType))
    return out.select(*[c for c in out.columns if c not in ("part", "etablissements")], "part", listed.alias("etablissements"))


def succession(keys: DataFrame, links: DataFrame, key: str = "siret", pred: str = "predecesseur",
               succ: str = "successeur") -> DataFrame:
    """Links touching each key on either end, as ``(key, link...)`` rows.

    ``pred = k OR succ = k`` would plan as a nested-loop join; this is two
    equi joins, the second excluding self-links so they appear once.
    """
    k = keys.select(F.col(key).alias("_k")).distinct()
    as_pred = links.join(k, F.col(pred) == F.col("_k"), "inner")
    as_succ = links.join(k, (F.col(succ) == F.col("_k")) & (F.col(pred) != F.col(succ)), "inner")
    return as_pred.unionByName(as_succ).withColumnRenamed("_k", key)


def succession_one(links: DataFrame, k, pred: str = "predecesseur", succ: str = "successeur") -> DataFrame:
    """Single-key form: a plain disjunctive filter (both ends are indexed)."""
    return links.filter((F.col(pred) == F.lit(k)) | (F.col(succ) == F.lit(k)))


def not_found(keys: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Requested keys absent from a lookup result."""
    return keys.select(key).distinct().join(result.select(key).distinct(), key, "left_anti")


def validate_keys(keys: DataFrame, key: str, length: int) -> DataFrame:
    """Adds ``valid``: the key has exactly ``length`` bytes (digits are not checked)."""
    return keys.withColumn("valid", F.coalesce(F.octet_length(F.col(key)) == F.lit(length), F.lit(False)))


def render_json(df: DataFrame, omit_if_null: tuple[str, ...] = ("score", "meter_distance"),
                alias: str = "json") -> DataFrame:
    """One JSON document per row, as the API renders it: NULL fields are kept
    (``ignoreNullFields`` is false) except ``omit_if_null`` ones, which are
    left out when NULL.  ``to_json`` drops every NULL by default."""
    opts = {"ignoreNullFields": "false"}
    omit = [c for c in omit_if_null if c in df.columns]
    base = [c for c in df.columns if c not in omit]
    out = None
    for mask in range(1 << len(omit)):
        present = [c for i, c in enumerate(omit) if mask >> i & 1]
        cond = F.lit(True)
        for i, c in enumerate(omit):
            cond = cond & (F.col(c).isNotNull() if mask >> i & 1 else F.col(c).isNull())
        doc = F.to_json(F.struct(*[F.col(c) for c in base + present]), opts)
        out = F.when(cond, doc) if out is None else out.when(cond, doc)
    return df.select(out.alias(alias) if out is not None else F.to_json(F.struct("*"), opts).alias(alias))
