"""Fixture views over the driver's tables.

The driver's tables are TPC-H-like; these views give them the shape of the
registry data (legal units, establishments, succession links, feed deltas,
periods).  The same SQL text runs in Spark and in DuckDB (one engine-specific
difference in ``geo_point``), so ``queries()`` and ``oracle_sql()`` share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LEGAL_UNIT = """
SELECT c_custkey AS unit_id,
       CASE WHEN c_acctbal < 1000 THEN 'C' ELSE 'A' END AS etat_administratif,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS denomination,
       CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE NULL END AS denomination_usuelle_1,
       CAST(NULL AS STRING) AS denomination_usuelle_2,
       CASE WHEN c_custkey % 4 = 0 THEN 'annexe' ELSE NULL END AS denomination_usuelle_3,
       c_mktsegment AS activite_principale,
       CAST(c_nationkey AS STRING) AS categorie_juridique,
       CASE WHEN c_acctbal > 8000 THEN 'GE' WHEN c_acctbal > 4000 THEN 'ETI' ELSE 'PME' END AS categorie_entreprise,
       d.first_day AS date_creation,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE d.last_day END AS date_debut
FROM customer
LEFT JOIN (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day, MAX(CAST(o_orderdate AS DATE)) AS last_day
           FROM orders GROUP BY o_custkey) d ON d.o_custkey = c_custkey
"""

ESTABLISHMENT = """
SELECT o.o_orderkey AS siret, o.o_custkey AS unit_id, o.o_orderstatus AS etat_administratif,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS date_creation,
       CAST(o.o_orderdate AS DATE) AS date_debut,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE p.p_name END AS denomination_usuelle,
       CASE WHEN o.o_orderkey % 4 = 0 THEN p.p_type ELSE NULL END AS enseigne_1,
       CAST(NULL AS STRING) AS enseigne_2, CAST(NULL AS STRING) AS enseigne_3,
       o.o_orderpriority AS code_postal, n.n_name AS libelle_commune,
       CAST(c.c_nationkey AS STRING) AS code_commune, c.c_mktsegment AS activite_principale,
       o.o_orderkey = h.head_key AND h.head_key IS NOT NULL AS etablissement_siege,
       o.o_orderdate AS date_dernier_traitement,
       o.o_orderkey % e.ne AS vec_id
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
CROSS JOIN (SELECT COUNT(*) AS np FROM part) k
CROSS JOIN (SELECT COUNT(*) AS ne FROM embeddings) e
JOIN part p ON p.p_partkey = o.o_orderkey % k.np
LEFT JOIN (SELECT o_custkey, MIN(o_orderkey) AS head_key FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) h
  ON h.o_custkey = o.o_custkey
"""

# Same rows as ESTABLISHMENT.  The two row counts are scalar subqueries and the
# part key is computed before the join, so Spark plans an equi (hash) join
# instead of a nested-loop join over orders x part.
ESTABLISHMENT_SPARK = """
SELECT o.o_orderkey AS siret, o.o_custkey AS unit_id, o.o_orderstatus AS etat_administratif,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS date_creation,
       CAST(o.o_orderdate AS DATE) AS date_debut,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE p.p_name END AS denomination_usuelle,
       CASE WHEN o.o_orderkey % 4 = 0 THEN p.p_type ELSE NULL END AS enseigne_1,
       CAST(NULL AS STRING) AS enseigne_2, CAST(NULL AS STRING) AS enseigne_3,
       o.o_orderpriority AS code_postal, n.n_name AS libelle_commune,
       CAST(c.c_nationkey AS STRING) AS code_commune, c.c_mktsegment AS activite_principale,
       o.o_orderkey = h.head_key AND h.head_key IS NOT NULL AS etablissement_siege,
       o.o_orderdate AS date_dernier_traitement,
       o.vec_id
FROM (SELECT *, o_orderkey % (SELECT COUNT(*) FROM part) AS part_key,
                o_orderkey % (SELECT COUNT(*) FROM embeddings) AS vec_id
      FROM orders) o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN part p ON p.p_partkey = o.part_key
LEFT JOIN (SELECT o_custkey, MIN(o_orderkey) AS head_key FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) h
  ON h.o_custkey = o.o_custkey
"""

_GEO_POINT = """
SELECT vec_id,
       CASE WHEN label = 0 THEN '[ND]' ELSE CAST(700000 + 1000000 * CAST(e0 AS DOUBLE) AS STRING) END AS coordonnee_lambert_x,
       CASE WHEN label = 0 THEN '[ND]' ELSE CAST(6600000 + 1000000 * CAST(e1 AS DOUBLE) AS STRING) END AS coordonnee_lambert_y
FROM (SELECT vec_id, label, {e0} AS e0, {e1} AS e1 FROM embeddings) t
"""
GEO_POINT_SPARK = _GEO_POINT.format(e0="element_at(embedding, 1)", e1="element_at(embedding, 2)")
GEO_POINT_DUCKDB = _GEO_POINT.format(e0="embedding[1]", e1="embedding[2]")

SHORT_TEXT = "SELECT p_partkey AS k, p_name AS t, p_type AS t2 FROM part"

SUCCESSION = """
SELECT predecesseur, successeur, date_lien_succession, transfert_siege, continuite_economique, date_dernier_traitement
FROM (SELECT LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecesseur,
             o_orderkey AS successeur, CAST(o_orderdate AS DATE) AS date_lien_succession,
             o_orderstatus = 'F' AS transfert_siege, o_orderkey % 2 = 0 AS continuite_economique,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS date_dernier_traitement
      FROM orders) t
WHERE predecesseur IS NOT NULL
"""

DELTA = """
SELECT user_id AS unit_id, event_type AS activite_principale, value, ts AS date_dernier_traitement,
       CAST(FLOOR(event_id / 1000) AS BIGINT) AS page, event_id AS pos
FROM events
"""

PERIOD = """
SELECT o_custkey AS unit_id, o_orderdate AS date_debut,
       COALESCE(LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                CASE WHEN o_custkey % 9 = 0 THEN o_orderdate ELSE NULL END) AS date_fin,
       o_orderkey, o_orderstatus AS etat_administratif
FROM orders
"""

# Update ledger derived from events: one run per event.
RUNS = """
SELECT event_id AS run_id, user_id, ts AS launched_timestamp,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'launched' ELSE 'finished' END AS status,
       CASE event_type WHEN 'view' THEN 'unites_legales' WHEN 'click' THEN 'etablissements'
                       WHEN 'purchase' THEN 'liens_succession' ELSE 'all' END AS group_type,
       CASE WHEN event_type = 'signup' THEN NULL ELSE ts + INTERVAL 1 HOUR END AS finished_timestamp,
       value
FROM events
"""

# A search request per supplier: text, radius, filters, sort, direction and
# paging in all mixtures.
REQUEST = """
SELECT s.s_suppkey AS request_id,
       CASE WHEN s.s_suppkey % 5 IN (0, 1) THEN p.p_name WHEN s.s_suppkey % 5 = 2 THEN n.n_name END AS q,
       CASE WHEN s.s_suppkey % 5 IN (1, 3) THEN CAST(46.5 + (s.s_nationkey - 12) * 0.4 AS DOUBLE) END AS lat,
       CASE WHEN s.s_suppkey % 5 IN (1, 3) THEN CAST(3.0 + (s.s_suppkey % 7 - 3) * 0.5 AS DOUBLE) END AS lng,
       CASE WHEN s.s_suppkey % 5 IN (1, 3) THEN CAST(40000 * (1 + s.s_suppkey % 6) AS DOUBLE) END AS radius,
       CASE WHEN s.s_suppkey % 3 = 0 THEN 'F' WHEN s.s_suppkey % 13 = 0 THEN 'C' END AS etat_administratif,
       CASE WHEN s.s_suppkey % 4 = 0 THEN '1-URGENT' END AS code_postal,
       CASE WHEN s.s_suppkey % 10 = 4 THEN s.s_suppkey * 3 END AS unit_id,
       CASE WHEN s.s_suppkey % 6 = 1 THEN CAST(s.s_nationkey AS STRING) END AS code_commune,
       CASE WHEN s.s_suppkey % 7 = 0 THEN 'MACHINERY' END AS activite_principale,
       CASE WHEN s.s_suppkey % 8 = 3 THEN false WHEN s.s_suppkey % 8 = 6 THEN true END AS etablissement_siege,
       CASE WHEN s.s_suppkey % 6 = 0 THEN 'date_creation' WHEN s.s_suppkey % 6 = 1 THEN 'date_debut'
            WHEN s.s_suppkey % 6 = 2 AND s.s_suppkey % 5 IN (1, 3) THEN 'distance'
            WHEN s.s_suppkey % 6 = 3 AND s.s_suppkey % 5 IN (0, 1, 2) THEN 'relevance' END AS sort,
       CASE WHEN s.s_suppkey % 4 = 1 THEN 'asc' WHEN s.s_suppkey % 4 = 2 THEN 'desc' END AS direction,
       CASE WHEN s.s_suppkey % 3 = 1 THEN 5 + s.s_suppkey % 20 WHEN s.s_suppkey % 9 = 2 THEN 1000 END AS "limit",
       CASE WHEN s.s_suppkey % 7 = 2 THEN 3 WHEN s.s_suppkey % 7 = 5 THEN 12 END AS "offset"
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN part p ON p.p_partkey = s.s_suppkey
"""

VIEWS_SPARK = {
    "legal_unit": LEGAL_UNIT,
    "establishment": ESTABLISHMENT_SPARK,
    "geo_point": GEO_POINT_SPARK,
    "short_text": SHORT_TEXT,
    "succession": SUCCESSION,
    "delta": DELTA,
    "period": PERIOD,
    "runs": RUNS,
    "request": REQUEST.replace('"', "`"),
}

VIEWS_DUCKDB = dict(VIEWS_SPARK, establishment=ESTABLISHMENT, geo_point=GEO_POINT_DUCKDB, request=REQUEST)


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the fixture views as CTEs (merging a
    leading ``WITH`` of the query itself)."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in VIEWS_DUCKDB.items())
    body = sql.lstrip()
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_registered: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str, force: bool = False) -> None:
    """Register base tables and fixture views as temp views for ``sf_dir``.

    Views are redefined when the session moves to another scale factor.
    """
    if not force and _registered.get(id(spark)) == sf_dir and spark.catalog.tableExists("period"):
        return
    _registered[id(spark)] = sf_dir
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, text in VIEWS_SPARK.items():
        spark.sql(text).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)
