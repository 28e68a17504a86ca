"""Registered queries: one per operator of the inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (or
DataFrames Spark derives from them) and has, where SQL can express it, an
oracle twin in :data:`ORACLE` that DuckDB runs over the same tables.  Output
columns are aliased identically on both sides; doubles are rounded (6 digits
for coordinates and scores, 3 for metres).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament import fixtures
from firmament.operators import derive as DV
from firmament.operators import search as S
from firmament.plans import oracle_sql as O
from firmament.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = fixtures.with_views(oracle)
        return fn

    return deco


def _round_search(df: DataFrame, entity: S.Entity) -> DataFrame:
    out = df.withColumn("score", F.round("score", 6))
    if entity.has_geo:
        out = T.flat_position(out).withColumn("meter_distance", F.round("meter_distance", 3))
    return out


def _search_query(name: str, params: S.SearchParams, entity: S.Entity = S.ESTABLISHMENT) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = T.establishments(spark, sf_dir) if entity.has_geo else T.units(spark, sf_dir)
        return _round_search(S.search(base, params, entity), entity)

    register(name, O.search_sql(params, entity))(run)


# ---------------------------------------------------------------- search (P-1, P-2, F-1, F-2, S-*, A-3, T-6)
P = S.SearchParams
_search_query("search_establishment_plain", P())
_search_query("filter_etat", P(filters={"etat_administratif": "F"}))
_search_query("filter_code_postal", P(filters={"code_postal": "1-URGENT"}, sort="date_debut", direction="asc"))
_search_query("filter_unit_id", P(filters={"unit_id": 605}, limit=100))
_search_query("filter_siege", P(filters={"etablissement_siege": True}, sort="date_creation", direction="asc"))
_search_query(
    "filter_combined",
    P(filters={"etat_administratif": "F", "code_postal": "2-HIGH", "etablissement_siege": False}, limit=50),
)
_search_query("sort_creation_desc", P(sort="date_creation", direction="desc", limit=30))
_search_query("sort_creation_asc", P(sort="date_creation", direction="asc", limit=30))
_search_query("sort_debut_desc", P(sort="date_debut", direction="desc", limit=30))
_search_query("sort_debut_asc", P(sort="date_debut", direction="asc", limit=30))
_search_query("page_offset", P(limit=150, offset=37, sort="date_debut", direction="desc"))
_search_query("search_default_sort", P(q="widget", filters={"etat_administratif": "F"}))
_search_query("search_total_text", P(q="bolt", limit=5))
_search_query("text_match_any_field", P(q="nation_1", sort="date_creation", limit=100))
_search_query("sort_distance", P(lat=46.5, lng=3.0, radius=25_000.0, sort="distance", limit=100))
_search_query(
    "search_combined",
    P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0, filters={"etablissement_siege": False}, limit=25),
)
_search_query("search_unit_plain", P(), S.UNIT)
_search_query("filter_unit_activity", P(filters={"activite_principale": "MACHINERY"}, limit=40), S.UNIT)
_search_query(
    "filter_unit_category",
    P(filters={"categorie_entreprise": "PME", "etat_administratif": "C"}, sort="date_debut", limit=40),
    S.UNIT,
)
_search_query("filter_unit_date", P(filters={"date_creation": dt.date(1995, 1, 1)}, limit=100), S.UNIT)
_search_query("search_unit_text", P(q="customer#0000001", limit=30), S.UNIT)


@register(
    "search_total",
    "SELECT count(*) AS total FROM establishment WHERE etat_administratif = 'F' AND code_commune = '3'",
)
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3: total of matches without q, as its own one-row aggregate."""
    m = S.matches(
        T.establishments(spark, sf_dir), P(filters={"etat_administratif": "F", "code_commune": "3"}), S.ESTABLISHMENT
    )
    return m.agg(F.count(F.lit(1)).alias("total"))


_META_PARAMS = P(q="gear", limit=500, offset=3)


@register(
    "search_page_meta",
    f"""WITH p AS ({O.search_sql(_META_PARAMS, S.ESTABLISHMENT)})
    SELECT 100 AS "limit", 3 AS "offset", 'relevance' AS sort, 'desc' AS direction,
           count(*) AS returned, max(total) AS total FROM p""",
)
def search_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7: the applied paging and sort echoed with the page."""
    meta = S.page_meta(_META_PARAMS)
    page = S.search(T.establishments(spark, sf_dir), _META_PARAMS)
    return page.agg(
        F.lit(meta["limit"]).alias("limit"),
        F.lit(meta["offset"]).alias("offset"),
        F.lit(meta["sort"]).alias("sort"),
        F.lit(meta["direction"]).alias("direction"),
        F.count(F.lit(1)).alias("returned"),
        F.max("total").alias("total"),
    )


# ---------------------------------------------------------------- lookups (J-1..J-4, J-7, F-5, F-7, P-3)
from firmament.operators import ledger as L  # noqa: E402
from firmament.operators import lookup as LK  # noqa: E402
from firmament.operators import merge as M  # noqa: E402
from firmament.plans import publish as PB  # noqa: E402

EST_COLS = [
    "siret", "unit_id", "etat_administratif", "date_creation", "date_debut", "denomination_usuelle", "enseigne_1",
    "enseigne_2", "enseigne_3", "code_postal", "libelle_commune", "code_commune", "activite_principale",
    "etablissement_siege", "date_dernier_traitement", "vec_id",
]
UNIT_COLS = [
    "unit_id", "etat_administratif", "denomination", "denomination_usuelle_1", "denomination_usuelle_2",
    "denomination_usuelle_3", "activite_principale", "categorie_juridique", "categorie_entreprise",
    "date_creation", "date_debut",
]
HQ_SQL = "SELECT unit_id, min(siret) AS etablissement_siege_siret FROM establishment WHERE etablissement_siege GROUP BY unit_id"


def _full_establishments(spark, sf_dir):
    """P-3: every loaded column plus position, never the search text."""
    return T.flat_position(T.establishments(spark, sf_dir).select(*EST_COLS, "position"))


@register(
    "establishment_lookup",
    f"""WITH e AS ({O.est_cte()}), k AS (SELECT DISTINCT successeur AS siret FROM succession), hq AS ({HQ_SQL})
    SELECT {", ".join("e." + c for c in EST_COLS)}, round(e.lng, 6) AS lng, round(e.lat, 6) AS lat,
           {", ".join(f"u.{c} AS unite_legale_{c}" for c in UNIT_COLS if c != "unit_id")},
           hq.etablissement_siege_siret
    FROM e JOIN k ON k.siret = e.siret JOIN legal_unit u ON u.unit_id = e.unit_id JOIN hq ON hq.unit_id = e.unit_id""",
)
def establishment_lookup(spark, sf_dir):
    keys = T.succession(spark, sf_dir).select(F.col("successeur").alias("siret"))
    units = T.units(spark, sf_dir).select(*UNIT_COLS)
    return LK.lookup_establishments(keys, _full_establishments(spark, sf_dir), units)


_UNIT_LOOKUP_SQL = f"""WITH hq AS ({HQ_SQL}), n AS (SELECT unit_id, count(*) AS nombre_etablissements FROM establishment GROUP BY unit_id)
    SELECT {", ".join("u." + c for c in UNIT_COLS)}, hq.etablissement_siege_siret,
           coalesce(n.nombre_etablissements, 0) AS nombre_etablissements
    FROM legal_unit u JOIN hq ON hq.unit_id = u.unit_id LEFT JOIN n ON n.unit_id = u.unit_id"""


@register("unit_lookup", _UNIT_LOOKUP_SQL)
def unit_lookup(spark, sf_dir):
    units = T.units(spark, sf_dir).select(*UNIT_COLS)
    return LK.lookup_units(units.select("unit_id"), units, T.establishments(spark, sf_dir))


@register(
    "unit_establishments",
    f"""WITH hq AS ({HQ_SQL})
    SELECT e.unit_id, e.siret, e.etablissement_siege, e.date_creation
    FROM establishment e JOIN legal_unit u ON u.unit_id = e.unit_id JOIN hq ON hq.unit_id = e.unit_id""",
)
def unit_establishments(spark, sf_dir):
    units = T.units(spark, sf_dir).select(*UNIT_COLS)
    est = T.establishments(spark, sf_dir)
    return LK.unit_establishments(units.select("unit_id"), units, est).select(
        "unit_id", "siret", "etablissement_siege", "date_creation"
    )


@register("unit_lookup_nested")
def unit_lookup_nested(spark, sf_dir):
    """M-9, J-2 nested form (rows-only: nested lists do not hash across engines)."""
    units = T.units(spark, sf_dir).select(*UNIT_COLS)
    est = T.establishments(spark, sf_dir).select(*EST_COLS, "position")
    return LK.lookup_units_nested(units.select("unit_id"), units, est)


@register(
    "unit_lookup_nested_rows",
    f"""WITH hq AS ({HQ_SQL}), n AS (SELECT unit_id, count(*) AS nombre_etablissements FROM establishment GROUP BY unit_id)
    SELECT e.unit_id, hq.etablissement_siege_siret, n.nombre_etablissements, e.siret, e.date_creation, e.code_postal
    FROM establishment e JOIN legal_unit u ON u.unit_id = e.unit_id JOIN hq ON hq.unit_id = e.unit_id
    JOIN n ON n.unit_id = e.unit_id""",
)
def unit_lookup_nested_rows(spark, sf_dir):
    """M-9, J-2: the nested answers taken apart again."""
    nested = unit_lookup_nested(spark, sf_dir)
    rows = nested.select("unit_id", F.col("etablissement_siege.siret").alias("etablissement_siege_siret"),
                         "nombre_etablissements", F.explode("etablissements").alias("e"))
    return rows.select("unit_id", "etablissement_siege_siret", "nombre_etablissements", "e.siret", "e.date_creation", "e.code_postal")


@register("head_office", f"SELECT unit_id, etablissement_siege_siret AS siret FROM ({HQ_SQL}) h")
def head_office(spark, sf_dir):
    return LK.head_office(T.establishments(spark, sf_dir)).select("unit_id", "siret")


SUCC_COLS = ["predecesseur", "successeur", "date_lien_succession", "transfert_siege", "continuite_economique",
             "date_dernier_traitement"]


@register("succession_lookup", "SELECT * FROM succession WHERE predecesseur = 100 OR successeur = 100")
def succession_lookup(spark, sf_dir):
    return LK.succession_one(T.succession(spark, sf_dir), 100)


@register(
    "succession_batch",
    f"""WITH k AS (SELECT DISTINCT siret FROM establishment WHERE etablissement_siege)
    SELECT k.siret, {", ".join("s." + c for c in SUCC_COLS)} FROM succession s JOIN k ON s.predecesseur = k.siret
    UNION ALL
    SELECT k.siret, {", ".join("s." + c for c in SUCC_COLS)} FROM succession s JOIN k ON s.successeur = k.siret
    WHERE s.predecesseur <> s.successeur""",
)
def succession_batch(spark, sf_dir):
    keys = T.establishments(spark, sf_dir).filter("etablissement_siege").select("siret")
    return LK.succession(keys, T.succession(spark, sf_dir))


@register(
    "lookup_not_found",
    f"SELECT u.unit_id FROM legal_unit u WHERE u.unit_id NOT IN (SELECT unit_id FROM ({HQ_SQL}) h)",
)
def lookup_not_found(spark, sf_dir):
    units = T.units(spark, sf_dir).select(*UNIT_COLS)
    found = LK.lookup_units(units.select("unit_id"), units, T.establishments(spark, sf_dir))
    return LK.not_found(units, found, "unit_id")


@register(
    "validate_keys",
    """SELECT k, coalesce(strlen(k) = 9, false) AS valid FROM (
         SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer
         UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer) t""",
)
def validate_keys(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    c = spark.table("customer")
    keys = c.select(F.col("c_custkey").cast("string").alias("k")).unionByName(
        c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("k"))
    )
    return LK.validate_keys(keys, "k", LK.UNIT_ID_LENGTH)


# ---------------------------------------------------------------- merge (M-1..M-4, M-8)
UNIT_BASE_SQL = ("SELECT *, activite_principale AS activite_principale_naf25, "
                 "CAST(NULL AS TIMESTAMP) AS date_dernier_traitement FROM legal_unit")
UNIT_BASE_COLS = UNIT_COLS + ["activite_principale_naf25", "date_dernier_traitement"]
UNIT_SET = ["activite_principale", "date_dernier_traitement"]
DEDUP_SQL = """SELECT {key}, {cols} FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date_dernier_traitement DESC NULLS LAST,
                                 page DESC, pos DESC) AS rn FROM ({src}) x) y WHERE rn = 1"""


def _unit_upsert(spark, sf_dir) -> M.Upsert:
    fixtures.register(spark, sf_dir)
    base = T.units(spark, sf_dir).select(*UNIT_COLS).withColumn(
        "activite_principale_naf25", F.col("activite_principale")
    ).withColumn("date_dernier_traitement", F.lit(None).cast("timestamp_ntz"))
    delta = spark.table("delta")
    return M.upsert(base, delta, "unit_id", UNIT_SET, ["date_dernier_traitement", "page", "pos"])


def _upsert_sql(base_sql, base_cols, key, set_cols, null_cols, delta_sql):
    sel = []
    for c in base_cols:
        if c == key:
            sel.append(f"b.{c}")
        elif c in set_cols:
            sel.append(f"CASE WHEN d.{key} IS NOT NULL THEN d.{c} ELSE b.{c} END AS {c}")
        elif c in null_cols:
            sel.append(f"CASE WHEN d.{key} IS NOT NULL THEN NULL ELSE b.{c} END AS {c}")
        else:
            sel.append(f"b.{c}")
    ins = [f"d.{c}" if (c == key or c in set_cols) else f"NULL AS {c}" for c in base_cols]
    dedup = DEDUP_SQL.format(key=key, cols=", ".join(set_cols), src=delta_sql)
    return f"""WITH b AS ({base_sql}), d AS ({dedup})
    SELECT {", ".join(sel)} FROM b LEFT JOIN d ON d.{key} = b.{key}
    UNION ALL SELECT {", ".join(ins)} FROM d WHERE d.{key} NOT IN (SELECT {key} FROM b)"""


register("upsert_legal_unit", _upsert_sql(UNIT_BASE_SQL, UNIT_BASE_COLS, "unit_id", UNIT_SET, (), "SELECT * FROM delta"))(
    lambda spark, sf_dir: _unit_upsert(spark, sf_dir).result
)

register(
    "upsert_counts",
    f"""WITH d AS ({DEDUP_SQL.format(key="unit_id", cols="activite_principale", src="SELECT * FROM delta")})
    SELECT count_if(d.unit_id NOT IN (SELECT unit_id FROM legal_unit)) AS inserted,
           count_if(d.unit_id IN (SELECT unit_id FROM legal_unit)) AS updated FROM d""",
)(lambda spark, sf_dir: _unit_upsert(spark, sf_dir).counts)

EST_BASE_COLS = EST_COLS + ["numero_voie_2"]
EST_DELTA_SQL = ("SELECT user_id * 101 AS siret, event_type AS activite_principale, ts AS date_dernier_traitement, "
                 "CAST(FLOOR(event_id / 1000) AS BIGINT) AS page, event_id AS pos FROM events")


@register(
    "upsert_establishment",
    _upsert_sql(f"SELECT {', '.join(EST_COLS)}, code_postal AS numero_voie_2 FROM establishment", EST_BASE_COLS,
                "siret", ["activite_principale", "date_dernier_traitement"], ("numero_voie_2",), EST_DELTA_SQL),
)
def upsert_establishment(spark, sf_dir):
    """M-2, M-3: last-wins dedupe, no ordering guard, second address nulled."""
    fixtures.register(spark, sf_dir)
    base = fixtures.table(spark, sf_dir, "establishment").select(*EST_COLS).withColumn(
        "numero_voie_2", F.col("code_postal")
    )
    delta = spark.sql(EST_DELTA_SQL)
    return M.upsert(base, delta, "siret", ["activite_principale", "date_dernier_traitement"],
                    ["date_dernier_traitement", "page", "pos"], null_cols=("numero_voie_2",)).result


AS_OF = dt.datetime(2001, 9, 1)
_SYNC_START_SQL = (f"SELECT CASE WHEN max(date_dernier_traitement) IS NULL THEN NULL ELSE greatest(max(date_dernier_traitement), "
                   f"TIMESTAMP '{AS_OF.isoformat(sep=' ')}' - INTERVAL 31 DAY) END FROM succession")
_DELTA_LINKS_SQL = f"SELECT * FROM succession WHERE date_dernier_traitement >= ({_SYNC_START_SQL})"


def _delta_links(spark, sf_dir):
    links = T.succession(spark, sf_dir)
    start = L.sync_start(L.high_water_mark(links, "date_dernier_traitement").scalar(), AS_OF)
    return L.incremental(links, start, "date_dernier_traitement")


register("incremental_range", _DELTA_LINKS_SQL)(_delta_links)
register("append_succession", f"SELECT * FROM succession UNION ALL {_DELTA_LINKS_SQL}")(
    lambda spark, sf_dir: M.append(T.succession(spark, sf_dir), _delta_links(spark, sf_dir))
)
register(
    "append_succession_dedup",
    f"SELECT * FROM succession UNION ALL (SELECT DISTINCT * FROM ({_DELTA_LINKS_SQL}) x EXCEPT SELECT * FROM succession)",
)(lambda spark, sf_dir: M.append(T.succession(spark, sf_dir), _delta_links(spark, sf_dir), dedupe=True))


# rows stored already, rows never seen, and each of both twice
_MIXED_LINKS_SQL = f"""SELECT * FROM ({_DELTA_LINKS_SQL}) UNION ALL SELECT * REPLACE (NOT transfert_siege AS transfert_siege) FROM ({_DELTA_LINKS_SQL})"""


@register(
    "append_succession_digest",
    f"""SELECT * FROM succession UNION ALL
    (SELECT DISTINCT * FROM ({_MIXED_LINKS_SQL} UNION ALL {_MIXED_LINKS_SQL}) x EXCEPT SELECT * FROM succession)""",
)
def append_succession_digest(spark, sf_dir):
    """M-4 on a table that stores its rows' digests."""
    links = T.succession(spark, sf_dir)
    base = T.stored(spark, sf_dir, "succession-digest",
                    lambda: links.withColumn(DV.DIGEST, DV.row_digest(links.schema)))
    delta = _delta_links(spark, sf_dir)
    mixed = delta.unionByName(delta.withColumn("transfert_siege", ~F.col("transfert_siege")))
    return M.append(base, mixed.unionByName(mixed), dedupe=True, ts_col="date_dernier_traitement").drop(DV.DIGEST)


# ---------------------------------------------------------------- publish, counts (M-5..M-7, A-1, A-2)
@register(
    "count_production",
    """SELECT 'unites_legales' AS group_type, count(unit_id) AS n FROM legal_unit
    UNION ALL SELECT 'etablissements', count(siret) FROM establishment
    UNION ALL SELECT 'liens_succession', count(*) FROM succession""",
)
def count_production(spark, sf_dir):
    u = T.units(spark, sf_dir).agg(F.lit("unites_legales").alias("group_type"), F.count("unit_id").alias("n"))
    e = fixtures.table(spark, sf_dir, "establishment").agg(
        F.lit("etablissements").alias("group_type"), F.count("siret").alias("n"))
    s = T.succession(spark, sf_dir).agg(F.lit("liens_succession").alias("group_type"), F.count(F.lit(1)).alias("n"))
    return u.unionByName(e).unionByName(s)


def _gate_sql(name, pred):
    return f"""SELECT '{name}' AS candidate, p.n AS production_count, s.n AS staging_count,
       (p.n = 0 OR NOT (s.n < p.n * 0.99 OR s.n > p.n * 1.01)) AS publish,
       CASE WHEN p.n = 0 THEN 'empty production' WHEN s.n < p.n * 0.99 THEN 'too few rows'
            WHEN s.n > p.n * 1.01 THEN 'too many rows' ELSE 'within tolerance' END AS reason
    FROM (SELECT count(siret) AS n FROM establishment) p, (SELECT count(siret) AS n FROM establishment WHERE {pred}) s"""


@register("publish_gate", _gate_sql("A", "siret % 200 <> 0") + " UNION ALL " + _gate_sql("B", "siret % 50 <> 0"))
def publish_gate(spark, sf_dir):
    prod = fixtures.table(spark, sf_dir, "establishment")
    out = []
    for name, pred in (("A", "siret % 200 <> 0"), ("B", "siret % 50 <> 0")):
        g = PB.gate(PB.row_counts(prod, prod.filter(pred), "siret"))
        out.append(g.select(F.lit(name).alias("candidate"), "production_count", "staging_count", "publish", "reason"))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- ledger (A-5..A-10, X-10, X-11, X-17, M-10..M-12)
_HWM_SQL = """SELECT 'etablissements' AS group_type, max(date_dernier_traitement) AS high_water_mark FROM establishment
    UNION ALL SELECT 'liens_succession', max(date_dernier_traitement) FROM succession
    UNION ALL SELECT 'unites_legales', max(date_dernier_traitement) FROM delta"""


def _hwm(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    parts = [
        ("etablissements", spark.table("establishment")),
        ("liens_succession", spark.table("succession")),
        ("unites_legales", spark.table("delta")),
    ]
    out = None
    for g, df in parts:
        h = L.high_water_mark(df, "date_dernier_traitement").select(F.lit(g).alias("group_type"), "high_water_mark")
        out = h if out is None else out.unionByName(h)
    return out


register("high_water_mark", _HWM_SQL)(_hwm)


@register(
    "sync_start",
    f"""SELECT group_type, strftime(greatest(high_water_mark, TIMESTAMP '{AS_OF.isoformat(sep=' ')}' - INTERVAL 31 DAY),
                                    '%Y-%m-%dT%H:%M:%S') AS sync_start FROM ({_HWM_SQL}) h""",
)
def sync_start_q(spark, sf_dir):
    h = _hwm(spark, sf_dir)
    return h.select("group_type", L.feed_timestamp(L.sync_start(F.col("high_water_mark"), AS_OF)).alias("sync_start"))


RUN_AS_OF = dt.datetime(2024, 1, 31)


@register(
    "latest_event",
    """SELECT user_id, run_id, launched_timestamp, status, group_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY launched_timestamp DESC, run_id DESC) AS rn
         FROM runs) r WHERE rn = 1""",
)
def latest_event(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs")
    return L.latest(runs, "user_id", ["launched_timestamp", "run_id"]).select(
        "user_id", "run_id", "launched_timestamp", "status", "group_type")


@register(
    "latest_purchase",
    """SELECT u.user_id, r.run_id, r.launched_timestamp FROM (SELECT DISTINCT user_id FROM runs) u
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                  ORDER BY launched_timestamp DESC, run_id DESC) AS rn FROM runs WHERE status = 'finished') x
                  WHERE rn = 1) r ON r.user_id = u.user_id""",
)
def latest_purchase(spark, sf_dir):
    """A-8: newest finished run per key; keys without one stay with NULLs."""
    runs = fixtures.table(spark, sf_dir, "runs")
    last = L.latest(runs, "user_id", ["launched_timestamp", "run_id"], where=F.col("status") == "finished")
    return runs.select("user_id").distinct().join(last.select("user_id", "run_id", "launched_timestamp"),
                                                  "user_id", "left")


@register(
    "stale_keys",
    f"""SELECT user_id, max(launched_timestamp) AS last_ts FROM runs WHERE status = 'launched' GROUP BY user_id
        HAVING max(launched_timestamp) < TIMESTAMP '{RUN_AS_OF.isoformat(sep=' ')}' - INTERVAL 1 HOUR""",
)
def stale_keys(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs").filter(F.col("status") == "launched")
    return L.stale(runs, "user_id", "launched_timestamp", RUN_AS_OF)


@register(
    "expand_groups",
    """SELECT run_id, group_type FROM runs WHERE group_type <> 'all'
       UNION ALL SELECT r.run_id, g.group_type FROM runs r,
         (VALUES ('unites_legales'), ('etablissements'), ('liens_succession')) g(group_type) WHERE r.group_type = 'all'""",
)
def expand_groups(spark, sf_dir):
    return L.expand_groups(fixtures.table(spark, sf_dir, "runs").select("run_id", "group_type"))


@register(
    "keyed_update",
    f"""SELECT group_type,
          CASE WHEN group_type = 'etablissements' THEN TIMESTAMP '{AS_OF.isoformat(sep=' ')}' ELSE high_water_mark END
            AS high_water_mark,
          coalesce(group_type = 'etablissements' AND high_water_mark IS DISTINCT FROM TIMESTAMP '{AS_OF.isoformat(sep=' ')}', false)
            AS changed
        FROM ({_HWM_SQL}) h""",
)
def keyed_update(spark, sf_dir):
    """M-10 on a ledger derived from the tables' high-water marks."""
    return L.keyed_update(_hwm(spark, sf_dir), "group_type", "etablissements", {"high_water_mark": AS_OF}).select(
        "group_type", "high_water_mark", "changed")


@register(
    "conditional_update",
    f"""SELECT run_id, user_id, launched_timestamp,
          CASE WHEN status = 'launched' THEN 'finished' ELSE status END AS status, group_type,
          CASE WHEN status = 'launched' THEN TIMESTAMP '{RUN_AS_OF.isoformat(sep=' ')}' ELSE finished_timestamp END
            AS finished_timestamp, value FROM runs""",
)
def conditional_update(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs")
    return L.conditional_update(
        runs, F.col("status") == "launched", {"finished_timestamp": RUN_AS_OF, "status": "finished"}
    )


@register("delete_where", "SELECT * FROM runs WHERE group_type IS DISTINCT FROM 'liens_succession'")
def delete_where(spark, sf_dir):
    return L.delete_where(fixtures.table(spark, sf_dir, "runs"), F.col("group_type") == "liens_succession")


# ---------------------------------------------------------------- text (P-4, P-5, X-1, T-1..T-5)
from firmament.functions import geo as G  # noqa: E402
from firmament.functions import text as TX  # noqa: E402
from firmament.operators import bm25 as BM  # noqa: E402
from firmament.operators import geo_join as GJ  # noqa: E402
from firmament.operators.util import top_k_per_group  # noqa: E402


@register(
    "search_text_establishment",
    "SELECT siret, coalesce(denomination_usuelle, '') || ' ' || coalesce(enseigne_1, '') || ' ' || "
    "coalesce(enseigne_2, '') || ' ' || coalesce(enseigne_3, '') AS search_denomination FROM establishment",
)
def search_text_establishment(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "establishment")
    return e.select("siret", TX.search_text(*T.ESTABLISHMENT_TEXT).alias("search_denomination"))


@register("search_text_unit", f"SELECT unit_id, search_denomination FROM ({O.unit_cte()}) u")
def search_text_unit(spark, sf_dir):
    return T.units(spark, sf_dir).select("unit_id", "search_denomination")


_GRAMS_SHORT_SQL = """SELECT k, field, g AS gram FROM (
    SELECT k, 't' AS field, substring(lower(t), r.i, n.n) AS g FROM short_text, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(t) - n.n + 1) r(i)
    UNION ALL
    SELECT k, 't2', substring(lower(t2), r.i, n.n) FROM short_text, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(t2) - n.n + 1) r(i)) x"""


@register("ngram_tokens", f"SELECT k, gram, count(*) AS tf FROM ({_GRAMS_SHORT_SQL}) g WHERE field = 't' GROUP BY k, gram")
def ngram_tokens(spark, sf_dir):
    st = T.short_text(spark, sf_dir).select("k", "t")
    st = BM.dealt(st, BM.shards(st, ["t"])[0], "k")
    return st.select("k", F.explode(TX.ngrams("t")).alias("gram")).groupBy("k", "gram").agg(
        F.count(F.lit(1)).alias("tf"))


@register(
    "postings_stats",
    f"""WITH g AS ({_GRAMS_SHORT_SQL}),
    p AS (SELECT field, gram, k, count(*) AS tf FROM g GROUP BY ALL),
    fs AS (SELECT 't' AS field, count(*) AS n,
                  sum(greatest(length(t) - 3, 0) + greatest(length(t) - 4, 0)) AS sum_dl FROM short_text
           UNION ALL SELECT 't2', count(*), sum(greatest(length(t2) - 3, 0) + greatest(length(t2) - 4, 0)) FROM short_text)
    SELECT p.field, p.gram, count(*) AS df, sum(p.tf) AS tf_total, fs.n, CAST(fs.sum_dl AS BIGINT) AS sum_dl
    FROM p JOIN fs ON fs.field = p.field GROUP BY p.field, p.gram, fs.n, fs.sum_dl""",
)
def postings_stats(spark, sf_dir):
    """T-4: postings, per-gram document frequency and field statistics."""
    idx = BM.build_postings(T.short_text(spark, sf_dir), "k", ["t", "t2"])
    tf_total = idx.postings.groupBy("field", "gram").agg(F.sum("tf").alias("tf_total"))
    return idx.grams.join(tf_total, ["field", "gram"]).join(idx.fields, "field").select(
        "field", "gram", "df", "tf_total", "n", F.col("sum_dl").cast("bigint").alias("sum_dl"))


def _bm25_query(name, table_fn, table_sql, key, fields, q, long_text=False):
    def run(spark, sf_dir):
        scored = BM.bm25_scan(table_fn(spark, sf_dir), fields, q)
        return scored.select(F.col(key).alias("key"), F.round("score", 6).alias("score"))

    register(name, f"SELECT key, round(score, 6) AS score FROM ({O.bm25_rel(table_sql, key, fields, q, long_text)}) s")(run)


_bm25_query("bm25_short_text", T.short_text, "SELECT * FROM short_text", "k", ["t", "t2"], "widget")
_bm25_query("bm25_documents", T.documents, "SELECT * FROM documents", "doc_id", ["text"], "retitioning", True)

BATCH_K = 10


_INDEXES: dict = {}


def _short_text_index(spark, sf_dir) -> BM.Postings:
    """The postings index of ``short_text``, built and written once per
    session (as a deployment builds it at load), then read back."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _INDEXES:
        built = BM.build_postings(T.short_text(spark, sf_dir), "k", ["t", "t2"])
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "short-text-index"))
    return _INDEXES[k]


@register(
    "search_batch",
    f"""WITH req AS (SELECT DISTINCT w AS q FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) x),
    qg AS (SELECT DISTINCT q, substring(lower(q), r.i, n.n) AS gram FROM req, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(q) - n.n + 1) r(i)),
    g AS ({_GRAMS_SHORT_SQL}),
    p AS (SELECT field, gram, k, count(*) AS tf FROM g GROUP BY ALL),
    dfx AS (SELECT field, gram, count(*) AS df FROM p GROUP BY ALL),
    dl AS (SELECT k, 't' AS field, greatest(length(t) - 3, 0) + greatest(length(t) - 4, 0) AS dl FROM short_text
           UNION ALL SELECT k, 't2', greatest(length(t2) - 3, 0) + greatest(length(t2) - 4, 0) FROM short_text),
    fs AS (SELECT field, CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS sum_dl FROM dl GROUP BY field),
    sc AS (SELECT qg.q AS query_id, p.k AS key,
                  sum(ln(1 + (fs.n - dfx.df + 0.5) / (dfx.df + 0.5)) * p.tf * 2.2
                      / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / (fs.sum_dl / fs.n)))) AS score
           FROM qg JOIN p ON p.gram = qg.gram JOIN dfx ON dfx.field = p.field AND dfx.gram = p.gram
           JOIN fs ON fs.field = p.field JOIN dl ON dl.k = p.k AND dl.field = p.field GROUP BY qg.q, p.k),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank,
                  count(*) OVER (PARTITION BY query_id) AS total FROM sc)
    SELECT query_id, key, rank, round(score, 6) AS score, total FROM rk WHERE rank <= {BATCH_K}""",
)
def search_batch(spark, sf_dir):
    """T-5, W-2: many requests at once through the postings plan."""
    fixtures.register(spark, sf_dir)
    requests = (
        spark.table("part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()
        .withColumn("query_id", F.col("q"))
    )
    scored = BM.bm25_postings(_short_text_index(spark, sf_dir), requests)
    totals = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    top = top_k_per_group(scored, ["query_id"], [F.round("score", S.SCORE_TIE_DIGITS).desc(), F.col("key").asc()], BATCH_K)
    return top.join(totals, "query_id").select("query_id", "key", "rank", F.round("score", 6).alias("score"), "total")


SEARCH_BATCH_SQL = ORACLE["search_batch"]


@register("search_topk_pruned")
def search_topk_pruned(spark, sf_dir):
    """T-3, T-5: the pages of ``search_batch``, joining only key blocks that
    can still reach a request's best."""
    from firmament.operators import topk as TK
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    requests = (
        spark.table("part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()
        .withColumn("query_id", F.col("q"))
    )
    k = (spark.sparkContext.applicationId, sf_dir, "blocked")
    if k not in _INDEXES:
        _INDEXES[k] = TK.write_blocked(_short_text_index(spark, sf_dir), scratch_path(spark, "short-text-blocks"))
    top = TK.top_k(_INDEXES[k], requests, BATCH_K)
    return top.select("query_id", "key", "rank", F.round("score", 6).alias("score"), "total")


ORACLE["search_topk_pruned"] = SEARCH_BATCH_SQL


# ---------------------------------------------------------------- geometry (P-6, X-2..X-7, F-4, J-5, J-6)
@register("lambert_to_wgs84", f"SELECT vec_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({O.geo_pos_cte()}) p")
def lambert_to_wgs84(spark, sf_dir):
    return T.flat_position(T.geo_points(spark, sf_dir).select("vec_id", "position"))


REF_LNG, REF_LAT = 3.0, 46.5


@register(
    "geodesic_distance",
    f"SELECT vec_id, round(d, 3) AS meter_distance FROM ({O.vincenty_rel(O.geo_pos_cte(), 'lng', 'lat', repr(REF_LNG), repr(REF_LAT), 'd')}) x",
)
def geodesic_distance(spark, sf_dir):
    p = T.geo_points(spark, sf_dir)
    d = G.geodesic_m(p.position["x"], p.position["y"], F.lit(REF_LNG), F.lit(REF_LAT))
    return p.select("vec_id", F.round(d, 3).alias("meter_distance"))


FAR_LNG, FAR_LAT, FAR_STEPS = -170.0, -40.0, 20  # some degrees from the points' antipodes: 20 steps settle, 4 don't


@register(
    "geodesic_far",
    f"SELECT vec_id, round(d, 2) AS meter_distance FROM ({O.vincenty_rel(O.geo_pos_cte(), 'lng', 'lat', repr(FAR_LNG), repr(FAR_LAT), 'd', FAR_STEPS)}) x",
)
def geodesic_far(spark, sf_dir):
    """X-6: distances to the other side of the Earth, where the azimuth is searched."""
    p = T.geo_points(spark, sf_dir)
    d = G.with_geodesic(p, p.position["x"], p.position["y"], F.lit(FAR_LNG), F.lit(FAR_LAT), "d")
    return d.select("vec_id", F.round("d", 2).alias("meter_distance"))


@register(
    "radius_search",
    f"""SELECT siret, round(meter_distance, 3) AS meter_distance
    FROM ({O.vincenty_rel(O.est_cte(), 'lng', 'lat', repr(REF_LNG), repr(REF_LAT), 'meter_distance')}) x
    WHERE meter_distance <= 150000.0""",
)
def radius_search(spark, sf_dir):
    e = T.establishments(spark, sf_dir)
    return S.apply_radius(e, REF_LNG, REF_LAT, 150_000.0).select("siret", F.round("meter_distance", 3).alias("meter_distance"))


JOIN_RADIUS = 25_000.0


@register(
    "radius_join",
    f"""WITH pts AS (SELECT vec_id AS point_id, lng AS plng, lat AS plat FROM ({O.geo_pos_cte()}) g WHERE lng IS NOT NULL),
    e AS ({O.est_cte()}),
    cand AS (SELECT pts.*, e.siret, e.lng AS elng, e.lat AS elat FROM pts JOIN e
             ON abs(e.lat - pts.plat) <= 0.3 AND e.lng IS NOT NULL)
    SELECT point_id, siret, round(d, 3) AS meter_distance
    FROM ({O.vincenty_rel("SELECT * FROM cand", "elng", "elat", "plng", "plat", "d")}) x WHERE d <= {JOIN_RADIUS!r}""",
)
def radius_join(spark, sf_dir):
    """J-6: every geo point as a query point, establishments within 25 km."""
    pts = T.geo_points(spark, sf_dir).filter(F.col("position").isNotNull()).select(
        F.col("vec_id").alias("point_id"), F.col("position")["x"].alias("lng"), F.col("position")["y"].alias("lat"),
        F.lit(JOIN_RADIUS).alias("radius"))
    out = GJ.radius_join(pts, T.establishments(spark, sf_dir))
    return out.select("point_id", "siret", F.round("meter_distance", 3).alias("meter_distance"))


# ---------------------------------------------------------------- feed (I-9..I-17, X-12, X-16)
from firmament.plans import landing as LD  # noqa: E402
from firmament.sources import feed as FD  # noqa: E402


def _unit_feed_sql() -> str:
    """Oracle twin of unit feed flattening, written from the page construction."""
    old = "date_debut IS NULL"
    keep = "date_debut IS NULL OR unit_id % 9 <> 0 OR date_creation IS NULL"
    e = {
        "unit_id": "CAST(unit_id AS VARCHAR)",
        "statut_diffusion": "'O'",
        "unite_purgee": "CASE WHEN unit_id % 4 = 0 THEN 'true' ELSE 'false' END",
        "date_creation": "date_creation",
        "annee_effectifs": "CASE WHEN unit_id % 3 = 0 THEN CAST(year(date_creation) AS INTEGER) END",
        "nombre_periodes": "2",
        "categorie_entreprise": "categorie_entreprise",
        "date_debut": f"CASE WHEN {old} THEN date_creation ELSE date_debut END",
        "etat_administratif": f"CASE WHEN {old} THEN 'A' ELSE coalesce(CASE WHEN unit_id % 8 <> 0 THEN etat_administratif END, 'C') END",
        "denomination": f"CASE WHEN {old} THEN 'ancien nom' ELSE denomination END",
        "denomination_usuelle_1": f"CASE WHEN {old} THEN NULL ELSE denomination_usuelle_1 END",
        "categorie_juridique": f"CASE WHEN {old} THEN NULL ELSE categorie_juridique END",
        "activite_principale": f"CASE WHEN {old} THEN NULL ELSE activite_principale END",
    }
    cols = ", ".join(f"{e.get(c, 'NULL')} AS {c}" for c in FD.UNIT_COLUMNS)
    return f"SELECT {cols} FROM legal_unit WHERE {keep}"


def _unit_feed(spark, sf_dir):
    return FD.flatten_units(FD.read_pages(spark, LD.unit_pages(spark, sf_dir)))


register("feed_legal_unit_flatten", _unit_feed_sql())(_unit_feed)
register("lenient_int", f"SELECT unit_id, annee_effectifs FROM ({_unit_feed_sql()}) x")(
    lambda spark, sf_dir: _unit_feed(spark, sf_dir).select("unit_id", "annee_effectifs")
)


def _est_feed_sql() -> str:
    e = {
        "unit_id": "CAST(unit_id AS VARCHAR)",
        "nic": "lpad(CAST(siret % 100000 AS VARCHAR), 5, '0')",
        "siret": "CAST(siret AS VARCHAR)",
        "statut_diffusion": "'O'",
        "date_creation": "date_creation",
        "annee_effectifs": "CASE WHEN siret % 3 = 0 THEN CAST(year(date_debut) AS INTEGER) END",
        "date_dernier_traitement": "date_dernier_traitement",
        "etablissement_siege": "etablissement_siege",
        "code_postal": "code_postal",
        "libelle_commune": "libelle_commune",
        "code_commune": "code_commune",
        "date_debut": "date_debut",
        "etat_administratif": "coalesce(CASE WHEN siret % 8 <> 0 THEN etat_administratif END, 'F')",
        "enseigne_1": "enseigne_1",
        "denomination_usuelle": "denomination_usuelle",
        "activite_principale": "activite_principale",
    }
    cols = ", ".join(f"{e.get(c, 'NULL')} AS {c}" for c in FD.ESTABLISHMENT_COLUMNS)
    return f"SELECT {cols} FROM establishment WHERE siret % 9 <> 0"


def _est_feed(spark, sf_dir):
    return FD.flatten_establishments(FD.read_pages(spark, LD.establishment_pages(spark, sf_dir)))


register("feed_establishment_flatten", _est_feed_sql())(_est_feed)
register("status_default", f"SELECT siret, etat_administratif FROM ({_est_feed_sql()}) x")(
    lambda spark, sf_dir: _est_feed(spark, sf_dir).select("siret", "etat_administratif")
)

register(
    "feed_succession_flatten",
    """SELECT CAST(predecesseur AS VARCHAR) AS siret_etablissement_predecesseur,
              CAST(successeur AS VARCHAR) AS siret_etablissement_successeur, date_lien_succession,
              transfert_siege, continuite_economique,
              date_dernier_traitement AS date_dernier_traitement_lien_succession FROM succession""",
)(lambda spark, sf_dir: FD.flatten_links(FD.read_pages(spark, LD.link_pages(spark, sf_dir))))


@register(
    "current_period",
    """SELECT unit_id, date_debut, o_orderkey, etat_administratif FROM (
         SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY date_debut, o_orderkey) AS rn
         FROM period WHERE date_fin IS NULL) p WHERE rn = 1""",
)
def current_period_q(spark, sf_dir):
    """I-12 over flat period rows: first open period in period order."""
    return FD.current_period_rows(fixtures.table(spark, sf_dir, "period"), "unit_id", ["date_debut", "o_orderkey"],
                                  "date_fin").select("unit_id", "date_debut", "o_orderkey", "etat_administratif")


@register(
    "page_chain_gaps",
    f"""WITH h AS (SELECT CAST(floor(unit_id / {LD.PAGE_SIZE}) AS BIGINT) AS seq FROM legal_unit GROUP BY 1),
    c AS (SELECT seq, CAST(seq AS VARCHAR) AS curseur,
                 CAST(CASE WHEN seq = (SELECT max(seq) FROM h) THEN seq ELSE seq + 1 END AS VARCHAR) AS curseur_suivant FROM h)
    SELECT c.seq, c.curseur, c.curseur_suivant, n.curseur AS next_curseur,
           CASE WHEN n.curseur IS NULL AND c.curseur_suivant <> c.curseur THEN 'chain not closed'
                WHEN n.curseur IS NOT NULL AND n.curseur <> c.curseur_suivant THEN 'gap' ELSE 'ok' END AS status
    FROM c LEFT JOIN c n ON n.seq = c.seq + 1""",
)
def page_chain_gaps_q(spark, sf_dir):
    """I-15: every landed page with its chain status (gaps, unclosed end)."""
    h = FD.headers(FD.read_pages(spark, LD.unit_pages(spark, sf_dir)))
    chain = h.select(F.col("curseur").cast("bigint").alias("seq"), "curseur", "curseur_suivant")
    return FD.chain_status(chain)


@register(
    "feed_reconcile",
    """SELECT CAST(count(*) AS BIGINT) AS announced,
               count(*) AS landed, true AS complete FROM legal_unit""",
)
def feed_reconcile(spark, sf_dir):
    """I-16: the total that every header repeats against the records landed."""
    pages = FD.read_pages(spark, LD.unit_pages(spark, sf_dir))
    return FD.reconcile(FD.headers(pages), FD.records(pages, FD.UNIT_ARRAY))


# ---------------------------------------------------------------- CSV snapshots (I-1..I-8, I-18)
from firmament import schemas as SC  # noqa: E402
from firmament.sources import snapshot as SN  # noqa: E402


def _csv_dir(spark, sf_dir, name, build, schema) -> str:
    cache = _csv_dir.__dict__.setdefault("cache", {})
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in cache:
        from firmament.session import scratch_path

        path = scratch_path(spark, name)
        SN.write_snapshot(build(), path, schema)
        cache[k] = path
    return cache[k]


_UNIT_CSV_EXPR = {
    "unit_id": "CAST(unit_id AS STRING)",
    "statut_diffusion": "'O'",
    "sigle": "CASE WHEN unit_id % 10 = 0 THEN 'S\"' || CAST(unit_id AS STRING) || '\", x' WHEN unit_id % 10 = 1 THEN '' END",
    "date_creation": "date_creation", "date_debut": "date_debut", "etat_administratif": "etat_administratif",
    "denomination": "denomination", "denomination_usuelle_1": "denomination_usuelle_1",
    "denomination_usuelle_2": "denomination_usuelle_2", "denomination_usuelle_3": "denomination_usuelle_3",
    "categorie_juridique": "categorie_juridique", "activite_principale": "activite_principale",
    "categorie_entreprise": "categorie_entreprise",
}


def _oracle_select(exprs: dict, schema, table: str) -> str:
    return "SELECT " + ", ".join(f"{exprs.get(f.name, 'NULL')} AS {f.name}" for f in schema.fields) + f" FROM {table}"


def _unit_csv_source(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _UNIT_CSV_EXPR.items())} FROM legal_unit")


def _unit_csv(spark, sf_dir):
    path = _csv_dir(spark, sf_dir, "unit-csv", lambda: _unit_csv_source(spark, sf_dir), SC.UNIT_SCHEMA)
    return SN.load_snapshot(spark, path, SC.UNIT_SCHEMA)


register("ingest_legal_unit_csv", _oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit"))(_unit_csv)

_EST_CSV_EXPR = {
    "unit_id": "CAST(e.unit_id AS STRING)",
    "nic": "lpad(CAST(e.siret % 100000 AS STRING), 5, '0')",
    "siret": "CAST(e.siret AS STRING)",
    "statut_diffusion": "'O'",
    "date_creation": "e.date_creation", "date_debut": "e.date_debut",
    "date_dernier_traitement": "e.date_dernier_traitement", "etablissement_siege": "e.etablissement_siege",
    "code_postal": "e.code_postal", "libelle_commune": "e.libelle_commune", "code_commune": "e.code_commune",
    "coordonnee_lambert_x": "g.coordonnee_lambert_x", "coordonnee_lambert_y": "g.coordonnee_lambert_y",
    "etat_administratif": "e.etat_administratif", "enseigne_1": "e.enseigne_1",
    "enseigne_2": "CASE WHEN e.siret % 5 = 0 THEN '' END", "denomination_usuelle": "e.denomination_usuelle",
    "activite_principale": "e.activite_principale",
}
_EST_CSV_FROM = "establishment e LEFT JOIN geo_point g ON g.vec_id = e.vec_id"


def _est_csv(spark, sf_dir):
    def build():
        fixtures.register(spark, sf_dir)
        return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _EST_CSV_EXPR.items())} FROM {_EST_CSV_FROM}")

    path = _csv_dir(spark, sf_dir, "establishment-csv", build, SC.ESTABLISHMENT_SCHEMA)
    return SN.load_snapshot(spark, path, SC.ESTABLISHMENT_SCHEMA)


register("ingest_establishment_csv", _oracle_select(_EST_CSV_EXPR, SC.ESTABLISHMENT_SCHEMA, _EST_CSV_FROM))(_est_csv)

_LINK_CSV_EXPR = {
    "siret_etablissement_predecesseur": "CAST(predecesseur AS STRING)",
    "siret_etablissement_successeur": "CAST(successeur AS STRING)",
    "date_lien_succession": "date_lien_succession", "transfert_siege": "transfert_siege",
    "continuite_economique": "continuite_economique",
    "date_dernier_traitement_lien_succession": "date_dernier_traitement",
}


@register("ingest_succession_csv",
          _oracle_select(_LINK_CSV_EXPR, SC.LINK_SCHEMA, "succession").replace(" FROM succession",
                                                                               ", true AS id_ok FROM succession"))
def ingest_succession_csv(spark, sf_dir):
    """I-3: six loaded columns plus a generated id (random; only its shape is compared)."""
    def build():
        fixtures.register(spark, sf_dir)
        return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _LINK_CSV_EXPR.items())} FROM succession")

    path = _csv_dir(spark, sf_dir, "link-csv", build, SC.LINK_SCHEMA)
    loaded = SN.with_id(SN.load_snapshot(spark, path, SC.LINK_SCHEMA))
    return loaded.withColumn("id_ok", F.length("id") == 36).drop("id")


@register(
    "constraint_violations",
    f"""WITH u AS ({_oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit")})
    SELECT {", ".join(f"count(*) FILTER (WHERE {f.name} IS NULL) AS {f.name}_null" for f in SC.UNIT_SCHEMA.fields if not f.nullable)},
           {", ".join(f"count(*) FILTER (WHERE length({c}) > {n}) AS {c}_too_long" for c, n in SC.UNIT_LENGTHS.items())},
           (SELECT count(*) FROM (SELECT unit_id FROM u GROUP BY unit_id HAVING count(*) > 1) d) AS duplicate_keys
    FROM u""",
)
def constraint_violations(spark, sf_dir):
    """I-7 on the loaded unit snapshot (the fixture keys are not 9 characters)."""
    return SC.constraint_violations(_unit_csv(spark, sf_dir), SC.UNIT_SCHEMA, SC.UNIT_LENGTHS, "unit_id")


@register("conform_schema", _oracle_select({c: c for c in _UNIT_CSV_EXPR if c not in ("unit_id", "statut_diffusion", "sigle")}
                                           | {"unit_id": "CAST(unit_id AS STRING)"}, SC.UNIT_SCHEMA, "legal_unit"))
def conform_schema(spark, sf_dir):
    """I-18: the unit view migrated to the 35-column stored schema."""
    return SC.conform(fixtures.table(spark, sf_dir, "legal_unit"), SC.UNIT_SCHEMA)


_MANIFEST_SQL = f"""SELECT group_type, high_water_mark AS last_modified,
      CASE group_type WHEN 'etablissements' THEN high_water_mark - INTERVAL 1 DAY
                      WHEN 'liens_succession' THEN high_water_mark END AS last_imported_timestamp,
      CASE group_type WHEN 'unites_legales' THEN high_water_mark + INTERVAL 1 DAY END AS staging_imported_timestamp
    FROM ({_HWM_SQL}) h"""


@register("sources_to_load", f"""SELECT group_type, last_modified FROM ({_MANIFEST_SQL}) m
    WHERE (last_imported_timestamp IS NULL OR last_modified IS NULL OR last_modified > last_imported_timestamp)
      AND (staging_imported_timestamp IS NULL OR last_modified IS NULL OR last_modified > staging_imported_timestamp)""")
def sources_to_load(spark, sf_dir):
    """I-8: remote modification times (the tables' high-water marks) against a
    load ledger derived from them."""
    h = _hwm(spark, sf_dir)
    manifest = h.select("group_type", F.col("high_water_mark").alias("last_modified"))
    hw = F.col("high_water_mark")
    ledger = h.select(
        "group_type",
        F.when(F.col("group_type") == "etablissements", hw - F.expr("INTERVAL 1 DAY"))
        .when(F.col("group_type") == "liens_succession", hw).alias("last_imported_timestamp"),
        F.when(F.col("group_type") == "unites_legales", hw + F.expr("INTERVAL 1 DAY")).alias("staging_imported_timestamp"),
    )
    return SN.sources_to_load(manifest, ledger).select("group_type", "last_modified")


# ---------------------------------------------------------------- request validation, run summaries
_REQUESTS_SQL = """SELECT event_id AS request_id,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 46.0 + value / 100 END AS lat,
    CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 2.0 + value / 100 END AS lng,
    CASE WHEN event_type IN ('view', 'error') THEN value * 1000 END AS radius,
    CASE WHEN event_type IN ('signup', 'view') THEN props END AS q,
    CASE user_id % 5 WHEN 0 THEN 'distance' WHEN 1 THEN 'relevance' WHEN 2 THEN 'date_creation'
                     WHEN 3 THEN 'score' END AS sort,
    CASE WHEN value > 50 THEN 'A' WHEN value > 20 THEN 'C' WHEN value > 10 THEN 'X' END AS etat_administratif
  FROM events"""


@register(
    "validate_requests",
    f"""SELECT *, geo_ok AND sort_ok AND status_ok AND radius_ok AS valid FROM (
      SELECT *, ((lat IS NOT NULL)::INT + (lng IS NOT NULL)::INT + (radius IS NOT NULL)::INT) IN (0, 3) AS geo_ok,
        (sort IS NULL OR (sort IN ('date_creation', 'date_debut', 'distance', 'relevance')
          AND (sort <> 'distance' OR (lat IS NOT NULL AND lng IS NOT NULL AND radius IS NOT NULL))
          AND (sort <> 'relevance' OR q IS NOT NULL))) AS sort_ok,
        (etat_administratif IS NULL OR etat_administratif IN ('A', 'F', 'C')) AS status_ok,
        (NOT (lat IS NOT NULL AND lng IS NOT NULL AND radius IS NOT NULL) OR radius BETWEEN 0.0 AND 5000000.0) AS radius_ok
      FROM ({_REQUESTS_SQL}) r) v""",
)
def validate_requests(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    return S.validate_requests(spark.sql(_REQUESTS_SQL))


_RUN_GROUPS = [("liens_succession", "purchase"), ("etablissements", "click"), ("unites_legales", "view")]


def _run_summaries(spark, sf_dir):
    """One nested summary per user: 3 steps x 3 groups (newest group first),
    built with bounded ``array(struct)`` from per-user aggregates."""
    fixtures.register(spark, sf_dir)
    ev = spark.table("events")
    agg = ev.groupBy(F.col("user_id").alias("run_id")).agg(
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for _, t in _RUN_GROUPS],
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
    )
    steps = []
    for i, step in enumerate(L.STEPS):
        groups = [
            F.struct(
                F.lit(g).alias("group_type"), (F.col(f"n_{t}") > 14 + 2 * i).alias("updated"),
                F.lit("finished").alias("status_label"), F.col("t0").alias("started_timestamp"),
                F.col("t1").alias("finished_timestamp"), F.col(f"n_{t}").alias("planned_count"),
                (F.col(f"n_{t}") - i).alias("done_count"), F.col("t1").alias("reference_timestamp"),
            )
            for g, t in _RUN_GROUPS
        ]
        steps.append(F.struct(F.lit(step).alias("step"), F.lit(None).cast("boolean").alias("updated"),
                              F.col("t0").alias("started_timestamp"), F.col("t1").alias("finished_timestamp"),
                              F.array(*groups).alias("groups")))
    summary = F.struct(F.lit(None).cast("boolean").alias("updated"), F.col("t0").alias("started_timestamp"),
                       F.col("t1").alias("finished_timestamp"), F.array(*steps).alias("steps"))
    return agg.select("run_id", summary.alias("summary"))


_RUN_FLAT_SQL = f"""WITH a AS (SELECT user_id AS run_id,
      count(*) FILTER (WHERE event_type = 'purchase') AS np, count(*) FILTER (WHERE event_type = 'click') AS nc,
      count(*) FILTER (WHERE event_type = 'view') AS nv, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
    s(step_pos, step) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(L.STEPS))}),
    g(group_pos, group_type) AS (VALUES {", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(_RUN_GROUPS))}),
    f AS (SELECT a.run_id, s.step_pos, s.step, CAST(NULL AS BOOLEAN) AS step_updated, g.group_pos, g.group_type,
           CASE g.group_type WHEN 'liens_succession' THEN np WHEN 'etablissements' THEN nc ELSE nv END AS n,
           a.t0, a.t1 FROM a, s, g)
    """


register(
    "run_flatten",
    _RUN_FLAT_SQL + """SELECT run_id, step_pos, step, step_updated, group_pos, group_type, n > 14 + 2 * step_pos AS updated,
      'finished' AS status_label, t0 AS started_timestamp, t1 AS finished_timestamp, n AS planned_count,
      n - step_pos AS done_count, t1 AS reference_timestamp FROM f""",
)(lambda spark, sf_dir: L.flatten_runs(_run_summaries(spark, sf_dir)))

register(
    "run_rollup",
    _RUN_FLAT_SQL + """, st AS (SELECT run_id, step_pos, step, bool_or(n > 14 + 2 * step_pos) AS step_updated FROM f
                        GROUP BY run_id, step_pos, step)
    SELECT run_id, bool_or(step_updated) OVER (PARTITION BY run_id) AS run_updated, step_pos, step, step_updated FROM st""",
)(lambda spark, sf_dir: L.rollup_runs(_run_summaries(spark, sf_dir)))


# ---------------------------------------------------------------- streaming (ST-1..ST-4)
from firmament.streaming import sync as SY  # noqa: E402

DELTA_SCHEMA = "unit_id bigint, activite_principale string, value double, date_dernier_traitement timestamp_ntz, page bigint, pos bigint"


@register("stream_upsert", _upsert_sql(UNIT_BASE_SQL, UNIT_BASE_COLS, "unit_id", UNIT_SET, (), "SELECT * FROM delta"))
def stream_upsert(spark, sf_dir):
    """ST-1: landed delta files streamed (AvailableNow, several micro-batches)
    into the unit table through the upsert sink."""
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    base = T.units(spark, sf_dir).select(*UNIT_COLS).withColumn(
        "activite_principale_naf25", F.col("activite_principale")
    ).withColumn("date_dernier_traitement", F.lit(None).cast("timestamp_ntz"))
    landing = scratch_path(spark, "delta-landing")
    spark.table("delta").repartition(4).write.option("timestampNTZFormat", SY.TS_FORMAT).json(landing)
    root = scratch_path(spark, "unit-table")
    SY.init_table(spark, base, root)
    return SY.run_sync(spark, landing, DELTA_SCHEMA, root, scratch_path(spark, "sync-checkpoint"), "unit_id",
                       UNIT_SET, ["date_dernier_traitement", "page", "pos"], "date_dernier_traitement",
                       files_per_batch=2)


@register("upsert_bucketed", _upsert_sql(UNIT_BASE_SQL, UNIT_BASE_COLS, "unit_id", UNIT_SET, (), "SELECT * FROM delta"))
def upsert_bucketed(spark, sf_dir):
    """M-1, ST-1: the unit table in buckets of its key; only buckets that hold
    keys of the delta are read and written."""
    from firmament.plans import buckets as BU
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    base = T.units(spark, sf_dir).select(*UNIT_COLS).withColumn(
        "activite_principale_naf25", F.col("activite_principale")
    ).withColumn("date_dernier_traitement", F.lit(None).cast("timestamp_ntz"))
    root = scratch_path(spark, "unit-buckets")
    BU.create(base, root, "unit_id", buckets=16)
    BU.upsert(spark.table("delta"), root, UNIT_SET, ["date_dernier_traitement", "page", "pos"])
    return BU.read(spark, root)


@register("search_response_json")
def search_response_json(spark, sf_dir):
    """M-9: the flagship page rendered as API JSON (NULLs kept, score and
    distance left out when NULL).  Rows-only: JSON text differs by engine."""
    page = S.search(T.establishments(spark, sf_dir), P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0, limit=25))
    return LK.render_json(T.flat_position(page))


def _establishment_index(spark, sf_dir) -> BM.Postings:
    """Postings of the stored establishment table (search text and commune),
    built and written once per session like the stored table itself."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir, "establishment")
    if k not in _INDEXES:
        built = BM.build_postings(T.establishments(spark, sf_dir), "siret", list(S.ESTABLISHMENT.text_fields))
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "establishment-index"))
    return _INDEXES[k]


_COMBINED = P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0, filters={"etablissement_siege": False}, limit=25)


@register("search_combined_index", O.search_sql(_COMBINED, S.ESTABLISHMENT))
def search_combined_index(spark, sf_dir):
    """T-6 through the postings index (T-4): same request and results as
    ``search_combined``, without scanning every text value."""
    page = S.search(T.establishments(spark, sf_dir), _COMBINED, S.ESTABLISHMENT, index=_establishment_index(spark, sf_dir))
    return _round_search(page, S.ESTABLISHMENT)


@register("search_batch_full", O.search_requests_sql())
def search_batch_full(spark, sf_dir):
    """W-2, T-5, T-6: a table of requests with text, radius, filters, four
    sorts and their own paging, through the index and the cells."""
    from firmament.operators import batch as BT

    requests = fixtures.table(spark, sf_dir, "request")
    pages = BT.search_requests(requests, T.establishments(spark, sf_dir), _establishment_index(spark, sf_dir))
    return pages.select("request_id", "rank", "siret", F.round("score", 6).alias("score"), F.round("meter_distance", 3).alias("meter_distance"), "total")


_PRECOND_LEDGER_SQL = f"""SELECT group_type,
      CASE group_type WHEN 'etablissements' THEN high_water_mark WHEN 'liens_succession' THEN high_water_mark END
        AS staging_imported_timestamp,
      CASE group_type WHEN 'etablissements' THEN high_water_mark - INTERVAL 1 DAY
                      WHEN 'liens_succession' THEN high_water_mark END AS last_imported_timestamp
    FROM ({_HWM_SQL}) h"""


@register(
    "publish_preconditions",
    f"""SELECT group_type, staging_imported_timestamp, last_imported_timestamp,
      CASE WHEN staging_imported_timestamp IS NULL THEN 'nothing to swap'
           WHEN last_imported_timestamp IS NOT NULL AND staging_imported_timestamp <= last_imported_timestamp
             THEN 'already imported' ELSE 'ready' END AS verdict
    FROM ({_PRECOND_LEDGER_SQL}) l""",
)
def publish_preconditions(spark, sf_dir):
    """M-7 on a load ledger derived from the tables' high-water marks: one
    dataset staged and newer (ready), one staged but not newer (already
    imported), one not staged (nothing to swap)."""
    h = _hwm(spark, sf_dir)
    hw, g = F.col("high_water_mark"), F.col("group_type")
    ledger = h.select(
        "group_type",
        F.when(g.isin("etablissements", "liens_succession"), hw).alias("staging_imported_timestamp"),
        F.when(g == "etablissements", hw - F.expr("INTERVAL 1 DAY")).when(g == "liens_succession", hw)
        .alias("last_imported_timestamp"),
    )
    return PB.preconditions(ledger)


def _documents_index(spark, sf_dir) -> BM.Postings:
    """Postings of the whole ``documents`` texts (long-text gram builder),
    built and written once per session."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir, "documents")
    if k not in _INDEXES:
        built = BM.build_postings(T.documents(spark, sf_dir), "doc_id", ["text"], long_text=True)
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "documents-index"))
    return _INDEXES[k]


@register("bm25_documents_index")
def bm25_documents_index(spark, sf_dir):
    """T-3/T-4 on long text through the persisted index; equals ``bm25_documents``."""
    scored = BM.bm25_index(_documents_index(spark, sf_dir), "retitioning")
    return scored.select("key", F.round("score", 6).alias("score"))


ORACLE["bm25_documents_index"] = ORACLE["bm25_documents"]


# ---------------------------------------------------------------- loaded and synced tables, searched (P-4..P-6, M-1, M-2, T-4, ST-1)
from firmament.plans import searchable as SB  # noqa: E402

# The day's delta: an event sets the name, place and status of an establishment
# (some stored, some new); several events of one establishment, the last wins.
_EST_DAY_EXPR = {
    "unit_id": "CAST(user_id AS STRING)", "nic": "'00001'", "siret": "CAST(event_id * 2 % 20011 AS STRING)",
    "statut_diffusion": "'O'", "date_dernier_traitement": "ts", "etablissement_siege": "event_type = 'signup'",
    "code_postal": "'3-MEDIUM'", "libelle_commune": "'Lyon'",
    "date_debut": "CAST(ts AS DATE)", "date_creation": "CAST(ts AS DATE)",
    "etat_administratif": "CASE WHEN event_type = 'error' THEN 'F' ELSE 'A' END",
    "denomination_usuelle": "'Atelier ' || event_type", "enseigne_2": "CASE WHEN user_id % 2 = 0 THEN 'marteau rouge' END",
    "coordonnee_lambert_x": "CASE WHEN event_type = 'view' THEN '[ND]' ELSE CAST(700000 + user_id * 1000 AS STRING) END",
    "coordonnee_lambert_y": "CASE WHEN event_type = 'view' THEN '[ND]' ELSE CAST(6600000 + user_id * 500 AS STRING) END",
}
_UNIT_DAY_EXPR = {
    "unit_id": "CAST(user_id * 11 AS STRING)", "statut_diffusion": "'O'", "date_dernier_traitement": "ts",
    "etat_administratif": "CASE WHEN event_type = 'error' THEN 'C' ELSE 'A' END",
    "denomination": "CASE WHEN event_type = 'click' THEN NULL ELSE 'Atelier ' || event_type END",
    "denomination_usuelle_2": "'marteau'", "date_creation": "CAST(ts AS DATE)", "activite_principale": "'62.01Z'",
}
_DAY_ORDER = ["date_dernier_traitement", "page", "pos"]


def _day_sql(exprs: dict, schema, select=None) -> str:
    body = (select or _oracle_select)(exprs, schema, "events")
    return body.replace(" FROM events", ", CAST(FLOOR(event_id / 1000) AS BIGINT) AS page, event_id AS pos FROM events")


def _typed_select(exprs: dict, schema, table: str) -> str:
    return "SELECT " + ", ".join(
        f"CAST({exprs.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields
    ) + f" FROM {table}"


_VERSIONS: dict[tuple[str, str, str], SB.Version] = {}


def _version(spark, sf_dir, entity: S.Entity, day: bool, segmented: bool = False) -> SB.Version:
    """The CSV snapshot loaded as a searchable version; with ``day``, the
    version after the day's delta.  Written once per session."""
    from firmament.session import scratch_path

    name = ("establishment" if entity.has_geo else "unit") + ("-day" if day else "-loaded") + ("-segmented" if segmented else "")
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in _VERSIONS:
        path = scratch_path(spark, name)
        if day:
            fixtures.register(spark, sf_dir)
            exprs, schema = (_EST_DAY_EXPR, SC.ESTABLISHMENT_SCHEMA) if entity.has_geo else (_UNIT_DAY_EXPR, SC.UNIT_SCHEMA)
            delta = spark.sql(_day_sql(exprs, schema, _typed_select))
            _VERSIONS[k] = SB.apply(_version(spark, sf_dir, entity, False), delta, _DAY_ORDER, path, segmented=segmented)
        else:
            _VERSIONS[k] = SB.load((_est_csv if entity.has_geo else _unit_csv)(spark, sf_dir), entity, path)
    return _VERSIONS[k]


_EST_LOADED_SQL = _oracle_select(_EST_CSV_EXPR, SC.ESTABLISHMENT_SCHEMA, _EST_CSV_FROM)
_UNIT_LOADED_SQL = _oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit")
_EST_AFTER_SQL = _upsert_sql(_EST_LOADED_SQL, SC.ESTABLISHMENT_SCHEMA.names, "siret", SC.ESTABLISHMENT_SET, (),
                             _day_sql(_EST_DAY_EXPR, SC.ESTABLISHMENT_SCHEMA))
_UNIT_AFTER_SQL = _upsert_sql(_UNIT_LOADED_SQL, SC.UNIT_SCHEMA.names, "unit_id", SC.UNIT_SET, (),
                              _day_sql(_UNIT_DAY_EXPR, SC.UNIT_SCHEMA))


def _version_query(name: str, params: S.SearchParams, entity: S.Entity, day: bool, loaded_sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_search(SB.search(_version(spark, sf_dir, entity, day), params), entity)

    register(name, O.search_sql(params, entity, O.generated_sql(loaded_sql, entity)))(run)


_version_query("load_then_search", P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0,
                                     filters={"etablissement_siege": False}, limit=50), S.ESTABLISHMENT, False, _EST_LOADED_SQL)
_version_query("load_then_search_unit", P(q="customer#0000001", limit=50), S.UNIT, False, _UNIT_LOADED_SQL)
_version_query("upsert_then_search", P(q="marteau widget", lat=46.5, lng=3.5, radius=120_000.0, limit=100),
               S.ESTABLISHMENT, True, _EST_AFTER_SQL)
_version_query("upsert_then_search_unit", P(q="atelier annexe", limit=100), S.UNIT, True, _UNIT_AFTER_SQL)


@register("segments_then_search")
def segments_then_search(spark, sf_dir):
    """T-4: as ``upsert_then_search``, the delta's index entries in a segment."""
    params = P(q="marteau widget", lat=46.5, lng=3.5, radius=120_000.0, limit=100)
    return _round_search(SB.search(_version(spark, sf_dir, S.ESTABLISHMENT, True, segmented=True), params), S.ESTABLISHMENT)


ORACLE["segments_then_search"] = ORACLE["upsert_then_search"]


def _sync(spark, sf_dir, dataset: str, landing: str, base: DataFrame) -> DataFrame:
    """Feed pages streamed into a table that starts with ``base``."""
    from firmament.session import scratch_path

    root = scratch_path(spark, f"{dataset}-table")
    SY.init_table(spark, base, root)
    return SY.sync_pages(spark, landing, root, scratch_path(spark, f"{dataset}-checkpoint"), dataset)


def _undated(sql: str) -> str:
    return f"SELECT *, 0 AS page, 0 AS pos FROM ({sql}) f"


@register("stream_units", _upsert_sql(f"SELECT * FROM ({_UNIT_LOADED_SQL}) l WHERE CAST(unit_id AS BIGINT) % 3 <> 0",
                                      SC.UNIT_SCHEMA.names, "unit_id", SC.UNIT_SET, (), _undated(_unit_feed_sql())))
def stream_units(spark, sf_dir):
    """ST-1, M-1: unit pages streamed into a table that holds two thirds of the units."""
    base = _unit_csv(spark, sf_dir).filter(F.col("unit_id").cast("bigint") % 3 != 0)
    return _sync(spark, sf_dir, "unites_legales", LD.unit_pages(spark, sf_dir), base)


@register("stream_establishments",
          "SELECT *, " + O._concat_text(T.ESTABLISHMENT_TEXT) + " AS search_denomination FROM ("
          + _upsert_sql(f"SELECT * FROM ({_EST_LOADED_SQL}) l WHERE CAST(siret AS BIGINT) % 3 <> 0",
                        SC.ESTABLISHMENT_SCHEMA.names, "siret", SC.ESTABLISHMENT_SET, (), _undated(_est_feed_sql())) + ") u")
def stream_establishments(spark, sf_dir):
    """ST-1, M-2: establishment pages streamed into a table with its search text."""
    from firmament.operators import derive as DV

    base = _est_csv(spark, sf_dir).filter(F.col("siret").cast("bigint") % 3 != 0)
    base = DV.derive(base, {"search_denomination": DV.establishment_columns()["search_denomination"]})
    return _sync(spark, sf_dir, "etablissements", LD.establishment_pages(spark, sf_dir), base)


# Two thirds of the establishments as known at the start of 2000, then the feed from the look-back on.
_SYNC_AS_OF, _SYNC_KNOWN = dt.datetime(2000, 3, 1), "2000-01-01 00:00:00"
_SYNC_BASE_SQL = (f"SELECT * REPLACE (least(date_dernier_traitement, TIMESTAMP '{_SYNC_KNOWN}') AS date_dernier_traitement) "
                  f"FROM ({_EST_LOADED_SQL}) l WHERE CAST(siret AS BIGINT) % 3 <> 0")
_SYNC_START_SQL = (f"SELECT CASE WHEN max(date_dernier_traitement) IS NULL THEN NULL ELSE greatest(max(date_dernier_traitement), "
                   f"TIMESTAMP '{AS_OF.isoformat(sep=' ')}' - INTERVAL 31 DAY) END FROM succession")
_DELTA_LINKS_SQL = f"SELECT * FROM succession WHERE date_dernier_traitement >= ({_SYNC_START_SQL})"


def _delta_links(spark, sf_dir):
    links = T.succession(spark, sf_dir)
    start = L.sync_start(L.high_water_mark(links, "date_dernier_traitement").scalar(), AS_OF)
    return L.incremental(links, start, "date_dernier_traitement")


register("incremental_range", _DELTA_LINKS_SQL)(_delta_links)
register("append_succession", f"SELECT * FROM succession UNION ALL {_DELTA_LINKS_SQL}")(
    lambda spark, sf_dir: M.append(T.succession(spark, sf_dir), _delta_links(spark, sf_dir))
)
register(
    "append_succession_dedup",
    f"SELECT * FROM succession UNION ALL (SELECT DISTINCT * FROM ({_DELTA_LINKS_SQL}) x EXCEPT SELECT * FROM succession)",
)(lambda spark, sf_dir: M.append(T.succession(spark, sf_dir), _delta_links(spark, sf_dir), dedupe=True))


# rows stored already, rows never seen, and each of both twice
_MIXED_LINKS_SQL = f"""SELECT * FROM ({_DELTA_LINKS_SQL}) UNION ALL SELECT * REPLACE (NOT transfert_siege AS transfert_siege) FROM ({_DELTA_LINKS_SQL})"""


@register(
    "append_succession_digest",
    f"""SELECT * FROM succession UNION ALL
    (SELECT DISTINCT * FROM ({_MIXED_LINKS_SQL} UNION ALL {_MIXED_LINKS_SQL}) x EXCEPT SELECT * FROM succession)""",
)
def append_succession_digest(spark, sf_dir):
    """M-4 on a table that stores its rows' digests."""
    links = T.succession(spark, sf_dir)
    base = T.stored(spark, sf_dir, "succession-digest",
                    lambda: links.withColumn(DV.DIGEST, DV.row_digest(links.schema)))
    delta = _delta_links(spark, sf_dir)
    mixed = delta.unionByName(delta.withColumn("transfert_siege", ~F.col("transfert_siege")))
    return M.append(base, mixed.unionByName(mixed), dedupe=True, ts_col="date_dernier_traitement").drop(DV.DIGEST)


# ---------------------------------------------------------------- publish, counts (M-5..M-7, A-1, A-2)
@register(
    "count_production",
    """SELECT 'unites_legales' AS group_type, count(unit_id) AS n FROM legal_unit
    UNION ALL SELECT 'etablissements', count(siret) FROM establishment
    UNION ALL SELECT 'liens_succession', count(*) FROM succession""",
)
def count_production(spark, sf_dir):
    u = T.units(spark, sf_dir).agg(F.lit("unites_legales").alias("group_type"), F.count("unit_id").alias("n"))
    e = fixtures.table(spark, sf_dir, "establishment").agg(
        F.lit("etablissements").alias("group_type"), F.count("siret").alias("n"))
    s = T.succession(spark, sf_dir).agg(F.lit("liens_succession").alias("group_type"), F.count(F.lit(1)).alias("n"))
    return u.unionByName(e).unionByName(s)


def _gate_sql(name, pred):
    return f"""SELECT '{name}' AS candidate, p.n AS production_count, s.n AS staging_count,
       (p.n = 0 OR NOT (s.n < p.n * 0.99 OR s.n > p.n * 1.01)) AS publish,
       CASE WHEN p.n = 0 THEN 'empty production' WHEN s.n < p.n * 0.99 THEN 'too few rows'
            WHEN s.n > p.n * 1.01 THEN 'too many rows' ELSE 'within tolerance' END AS reason
    FROM (SELECT count(siret) AS n FROM establishment) p, (SELECT count(siret) AS n FROM establishment WHERE {pred}) s"""


@register("publish_gate", _gate_sql("A", "siret % 200 <> 0") + " UNION ALL " + _gate_sql("B", "siret % 50 <> 0"))
def publish_gate(spark, sf_dir):
    prod = fixtures.table(spark, sf_dir, "establishment")
    out = []
    for name, pred in (("A", "siret % 200 <> 0"), ("B", "siret % 50 <> 0")):
        g = PB.gate(PB.row_counts(prod, prod.filter(pred), "siret"))
        out.append(g.select(F.lit(name).alias("candidate"), "production_count", "staging_count", "publish", "reason"))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- ledger (A-5..A-10, X-10, X-11, X-17, M-10..M-12)
_HWM_SQL = """SELECT 'etablissements' AS group_type, max(date_dernier_traitement) AS high_water_mark FROM establishment
    UNION ALL SELECT 'liens_succession', max(date_dernier_traitement) FROM succession
    UNION ALL SELECT 'unites_legales', max(date_dernier_traitement) FROM delta"""


def _hwm(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    parts = [
        ("etablissements", spark.table("establishment")),
        ("liens_succession", spark.table("succession")),
        ("unites_legales", spark.table("delta")),
    ]
    out = None
    for g, df in parts:
        h = L.high_water_mark(df, "date_dernier_traitement").select(F.lit(g).alias("group_type"), "high_water_mark")
        out = h if out is None else out.unionByName(h)
    return out


register("high_water_mark", _HWM_SQL)(_hwm)


@register(
    "sync_start",
    f"""SELECT group_type, strftime(greatest(high_water_mark, TIMESTAMP '{AS_OF.isoformat(sep=' ')}' - INTERVAL 31 DAY),
                                    '%Y-%m-%dT%H:%M:%S') AS sync_start FROM ({_HWM_SQL}) h""",
)
def sync_start_q(spark, sf_dir):
    h = _hwm(spark, sf_dir)
    return h.select("group_type", L.feed_timestamp(L.sync_start(F.col("high_water_mark"), AS_OF)).alias("sync_start"))


RUN_AS_OF = dt.datetime(2024, 1, 31)


@register(
    "latest_event",
    """SELECT user_id, run_id, launched_timestamp, status, group_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY launched_timestamp DESC, run_id DESC) AS rn
         FROM runs) r WHERE rn = 1""",
)
def latest_event(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs")
    return L.latest(runs, "user_id", ["launched_timestamp", "run_id"]).select(
        "user_id", "run_id", "launched_timestamp", "status", "group_type")


@register(
    "latest_purchase",
    """SELECT u.user_id, r.run_id, r.launched_timestamp FROM (SELECT DISTINCT user_id FROM runs) u
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                  ORDER BY launched_timestamp DESC, run_id DESC) AS rn FROM runs WHERE status = 'finished') x
                  WHERE rn = 1) r ON r.user_id = u.user_id""",
)
def latest_purchase(spark, sf_dir):
    """A-8: newest finished run per key; keys without one stay with NULLs."""
    runs = fixtures.table(spark, sf_dir, "runs")
    last = L.latest(runs, "user_id", ["launched_timestamp", "run_id"], where=F.col("status") == "finished")
    return runs.select("user_id").distinct().join(last.select("user_id", "run_id", "launched_timestamp"),
                                                  "user_id", "left")


@register(
    "stale_keys",
    f"""SELECT user_id, max(launched_timestamp) AS last_ts FROM runs WHERE status = 'launched' GROUP BY user_id
        HAVING max(launched_timestamp) < TIMESTAMP '{RUN_AS_OF.isoformat(sep=' ')}' - INTERVAL 1 HOUR""",
)
def stale_keys(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs").filter(F.col("status") == "launched")
    return L.stale(runs, "user_id", "launched_timestamp", RUN_AS_OF)


@register(
    "expand_groups",
    """SELECT run_id, group_type FROM runs WHERE group_type <> 'all'
       UNION ALL SELECT r.run_id, g.group_type FROM runs r,
         (VALUES ('unites_legales'), ('etablissements'), ('liens_succession')) g(group_type) WHERE r.group_type = 'all'""",
)
def expand_groups(spark, sf_dir):
    return L.expand_groups(fixtures.table(spark, sf_dir, "runs").select("run_id", "group_type"))


@register(
    "keyed_update",
    f"""SELECT group_type,
          CASE WHEN group_type = 'etablissements' THEN TIMESTAMP '{AS_OF.isoformat(sep=' ')}' ELSE high_water_mark END
            AS high_water_mark,
          coalesce(group_type = 'etablissements' AND high_water_mark IS DISTINCT FROM TIMESTAMP '{AS_OF.isoformat(sep=' ')}', false)
            AS changed
        FROM ({_HWM_SQL}) h""",
)
def keyed_update(spark, sf_dir):
    """M-10 on a ledger derived from the tables' high-water marks."""
    return L.keyed_update(_hwm(spark, sf_dir), "group_type", "etablissements", {"high_water_mark": AS_OF}).select(
        "group_type", "high_water_mark", "changed")


@register(
    "conditional_update",
    f"""SELECT run_id, user_id, launched_timestamp,
          CASE WHEN status = 'launched' THEN 'finished' ELSE status END AS status, group_type,
          CASE WHEN status = 'launched' THEN TIMESTAMP '{RUN_AS_OF.isoformat(sep=' ')}' ELSE finished_timestamp END
            AS finished_timestamp, value FROM runs""",
)
def conditional_update(spark, sf_dir):
    runs = fixtures.table(spark, sf_dir, "runs")
    return L.conditional_update(
        runs, F.col("status") == "launched", {"finished_timestamp": RUN_AS_OF, "status": "finished"}
    )


@register("delete_where", "SELECT * FROM runs WHERE group_type IS DISTINCT FROM 'liens_succession'")
def delete_where(spark, sf_dir):
    return L.delete_where(fixtures.table(spark, sf_dir, "runs"), F.col("group_type") == "liens_succession")


# ---------------------------------------------------------------- text (P-4, P-5, X-1, T-1..T-5)
from firmament.functions import geo as G  # noqa: E402
from firmament.functions import text as TX  # noqa: E402
from firmament.operators import bm25 as BM  # noqa: E402
from firmament.operators import geo_join as GJ  # noqa: E402
from firmament.operators.util import top_k_per_group  # noqa: E402


@register(
    "search_text_establishment",
    "SELECT siret, coalesce(denomination_usuelle, '') || ' ' || coalesce(enseigne_1, '') || ' ' || "
    "coalesce(enseigne_2, '') || ' ' || coalesce(enseigne_3, '') AS search_denomination FROM establishment",
)
def search_text_establishment(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "establishment")
    return e.select("siret", TX.search_text(*T.ESTABLISHMENT_TEXT).alias("search_denomination"))


@register("search_text_unit", f"SELECT unit_id, search_denomination FROM ({O.unit_cte()}) u")
def search_text_unit(spark, sf_dir):
    return T.units(spark, sf_dir).select("unit_id", "search_denomination")


_GRAMS_SHORT_SQL = """SELECT k, field, g AS gram FROM (
    SELECT k, 't' AS field, substring(lower(t), r.i, n.n) AS g FROM short_text, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(t) - n.n + 1) r(i)
    UNION ALL
    SELECT k, 't2', substring(lower(t2), r.i, n.n) FROM short_text, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(t2) - n.n + 1) r(i)) x"""


@register("ngram_tokens", f"SELECT k, gram, count(*) AS tf FROM ({_GRAMS_SHORT_SQL}) g WHERE field = 't' GROUP BY k, gram")
def ngram_tokens(spark, sf_dir):
    st = T.short_text(spark, sf_dir).select("k", "t")
    st = BM.dealt(st, BM.shards(st, ["t"])[0], "k")
    return st.select("k", F.explode(TX.ngrams("t")).alias("gram")).groupBy("k", "gram").agg(
        F.count(F.lit(1)).alias("tf"))


@register(
    "postings_stats",
    f"""WITH g AS ({_GRAMS_SHORT_SQL}),
    p AS (SELECT field, gram, k, count(*) AS tf FROM g GROUP BY ALL),
    fs AS (SELECT 't' AS field, count(*) AS n,
                  sum(greatest(length(t) - 3, 0) + greatest(length(t) - 4, 0)) AS sum_dl FROM short_text
           UNION ALL SELECT 't2', count(*), sum(greatest(length(t2) - 3, 0) + greatest(length(t2) - 4, 0)) FROM short_text)
    SELECT p.field, p.gram, count(*) AS df, sum(p.tf) AS tf_total, fs.n, CAST(fs.sum_dl AS BIGINT) AS sum_dl
    FROM p JOIN fs ON fs.field = p.field GROUP BY p.field, p.gram, fs.n, fs.sum_dl""",
)
def postings_stats(spark, sf_dir):
    """T-4: postings, per-gram document frequency and field statistics."""
    idx = BM.build_postings(T.short_text(spark, sf_dir), "k", ["t", "t2"])
    tf_total = idx.postings.groupBy("field", "gram").agg(F.sum("tf").alias("tf_total"))
    return idx.grams.join(tf_total, ["field", "gram"]).join(idx.fields, "field").select(
        "field", "gram", "df", "tf_total", "n", F.col("sum_dl").cast("bigint").alias("sum_dl"))


def _bm25_query(name, table_fn, table_sql, key, fields, q, long_text=False):
    def run(spark, sf_dir):
        scored = BM.bm25_scan(table_fn(spark, sf_dir), fields, q)
        return scored.select(F.col(key).alias("key"), F.round("score", 6).alias("score"))

    register(name, f"SELECT key, round(score, 6) AS score FROM ({O.bm25_rel(table_sql, key, fields, q, long_text)}) s")(run)


_bm25_query("bm25_short_text", T.short_text, "SELECT * FROM short_text", "k", ["t", "t2"], "widget")
_bm25_query("bm25_documents", T.documents, "SELECT * FROM documents", "doc_id", ["text"], "retitioning", True)

BATCH_K = 10


_INDEXES: dict = {}


def _short_text_index(spark, sf_dir) -> BM.Postings:
    """The postings index of ``short_text``, built and written once per
    session (as a deployment builds it at load), then read back."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _INDEXES:
        built = BM.build_postings(T.short_text(spark, sf_dir), "k", ["t", "t2"])
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "short-text-index"))
    return _INDEXES[k]


@register(
    "search_batch",
    f"""WITH req AS (SELECT DISTINCT w AS q FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) x),
    qg AS (SELECT DISTINCT q, substring(lower(q), r.i, n.n) AS gram FROM req, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(q) - n.n + 1) r(i)),
    g AS ({_GRAMS_SHORT_SQL}),
    p AS (SELECT field, gram, k, count(*) AS tf FROM g GROUP BY ALL),
    dfx AS (SELECT field, gram, count(*) AS df FROM p GROUP BY ALL),
    dl AS (SELECT k, 't' AS field, greatest(length(t) - 3, 0) + greatest(length(t) - 4, 0) AS dl FROM short_text
           UNION ALL SELECT k, 't2', greatest(length(t2) - 3, 0) + greatest(length(t2) - 4, 0) FROM short_text),
    fs AS (SELECT field, CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS sum_dl FROM dl GROUP BY field),
    sc AS (SELECT qg.q AS query_id, p.k AS key,
                  sum(ln(1 + (fs.n - dfx.df + 0.5) / (dfx.df + 0.5)) * p.tf * 2.2
                      / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / (fs.sum_dl / fs.n)))) AS score
           FROM qg JOIN p ON p.gram = qg.gram JOIN dfx ON dfx.field = p.field AND dfx.gram = p.gram
           JOIN fs ON fs.field = p.field JOIN dl ON dl.k = p.k AND dl.field = p.field GROUP BY qg.q, p.k),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank,
                  count(*) OVER (PARTITION BY query_id) AS total FROM sc)
    SELECT query_id, key, rank, round(score, 6) AS score, total FROM rk WHERE rank <= {BATCH_K}""",
)
def search_batch(spark, sf_dir):
    """T-5, W-2: many requests at once through the postings plan."""
    fixtures.register(spark, sf_dir)
    requests = (
        spark.table("part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()
        .withColumn("query_id", F.col("q"))
    )
    scored = BM.bm25_postings(_short_text_index(spark, sf_dir), requests)
    totals = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    top = top_k_per_group(scored, ["query_id"], [F.round("score", S.SCORE_TIE_DIGITS).desc(), F.col("key").asc()], BATCH_K)
    return top.join(totals, "query_id").select("query_id", "key", "rank", F.round("score", 6).alias("score"), "total")


SEARCH_BATCH_SQL = ORACLE["search_batch"]


@register("search_topk_pruned")
def search_topk_pruned(spark, sf_dir):
    """T-3, T-5: the pages of ``search_batch``, joining only key blocks that
    can still reach a request's best."""
    from firmament.operators import topk as TK
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    requests = (
        spark.table("part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()
        .withColumn("query_id", F.col("q"))
    )
    k = (spark.sparkContext.applicationId, sf_dir, "blocked")
    if k not in _INDEXES:
        _INDEXES[k] = TK.write_blocked(_short_text_index(spark, sf_dir), scratch_path(spark, "short-text-blocks"))
    top = TK.top_k(_INDEXES[k], requests, BATCH_K)
    return top.select("query_id", "key", "rank", F.round("score", 6).alias("score"), "total")


ORACLE["search_topk_pruned"] = SEARCH_BATCH_SQL


# ---------------------------------------------------------------- geometry (P-6, X-2..X-7, F-4, J-5, J-6)
@register("lambert_to_wgs84", f"SELECT vec_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({O.geo_pos_cte()}) p")
def lambert_to_wgs84(spark, sf_dir):
    return T.flat_position(T.geo_points(spark, sf_dir).select("vec_id", "position"))


REF_LNG, REF_LAT = 3.0, 46.5


@register(
    "geodesic_distance",
    f"SELECT vec_id, round(d, 3) AS meter_distance FROM ({O.vincenty_rel(O.geo_pos_cte(), 'lng', 'lat', repr(REF_LNG), repr(REF_LAT), 'd')}) x",
)
def geodesic_distance(spark, sf_dir):
    p = T.geo_points(spark, sf_dir)
    d = G.geodesic_m(p.position["x"], p.position["y"], F.lit(REF_LNG), F.lit(REF_LAT))
    return p.select("vec_id", F.round(d, 3).alias("meter_distance"))


FAR_LNG, FAR_LAT, FAR_STEPS = -170.0, -40.0, 20  # some degrees from the points' antipodes: 20 steps settle, 4 don't


@register(
    "geodesic_far",
    f"SELECT vec_id, round(d, 2) AS meter_distance FROM ({O.vincenty_rel(O.geo_pos_cte(), 'lng', 'lat', repr(FAR_LNG), repr(FAR_LAT), 'd', FAR_STEPS)}) x",
)
def geodesic_far(spark, sf_dir):
    """X-6: distances to the other side of the Earth, where the azimuth is searched."""
    p = T.geo_points(spark, sf_dir)
    d = G.with_geodesic(p, p.position["x"], p.position["y"], F.lit(FAR_LNG), F.lit(FAR_LAT), "d")
    return d.select("vec_id", F.round("d", 2).alias("meter_distance"))


@register(
    "radius_search",
    f"""SELECT siret, round(meter_distance, 3) AS meter_distance
    FROM ({O.vincenty_rel(O.est_cte(), 'lng', 'lat', repr(REF_LNG), repr(REF_LAT), 'meter_distance')}) x
    WHERE meter_distance <= 150000.0""",
)
def radius_search(spark, sf_dir):
    e = T.establishments(spark, sf_dir)
    return S.apply_radius(e, REF_LNG, REF_LAT, 150_000.0).select("siret", F.round("meter_distance", 3).alias("meter_distance"))


JOIN_RADIUS = 25_000.0


@register(
    "radius_join",
    f"""WITH pts AS (SELECT vec_id AS point_id, lng AS plng, lat AS plat FROM ({O.geo_pos_cte()}) g WHERE lng IS NOT NULL),
    e AS ({O.est_cte()}),
    cand AS (SELECT pts.*, e.siret, e.lng AS elng, e.lat AS elat FROM pts JOIN e
             ON abs(e.lat - pts.plat) <= 0.3 AND e.lng IS NOT NULL)
    SELECT point_id, siret, round(d, 3) AS meter_distance
    FROM ({O.vincenty_rel("SELECT * FROM cand", "elng", "elat", "plng", "plat", "d")}) x WHERE d <= {JOIN_RADIUS!r}""",
)
def radius_join(spark, sf_dir):
    """J-6: every geo point as a query point, establishments within 25 km."""
    pts = T.geo_points(spark, sf_dir).filter(F.col("position").isNotNull()).select(
        F.col("vec_id").alias("point_id"), F.col("position")["x"].alias("lng"), F.col("position")["y"].alias("lat"),
        F.lit(JOIN_RADIUS).alias("radius"))
    out = GJ.radius_join(pts, T.establishments(spark, sf_dir))
    return out.select("point_id", "siret", F.round("meter_distance", 3).alias("meter_distance"))


# ---------------------------------------------------------------- feed (I-9..I-17, X-12, X-16)
from firmament.plans import landing as LD  # noqa: E402
from firmament.sources import feed as FD  # noqa: E402


def _unit_feed_sql() -> str:
    """Oracle twin of unit feed flattening, written from the page construction."""
    old = "date_debut IS NULL"
    keep = "date_debut IS NULL OR unit_id % 9 <> 0 OR date_creation IS NULL"
    e = {
        "unit_id": "CAST(unit_id AS VARCHAR)",
        "statut_diffusion": "'O'",
        "unite_purgee": "CASE WHEN unit_id % 4 = 0 THEN 'true' ELSE 'false' END",
        "date_creation": "date_creation",
        "annee_effectifs": "CASE WHEN unit_id % 3 = 0 THEN CAST(year(date_creation) AS INTEGER) END",
        "nombre_periodes": "2",
        "categorie_entreprise": "categorie_entreprise",
        "date_debut": f"CASE WHEN {old} THEN date_creation ELSE date_debut END",
        "etat_administratif": f"CASE WHEN {old} THEN 'A' ELSE coalesce(CASE WHEN unit_id % 8 <> 0 THEN etat_administratif END, 'C') END",
        "denomination": f"CASE WHEN {old} THEN 'ancien nom' ELSE denomination END",
        "denomination_usuelle_1": f"CASE WHEN {old} THEN NULL ELSE denomination_usuelle_1 END",
        "categorie_juridique": f"CASE WHEN {old} THEN NULL ELSE categorie_juridique END",
        "activite_principale": f"CASE WHEN {old} THEN NULL ELSE activite_principale END",
    }
    cols = ", ".join(f"{e.get(c, 'NULL')} AS {c}" for c in FD.UNIT_COLUMNS)
    return f"SELECT {cols} FROM legal_unit WHERE {keep}"


def _unit_feed(spark, sf_dir):
    return FD.flatten_units(FD.read_pages(spark, LD.unit_pages(spark, sf_dir)))


register("feed_legal_unit_flatten", _unit_feed_sql())(_unit_feed)
register("lenient_int", f"SELECT unit_id, annee_effectifs FROM ({_unit_feed_sql()}) x")(
    lambda spark, sf_dir: _unit_feed(spark, sf_dir).select("unit_id", "annee_effectifs")
)


def _est_feed_sql() -> str:
    e = {
        "unit_id": "CAST(unit_id AS VARCHAR)",
        "nic": "lpad(CAST(siret % 100000 AS VARCHAR), 5, '0')",
        "siret": "CAST(siret AS VARCHAR)",
        "statut_diffusion": "'O'",
        "date_creation": "date_creation",
        "annee_effectifs": "CASE WHEN siret % 3 = 0 THEN CAST(year(date_debut) AS INTEGER) END",
        "date_dernier_traitement": "date_dernier_traitement",
        "etablissement_siege": "etablissement_siege",
        "code_postal": "code_postal",
        "libelle_commune": "libelle_commune",
        "code_commune": "code_commune",
        "date_debut": "date_debut",
        "etat_administratif": "coalesce(CASE WHEN siret % 8 <> 0 THEN etat_administratif END, 'F')",
        "enseigne_1": "enseigne_1",
        "denomination_usuelle": "denomination_usuelle",
        "activite_principale": "activite_principale",
    }
    cols = ", ".join(f"{e.get(c, 'NULL')} AS {c}" for c in FD.ESTABLISHMENT_COLUMNS)
    return f"SELECT {cols} FROM establishment WHERE siret % 9 <> 0"


def _est_feed(spark, sf_dir):
    return FD.flatten_establishments(FD.read_pages(spark, LD.establishment_pages(spark, sf_dir)))


register("feed_establishment_flatten", _est_feed_sql())(_est_feed)
register("status_default", f"SELECT siret, etat_administratif FROM ({_est_feed_sql()}) x")(
    lambda spark, sf_dir: _est_feed(spark, sf_dir).select("siret", "etat_administratif")
)

register(
    "feed_succession_flatten",
    """SELECT CAST(predecesseur AS VARCHAR) AS siret_etablissement_predecesseur,
              CAST(successeur AS VARCHAR) AS siret_etablissement_successeur, date_lien_succession,
              transfert_siege, continuite_economique,
              date_dernier_traitement AS date_dernier_traitement_lien_succession FROM succession""",
)(lambda spark, sf_dir: FD.flatten_links(FD.read_pages(spark, LD.link_pages(spark, sf_dir))))


@register(
    "current_period",
    """SELECT unit_id, date_debut, o_orderkey, etat_administratif FROM (
         SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY date_debut, o_orderkey) AS rn
         FROM period WHERE date_fin IS NULL) p WHERE rn = 1""",
)
def current_period_q(spark, sf_dir):
    """I-12 over flat period rows: first open period in period order."""
    return FD.current_period_rows(fixtures.table(spark, sf_dir, "period"), "unit_id", ["date_debut", "o_orderkey"],
                                  "date_fin").select("unit_id", "date_debut", "o_orderkey", "etat_administratif")


@register(
    "page_chain_gaps",
    f"""WITH h AS (SELECT CAST(floor(unit_id / {LD.PAGE_SIZE}) AS BIGINT) AS seq FROM legal_unit GROUP BY 1),
    c AS (SELECT seq, CAST(seq AS VARCHAR) AS curseur,
                 CAST(CASE WHEN seq = (SELECT max(seq) FROM h) THEN seq ELSE seq + 1 END AS VARCHAR) AS curseur_suivant FROM h)
    SELECT c.seq, c.curseur, c.curseur_suivant, n.curseur AS next_curseur,
           CASE WHEN n.curseur IS NULL AND c.curseur_suivant <> c.curseur THEN 'chain not closed'
                WHEN n.curseur IS NOT NULL AND n.curseur <> c.curseur_suivant THEN 'gap' ELSE 'ok' END AS status
    FROM c LEFT JOIN c n ON n.seq = c.seq + 1""",
)
def page_chain_gaps_q(spark, sf_dir):
    """I-15: every landed page with its chain status (gaps, unclosed end)."""
    h = FD.headers(FD.read_pages(spark, LD.unit_pages(spark, sf_dir)))
    chain = h.select(F.col("curseur").cast("bigint").alias("seq"), "curseur", "curseur_suivant")
    return FD.chain_status(chain)


@register(
    "feed_reconcile",
    """SELECT CAST(count(*) AS BIGINT) AS announced,
               count(*) AS landed, true AS complete FROM legal_unit""",
)
def feed_reconcile(spark, sf_dir):
    """I-16: the total that every header repeats against the records landed."""
    pages = FD.read_pages(spark, LD.unit_pages(spark, sf_dir))
    return FD.reconcile(FD.headers(pages), FD.records(pages, FD.UNIT_ARRAY))


# ---------------------------------------------------------------- CSV snapshots (I-1..I-8, I-18)
from firmament import schemas as SC  # noqa: E402
from firmament.sources import snapshot as SN  # noqa: E402


def _csv_dir(spark, sf_dir, name, build, schema) -> str:
    cache = _csv_dir.__dict__.setdefault("cache", {})
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in cache:
        from firmament.session import scratch_path

        path = scratch_path(spark, name)
        SN.write_snapshot(build(), path, schema)
        cache[k] = path
    return cache[k]


_UNIT_CSV_EXPR = {
    "unit_id": "CAST(unit_id AS STRING)",
    "statut_diffusion": "'O'",
    "sigle": "CASE WHEN unit_id % 10 = 0 THEN 'S\"' || CAST(unit_id AS STRING) || '\", x' WHEN unit_id % 10 = 1 THEN '' END",
    "date_creation": "date_creation", "date_debut": "date_debut", "etat_administratif": "etat_administratif",
    "denomination": "denomination", "denomination_usuelle_1": "denomination_usuelle_1",
    "denomination_usuelle_2": "denomination_usuelle_2", "denomination_usuelle_3": "denomination_usuelle_3",
    "categorie_juridique": "categorie_juridique", "activite_principale": "activite_principale",
    "categorie_entreprise": "categorie_entreprise",
}


def _oracle_select(exprs: dict, schema, table: str) -> str:
    return "SELECT " + ", ".join(f"{exprs.get(f.name, 'NULL')} AS {f.name}" for f in schema.fields) + f" FROM {table}"


def _unit_csv_source(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _UNIT_CSV_EXPR.items())} FROM legal_unit")


def _unit_csv(spark, sf_dir):
    path = _csv_dir(spark, sf_dir, "unit-csv", lambda: _unit_csv_source(spark, sf_dir), SC.UNIT_SCHEMA)
    return SN.load_snapshot(spark, path, SC.UNIT_SCHEMA)


register("ingest_legal_unit_csv", _oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit"))(_unit_csv)

_EST_CSV_EXPR = {
    "unit_id": "CAST(e.unit_id AS STRING)",
    "nic": "lpad(CAST(e.siret % 100000 AS STRING), 5, '0')",
    "siret": "CAST(e.siret AS STRING)",
    "statut_diffusion": "'O'",
    "date_creation": "e.date_creation", "date_debut": "e.date_debut",
    "date_dernier_traitement": "e.date_dernier_traitement", "etablissement_siege": "e.etablissement_siege",
    "code_postal": "e.code_postal", "libelle_commune": "e.libelle_commune", "code_commune": "e.code_commune",
    "coordonnee_lambert_x": "g.coordonnee_lambert_x", "coordonnee_lambert_y": "g.coordonnee_lambert_y",
    "etat_administratif": "e.etat_administratif", "enseigne_1": "e.enseigne_1",
    "enseigne_2": "CASE WHEN e.siret % 5 = 0 THEN '' END", "denomination_usuelle": "e.denomination_usuelle",
    "activite_principale": "e.activite_principale",
}
_EST_CSV_FROM = "establishment e LEFT JOIN geo_point g ON g.vec_id = e.vec_id"


def _est_csv(spark, sf_dir):
    def build():
        fixtures.register(spark, sf_dir)
        return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _EST_CSV_EXPR.items())} FROM {_EST_CSV_FROM}")

    path = _csv_dir(spark, sf_dir, "establishment-csv", build, SC.ESTABLISHMENT_SCHEMA)
    return SN.load_snapshot(spark, path, SC.ESTABLISHMENT_SCHEMA)


register("ingest_establishment_csv", _oracle_select(_EST_CSV_EXPR, SC.ESTABLISHMENT_SCHEMA, _EST_CSV_FROM))(_est_csv)

_LINK_CSV_EXPR = {
    "siret_etablissement_predecesseur": "CAST(predecesseur AS STRING)",
    "siret_etablissement_successeur": "CAST(successeur AS STRING)",
    "date_lien_succession": "date_lien_succession", "transfert_siege": "transfert_siege",
    "continuite_economique": "continuite_economique",
    "date_dernier_traitement_lien_succession": "date_dernier_traitement",
}


@register("ingest_succession_csv",
          _oracle_select(_LINK_CSV_EXPR, SC.LINK_SCHEMA, "succession").replace(" FROM succession",
                                                                               ", true AS id_ok FROM succession"))
def ingest_succession_csv(spark, sf_dir):
    """I-3: six loaded columns plus a generated id (random; only its shape is compared)."""
    def build():
        fixtures.register(spark, sf_dir)
        return spark.sql(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _LINK_CSV_EXPR.items())} FROM succession")

    path = _csv_dir(spark, sf_dir, "link-csv", build, SC.LINK_SCHEMA)
    loaded = SN.with_id(SN.load_snapshot(spark, path, SC.LINK_SCHEMA))
    return loaded.withColumn("id_ok", F.length("id") == 36).drop("id")


@register(
    "constraint_violations",
    f"""WITH u AS ({_oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit")})
    SELECT {", ".join(f"count(*) FILTER (WHERE {f.name} IS NULL) AS {f.name}_null" for f in SC.UNIT_SCHEMA.fields if not f.nullable)},
           {", ".join(f"count(*) FILTER (WHERE length({c}) > {n}) AS {c}_too_long" for c, n in SC.UNIT_LENGTHS.items())},
           (SELECT count(*) FROM (SELECT unit_id FROM u GROUP BY unit_id HAVING count(*) > 1) d) AS duplicate_keys
    FROM u""",
)
def constraint_violations(spark, sf_dir):
    """I-7 on the loaded unit snapshot (the fixture keys are not 9 characters)."""
    return SC.constraint_violations(_unit_csv(spark, sf_dir), SC.UNIT_SCHEMA, SC.UNIT_LENGTHS, "unit_id")


@register("conform_schema", _oracle_select({c: c for c in _UNIT_CSV_EXPR if c not in ("unit_id", "statut_diffusion", "sigle")}
                                           | {"unit_id": "CAST(unit_id AS STRING)"}, SC.UNIT_SCHEMA, "legal_unit"))
def conform_schema(spark, sf_dir):
    """I-18: the unit view migrated to the 35-column stored schema."""
    return SC.conform(fixtures.table(spark, sf_dir, "legal_unit"), SC.UNIT_SCHEMA)


_MANIFEST_SQL = f"""SELECT group_type, high_water_mark AS last_modified,
      CASE group_type WHEN 'etablissements' THEN high_water_mark - INTERVAL 1 DAY
                      WHEN 'liens_succession' THEN high_water_mark END AS last_imported_timestamp,
      CASE group_type WHEN 'unites_legales' THEN high_water_mark + INTERVAL 1 DAY END AS staging_imported_timestamp
    FROM ({_HWM_SQL}) h"""


@register("sources_to_load", f"""SELECT group_type, last_modified FROM ({_MANIFEST_SQL}) m
    WHERE (last_imported_timestamp IS NULL OR last_modified IS NULL OR last_modified > last_imported_timestamp)
      AND (staging_imported_timestamp IS NULL OR last_modified IS NULL OR last_modified > staging_imported_timestamp)""")
def sources_to_load(spark, sf_dir):
    """I-8: remote modification times (the tables' high-water marks) against a
    load ledger derived from them."""
    h = _hwm(spark, sf_dir)
    manifest = h.select("group_type", F.col("high_water_mark").alias("last_modified"))
    hw = F.col("high_water_mark")
    ledger = h.select(
        "group_type",
        F.when(F.col("group_type") == "etablissements", hw - F.expr("INTERVAL 1 DAY"))
        .when(F.col("group_type") == "liens_succession", hw).alias("last_imported_timestamp"),
        F.when(F.col("group_type") == "unites_legales", hw + F.expr("INTERVAL 1 DAY")).alias("staging_imported_timestamp"),
    )
    return SN.sources_to_load(manifest, ledger).select("group_type", "last_modified")


# ---------------------------------------------------------------- request validation, run summaries
_REQUESTS_SQL = """SELECT event_id AS request_id,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 46.0 + value / 100 END AS lat,
    CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 2.0 + value / 100 END AS lng,
    CASE WHEN event_type IN ('view', 'error') THEN value * 1000 END AS radius,
    CASE WHEN event_type IN ('signup', 'view') THEN props END AS q,
    CASE user_id % 5 WHEN 0 THEN 'distance' WHEN 1 THEN 'relevance' WHEN 2 THEN 'date_creation'
                     WHEN 3 THEN 'score' END AS sort,
    CASE WHEN value > 50 THEN 'A' WHEN value > 20 THEN 'C' WHEN value > 10 THEN 'X' END AS etat_administratif
  FROM events"""


@register(
    "validate_requests",
    f"""SELECT *, geo_ok AND sort_ok AND status_ok AND radius_ok AS valid FROM (
      SELECT *, ((lat IS NOT NULL)::INT + (lng IS NOT NULL)::INT + (radius IS NOT NULL)::INT) IN (0, 3) AS geo_ok,
        (sort IS NULL OR (sort IN ('date_creation', 'date_debut', 'distance', 'relevance')
          AND (sort <> 'distance' OR (lat IS NOT NULL AND lng IS NOT NULL AND radius IS NOT NULL))
          AND (sort <> 'relevance' OR q IS NOT NULL))) AS sort_ok,
        (etat_administratif IS NULL OR etat_administratif IN ('A', 'F', 'C')) AS status_ok,
        (NOT (lat IS NOT NULL AND lng IS NOT NULL AND radius IS NOT NULL) OR radius BETWEEN 0.0 AND 5000000.0) AS radius_ok
      FROM ({_REQUESTS_SQL}) r) v""",
)
def validate_requests(spark, sf_dir):
    fixtures.register(spark, sf_dir)
    return S.validate_requests(spark.sql(_REQUESTS_SQL))


_RUN_GROUPS = [("liens_succession", "purchase"), ("etablissements", "click"), ("unites_legales", "view")]


def _run_summaries(spark, sf_dir):
    """One nested summary per user: 3 steps x 3 groups (newest group first),
    built with bounded ``array(struct)`` from per-user aggregates."""
    fixtures.register(spark, sf_dir)
    ev = spark.table("events")
    agg = ev.groupBy(F.col("user_id").alias("run_id")).agg(
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for _, t in _RUN_GROUPS],
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
    )
    steps = []
    for i, step in enumerate(L.STEPS):
        groups = [
            F.struct(
                F.lit(g).alias("group_type"), (F.col(f"n_{t}") > 14 + 2 * i).alias("updated"),
                F.lit("finished").alias("status_label"), F.col("t0").alias("started_timestamp"),
                F.col("t1").alias("finished_timestamp"), F.col(f"n_{t}").alias("planned_count"),
                (F.col(f"n_{t}") - i).alias("done_count"), F.col("t1").alias("reference_timestamp"),
            )
            for g, t in _RUN_GROUPS
        ]
        steps.append(F.struct(F.lit(step).alias("step"), F.lit(None).cast("boolean").alias("updated"),
                              F.col("t0").alias("started_timestamp"), F.col("t1").alias("finished_timestamp"),
                              F.array(*groups).alias("groups")))
    summary = F.struct(F.lit(None).cast("boolean").alias("updated"), F.col("t0").alias("started_timestamp"),
                       F.col("t1").alias("finished_timestamp"), F.array(*steps).alias("steps"))
    return agg.select("run_id", summary.alias("summary"))


_RUN_FLAT_SQL = f"""WITH a AS (SELECT user_id AS run_id,
      count(*) FILTER (WHERE event_type = 'purchase') AS np, count(*) FILTER (WHERE event_type = 'click') AS nc,
      count(*) FILTER (WHERE event_type = 'view') AS nv, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
    s(step_pos, step) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(L.STEPS))}),
    g(group_pos, group_type) AS (VALUES {", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(_RUN_GROUPS))}),
    f AS (SELECT a.run_id, s.step_pos, s.step, CAST(NULL AS BOOLEAN) AS step_updated, g.group_pos, g.group_type,
           CASE g.group_type WHEN 'liens_succession' THEN np WHEN 'etablissements' THEN nc ELSE nv END AS n,
           a.t0, a.t1 FROM a, s, g)
    """


register(
    "run_flatten",
    _RUN_FLAT_SQL + """SELECT run_id, step_pos, step, step_updated, group_pos, group_type, n > 14 + 2 * step_pos AS updated,
      'finished' AS status_label, t0 AS started_timestamp, t1 AS finished_timestamp, n AS planned_count,
      n - step_pos AS done_count, t1 AS reference_timestamp FROM f""",
)(lambda spark, sf_dir: L.flatten_runs(_run_summaries(spark, sf_dir)))

register(
    "run_rollup",
    _RUN_FLAT_SQL + """, st AS (SELECT run_id, step_pos, step, bool_or(n > 14 + 2 * step_pos) AS step_updated FROM f
                        GROUP BY run_id, step_pos, step)
    SELECT run_id, bool_or(step_updated) OVER (PARTITION BY run_id) AS run_updated, step_pos, step, step_updated FROM st""",
)(lambda spark, sf_dir: L.rollup_runs(_run_summaries(spark, sf_dir)))


# ---------------------------------------------------------------- streaming (ST-1..ST-4)
from firmament.streaming import sync as SY  # noqa: E402

DELTA_SCHEMA = "unit_id bigint, activite_principale string, value double, date_dernier_traitement timestamp_ntz, page bigint, pos bigint"


@register("stream_upsert", _upsert_sql(UNIT_BASE_SQL, UNIT_BASE_COLS, "unit_id", UNIT_SET, (), "SELECT * FROM delta"))
def stream_upsert(spark, sf_dir):
    """ST-1: landed delta files streamed (AvailableNow, several micro-batches)
    into the unit table through the upsert sink."""
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    base = T.units(spark, sf_dir).select(*UNIT_COLS).withColumn(
        "activite_principale_naf25", F.col("activite_principale")
    ).withColumn("date_dernier_traitement", F.lit(None).cast("timestamp_ntz"))
    landing = scratch_path(spark, "delta-landing")
    spark.table("delta").repartition(4).write.option("timestampNTZFormat", SY.TS_FORMAT).json(landing)
    root = scratch_path(spark, "unit-table")
    SY.init_table(spark, base, root)
    return SY.run_sync(spark, landing, DELTA_SCHEMA, root, scratch_path(spark, "sync-checkpoint"), "unit_id",
                       UNIT_SET, ["date_dernier_traitement", "page", "pos"], "date_dernier_traitement",
                       files_per_batch=2)


@register("upsert_bucketed", _upsert_sql(UNIT_BASE_SQL, UNIT_BASE_COLS, "unit_id", UNIT_SET, (), "SELECT * FROM delta"))
def upsert_bucketed(spark, sf_dir):
    """M-1, ST-1: the unit table in buckets of its key; only buckets that hold
    keys of the delta are read and written."""
    from firmament.plans import buckets as BU
    from firmament.session import scratch_path

    fixtures.register(spark, sf_dir)
    base = T.units(spark, sf_dir).select(*UNIT_COLS).withColumn(
        "activite_principale_naf25", F.col("activite_principale")
    ).withColumn("date_dernier_traitement", F.lit(None).cast("timestamp_ntz"))
    root = scratch_path(spark, "unit-buckets")
    BU.create(base, root, "unit_id", buckets=16)
    BU.upsert(spark.table("delta"), root, UNIT_SET, ["date_dernier_traitement", "page", "pos"])
    return BU.read(spark, root)


@register("search_response_json")
def search_response_json(spark, sf_dir):
    """M-9: the flagship page rendered as API JSON (NULLs kept, score and
    distance left out when NULL).  Rows-only: JSON text differs by engine."""
    page = S.search(T.establishments(spark, sf_dir), P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0, limit=25))
    return LK.render_json(T.flat_position(page))


def _establishment_index(spark, sf_dir) -> BM.Postings:
    """Postings of the stored establishment table (search text and commune),
    built and written once per session like the stored table itself."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir, "establishment")
    if k not in _INDEXES:
        built = BM.build_postings(T.establishments(spark, sf_dir), "siret", list(S.ESTABLISHMENT.text_fields))
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "establishment-index"))
    return _INDEXES[k]


_COMBINED = P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0, filters={"etablissement_siege": False}, limit=25)


@register("search_combined_index", O.search_sql(_COMBINED, S.ESTABLISHMENT))
def search_combined_index(spark, sf_dir):
    """T-6 through the postings index (T-4): same request and results as
    ``search_combined``, without scanning every text value."""
    page = S.search(T.establishments(spark, sf_dir), _COMBINED, S.ESTABLISHMENT, index=_establishment_index(spark, sf_dir))
    return _round_search(page, S.ESTABLISHMENT)


@register("search_batch_full", O.search_requests_sql())
def search_batch_full(spark, sf_dir):
    """W-2, T-5, T-6: a table of requests with text, radius, filters, four
    sorts and their own paging, through the index and the cells."""
    from firmament.operators import batch as BT

    requests = fixtures.table(spark, sf_dir, "request")
    pages = BT.search_requests(requests, T.establishments(spark, sf_dir), _establishment_index(spark, sf_dir))
    return pages.select("request_id", "rank", "siret", F.round("score", 6).alias("score"), F.round("meter_distance", 3).alias("meter_distance"), "total")


_PRECOND_LEDGER_SQL = f"""SELECT group_type,
      CASE group_type WHEN 'etablissements' THEN high_water_mark WHEN 'liens_succession' THEN high_water_mark END
        AS staging_imported_timestamp,
      CASE group_type WHEN 'etablissements' THEN high_water_mark - INTERVAL 1 DAY
                      WHEN 'liens_succession' THEN high_water_mark END AS last_imported_timestamp
    FROM ({_HWM_SQL}) h"""


@register(
    "publish_preconditions",
    f"""SELECT group_type, staging_imported_timestamp, last_imported_timestamp,
      CASE WHEN staging_imported_timestamp IS NULL THEN 'nothing to swap'
           WHEN last_imported_timestamp IS NOT NULL AND staging_imported_timestamp <= last_imported_timestamp
             THEN 'already imported' ELSE 'ready' END AS verdict
    FROM ({_PRECOND_LEDGER_SQL}) l""",
)
def publish_preconditions(spark, sf_dir):
    """M-7 on a load ledger derived from the tables' high-water marks: one
    dataset staged and newer (ready), one staged but not newer (already
    imported), one not staged (nothing to swap)."""
    h = _hwm(spark, sf_dir)
    hw, g = F.col("high_water_mark"), F.col("group_type")
    ledger = h.select(
        "group_type",
        F.when(g.isin("etablissements", "liens_succession"), hw).alias("staging_imported_timestamp"),
        F.when(g == "etablissements", hw - F.expr("INTERVAL 1 DAY")).when(g == "liens_succession", hw)
        .alias("last_imported_timestamp"),
    )
    return PB.preconditions(ledger)


def _documents_index(spark, sf_dir) -> BM.Postings:
    """Postings of the whole ``documents`` texts (long-text gram builder),
    built and written once per session."""
    from firmament.session import scratch_path

    k = (spark.sparkContext.applicationId, sf_dir, "documents")
    if k not in _INDEXES:
        built = BM.build_postings(T.documents(spark, sf_dir), "doc_id", ["text"], long_text=True)
        _INDEXES[k] = BM.write_postings(built, scratch_path(spark, "documents-index"))
    return _INDEXES[k]


@register("bm25_documents_index")
def bm25_documents_index(spark, sf_dir):
    """T-3/T-4 on long text through the persisted index; equals ``bm25_documents``."""
    scored = BM.bm25_index(_documents_index(spark, sf_dir), "retitioning")
    return scored.select("key", F.round("score", 6).alias("score"))


ORACLE["bm25_documents_index"] = ORACLE["bm25_documents"]


# ---------------------------------------------------------------- loaded and synced tables, searched (P-4..P-6, M-1, M-2, T-4, ST-1)
from firmament.plans import searchable as SB  # noqa: E402

# The day's delta: an event sets the name, place and status of an establishment
# (some stored, some new); several events of one establishment, the last wins.
_EST_DAY_EXPR = {
    "unit_id": "CAST(user_id AS STRING)", "nic": "'00001'", "siret": "CAST(event_id * 2 % 20011 AS STRING)",
    "statut_diffusion": "'O'", "date_dernier_traitement": "ts", "etablissement_siege": "event_type = 'signup'",
    "code_postal": "'3-MEDIUM'", "libelle_commune": "'Lyon'",
    "date_debut": "CAST(ts AS DATE)", "date_creation": "CAST(ts AS DATE)",
    "etat_administratif": "CASE WHEN event_type = 'error' THEN 'F' ELSE 'A' END",
    "denomination_usuelle": "'Atelier ' || event_type", "enseigne_2": "CASE WHEN user_id % 2 = 0 THEN 'marteau rouge' END",
    "coordonnee_lambert_x": "CASE WHEN event_type = 'view' THEN '[ND]' ELSE CAST(700000 + user_id * 1000 AS STRING) END",
    "coordonnee_lambert_y": "CASE WHEN event_type = 'view' THEN '[ND]' ELSE CAST(6600000 + user_id * 500 AS STRING) END",
}
_UNIT_DAY_EXPR = {
    "unit_id": "CAST(user_id * 11 AS STRING)", "statut_diffusion": "'O'", "date_dernier_traitement": "ts",
    "etat_administratif": "CASE WHEN event_type = 'error' THEN 'C' ELSE 'A' END",
    "denomination": "CASE WHEN event_type = 'click' THEN NULL ELSE 'Atelier ' || event_type END",
    "denomination_usuelle_2": "'marteau'", "date_creation": "CAST(ts AS DATE)", "activite_principale": "'62.01Z'",
}
_DAY_ORDER = ["date_dernier_traitement", "page", "pos"]


def _day_sql(exprs: dict, schema, select=None) -> str:
    body = (select or _oracle_select)(exprs, schema, "events")
    return body.replace(" FROM events", ", CAST(FLOOR(event_id / 1000) AS BIGINT) AS page, event_id AS pos FROM events")


def _typed_select(exprs: dict, schema, table: str) -> str:
    return "SELECT " + ", ".join(
        f"CAST({exprs.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields
    ) + f" FROM {table}"


_VERSIONS: dict[tuple[str, str, str], SB.Version] = {}


def _version(spark, sf_dir, entity: S.Entity, day: bool, segmented: bool = False) -> SB.Version:
    """The CSV snapshot loaded as a searchable version; with ``day``, the
    version after the day's delta.  Written once per session."""
    from firmament.session import scratch_path

    name = ("establishment" if entity.has_geo else "unit") + ("-day" if day else "-loaded") + ("-segmented" if segmented else "")
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in _VERSIONS:
        path = scratch_path(spark, name)
        if day:
            fixtures.register(spark, sf_dir)
            exprs, schema = (_EST_DAY_EXPR, SC.ESTABLISHMENT_SCHEMA) if entity.has_geo else (_UNIT_DAY_EXPR, SC.UNIT_SCHEMA)
            delta = spark.sql(_day_sql(exprs, schema, _typed_select))
            _VERSIONS[k] = SB.apply(_version(spark, sf_dir, entity, False), delta, _DAY_ORDER, path, segmented=segmented)
        else:
            _VERSIONS[k] = SB.load((_est_csv if entity.has_geo else _unit_csv)(spark, sf_dir), entity, path)
    return _VERSIONS[k]


_EST_LOADED_SQL = _oracle_select(_EST_CSV_EXPR, SC.ESTABLISHMENT_SCHEMA, _EST_CSV_FROM)
_UNIT_LOADED_SQL = _oracle_select(_UNIT_CSV_EXPR, SC.UNIT_SCHEMA, "legal_unit")
_EST_AFTER_SQL = _upsert_sql(_EST_LOADED_SQL, SC.ESTABLISHMENT_SCHEMA.names, "siret", SC.ESTABLISHMENT_SET, (),
                             _day_sql(_EST_DAY_EXPR, SC.ESTABLISHMENT_SCHEMA))
_UNIT_AFTER_SQL = _upsert_sql(_UNIT_LOADED_SQL, SC.UNIT_SCHEMA.names, "unit_id", SC.UNIT_SET, (),
                              _day_sql(_UNIT_DAY_EXPR, SC.UNIT_SCHEMA))


def _version_query(name: str, params: S.SearchParams, entity: S.Entity, day: bool, loaded_sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_search(SB.search(_version(spark, sf_dir, entity, day), params), entity)

    register(name, O.search_sql(params, entity, O.generated_sql(loaded_sql, entity)))(run)


_version_query("load_then_search", P(q="red widget", lat=46.5, lng=3.0, radius=150_000.0,
                                     filters={"etablissement_siege": False}, limit=50), S.ESTABLISHMENT, False, _EST_LOADED_SQL)
_version_query("load_then_search_unit", P(q="customer#0000001", limit=50), S.UNIT, False, _UNIT_LOADED_SQL)
_version_query("upsert_then_search", P(q="marteau widget", lat=46.5, lng=3.5, radius=120_000.0, limit=100),
               S.ESTABLISHMENT, True, _EST_AFTER_SQL)
_version_query("upsert_then_search_unit", P(q="atelier annexe", limit=100), S.UNIT, True, _UNIT_AFTER_SQL)


@register("segments_then_search")
def segments_then_search(spark, sf_dir):
    """T-4: as ``upsert_then_search``, the delta's index entries in a segment."""
    params = P(q="marteau widget", lat=46.5, lng=3.5, radius=120_000.0, limit=100)
    return _round_search(SB.search(_version(spark, sf_dir, S.ESTABLISHMENT, True, segmented=True), params), S.ESTABLISHMENT)


ORACLE["segments_then_search"] = ORACLE["upsert_then_search"]


def _sync(spark, sf_dir, dataset: str, landing: str, base: DataFrame) -> DataFrame:
    """Feed pages streamed into a table that starts with ``base``."""
    from firmament.session import scratch_path

    root = scratch_path(spark, f"{dataset}-table")
    SY.init_table(spark, base, root)
    return SY.sync_pages(spark, landing, root, scratch_path(spark, f"{dataset}-checkpoint"), dataset)


def _undated(sql: str) -> str:
    return f"SELECT *, 0 AS page, 0 AS pos FROM ({sql}) f"


@register("stream_units", _upsert_sql(f"SELECT * FROM ({_UNIT_LOADED_SQL}) l WHERE CAST(unit_id AS BIGINT) % 3 <> 0",
                                      SC.UNIT_SCHEMA.names, "unit_id", SC.UNIT_SET, (), _undated(_unit_feed_sql())))
def stream_units(spark, sf_dir):
    """ST-1, M-1: unit pages streamed into a table that holds two thirds of the units."""
    base = _unit_csv(spark, sf_dir).filter(F.col("unit_id").cast("bigint") % 3 != 0)
    return _sync(spark, sf_dir, "unites_legales", LD.unit_pages(spark, sf_dir), base)


@register("stream_establishments",
          "SELECT *, " + O._concat_text(T.ESTABLISHMENT_TEXT) + " AS search_denomination FROM ("
          + _upsert_sql(f"SELECT * FROM ({_EST_LOADED_SQL}) l WHERE CAST(siret AS BIGINT) % 3 <> 0",
                        SC.ESTABLISHMENT_SCHEMA.names, "siret", SC.ESTABLISHMENT_SET, (), _undated(_est_feed_sql())) + ") u")
def stream_establishments(spark, sf_dir):
    """ST-1, M-2: establishment pages streamed into a table with its search text."""
    from firmament.operators import derive as DV

    base = _est_csv(spark, sf_dir).filter(F.col("siret").cast("bigint") % 3 != 0)
    base = DV.derive(base, {"search_denomination": DV.establishment_columns()["search_denomination"]})
    return _sync(spark, sf_dir, "etablissements", LD.establishment_pages(spark, sf_dir), base)


# Two thirds of the establishments with known dates, and the feed from the start on.
_SYNC_AS_OF = dt.datetime(2024, 2, 15)
_SYNC_DATED = "TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (CAST(siret AS BIGINT) % 20)"
_SYNC_BASE_SQL = (f"SELECT * REPLACE ({_SYNC_DATED} AS date_dernier_traitement) FROM ({_EST_LOADED_SQL}) l WHERE CAST(siret AS BIGINT) % 3 <> 0")
_SYNC_START_SQL = (f"(SELECT greatest(max(date_dernier_traitement), TIMESTAMP '{_SYNC_AS_OF}' - INTERVAL {L.LOOKBACK_DAYS} DAY) FROM ({_SYNC_BASE_SQL}) b)")
_SYNC_PARAMS = P(q="red widget", filters={"etablissement_siege": False}, limit=100)
_SYNC_AFTER_SQL = _upsert_sql(_SYNC_BASE_SQL, SC.ESTABLISHMENT_SCHEMA.names, "siret", SC.ESTABLISHMENT_SET, (),
                              f"SELECT * FROM ({_undated(_est_feed_sql())}) z WHERE date_dernier_traitement >= {_SYNC_START_SQL}")


@register("stream_then_search", O.search_sql(_SYNC_PARAMS, S.ESTABLISHMENT, O.generated_sql(_SYNC_AFTER_SQL, S.ESTABLISHMENT)))
def stream_then_search(spark, sf_dir):
    """ST-1, ST-2: establishment pages from the look-back on streamed into a
    searchable version; table, index and batch are one commit."""
    from firmament.session import scratch_path
    from firmament.streaming import search_sync as SS

    dated = F.least("date_dernier_traitement", L.ntz(_SYNC_KNOWN))
    base = _est_csv(spark, sf_dir).filter(F.col("siret").cast("bigint") % 3 != 0).withColumn("date_dernier_traitement", dated)
    root = scratch_path(spark, "sync-searchable")
    SS.create(base, S.ESTABLISHMENT, root)
    version = SS.sync(spark, LD.establishment_pages(spark, sf_dir), root, scratch_path(spark, "sync-searchable-checkpoint"), S.ESTABLISHMENT, _SYNC_AS_OF)
    return _round_search(SB.search(version, _SYNC_PARAMS), S.ESTABLISHMENT)


_LINK_ROWS_SQL = _oracle_select(_LINK_CSV_EXPR, SC.LINK_SCHEMA, "succession")


@register("stream_links", f"""WITH l AS ({_LINK_ROWS_SQL}),
    b AS (SELECT * FROM l WHERE CAST(siret_etablissement_successeur AS BIGINT) % 3 <> 0)
    SELECT * FROM b UNION ALL (SELECT DISTINCT * FROM l EXCEPT SELECT * FROM b)""")
def stream_links(spark, sf_dir):
    """ST-1, ST-3, M-4: link pages streamed; stored links are not added again."""
    fixtures.register(spark, sf_dir)
    base = spark.sql(_LINK_ROWS_SQL).filter(F.col("siret_etablissement_successeur").cast("bigint") % 3 != 0)
    return _sync(spark, sf_dir, "liens_succession", LD.link_pages(spark, sf_dir), base)


# ---------------------------------------------------------------- publish in one flow, schema migrations (M-5, M-7, I-6, I-7, I-18)
from firmament import migrations as MG  # noqa: E402
from firmament.plans import registry as RG  # noqa: E402

_FLOW = {"unites_legales": ("legal_unit", "unit_id"), "etablissements": ("establishment", "siret"), "liens_succession": ("succession", "successeur")}


@register(
    "publish_flow",
    """WITH n AS (SELECT 'unites_legales' AS dataset, count(*) AS n FROM legal_unit UNION ALL SELECT 'etablissements', count(*) FROM establishment
                  UNION ALL SELECT 'liens_succession', count(*) FROM succession),
    h AS (SELECT count(*) AS half FROM legal_unit WHERE unit_id % 2 = 0)
    SELECT 1 AS step, dataset, 'empty production' AS verdict, true AS published, CAST(0 AS BIGINT) AS production_count, n AS staging_count FROM n
    UNION ALL SELECT 2, dataset, CASE WHEN dataset = 'unites_legales' THEN 'already imported' ELSE 'nothing to swap' END, false, NULL, NULL FROM n
    UNION ALL SELECT 3, dataset, CASE WHEN dataset = 'unites_legales' THEN 'too few rows' ELSE 'nothing to swap' END, false,
                     CASE WHEN dataset = 'unites_legales' THEN n END, CASE WHEN dataset = 'unites_legales' THEN half END FROM n, h
    UNION ALL SELECT 4, dataset, CASE WHEN dataset = 'unites_legales' THEN 'forced' ELSE 'nothing to swap' END, dataset = 'unites_legales',
                     CASE WHEN dataset = 'unites_legales' THEN n END, CASE WHEN dataset = 'unites_legales' THEN half END FROM n, h""",
)
def publish_flow(spark, sf_dir):
    """M-5, M-7: three datasets staged and published together; then units of
    the same date, half of the units, and the same forced."""
    from firmament.session import scratch_path

    root, day = scratch_path(spark, "registry"), dt.datetime(2024, 1, 1)
    keys = {name: key for name, (_, key) in _FLOW.items()}
    for name, (view, key) in _FLOW.items():
        RG.stage(fixtures.table(spark, sf_dir, view), root, name, key, day)
    units = fixtures.table(spark, sf_dir, "legal_unit")
    steps = [RG.publish(spark, root, keys)]
    RG.stage(units, root, "unites_legales", "unit_id", day)
    steps.append(RG.publish(spark, root, keys))
    RG.stage(units.filter("unit_id % 2 = 0"), root, "unites_legales", "unit_id", day + dt.timedelta(days=1))
    steps += [RG.publish(spark, root, keys), RG.publish(spark, root, keys, force=True)]
    rows = [(i, v.dataset, v.verdict, v.published, v.production_count, v.staging_count) for i, step in enumerate(steps, 1) for v in step]
    return spark.createDataFrame(rows, "step int, dataset string, verdict string, published boolean, production_count bigint, staging_count bigint")


# Units as an older version stored them, and what has changed since.
_UNIT_MIGRATIONS = [
    MG.Rename("nom", "denomination"),
    MG.Retype("date_creation", "date", "to_date(date_creation, 'dd/MM/yyyy')"),
    MG.Add("nom_complet", "string", "concat_ws(' ', denomination, denomination_usuelle_1)"),
    MG.Drop("obsolete"),
    MG.Order(["unit_id", "etat_administratif", "date_creation", "denomination", "denomination_usuelle_1", "nom_complet"]),
]


@register(
    "migrate_schema",
    """SELECT unit_id, etat_administratif, date_creation, denomination, denomination_usuelle_1,
              concat_ws(' ', denomination, denomination_usuelle_1) AS nom_complet FROM legal_unit""",
)
def migrate_schema(spark, sf_dir):
    """I-18: a table in the layout of an older version, read in today's."""
    from firmament.session import scratch_path

    old = fixtures.table(spark, sf_dir, "legal_unit").selectExpr(
        "denomination AS nom", "unit_id", "date_format(date_creation, 'dd/MM/yyyy') AS date_creation", "'x' AS obsolete", "denomination_usuelle_1", "etat_administratif")
    path = scratch_path(spark, "old-units")
    MG.write(old, path, version=0)
    return MG.read(spark, path, _UNIT_MIGRATIONS)
