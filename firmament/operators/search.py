"""Search: filters, text relevance, radius, sort, paging and total.

One request is a :class:`SearchParams`; the result is a DataFrame of at most
``limit`` rows with a ``total`` column (the number of matches, independent of
the page).  Through an index, page and total come from one evaluation of the
matches (:func:`page_and_total`).  Otherwise the page is a single
``TakeOrderedAndProject`` with offset and the total a scalar subquery (partial
counts per task).

Deviations from the reference, on purpose (each has a test):

* every sort ends with the key, so pages are stable;
* ``total`` counts all matches even for a page past the end;
* status ``C`` is accepted by the status filter (units are stored with it);
* distance ordering uses the exact ellipsoidal distance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.functions import geo
from firmament.operators.bm25 import bm25_scan


# Paging bounds and the status domain.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
MAX_OFFSET = 10_000
STATUS_VALUES = ("A", "F", "C")
SCORE_TIE_DIGITS = 9
PAGE_PARTS = 32  # in which the matches of one request are ordered and counted

ESTABLISHMENT_FILTERS = (
    "etat_administratif",
    "code_postal",
    "unit_id",
    "code_commune",
    "activite_principale",
    "etablissement_siege",
)
UNIT_FILTERS = (
    "etat_administratif",
    "activite_principale",
    "categorie_juridique",
    "categorie_entreprise",
    "date_creation",
    "date_debut",
)
ESTABLISHMENT_SORTS = ("date_creation", "date_debut", "distance", "relevance")
UNIT_SORTS = ("date_creation", "date_debut", "relevance")

ESTABLISHMENT_COLUMNS = (
    "siret",
    "unit_id",
    "etat_administratif",
    "date_creation",
    "denomination_usuelle",
    "enseigne_1",
    "enseigne_2",
    "enseigne_3",
    "code_postal",
    "libelle_commune",
    "activite_principale",
    "etablissement_siege",
    "position",
)
UNIT_COLUMNS = (
    "unit_id",
    "etat_administratif",
    "date_creation",
    "denomination",
    "denomination_usuelle_1",
    "denomination_usuelle_2",
    "denomination_usuelle_3",
    "activite_principale",
    "categorie_juridique",
    "categorie_entreprise",
)


@dataclass(frozen=True)
class Entity:
    key: str
    text_fields: tuple[str, ...]
    filters: tuple[str, ...]
    sorts: tuple[str, ...]
    columns: tuple[str, ...]
    has_geo: bool


ESTABLISHMENT = Entity(
    "siret", ("search_denomination", "libelle_commune"), ESTABLISHMENT_FILTERS, ESTABLISHMENT_SORTS,
    ESTABLISHMENT_COLUMNS, True,
)
UNIT = Entity("unit_id", ("search_denomination",), UNIT_FILTERS, UNIT_SORTS, UNIT_COLUMNS, False)


@dataclass
class SearchParams:
    q: str | None = None
    lat: float | None = None
    lng: float | None = None
    radius: float | None = None
    filters: dict = field(default_factory=dict)
    sort: str | None = None
    direction: str | None = None
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Resolved:
    """Applied paging and sort, echoed with the response."""

    limit: int
    offset: int
    sort: str
    direction: str
    has_geo: bool
    has_q: bool


def clamp(v: int | None, default: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, default if v is None else int(v)))


def validate(params: SearchParams, entity: Entity) -> Resolved:
    """Request checks; raise ``ValueError`` with the reason (HTTP 400)."""
    geo_given = [params.lat is not None, params.lng is not None, params.radius is not None]
    if any(geo_given) and not all(geo_given):
        raise ValueError("lat, lng and radius must be given together")
    has_geo = all(geo_given)
    if has_geo and not entity.has_geo:
        raise ValueError("geographic search is not available for this entity")
    if has_geo:
        geo.check_radius(params.radius)
    has_q = params.q is not None
    for name in params.filters:
        if name not in entity.filters:
            raise ValueError(f"unknown filter {name!r}")
    status = params.filters.get("etat_administratif")
    if status is not None and status not in STATUS_VALUES:
        raise ValueError(f"etat_administratif must be one of {STATUS_VALUES}")
    sort = params.sort or ("relevance" if has_q else "date_creation")
    if sort not in entity.sorts:
        raise ValueError(f"unknown sort {sort!r}")
    if sort == "distance" and not has_geo:
        raise ValueError("sort=distance needs lat, lng and radius")
    if sort == "relevance" and not has_q:
        raise ValueError("sort=relevance needs q")
    direction = params.direction or ("asc" if sort == "distance" else "desc")
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    return Resolved(
        limit=clamp(params.limit, DEFAULT_LIMIT, 1, MAX_LIMIT),
        offset=clamp(params.offset, 0, 0, MAX_OFFSET),
        sort=sort,
        direction=direction,
        has_geo=has_geo,
        has_q=has_q,
    )


def sort_columns(r: Resolved, key: str) -> list[Column]:
    """ORDER BY of a resolved request; NULLS LAST both ways, then the key."""
    source = {
        "date_creation": "date_creation",
        "date_debut": "date_debut",
        "distance": "meter_distance",
        "relevance": "score",
    }[r.sort]
    c = F.col(source)
    if r.sort == "relevance":
        # Scores summed in another order differ in the last bits; ties are
        # decided by the key after rounding to 1e-9.
        c = F.round(c, SCORE_TIE_DIGITS)
    primary = c.asc_nulls_last() if r.direction == "asc" else c.desc_nulls_last()
    return [primary, F.col(key).asc()]


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """AND of equality filters; a NULL value matches nothing, like ``=``."""
    for name, value in filters.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def apply_radius(df: DataFrame, lng: float, lat: float, radius_m: float, position: str = "position") -> DataFrame:
    """Keep rows within ``radius_m`` metres (inclusive), add ``meter_distance``.

    A box predicate runs first (it reaches the Parquet reader when position
    is stored); the exact distance runs only on rows inside the box.
    """
    pos = F.col(position)
    boxed = df.filter(pos.isNotNull() & geo.in_box(pos, lng, lat, radius_m))
    with_dist = geo.with_geodesic(boxed, pos["x"], pos["y"], F.lit(float(lng)), F.lit(float(lat)), "meter_distance")
    return with_dist.filter(F.col("meter_distance") <= F.lit(float(radius_m)))


def matches(df: DataFrame, params: SearchParams, entity: Entity, r: Resolved | None = None,
            index=None) -> DataFrame:
    """All matching rows with ``score`` and ``meter_distance`` (no paging).

    ``df`` is the whole table: text statistics are taken before filters.
    With ``index`` (a persisted :class:`~firmament.operators.bm25.Postings`
    of the same table and fields), scores come from the index instead of a
    scan of every text value; results are the same.
    """
    r = r or validate(params, entity)
    if r.has_q and index is not None:
        from firmament.operators.bm25 import bm25_index
        

        scores = bm25_index(index, params.q).withColumnRenamed("key", entity.key)
        out = df.join(scores, entity.key, "inner")
    elif r.has_q:
        out = bm25_scan(df, list(entity.text_fields), params.q)
    else:
        out = df.withColumn("score", F.lit(None).cast("double"))
    out = apply_filters(out, params.filters)
    if r.has_geo:
        out = apply_radius(out, params.lng, params.lat, params.radius)
    else:
        out = out.withColumn("meter_distance", F.lit(None).cast("double"))
    return out


def total(matched: DataFrame) -> Column:
    """Number of matches as a scalar subquery column."""
    return matched.agg(F.count(F.lit(1)).alias("total")).scalar()


def page_and_total(matched: DataFrame, r: Resolved, key: str, columns: list[str]) -> DataFrame:
    """The page of ``columns`` and ``total`` from one evaluation of the matches:
    each part is ordered and counted, and keeps offset + limit rows; the parts'
    heads are merged with their counts."""
    order = sort_columns(r, key)
    sorted_by = [c for c in ("date_creation", "date_debut") if c == r.sort and c not in columns]
    rows = matched.select(*columns, *sorted_by).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PAGE_PARTS)))
    own = Window.partitionBy("_part")
    placed = rows.withColumns({"_place": F.row_number().over(own.orderBy(*order)), "_n": F.count(F.lit(1)).over(own)})
    heads = placed.filter(F.col("_place") <= r.offset + r.limit)
    # PAGE_PARTS heads at most, of a page's depth each
    heads = heads.withColumn("total", F.sum(F.when(F.col("_place") == 1, F.col("_n"))).over(Window.partitionBy()))
    return heads.orderBy(*order).offset(r.offset).limit(r.limit).select(*columns, "total")


def search(df: DataFrame, params: SearchParams, entity: Entity = ESTABLISHMENT, index=None) -> DataFrame:
    """One page of results plus ``total``; see the module docstring."""
    r = validate(params, entity)
    m = matches(df, params, entity, r, index)
    columns = [c for c in entity.columns if c in df.columns]
    extra = ["meter_distance"] if entity.has_geo else []
    if index is not None and r.has_q:
        return page_and_total(m, r, entity.key, [*columns, *extra, "score"])
    page = m.orderBy(*sort_columns(r, entity.key)).offset(r.offset).limit(r.limit)
    return page.select(*columns, *extra, "score", total(m).alias("total"))


def page_meta(params: SearchParams, entity: Entity = ESTABLISHMENT) -> dict:
    """The applied limit, offset, sort and direction echoed by a response."""
    r = validate(params, entity)
    return {"limit": r.limit, "offset": r.offset, "sort": r.sort, "direction": r.direction}


def validate_requests(requests: DataFrame, entity: Entity = ESTABLISHMENT) -> DataFrame:
    """Batch form of :func:`validate`: verdict columns per request row.

    Expects nullable columns ``lat lng radius q sort etat_administratif``;
    adds ``geo_ok`` (0 or 3 geo parameters), ``sort_ok`` (distance needs geo,
    relevance needs q, known sort), ``status_ok`` (A, F or C), ``radius_ok``
    and ``valid``.
    """
    n_geo = sum(F.col(c).isNotNull().cast("int") for c in ("lat", "lng", "radius"))
    has_geo = n_geo == 3
    has_q = F.col("q").isNotNull()
    sort = F.col("sort")
    sort_ok = sort.isNull() | (
        sort.isin(*entity.sorts)
        & ((sort != F.lit("distance")) | has_geo)
        & ((sort != F.lit("relevance")) | has_q)
    )
    status_ok = F.col("etat_administratif").isNull() | F.col("etat_administratif").isin(*STATUS_VALUES)
    radius_ok = ~has_geo | (F.col("radius") >= F.lit(0.0))
    geo_ok = n_geo.isin(0, 3)
    return requests.select(
        "*",
        geo_ok.alias("geo_ok"),
        sort_ok.alias("sort_ok"),
        status_ok.alias("status_ok"),
        radius_ok.alias("radius_ok"),
        (geo_ok & sort_ok & status_ok & radius_ok).alias("valid"),
    )


def search_meta(df: DataFrame, params: SearchParams, entity: Entity = ESTABLISHMENT) -> DataFrame:
    """Response metadata as one row, even when nothing matches: ``total``
    (all matches) and the applied ``limit``, ``offset``, ``sort``,
    ``direction``."""
    r = validate(params, entity)
    return matches(df, params, entity, r).agg(
        F.count(F.lit(1)).alias("total"),
        F.lit(r.limit).alias("limit"),
        F.lit(r.offset).alias("offset"),
        F.lit(r.sort).alias("sort"),
        F.lit(r.direction).alias("direction"),
    )
