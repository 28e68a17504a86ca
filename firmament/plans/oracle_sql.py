"""DuckDB SQL builders for the oracle side of the parity check.

DuckDB here has neither spatial nor full-text extensions, so projection,
geodesic distance and BM25 are written as plain arithmetic over CTE chains.
These builders only produce SQL text for the checker; the engine itself
never uses them.
"""

from __future__ import annotations

import math

from firmament.functions import geo as G
from firmament.functions.text import query_grams
from firmament.plans.tables import ESTABLISHMENT_TEXT, UNIT_TEXT


def _chain(src: str, steps: list[str]) -> str:
    """``SELECT *, <step> FROM (...)`` nested once per step."""
    sql = src
    for s in steps:
        sql = f"SELECT *, {s} FROM ({sql}) _t"
    return sql


def lambert_rel(src: str, x: str = "x", y: str = "y") -> str:
    """Adds ``lng``, ``lat`` to a relation with text/number columns x, y."""
    e = G.LAMBERT_E
    steps = [
        f"CASE WHEN {x} IS NULL OR {y} IS NULL OR CAST({x} AS VARCHAR) = '[ND]' THEN NULL "
        f"ELSE CAST({x} AS DOUBLE) - {G.LAMBERT_XS!r} END AS _dx",
        f"CASE WHEN {x} IS NULL OR {y} IS NULL OR CAST({x} AS VARCHAR) = '[ND]' THEN NULL "
        f"ELSE {G.LAMBERT_YS!r} - CAST({y} AS DOUBLE) END AS _dy",
        "atan2(_dx, _dy) AS _gamma",
        f"exp(-ln(sqrt(_dx * _dx + _dy * _dy) / {G.LAMBERT_C!r}) / {G.LAMBERT_N!r}) AS _L",
        f"2 * atan(_L) - {math.pi / 2!r} AS _phi0",
    ]
    for k in range(1, G.LAMBERT_ITERATIONS + 1):
        p = f"_phi{k - 1}"
        steps.append(
            f"2 * atan(pow((1 + {e!r} * sin({p})) / (1 - {e!r} * sin({p})), {e / 2!r}) * _L) - {math.pi / 2!r} AS _phi{k}"
        )
    steps.append(f"{G.LAMBERT_LON0_DEG!r} + degrees(_gamma / {G.LAMBERT_N!r}) AS lng")
    steps.append(f"degrees(_phi{G.LAMBERT_ITERATIONS}) AS lat")
    return _chain(src, steps)


def vincenty_rel(src: str, lng1: str, lat1: str, lng2: str, lat2: str, out: str = "dist", n: int = G.VINCENTY_ITERATIONS) -> str:
    """Adds ``out`` (metres) to a relation by ``n`` steps, the engine's number unless told."""
    f, a, b = G.WGS84_F, G.WGS84_A, G.WGS84_B
    steps = [
        f"radians({lng2} - {lng1}) AS _vl",
        f"atan((1 - {f!r}) * tan(radians({lat1}))) AS _u1",
        f"atan((1 - {f!r}) * tan(radians({lat2}))) AS _u2",
        "sin(_u1) AS _su1", "cos(_u1) AS _cu1", "sin(_u2) AS _su2", "cos(_u2) AS _cu2",
        "_vl AS _lam0",
    ]
    for k in range(1, n + 1):
        steps += [
            f"sin(_lam{k - 1}) AS _sl{k}",
            f"cos(_lam{k - 1}) AS _cl{k}",
            f"sqrt(pow(_cu2 * _sl{k}, 2) + pow(_cu1 * _su2 - _su1 * _cu2 * _cl{k}, 2)) AS _ss{k}",
            f"_su1 * _su2 + _cu1 * _cu2 * _cl{k} AS _cs{k}",
            f"atan2(_ss{k}, _cs{k}) AS _sg{k}",
            f"CASE WHEN _ss{k} = 0 THEN 0.0 ELSE _cu1 * _cu2 * _sl{k} / _ss{k} END AS _sa{k}",
            f"1 - _sa{k} * _sa{k} AS _ca{k}",
            f"CASE WHEN _ca{k} = 0 THEN 0.0 ELSE _cs{k} - 2 * _su1 * _su2 / _ca{k} END AS _cm{k}",
            f"{f / 16!r} * _ca{k} * (4 + {f!r} * (4 - 3 * _ca{k})) AS _kc{k}",
            f"_vl + (1 - _kc{k}) * {f!r} * _sa{k} * (_sg{k} + _kc{k} * _ss{k} * (_cm{k} + _kc{k} * _cs{k} * (-1 + 2 * _cm{k} * _cm{k}))) AS _lam{k}",
        ]
    steps += [
        f"_ca{n} * {(a * a - b * b) / (b * b)!r} AS _usq",
        "1 + _usq / 16384 * (4096 + _usq * (-768 + _usq * (320 - 175 * _usq))) AS _ba",
        "_usq / 1024 * (256 + _usq * (-128 + _usq * (74 - 47 * _usq))) AS _bb",
        f"_bb * _ss{n} * (_cm{n} + _bb / 4 * (_cs{n} * (-1 + 2 * _cm{n} * _cm{n}) - _bb / 6 * _cm{n} * (-3 + 4 * _ss{n} * _ss{n}) * (-3 + 4 * _cm{n} * _cm{n}))) AS _dsig",
        f"{b!r} * _ba * (_sg{n} - _dsig) AS {out}",
    ]
    return _chain(src, steps)


def _concat_text(cols) -> str:
    return " || ' ' || ".join(f"coalesce({c}, '')" for c in cols)


def geo_pos_cte() -> str:
    return lambert_rel("SELECT vec_id, coordonnee_lambert_x AS x, coordonnee_lambert_y AS y FROM geo_point")


def est_cte() -> str:
    """Establishments with search text and lng/lat (oracle twin of tables.establishments)."""
    return (
        f"SELECT e.*, p.lng, p.lat, {_concat_text(ESTABLISHMENT_TEXT)} AS search_denomination "
        f"FROM establishment e LEFT JOIN ({geo_pos_cte()}) p ON p.vec_id = e.vec_id"
    )


def unit_cte() -> str:
    return f"SELECT u.*, {_concat_text(UNIT_TEXT)} AS search_denomination FROM legal_unit u"


def _dl(s: str) -> str:
    return f"(greatest(length({s}) - 3, 0) + greatest(length({s}) - 4, 0))"


def bm25_rel(src: str, key: str, fields: list[str], q: str | None, long_text: bool = False) -> str:
    """``(key, score)`` of rows of ``src`` containing any gram of ``q``."""
    grams = query_grams(q)
    if not grams:
        return f"SELECT {key} AS key, CAST(NULL AS DOUBLE) AS score FROM ({src}) _s WHERE false"
    values = ", ".join("('" + g.replace("'", "''") + "')" for g in grams)
    norm = ", ".join(f"lower(coalesce({f}, '')) AS s{i}" for i, f in enumerate(fields))
    dls = " + ".join(f"0" for _ in fields)
    parts_pos = []
    for i, _ in enumerate(fields):
        if long_text:
            parts_pos.append(
                f"""SELECT key, {i} AS field, g FROM (
                  SELECT key, c || coalesce(c1,'') || coalesce(c2,'') || coalesce(c3,'') AS g4,
                         c || coalesce(c1,'') || coalesce(c2,'') || coalesce(c3,'') || coalesce(c4,'') AS g5,
                         c3 IS NOT NULL AS ok4, c4 IS NOT NULL AS ok5
                  FROM (SELECT key, c, lead(c,1) OVER w AS c1, lead(c,2) OVER w AS c2, lead(c,3) OVER w AS c3,
                               lead(c,4) OVER w AS c4
                        FROM (SELECT key, unnest(string_split(s{i}, '')) AS c,
                                     unnest(range(1, length(s{i}) + 1)) AS pos FROM T) _c
                        WINDOW w AS (PARTITION BY key ORDER BY pos)) _l) _m,
                LATERAL (SELECT g4 AS g WHERE ok4 UNION ALL SELECT g5 WHERE ok5) _u"""
            )
        else:
            parts_pos.append(
                f"SELECT key, {i} AS field, substring(s{i}, r.i, n.n) AS g FROM T, (VALUES (4), (5)) n(n), "
                f"LATERAL generate_series(1, length(s{i}) - n.n + 1) r(i)"
            )
    pos_sql = " UNION ALL ".join(parts_pos)
    dl_cols = ", ".join(f"CAST({_dl(f's{i}')} AS DOUBLE) AS dl{i}" for i, _ in enumerate(fields))
    sdl = ", ".join(f"CAST(sum(dl{i}) AS DOUBLE) AS sdl{i}" for i, _ in enumerate(fields))
    dl_case = "CASE tf.field " + " ".join(f"WHEN {i} THEN d.dl{i}" for i, _ in enumerate(fields)) + " END"
    avg_case = "CASE tf.field " + " ".join(f"WHEN {i} THEN st.sdl{i} / st.n" for i, _ in enumerate(fields)) + " END"
    del dls
    return f"""
    WITH T AS (SELECT {key} AS key, {norm} FROM ({src}) _s),
    D AS (SELECT key, {dl_cols} FROM T),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, {sdl} FROM D),
    q(g) AS (VALUES {values}),
    pos AS ({pos_sql}),
    tf AS (SELECT key, field, g, CAST(count(*) AS DOUBLE) AS tf FROM pos WHERE g IN (SELECT g FROM q) GROUP BY ALL),
    dfx AS (SELECT field, g, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL)
    SELECT tf.key AS key,
           sum(ln(1 + (st.n - dfx.df + 0.5) / (dfx.df + 0.5)) * tf.tf * {1.2 + 1!r}
               / (tf.tf + 1.2 * (0.25 + 0.75 * ({dl_case}) / ({avg_case})))) AS score
    FROM tf JOIN dfx ON dfx.field = tf.field AND dfx.g = tf.g JOIN D d ON d.key = tf.key CROSS JOIN st
    GROUP BY tf.key
    """


def _lit(v) -> str:
    import datetime as _dt

    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, _dt.date):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("'", "''") + "'"


def generated_sql(src: str, entity) -> str:
    """Rows of loaded columns with search text and, for establishments, lng/lat."""
    text = ESTABLISHMENT_TEXT if entity.has_geo else UNIT_TEXT
    if entity.has_geo:
        src = lambert_rel(src, "coordonnee_lambert_x", "coordonnee_lambert_y")
    return f"SELECT *, {_concat_text(text)} AS search_denomination FROM ({src}) _l"


def search_sql(p, entity, src: str | None = None) -> str:
    """Oracle twin of :func:`firmament.operators.search.search`, over ``src``
    (default: the whole fixture table of the entity)."""
    from firmament.operators import search as S

    r = S.validate(p, entity)
    src = src or (est_cte() if entity.has_geo else unit_cte())
    key = entity.key
    if r.has_q:
        scores = bm25_rel(src, key, list(entity.text_fields), p.q)
        m = f"SELECT b.*, s.score FROM ({src}) b JOIN ({scores}) s ON s.key = b.{key}"
    else:
        m = f"SELECT b.*, CAST(NULL AS DOUBLE) AS score FROM ({src}) b"
    conds = [f"{k} = {_lit(v)}" for k, v in p.filters.items()]
    if conds:
        m = f"SELECT * FROM ({m}) _f WHERE " + " AND ".join(conds)
    if r.has_geo:
        m = vincenty_rel(m, "lng", "lat", repr(float(p.lng)), repr(float(p.lat)), "meter_distance")
        m = f"SELECT * FROM ({m}) _g WHERE meter_distance <= {float(p.radius)!r}"
    elif entity.has_geo:
        m = f"SELECT *, CAST(NULL AS DOUBLE) AS meter_distance FROM ({m}) _g"
    sort_col = {"date_creation": "date_creation", "date_debut": "date_debut",
                "distance": "meter_distance", "relevance": "score"}[r.sort]
    cols = [c for c in entity.columns if c != "position"]
    out = ", ".join(cols)
    if entity.has_geo:
        out += ", round(lng, 6) AS lng, round(lat, 6) AS lat, round(meter_distance, 3) AS meter_distance"
    out += ", round(score, 6) AS score, (SELECT count(*) FROM m) AS total"
    order = f"round({sort_col}, 9)" if r.sort == "relevance" else sort_col
    return (
        f"WITH m AS ({m}) SELECT {out} FROM m ORDER BY {order} {r.direction.upper()} NULLS LAST, {key} "
        f"LIMIT {r.limit} OFFSET {r.offset}"
    )


def search_requests_sql() -> str:
    """Oracle twin of :func:`firmament.operators.batch.search_requests` over the
    fixture requests: every request against every row."""
    from firmament.operators import search as S

    null_tolerant = " AND ".join(f"(r.{f} IS NULL OR r.{f} = e.{f})" for f in S.ESTABLISHMENT_FILTERS)
    grams = " UNION ALL ".join(
        f"SELECT k, {i} AS field, substring(s{i}, r.i, n.n) AS gram FROM t, (VALUES (4), (5)) n(n), LATERAL generate_series(1, length(s{i}) - n.n + 1) r(i)"
        for i in range(2)
    )
    lengths = " UNION ALL ".join(f"SELECT k, {i} AS field, {_dl(f's{i}')} AS dl FROM t" for i in range(2))
    near = vincenty_rel("SELECT * FROM m", "lng", "lat", "r_lng", "r_lat", "d")
    return f"""WITH req AS (SELECT *, coalesce(sort, CASE WHEN q IS NOT NULL THEN 'relevance' ELSE 'date_creation' END) AS by_,
      coalesce(direction, CASE WHEN sort = 'distance' THEN 'asc' ELSE 'desc' END) AS dir_,
      least({S.MAX_LIMIT}, greatest(1, coalesce("limit", {S.DEFAULT_LIMIT}))) AS lim_, least({S.MAX_OFFSET}, greatest(0, coalesce("offset", 0))) AS off_
      FROM request WHERE etat_administratif IS NULL OR etat_administratif IN ('A', 'F', 'C')),
    e AS ({est_cte()}),
    t AS (SELECT siret AS k, lower(coalesce(search_denomination, '')) AS s0, lower(coalesce(libelle_commune, '')) AS s1 FROM e),
    qg AS (SELECT DISTINCT q, substring(lower(q), r.i, n.n) AS gram FROM (SELECT DISTINCT q FROM req WHERE q IS NOT NULL) x, (VALUES (4), (5)) n(n),
           LATERAL generate_series(1, length(q) - n.n + 1) r(i)),
    p AS (SELECT field, gram, k, CAST(count(*) AS DOUBLE) AS tf FROM ({grams}) g WHERE gram IN (SELECT gram FROM qg) GROUP BY field, gram, k),
    dfx AS (SELECT field, gram, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY field, gram),
    dl AS ({lengths}),
    fs AS (SELECT field, CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS sum_dl FROM dl GROUP BY field),
    sc AS (SELECT qg.q, p.k, sum(ln(1 + (fs.n - dfx.df + 0.5) / (dfx.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / (fs.sum_dl / fs.n)))) AS score
           FROM qg JOIN p ON p.gram = qg.gram JOIN dfx ON dfx.field = p.field AND dfx.gram = p.gram
           JOIN fs ON fs.field = p.field JOIN dl ON dl.k = p.k AND dl.field = p.field GROUP BY qg.q, p.k),
    m AS (SELECT r.request_id, r.by_, r.dir_, r.lim_, r.off_, r.radius AS r_radius, r.lng AS r_lng, r.lat AS r_lat, e.siret, e.date_creation, e.date_debut, e.lng, e.lat, sc.score
          FROM req r JOIN e ON {null_tolerant} LEFT JOIN sc ON sc.q = r.q AND sc.k = e.siret WHERE r.q IS NULL OR sc.score IS NOT NULL),
    f AS (SELECT *, CASE WHEN r_radius IS NOT NULL THEN d END AS meter_distance FROM ({near}) x WHERE r_radius IS NULL OR d <= r_radius),
    v AS (SELECT *, CASE by_ WHEN 'date_creation' THEN CAST(date_creation - DATE '1970-01-01' AS DOUBLE) WHEN 'date_debut' THEN CAST(date_debut - DATE '1970-01-01' AS DOUBLE)
                         WHEN 'distance' THEN meter_distance ELSE round(score, 9) END AS val FROM f),
    rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN dir_ = 'desc' THEN -val ELSE val END ASC NULLS LAST, siret) AS rank,
                  count(*) OVER (PARTITION BY request_id) AS total FROM v)
    SELECT request_id, rank, siret, round(score, 6) AS score, round(meter_distance, 3) AS meter_distance, total FROM rk WHERE rank > off_ AND rank <= off_ + lim_"""
