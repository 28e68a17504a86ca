"""BM25 over character n-grams, two plans with one scoring function.

score(d, q) = sum over fields f, over distinct query grams g of
    idf(f, g) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl_f))
idf(f, g)  = ln(1 + (N - df + 0.5) / (df + 0.5))

``N``, ``avgdl_f`` and ``df`` are statistics of the whole table, before any
filter.  ``dl`` is the number of grams of the field value (closed form), ``tf``
the overlapping occurrences of ``g``.

* Scan plan (:func:`bm25_scan`): one request, no index.  A statistics pass
  (``contains`` and ``length`` only, no regex) and a scoring pass over the rows
  that contain at least one query gram.
* Postings plan (:func:`build_postings`, :func:`bm25_postings`): many requests.
  Postings ``(field, gram, key, tf, dl)`` are built once, by shards of keys;
  request grams join them.  Results equal the scan plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.functions.text import (
    gram_length,
    gram_pattern,
    ngrams,
    ngrams_long,
    normalized,
    query_grams,
)
from firmament.operators.merge import merged_if_large
from firmament.session import drop_shuffles


# Fixed BM25 parameters.
K1 = 1.2
B = 0.75
GRAMS_PER_SHARD = 2_000_000  # counted and ordered by one task
SMALL_SHARD = 100_000


def _term(tf: Column, dl: Column, avgdl: Column, df: Column, n: Column, k1: float, b: float) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return F.when(tf > 0, idf * tf * F.lit(k1 + 1) / (tf + norm)).otherwise(F.lit(0.0))


def bm25_scan(
    df: DataFrame,
    fields: list[str],
    q: str | None,
    k1: float = K1,
    b: float = B,
    score_col: str = "score",
) -> DataFrame:
    """Rows of ``df`` that contain any gram of ``q`` in any field, plus ``score``.

    ``df`` must be the whole table (statistics are taken before filters);
    apply filters to the result.  ``q`` under 4 characters has no grams and
    matches nothing.
    """
    grams = query_grams(q)
    if not grams:
        return df.filter(F.lit(False)).withColumn(score_col, F.lit(None).cast("double"))

    # Normalized text and gram length are bound once per field as columns:
    # every gram term reads them, and repeating the expressions per term
    # multiplies both the work and the generated code.  Expressions are built
    # as SQL text (one JVM call each rather than one per operator).
    n_cols = [f"_bm25_n{i}" for i in range(len(fields))]
    prepared = df.select("*", *[normalized(f).alias(n) for f, n in zip(fields, n_cols)])
    stats_cols = ["CAST(count(1) AS DOUBLE) AS n"]
    for i, n in enumerate(n_cols):
        stats_cols.append(f"CAST(sum({_length_sql(n)}) AS DOUBLE) AS sdl{i}")
        for j, g in enumerate(grams):
            stats_cols.append(f"CAST(count_if(contains({n}, {sql_literal(g)})) AS DOUBLE) AS df{i}_{j}")
    stats = prepared.agg(*[F.expr(c) for c in stats_cols]).select(F.struct("*").alias("s")).scalar()
    any_hit = " OR ".join(f"contains({n}, {sql_literal(g)})" for n in n_cols for g in grams)

    # The statistics struct is bound once as a column: each reference to the
    # scalar subquery itself would carry (and optimize) its own copy of the plan.
    hits = prepared.filter(F.expr(any_hit)).select("*", stats.alias("_bm25_stats"))
    tf_cols = {}
    exprs = []
    for i, n in enumerate(n_cols):
        exprs.append(f"CAST({_length_sql(n)} AS DOUBLE) AS _bm25_l{i}")
        for j, g in enumerate(grams):
            tf_cols[(i, j)] = f"_bm25_tf{i}_{j}"
            exprs.append(
                f"CAST(CASE WHEN contains({n}, {sql_literal(g)}) THEN regexp_count({n}, {sql_literal(gram_pattern(g))}) "
                f"ELSE 0 END AS DOUBLE) AS _bm25_tf{i}_{j}"
            )
    hits = hits.selectExpr("*", *exprs)
    terms = []
    for i in range(len(n_cols)):
        avgdl = f"(_bm25_stats.sdl{i} / _bm25_stats.n)"
        for j in range(len(grams)):
            tf, dfc = tf_cols[(i, j)], f"_bm25_stats.df{i}_{j}"
            idf = f"ln(1.0D + (_bm25_stats.n - {dfc} + 0.5D) / ({dfc} + 0.5D))"
            norm = f"{k1!r}D * ({1.0 - b!r}D + {b!r}D * _bm25_l{i} / {avgdl})"
            terms.append(f"CASE WHEN {tf} > 0 THEN {idf} * {tf} * {k1 + 1!r}D / ({tf} + {norm}) ELSE 0.0D END")
    scored = hits.withColumn(score_col, F.expr(" + ".join(terms)))
    drop = [*n_cols, "_bm25_stats", *tf_cols.values(), *[f"_bm25_l{i}" for i in range(len(n_cols))]]
    return scored.drop(*drop)


def sql_literal(v: str) -> str:
    """A Spark SQL string literal for any text (backslash escapes)."""
    out = v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{out}'"


def _length_sql(n: str) -> str:
    return f"(greatest(length({n}) - 3, 0) + greatest(length({n}) - 4, 0))"


@dataclass
class Postings:
    """Inverted index: postings, per-gram document frequency, field stats."""

    postings: DataFrame  # field string, gram string, key, tf long, dl long
    grams: DataFrame  # field, gram, df long
    fields: DataFrame  # field, n long, sum_dl long
    sharded: bool = False  # postings as built or read back: a shard a task


def shards(df: DataFrame, fields: list[str]) -> list[int]:
    """For each field, in how many shards of ``GRAMS_PER_SHARD`` grams its texts
    are dealt out; small tables in a few per shuffle partition at most."""
    sums = df.agg(*[F.sum(gram_length(f).cast("long")) for f in fields]).first()  # a number per field
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [max(1, min(few, -(-(n or 0) // SMALL_SHARD)), -(-(n or 0) // GRAMS_PER_SHARD)) for n in sums]


def dealt(texts: DataFrame, n: int, *by: str) -> DataFrame:
    """Texts in ``n`` partitions by some of the columns that their grams are
    then counted by, which needs no further shuffle."""
    return texts.repartition(n, *by)


def range_parts(p: Postings) -> int:
    """Partitions of an index that is ordered anew, ``GRAMS_PER_SHARD`` grams each at most."""
    grams = p.fields.agg(F.sum("sum_dl").cast("long")).first()[0] or 0
    return max(int(p.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams // GRAMS_PER_SHARD))


def build_postings(df: DataFrame, key: str, fields: list[str], long_text: bool = False) -> Postings:
    """Grams per field, counted per (field, gram, key, dl).

    Texts are dealt out by key before grams are made (:func:`dealt`), so that
    a shard's grams are counted where they are made: no posting is shuffled,
    and the memory of a task doesn't grow with the table.
    """
    make = ngrams_long if long_text else ngrams
    parts = []
    for f, n in zip(fields, shards(df, fields)):
        # Length and gram array are computed before the explode: a text-wide
        # expression next to the generator would be evaluated once per gram.
        per_doc = dealt(df.select(F.col(key).alias("key"), F.col(f).alias("_text"), gram_length(f).alias("dl")), n, "key", "dl")
        exploded = per_doc.select("key", "dl", make("_text").alias("_grams")).select(F.explode("_grams").alias("gram"), "key", "dl")
        counted = exploded.groupBy("gram", "key", "dl").agg(F.count(F.lit(1)).alias("tf"))
        parts.append(counted.select(F.lit(f).alias("field"), "gram", "key", "dl", "tf"))
    postings = parts[0]
    for p in parts[1:]:
        postings = postings.unionByName(p)
    grams = postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df"))
    field_cols = []
    for f in fields:
        field_cols.append(
            df.select(F.lit(f).alias("field"), gram_length(f).alias("dl"))
        )
    flat = field_cols[0]
    for p in field_cols[1:]:
        flat = flat.unionByName(p)
    field_stats = flat.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("sum_dl"))
    return Postings(postings, grams, field_stats, sharded=True)


def write_postings(p: Postings, path: str, partitions: int | None = None, grams: DataFrame | None = None) -> Postings:
    """Persist the index: postings sorted by gram in every file so that a
    ``gram IN (...)`` predicate prunes pages and row groups, and the
    per-gram and per-field tables.  Gram counts are taken from the written
    postings (so the grams are made once) unless ``grams`` is given.

    Sharded postings are written shard by shard as they are, without a shuffle;
    others are range-partitioned, in partitions of a shard's size at most."""
    spark = p.postings.sparkSession
    out = p.postings
    if partitions or not p.sharded:
        # Files cover gram ranges (file-level min/max prune too); the key as last
        # range column splits a very common gram over several files.
        n = partitions or range_parts(p)
        out = out.repartitionByRange(n, "field", "gram", "key")
    out.sortWithinPartitions("field", "gram", "key").write.mode("overwrite").parquet(f"{path}/postings")
    drop_shuffles(spark)
    if grams is None:
        stored = spark.read.parquet(f"{path}/postings")
        grams = stored.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df"))
    grams.write.mode("overwrite").parquet(f"{path}/grams")
    p.fields.write.mode("overwrite").parquet(f"{path}/fields")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    """The index that :func:`write_postings` wrote at ``path``."""
    return Postings(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "grams", "fields")))


def _changed(before: DataFrame, after: DataFrame, key: str, fields: list[str], path: str) -> DataFrame:
    """(key, _old, _new) of the keys whose text changed, kept at ``path``."""
    old = before.select(F.col(key).alias("key"), F.struct(*fields).alias("_old"))
    new = after.select(F.col(key).alias("key"), F.struct(*fields).alias("_new"))
    old.join(new, "key", "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).write.parquet(f"{path}/changed")
    return before.sparkSession.read.parquet(f"{path}/changed")


def refresh_postings(p: Postings, before: DataFrame, after: DataFrame, key: str, fields: list[str], path: str,
                     long_text: bool = False) -> Postings:
    """The index after some rows changed, written at ``path`` (a fresh folder).

    ``before`` and ``after`` hold the key and text fields of those rows (a key
    only in one was inserted or deleted; rows with equal text are left out).
    Grams are made for changed rows alone; gram and field counts are the
    stored ones plus or minus theirs.
    """
    spark = p.postings.sparkSession
    changed = _changed(before, after, key, fields, path)
    gone = build_postings(changed.filter("_old IS NOT NULL").select("key", "_old.*"), "key", fields, long_text)
    come = build_postings(changed.filter("_new IS NOT NULL").select("key", "_new.*"), "key", fields, long_text)

    def balance(stored: DataFrame, minus: DataFrame, plus: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
        less = minus.select(*by, *[(-F.col(c)).alias(c) for c in sums])
        return stored.unionByName(less).unionByName(plus).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])

    grams = balance(p.grams, gone.grams, come.grams, ["field", "gram"], ["df"]).filter(F.col("df") > 0)
    stats = balance(p.fields, gone.fields, come.fields, ["field"], ["n", "sum_dl"])
    kept = p.postings.join(merged_if_large(changed.select("key"), changed.count()), "key", "left_anti")
    # what is kept stays in the shards that it came from
    return write_postings(Postings(kept.unionByName(come.postings), grams, stats, sharded=True), path, grams=grams)


def write_segment(before: DataFrame, after: DataFrame, key: str, fields: list[str], path: str, long_text: bool = False) -> None:
    """A delta of an index at ``path`` (a fresh folder): the keys whose text
    changed, their new postings, and what they add to and take from the counts.

    ``before`` and ``after`` are as for :func:`refresh_postings`; what is written
    is in proportion to them, whatever the index holds."""
    spark, changed = before.sparkSession, _changed(before, after, key, fields, path)
    gone = build_postings(changed.filter("_old IS NOT NULL").select("key", "_old.*"), "key", fields, long_text)
    come = build_postings(changed.filter("_new IS NOT NULL").select("key", "_new.*"), "key", fields, long_text)
    come.postings.sortWithinPartitions("field", "gram", "key").write.parquet(f"{path}/postings")
    come = Postings(spark.read.parquet(f"{path}/postings"), come.grams, come.fields)
    grams = come.postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df"))

    def difference(minus: DataFrame, plus: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
        less = minus.select(*by, *[(-F.col(c)).alias(c) for c in sums])
        return plus.unionByName(less).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])

    difference(gone.grams, grams, ["field", "gram"], ["df"]).filter("df <> 0").write.parquet(f"{path}/grams")
    difference(gone.fields, come.fields, ["field"], ["n", "sum_dl"]).write.parquet(f"{path}/fields")


def read_segments(spark: SparkSession, base: str, segments: list[str]) -> Postings:
    """The index of a base folder and its segments, oldest first: postings of
    keys that a later segment changed are left out, counts are sums."""
    if not segments:
        return read_postings(spark, base)
    paths = [base, *segments]

    def table(name: str) -> list[DataFrame]:
        return [spark.read.parquet(f"{p}/{name}") for p in paths]

    keys = [spark.read.parquet(f"{p}/changed").select("key") for p in segments]
    postings = None
    for i, part in enumerate(table("postings")):
        later = keys[i:]
        if later:
            gone = later[0]
            for k in later[1:]:
                gone = gone.unionByName(k)
            part = part.join(merged_if_large(gone.distinct(), gone.count()), "key", "left_anti")
        part = part.select("field", "gram", "key", "tf", "dl")
        postings = part if postings is None else postings.unionByName(part)

    def summed(name: str, by: list[str], sums: list[str]) -> DataFrame:
        first, *rest = table(name)
        for x in rest:
            first = first.unionByName(x)
        return first.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])

    return Postings(postings, summed("grams", ["field", "gram"], ["df"]).filter("df > 0"), summed("fields", ["field"], ["n", "sum_dl"]))


def worth_compacting(spark: SparkSession, base: str, segments: list[str], share: float = 0.2) -> bool:
    """Whether segments hold more than ``share`` of the base's postings (row counts of footers)."""
    rows = [spark.read.parquet(f"{p}/postings").count() for p in (base, *segments)]
    return sum(rows[1:]) > share * rows[0]


def compact(spark: SparkSession, base: str, segments: list[str], path: str) -> Postings:
    """Base and segments as one new base at ``path``."""
    p = read_segments(spark, base, segments)
    return write_postings(Postings(p.postings, p.grams, p.fields, sharded=True), path, grams=p.grams)


def request_grams(requests: DataFrame, id_col: str = "query_id", q_col: str = "q") -> DataFrame:
    """Distinct grams of each request string."""
    return requests.select(
        F.col(id_col).alias("query_id"), F.explode(F.array_distinct(ngrams(q_col))).alias("gram")
    )


def bm25_postings(p: Postings, requests: DataFrame, id_col: str = "query_id", q_col: str = "q",
                  k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, key, score)`` for every (request, matching key) pair.

    Request grams are first joined with the per-gram frequencies (the request
    side stays small), then with the postings.
    """
    qg = request_grams(requests, id_col, q_col)
    qgd = qg.join(p.grams, "gram").join(F.broadcast(p.fields), "field")
    hits = qgd.join(p.postings, ["field", "gram"])
    contrib = _term(
        F.col("tf").cast("double"),
        F.col("dl").cast("double"),
        F.col("sum_dl").cast("double") / F.col("n").cast("double"),
        F.col("df").cast("double"),
        F.col("n").cast("double"),
        k1,
        b,
    )
    return hits.groupBy("query_id", "key").agg(F.sum(contrib).alias("score"))


def bm25_index(p: Postings, q: str | None, k1: float = K1, b: float = B) -> DataFrame:
    """``(key, score)`` for one request from a persisted index.

    The request's grams are literals, so ``gram IN (...)`` reaches the
    Parquet reader and, with postings sorted by (field, gram), only the row
    groups holding those grams are read.  Equal to :func:`bm25_scan`.
    """
    grams = query_grams(q)
    if not grams:
        return p.postings.select("key", F.lit(0.0).alias("score")).filter(F.lit(False))
    hits = p.postings.filter(F.col("gram").isin(grams))
    g = p.grams.filter(F.col("gram").isin(grams))
    # per-field statistics: one row per text field (a fixed, tiny set)
    joined = hits.join(g, ["field", "gram"]).join(F.broadcast(p.fields), "field")
    contrib = _term(
        F.col("tf").cast("double"), F.col("dl").cast("double"),
        F.col("sum_dl").cast("double") / F.col("n").cast("double"),
        F.col("df").cast("double"), F.col("n").cast("double"), k1, b,
    )
    return joined.groupBy("key").agg(F.sum(contrib).alias("score"))
