"""Merging a delta into a stored table: upsert by key, append, counts.

Parquet tables have no ``MERGE``; an upsert is expressed as

    updated  = base LEFT JOIN delta   (adaptive execution broadcasts a small delta)
    inserted = delta LEFT ANTI JOIN base(key)

so the big side is scanned once and never shuffled when the delta is small.
A delta that the caller knows to be large (``rows``) is merged in one full outer
sort-merge join instead: the planner's estimate of a few key columns of a
compressed file is far too low, and would have millions of keys broadcast.
The delta is first reduced to one row per key with ``max_by`` over a total
order, which aggregates partially on the map side (a key holding a third of
the delta does not become one sorted task; Spark plans a sort aggregate, so each
task sorts its own rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.operators.derive import DIGEST, derive, row_digest


# Rows of a delta up to which its joins are left to the planner.
BROADCAST_ROWS = 100_000


def merged_if_large(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` marked for sort-merge joins if it comes from more than ``BROADCAST_ROWS`` rows."""
    return df.hint("merge") if rows is not None and rows > BROADCAST_ROWS else df


def latest_per_key(delta: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order_cols`` (e.g. ts, page, position).

    A NULL in an ordering column sorts lowest, so rows with a timestamp win
    over rows without one.
    """
    rest = [c for c in delta.columns if c != key]
    return (
        delta.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order_cols])).alias("_r"))
        .select(key, "_r.*")
    )


@dataclass
class Upsert:
    result: DataFrame  # the new table
    counts: DataFrame  # one row: inserted, updated


def upsert(
    base: DataFrame,
    delta: DataFrame,
    key: str,
    set_cols: list[str],
    order_cols: list[str],
    null_cols: tuple[str, ...] = (),
    guard_ts: str | None = None,
    generated: dict[str, Column] | None = None,
    rows: int | None = None,
) -> Upsert:
    """``INSERT .. ON CONFLICT (key) DO UPDATE SET set_cols`` on DataFrames.

    * Columns of ``base`` not in ``set_cols``/``null_cols`` keep their old
      value on update and are NULL on insert (a column left out of the SET
      list behaves this way in the reference).
    * ``null_cols`` are overwritten with NULL on update (they are in the SET
      list but the feed never fills them).
    * No ordering guard by default: an incoming row replaces the stored one
      even when older.  ``guard_ts`` names a timestamp column to keep the
      stored row when it is newer; an incoming row without a timestamp never
      replaces a stored row that has one.  Counts are of rows replaced.
    * ``generated`` names columns of ``base`` that are expressions over its
      other columns (:mod:`firmament.operators.derive`): computed anew for rows
      replaced or inserted, kept as stored for the rest.
    * ``rows``: how many the delta has, if the caller knows; with more than
      ``BROADCAST_ROWS`` the delta is shuffled once and never broadcast.
    """
    generated = generated or {}
    if rows is not None and rows > BROADCAST_ROWS:
        return _upsert_large(base, delta, key, set_cols, order_cols, null_cols, guard_ts, generated)
    d = latest_per_key(delta.select(key, *set_cols, *[c for c in order_cols if c not in set_cols]), key, order_cols)
    d = d.select(key, *set_cols)
    renamed = d.select(key, *[F.col(c).alias(f"_new_{c}") for c in set_cols], F.lit(True).alias("_hit"))
    joined = base.join(renamed, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if guard_ts:
        newer = F.coalesce(F.col(f"_new_{guard_ts}") >= F.col(guard_ts), F.lit(False))
        hit = hit & (F.col(guard_ts).isNull() | newer)
    out_cols = []
    for c in base.columns:
        if c in set_cols:
            out_cols.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in null_cols:
            out_cols.append(F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c))
        else:
            out_cols.append(F.col(c))
    updated = joined.select(*out_cols, hit.alias("_hit"))
    for name, value in generated.items():
        updated = updated.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    # Stored keys that the delta touches: the stored table streams past the
    # delta keys, so it is never the build side of a join.
    matched = base.select(key).join(d.select(key), key, "left_semi")
    inserted = d.join(matched, key, "left_anti")
    for f in base.schema.fields:
        if f.name not in inserted.columns:
            inserted = inserted.withColumn(f.name, F.lit(None).cast(f.dataType))
    inserted = derive(inserted, generated)
    result = updated.select(*base.columns).unionByName(inserted.select(*base.columns))
    n_matched = matched.agg(F.count(F.lit(1))).scalar()
    n_updated = joined.filter(hit).agg(F.count(F.lit(1))).scalar() if guard_ts else n_matched
    counts = d.agg((F.count(F.lit(1)) - n_matched).alias("inserted")).select("inserted", n_updated.alias("updated"))
    return Upsert(result, counts)


def _upsert_large(base: DataFrame, delta: DataFrame, key: str, set_cols: list[str], order_cols: list[str], null_cols: tuple[str, ...],
                  guard_ts: str | None, generated: dict[str, Column]) -> Upsert:
    """:func:`upsert` as one full outer join; the counts join the keys alone."""
    types = {f.name: f.dataType for f in base.schema.fields}

    def joined(stored: DataFrame, cols: list[str]) -> tuple[DataFrame, Column]:
        d = latest_per_key(delta.select(key, *dict.fromkeys([*cols, *order_cols])), key, order_cols)
        new = d.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
        both = stored.withColumn("_stored", F.lit(True)).join(new.hint("merge"), key, "full")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
        if guard_ts:
            newer = F.coalesce(F.col(f"_new_{guard_ts}") >= F.col(guard_ts), F.lit(False))
            hit = hit & (F.col("_stored").isNull() | F.col(guard_ts).isNull() | newer)
        return both, hit

    both, hit = joined(base, set_cols)
    out_cols = []
    for c in base.columns:
        if c in set_cols:
            out_cols.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in null_cols:
            out_cols.append(F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(types[c]).alias(c))
        else:
            out_cols.append(F.col(c))
    result = both.select(*out_cols, hit.alias("_hit"))
    for name, value in generated.items():
        result = result.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    guard = [guard_ts] if guard_ts else []
    both, hit = joined(base.select(key, *guard), guard)
    counts = both.agg(F.count_if(F.col("_stored").isNull()).alias("inserted"), F.count_if(F.col("_stored").isNotNull() & hit).alias("updated"))
    return Upsert(result.select(*base.columns), counts)


def new_rows(base: DataFrame, delta: DataFrame, ts_col: str | None = None) -> DataFrame:
    """Distinct delta rows that ``base`` does not hold (NULLs equal).

    Stored copies are found by the row digest: from the stored column
    ``row_digest``, if ``base`` has it, so that the scan reads that column alone
    (and ``ts_col``), else computed.  With ``ts_col``, stored rows older than
    the delta's oldest aren't met: no copy is among them.  The stored table
    streams past the (small) delta and is never shuffled.
    """
    plain = T.StructType([f for f in base.schema.fields if f.name != DIGEST])
    digest = row_digest(plain)
    d = delta.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in plain.fields]).distinct()
    stored = base
    if ts_col:
        oldest = d.agg(F.min(ts_col)).scalar()
        stored = base.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= oldest))
    d = d.withColumn(DIGEST, digest)
    have = stored.select(F.col(DIGEST) if DIGEST in base.columns else digest.alias(DIGEST))
    held = have.join(d.select(DIGEST), DIGEST, "left_semi").distinct()
    return d.join(held, DIGEST, "left_anti").select(*base.columns)


def append(base: DataFrame, delta: DataFrame, dedupe: bool = False, ts_col: str | None = None) -> DataFrame:
    """Plain insert.  Boundary rows of an inclusive range re-sync duplicate;
    with ``dedupe`` only :func:`new_rows` are added.  A stored ``row_digest`` is
    made for the rows added."""
    if dedupe:
        return base.unionByName(new_rows(base, delta, ts_col))
    if DIGEST in base.columns:
        plain = delta.select(*[c for c in base.columns if c != DIGEST])
        delta = plain.withColumn(DIGEST, row_digest(plain.schema))
    return base.unionByName(delta)
