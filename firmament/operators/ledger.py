"""Run ledger operators: latest record, stuck runs, high-water marks,
summary roll-up and flattening, keyed and conditional updates.

All time arithmetic takes ``as_of`` as a parameter; nothing reads the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-back window, stuck-run threshold, feed timestamp format,
# group types and the expansion of the synthetic group "all".
LOOKBACK_DAYS = 31
STUCK_HOURS = 1
FEED_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
GROUP_TYPES = ("unites_legales", "etablissements", "liens_succession")
SYNTHETIC_ALL = "all"
STEPS = ("UpdateData", "SwapData", "SyncFeed")
STATUSES = ("launched", "finished", "error")


def ntz(ts: dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal from ISO text, independent of the session and
    Python time zones (a Python ``datetime`` literal becomes a zoned TIMESTAMP)."""
    text = ts.isoformat(sep=" ") if isinstance(ts, dt.datetime) else str(ts)
    return F.lit(text).cast("timestamp_ntz")


def high_water_mark(df: DataFrame, ts_col: str, alias: str = "high_water_mark") -> DataFrame:
    """Greatest non-null timestamp; one row, NULL on an empty table."""
    return df.agg(F.max(F.col(ts_col)).alias(alias))


def sync_start(hwm: Column, as_of: dt.datetime, days: int = LOOKBACK_DAYS) -> Column:
    """``max(hwm, as_of - days)``, NULL when there is no high-water mark."""
    floor = ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.when(hwm.isNull(), F.lit(None)).otherwise(F.greatest(hwm, floor))


def feed_timestamp(ts: Column) -> Column:
    """Feed query format; fractions of a second are dropped."""
    return F.date_format(ts, FEED_TS_FORMAT)


def incremental(df: DataFrame, start, ts_col: str) -> DataFrame:
    """Rows changed at or after ``start`` (inclusive)."""
    s = start if isinstance(start, Column) else F.lit(start)
    return df.filter(F.col(ts_col) >= s)


def latest(df: DataFrame, key: str, order_cols: list[str], where: Column | None = None) -> DataFrame:
    """Newest row per key by ``order_cols`` (``max_by``, partial aggregation)."""
    src = df if where is None else df.filter(where)
    rest = [c for c in df.columns if c != key]
    return src.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_r")).select(key, "_r.*")


def stale(df: DataFrame, key: str, ts_col: str, as_of: dt.datetime, hours: int = STUCK_HOURS) -> DataFrame:
    """Keys whose newest timestamp is strictly older than ``as_of - hours``."""
    limit = ntz(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.groupBy(key).agg(F.max(ts_col).alias("last_ts")).filter(F.col("last_ts") < limit)


def expand_groups(df: DataFrame, col: str = "group_type") -> DataFrame:
    """Replace the synthetic group ``all`` by the three groups, in order."""
    all_groups = F.array(*[F.lit(g) for g in GROUP_TYPES])
    return df.withColumn(
        col, F.explode(F.when(F.col(col) == F.lit(SYNTHETIC_ALL), all_groups).otherwise(F.array(F.col(col))))
    )


def flatten_runs(runs: DataFrame, id_col: str = "run_id", summary: str = "summary") -> DataFrame:
    """One row per (run, step, group) with positions in the summary arrays."""
    steps = runs.select(id_col, F.posexplode(F.col(summary)["steps"]).alias("step_pos", "step"))
    groups = steps.select(
        id_col, "step_pos", F.col("step")["step"].alias("step"), F.col("step")["updated"].alias("step_updated"),
        F.posexplode(F.col("step")["groups"]).alias("group_pos", "g"),
    )
    return groups.select(id_col, "step_pos", "step", "step_updated", "group_pos", "g.*")


def rollup_runs(runs: DataFrame, id_col: str = "run_id", summary: str = "summary") -> DataFrame:
    """step.updated = any(group.updated); run.updated = any(step.updated)."""
    steps = F.transform(
        F.col(summary)["steps"],
        lambda s: F.struct(
            s["step"].alias("step"),
            F.exists(s["groups"], lambda g: F.coalesce(g["updated"], F.lit(False))).alias("updated"),
        ),
    )
    rolled = runs.select(id_col, steps.alias("steps"))
    return rolled.select(
        id_col,
        F.exists("steps", lambda s: s["updated"]).alias("run_updated"),
        F.posexplode("steps").alias("step_pos", "s"),
    ).select(id_col, "run_updated", "step_pos", F.col("s.step").alias("step"), F.col("s.updated").alias("step_updated"))


def keyed_update(df: DataFrame, key: str, key_value, values: dict) -> DataFrame:
    """Set ``values`` on the row(s) whose key equals ``key_value``; adds
    ``changed`` (the row matched and at least one value differs)."""
    hit = F.col(key) == F.lit(key_value)
    diff = None
    for c, v in values.items():
        d = ~F.col(c).eqNullSafe(_value(v).cast(df.schema[c].dataType))
        diff = d if diff is None else (diff | d)
    out = df.withColumn("changed", F.coalesce(hit & diff, F.lit(False)))
    for c, v in values.items():
        out = out.withColumn(c, F.when(hit, _value(v).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out


def _value(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, dt.datetime):
        return ntz(v)
    return F.lit(v)


def conditional_update(df: DataFrame, predicate: Column, values: dict) -> DataFrame:
    """Set ``values`` on every row where ``predicate`` holds; others untouched."""
    out = df
    for c, v in values.items():
        val = _value(v)
        out = out.withColumn(c, F.when(F.coalesce(predicate, F.lit(False)), val.cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows where ``predicate`` is true; NULL keeps the row (SQL DELETE)."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
