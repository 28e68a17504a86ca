"""A stored table in buckets of its key, where an upsert writes what it touches.

The table's Parquet files lie in folders by hash of the key.  One pointer line
names the folder of every bucket, the schema and the last batch applied.  An
upsert reads and rewrites the buckets that hold keys of the delta, into new
folders; all others stay where they are.  The line is replaced by one rename,
so readers see the table before or after, and a crash in between leaves files
that no line names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.operators import merge as M
from firmament.plans import publish as PB

POINTER = "BUCKETS"
COLUMN = "_bucket"


@dataclass(frozen=True)
class State:
    key: str
    schema: T.StructType
    paths: tuple[str | None, ...]  # by bucket; None: no row
    batch: int

    def line(self) -> str:
        return json.dumps({"key": self.key, "schema": self.schema.json(), "paths": self.paths, "batch": self.batch})


@dataclass(frozen=True)
class Applied:
    buckets: int  # rewritten
    inserted: int
    updated: int


def state(spark: SparkSession, root: str) -> State:
    line = PB.get_pointer(spark, root, POINTER)
    if not line:
        raise ValueError(f"no bucketed table under {root}")
    x = json.loads(line)
    return State(x["key"], T.StructType.fromJson(json.loads(x["schema"])), tuple(x["paths"]), x["batch"])


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def _write(df: DataFrame, key: str, n: int, root: str, tasks: int) -> dict[int, str]:
    """Rows in new folders, one per bucket; their paths."""
    spark, path = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    df.withColumn(COLUMN, bucket(key, n)).repartition(tasks, COLUMN).write.partitionBy(COLUMN).parquet(path)
    fs, folder, _ = PB._fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return {int(x.split("=")[1]): f"{path}/{x}" for x in names if x.startswith(f"{COLUMN}=")}


def create(df: DataFrame, root: str, key: str, buckets: int = 64) -> None:
    """A new table from ``df``, which holds each key once."""
    found = _write(df, key, buckets, root, buckets)
    new = State(key, df.schema, tuple(found.get(i) for i in range(buckets)), -1)
    PB.set_pointer(df.sparkSession, root, POINTER, new.line())


def _rows(spark: SparkSession, s: State, buckets: list[int] | None = None) -> DataFrame:
    paths = [p for i, p in enumerate(s.paths) if p and (buckets is None or i in buckets)]
    return spark.read.schema(s.schema).parquet(*paths) if paths else spark.createDataFrame([], s.schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as the pointer names it now."""
    return _rows(spark, state(spark, root))


def upsert(delta: DataFrame, root: str, set_cols: list[str], order_cols: list[str], batch: int | None = None, null_cols: tuple[str, ...] = (),
           guard_ts: str | None = None, generated: dict[str, Column] | None = None) -> Applied | None:
    """Merges a delta (:func:`firmament.operators.merge.upsert`) and commits.

    With ``batch``, one that is not newer than the last applied is skipped
    (None).  Inserted rows are counted from the files' footers, updated ones
    are the delta's other keys, or with ``guard_ts`` those that replace."""
    spark = delta.sparkSession
    s = state(spark, root)
    if batch is not None and batch <= s.batch:
        return None
    n = len(s.paths)
    needed = list(dict.fromkeys([s.key, *set_cols, *order_cols]))
    path = f"{root}/delta/{uuid.uuid4().hex}"
    M.latest_per_key(delta.select(*needed), s.key, order_cols).withColumn(COLUMN, bucket(s.key, n)).write.parquet(path)
    newest = spark.read.parquet(path)
    touched = sorted(r[COLUMN] for r in newest.select(COLUMN).distinct().collect())  # n at most
    paths, inserted, updated = list(s.paths), 0, 0
    if touched:
        base = _rows(spark, s, touched)
        merged = M.upsert(base, newest, s.key, set_cols, order_cols, null_cols, guard_ts, generated)
        found = _write(merged.result.select(*s.schema.names), s.key, n, root, len(touched))
        for i in touched:
            paths[i] = found.get(i)
        after = replace(s, paths=tuple(paths))
        inserted = _rows(spark, after, touched).count() - base.count()
        updated = merged.counts.first()["updated"] if guard_ts else newest.count() - inserted
    PB.set_pointer(spark, root, POINTER, replace(s, paths=tuple(paths), batch=s.batch if batch is None else batch).line())
    return Applied(len(touched), inserted, updated)


def sink(root: str, set_cols: list[str], order_cols: list[str], guard_ts: str | None = None, generated: dict[str, Column] | None = None):
    """A ``foreachBatch`` function: each batch is applied once, whatever is delivered again."""

    def run(rows: DataFrame, batch_id: int) -> None:
        upsert(rows, root, set_cols, order_cols, batch_id, guard_ts=guard_ts, generated=generated)

    return run
