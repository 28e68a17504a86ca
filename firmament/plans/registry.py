"""Staging and publishing of all datasets, in one manifest.

The manifest is one pointer line: for every dataset the published version, the
staged one, the one published before, and when the staged and published
snapshots were made.  Staging and publishing replace the line by one rename, so
a reader sees all datasets of one commit, and a crash at any step leaves the
last commit as it was.

Publishing can't be called around its checks: it looks itself whether
something is staged that is newer than what was imported, whether the staged
rows keep their constraints, and whether their number is near the published
one.  Datasets that pass are published together with their import times; if
one that is due fails, none is.  Versions that no line names any more go.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.plans import publish as PB

POINTER = "MANIFEST"
REFUSED = ("too few rows", "too many rows")


@dataclass(frozen=True)
class Entry:
    current: str | None = None
    previous: str | None = None
    staged: str | None = None
    staged_at: str | None = None
    imported_at: str | None = None


@dataclass(frozen=True)
class Verdict:
    dataset: str
    verdict: str
    published: bool
    production_count: int | None = None
    staging_count: int | None = None


def manifest(spark: SparkSession, root: str) -> dict[str, Entry]:
    line = PB.get_pointer(spark, root, POINTER)
    return {name: Entry(**x) for name, x in json.loads(line).items()} if line else {}


def _commit(spark: SparkSession, root: str, entries: dict[str, Entry]) -> None:
    PB.set_pointer(spark, root, POINTER, json.dumps({name: asdict(e) for name, e in sorted(entries.items())}))


def broken_keys(df: DataFrame, key: str) -> int:
    """Values of ``key`` that repeat or are NULL."""
    repeats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    return repeats.agg(F.count(F.lit(1))).first()[0]


def stage(df: DataFrame, root: str, dataset: str, key: str, made: dt.datetime, violations: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Writes a load and names it as staged; returns its folder.

    ``violations`` gives the rows of a constraint report (such as
    :func:`firmament.schemas.constraint_violations`).  A load that breaks one,
    or whose key repeats or is NULL, is an error and isn't named."""
    spark = df.sparkSession
    path = PB.write_version(df, f"{root}/{dataset}")
    stored = spark.read.parquet(path)
    broken = broken_keys(stored, key)
    if broken:
        raise ValueError(f"staged {dataset}: {broken} values of {key} are repeated or NULL")
    found = violations(stored).limit(5).collect() if violations else []
    if found:
        raise ValueError(f"staged {dataset} breaks constraints: {[r.asDict() for r in found]}")
    entries = manifest(spark, root)
    entries[dataset] = replace(entries.get(dataset, Entry()), staged=path, staged_at=made.isoformat())
    _commit(spark, root, entries)
    return path


def publish(spark: SparkSession, root: str, keys: dict[str, str], tolerance: float = PB.TOLERANCE, force: bool = False) -> list[Verdict]:
    """A verdict per dataset of ``keys`` (name to key).  ``force`` passes the
    checks of time and number, not those of staging."""
    entries, verdicts, due = manifest(spark, root), [], {}
    for name, key in keys.items():
        e = entries.get(name, Entry())
        if e.staged is None:
            verdicts.append(Verdict(name, "nothing to swap", False))
        elif not force and e.imported_at is not None and dt.datetime.fromisoformat(e.staged_at) <= dt.datetime.fromisoformat(e.imported_at):
            verdicts.append(Verdict(name, "already imported", False))
        else:
            staged = spark.read.parquet(e.staged)
            production = spark.read.parquet(e.current) if e.current else staged.limit(0)
            row = PB.gate(PB.row_counts(production, staged, key), tolerance, force).first()
            due[name] = Verdict(name, row["reason"], row["publish"], row["production_count"], row["staging_count"])
            verdicts.append(due[name])
    if not due or not all(v.published for v in due.values()):
        return [replace(v, published=False) for v in verdicts]
    old = [entries[name].previous for name in due]
    for name in due:
        e = entries[name]
        entries[name] = Entry(current=e.staged, previous=e.current, imported_at=e.staged_at)
    _commit(spark, root, entries)
    for path in filter(None, old):  # readers may still be at the previous version, not at the one before
        fs, folder, _ = PB._fs(spark, path)
        fs.delete(folder, True)
    return verdicts


def read(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The published rows of a dataset."""
    entry = manifest(spark, root).get(dataset, Entry())
    if entry.current is None:
        raise ValueError(f"{dataset} is not published")
    return spark.read.parquet(entry.current)
