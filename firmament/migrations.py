"""Schema migrations: an older table read in today's layout.

A table's folder records how many migrations its files have seen.  Reading
applies the others as projections, in order, so nothing is rewritten until the
table is; a write records the newest version.  Each migration fails on a table
that doesn't have the columns it speaks of, so a list can't be applied twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.plans.publish import get_pointer, set_pointer

RECORD = "_SCHEMA_VERSION"


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} to migrate")


def _free(df: DataFrame, column: str) -> None:
    if column in df.columns:
        raise ValueError(f"column {column} is there already")


@dataclass(frozen=True)
class Rename:
    old: str
    new: str

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.old)
        _free(df, self.new)
        return df.withColumnRenamed(self.old, self.new)


@dataclass(frozen=True)
class Retype:
    """A column's values by an expression over the row, or by a plain cast."""

    column: str
    type: str
    value: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.column)
        value = F.expr(self.value) if self.value else F.col(self.column)
        return df.withColumn(self.column, value.cast(self.type))


@dataclass(frozen=True)
class Add:
    """A column, filled for stored rows by an expression (NULL without one)."""

    column: str
    type: str
    fill: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        _free(df, self.column)
        return df.withColumn(self.column, (F.expr(self.fill) if self.fill else F.lit(None)).cast(self.type))


@dataclass(frozen=True)
class Drop:
    column: str

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.column)
        return df.drop(self.column)


@dataclass(frozen=True)
class Order:
    """Columns in this order; those not named follow as they were."""

    columns: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, *self.columns)
        return df.select(*self.columns, *[c for c in df.columns if c not in self.columns])


Migration = Rename | Retype | Add | Drop | Order


def migrate(df: DataFrame, migrations: list[Migration], version: int) -> DataFrame:
    """``df``, whose layout is that after the first ``version`` migrations, after all."""
    if not 0 <= version <= len(migrations):
        raise ValueError(f"version {version} is not among {len(migrations)} migrations")
    for step in migrations[version:]:
        df = step.apply(df)
    return df


def write(df: DataFrame, path: str, version: int) -> None:
    """Parquet at ``path`` with the version of its layout."""
    df.write.parquet(path)
    set_pointer(df.sparkSession, path, RECORD, str(version))


def read(spark: SparkSession, path: str, migrations: list[Migration]) -> DataFrame:
    """The table at ``path`` in the layout after all migrations; files without
    a record are as old as can be."""
    return migrate(spark.read.parquet(path), migrations, int(get_pointer(spark, path, RECORD) or 0))
