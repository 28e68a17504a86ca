"""Full CSV snapshots: archive unpacking, positional load, freshness.

* Columns are bound **by position** to the declared schema; the header line
  is skipped, not matched (``enforceSchema`` keeps the given schema).
* ``FAILFAST``: a record with too few or too many fields, or a value that
  does not cast, aborts the load.
* Null rule of a PostgreSQL ``COPY .. CSV``: an unquoted empty field is NULL,
  a quoted empty field is the empty string.  Spark makes both NULL, so quoted
  empties are read as a sentinel and mapped back to ``''``.
* ``multiLine`` is needed for quoted newlines and stops Spark from splitting
  a file; it is off by default (a broken record then fails the field count).
"""

from __future__ import annotations

import os
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.schemas import conform
from firmament.session import drop_shuffles

# Fixed value: stands for a quoted empty field while Spark parses the CSV.
QUOTED_EMPTY = "\u0001"


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType, quoted_empty: bool = True,
                  multiline: bool = False) -> DataFrame:
    """Read a CSV snapshot into ``schema`` (see the module docstring)."""
    reader = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("multiLine", "true" if multiline else "false")
        .option("nullValue", "")
    )
    if quoted_empty:
        reader = reader.option("emptyValue", QUOTED_EMPTY)
    df = reader.csv(path)
    if not quoted_empty:
        return df
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c == F.lit(QUOTED_EMPTY), F.lit("")).otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def write_snapshot(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Write ``df`` conformed to ``schema`` as a CSV snapshot with a header
    (NULL as an empty field, empty text as ``""``), its files packed with gzip."""
    (conform(df, schema).write.mode("overwrite").option("header", "true").option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path, compression="gzip"))
    drop_shuffles(df.sparkSession)


def with_id(df: DataFrame, col: str = "id") -> DataFrame:
    """Random row id for tables keyed by a generated uuid (not reproducible)."""
    return df.withColumn(col, F.expr("uuid()"))


def _unpack_partition(out_dir: str):
    def run(batches):
        for pdf in batches:
            rows = []
            for src in pdf["path"]:
                local = src[len("file:"):] if src.startswith("file:") else src
                with zipfile.ZipFile(local) as z:
                    members = [m for m in z.infolist() if not m.is_dir()]
                    if len(members) != 1:
                        raise ValueError(f"{src}: archive must hold exactly one file, found {len(members)}")
                    m = members[0]
                    target = os.path.join(out_dir, os.path.basename(local) + "." + os.path.basename(m.filename))
                    with z.open(m) as r, open(target, "wb") as w:
                        while True:
                            chunk = r.read(1 << 20)
                            if not chunk:
                                break
                            w.write(chunk)
                rows.append((src, target, m.file_size))
            yield pd.DataFrame(rows, columns=["path", "csv_path", "bytes"])

    return run


def unpack_archives(spark: SparkSession, paths: list[str] | str, out_dir: str) -> DataFrame:
    """Unpack zip archives in parallel, one task per archive, streaming the
    single member to ``out_dir`` (a directory every executor can reach).

    Only the ``path`` column of ``binaryFile`` is read (its content column
    cannot hold members over 2 GB); Spark has no zip codec, so the work runs
    in ``mapInPandas`` with the standard library.
    """
    os.makedirs(out_dir, exist_ok=True)
    files = spark.read.format("binaryFile").load(paths).select("path")
    files = files.repartition(max(1, files.count()))
    return files.mapInPandas(_unpack_partition(out_dir), "path string, csv_path string, bytes long")


def sources_to_load(manifest: DataFrame, ledger: DataFrame, key: str = "group_type", force: bool = False) -> DataFrame:
    """Sources whose remote ``last_modified`` is newer than both the last
    imported and the staged timestamps; NULL timestamps pass; ``force``
    passes everything."""
    j = manifest.join(ledger, key, "left")
    lm = F.col("last_modified")

    def newer(c: Column) -> Column:
        return c.isNull() | lm.isNull() | (lm > c)

    keep = F.lit(force) | (newer(F.col("last_imported_timestamp")) & newer(F.col("staging_imported_timestamp")))
    return j.filter(keep)
