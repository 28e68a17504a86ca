"""Generated columns of the stored tables, as expressions over loaded columns.

A loaded row has the text and coordinate columns of its schema; search needs
``search_denomination``, and for establishments ``position`` (WGS84 point of
the Lambert-93 text) and its grid cell.  The same expressions run at load time
(:func:`derive`) and, for rows an upsert replaces or inserts, inside
:func:`firmament.operators.merge.upsert`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.functions.geo import cell, lambert93_to_wgs84
from firmament.functions.text import search_text

ESTABLISHMENT_TEXT = ("denomination_usuelle", "enseigne_1", "enseigne_2", "enseigne_3")
UNIT_TEXT = ("denomination", "denomination_usuelle_1", "denomination_usuelle_2", "denomination_usuelle_3")


def unit_columns() -> dict[str, Column]:
    return {"search_denomination": search_text(*UNIT_TEXT)}


def establishment_columns() -> dict[str, Column]:
    """In order: the cells are taken from ``position``."""
    return {
        "search_denomination": search_text(*ESTABLISHMENT_TEXT),
        "position": lambert93_to_wgs84("coordonnee_lambert_x", "coordonnee_lambert_y"),
        "cell_y": cell(F.col("position")["y"]),
        "cell_x": cell(F.col("position")["x"]),
    }


DIGEST = "row_digest"  # generated column of tables that rows are appended to


def row_digest(schema: T.StructType) -> Column:
    """128-bit digest of a row of ``schema`` (all columns but a stored digest).

    Equal rows have equal digests, NULLs equal to each other; each value's text
    comes with its length, so no two rows share a text.  Timestamps count in
    microseconds: the session's time zone plays no part.  Flat columns only.
    """
    parts = []
    for f in schema.fields:
        if f.name == DIGEST:
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise ValueError(f"column {f.name} is nested; a digest takes flat columns")
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # -0.0 and 0.0 are equal
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts).cast("binary"))


def derive(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the generated columns, computed anew if it has them."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


ROWS_PER_FILE = 200_000  # ordered by one task


def clustered(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """Rows range-partitioned and sorted by cell: files cover disjoint cell
    ranges, so box predicates prune row groups.  The key as last range column
    lets boundaries fall inside one cell, so a dense cell (a big city) is split
    over several files.  With about how many ``rows`` there are, files are so
    many that a task's rows don't grow with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_FILE))
    return df.repartitionByRange(n, "cell_y", "cell_x", key).sortWithinPartitions("cell_y", "cell_x")
