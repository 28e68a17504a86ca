"""Registry tables as the engine stores them, derived from the fixture views.

``establishments`` and ``units`` add the generated columns of
:mod:`firmament.operators.derive` (search text, projected point) to views over
the driver's tables, so every query's work grows with them.  A loaded snapshot
gets the same columns from :mod:`firmament.plans.searchable`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament import fixtures
from firmament.functions.geo import lambert93_to_wgs84
from firmament.operators import derive as DV
from firmament.operators.derive import ESTABLISHMENT_TEXT, UNIT_TEXT  # noqa: F401
from firmament.session import scratch_path

ESTABLISHMENT_TEXT = ("denomination_usuelle", "enseigne_1", "enseigne_2", "enseigne_3")
UNIT_TEXT = ("denomination", "denomination_usuelle_1", "denomination_usuelle_2", "denomination_usuelle_3")


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``geo_point`` with its projected WGS84 ``position``."""
    g = fixtures.table(spark, sf_dir, "geo_point")
    return g.withColumn("position", lambert93_to_wgs84("coordonnee_lambert_x", "coordonnee_lambert_y"))


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per session and scale factor under the shared
    checkpoint folder, then read it back (generated columns are stored, as the
    registry stores them at load time)."""
    k = (spark.sparkContext.applicationId, sf_dir, name)
    path = _stored.get(k)
    if path is None:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _stored[k] = path
    return spark.read.parquet(path)


def derive_establishments(e: DataFrame, points: DataFrame, rows: int = 0) -> DataFrame:
    """An establishment table with its generated columns, clustered by cell;
    coordinates come from the point table by ``vec_id``."""
    pts = points.select("vec_id", "coordonnee_lambert_x", "coordonnee_lambert_y")
    out = DV.derive(e.join(pts, "vec_id", "left"), DV.establishment_columns())
    return DV.clustered(out.drop("coordonnee_lambert_x", "coordonnee_lambert_y"), "siret", rows)


def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Establishments with ``search_denomination``, ``position`` and cell."""

    def build() -> DataFrame:
        e = fixtures.table(spark, sf_dir, "establishment")
        rows = fixtures.table(spark, sf_dir, "orders").count()  # of footers; an establishment each
        return derive_establishments(e, fixtures.table(spark, sf_dir, "geo_point"), rows)

    return stored(spark, sf_dir, "establishment", build)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal units with ``search_denomination``."""
    u = fixtures.table(spark, sf_dir, "legal_unit")
    return DV.derive(u, DV.unit_columns())


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "succession")


def short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "short_text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures.register(spark, sf_dir)
    return spark.table("documents")


def flat_position(df: DataFrame, col: str = "position", digits: int = 6) -> DataFrame:
    """Replace a point struct by rounded ``lng`` / ``lat`` columns (for parity checks)."""
    return df.withColumn("lng", F.round(F.col(col)["x"], digits)).withColumn(
        "lat", F.round(F.col(col)["y"], digits)
    ).drop(col)
