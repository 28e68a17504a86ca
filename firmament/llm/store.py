"""Tables written to the shared folder, to cut lineage and to reuse results.

The folder is the session's ``spark.checkpoint.dir``, which the driver and all
executors share; a lost executor's work is read back from there.  A written
Parquet table is used instead of ``checkpoint()`` because it is smaller, keeps
column pruning and gives adaptive execution true sizes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_RUNS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; one is made only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="firmament-llm-"))
    return spark.sparkContext.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
        _RUNS.add(path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """128-bit key of a text (null as empty): equal texts and only they share it."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def small(df: DataFrame, max_rows: int, texts: tuple[str, ...] = (), max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` (already saved) marked for broadcast if it has at most ``max_rows``
    rows and ``max_bytes`` bytes in its columns ``texts`` of open length.

    Without such columns the count reads Parquet footers only.  Beyond a bound
    the mark is left out, and the join shuffles both sides.
    """
    size = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts), F.lit(0))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first() if texts else (df.count(), 0)
    return F.broadcast(df) if n <= max_rows and held <= max_bytes else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, as ``--py-files`` would, unless the
    environment already names its folder on PYTHONPATH."""
    sc = spark.sparkContext
    top = Path(__file__).resolve().parents[2]
    if str(top) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and sc.applicationId not in _SHIPPED:
        package = Path(tempfile.mkdtemp(prefix="firmament-package-")) / "firmament.zip"  # the driver serves it
        with zipfile.ZipFile(package, "w") as out:
            for file in sorted(top.glob("firmament/**/*.py")):
                out.write(file, file.relative_to(top))
        sc.addPyFile(str(package))
        _SHIPPED.add(sc.applicationId)
    return spark
