"""Publishing all datasets in one manifest, and schema migrations."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from firmament import migrations as MG
from firmament import schemas as SC
from firmament.plans import registry as RG

DAY = dt.datetime(2024, 5, 1)
KEYS = {"a": "k", "b": "k"}


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v"))


def test_datasets_are_published_together_or_not_at_all(spark, tmp_dir):
    for name in KEYS:
        RG.stage(rows(spark, 100), tmp_dir, name, "k", DAY)
    assert [v.published for v in RG.publish(spark, tmp_dir, KEYS)] == [True, True]
    assert RG.manifest(spark, tmp_dir)["a"].imported_at == DAY.isoformat() and RG.manifest(spark, tmp_dir)["a"].staged is None
    RG.stage(rows(spark, 101), tmp_dir, "a", "k", DAY + dt.timedelta(days=1))
    RG.stage(rows(spark, 50), tmp_dir, "b", "k", DAY + dt.timedelta(days=1))
    got = RG.publish(spark, tmp_dir, KEYS)
    assert [(v.verdict, v.published) for v in got] == [("within tolerance", False), ("too few rows", False)]
    assert RG.read(spark, tmp_dir, "a").count() == 100 and RG.manifest(spark, tmp_dir)["a"].imported_at == DAY.isoformat()
    assert all(v.published for v in RG.publish(spark, tmp_dir, KEYS, force=True)) and RG.read(spark, tmp_dir, "b").count() == 50
    RG.stage(rows(spark, 101), tmp_dir, "a", "k", DAY)
    assert [v.verdict for v in RG.publish(spark, tmp_dir, KEYS)] == ["already imported", "nothing to swap"]


def test_broken_loads_are_not_staged(spark, tmp_dir):
    RG.stage(rows(spark, 10), tmp_dir, "a", "k", DAY)
    before = RG.manifest(spark, tmp_dir)
    with pytest.raises(ValueError, match="repeated or NULL"):
        RG.stage(rows(spark, 10).union(rows(spark, 1)), tmp_dir, "a", "k", DAY)
    unit = spark.createDataFrame([("1", None)], "unit_id string, etat_administratif string")
    with pytest.raises(ValueError, match="constraints"):
        RG.stage(SC.conform(unit, SC.UNIT_SCHEMA), tmp_dir, "a", "unit_id", DAY, lambda df: SC.constraint_violations(df, SC.UNIT_SCHEMA, SC.UNIT_LENGTHS, "unit_id"))
    assert RG.manifest(spark, tmp_dir) == before
    with pytest.raises(ValueError, match="not published"):
        RG.read(spark, tmp_dir, "b")


@pytest.mark.parametrize("step", ["write_version", "gate", "set_pointer"])
def test_a_crash_at_any_step_keeps_the_last_commit(spark, tmp_dir, monkeypatch, step):
    RG.stage(rows(spark, 10), tmp_dir, "a", "k", DAY)
    RG.publish(spark, tmp_dir, KEYS)
    if step != "write_version":
        RG.stage(rows(spark, 10), tmp_dir, "a", "k", DAY + dt.timedelta(days=1))
    before = RG.manifest(spark, tmp_dir)

    def crash(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(RG.PB, step, crash)
        with pytest.raises(OSError):
            RG.stage(rows(spark, 10), tmp_dir, "a", "k", DAY) if step == "write_version" else RG.publish(spark, tmp_dir, KEYS)
    assert RG.manifest(spark, tmp_dir) == before and RG.read(spark, tmp_dir, "a").count() == 10


def test_superseded_versions_go(spark, tmp_dir):
    paths = []
    for i in range(3):
        paths.append(RG.stage(rows(spark, 10), tmp_dir, "a", "k", DAY + dt.timedelta(days=i)))
        RG.publish(spark, tmp_dir, KEYS)
    assert [os.path.exists(p) for p in paths] == [False, True, True]


def test_migrations_apply_from_the_recorded_version(spark, tmp_dir):
    steps = [MG.Rename("a", "b"), MG.Retype("n", "int"), MG.Add("c", "string", "upper(b)"), MG.Drop("x"), MG.Order(["c", "b"])]
    old = spark.createDataFrame([("v", "7", 1)], "a string, n string, x int")
    MG.write(old, f"{tmp_dir}/v0", 0)
    got = MG.read(spark, f"{tmp_dir}/v0", steps)
    assert got.columns == ["c", "b", "n"] and got.dtypes[2] == ("n", "int") and tuple(got.first()) == ("V", "v", 7)
    MG.write(MG.migrate(old, steps[:2], 0), f"{tmp_dir}/v2", 2)
    assert tuple(MG.read(spark, f"{tmp_dir}/v2", steps).first()) == ("V", "v", 7)
    MG.write(got, f"{tmp_dir}/v5", 5)
    assert tuple(MG.read(spark, f"{tmp_dir}/v5", steps).first()) == ("V", "v", 7)
    old.write.parquet(f"{tmp_dir}/unrecorded")
    assert tuple(MG.read(spark, f"{tmp_dir}/unrecorded", steps).first()) == ("V", "v", 7)
    with pytest.raises(ValueError):
        MG.migrate(old, steps, 9)
    with pytest.raises(ValueError):
        MG.migrate(got, steps, 0)  # migrated already
