import datetime as dt

import pytest
from pyspark.sql import functions as F

from firmament.operators import derive as DV
from firmament.operators import merge as M

T = dt.datetime


def frames(spark):
    base = spark.createDataFrame(
        [(1, "a", "x1", "n1", T(2024, 1, 1)), (2, "b", "x2", "n2", T(2024, 1, 1)), (3, "c", "x3", "n3", None)],
        "k long, v string, keep string, naf25 string, ts timestamp_ntz")
    delta = spark.createDataFrame(
        [(1, "a1", T(2024, 1, 5), 1, 1), (1, "a2", T(2024, 1, 6), 1, 2),   # newest wins
         (2, "b-old", T(2023, 1, 1), 2, 1),                                  # older than stored: still replaces
         (3, "c1", T(2024, 1, 7), 1, 5), (3, "c2", T(2024, 1, 7), 2, 1),    # equal ts: later page wins
         (9, "new", T(2024, 1, 8), 3, 1)],                                   # not stored: inserted
        "k long, v string, ts timestamp_ntz, page int, pos int")
    return base, delta


def as_dict(df):
    return {r.k: r.asDict() for r in df.collect()}


def test_upsert_semantics(spark):
    base, delta = frames(spark)
    up = M.upsert(base, delta, "k", ["v", "ts"], ["ts", "page", "pos"])
    got = as_dict(up.result)
    assert got[1]["v"] == "a2" and got[1]["keep"] == "x1" and got[1]["naf25"] == "n1"
    assert got[2]["v"] == "b-old"
    assert got[3]["v"] == "c2"
    assert got[9]["v"] == "new" and got[9]["keep"] is None and got[9]["naf25"] is None
    c = up.counts.first()
    assert (c.inserted, c.updated) == (1, 3)


def test_upsert_guard_keeps_newer_stored(spark):
    base, delta = frames(spark)
    got = as_dict(M.upsert(base, delta, "k", ["v", "ts"], ["ts", "page", "pos"], guard_ts="ts").result)
    assert got[2]["v"] == "b"


def test_upsert_twice_equals_once(spark):
    base, delta = frames(spark)
    once = M.upsert(base, delta, "k", ["v", "ts"], ["ts", "page", "pos"]).result
    twice = M.upsert(once, delta, "k", ["v", "ts"], ["ts", "page", "pos"]).result
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_null_cols_overwritten_on_update(spark):
    base, delta = frames(spark)
    got = as_dict(M.upsert(base, delta, "k", ["v"], ["ts", "page", "pos"], null_cols=("keep",)).result)
    assert got[1]["keep"] is None and got[9]["keep"] is None


def test_append_and_dedupe(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "p long, s string")
    delta = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "p long, s string")
    assert M.append(base, delta).count() == 5
    assert sorted(map(tuple, M.append(base, delta, dedupe=True).collect()), key=str) == sorted(
        [(1, "a"), (2, None), (3, "c")], key=str)


def test_append_by_stored_digest(spark, tmp_path):
    schema = "p string, s string, d timestamp_ntz, n double"
    rows = [("1:a", None, T(2024, 1, 1), 0.0), ("1", ":a", None, None), (None, "x", T(2024, 2, 1), 1.5), ("ab", "c", T(2024, 2, 1), 2.0)]
    plain = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "links")
    plain.withColumn(DV.DIGEST, DV.row_digest(plain.schema)).write.parquet(path)
    base = spark.read.parquet(path)
    fresh = [("a", "bc", T(2024, 2, 1), 2.0), ("x", None, T(2024, 2, 1), 1.5), ("1:a", None, None, 0.0)]
    delta = spark.createDataFrame([*rows[1:], ("1:a", None, T(2024, 1, 1), -0.0), *fresh, *fresh], schema)
    for ts in (None, "d"):
        out = M.append(base, delta, dedupe=True, ts_col=ts)
        assert sorted(map(str, out.drop(DV.DIGEST).collect())) == sorted(map(str, spark.createDataFrame(rows + fresh, schema).collect()))
        assert M.new_rows(out, delta, ts).count() == 0  # applied again: nothing is new
        assert out.filter(F.col(DV.DIGEST).isNull()).count() == 0
    assert M.append(base, delta).count() == len(rows) + delta.count()
    assert M.new_rows(base, delta.limit(0), "d").count() == 0 and M.new_rows(base.limit(0), delta, "d").count() == 7
    plan = M.new_rows(base, delta)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_digest:string>" in plan
    with pytest.raises(ValueError, match="nested"):
        DV.row_digest(spark.createDataFrame([([1],)], "a array<int>").schema)


def test_guarded_upsert_counts_what_it_replaces(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], "k int, v string, ts int")
    delta = spark.createDataFrame([(1, "old", 4), (2, "none", None), (3, "new", 1), (4, "in", None)], "k int, v string, ts int")
    up = M.upsert(base, delta, "k", ["v", "ts"], ["ts"], guard_ts="ts")
    assert sorted((r.k, r.v) for r in up.result.collect()) == [(1, "a"), (2, "b"), (3, "new"), (4, "in")]
    assert up.counts.first().asDict() == {"inserted": 1, "updated": 1}


def test_a_large_delta_is_merged_without_a_broadcast(spark, monkeypatch):
    """The same rows and counts as a small delta's, from joins that hold no side's keys on the driver."""
    base, delta = frames(spark)
    base = base.unionByName(base.limit(1).withColumns({"k": F.lit(None).cast("long"), "v": F.lit("stored")}))
    new = [(None, "null key", T(2024, 1, 8), 1, 1), (7, "undated", None, 1, 1), (8, None, T(2024, 1, 8), 1, 1)]
    delta = delta.unionByName(spark.createDataFrame(new, delta.schema))
    generated = {"g": F.concat(F.lit("of "), F.coalesce("v", F.lit("-")))}
    base = base.withColumn("g", F.lit("as stored"))
    for options in ({}, {"guard_ts": "ts"}, {"null_cols": ("keep",)}):
        args = ("k", ["v", "ts"], ["ts", "page", "pos"])
        small = M.upsert(base, delta, *args, generated=generated, rows=9, **options)
        with monkeypatch.context() as m:
            m.setattr(M, "BROADCAST_ROWS", 8)
            large = M.upsert(base, delta, *args, generated=generated, rows=9, **options)
        assert large.result.schema.names == small.result.schema.names
        order = lambda df: sorted(map(str, df.collect()))
        assert order(large.result) == order(small.result)
        assert large.counts.first().asDict() == small.counts.first().asDict()
        for df in (large.result, large.counts):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" in small.result._jdf.queryExecution().executedPlan().toString()
