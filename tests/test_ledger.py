import datetime as dt

from pyspark.sql import functions as F

from firmament.operators import ledger as L

T = dt.datetime


def test_high_water_mark_empty_is_null(spark):
    df = spark.createDataFrame([], "k long, ts timestamp_ntz")
    assert L.high_water_mark(df, "ts").first().high_water_mark is None
    df = spark.createDataFrame([(1, None), (2, T(2024, 1, 2))], "k long, ts timestamp_ntz")
    assert L.high_water_mark(df, "ts").first().high_water_mark == T(2024, 1, 2)


def test_sync_start_clamp_and_format(spark):
    df = spark.createDataFrame([(T(2024, 3, 1, 10, 0, 0, 999000),), (T(2023, 1, 1),), (None,)], "h timestamp_ntz")
    out = df.select(L.feed_timestamp(L.sync_start(F.col("h"), T(2024, 3, 10))).alias("s")).collect()
    assert [r.s for r in out] == ["2024-03-01T10:00:00", "2024-02-08T00:00:00", None]


def test_stale_is_strict_one_hour(spark):
    as_of = T(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, T(2024, 1, 1, 11)), (2, T(2024, 1, 1, 10, 59, 59)), (3, T(2024, 1, 1, 9)),
                                (3, T(2024, 1, 1, 11, 30))], "k long, ts timestamp_ntz")
    assert {r.k for r in L.stale(df, "k", "ts", as_of).collect()} == {2}


def test_latest_and_where(spark):
    df = spark.createDataFrame([(1, T(2024, 1, 1), "finished", 10), (1, T(2024, 1, 2), "error", 11),
                                (2, T(2024, 1, 1), "launched", 12)], "k long, ts timestamp_ntz, status string, id long")
    assert {r.k: r.id for r in L.latest(df, "k", ["ts", "id"]).collect()} == {1: 11, 2: 12}
    done = L.latest(df, "k", ["ts", "id"], where=F.col("status") == "finished")
    assert {r.k: r.id for r in done.collect()} == {1: 10}


def test_expand_groups_order(spark):
    df = spark.createDataFrame([(1, "all"), (2, "etablissements")], "id long, group_type string")
    got = [(r.id, r.group_type) for r in L.expand_groups(df).collect()]
    assert got == [(1, "unites_legales"), (1, "etablissements"), (1, "liens_succession"), (2, "etablissements")]


def test_updates_and_delete(spark):
    df = spark.createDataFrame([("a", T(2024, 1, 1), "launched"), ("b", None, "finished"), ("c", None, None)],
                               "g string, ts timestamp_ntz, status string")
    k = {r.g: (r.ts, r.changed) for r in L.keyed_update(df, "g", "a", {"ts": T(2024, 1, 1)}).collect()}
    assert k["a"] == (T(2024, 1, 1), False)
    k = {r.g: (r.ts, r.changed) for r in L.keyed_update(df, "g", "b", {"ts": T(2024, 2, 1)}).collect()}
    assert k["b"] == (T(2024, 2, 1), True) and k["a"][1] is False
    c = {r.g: r.status for r in L.conditional_update(df, F.col("status") == "launched", {"status": "finished"}).collect()}
    assert c == {"a": "finished", "b": "finished", "c": None}
    assert {r.g for r in L.delete_where(df, F.col("status") == "finished").collect()} == {"a", "c"}


def test_rollup_and_flatten(spark):
    summary = ("struct<updated:boolean, steps:array<struct<step:string, updated:boolean, "
               "groups:array<struct<group_type:string, updated:boolean>>>>>")
    df = spark.createDataFrame(
        [(1, (None, [("UpdateData", None, [("b", False), ("a", True)]), ("SwapData", None, [("a", None)])])),
         (2, (None, [("UpdateData", None, [("a", False)])]))], f"run_id long, summary {summary}")
    r = {(x.run_id, x.step): (x.step_updated, x.run_updated) for x in L.rollup_runs(df).collect()}
    assert r == {(1, "UpdateData"): (True, True), (1, "SwapData"): (False, True), (2, "UpdateData"): (False, False)}
    flat = [(x.run_id, x.step_pos, x.group_pos, x.group_type) for x in L.flatten_runs(df).collect()]
    assert flat == [(1, 0, 0, "b"), (1, 0, 1, "a"), (1, 1, 0, "a"), (2, 0, 0, "a")]
