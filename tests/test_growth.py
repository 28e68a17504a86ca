"""What a plan or a task holds doesn't grow with requests, texts or rows."""

import glob

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from firmament.functions import geo
from firmament.operators import batch as BT
from firmament.operators import bm25 as BM
from firmament.operators import derive as DV
from firmament.operators import lookup as LK
from firmament.operators import search as S
from firmament.operators import topk as TK
from firmament.operators.merge import Upsert
from firmament.plans import queries as Q
from firmament.plans import tables as T
from firmament.sources import snapshot as SN
from firmament.streaming import sync as SY

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_is_not_copied_into_what_uses_it(spark):
    points = spark.range(9).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    far = geo.with_geodesic(points, F.col("a"), F.col("b"), F.lit(3.0), F.lit(46.5), "d")
    used = far.filter("d <= 1e7").union(far.filter("d > 1e7")).select(F.when(F.col("d") > 2e6, -F.col("d")).otherwise(F.col("d")).alias("o")).orderBy("o")
    assert optimized(used).count("aggregate(") == 2 * optimized(far).count("aggregate(")
    assert used.count() == 9


def test_batch_search_plans_requests_once_and_scores_a_text_once(spark, monkeypatch):
    texts = []

    def spied(index, requests, *names):
        texts.extend(r[0] for r in requests.select("_q").collect())
        return BM.bm25_postings(index, requests, *names)

    monkeypatch.setattr(BT, "bm25_postings", spied)
    fields = ("q string, lat double, lng double, radius double, etat_administratif string, code_postal string, unit_id bigint, code_commune string, "
              "activite_principale string, etablissement_siege boolean, sort string, direction string, `limit` int, `offset` int")
    nulls = [f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in fields.split(", ")[1:] if not f.startswith("etat")]
    requests = spark.range(6).selectExpr("CAST(id AS INT) AS request_id", "concat('red ', 'widget', substr('marker', 9, CAST(id AS INT))) AS q",
                                         "CASE WHEN id % 2 = 0 THEN 'F' END AS etat_administratif", *nulls)
    pages = BT.search_requests(requests, T.establishments(spark, SF), Q._establishment_index(spark, SF))
    assert texts == ["red widget"]
    assert "marker" not in optimized(pages)
    assert {r.request_id for r in pages.select("request_id").distinct().collect()} == set(range(6))


def test_postings_are_made_in_shards_without_a_shuffle(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(BM, "GRAMS_PER_SHARD", 100)
    rows = [(i % 70, "red widget" if i % 3 else "widget widget") for i in range(80)] + [(None, "old gear"), (None, "old gear"), (5, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    p = BM.build_postings(df, "k", ["t"])
    assert p.postings.rdd.getNumPartitions() >= 10
    assert "hashpartitioning(gram" not in executed(p.postings)
    stored = BM.write_postings(p, f"{tmp_dir}/index")
    want = {}
    for k, t in rows:
        for g in BM.query_grams(t):
            n = sum((t or "").startswith(g, i) for i in range(len(t or "")))
            at = (g, k, 2 * len(t) - 7)
            want[at] = want.get(at, 0) + n
    assert {(r.gram, r.key, r.dl): r.tf for r in stored.postings.collect()} == want
    assert {r.gram: r.df for r in stored.grams.collect()} == {g: sum(x[0] == g for x in want) for g, _, _ in want}
    assert TK.write_blocked(stored, f"{tmp_dir}/blocked", blocks=4).index.postings.count() == len(want)
    assert BM.range_parts(stored) >= 10


def test_lists_and_clusters_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(LK, "ROWS_PER_TASK", 10)
    est = spark.range(300).select(F.col("id").alias("siret"), (F.col("id") % 7).alias("unit_id"), (F.col("id") < 7).alias("etablissement_siege"))
    units = spark.range(7).select(F.col("id").alias("unit_id"))
    assert LK.list_tasks(est) == 30
    nested = LK.lookup_units_nested(units, units, est)
    assert "hashpartitioning(unit_id" in executed(nested) and ", 30), REPARTITION_BY_NUM" in executed(nested)
    assert nested.select(F.explode("etablissements.siret")).count() == 300
    monkeypatch.setattr(DV, "ROWS_PER_FILE", 10)
    cells = spark.range(300).selectExpr("id AS siret", "CAST(id % 50 AS INT) AS cell_y", "CAST(id AS INT) AS cell_x")
    assert DV.clustered(cells, "siret", 300).rdd.getNumPartitions() > 20


def test_a_streamed_batch_is_stored_before_it_is_merged(spark, tmp_dir):
    files = []

    def merge(base, batch):
        files.extend(batch.inputFiles())
        counts = batch.agg(F.count(F.lit(1)).alias("inserted")).withColumn("updated", F.lit(0).cast("long"))
        return Upsert(base.unionByName(batch), counts)

    rows = spark.createDataFrame([(1, "2024-01-02")], "k long, d string").select("k", F.to_timestamp_ntz("d").alias("ts"))
    SY.init_table(spark, rows, tmp_dir)
    SY.sink(tmp_dir, "ts", merge)(rows.withColumn("k", F.col("k") + 1), 0)
    assert files and all("/delta-" in f for f in files)
    assert sorted(r.k for r in SY.read_table(spark, tmp_dir).collect()) == [1, 2]
    assert [(r.rows, r.inserted) for r in SY.progress(spark, tmp_dir).collect()] == [(1, 1)]


def test_an_index_is_refreshed_without_dealing_it_out_again(spark, tmp_dir, monkeypatch):
    before = spark.createDataFrame([(i, "red widget") for i in range(30)], "k long, t string")
    after = spark.createDataFrame([(i, "old gear") for i in range(3)], "k long, t string")
    index = BM.write_postings(BM.build_postings(before, "k", ["t"]), f"{tmp_dir}/base")
    BM.write_segment(before.filter("k < 3"), after, "k", ["t"], f"{tmp_dir}/segment")

    def dealt_out(*_):
        raise AssertionError("all postings are shuffled")

    monkeypatch.setattr(type(before), "repartitionByRange", dealt_out)
    refreshed = BM.refresh_postings(index, before.filter("k < 3"), after, "k", ["t"], f"{tmp_dir}/refreshed")
    compacted = BM.compact(spark, f"{tmp_dir}/base", [f"{tmp_dir}/segment"], f"{tmp_dir}/compacted")
    want = {(r.gram, r.key, r.tf) for r in BM.build_postings(before.filter("k > 2").union(after), "k", ["t"]).postings.collect()}
    for got in (refreshed, compacted):
        assert {(r.gram, r.key, r.tf) for r in got.postings.collect()} == want
        assert {r.gram: r.df for r in got.grams.collect()} == {g: sum(x[0] == g for x in want) for g, _, _ in want}


def test_snapshots_are_written_packed(spark, tmp_dir):
    schema = T_.StructType().add("k", "integer").add("t", "string")
    rows = [(1, "say \"x\""), (2, ""), (3, None)]
    SN.write_snapshot(spark.createDataFrame(rows, schema), f"{tmp_dir}/csv", schema)
    files = glob.glob(f"{tmp_dir}/csv/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert sorted(map(tuple, SN.load_snapshot(spark, f"{tmp_dir}/csv", schema).collect())) == rows
