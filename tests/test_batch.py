"""Batch search against single requests, pruned top-k, bucketed upserts and
index segments."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from firmament import fixtures
from firmament.operators import batch as BT
from firmament.operators import bm25 as BM
from firmament.operators import search as S
from firmament.operators import topk as TK
from firmament.plans import buckets as BU
from firmament.plans import queries as Q
from firmament.plans import tables as T

SF = "/root/testdata/sf0.001"
REQUEST = "request_id int, q string, lat double, lng double, radius double, etat_administratif string, code_postal string, unit_id bigint, code_commune string, activite_principale string, etablissement_siege boolean, sort string, direction string, limit int, offset int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, rows):
    return spark.createDataFrame(rows, "k long, t string, u string")


def test_batch_equals_single_requests(spark):
    targets, index = T.establishments(spark, SF), Q._establishment_index(spark, SF)
    none = dict.fromkeys(S.ESTABLISHMENT_FILTERS)
    asked = [
        dict(q="red widget", limit=7), dict(q="red widget", offset=7, limit=7), dict(q="widget", lat=46.5, lng=3.0, radius=300_000.0, sort="distance", limit=30),
        dict(lat=46.5, lng=3.0, radius=400_000.0, etat_administratif="F", direction="asc"), dict(code_postal="1-URGENT", sort="date_debut", direction="asc", limit=500),
        dict(), dict(direction="asc", offset=20_000), dict(sort="date_debut", limit=0), dict(q="abc"), dict(unit_id=4, etablissement_siege=False), dict(etat_administratif="C"),
    ]
    bad = [dict(lat=1.0), dict(sort="distance"), dict(sort="relevance"), dict(etat_administratif="X"), dict(direction="up"), dict(sort="name")]
    fields = [c.split()[0] for c in REQUEST.split(", ")]
    requests = spark.createDataFrame([tuple({"request_id": i, **none, **a}.get(f) for f in fields) for i, a in enumerate(asked + bad)], REQUEST)
    pages = BT.search_requests(requests, targets, index)
    assert "CartesianProduct" not in plan(pages) and "BroadcastNestedLoopJoin" not in plan(pages)
    got = {}
    for r in pages.collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.siret, r.total, None if r.meter_distance is None else round(r.meter_distance, 3)))
    for i, a in enumerate(asked):
        filters = {f: a[f] for f in S.ESTABLISHMENT_FILTERS if a.get(f) is not None}
        p = S.SearchParams(q=a.get("q"), lat=a.get("lat"), lng=a.get("lng"), radius=a.get("radius"), filters=filters, sort=a.get("sort"), direction=a.get("direction"), limit=a.get("limit"), offset=a.get("offset"))
        want = S.search(targets, p).collect()
        start = S.validate(p, S.ESTABLISHMENT).offset
        want = [(start + 1 + n, r.siret, r.total, None if r.meter_distance is None else round(r.meter_distance, 3)) for n, r in enumerate(want)]
        assert sorted(got.get(i, [])) == want, a
    assert max(got) < len(asked)


def test_page_and_total_scan_once(spark):
    targets, index = T.establishments(spark, SF), Q._establishment_index(spark, SF)
    p = S.SearchParams(q="red widget", limit=9, offset=2)
    page = S.search(targets, p, index=index)
    assert plan(page).count("establishment-") <= plan(S.matches(targets, p, S.ESTABLISHMENT, index=index)).count("establishment-")
    assert [(r.siret, r.total) for r in page.collect()] == [(r.siret, r.total) for r in S.search(targets, p).collect()]


def test_pruned_top_k_equals_all_scores_and_reads_less(spark, tmp_dir):
    rng = random.Random(4)
    common, rare = ["stone", "water", "river", "mountain"], ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(1, 9)) + rng.choices(rare, k=1)), rng.choice(common)) for i in range(4000)]
    p = BM.write_postings(BM.build_postings(words(spark, rows), "k", ["t", "u"]), f"{tmp_dir}/index")
    x = TK.write_blocked(p, f"{tmp_dir}/blocked", blocks=200)
    requests = spark.createDataFrame([("a", f"{rare[7]} river"), ("b", "stone"), ("c", rare[100]), ("d", "zzzz"), ("e", None), ("f", f"water {rare[55]}")], "query_id string, q string")
    scores = {}
    for r in BM.bm25_postings(p, requests).collect():
        scores.setdefault(r.query_id, []).append((-round(r.score, 9), r.key))
    for k in (1, 5, 40):
        got = {}
        for r in TK.top_k(x, requests, k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.key, r.total))
        assert {q: [(n, key, len(s)) for n, (_, key) in enumerate(sorted(s)[:k], 1)] for q, s in scores.items()} == {q: sorted(v) for q, v in got.items()}
    asked = TK._asked(x, requests.filter("query_id IN ('a', 'c', 'f')"), "query_id", "q")  # with a rare word
    blocks = TK.reaching(x, asked, 5)
    read = asked.join(blocks, "query_id").join(x.index.postings, ["field", "gram", "block"]).count()
    every = asked.join(x.index.postings, ["field", "gram"]).count()
    assert read < every / 2


def test_bucketed_upsert_touches_its_buckets_only(spark, tmp_dir):
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("kept"))
    root = f"{tmp_dir}/table"
    BU.create(base, root, "k", buckets=32)
    before = BU.state(spark, root)
    day = dt.datetime(2024, 1, 1)
    delta = spark.createDataFrame([(5, "new", day, 1), (5, "newer", day, 2), (5000, "added", day, 1)], "k long, v string, ts timestamp_ntz, pos int")
    done = BU.upsert(delta, root, ["v", "ts"], ["ts", "pos"], batch=0)
    after = BU.state(spark, root)
    assert (done.inserted, done.updated) == (1, 1) and done.buckets == sum(a != b for a, b in zip(before.paths, after.paths)) <= 2
    same = [p for p in before.paths if p in after.paths]
    assert len(same) >= 30 and all(glob.glob(f"{p.removeprefix('file:')}/*.parquet") for p in same if p)
    got = {r.k: (r.v, r.kept) for r in BU.read(spark, root).collect()}
    assert len(got) == 1001 and got[5] == ("newer", 1) and got[5000] == ("added", None) and got[6] == ("old", 1)

    # delivered again: skipped; a batch after it: applied; an older row under the guard: kept out
    assert BU.upsert(delta, root, ["v", "ts"], ["ts", "pos"], batch=0) is None
    BU.sink(root, ["v", "ts"], ["ts", "pos"], guard_ts="ts")(spark.createDataFrame([(5, "late", dt.datetime(2023, 1, 1), 1), (6, "x", day, 1)], "k long, v string, ts timestamp_ntz, pos int"), 1)
    got = {r.k: r.v for r in BU.read(spark, root).collect()}
    assert got[5] == "newer" and got[6] == "x" and BU.state(spark, root).batch == 1
    assert BU.upsert(delta.limit(0), root, ["v", "ts"], ["ts", "pos"]).buckets == 0


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/table"
    BU.create(spark.range(20).select(F.col("id").alias("k"), F.lit("old").alias("v")), root, "k", buckets=4)

    def crash(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(BU.PB, "set_pointer", crash)
        with pytest.raises(OSError):
            BU.upsert(spark.createDataFrame([(1, "new", 1)], "k long, v string, pos int"), root, ["v"], ["pos"])
    assert {r.v for r in BU.read(spark, root).collect()} == {"old"}


def test_index_segments_equal_a_full_build(spark, tmp_dir):
    rows = {i: (f"word{i % 7} common text", f"tag{i % 3}") for i in range(400)}
    frame = lambda r: words(spark, [(k, *v) for k, v in r.items()])
    BM.write_postings(BM.build_postings(frame(rows), "k", ["t", "u"]), f"{tmp_dir}/base")
    segments = []
    for n, change in enumerate([{3: ("changed words here", None), 900: ("a newcomer text", "tag1"), 7: None}, {3: ("changed again", "tag9"), 900: None, 8: ("word8 common text", "tag2")}]):
        keys = list(change)
        after = {k: v for k, v in {**rows, **change}.items() if v is not None}
        BM.write_segment(frame({k: rows[k] for k in keys if k in rows}), frame({k: after[k] for k in keys if k in after}), "k", ["t", "u"], f"{tmp_dir}/s{n}")
        rows = after
        segments.append(f"{tmp_dir}/s{n}")
        assert spark.read.parquet(f"{segments[-1]}/postings").count() < 120  # in proportion to the delta
        full, got = BM.build_postings(frame(rows), "k", ["t", "u"]), BM.read_segments(spark, f"{tmp_dir}/base", segments)
        for a, b in ((full.postings, got.postings), (full.grams, got.grams), (full.fields, got.fields)):
            assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()))
    assert not BM.worth_compacting(spark, f"{tmp_dir}/base", segments) and BM.worth_compacting(spark, f"{tmp_dir}/base", segments, 0.001)
    packed = BM.compact(spark, f"{tmp_dir}/base", segments, f"{tmp_dir}/packed")
    assert sorted(map(tuple, packed.postings.select("field", "gram", "key", "tf", "dl").collect())) == sorted(map(tuple, full.postings.select("field", "gram", "key", "tf", "dl").collect()))


def test_requests_come_from_every_supplier(spark):
    assert fixtures.table(spark, SF, "request").count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
