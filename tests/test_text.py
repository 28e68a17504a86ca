import math

import pytest
from pyspark.sql import functions as F

from firmament.functions import text as TX
from firmament.operators import bm25 as BM


def test_grams_edge_lengths(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcd",), ("abcde",), (None,), ("ABCD",)], "t string")
    got = [r.g for r in df.select(TX.ngrams("t").alias("g")).collect()]
    assert got == [[], [], ["abcd"], ["abcd", "bcde", "abcde"], [], ["abcd"]]
    long = [r.g for r in df.select(TX.ngrams_long("t").alias("g")).collect()]
    assert long == got
    dl = [r.d for r in df.select(TX.gram_length("t").alias("d")).collect()]
    assert dl == [0, 0, 1, 3, 0, 1]


def test_search_text_keeps_separators(spark):
    df = spark.createDataFrame([(None, None, None), ("a", None, "c"), ("", "", "")], "a string, b string, c string")
    got = [r.s for r in df.select(TX.search_text("a", "b", "c").alias("s")).collect()]
    assert got == ["  ", "a  c", "  "]


def test_query_grams_distinct_and_short():
    assert TX.query_grams("abc") == []
    assert TX.query_grams(None) == []
    assert TX.query_grams("aaaaa") == ["aaaa", "aaaaa"]


def test_overlapping_count(spark):
    df = spark.createDataFrame([("aaaaaa",), ("xaaaax",), ("b.c*d?e",)], "t string")
    got = [r.c for r in df.select(TX.gram_count("t", "aaaa").alias("c")).collect()]
    assert got == [3, 1, 0]
    got = [r.c for r in df.select(TX.gram_count("t", ".c*d").alias("c")).collect()]
    assert got == [0, 0, 1]


def python_bm25(docs, q, k1=1.2, b=0.75):
    grams = TX.query_grams(q)

    def all_grams(t):
        t = (t or "").lower()
        return [t[i:i + n] for n in (4, 5) for i in range(len(t) - n + 1)]

    toks = {k: all_grams(t) for k, t in docs.items()}
    n = len(docs)
    avgdl = sum(len(v) for v in toks.values()) / n
    out = {}
    for k, tk in toks.items():
        s, hit = 0.0, False
        for g in grams:
            tf = tk.count(g)
            if tf:
                hit = True
                df = sum(1 for v in toks.values() if g in v)
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                s += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tk) / avgdl))
        if hit:
            out[k] = s
    return out


DOCS = {1: "red widget", 2: "blue widget widget", 3: "old gear", 4: None, 5: "widgetwidget red", 6: "wid"}


def test_scan_matches_python_and_postings(spark):
    df = spark.createDataFrame(list(DOCS.items()), "k long, t string")
    expect = python_bm25(DOCS, "red widget")
    scan = {r.k: r.score for r in BM.bm25_scan(df, ["t"], "red widget").collect()}
    assert scan.keys() == expect.keys()
    for k in expect:
        assert scan[k] == pytest.approx(expect[k], rel=1e-12)
    idx = BM.build_postings(df, "k", ["t"])
    req = spark.createDataFrame([("q1", "red widget"), ("q2", "gear")], "query_id string, q string")
    post = {(r.query_id, r.key): r.score for r in BM.bm25_postings(idx, req).collect()}
    for k in expect:
        assert post[("q1", k)] == pytest.approx(expect[k], rel=1e-12)
    assert {k for (q, k) in post if q == "q2"} == {3}


def test_long_text_postings_equal_short(spark):
    df = spark.createDataFrame(list(DOCS.items()), "k long, t string")
    a = BM.build_postings(df, "k", ["t"]).postings.collect()
    b = BM.build_postings(df, "k", ["t"], long_text=True).postings.collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_grams_no_rows(spark):
    df = spark.createDataFrame(list(DOCS.items()), "k long, t string")
    assert BM.bm25_scan(df, ["t"], "ab").count() == 0
    assert BM.bm25_scan(df, ["t"], "").count() == 0


def test_special_characters_in_query(spark):
    docs = {1: "it's a\\b c.d\nline two", 2: "it's", 3: "plain words"}
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    for q in ["it's a\\b", "c.d\nli", "d\nline"]:
        expect = python_bm25(docs, q)
        got = {r.k: r.score for r in BM.bm25_scan(df, ["t"], q).collect()}
        assert got.keys() == expect.keys(), q
        for k in expect:
            assert got[k] == pytest.approx(expect[k], rel=1e-12)
