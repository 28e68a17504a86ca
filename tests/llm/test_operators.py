"""Each operator against brute force on the small tables, fixed cases, and
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns."""

import base64
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from firmament.llm import components, decontaminate, hnsw, html_text, langid, linkgraph, mixing, pii, quality, queries, secret_scan, simhash
from firmament.llm.store import saved

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = ("lorem ipsum dolor sit amet " * 8000).strip()

# null and empty texts, ties, a repeated row, a null id and null columns
EDGE = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", 3),
    (4, "one two", "en", "b", 7),
    (4, "one two", "en", "b", 7),
    (None, "one two three four five", "en", None, 23),
    (7, "12345 67890 !!", "de", "b", 14),
    (8, LONG, "en", "a", len(LONG)),
    (9, "one two", "en", "b", 7),
]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """The edge rows, with extra columns that clash with the operators' own names."""
    extra = {c: F.lit("x") for c in ("text_key", "fp", "key", "size", "score", "spans", "item_id", "component_id", "row", "u", "h", "id", "kept", "redacted")}
    return spark.createDataFrame(EDGE, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ components
def test_components_chain_star_and_none(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(-5, -9), (7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 140)} == {100} and got[-5] == got[-9] == -9
    assert rows(components.components(spark.createDataFrame([], "a bigint, b bigint"))) == []


def test_components_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    a, b = np.array(edges).T
    label = components.min_labels(a, b, 400)
    assert all(got[n] == label[n] for pair in edges if pair[0] != pair[1] for n in pair)


# ------------------------------------------------------------------ SimHash
def slow_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = {r.doc_id: r for r in queries.op10_simhash(spark, SF).collect()}
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    pairs = np.array([(i, j) for i in range(len(ids)) for j in range(i) if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 4] or [(0, 0)])
    label = components.min_labels(pairs[:, 0], pairs[:, 1], len(ids))
    for i, d in enumerate(ids):
        assert (got[d].fingerprint, got[d].component_id) == (f"{fps[d]:016x}", ids[label[i]])


def test_simhash_large_buckets(spark):
    """A dense group of distinct fingerprints goes through the chunk pairs."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0x0F0F << 40 | rng.getrandbits(14) for _ in range(900)}
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 4)
    got = dict(rows(components.components(edges)))
    a = np.array(fps)
    i, j = np.nonzero(np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 4)
    label = components.min_labels(i, j, len(fps))
    assert all(got.get(f, f) == fps[label[k]] for k, f in enumerate(fps))


def test_simhash_more_blocks_for_more_rows():
    assert len(simhash.block_masks(4, 10)) == 15 and len(simhash.block_masks(4, 10**9)) == 35
    for n in (10, 10**9, 10**11):
        masks = simhash.block_masks(4, n)
        rng = random.Random(n)
        for _ in range(300):  # any four bits leave one mask untouched
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not (m % (1 << 64)) & flips for m in masks)


def test_simhash_edges(edge, no_docs):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[9].component_id == by[4].component_id == 4 and not by[9].kept
    assert simhash.near_duplicates(no_docs).count() == 0


# ------------------------------------------------------------------ decontamination
def test_contamination_matches_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op9_contamination(spark, SF).select("doc_id", "item_id", "n_shared", "n_item")
    assert sorted(rows(got)) == sorted(x[:4] for x in con.execute(decontaminate.ORACLE).fetchall()) != []


def test_contamination_threshold_and_noise(spark, edge):
    item = [f"w{i}" for i in range(24)]  # 20 shingles
    cut = lambda k: " ".join(item[:k] + ["zz"])
    docs = spark.createDataFrame(
        [(1, "x " * 3000 + " ".join(w.upper() + "!!" for w in item) + " y" * 3000), (2, cut(20)), (3, cut(19)), (4, None), (5, "Q, R. s")], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(10, " ".join(item)), (11, "q r S"), (12, None), (None, "..."), (13, LONG)], "item_id bigint, text string")
    got = {r[:2]: r[4] for r in rows(decontaminate.contaminated(docs, items))}
    assert got == {(1, 10): 1.0, (2, 10): 0.8, (5, 11): 1.0}
    assert {r[:2] for r in rows(decontaminate.contaminated(edge, items))} == {(8, 13)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4]
    assert decontaminate.clean(edge, items).columns == edge.columns
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), items).count()


def test_short_items_are_found_inside_long_texts(spark):
    docs = [(1, "alpha beta"), (2, "x alpha beta y and many more words follow"), (3, "alpha x beta y z and more words"), (4, "beta"), (5, "so Gamma, delta; epsilon zeta eta theta iota kappa"), (6, "one two three four five six"), (7, None)]
    items = [(1, "Alpha beta."), (2, "gamma delta epsilon zeta"), (3, "zeta"), (4, "one two three four five"), (5, ""), (6, None)]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1), (2, 1), (5, 2), (5, 3), (6, 4)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 7]
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        con.register(name, df.toPandas())
    assert sorted(tuple(r)[:2] for r in con.sql(decontaminate.ORACLE).fetchall()) == got


def test_contamination_is_native(spark):
    plan = queries.op9_contamination(spark, SF)._jdf.queryExecution().toString() + queries.op2_pii(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ mixing
def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {s for s in names if not sizes[s]}
    while True:
        rest, open_w = total - sum(cap * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and t[s] >= cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing_targets_and_totals(spark):
    docs = table(spark, "documents")
    got = queries.op6_mixing(spark, SF).collect()
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and r.taken in (0, size[r.doc_id], 2 * size[r.doc_id]) for r in got)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = queries.op6_mixing(spark, SF).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_mixing_is_pareto_order(spark, monkeypatch):
    """The extra copies of a source are a prefix of its order by odds over odds."""
    monkeypatch.setattr(mixing, "NARROW", 5)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 7))").alias("text"), F.lit("s").alias("source"), (1 + F.col("id") % 3).alias("merit"))
    got = mixing.mix(docs, weights=[1], share=0.8, merit_col="merit").join(docs.select("doc_id", "text"), "doc_id")
    u = (F.pmod(F.xxhash64(F.lit(42), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    got = got.withColumn("u", u).collect()
    p = {r.doc_id: r.expected - int(r.expected) for r in got}
    order = sorted((r for r in got if p[r.doc_id] > 0), key=lambda r: (r.u / (1 - r.u)) / (p[r.doc_id] / (1 - p[r.doc_id])))
    extra = [r.copies - int(r.expected) for r in order]
    assert extra == sorted(extra, reverse=True) and 0 < sum(extra) < len(extra)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 7


def test_mixing_inclusion_follows_the_odds(spark):
    """Documents of unequal merit are taken as often as their expected copies say."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), (1 + F.col("id") % 4).alias("merit"))
    got = mixing.mix(docs, weights=[1], share=0.7, merit_col="merit")
    for r in got.groupBy((F.col("doc_id") % 4).alias("kind")).agg(F.avg("copies").alias("taken"), F.avg("expected").alias("expected"), F.count("*").alias("n")).collect():
        p = r.expected - int(r.expected)
        assert abs(r.taken - r.expected) < 4 * (p * (1 - p) / r.n) ** 0.5 + 0.01
    assert abs(got.agg(F.sum("taken")).first()[0] - got.first().target) <= 2


def test_mixing_many_equal_rows(spark, monkeypatch):
    """Rows that repeat are counted off, not ordered in one task; as many are taken as fit."""
    monkeypatch.setattr(mixing, "NARROW", 50)
    docs = spark.range(9_000).select(F.when(F.col("id") < 8_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), F.lit(None).cast("string").alias("source"))
    got = mixing.mix(docs, weights=[1], share=0.5).collect()
    assert len(got) == 9_000 and abs(sum(r.taken for r in got) - got[0].target) <= 1.5
    assert 0 < sum(r.copies for r in got if r.doc_id == 7) < 8_000
    again = mixing.mix(docs.repartition(5), weights=[1], share=0.5).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_edges(edge, no_docs):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.taken <= 2 * r["size"] for r in got)
    assert {r.doc_id: r["size"] for r in got}[1] == 0
    assert mixing.mix(no_docs).count() == 0


# ------------------------------------------------------------------ secrets
def test_secret_base_spans_match_the_patterns(spark):
    for r in queries.op7_secrets(spark, SF).join(table(spark, "documents"), "doc_id").collect():
        text = r.text or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()


def test_guess_costs():
    words = secret_scan.dictionary(queries.VOCABULARY)
    cost = lambda v: secret_scan.guess_cost(v, words)[0]
    weak = ("password123", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "changeme2024", "2019-05-12", "zxcvbnm", "P@ssw0rd")
    assert all(cost(v) < secret_scan.MIN_LOG10 for v in weak)
    assert all(cost(v) >= secret_scan.MIN_LOG10 for v in ("x8Fq!29zLmPa", "k9#vQz7!pW", "hGf7$kk29Lq"))
    # never dearer than brute force, and a suffix never makes it cheaper by much
    rng = random.Random(2)
    for _ in range(60):
        v = "".join(rng.choice("abqwe12345Zz!é") for _ in range(rng.randint(1, 14)))
        total, cuts = secret_scan.guess_cost(v, words)
        assert total <= len(v) * secret_scan._alphabet(v) + secret_scan.SEGMENT + 1e-9
        assert [c[0] for c in cuts] + [len(v)] == [0] + [c[1] for c in cuts]


def test_guess_cost_is_the_least_of_all_segmentations():
    words = {"pass": 5, "word": 9, "sword": 100}
    for v in ("password", "passswordq", "qpassword1"):
        each, ends = secret_scan._alphabet(v), secret_scan.segments(v, words)

        def least(j, v=v, each=each, ends=ends):
            brute = [least(i) + (j - i) * each + secret_scan.SEGMENT for i in range(j)]
            return 0.0 if j == 0 else min(brute + [least(i) + g + secret_scan.SEGMENT for i, g, _ in ends[j]])

        assert secret_scan.guess_cost(v, words)[0] == pytest.approx(least(len(v)))


def test_a_missing_vocabulary_is_an_error(tmp_dir):
    with pytest.raises(FileNotFoundError):
        secret_scan.dictionary(f"{tmp_dir}/none.tiktoken")
    assert secret_scan.guess_cost("correct-horse-battery", secret_scan.dictionary(queries.VOCABULARY))[0] < 20


def test_values_in_base_spans_are_priced_too(spark):
    words = secret_scan.dictionary(queries.VOCABULARY)
    texts = ["password = k9QvQz7XpWd4", "password: password123", "no credential here", None, 'x secret=abcdefgh y token="Zq8RtY2mWx5v"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.max_guess_log10 for r in secret_scan.find_secrets(docs, words).orderBy("doc_id").collect()]
    want = ["k9QvQz7XpWd4", "password123", None, None, "Zq8RtY2mWx5v"]
    assert got == [None if v is None else pytest.approx(secret_scan.guess_cost(v, words)[0]) for v in want]


def test_secret_contexts_and_redaction(spark, edge, no_docs):
    words = secret_scan.dictionary(queries.VOCABULARY)
    text = 'login: hGf7$kk29Lq\npwd=qwerty123 é mysql://bob:s3cr3tPa55w0rdZq@host token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" the pin is in'
    spans = secret_scan.scan(text, words)
    assert [(k, text[a:b][:6]) for a, b, k in spans] == [("guess", "hGf7$k"), ("guess", "s3cr3t"), ("assign", "token "), ("hex", "abe29c")]
    docs = spark.createDataFrame([(1, text, 5), (2, "clean", 5), (3, None, None)], "doc_id bigint, text string, n_chars int")
    got = secret_scan.redact(docs, words).orderBy("doc_id").collect()
    assert got[0].text.count("[SECRET]") == 3 and "qwerty123" in got[0].text and got[0].n_chars == len(got[0].text)
    assert got[1].text == "clean" and got[1].n_chars == 5 and got[2].text is None
    found = secret_scan.find_secrets(edge, words).collect()
    assert len(found) == len(EDGE) and all(r.spans == "" for r in found)
    assert secret_scan.redact(edge, words).columns == edge.columns and secret_scan.find_secrets(no_docs, words).count() == 0


# ------------------------------------------------------------------ personal data
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    ok = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d), "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok[k](m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data_base_spans(spark):
    pieces = ["a@b.cd_e@f.g", "x.y@z", "1.2.3.4.5.6.7.8", "300.1.1.1", "0000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "é😀", "..@..", "a@b.c@d.e", "1" * 30, "+49.30.123456789012", "\n"]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["".join(rng.choice("1234 .-+@a()") for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pii.digest(pii.find_personal_data(docs, support=10**6)).collect()
    for r in got:
        assert r.spans == plain_spans(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    for r in queries.op2_pii(spark, SF).join(table(spark, "documents").select("doc_id", "text"), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(plain_spans(r.text).encode()).hexdigest()


def test_disclosing_terms(spark):
    """zorblat occurs only near the entity: removed or generalised; common stays."""
    docs = [(i, f"the common zorblat wrote from jim@x.org about common things {i}") for i in range(4)]
    docs += [(10 + i, f"common text number {i} has the zorb of other things") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = pii.find_personal_data(docs, disclosure=0.95)
    by = {r.doc_id: r for r in pii.digest(found).collect()}
    text = docs.filter("doc_id = 0").first().text
    terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in by[0].spans.split(",")) if k == "term"}
    assert "zorblat" in terms and "common" not in terms and by[10].spans == ""
    out = {r.doc_id: r.text for r in pii.sanitised(docs, found).collect()}
    assert "jim" not in out[0] and "[EMAIL]" in out[0] and "zorblat" not in out[0] and "zorb*" in out[0] and out[10] == docs.filter("doc_id = 10").first().text


def test_terms_of_values_in_one_document(spark):
    """A value held once is disclosed by the words that only its document holds."""
    docs = [(0, "the common quixley wrote from jim@x.org about common things")]
    docs += [(10 + i, "the common text wrote from here about common things") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = pii.find_personal_data(docs)
    by = {r.doc_id: r for r in pii.digest(found).collect()}
    assert by[0].spans == "term:11:18,email:30:39" and by[0].n_term == 1 and by[10].spans == ""
    assert "quix" not in {r.doc_id: r.text for r in pii.sanitised(docs, found).collect()}[0]
    held = [r for r in queries.op2_pii(spark, SF).collect() if r.n_email + r.n_ip + r.n_card + r.n_phone]
    assert held and sum(r.n_term for r in held) > 0


def test_terms_far_from_the_value_and_in_other_texts(spark):
    far = "common words here " * 40  # 720 characters
    docs = [(i, f"zorblat {far} jim@x.org {far} Zorblat jim") for i in range(3)]
    docs += [(3, f"{far} the zorblat again"), (4, None)] + [(10 + i, f"{far} the zorb") for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = pii.find_personal_data(docs)
    by = {r.doc_id: r for r in pii.digest(found).collect()}
    # both places in a text that holds the value, "jim" outside it, and the text without it
    assert [by[i].n_term for i in (0, 3, 4, 10)] == [3, 1, 0, 0]
    out = {r.doc_id: r.text for r in pii.sanitised(docs, found).collect()}
    assert not any("zorblat" in (t or "").lower() for t in out.values()) and "jim" not in out[0] and out[3] == f"{far} the zorb* again"


def test_placed_matches_are_whole_in_blocks(spark):
    texts = ["", "no", "abc", " abc é😀 defg" * 500, "İstanbul x " * pii.BLOCK, "word " * (pii.BLOCK + 1)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.matches(F.col("t"), pii.WORD).alias("m")).collect()
    for r in got:
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]{3,}", texts[r.i])]


def test_personal_data_edges(spark, edge, no_docs):
    got = pii.digest(pii.find_personal_data(edge)).collect()
    assert len(got) == len(EDGE) and all(r.spans == "" for r in got)
    assert pii.find_personal_data(no_docs).count() == 0
    hard = ["1" * 100_000, "a." * 50_000 + "@", "1-" * 50_000, "a@" + "b." * 40_000, "+1" + "(" * 50_000]
    got = pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string"))).collect()
    assert {r.doc_id: r.spans for r in got}[3] == f"email:0:{2 + 80_000 - 1}"


# ------------------------------------------------------------------ language and quality
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_unlearned_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.learned(docs))
    rng = random.Random(5)
    strange = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era",
        "Mieleni minun tekevi, aivoni ajattelevi lahteani laulamahan, saa'ani sanelemahan, sukuvirtta suoltamahan, lajivirtta laulamahan.",
        "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил и лучше выдумать не мог.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(120)),
        base64.b64encode(rng.randbytes(600)).decode(),
    ]
    strange = spark.createDataFrame(list(enumerate(strange)), "doc_id bigint, text string")
    assert langid.accepted(strange, model).count() == 0 and langid.accepted(strange, model, min_score=0.0).count() == 5
    held = docs.exceptAll(langid.learned(docs))
    assert langid.accepted(held, model).count() >= 0.995 * held.count()
    # a language left out, and a model of one family
    for out, langs in (("de", ["en", "fr", "es"]), ("en", ["de", "fr", "es"]), ("fr", ["en"])):
        model = langid.train(langid.learned(docs).filter(F.col("lang").isin(langs)))
        left, kept = held.filter(F.col("lang") == out), held.filter(F.col("lang").isin(langs))
        assert langid.accepted(left, model).count() <= 0.1 * left.count() and langid.accepted(kept, model).count() >= 0.98 * kept.count()


def test_language_sample_is_bounded(spark, monkeypatch):
    """One id on many rows, copies without number, and more languages than are learned."""
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda x, langs: fitted.append(langs))
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, 1).otherwise(F.lit(None)).alias("doc_id"), F.concat(F.lit("some text "), F.when(F.col("id") < 1_500, F.col("id")).otherwise(0)).alias("text"), F.lit("en").alias("lang"))
    dirty = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.concat(F.lit("x"), F.col("id")).alias("lang"))
    langid.train(rows.unionByName(dirty).unionByName(dirty), per_language=20, languages=10)
    assert len(set(fitted[0])) == 10 and fitted[0].count("en") == 20 and len(fitted[0]) == 29


def test_language_edges(spark, edge, no_docs):
    model = langid.train(table(spark, "documents"))
    got = langid.identify(edge, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 7))
    assert langid.accepted(edge, model).columns == edge.columns
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(edge, empty).collect()} == {"und"} and langid.identify(no_docs, model).count() == 0
    assert langid.family("en-US") == "germanic" and langid.family("xx") == "xx"


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op1_quality(spark, sf).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_quality_sample_is_bounded(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels, weights: fitted.append(labels))
    docs = spark.range(2_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 1_000, F.col("id")).otherwise(0)).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    quality.train(docs, labels, per_label=30)
    assert len(fitted[0]) == 30


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(5, quality.DIMS)))
    model = quality.fit([x, x + 1], np.array([0.0, 1.0]), np.ones(2), rounds=2)
    s, kept = model.forward(x)
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    model.gradient(x, s - 1.0, kept, g)
    for k in g:
        at = tuple(0 for _ in g[k].shape)
        model.p[k][at] += 1e-6
        more = -np.log(model.forward(x)[0])
        model.p[k][at] -= 2e-6
        less = -np.log(model.forward(x)[0])
        model.p[k][at] += 1e-6
        assert g[k][at] == pytest.approx((more - less) / 2e-6, abs=1e-4)


def test_quality_edges(spark, edge, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.train(edge, labels)
    got = {r.doc_id: r for r in quality.score(edge, model).collect()}
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (1, 2, 3)) and 0 < got[8].score < 1
    assert quality.score(edge, quality.train(edge, labels.limit(0))).filter("doc_id = 4").first().score == 0.5
    assert quality.score(no_docs, model).count() == 0


# ------------------------------------------------------------------ embeddings
def test_embeddings_match_brute_force(spark):
    """Clusters dense enough to fill beams, copies, and vectors that have no links."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.vstack([rng.normal(size=(500, 16))] + [c + rng.normal(size=(n, 16)) * s for c, n, s in zip(centres, (3, 300, 40, 5, 90, 2, 7, 9, 30, 4, 60, 8), [0.1, 0.08, 0.2] * 4)])
    x = np.vstack([x, x[:3], x[:3] * 2])
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v) for i, v in enumerate(odd)]
    vecs = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("cid", F.lit(1)).withColumn("key", F.lit(1))
    got = {r.vec_id: r for r in hnsw.near_duplicates(vecs, shards=2, blocks=2).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(u @ u.T >= 0.95)
    label = components.min_labels(i, j, len(x))
    count = np.bincount(i, minlength=len(x)) - 1
    found = sum(min(got[k].n_links, count[k]) for k in range(len(x)))
    assert found >= 0.99 * count.sum() and all(got[k].n_links <= count[k] for k in range(len(x)))
    assert np.mean([got[k].component_id == label[k] for k in range(len(x))]) > 0.995
    assert all(got[10_000 + k].n_links == 0 and got[10_000 + k].kept for k in range(len(odd)))
    assert hnsw.near_duplicates(vecs.limit(0)).count() == 0


def test_shards_of_embeddings_are_bounded_by_bytes(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(120, 6))
    x = np.vstack([x, x[:40] * 1.5, x[:40] + 0.01])
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    tables = {}

    def kept(df, name, **options):
        tables[name] = saved(df, name, **options)
        return tables[name]

    monkeypatch.setattr(hnsw, "saved", kept)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 1000)
    monkeypatch.setattr(hnsw, "COSINES", 50)
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(vecs, shards=1, blocks=1).collect()}
    n_bytes = tables["classes"].selectExpr("sum(octet_length(unit))").first()[0]
    assert tables["graphs"].count() >= 0.7 * n_bytes / 1000 > 4
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist()))


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x)
    truth = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    ids, _ = graph.search(x[:200], 64)
    assert np.mean([np.isin(t, i).mean() for t, i in zip(truth, ids)]) > 0.9 and len(graph.levels) > 1


# ------------------------------------------------------------------ pages
def test_main_text_of_the_pages(spark):
    import html

    for r in queries.op5_main_text(spark, SF).join(table(spark, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_main_text_of_other_layouts(spark):
    sources = sorted(r.html for r in table(spark, "pages").collect())
    trees, rng = html_text.fit(sources[: len(sources) // 2]), random.Random(8)
    stray = ["Thanks for this, it was good.", "I do not agree; see below."]
    exact, n = 0, 0
    for source in sources[len(sources) // 2 :]:
        page = html_text.parse(source)
        content, other = html_text.blocks_of(page, html_text.weak_labels(page))
        made = html_text.layout(content[:40], other, stray, rng)
        page = html_text.parse(made)
        want = html_text.text_of(page, html_text.layout_labels(page) > 0)
        exact, n = exact + (html_text.extract(made, trees) == want), n + 1
    assert exact / n > 0.85


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(sorted(r.html for r in table(spark, "pages").collect()))


def laid_out(inner, before="", after=""):
    return f"<html><head><title>t</title></head><body>{before}<div class='wrapper'><article>{inner}</article></div>{after}</body></html>"


def test_main_text_of_broken_and_hostile_markup(trees):
    article = "<h1>A title</h1>" + "".join(f"<p>This is sentence {i} of the article, and it has words. Another one follows here.</p>" for i in range(8))
    text = "\n".join(["A title", *(f"This is sentence {i} of the article, and it has words. Another one follows here." for i in range(8))])
    of = lambda *parts: html_text.extract(laid_out(*parts), trees)
    assert of(article) == text
    assert of(article + "<p>See <a title=O'Brien href=x>the link</a> now, it is good.</p>") == text + "\nSee the link now, it is good."
    assert of(article + "<script src=a.js /> var a=1;</script><p>These are the last words of it.</p>") == text + "\nThese are the last words of it."
    assert of(article, "Accept our cookies now") == text
    assert of(article.replace("here.</p>", "here. <span class='ad'>Buy now cheap!</span></p>", 1)) == text
    assert of(article + "<p>The formula <math><mi>y2</mi></math> is known to all of us.</p>") == text + "\nThe formula y2 is known to all of us."
    for unclosed in ("button", "svg", "select", "canvas", "audio", "span class='ad'"):
        assert of(f"<{unclosed}>" + article) == text


@pytest.mark.parametrize("unit", ["<a href=\"x ", "<a href='x ", "<b>", "<b></i>", "<p><table><td><b><h2>", "<!--", "<", "</", "<a =", "<li><b>", "<svg"])
def test_parsing_time_is_linear(unit):
    took = []
    for n in (100_000, 400_000):
        source = (unit * n)[:n]
        start = time.process_time()
        html_text.parse(source)
        took.append(time.process_time() - start)
    assert took[1] < 0.5 + 12 * took[0] and took[1] < 10


def test_decoding_never_contradicts():
    rng = np.random.default_rng(9)
    page = html_text.parse("<body><div><p>a</p><div><p>b</p><ul><li>c<li>d</ul></div></div><div><p>e</p></div></body>")
    for _ in range(200):
        kept = html_text.decode(page, rng.normal(size=len(page.nodes)))
        assert all(kept[n.parent] for n, k in zip(page.nodes[1:], kept[1:]) if k)


def test_main_text_edges(spark):
    data = [
        (1, "u", None), (2, None, ""), (3, "u", "<article><p>x &amp; y<br>z <b>bold</p><script>a<b</script><p>" + "w " * 50_000), (3, "u", ""),
        (None, "u", "plain < text"), (5, "u", '<div class="x>'), (6, "u", "</div></p><article><p>ok"),
    ]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    trees = html_text.train(table(spark, "pages"))
    got = [tuple(r) for r in html_text.main_text(pages, trees).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(data) and by[1][2] == by[2][2] == "" and by[1][3] == 0
    assert by[6][2] == "ok" and by[None][2] == "plain < text"
    assert html_text.main_text(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


# ------------------------------------------------------------------ urls
def test_url_parts_and_rules(spark):
    data = [
        (1, "HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "http://b.net/x", "b.net", "/x", "net/", "block"),
        (3, "http://c.net", "c.net", "", None, "allow"), (4, "http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        (5, "http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), (6, "ftp://x.org/fr/a://b", "x.org", "/fr/a://b", "org/fr/", "allow"),
        (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"), (9, "x://h?a/b", "h", "", None, "allow"), (9, "x://h?a/b", "h", "", None, "allow"),
        (10, "http://a\nb.net/x\ny", "a\nb.net", "/x\ny", "net/", "block"),
    ]
    pages = spark.createDataFrame([r[:2] for r in data], "page_id bigint, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    got = [tuple(r)[:5] for r in linkgraph.judge(pages, queries.URL_RULES).collect()]
    want = [(i, h, p, rule, v) for i, _, h, p, rule, v in data]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert linkgraph.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_link_graph_matches_dense_power_iteration(spark):
    rng = random.Random(12)
    hosts = [f"h{i}.test" for i in range(30)] + ["bad.net", "worse.net", "good.org"]
    pages, links = [], {}
    for i in range(400):
        src, out = rng.choice(hosts), [rng.choice(hosts) for _ in range(rng.randint(0, 4))]
        path = "/fr/" if src == "good.org" else "/x"
        pages.append((i, f"http://{src}{path}", " ".join(f"<a href='https://{d.upper()}/p'>x</a>" for d in out)))
        for d in out:
            if d != src:
                links[src, d] = links.get((src, d), 0) + 1
    got = linkgraph.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), queries.URL_RULES, tolerance=1e-9, damping=0.5, threshold=0.6).collect()

    def rank(weights, seeds):
        at = {h: i for i, h in enumerate(hosts)}
        m, s = np.zeros((len(hosts),) * 2), np.zeros(len(hosts))
        for (a, b), w in weights.items():
            m[at[b], at[a]] = w
        m /= np.maximum(m.sum(0), 1e-12)
        for h in seeds:
            s[at[h]] = 1.0
        return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - 0.5 * m, s)))

    trust, distrust = rank(links, ["good.org"]), rank({(b, a): 1 for a, b in links}, ["bad.net", "worse.net"])
    for r in got:
        assert r.trust == pytest.approx(trust[r.host], abs=1e-6) and r.distrust == pytest.approx(distrust[r.host], abs=1e-6)
        if r.rule is None:
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] and distrust[r.host] >= 0.6 else "allow")


def test_link_ranks_reach_the_tolerance_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    got = {r["host"]: r["rank"] for r in linkgraph.spread(edges, seeds, 0.85, 1e-6).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2), abs=1e-6) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2), abs=1e-6)


def test_partly_ruled_hosts_are_seeds_by_their_share(spark):
    pages = [(i, f"http://{'de' if i < 3 else 'x'}.example.com/{'de' if i < 3 else 'en'}/", None) for i in range(4)]
    pages += [(10 + i, f"http://mixed.example.com/{'de' if i < 3 else 'en'}/", None) for i in range(12)]
    pages += [(30, "http://friend.test/", '<a href="//mixed.example.com/">x</a>')]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.host: r.distrust for r in linkgraph.judge(df, queries.URL_RULES).collect()}
    assert got["de.example.com"] == pytest.approx(1.0) and got["mixed.example.com"] == pytest.approx(0.25) and got["friend.test"] == pytest.approx(0.25 * 0.85)
    verdict = lambda **o: {r.page_id: r.verdict for r in linkgraph.judge(df, queries.URL_RULES, **o).collect()}
    assert verdict()[15] == "allow" and verdict(threshold=0.2)[15] == "block" and verdict()[10] == "block"


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    docs, kept = table(spark, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns
        kept[name] = (docs, out)
        docs = out
    before, after = kept["SimHash near-dedup"]
    groups = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in groups})
    before, after = kept["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.contaminated(before, table(spark, "benchmark")).collect()}
    assert bad and sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
    before, after = kept["secret scans"]
    assert before.count() == after.count() and not after.filter(F.col("text").rlike("token = \"[0-9a-f]{32}")).count()
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_pipeline_edges(spark, edge, tmp_dir):
    table(spark, "benchmark").write.parquet(f"{tmp_dir}/benchmark.parquet")
    learned = langid.train(table(spark, "documents"))
    docs = langid.accepted(edge, learned, min_score=0.0)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = saved(stage(spark, docs, tmp_dir), "test")
        assert docs.columns == edge.columns
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [4, 8, None]
    for docs in (edge.limit(0), edge.filter("text is null")):
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, tmp_dir), "test")
        assert docs.count() == 0


# ---------------------------------------------------------------- long texts, read a piece at a time
def test_values_whose_lower_case_is_longer():
    words = secret_scan.dictionary(None)
    text = "password: İstanbul2020İ! login=İİİİ2020-01-02"
    assert all(0 <= s < e <= len(text) for s, e, _ in secret_scan.scan(text, words))
    assert secret_scan.guess_cost("İ2020", words)[1][-1][1] == 5


def test_guesses_never_overlap_base_spans():
    words = secret_scan.dictionary(None)
    text = "token=abcdefgh12 pwd: tR7#kQ9!vL2p\n" * 50 + "password=token=Zx9kQ2vL8pWm bearer: Zx9kQ2vL8pWm%"
    spans = secret_scan.scan(text, words)
    base = [(s, e) for s, e, k in spans if k != "guess"]
    guesses = [(s, e) for s, e, k in spans if k == "guess"]
    assert len(guesses) >= 50
    assert not any(s < f and b < e for s, e in guesses for b, f in base)


MANY = ["", "a", "one two three", "Ünï cödé wörds, again!  and\tagain\n" * 40, "x" * 300 + " y " + "z" * 90, "\x1c \x0b a\x1cb c d e"]


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text_do_not_change_fingerprint_and_language_features(monkeypatch, piece):
    whole = [(simhash.fingerprint(t), langid.features(t)) for t in MANY]
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(langid, "PIECE", piece)
    for t, (fp, x) in zip(MANY, whole):
        assert simhash.fingerprint(t) == fp
        y = langid.features(t)
        assert (x is None) == (y is None) and (x is None or np.allclose(x, y))


def test_quality_scores_every_passage_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = "\n".join(" ".join(rng.choice(["aa", "Bb", "12", "!?"], 6)) for _ in range(50))
    x = quality.bag(text, 1000)
    model = quality.fit([x, x[:20]], np.array([0.0, 1.0]), np.ones(2), rounds=3)
    want = model.forward(x)[0]
    for at_once in (1, 7, 50):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        assert abs(model.score(text) - want) < 1e-9
        some = quality.bag(text, 5)
        assert len(some) == 5 and np.array_equal(some[[0, -1]], x[[0, -1]])
