"""Token files, phrases and whitening: against the library, brute force and a
plain eigensolver; selective reads; nulls, repeats, long texts, empty tables."""

import glob
import random
import re
import tracemalloc
import uuid
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmament.llm import phrases, queries, token_files, whitening

SF = "/root/testdata/sf0.001"
phrases_saved = phrases.saved
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string"
LONG = " ".join(f"w{i % 97}" for i in range(60_000))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ token files


def library_ids(texts, path=WORD_BPE, end=(2,)):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + list(end) for t in texts]


def test_token_files_match_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    expected, start = [], 0
    for row, ids in zip(rows, library_ids([r["text"] for r in rows])):
        expected.append((row["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op11_token_files(spark, SF).collect())) == expected


def encoded(texts, path=WORD_BPE, **options):
    return [x.tolist() for x in token_files.Encoder(path, **options).encoded(texts)]


def test_token_ids_do_not_depend_on_stretches():
    rng = random.Random(3)
    signs = "abzAZ019 .,'’sß İǅΣσς́‍中文\t\n\r\v\f\u2028\xa0\x1c  %<|>-éé!?;"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["x<|endoftext|> y", "<|endoftext|>.", "it's, they're. ' 's, a≠. ǅ.", " ", LONG]
    assert token_files.Encoder(WORD_BPE).parted and not token_files.Encoder(BYTE_BPE).parted  # the latter's pieces begin with spaces
    assert encoded(texts) == library_ids(texts, end=())
    assert encoded(texts[:300], BYTE_BPE) == library_ids(texts[:300], BYTE_BPE, ())


def test_words_are_encoded_once_whatever_signs_follow(monkeypatch, tmp_dir):
    rng = random.Random(6)
    words = ["Haus", "haus", "ÉTÉ", "été", "ŒUVRE", "æon", "ß", "e\u0301t", "l'eau", "it's", "a1", "1", "İx", "<|endoftext|>", "endoftext", "x"]
    signs = ["", ".", ",", "!?", "###", ".###", "***&", "'", "'s", ".'s", "'re,", "_", "|", "<|", "…", "\u0301", "-x", "€"]
    texts = [" ".join(rng.choice(words) + rng.choice(signs) for _ in range(30)) for _ in range(300)] + ["... ### |", ""]
    assert encoded(texts) == library_ids(texts, end=())
    for name, change in {"nfd": ('"NFC"', '"NFD"'), "cased": ('"Lowercase"', '"NFC"')}.items():
        path = f"{tmp_dir}/{name}.json"
        with open(WORD_BPE, encoding="utf8") as old, open(path, "w", encoding="utf8") as new:
            new.write(old.read().replace(*change))
        assert encoded(texts, path) == library_ids(texts, path, ())

    of, sent = token_files.Encoder(WORD_BPE), []
    library = of._of
    monkeypatch.setattr(of, "_of", lambda texts: sent.extend(" ".join(texts).split()) or library(texts))
    for text in ["Haus haus, HAUS! haus.### Haus", "haus! Haus, haus### haus"]:
        assert [x.tolist() for x in of.encoded([text])] == library_ids([text], end=())
    assert sorted(sent) == ["!", "###", ",", ".###", "haus"]


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 1)
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    letters = "abcdefghijklmnopqrst"
    texts = [" ".join(["the", "The,", "it's", *(a + b + sign for b in letters[:10] for sign in (".", "!"))]) for a in letters] + ["", " ".join(a + b for a in letters for b in letters), "the"]
    of, sent, most = token_files.Encoder(WORD_BPE), [], 0
    library = of._of
    monkeypatch.setattr(of, "_of", lambda texts: sent.extend(" ".join(texts).split()) or library(texts))
    for text, ids in zip(texts, library_ids(texts, end=())):
        assert [x.tolist() for x in of.encoded([text])] == [ids]
        most = max(most, len(of.known))
    assert sent[: sent.index("ta")].count("the") == 1  # words that were just used stay
    assert 30 < most <= 40


def test_ids_of_many_short_words_are_put_in_place_in_part():
    text, of = "a b c d " * (1 << 18), token_files.Encoder(WORD_BPE)
    tracemalloc.start()
    try:
        sizes = [len(ids) for ids in of.encoded(text for _ in range(4))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [1 << 20] * 4
    assert most < 120 << 20  # numpy's arrays and Python's objects; 2 MB a text


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_pieces_of_a_long_text(monkeypatch, piece):
    monkeypatch.setattr(token_files, "PIECE", piece)
    monkeypatch.setattr(token_files, "AT_ONCE", 3 * piece)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    texts = ["one  two three, four's " * 9, "a" * 300, " lead", "trail ", "", "  ", "lead, trail! ... one."] * 2
    assert ["".join(token_files.pieces(t)) for t in texts] == texts
    assert encoded(texts) == library_ids(texts, end=())
    assert encoded([]) == []


def test_special_strings_as_text(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b", None)], DOCS)
    token_files.write(docs, f"{tmp_dir}/plain", WORD_BPE, special_as_text=True)
    assert 49407 not in token_files.tokens(spark, f"{tmp_dir}/plain").first()["ids"]


def test_token_files_layout_and_selective_reads(spark, tmp_dir):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), *[F.hash("id", F.lit(i)) for i in range(12)]).alias("text"))
    path = f"{tmp_dir}/tokens"
    token_files.write(docs, path, WORD_BPE, files=3, row_group_bytes=1 << 15, page_rows=100)
    whole = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_files.tokens(spark, path).collect()}
    files = sorted(glob.glob(f"{path}/tokens/part-*.parquet"))
    assert len(files) == 3
    last = -1
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 1
        ids = pq.read_table(file, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last  # ascending through all files
        last = ids[-1]
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())

    listed = token_files.documents(spark, path)
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in listed.collect()} == {k: v[:2] for k, v in whole.items()}
    assert "ids" not in re.search(r"ReadSchema: struct<doc_id.*?>", plan(listed))[0]

    some = token_files.of_ids(spark, path, [5, 1700, 2999, 4000])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {k: whole[k][2] for k in (5, 1700, 2999)}
    assert "In(doc_id" in plan(some)

    total = sum(v[1] for v in whole.values())
    for begin, end in [(0, 1), (total - 1, total + 9), (total // 3 - 50, total // 3 + 700), (0, total), (7, 7), (total, total + 1)]:
        got = sorted(r["doc_id"] for r in token_files.of_range(spark, path, begin, end).collect())
        assert got == sorted(k for k, (s, n, _) in whole.items() if s < end and s + n > begin and begin < end)


def test_token_files_edges(spark, tmp_dir):
    rows = [(1, None, "en"), (2, "", None), (None, "no id", "x"), (4, LONG, "en"), (4, LONG, "en")] + [(7, f"text {i % 3}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("ids", "start", "n_tokens", "file", "h", "at", "base")})
    path = f"{tmp_dir}/edges-{uuid.uuid4().hex}"
    token_files.write(docs, path, WORD_BPE, files=4)
    assert token_files.index(spark, path).filter("first_id <= 7 and last_id >= 7").count() > 1  # a hot id is split
    got = token_files.tokens(spark, path).collect()
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((r[0] or -1, ids) for r, ids in zip(rows, library_ids([r[1] for r in rows])))
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [0, *np.cumsum([r["n_tokens"] for r in by_start])[:-1].tolist()]
    assert [r["doc_id"] or -1 for r in by_start] == sorted(r[0] or -1 for r in rows)
    token_files.write(docs.limit(0), f"{path}-none", WORD_BPE)
    assert token_files.checksums(token_files.tokens(spark, f"{path}-none")).collect() == []
    assert token_files.of_range(spark, f"{path}-none", 0, 9).collect() == []


def test_checksums_take_a_list_in_short_rows(spark, tmp_dir):
    lengths = [0, 1, 255, 256, 257, 0, 512, 513, 5000, 0]
    docs = spark.createDataFrame([(None if i == 1 else i, "a b c d " * (n // 4) + " a" * (n % 4), "en") for i, n in enumerate(lengths)], DOCS).coalesce(1)
    for end, more in ((None, []), (2, [2])):
        path = f"{tmp_dir}/short-{uuid.uuid4().hex}"
        token_files.write(docs, path, WORD_BPE, end_id=end, files=1)
        kept = {r["doc_id"]: r for r in token_files.tokens(spark, path).collect()}
        rows = token_files.checksums(token_files.tokens(spark, path))
        assert "slice(ids#" in plan(rows) and f", {token_files.SENT})" in plan(rows)  # no whole list in a batch
        got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows.collect()}
        assert got == {k: (r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for k, r in kept.items()}
        assert [got[None if i == 1 else i][1] for i in range(len(lengths))] == [n + len(more) for n in lengths]


# ------------------------------------------------------------------ phrases


def slow_phrases(rows, depth, least):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, depth + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {(lang, g): n for (lang, g), n in counts.items() if n >= least}
    held = {(lang, part) for (lang, g), n in found.items() if len(g) > 2 for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) for part in [g[i:j]] if n >= found[lang, part]}
    out = []
    for (lang, g), a in found.items():
        if len(g) > 1 and (lang, g) not in held:
            cuts = [(1000 * a * totals[lang] // (found[lang, g[:k]] * found[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.append((lang, " ".join(g), a, found[lang, g[:k]], found[lang, g[k:]], totals[lang], score))
    return sorted(out)


@pytest.mark.parametrize("depth,least,shard,rows_sent", [(5, 3, 60, 10**6), (5, 3, 60, 0), (4, 2, 300, 30), (3, 2, 10_000, 10**6), (2, 4, 25, 10**6)])
def test_phrases_match_brute_force(spark, monkeypatch, depth, least, shard, rows_sent):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows_sent)  # 30: words, but not pairs
    rng = random.Random(depth)
    chunks = ["the old mill", "a b a b a", "x x x x x x", "Zug um Zug"]
    rows = [("".join(rng.choice([w + " " for w in "the old new mill a b x zug um éa ÉA".split()] + [c + " " for c in chunks] + [", ", ".", "\n", "\t", "   "]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" . ", "en"), ("the old mill stands", "en")] + [("copied text of several words", "de")] * 9
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3)
    docs = docs.withColumns({c: F.lit("y") for c in ("word", "shard", "n", "ids", "gram", "f", "a", "l")})
    got = phrases.phrases(docs, depth=depth, min_count=least, shard_words=shard)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == slow_phrases(rows, depth, least)


def test_shards_are_read_one_by_one(spark, monkeypatch):
    """A task never holds more than one shard, and the session keeps its settings."""
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(30)), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    shards = phrases.saved(phrases.make_shards(docs, "lang", "text", 100), "shards").coalesce(1)
    assert shards.count() > 5
    held = shards.select("shard").mapInArrow(lambda batches: (b.set_column(0, "n", phrases.pa.array([len(b)] * len(b))) for b in batches), "n bigint")
    with phrases.settings(spark, phrases.ONE_ROW):
        assert {r.n for r in held.collect()} == {1}
    seen = []
    monkeypatch.setattr(phrases, "saved", lambda df, name, **o: seen.append((name, [spark.conf.get(c) for c in phrases.ONE_ROW])) or phrases_saved(df, name, **o))
    before = [spark.conf.get(c) for c in phrases.ONE_ROW]
    assert phrases.phrases(docs, min_count=3, shard_words=100).count()
    assert all(conf == ["1", "1"] for name, conf in seen if name.startswith("grams-")) and len(seen) == 8
    assert [spark.conf.get(c) for c in phrases.ONE_ROW] == before


def test_phrase_ranks_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "b c. a b. d", "en") for i in range(4)], DOCS)
    best = [(r["rank"], r["phrase"], r["score"]) for r in phrases.top_phrases(docs, keep=1, min_count=2).collect()]
    assert best == [(1, "a b", 2500)]  # ties by phrase
    assert phrases.top_phrases(docs.limit(0)).collect() == []
    assert phrases.top_phrases(docs).collect() == []


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_words_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    text = "Ein  Satz.\n\n" * 20 + "und ein sehr langer ohne Ende " * 20
    words = phrases.Words()
    ids = np.concatenate([phrases.word_ids(p, words) for p in phrases.parts(text)])
    names = {i: w.decode() for w, i in words.items()}
    plain = [w for w in re.sub(r"[.\n]", " \n ", text.lower()).split(" ") if w]
    assert [names[i] for i in ids] == plain


def test_index_counts_every_phrase():
    rng = np.random.default_rng(5)
    text = np.concatenate([np.append(rng.integers(1, 5, rng.integers(0, 9)), 0) for _ in range(80)])
    text = phrases.with_breaks(text, np.arange(5))
    want = {m: Counter() for m in range(2, 6)}
    around = {}
    for run in " ".join(map(str, text)).split("0"):
        w = tuple(map(int, run.split()))
        for m in want:
            for i in range(len(w) - m + 1):
                want[m][w[i : i + m]] += 1
                sides = around.setdefault(w[i : i + m], (set(), set()))
                sides[0].add(w[i - 1] if i else 0)
                sides[1].add(w[i + m] if i + m < len(w) else 0)
    for m, (grams, n, left, right) in enumerate(phrases.enumerate_phrases(text, 5, 5), 2):
        assert {tuple(g): c for g, c in zip(grams.tolist(), n.tolist())} == want[m]
        if m < 5:
            one = lambda s: next(iter(s)) if len(s) == 1 else 0
            assert [(one(around[tuple(g)][0]), one(around[tuple(g)][1])) for g in grams.tolist()] == list(zip(left.tolist(), right.tolist()))


@pytest.mark.parametrize("letters", [3, 8, 300])
def test_longest_phrases_are_one_row_a_place(letters):
    """What a shard hands over follows the places of its text, not how many
    phrases are frequent; a repeated text is handed over once."""
    rng = np.random.default_rng(letters)
    text = np.append(rng.integers(1, letters + 1, 500), 0)
    words = np.arange(1, letters + 1)
    for copies in (1, 6):
        ids = np.tile(text, copies).astype("<i4").tobytes()
        got = phrases.longest_blocks(ids, words, rng.permutation(words) + 70, 5, [])
        assert sum(got["n"]) <= 499  # all but the first word of a text end one
        *longest, after, n = phrases.unpack(got["block"][0], 7, got["n"][0])
        assert n.sum() == 499 * copies and all((x == 0).sum() < 4 for x in longest)


@pytest.mark.parametrize("size,rows_sent", [(1, 10**6), (2, 10**6), (7, 0), (50, 10**6)])
def test_phrases_that_go_on_in_the_next_range(spark, monkeypatch, size, rows_sent):
    """Ranges of a few rows: most phrases lie in several, some in whole ranges."""
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows_sent)
    monkeypatch.setattr(phrases, "RANGE_ROWS", size)
    rng = random.Random(size)
    rows = [(" ".join(rng.choice(["a", "b", "a b c", "d."]) for _ in range(rng.randrange(12))), "en") for _ in range(40)] + [("a b a b a", None)] * 5
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(2)
    got = phrases.phrases(docs, min_count=4, shard_words=20)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == slow_phrases(rows, 5, 4)


def test_ranges_add_up_to_the_whole():
    """Counts and neighbours of a range, and of its parts, against plain ones."""
    rng = np.random.default_rng(4)
    ends = [tuple(rng.integers(1, 3, rng.integers(2, 6))) for _ in range(300)]
    rows = sorted(tuple(e[::-1]) + (0,) * (5 - len(e)) + (int(rng.integers(0, 3)),) for e in ends)
    table = np.array(rows)
    words, after = list(table[:, :5].T), table[:, 5]
    n = np.ones(len(rows), np.int64)
    want = {m: Counter(r[:m][::-1] for r in rows if r[m - 1]) for m in range(2, 6)}
    for parts in (1, 3, 40):
        got = Counter()
        for at in np.array_split(np.arange(len(rows)), parts):
            for m, found in enumerate(phrases.counted([x[at] for x in words], after[at], n[at], 1), 2):
                for row in found.tolist():
                    got[tuple(row[:m])] += row[5]
        assert got == sum(want.values(), Counter())
    for m, found in enumerate(phrases.counted(words, after, n, 6), 2):
        for *gram, count, left, right in found.tolist():
            mine = [r for r in rows if r[:m] == tuple(gram[:m][::-1])]
            one = lambda s: next(iter(s)) if len(s) == 1 else 0
            assert count == len(mine) and (m == 5 or (left, right) == (one({r[m] for r in mine}), one({r[5] for r in mine})))


def test_scores_pass_64_bits(spark):
    a, n, l, r = 10**11, 10**14, 10**12, 10**12 - 1
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    e = phrases.exact
    got = row.select(F.expr("1").alias("x"), (e(F.col("a")) * e(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).alias("over"), (e(F.col("l")) * e(F.col("r"))).alias("under")).select(F.expr("over div under").alias("s"), "over").first()
    assert got["s"] == 1000 * a * n // (l * r) and got["over"] == Decimal(1000 * a * n)


# ------------------------------------------------------------------ whitening


def brute_whitening(rows, count=4, scale=256):
    x = {i: np.floor(scale * np.array(v, float)).astype(int) for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, w = (a[..., ::-1] for a in np.linalg.eigh(v))
    return n, {(i, k + 1): (sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)), float((r - s / n) @ w[:, k] / np.sqrt(e[k])), e[k] / np.trace(v)) for i, r in x.items() for k in range(count)}


def same(got, n, want):
    assert len(got) == len(want)
    signs = {}
    for r in got:
        deviation, whitened, explained = want[r["vec_id"], r["component"]]
        sign = signs.setdefault(r["component"], 1 if whitened * r["whitened"] >= 0 else -1)
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(sign * r["whitened"] - whitened) < 1e-8
        assert abs(r["explained"] / explained - 1) < 1e-10 and r["identity_error"] < 1e-10


def test_whitening_matches_an_eigensolver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op13_whitening(spark, SF).collect(), *brute_whitening(rows))


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal([3, -2, 0, 1, 0], [5, 3, 2, 1, 0.5])]) for i in range(300)]
    good += [(1000 + i, good[0][1]) for i in range(200)]  # repeated
    bad = [(-1, None), (-2, []), (-3, [1.0, None, 0, 0, 0]), (-4, [float("nan"), 0, 0, 0, 0]), (-5, [float("inf")] * 5), (-6, [1e300] * 5), (-7, [1.0, 2.0])]
    df = spark.createDataFrame(good + [(i, v and [None if x is None else float(x) for x in v]) for i, v in bad], "vec_id bigint, embedding array<double>")
    df = df.withColumns({c: F.lit("z") for c in ("x", "n", "component", "label")})
    x = whitening.scaled(df)
    same(whitening.whiten(x, whitening.fit(x)).collect(), *brute_whitening(good))

    one = whitening.scaled(df.filter("vec_id >= 1000"))
    none = whitening.scaled(df.limit(0))
    assert whitening.whiten(one, whitening.fit(one)).collect() == [] and whitening.whiten(none, whitening.fit(none)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), float(2 * i), 7.0]) for i in range(9)] + [(None, [4.0, 8.0, 7.0])], "vec_id bigint, embedding array<float>")
    flat = whitening.scaled(flat)
    assert {r["component"] for r in whitening.whiten(flat, whitening.fit(flat)).collect()} == {1}  # one direction varies
    assert whitening.whiten(flat, whitening.fit(flat)).count() == 10


@pytest.mark.parametrize("values", [[1] * 5, [0] * 4, [3, 3, 1, 1, 1], [10.0**-i for i in range(30)], [1, 1 + 1e-13, 1 - 1e-13, 2], [1e9] + [1] * 20, list(range(40)), [-2, -1, 0, 5]])
def test_spectrum_of_hard_matrices(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    v = q @ np.diag(values).astype(float) @ q.T
    v, size = (v + v.T) / 2, max(map(abs, values)) or 1
    for count in (None, 2):
        e, w = whitening.spectrum(v, count)
        assert np.abs(e - np.sort(values)[::-1][:count]).max() <= 1e-14 * size * len(values)
        assert np.abs(w.T @ w - np.eye(len(e))).max() < 1e-13 and np.abs(v @ w - w * e).max() < 1e-13 * size


def test_exact_deviations_beyond_doubles():
    centre = whitening.Centre(3, (10**17 + 1, 5))
    x = np.array([[10**16 + 7, 2]])
    assert centre.apart(x).tolist() == [[3 * (10**16 + 7) - 10**17 - 1, 1]]


def test_phrases_of_a_shard_are_held_once_however_many_ranges():
    rng = np.random.default_rng(3)
    ids, words = rng.integers(0, 900, 40_000).astype("<i4").tobytes(), np.arange(1, 900)
    bounds = [(i << 31, 0, 0) for i in range(2, 900)]
    tracemalloc.start()
    try:
        got = phrases.longest_blocks(ids, words, words, 5, bounds)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got["part"]) > 800 and sum(got["n"]) > 30_000
    assert most < 40e6  # each range had held a column of the whole shard
    whole = phrases.longest_blocks(ids, words, words, 5, [])
    parts = [phrases.unpack(b, 7, n) for b, n in zip(got["block"], got["n"])]
    columns = [*np.concatenate(parts, axis=1)], [*phrases.unpack(whole["block"][0], 7, whole["n"][0])]
    assert len({tuple(np.stack(c)[:, np.lexsort(c)].ravel().tolist()) for c in columns}) == 1


def test_a_shards_words_are_found_of_its_language():
    words = {"lang": pa.array(["de", "en", "en", "fr"]), "word": pa.array(["a", "b", "a", "c"]), "word_id": pa.array([1, 2, 3, 4])}
    local, number = phrases.own_words(words, "en", pa.array(["x", "a", "c", "b"]))
    assert dict(zip(local.tolist(), number.tolist())) == {2: 3, 4: 2}
    assert not len(phrases.own_words(words, "es", pa.array(["a"]))[0])
