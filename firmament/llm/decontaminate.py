"""Benchmark decontamination: MinHash containment search, then exact containment.

Test items are short and documents long, so similarity must be containment:
the share of an item's distinct word shingles that a document holds.

1. Items are partitioned by size (distinct shingles, in doubling classes).
   An item's sketch is its bottom-k MinHash: its k smallest shingle hashes,
   with k from its size so that a document holding at least ``threshold`` of
   the item must hold one of the k (it can miss at most k - 1 shingles).  The
   sketch is as small as that allows, and no match is lost.
2. Every document's shingle hashes are joined with the sketches of the size
   classes that it is long enough to hold.  The join broadcasts the sketches up
   to ``BROADCAST_ROWS`` rows and shuffles beyond.
3. Candidates are verified on shingle strings, once per distinct text.

Words are runs of letters and digits, lower-cased, so punctuation glued to
words doesn't hide a passage.  An item of fewer words than a shingle is one
shingle, and documents are read for shingles of its length too, whatever
their own.  DataFrame functions only.

Defined results: null and wordless texts or items match nothing; repeated
rows each get their rows; null ids are carried; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import saved, small, text_key, unused

WORD = r"[\p{L}\p{N}]+"
BROADCAST_ROWS = 2_000_000  # of (hash, item) rows of 16 bytes: 32 MB
BROADCAST_KEYS = 1_000_000  # of text keys of 32 bytes: 32 MB; beyond, texts are shuffled


def shingles(text: Column, n_words: int) -> Column:
    """Word shingles of a text in order, repeats included; null and wordless: empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(n_words - 1)), lambda i: F.array_join(F.slice(w, i, n_words), " "))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= n_words, runs).otherwise(short)

    return F.transform(F.array(words), of)[0]  # binds the words once


def short_lengths(items: DataFrame, text_col: str, n_words: int) -> list[int]:
    """The numbers of words under ``n_words`` that items have: ``n_words`` - 1 values at most."""
    n = F.size(F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    return sorted(r["n"] for r in items.select(n.alias("n")).filter(F.col("n").between(1, n_words - 1)).distinct().collect())


def probes(text: Column, n_words: int, lengths: list[int]) -> Column:
    """Shingles of a document: those of ``n_words`` words and, where items are
    that short, of each of ``lengths``."""
    return F.concat(shingles(text, n_words), *[F.when(F.regexp_count(text, F.lit(WORD)) > m, shingles(text, m)).otherwise(F.array().cast("array<string>")) for m in lengths])


def item_shingles(items: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """(item_id, n_item, shingle) with distinct shingles; items of one id are one item."""
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(shingles(F.col(text_col), n_words)).alias("shingle")).distinct()
    sizes = rows.groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n_item"))
    return rows.join(sizes, F.col("item_id").eqNullSafe(F.col("of"))).select("item_id", "n_item", "shingle")


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """(size_class, item_id, h): the bottom-k MinHash of every item."""
    k = (F.col("n_item") - F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    size_class = F.floor(F.log2("n_item")).cast("int")
    hashed = shingled.groupBy("item_id", "n_item").agg(F.sort_array(F.collect_set(F.xxhash64("shingle"))).alias("hashes"))
    return hashed.select(size_class.alias("size_class"), "item_id", F.explode(F.slice("hashes", F.lit(1), k)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(text_key, item_id, n_shared, n_item) of every text that holds at least
    ``threshold`` of an item's distinct shingles."""
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    shingled = saved(item_shingles(items, item_id, item_text, n_words), "items")
    sketch = saved(sketches(shingled, threshold), "sketch")
    lengths = short_lengths(items, item_text, n_words)

    hashes = F.transform(probes(F.col("text"), n_words, lengths), lambda s: F.xxhash64(s))
    probed = texts.select("text_key", hashes.alias("hashes")).select("text_key", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    long_enough = F.col("n") >= F.pow(F.lit(2.0), F.col("size_class")) * F.lit(threshold) - F.lit(1e-9)
    found = probed.join(small(sketch, BROADCAST_ROWS), "h").filter(long_enough).select("text_key", "item_id").distinct()
    found = saved(found, "candidates")

    candidates = saved(found.select("text_key").distinct(), "candidate-texts")
    once = texts.join(small(candidates, BROADCAST_KEYS), "text_key", "left_semi").dropDuplicates(["text_key"])
    held = once.select("text_key", F.explode(F.array_distinct(probes(F.col("text"), n_words, lengths))).alias("shingle"))
    shared = held.join(small(shingled, BROADCAST_ROWS // 8, ("shingle",)), "shingle").groupBy("text_key", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    shared = shared.filter(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    found = found.select(F.col("text_key").alias("key"), F.col("item_id").alias("of"))
    return shared.join(found, (F.col("text_key") == F.col("key")) & F.col("item_id").eqNullSafe(F.col("of")), "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_shared,
    n_item, containment."""
    pairs = saved(contained(docs, items, text_col, **options), "contained")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"))
    return rows.join(pairs, "text_key").select(
        "doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    keys = saved(contained(docs, items, text_col, **options).select("text_key").distinct(), "held")
    key = unused(docs, "text_key")
    keys, keyed = keys.withColumnRenamed("text_key", key), docs.withColumn(key, text_key(F.col(text_col)))
    return keyed.join(small(keys, BROADCAST_KEYS), key, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH dw AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
bw AS (SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
m AS (SELECT DISTINCT len(w) AS m FROM bw WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM dw WHERE len(w) > 0)
       UNION SELECT doc_id, array_to_string(w[i:i+m-1], ' ')
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, m WHERE len(w) >= m)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM bw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2) JOIN n USING (item_id)
WHERE n_shared >= n_item * 0.8 - 1e-9
"""
