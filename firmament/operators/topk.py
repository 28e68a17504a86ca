"""The best k per request from a postings index, without scoring every match.

Postings are laid out by key block as well.  A table of bounds keeps, for each
(field, gram, block), the greatest contribution of any of its postings, idf
left out.  A request's bound for a block is the sum over its grams, so:

1. the blocks with the greatest bounds are scored, and the k-th best score
   there is a threshold that the answer can't be below;
2. only blocks whose bound reaches the threshold are joined and ranked.

Results equal ranking all scores of :func:`firmament.operators.bm25.bm25_postings`.
Totals are exact counts of distinct keys, for which no score is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmament.operators.bm25 import B, K1, Postings, range_parts, request_grams
from firmament.operators.search import SCORE_TIE_DIGITS
from firmament.operators.util import top_k_per_group

KEYS_PER_BLOCK = 128
SLACK = 1e-8  # scores are compared after rounding to SCORE_TIE_DIGITS


@dataclass
class Blocked:
    index: Postings  # its postings with ``block``
    bounds: DataFrame  # field, gram, block, most


def _share(k1: float, b: float) -> Column:
    """A posting's contribution, idf left out."""
    tf = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl").cast("double") / (F.col("sum_dl").cast("double") / F.col("n").cast("double")))
    return tf * F.lit(k1 + 1) / (tf + norm)


def _idf() -> Column:
    df, n = F.col("df").cast("double"), F.col("n").cast("double")
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def write_blocked(p: Postings, path: str, blocks: int | None = None, k1: float = K1, b: float = B) -> Blocked:
    """Postings sorted by (field, gram, block), and the bounds of all blocks."""
    spark = p.postings.sparkSession
    if blocks is None:
        blocks = max(1, (p.fields.agg(F.max("n")).first()[0] or 0) // KEYS_PER_BLOCK)  # a row per field
    parts = range_parts(p)
    out = p.postings.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    out = out.repartitionByRange(parts, "field", "gram", "block", "key").sortWithinPartitions("field", "gram", "block")
    out.write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    shares = stored.join(F.broadcast(p.fields), "field").repartition(parts, "field", "gram", "block")
    bounds = shares.groupBy("field", "gram", "block").agg(F.max(_share(k1, b)).alias("most"))
    bounds.write.parquet(f"{path}/bounds")
    p.grams.write.parquet(f"{path}/grams")
    p.fields.write.parquet(f"{path}/fields")
    return read_blocked(spark, path)


def read_blocked(spark: SparkSession, path: str) -> Blocked:
    postings, grams, fields, bounds = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "grams", "fields", "bounds"))
    return Blocked(Postings(postings, grams, fields), bounds)


def _asked(x: Blocked, requests: DataFrame, id_col: str, q_col: str) -> DataFrame:
    """(query_id, field, gram, idf, n, sum_dl) of the grams that the index has."""
    grams = request_grams(requests, id_col, q_col).join(x.index.grams, "gram").join(F.broadcast(x.index.fields), "field")
    return grams.select("query_id", "field", "gram", _idf().alias("idf"), "n", "sum_dl")


def _scored(x: Blocked, asked: DataFrame, blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, key, score) of the keys in some blocks (query_id, block)."""
    hits = asked.join(blocks, "query_id").join(x.index.postings, ["field", "gram", "block"])
    return hits.groupBy("query_id", "key").agg(F.sum(F.col("idf") * _share(k1, b)).alias("score"))


def reaching(x: Blocked, asked: DataFrame, k: int, seeds: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, block): the blocks that can hold one of the ``k`` best.
    ``seeds`` blocks are scored first, ``k`` unless said otherwise."""
    bound = asked.join(x.bounds, ["field", "gram"]).groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    first = top_k_per_group(bound, ["query_id"], [F.desc("bound"), F.asc("block")], seeds or max(2, k), salt_col="block").select("query_id", "block")
    best = top_k_per_group(_scored(x, asked, first, k1, b), ["query_id"], [F.desc("score"), F.asc("key")], k)
    least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
    return bound.join(least, "query_id").filter(F.col("bound") >= F.col("least") - F.lit(SLACK)).select("query_id", "block")


def top_k(x: Blocked, requests: DataFrame, k: int, id_col: str = "query_id", q_col: str = "q", totals: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, rank, score[, total]): the ``k`` best keys per request."""
    asked = _asked(x, requests, id_col, q_col)
    scores = _scored(x, asked, reaching(x, asked, k, k1=k1, b=b), k1, b)
    best = top_k_per_group(scores, ["query_id"], [F.round("score", SCORE_TIE_DIGITS).desc(), F.col("key").asc()], k)
    best = best.select("query_id", "key", "rank", "score")
    if not totals:
        return best
    held = asked.select("query_id", "field", "gram").join(x.index.postings.select("field", "gram", "key"), ["field", "gram"])
    counts = held.select("query_id", "key").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return best.join(counts, "query_id")
