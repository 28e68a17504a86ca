"""SimHash near-duplicate groups: pigeonhole blocks, then exact bit distance.

1. A 64-bit fingerprint per text from the XXH64 (seed 42) of its word shingles.
2. The bits are cut into ``blocks`` blocks.  Two fingerprints at most ``d``
   bits apart agree on at least ``blocks - d`` of them, so joining on every
   choice of that many blocks meets every close pair.
3. Only distinct fingerprints are joined: copies never make pairs.  A bucket
   of up to ``SMALL`` fingerprints is a self join; a larger one is split into
   chunks, each pair of chunks is one task-sized piece, and what a piece
   returns is a spanning star of the links in it, not the pairs.
4. Links become components, and a component is named by its smallest id.

Defined results: null or blank text has fingerprint 0 and links like any
other; fewer words than a shingle make one shingle of all words; repeated rows
each get a row; a null id never names a component unless all its ids are null;
empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.components import components, star_edges
from firmament.llm.store import saved, text_key

SEED = 42
CHUNK = 1024  # fingerprints a chunk of a large bucket holds, about
SMALL = 64  # largest bucket that is joined row by row
PIECE = 1 << 18  # bytes of a text whose shingles are counted at once
SPACES = tuple(b"\t\n\v\f\r "[i : i + 1] for i in range(6))


def _bits(words: list[bytes], n_words: int) -> np.ndarray:
    """How many of the words' shingles have each bit set."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    n = len(words) - n_words + 1
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    return np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, np.int64)


def fingerprint(text: str | None, n_words: int = 4) -> int:
    """The signed 64-bit fingerprint of one text, counted a piece at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, n, last, cut = np.zeros(64, np.int64), 0, [], b""
    for start in range(0, len(raw), PIECE):
        # words of this piece; one that the piece's end cuts is left for the next
        piece = cut + raw[start : start + PIECE]
        words = piece.split()
        cut = words.pop() if start + PIECE < len(raw) and words and piece[-1:] not in SPACES else b""
        words = last + words
        if len(words) >= n_words:
            ones += _bits(words, n_words)
            n += len(words) - n_words + 1
            last = words[len(words) - n_words + 1 :]
        else:
            last = words
    if not n:
        if not last:
            return 0
        ones, n = _bits(last, len(last)), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """(doc_id, text_key, fp) per row.  The UDF gets a hundred rows at a time,
    so long texts don't add up in memory."""
    of = F.udf(lambda text: fingerprint(text, n_words), "bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", text_key(F.col("text")).alias("text_key"), of("text").alias("fp"))


def block_masks(max_distance: int, n: int) -> list[int]:
    """A mask for each choice of blocks; blocks enough that a bucket of ``n``
    unrelated fingerprints holds about eight at most."""
    blocks = max_distance + 2
    while comb(blocks, max_distance) < 2000 and n > 8 << (64 * (blocks - max_distance) // blocks):
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(bits, blocks - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_star(fps: np.ndarray, first: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links in one pair of chunks; ``first`` marks the first chunk's rows."""
    left, right = (fps[first], fps[~first]) if not first.all() else (fps, fps)
    if not len(left) or not len(right):
        return left[:0], left[:0]
    near = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= max_distance
    i, j = np.nonzero(near)
    return star_edges(left[i], right[j])


def links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` values within ``max_distance`` bits."""
    fps = fps.select("fp")
    masks = block_masks(max_distance, fps.count())
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("k")).select("k.c", "k.v", "fp")
    sizes = saved(rows.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = saved(rows.join(sizes, ["c", "v"]), "members")

    few = members.filter(F.col("n") <= SMALL).select("c", "v", "fp")
    other = few.withColumnRenamed("fp", "b")
    pairs = few.join(other, ["c", "v"]).filter(F.col("fp") < F.col("b"))
    pairs = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_distance).select(F.col("fp").alias("a"), "b")

    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    many = members.filter(F.col("n") > SMALL).withColumn("chunks", chunks)
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    many = many.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = many.select("c", "v", "fp", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].to_numpy()
        a, b = close_star(rows["fp"].to_numpy(np.int64), own == rows["i"].iat[0], max_distance)
        return pd.DataFrame({"a": a, "b": b})

    return pairs.unionByName(many.groupBy("c", "v", "i", "j").applyInPandas(piece, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fp (signed), component_id
    (smallest doc_id linked, itself included) and ``kept`` (the one text of
    its component that stays: smallest id, then smallest text key)."""
    rows = saved(fingerprints(docs, id_col, text_col, n_words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    per_fp = saved(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = saved(components(links(per_fp, max_distance)), "roots").withColumnRenamed("node", "fp")
    per_fp = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = per_fp.groupBy("root").agg(F.min("first").alias("named"))
    per_fp = saved(per_fp.select("fp", "root").join(named, "root").select("fp", F.col("named.id").alias("component_id"), F.col("named.key").alias("key")), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("key"))
    return rows.join(per_fp, "fp").select("doc_id", "text_key", "fp", "component_id", kept.alias("kept"))


def hex64(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
