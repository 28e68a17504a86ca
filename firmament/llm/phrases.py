"""Phrases that recur, and how strongly their words hold together.

Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line
ends, and those into words at spaces and tabs.  Everything is per language;
phrases are counted within pieces, overlaps included.

1. Tasks turn their texts into shards: word ids of one language, pieces parted
   by 0, with the shard's own dictionary and word counts.  Word counts are
   summed; words under ``min_count`` can be in no frequent phrase.
2. In every shard, a bidirectional FM-index of the runs of frequent words
   enumerates its phrases: each interval is extended to the left by every word
   before it, the interval in the index of the reversed text along with it, up
   to ``depth`` words or a break.  So every place ends one longest phrase.
   Those are handed over, each once a shard, with its count there and with the
   one word after it, if that is always the same.
3. The longest phrases of all shards are dealt out in ranges, ordered by their
   last word, the one before it, and so on; the bounds are those of a sample
   (``PER_RANGE`` places a range, evenly over the shards), and only balance the
   ranges.  There all longest phrases that end with a given shorter one stand
   together: one pass over a sorted range counts the phrases of 2 to ``depth``
   words.  A range keeps those found ``min_count`` times and the first and last
   of each length, which may go on in the next range; these are added up.
4. A phrase always preceded (or followed) by one word in all shards is as
   frequent as the longer phrase with that word, and dropped.  What remains is
   scored at its weakest cut.

What is handed over is at most one phrase per place of the text, however many are
frequent: nothing is sent for a shorter phrase, and none is sent twice.  A shard's
phrases go to a range as one packed row.  A shard has ``shard_words`` words and at
most one piece more, a task reads its shards one by one, and a range has about
``RANGE_ROWS`` phrases.  What is repeated is sent once a shard, so no text, word
or phrase is hot.  Frequent words go to the
shards by broadcast up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES``
bytes, beyond by a join and a shuffle of shards.

Scores are exact: products are DECIMAL(38), enough for counts up to 10^12.

Defined results: null texts are empty; a null language is ``und``; repeated
rows count as often as they occur; texts of any length are read whole; an
empty table or none frequent gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmament.llm.store import saved, small
from firmament.operators.util import top_k_per_group

PIECE = 1 << 20  # bytes of a text that are split into words at once
PAIR = 1 << 31  # word ids are below
RANGE_ROWS = 1_000_000  # longest phrases that are sorted at once, about
PER_RANGE = 100  # places sampled for a range's bounds
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20  # of the words among them
ENDS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
ZSTD = pa.Codec("zstd", 3)
ONE_ROW = {"spark.sql.parquet.columnarReaderBatchSize": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


class Words(dict):
    """Ids by word, from 1 in order of first use; "" is -1 and a break is 0."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def _cuts(data: bytes, mark: bytes) -> Iterator[bytes]:
    """``data`` in parts of about ``PIECE`` bytes that end at a ``mark``."""
    at = 0
    while at < len(data):
        end = data.find(mark, at + PIECE) + 1 or len(data)
        yield data[at:end]
        at = end


def parts(text: str) -> Iterator[bytes]:
    """A whole text, cleaned, in parts that end at a break or at its end."""
    return _cuts(text.encode().lower().translate(CLEAN), b"\n")


def word_ids(part: bytes, words: Words) -> np.ndarray:
    """Ids of the words of a part, breaks as 0."""
    split = (piece.replace(b"\n", b" \n ").split(b" ") for piece in _cuts(part, b" "))
    ids = np.concatenate([np.fromiter(map(words.__getitem__, found), np.int32, len(found)) for found in split])
    return ids[ids >= 0]


def make_shards(docs: DataFrame, lang_col: str, text_col: str, shard_words: int) -> DataFrame:
    """(shard, lang, n, words, counts, ids): a row per shard with its number of
    words, its dictionary (local ids from 1 in that order), each word's count,
    and its ids (int32, breaks 0)."""
    names = ["shard", "lang", "n", "words", "counts", "ids"]

    def row(shard: int, lang: str, words: Words, ids: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(ids)
        ids = ids[(ids > 0) | (np.append(0, ids[:-1]) > 0)]  # no break follows a break
        counts = np.bincount(ids, minlength=len(words) - 1)[1:]
        known = [w.decode() for w in list(words)[2:]]
        columns = [pa.array([shard]), pa.array([lang], pa.string()), pa.array([int(counts.sum())]), pa.array([known], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([ids.astype("<i4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Words, list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        first, made, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts(text.as_py()):
                    if lang not in open_:
                        open_[lang], size[lang] = (Words(), []), 0
                    words, ids = open_[lang]
                    found = word_ids(part, words)
                    ids += [found, np.zeros(1, np.int32)]
                    size[lang] += len(found)
                    held += len(found)
                    full = [lang] if size[lang] >= shard_words else list(open_) if held >= 2 * shard_words else []
                    for x in full:
                        yield row(first + made, x, *open_.pop(x))
                        made, held = made + 1, held - size.pop(x)
        for lang, kept in open_.items():
            yield row(first + made, lang, *kept)
            made += 1

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(deal, "shard bigint, lang string, n bigint, words array<string>, counts array<bigint>, ids binary")


# ---------------------------------------------------------------- index


def sorted_bwt(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each place of ``text`` (a ring), places ordered by the
    ``depth`` symbols from there or more."""
    rank, width = text, 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width) if width < depth else rank
        order = np.argsort(key)
        if width * 2 >= depth:
            return text[order - 1]
        ordered = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        width *= 2


class Index:
    """FM-index of ``text`` (symbols 0 to ``n_symbols`` - 1), right for patterns
    up to ``depth`` symbols.  An interval [lo, hi) of its places stands for a
    pattern; ``first`` has that of every symbol."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        self.n = len(text)
        self.bwt = sorted_bwt(text, depth)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        self.occurrences = np.sort(self.bwt * self.n + np.arange(self.n))

    def before(self, symbol: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Where the interval of ``symbol`` + pattern begins, for patterns that begin at ``lo``:
        places of smaller symbols, and the symbol's own occurrences above ``lo``."""
        return np.searchsorted(self.occurrences, symbol * self.n + lo)

    def only(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The one symbol before all places of each interval; 0 if they differ."""
        ends, padded = np.stack([lo, hi], 1).ravel(), np.append(self.bwt, 0)
        least, most = np.minimum.reduceat(padded, ends)[::2], np.maximum.reduceat(padded, ends)[::2]
        return np.where(least == most, least, 0)


def extended(index: Index, n_symbols: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(interval, symbol, count, count of smaller symbols) for every symbol
    that stands before places of each interval, breaks (0) included."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    key, count = np.unique(owner * n_symbols + index.bwt[place], return_counts=True)
    owner, symbol = key // n_symbols, key % n_symbols
    smaller = np.cumsum(count) - count
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    return owner, symbol, count, smaller - np.repeat(smaller[first], np.diff(np.append(first, len(owner))))


def intervals(forward: Index, backward: Index, n_symbols: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases, lo, rlo, counts, counts after a break) for all phrases of 1, 2,
    ... ``depth`` symbols between breaks, ordered by the last symbol, then the
    one before it, and so on: [lo, lo + count) of ``forward`` and [rlo, rlo +
    count) of ``backward``, where those after a break come first."""
    grams = np.arange(1, n_symbols, dtype=np.int32)[:, None]
    lo, rlo = forward.first[1:n_symbols], backward.first[1:n_symbols]
    count = forward.first[2:] - lo
    for length in range(1, depth + 1):
        if not len(grams):
            return
        owner, symbol, size, smaller = extended(forward, n_symbols, lo, lo + count)
        begun, real = symbol == 0, symbol > 0
        after_break = np.zeros(len(grams), np.int64)
        after_break[owner[begun]] = size[begun]
        yield grams, lo, rlo, count, after_break
        if length < depth:
            owner, symbol, count = owner[real], symbol[real], size[real]
            grams = np.hstack([symbol[:, None].astype(np.int32), grams[owner]])
            lo, rlo = forward.before(symbol, lo[owner]), rlo[owner] + smaller[real]


def enumerate_phrases(text: np.ndarray, n_symbols: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases, counts, only symbol before, only symbol after) for the phrases
    of 2, 3, ... ``depth`` symbols between breaks; the symbols before and after
    are told for phrases under ``depth`` symbols."""
    forward, backward = Index(text, n_symbols, depth), Index(text[::-1].copy(), n_symbols, depth)
    for grams, lo, rlo, count, _ in intervals(forward, backward, n_symbols, depth):
        if 2 <= grams.shape[1] < depth:
            yield grams, count, forward.only(lo, lo + count), backward.only(rlo, rlo + count)
        elif grams.shape[1] == depth:
            none = np.zeros(len(count), np.int64)
            yield grams, count, none, none


def longest_phrases(text: np.ndarray, n_symbols: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases, counts, only symbol after): the longest phrase, up to ``depth``
    symbols, that ends at each place, if it has two or more."""
    forward, backward = Index(text, n_symbols, depth), Index(text[::-1].copy(), n_symbols, depth)
    for grams, _, rlo, count, after_break in intervals(forward, backward, n_symbols, depth):
        if grams.shape[1] > 1:
            count = count if grams.shape[1] == depth else after_break
            here = np.flatnonzero(count)
            yield grams[here], count[here], backward.only(rlo[here], (rlo + count)[here])


def with_breaks(ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Symbols (``live``: of each local id; 0 none) in runs of two and more,
    parted by single breaks."""
    text = live[ids]
    word = text > 0
    kept = word & (np.append(False, word[:-1]) | np.append(word[1:], False))
    ends = kept & ~np.append(kept[1:], False)
    out = np.zeros(1 + kept.sum() + ends.sum(), text.dtype)
    out[1 + np.arange(kept.sum()) + np.cumsum(ends[kept]) - ends[kept]] = text[kept]
    return out


def in_number_order(local: np.ndarray, number: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, global ids by symbol): ``ids`` with the frequent words ``local`` as
    symbols in the order of their global ids ``number``, and breaks."""
    live = np.zeros(max(int(ids.max(initial=0)), int(local.max(initial=0))) + 1, np.int64)
    order = np.argsort(number)
    live[local[order]] = np.arange(1, len(local) + 1)
    return with_breaks(ids, live), np.append(0, number[order])


def keys(words: list[np.ndarray]) -> list[np.ndarray]:
    """Columns packed two to a number, which keeps their order."""
    words = [x.astype(np.int64) for x in words] + [np.zeros(len(words[0]), np.int64)] * (len(words) % 2)
    return [a * PAIR + b for a, b in zip(words[::2], words[1::2])]


def sampled_keys(ids: bytes, local: np.ndarray, number: np.ndarray, depth: int, places: int) -> dict[str, np.ndarray]:
    """``keys`` (k1, k2, ...) of the longest phrases that end at up to ``places``
    places of a shard, evenly spread: last word, the one before it, and so on."""
    text, number = in_number_order(local, number, np.frombuffer(ids, "<i4"))
    ends = np.flatnonzero((text[1:] > 0) & (text[:-1] > 0)) + 1
    at = ends[np.linspace(0, len(ends) - 1, min(places, len(ends))).astype(np.int64)]
    words, inside = [], np.ones(len(at), bool)
    for back in range(depth):
        symbol = text[np.maximum(at - back, 0)]
        inside &= symbol > 0
        words.append(np.where(inside, number[symbol], 0))
    return {f"k{i}": k for i, k in enumerate(keys(words), 1)}


def first_not_below(rows: list[np.ndarray], bound: tuple[int, ...]) -> int:
    """Where ``bound`` stands in sorted ``rows`` (columns of numbers)."""
    lo, hi = 0, len(rows[0])
    for column, x in zip(rows, bound):
        lo, hi = (lo + int(np.searchsorted(column[lo:hi], x, side)) for side in ("left", "right"))
    return lo


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns (int32) as one block of bytes, the same byte of all numbers together."""
    planes = np.stack(columns).astype("<i4").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(block: bytes, n_columns: int, n_rows: int) -> np.ndarray:
    planes = np.frombuffer(ZSTD.decompress(block, 4 * n_columns * n_rows, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(n_columns, 4, n_rows).transpose(0, 2, 1)).view("<i4")[..., 0]


def longest_blocks(ids: bytes, local: np.ndarray, number: np.ndarray, depth: int, bounds: list[tuple[int, ...]]) -> dict[str, list]:
    """A shard's longest phrases by range (``part``; from one of ``bounds`` to
    the next), packed: last word, the one before it, ... (0: none), the word
    after it, count.  ``local``: its frequent words, with the global ids ``number``."""
    text, number = in_number_order(local, number, np.frombuffer(ids, "<i4"))
    blocks = [[] for _ in range(len(bounds) + 1)]
    for grams, count, after in longest_phrases(text, len(number), depth) if len(text) > 2 else ():
        words = [number[c] for c in grams.T[::-1]] + [np.zeros(len(count), np.int64)] * (depth - grams.shape[1])
        rows = keys(words)  # sorted, as the phrases are
        cuts = [0, *(first_not_below(rows, b) for b in bounds), len(count)]
        columns = [x.astype(np.int32) for x in (*words, number[after], count)]  # once: the parts are views of these
        for block, begin, end in zip(blocks, cuts, cuts[1:]):
            if begin < end:
                block.append([x[begin:end] for x in columns])
    filled = [(part, sum(len(x[0]) for x in block), pack([np.concatenate(x) for x in zip(*block)])) for part, block in enumerate(blocks) if block]
    return dict(zip(("part", "n", "block"), map(list, zip(*filled)))) if filled else {"part": [], "n": [], "block": []}


def counted(words: list[np.ndarray], after: np.ndarray, n: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """(w1, w2, ..., count, left, right) for the phrases of 2 and more words in a
    range of longest phrases (``words``: the last one, the one before it, ...; 0:
    none; ``after``: the word after it): those found ``least`` times, and the
    first and last of each length, which may go on outside.  ``left`` and
    ``right`` (not at most words): the one word before and after, 0 if it differs."""
    depth = len(words)
    order = np.lexsort(keys(words)[::-1])
    words, after, n = [x[order] for x in words], after[order], n[order]
    new = np.append(True, words[0][1:] != words[0][:-1])
    for m in range(2, depth + 1):
        new[1:] |= words[m - 1][1:] != words[m - 1][:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(n))
        count = np.add.reduceat(n, begin)
        kept = count >= least
        kept[[0, -1]] = True
        inside = np.repeat(kept, end - begin)
        phrase = np.flatnonzero(kept & (words[m - 1][begin] > 0))
        out = np.zeros((len(phrase), depth + 3), np.int64)
        out[:, :m] = np.stack([words[i][begin[phrase]] for i in reversed(range(m))], 1)
        out[:, depth] = count[phrase]
        if m < depth:
            before = words[m][begin]
            out[:, depth + 1] = np.where(before == words[m][end - 1], before, 0)[phrase]
            least_after, most_after = np.minimum.reduceat(after, begin), np.maximum.reduceat(after, begin)
            out[:, depth + 2] = np.where(least_after == most_after, least_after, 0)[phrase]
        yield out
        words, after, n, new = [x[inside] for x in words], after[inside], n[inside], new[inside]


# ---------------------------------------------------------------- shards and what is frequent, paired up


def known_to_tasks(words: DataFrame) -> dict | None:
    """Words (lang, word, word_id) for broadcast, if they have at most
    ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    return {c: x.combine_chunks() for c, x in zip(words.columns, words.toArrow().columns)} if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else None


def own_words(words: dict, lang: str, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(local ids, global ids) of a dictionary's frequent words; what is looked
    up and copied is the shard's, however many words are frequent."""
    at = pc.fill_null(pc.index_in(words["word"], value_set=dictionary), -1).to_numpy()
    found = (at >= 0) & pc.equal(words["lang"], lang).to_numpy(zero_copy_only=False)
    return at[found].astype(np.int64) + 1, words["word_id"].to_numpy()[found]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` for what runs inside, then the session's own again."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def from_broadcast(shards: DataFrame, words, found: Callable[..., dict], schema: str) -> DataFrame:
    """``found(ids, local, number)`` of every shard; ``words``: a broadcast table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lang, ids = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                rows = found(ids, *own_words(words.value, lang, batch.column(1)[i].values))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "block" else pa.int64()) for c, x in rows.items()], names=list(rows))

    return shards.select("lang", "words", "ids").mapInArrow(each, schema)


def own_in_shards(shards: DataFrame, words: DataFrame) -> DataFrame:
    """Each shard's frequent words (shard, local, word_id)."""
    own = shards.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
    return saved(own.select("shard", (F.col("at") + 1).cast("bigint").alias("local"), "word_id"), "live")


def from_join(shards: DataFrame, live: DataFrame, found: Callable[..., dict], schema: str) -> DataFrame:
    """The same with each shard's frequent words sent to it."""

    def each(shard: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(shard):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64" if c.endswith("bigint") else object) for c in schema.split(", ")})
        return pd.DataFrame(found(shard["ids"].iat[0], own["local"].to_numpy(np.int64), own["word_id"].to_numpy(np.int64)))

    return shards.select("shard", "ids").groupBy("shard").cogroup(live.groupBy("shard")).applyInPandas(each, schema)


def range_bounds(sample: DataFrame, ranges: int) -> list[tuple[int, ...]]:
    """Bounds of about ``ranges`` ranges of equal size in a sample of some
    ``PER_RANGE`` rows for each."""
    if ranges == 1:
        return []
    rows = sample.orderBy(*sample.columns).toArrow()
    at = np.arange(1, ranges) * len(rows) // ranges
    return sorted(set(zip(*(c.to_numpy()[at].tolist() for c in rows.columns)))) if len(rows) else []


def from_ranges(blocks: DataFrame, ranges: int, depth: int, min_count: int) -> DataFrame:
    """(w1, w2, ..., f, left, right): the frequent phrases; missing words are 0."""
    names = [f"w{i}" for i in range(1, depth + 1)]
    columns = [*names, "n", "left", "right"]

    def each(part: pa.Table) -> pa.Table:
        packed = zip(part["block"], part["n"].to_pylist())
        *words, after, n = np.concatenate([unpack(block.as_py(), depth + 2, size) for block, size in packed], axis=1)
        found = np.vstack(list(counted(words, after, n.astype(np.int64), min_count)))
        return pa.table([pa.array(c) for c in found.T], names=columns)

    found = blocks.repartition(ranges, "part").groupBy("part").applyInArrow(each, ", ".join(f"{c} bigint" for c in columns))
    one_word = [F.when(F.min(side) == F.max(side), F.min(side)).otherwise(0).alias(side) for side in ("left", "right")]
    return found.groupBy(*names).agg(F.sum("n").alias("f"), *one_word).filter(F.col("f") >= min_count)


# ---------------------------------------------------------------- phrases


def with_ids(words: DataFrame) -> DataFrame:
    """``words`` with ``word_id``, from 1 without gaps, a language's frequent words
    first (small numbers pack better): a place in its task's rows and the number of rows of the tasks before (one row a task is added up)."""
    placed = saved(words.orderBy("lang", F.desc("f")).withColumn("at", F.monotonically_increasing_id()), "placed")
    task, place = F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy(task).agg(F.count("*").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("task", task).join(F.broadcast(tasks), "task").withColumn("word_id", F.col("start") + place + 1)
    return numbered.withColumn("word_id", F.when(F.col("word_id") < PAIR, F.col("word_id")).otherwise(F.raise_error(F.lit("too many frequent words")).cast("bigint"))).drop("task", "at", "start")


def frequent(docs: DataFrame, depth: int, min_count: int, lang_col: str, text_col: str, shard_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (word_id, lang, word, f), phrases (gram: word ids, f, held: whether
    a longer phrase up to ``depth`` is as frequent) and totals (lang, n)."""
    shards = saved(make_shards(docs, lang_col, text_col, shard_words), "shards", compression="zstd")
    totals = saved(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    words = saved(with_ids(words), "words")

    listed = words.select("lang", "word", "word_id")
    known = known_to_tasks(listed)
    sent = docs.sparkSession.sparkContext.broadcast(known) if known else None
    live = None if known else own_in_shards(shards, listed)

    def from_shards(found: Callable[..., dict], schema: str) -> DataFrame:
        return from_broadcast(shards, sent, found, schema) if sent else from_join(shards, live, found, schema)

    n_shards, places = shards.count(), words.agg(F.sum("f")).first()[0] or 0
    ranges = max(1, -(-places // RANGE_ROWS))
    each = -(-PER_RANGE * ranges // max(1, n_shards))
    # a shard is a row of some megabytes: a task holds one at a time, not all of its split
    with settings(docs.sparkSession, ONE_ROW if known else {}):
        sample = from_shards(lambda *shard: sampled_keys(*shard, depth, each), ", ".join(f"k{i} bigint" for i in range(1, (depth + 3) // 2)))
        bounds = range_bounds(saved(sample, "grams-sample"), ranges)
        blocks = from_shards(lambda *shard: longest_blocks(*shard, depth, bounds), "part bigint, n bigint, block binary")
        grams = saved(from_ranges(blocks, ranges, depth, min_count), "grams-frequent")
    gram = F.filter(F.array(*[f"w{i}" for i in range(1, depth + 1)]), lambda w: w > 0)
    return words, grams.select(gram.alias("gram"), "f", ((F.col("left") > 0) | (F.col("right") > 0)).alias("held")), totals


def exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def phrases(docs: DataFrame, depth: int = 5, min_count: int = 100, lang_col: str = "lang", text_col: str = "text", shard_words: int = 1_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase of 2 to
    ``depth`` words found ``min_count`` times or more, but those held in a
    longer one that is as frequent.  score = floor(1000 a n / (l r)) at the cut
    with the lowest score (the first such), l and r the counts of its parts."""
    words, grams, totals = frequent(docs, depth, min_count, lang_col, text_col, shard_words)
    counts = saved(grams.select("gram", "f").unionByName(words.select(F.array("word_id").alias("gram"), "f")), "counts")
    cut = grams.filter(~F.col("held")).select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("gram", F.lit(1), F.col("k")), "tail": F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k"))})
    cut = cut.join(counts.select(F.col("gram").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("gram").alias("tail"), F.col("f").alias("r")), "tail")

    lang = words.select(F.col("word_id").alias("first"), "lang").join(small(totals, BROADCAST_ROWS), "lang")
    cut = cut.withColumn("first", F.col("gram")[0]).join(lang, "first")
    cut = cut.withColumn("over", exact(F.col("a")) * exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn("under", exact(F.col("l")) * exact(F.col("r")))
    weakest = cut.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    weakest = saved(weakest, "weakest")

    named = weakest.select("gram", F.posexplode("gram").alias("at", "word_id")).join(words.select("word_id", "word"), "word_id")
    named = named.groupBy("gram").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    return weakest.join(named, "gram").select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "cut.l", "cut.r", "n", "cut.score")


def top_phrases(docs: DataFrame, keep: int = 2000, **options) -> DataFrame:
    """Each language's ``keep`` best: lang, rank, phrase, a, l, r, n, score, by
    falling score, falling count, then phrase (byte order)."""
    found = saved(phrases(docs, **options), "phrases")
    best = top_k_per_group(found, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], keep)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p),
g AS (SELECT lang, m, ws[i:i+m-1] AS g FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
held AS (SELECT lang, m - 1 AS m, g[1:m-1] AS g, f FROM f WHERE m > 2 UNION ALL SELECT lang, m - 1, g[2:m], f FROM f WHERE m > 2),
c AS (SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = f.lang AND h.m = f.m AND h.g = f.g AND h.f = f.f)),
k AS (SELECT c.lang, c.g, c.f AS a, n.n, unnest(generate_series(1, c.m - 1)) AS k, c.m FROM c JOIN n USING (lang)),
s AS (SELECT k.lang, k.g, k.a, k.n, k.k, x.f AS l, y.f AS r, (1000::HUGEINT * k.a * k.n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.g = k.g[k.k+1:k.m]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s),
t AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE o = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t) WHERE rank <= 2000
"""
