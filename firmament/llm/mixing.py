"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) get the weights in turn and
share a total of words; a source stops at ``cap`` times its own size, and the
excess is shared again by weight until none is above.

Within a source a document's expected copies are its source's target over its
size, times its merit (1 unless a column is named), at most ``cap``.  Whole
expected copies are certain.  The rest is its inclusion probability p: rank
documents by the odds of a random number over the odds of p (Pareto sampling),
and take them in that order until the source's words are at the target, so the
sample's size is fixed while its members are random.

A random number is the hash of the document id and a seed, so reruns agree.
The cut of a source is found by histograms of the rank key, refined around the
target; only the rows of the last narrow bin are ever ordered, rows that repeat
as one with their number, so a source with a third of all rows is never sorted
in one task.

Defined results: null text has size 0; an empty or null text takes 0 words;
null sources are one source, ordered last; rows that repeat have equal ranks
and as many of them are taken as fit; empty input gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.llm.store import saved

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096  # of a histogram of rank keys
NARROW = 20_000  # rows of a source that are ordered exactly
ROUNDS = 6  # of refinement; after them equal keys remain at most
PARTS = 256  # of a group of equal rows, to count them off


def ranked_sources(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``weight``: the weights repeat over sources in order, nulls last.

    Ranges of sources are numbered in their own tasks and shifted by the
    ranges before them, so no task needs all sources."""
    parts = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = saved(parts, "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = F.pmod(F.col("before") + F.col("own") - 1, F.lit(len(weights))).cast("int")
    numbered = parts.withColumn("own", own).join(before, "part")
    return numbered.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[place]).drop("part", "own", "before")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): capped shares of ``share`` times all words."""
    rows = saved(ranked_sources(sizes, weights), "weights")
    most = F.col("source_size") * F.lit(cap)
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, full = 0.0, -1
    while True:
        at_cap = most <= F.col("weight") * F.lit(level)
        n, used, open_weight = rows.agg(F.count_if(at_cap), F.sum(F.when(at_cap, most)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        level, full = (total - (used or 0.0)) / open_weight, n
    return rows.select("source", "source_size", F.least(most, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _cuts(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, low, high, before): the least and greatest rank key of the bin
    in which a source's words reach ``rest``, and the words below it; keys of 2
    if they don't reach it."""
    now = rest.select("source", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("bigint").alias("before"))
    for _ in range(ROUNDS):
        now = saved(now, "cuts")
        same = rows["source"].eqNullSafe(now["source"])
        inside = rows.join(now, same).filter(F.col("key").between(F.col("low"), F.col("high")))
        place = F.when(F.col("high") > F.col("low"), F.least(F.lit(BINS - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))).otherwise(0)
        inside = inside.select(now["source"], "rest", "before", place.alias("bin"), "key", "size")
        bins = inside.groupBy("source", "rest", "before", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("start", F.col("before") + upto - F.col("words")).withColumn("end", F.col("before") + upto)
        hit = bins.filter((F.col("start") <= F.col("rest")) & (F.col("end") > F.col("rest")))
        hit = saved(hit.select("source", "rest", "low", "high", F.col("start").alias("before"), "n"), "hits")
        missed = now.join(hit, now["source"].eqNullSafe(hit["source"]), "left_anti").withColumns({"low": F.lit(2.0), "high": F.lit(2.0)})
        now = hit.drop("n").unionByName(missed)
        if not hit.filter((F.col("n") > NARROW) & (F.col("high") > F.col("low"))).limit(1).count():
            break
    return saved(now, "cuts")


def numbered(narrow: DataFrame) -> DataFrame:
    """The rows of the last bins with ``extra``: 1 for those up to the target.

    Rows that repeat are one group, of which some number is taken; a group is
    cut in parts to count that number off, so none is ordered in one task."""
    same = [F.col("source").eqNullSafe(F.col("_g")), F.col("key") == F.col("_k"), F.col("doc_id").eqNullSafe(F.col("_d")), F.col("size") == F.col("_s")]
    narrow = saved(narrow.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "narrow")
    names = [F.col("source").alias("_g"), F.col("key").alias("_k"), F.col("doc_id").alias("_d"), F.col("size").alias("_s")]
    groups = narrow.groupBy(*names, "before", "rest").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("n") * F.col("_s")).over(Window.partitionBy("_g").orderBy("_k", "_d", "_s").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("rest") - F.col("before") - F.coalesce(upto, F.lit(0))
    nearest = F.when(F.col("_s") > 0, F.floor(left / F.col("_s") + 0.5)).when(left >= 0, F.col("n")).otherwise(0)
    groups = saved(groups.withColumn("take", F.least("n", F.greatest(F.lit(0), nearest))).select("_g", "_k", "_d", "_s", "n", "take"), "groups")
    rows = narrow.join(groups, same[0] & same[1] & same[2] & same[3]).drop("_g", "_k", "_d", "_s")

    some = saved(rows.filter((F.col("take") > 0) & (F.col("take") < F.col("n"))), "partly-taken")  # one group a source at most
    counts = some.groupBy(F.col("source").alias("_g"), F.col("part").alias("_p")).agg(F.count("*").alias("in_part"))
    counts = counts.select("_g", "_p", F.coalesce(F.sum("in_part").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy("u"))
    some = some.withColumn("own", own).join(counts, F.col("source").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p"))).drop("_g", "_p")
    some = some.withColumn("extra", (F.col("earlier") + F.col("own") <= F.col("take")).cast("int")).drop("own", "earlier")
    clear = rows.filter((F.col("take") == 0) | (F.col("take") == F.col("n"))).withColumn("extra", (F.col("take") == F.col("n")).cast("int"))
    return clear.unionByName(some).drop("n", "take", "part")


def mix(docs: DataFrame, weights: list[float] | tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", merit_col: str | None = None, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its
    source's), expected (copies), copies, taken (words, repeats counted)."""
    merit = F.greatest(F.coalesce(F.col(merit_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if merit_col else F.lit(1.0)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    # the id's hash and, for ids that repeat or are null, the text's
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), merit.alias("merit"), u.alias("u")), "sizes")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("merit")).alias("merits"))
    goal = targets(sizes.select("source", "source_size"), list(weights), share, cap)
    sizes = sizes.withColumnRenamed("source", "s")
    goal = saved(goal.join(sizes.select("s", "merits"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "g"), "targets")

    expected = F.when(F.col("merits") > 0, F.least(F.lit(cap), F.col("merit") * F.col("target") / F.col("merits"))).otherwise(F.lit(0.0))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumn("expected", expected)
    whole = F.floor("expected")
    rows = rows.withColumn("whole", whole).withColumn("p", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("key", F.when(F.col("p") > 0, odds / (1 + odds)))  # in (0, 1), same order as the odds
    rows = saved(rows, "ranks")

    certain = rows.groupBy("source").agg(F.greatest(F.lit(0.0), F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("rest"))
    ranked = rows.filter(F.col("key").isNotNull()).select("source", "key", "size")
    cuts = _cuts(ranked, certain).withColumnRenamed("source", "g")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    narrow = numbered(rows.filter(F.col("key").between(F.col("low"), F.col("high"))))
    others = rows.filter(F.col("key").isNull() | (F.col("key") < F.col("low")) | (F.col("key") > F.col("high")))
    others = others.withColumn("extra", (F.col("key").isNotNull() & (F.col("key") < F.col("low"))).cast("int"))
    out = others.unionByName(narrow).withColumn("copies", (F.col("whole") + F.col("extra")).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("size") * F.col("copies")).alias("taken"))
