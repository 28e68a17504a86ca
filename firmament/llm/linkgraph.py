"""URL filter: rules, then trust and distrust spread over host links.

A url's host and path are looked up in the rules (longest fitting rule wins).
For the other urls, hosts are judged by the link graph of the pages: trust
flows along links by PageRank personalised to hosts with allowed pages, and
distrust flows against links from hosts with blocked pages, each by its share
of such pages.  A host whose distrust is at least ``threshold`` and more than
its trust is blocked, others are allowed.

Edges are distinct host pairs, counted before the shuffle; ranks are written
to the shared folder every round, so lost executors cost one round at most.

Defined results: a null url or one without ``://`` has an empty host and path
and is allowed; null html has no links; repeated rows get equal rows; links
to a page's own host carry nothing; hosts that no seed reaches are allowed;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import saved

LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s"'<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z
    lower-cased; then up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts; a host's weights sum to 1."""
    link = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    linked = pages.select(F.col("host").alias("src"), F.explode(link).alias("to"))
    dst = F.translate(F.regexp_extract("to", r"^([^/?#]*)", 1), UPPER, LOWER)
    counts = linked.select("src", dst.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    counts = saved(counts, "links")
    total = saved(counts.groupBy("src").agg(F.sum("n").alias("total")), "out")
    return saved(counts.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight")), "edges")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Every host hands its distrust to the hosts that link to it, in equal parts."""
    total = saved(edges.groupBy("dst").agg(F.count("*").alias("total")), "in")
    return saved(edges.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.col("total")).alias("weight")), "reversed")


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, seed), in
    units in which a host that no link reaches has its own seed:
    rank = seed + damping * what flows in.

    A round shrinks the distance to the limit by ``damping`` at least, so what
    a round changes bounds what is missing: rounds go on until that is under
    ``tolerance`` times all seeds."""
    start = seeds.select("host", F.col("seed").alias("rank"))
    ranks, total = saved(start, "ranks"), seeds.agg(F.sum("seed")).first()[0] or 0.0
    enough = tolerance * total * (1 - damping) / damping
    most = 10 + 2 * math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))
    for _ in range(most if total else 0):
        flow = edges.join(ranks, edges["src"] == ranks["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("weight") * damping).alias("rank"))
        new = saved(flow.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
        old = ranks.select("host", F.col("rank").alias("old"))
        change = new.join(old, "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        ranks = new
        if change <= enough:
            return ranks
    if total:
        raise ArithmeticError(f"ranks still change by {change} after {most} rounds; {enough} is asked for")
    return ranks


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-6, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A host's seeds are the shares of its pages that a rule allows and blocks.
    Other pages of a host are blocked if its distrust is more than its trust
    and at least ``threshold``: that of a host with such a share of blocked
    pages and no links."""
    host, path = split_url(F.col(url_col))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    edges = host_edges(rows)
    rows = saved(rows.drop("html").withColumn("rule", rule).withColumn("ruled", verdict), "pages")

    named = rows.filter("host <> ''")
    tallies = saved(named.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")), "hosts")

    def seeds(kind: str) -> DataFrame:
        return tallies.filter(F.col(kind) > 0).select("host", (F.col(kind) / F.col("pages")).alias("seed"))

    trust = spread(edges, seeds("allow"), damping, tolerance).withColumnRenamed("rank", "trust")
    distrust = spread(reversed_edges(edges), seeds("block"), damping, tolerance).withColumnRenamed("rank", "distrust")
    scores = tallies.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = saved(scores, "scores")
    out = rows.join(scores, "host", "left")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold)
    judged = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(bad, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
