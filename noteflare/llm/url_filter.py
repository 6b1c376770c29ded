"""URL filter: rules first, then trust and distrust over the link graph (DataFrame functions only).

A url's longest fitting rule decides.  Urls without one are judged by their host:
trust is a personalised PageRank along links from hosts most of whose pages rules allow,
distrust one against links from hosts most of whose pages rules block (who
links to bad hosts is suspect).  A host is blocked where distrust exceeds trust by more
than a threshold.  Links are aggregated to host edges before anything
iterates; each round is a join on the host and a sum, written to a scratch table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import drop_scratch, scratch_table

# (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 0.0
SEED_SHARE = 0.5  # share of a host's pages that rules allow (block) for it to be a trusted (blocked) seed
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def host(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path(url) -> F.Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> F.Column:
    cut = rule.index("/")
    name, start = rule[:cut], rule[cut:]
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(…, rule, said) appended to rows with host and path: the longest fitting rule, or null.

    Rules are a short list, tried longest first inside the row.
    """
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in reversed(by_length):
        rule = F.when(_fits(text), F.lit(text)).otherwise(rule)
        said = F.when(_fits(text), F.lit(verdict)).otherwise(said)
    return urls.select("*", rule.alias("rule"), said.alias("said"))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight): links between different hosts, weighted by number."""
    links = pages.select(host(F.col(url_col)).alias("src"),
                         F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("link"))
    # A link without a scheme has the page's.
    dst = F.translate(F.regexp_extract("link", r"^[^/]*//([^/?#]*)", 1), UPPER, LOWER)
    return (links.select("src", dst.alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != "")
                                                        & (F.col("dst") != ""))
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank along (src, dst, weight) from (host, mass) seeds."""
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return seeds.select("host", F.col("mass").alias("rank")).where("false")
    start = scratch_table(seeds.select("host", (F.col("mass") / F.lit(total)).alias("start")), "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = scratch_table(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "flow")
    rank = start.select("host", F.col("start").alias("rank"))
    if flow.isEmpty():
        return rank
    for i in range(rounds):
        given = (flow.join(rank, flow.src == rank.host).groupBy(F.col("dst").alias("host"))
                 .agg((F.sum(F.col("share") * F.col("rank")) * damping).alias("given")))
        new = scratch_table(start.join(given, "host", "full").select(
            "host", (F.coalesce("start", F.lit(0.0)) * (1 - damping) + F.coalesce("given", F.lit(0.0))).alias("rank")), "rank")
        if i:
            drop_scratch(rank)
        rank = new
    return rank


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust): one row per input row.

    Null urls and urls without ``://`` have an empty host and path, no rule, and are
    allowed (no host speaks against them).  A host no trust or distrust reaches
    is allowed.  Null html has no links.  Repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty result.
    """
    urls = match_rules(pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"),
                                    path(F.col(url_col)).alias("path")), rules)
    edges = scratch_table(host_edges(pages, url_col, html_col), "host-edges")
    shares = urls.where("host <> ''").groupBy("host").agg(
        F.avg(F.coalesce(F.col("said") == "allow", F.lit(False)).cast("double")).alias("good"),
        F.avg(F.coalesce(F.col("said") == "block", F.lit(False)).cast("double")).alias("bad"))
    shares = scratch_table(shares, "ruled-hosts")
    mass = F.lit(1.0).alias("mass")
    trust = propagate(edges, shares.where(F.col("good") >= SEED_SHARE).select("host", mass))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, shares.where(F.col("bad") >= SEED_SHARE).select("host", mass))
    known = (trust.withColumnRenamed("rank", "trust")
             .join(distrust.withColumnRenamed("rank", "distrust"), "host", "full"))
    judged = urls.join(known, "host", "left").withColumns({
        "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("said", by_host).alias("verdict"), "trust", "distrust")
