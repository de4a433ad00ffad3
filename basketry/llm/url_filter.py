"""URL verdicts from rules and, beyond them, from trust and distrust spread over the host link graph.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.storage import written

LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"
BASE = "(?i)<base\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"
#: Steps of the walk in one job, and parts that a host's links are dealt to.
HOPS, SALTS = 4, 16

#: (verdict, host, path)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict, or nulls. A rule holds for its host and all subdomains and for all paths it begins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(begin)
        name, verdict = F.when(fits, F.lit(own + begin)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links of ``pages (host, html)`` to other hosts.

    A link without host goes to that of the page's ``<base href>``, if it names one,
    or stays on its host and is no edge; links of other schemes are none either.
    """
    link, base = F.col("link"), F.regexp_extract("html", BASE, 1)
    absolute = "(?i)^([a-z][a-z0-9+.-]*:)?//"

    def host_of(address: Column) -> Column:
        return url_host(F.when(address.startswith("//"), F.concat(F.lit("http:"), address)).otherwise(address))

    found = pages.where("host <> '' and html is not null")
    found = found.select(F.col("host").alias("src"), F.when(base.rlike(absolute), host_of(base)).alias("base"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    dst = F.when(link.rlike(absolute), host_of(link)).when(~link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.col("base"))
    return found.select("src", dst.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, name: str, damping: float, tolerance: float) -> DataFrame:
    """``(host, <name>)``: PageRank over ``edges (src, dst, n)`` that restarts at ``seeds (host, weight)``; ranks sum to 1.

    A host without links gives its rank back to the seeds. That only scales all
    ranks alike, so the walk without it is summed up and scaled at the end. The
    walk goes on, ``HOPS`` steps at a time, until those add less than ``tolerance``.
    The links of a host are dealt to ``SALTS`` parts, so a hub is no single key.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = written(seeds.select("host", (F.col("weight") / F.lit(total) * (1 - damping)).alias("restart")), f"{name}-seeds")
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")
    dealt = edges.withColumn("salt", salt)
    out = dealt.groupBy("src", "salt").agg(F.sum("n").alias("part"))
    out = out.select("src", "salt").join(out.groupBy("src").agg(F.sum("part").alias("out")), "src")
    steps = written(dealt.join(out, ["src", "salt"]).select("src", "salt", "dst", (F.col("n") / F.col("out") * damping).alias("p")), f"{name}-steps")
    rank, mass = start.select("host", F.col("restart").alias("r")), 0.0
    while not steps.isEmpty():
        for _ in range(HOPS):
            spread = rank.select("host", "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            flow = steps.join(spread, (steps.src == spread.host) & (steps.salt == spread.salt)).groupBy("dst").agg(F.sum(F.col("p") * F.col("r")).alias("in"))
            both = start.join(flow, start.host == flow.dst, "full")
            rank = both.select(F.coalesce("host", "dst").alias("host"), (F.coalesce("restart", F.lit(0.0)) + F.coalesce("in", F.lit(0.0))).alias("r"))
        rank = written(rank, f"{name}-rank")
        before, mass = mass, rank.agg(F.sum("r")).first()[0] or 0.0
        if mass - before < tolerance:
            break
    whole = rank.agg(F.sum("r")).first()[0] or 1.0
    return rank.select("host", (F.floor(F.col("r") / F.lit(whole) * 1e9 + 0.5) / 1e9).alias(name))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-3, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages (page_id, url, html, ...)``: ``page_id, host, path, rule, verdict, trust, distrust``.

    The longest fitting rule decides. Other pages follow their host: trust starts
    at the hosts of allowed pages (by their number) and runs along links; distrust
    starts at those of blocked pages and runs against them, to the hosts that link
    there. A host is blocked if distrust is over ``threshold`` of both together,
    and allowed if it has neither. A null url, or one without ``://``, has the
    empty host and path and no rank, so it is allowed. Null and empty html has no
    links; html of any length is read whole. Rows that repeat count as pages of
    their own; an empty table gives an empty result; other columns are not read.
    """
    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    name, verdict = rule_match(F.col("host"), F.col("path"), rules)
    judged = own.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    edges = written(host_edges(own), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")

    def seeds(what: str) -> DataFrame:
        return judged.where(F.col("ruled") == what).groupBy("host").agg(F.count("*").cast("double").alias("weight"))

    trust = personalised_rank(edges, seeds("allow"), "trust", damping, tolerance)
    distrust = personalised_rank(back, seeds("block"), "distrust", damping, tolerance)
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    hosts = written(trust.join(distrust, "host", "full").na.fill(0.0), "host-ranks").withColumn("said", F.when(blocked, "block").otherwise("allow"))
    found = judged.join(hosts, "host", "left")
    verdict = F.coalesce("ruled", "said", F.lit("allow")).alias("verdict")
    return found.select("page_id", "host", "path", "rule", verdict, F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
