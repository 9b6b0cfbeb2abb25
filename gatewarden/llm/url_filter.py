"""URL filter: rules on hosts and paths, and trust carried along links between hosts, in DataFrame functions only.

A page's verdict is that of the longest rule that fits its url. Where none fits, personalised PageRank decides: trust walks
from the hosts of allowed pages along links, distrust walks from the hosts of blocked pages against them, and a
host is blocked where distrust outweighs trust by a threshold.

Null urls, and urls without ://, have an empty host and path and are allowed. Repeated rows are judged each. Null html has no links.
Columns of the names that the result adds are replaced; others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, REST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, REST, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null; rules are tried from the longest on."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, weight) between different hosts: the number of pages of src with a link to dst, over those of all its links."""
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("""(?i)href\\s*=\\s*["']?((?:https?:)?//[^"'\\s>]+)"""), 1), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))))
    pairs = pages.select(host_of(F.col(url)).alias("src"), target.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, a: str, b: str, damping: float, tolerance: float) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, weight) along a -> b, right to tolerance at each host.

    What newly arrives shrinks by damping a round at least, so what is still to come is at most damping / (1 - damping) times its sum; the walk
    ends once that is within tolerance.

    What arrives is summed before the shuffle; a host with very many links is a skewed key of the join, whose part Spark splits. Hosts
    that no seed reaches have no row. Each round is cut by a checkpoint.
    """
    out = edges.groupBy(a).agg(F.sum("n").alias("total"))
    step = cut(edges.join(out, a).select(F.col(a).alias("from"), F.col(b).alias("host"), (F.col("n") / F.col("total")).alias("share")))
    if step.isEmpty():
        return seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank"))
    base = seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank"))
    rank = new = base
    while True:
        new = cut(step.join(new.withColumnRenamed("host", "from"), "from").groupBy("host").agg(F.sum(damping * F.col("rank") * F.col("share")).alias("rank")))
        left = new.agg(F.sum("rank")).first()[0]
        if left is None:
            break
        rank = cut(rank.unionByName(new).groupBy("host").agg(F.sum("rank").alias("rank")))
        if left * damping / (1 - damping) <= tolerance:
            break
    return rank


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, damping: float = 0.85, tolerance: float = 1e-10, threshold: float = 1e-9, small_rows: int = 20_000) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict.

    Seeds weigh a host by the number of its pages that a rule allows (trust) or blocks (distrust). A seed host whose pages are
    allowed and blocked by turns takes part in both walks. A host without a rule is blocked if distrust - trust > threshold and distrust is not
    merely its own seed: what counts is rank that arrived over links. They are compared in pages, each allowed or blocked page being a seed of weight 1, so that a
    verdict depends on what a host is linked with, not on the size of the corpus; the columns trust and distrust are shares of all seeds.
    """
    pages = pages.drop(*{"host", "path", "rule", "trust", "distrust", "verdict"} - {url, html})
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = judged.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules))
    edges = cut(links(pages, url, html))
    counts = judged.groupBy("host").agg(F.count(F.when(F.col("__rule.verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("__rule.verdict") == "block", 1)).alias("block"))
    counts = cut(counts.where("host <> '' and allow + block > 0"))
    total = counts.agg(F.sum("allow"), F.sum("block")).first()
    ranks = None
    for name, a, b in (("allow", "src", "dst"), ("block", "dst", "src")):
        seeds = counts.where(F.col(name) > 0).select("host", F.col(name).cast("double").alias("weight"))
        rank = walk(edges, seeds, a, b, damping, tolerance)
        arrived = rank.join(seeds, "host", "left").select("host", F.greatest(F.lit(0.0), F.col("rank") - (1 - damping) * F.coalesce("weight", F.lit(0.0))).alias("r"))
        side = arrived.select(F.col("host").alias("__host"), *(F.col("r").alias(c) if c == name else F.lit(0.0).alias(c) for c in ("allow", "block")))
        ranks = side if ranks is None else ranks.unionByName(side)
    ranks = cut(ranks.groupBy("__host").agg(F.sum("allow").alias("trust"), F.sum("block").alias("distrust")).where("trust > 0 or distrust > 0"))
    if ranks.count() <= small_rows:
        ranks = F.broadcast(ranks)
    joined = judged.join(ranks, F.col("host") == F.col("__host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    suspect = distrust - trust > threshold
    return (
        joined.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), F.when(suspect, "block").otherwise("allow"))})
        .withColumns({"trust": trust / F.lit(float(max(total[0] or 0, 1))), "distrust": distrust / F.lit(float(max(total[1] or 0, 1)))})
        .select(*judged.drop("__rule").columns, "trust", "distrust", "rule", "verdict")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """The verdict for each row of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
