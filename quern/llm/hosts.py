"""URL filters: rules first, then trust and distrust propagated over the graph of hosts.

Links between hosts are read from the pages.  Personalised PageRank spreads
trust from hosts that the rules mostly allow along the links; distrust spreads
from hosts that they mostly block against the links, to whoever links to them.
A host without a rule of its own is blocked where distrust outweighs trust.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, meet, unfold, with_row

LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (a host, then a path that starts with /) that fits, and its verdict; of equally long ones block wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        top, _, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """kind, host, rank after `rounds` steps of personalised PageRank on edges (kind, src, dst, share) from seeds (kind, host, mass).

    share: what part of src's rank goes along the edge.  Every second round is
    written to the shared folder, so a plan never holds more than two.
    """
    ranks = seeds.withColumnRenamed("mass", "rank")
    for k in range(rounds):
        sent = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
        sent = sent.groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        both = sent.join(seeds, ["kind", "host"], "full")
        ranks = both.select("kind", "host", (F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.coalesce("mass", F.lit(0.0))).alias("rank"))
        if k % 2 or k == rounds - 1:
            ranks = scratch.put(ranks, f"ranks-{k}")
    return ranks


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """The input's columns with host, path, rule, verdict (allow or block), trust and distrust.

    rules: (allow or block, "host/path") pairs, a short list.  A rule fits its
    host and all subdomains where the path starts with the rule's; the longest
    wins, of equally long ones block.  A host of which more than half of the pages are allowed (blocked) by
    rules is a seed of trust (distrust).  Elsewhere a page is blocked if its
    host's distrust is above its trust.  Null urls have an empty host and path,
    null html has no links; repeated pages count as often as they stand; an
    empty table gives an empty table.  Columns of the new names are replaced.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "hosts")
    rows = with_row(pages, __url=url_col, __html=html_col)
    rows = rows.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    name, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumns({"__rule": name, "__said": verdict})
    counted = rows.groupBy("__host").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("__said") == s, 1)).alias(s) for s in ("allow", "block")])
    counted = scratch.put(counted, "counts")
    hosts = counted.where("__host <> ''")
    seeds = [hosts.where(F.col(s) * 2 > F.col("n")).select(F.lit(k).alias("kind"), F.col("__host").alias("host"), F.col(s).cast("double").alias("mass")) for k, s in (("trust", "allow"), ("distrust", "block"))]
    seeds = scratch.put(reduce(DataFrame.unionByName, seeds), "seeds")
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    seeds = seeds.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass"))
    ends = rows.where(F.col("__host") != "").select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all("__html", F.lit(LINK), 1)).alias("dst"))
    ends = ends.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst")
    links = scratch.put(ends.groupBy("src", "dst").agg(F.count("*").alias("w")), "links")
    if links.isEmpty():
        ranks = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    else:
        ways = [links.select(F.lit("trust").alias("kind"), "src", "dst", "w"), links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")]
        edges = reduce(DataFrame.unionByName, ways)
        out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
        edges = scratch.put(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("share")), "edges")
        ranks = propagate(edges, seeds, scratch, rounds, damping)
    score = ranks.groupBy(F.col("host").alias("h")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    score = counted.select("__host", "n").join(score, F.col("__host") == F.col("h"), "left").drop("h")
    met = meet(rows.drop("__html"), scratch.put(score, "score"), ["__host"], "n")
    trust, distrust = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("trust", "distrust"))
    said = F.coalesce("__said", F.when(distrust > trust, "block").otherwise("allow"))
    return unfold(met, pages.columns, host=F.col("__host"), path=F.col("__path"), rule=F.col("__rule"), verdict=said, trust=trust, distrust=distrust)
