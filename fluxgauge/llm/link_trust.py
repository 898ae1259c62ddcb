"""URL filters: rules for hosts and paths, and trust that spreads over the links between hosts.

Hosts without a rule are judged by two personalised PageRanks over host edges: trust flows from
hosts that rules allow along links, distrust from hosts that rules block against the links, to
those that link to them, until the ranks settle. All of it is DataFrame work; only totals, and one
number every few rounds, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.tables import Stages

#: (verdict, host, path prefix). A rule fits its host and all subdomains.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING = 0.85
#: Rounds between two looks at how far the ranks have settled.
ROUNDS = 8
#: Ranks have settled once no host's rank changes by more than this share of itself within ROUNDS.
TOLERANCE = 1e-6
#: Ranks below this have few digits left; whether they are there still counts, their change does not.
TINY = 1e-300
#: A host is blocked if this share of what reached it is distrust.
SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\x22']?([^\x22'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits ``host`` and ``path``, else null."""
    text = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1], r[2]))
    for kind, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, w)`` between different hosts: links of ``pages(host, html)``, counted, and
    subdomain to parent where both are hosts of the table, in both directions.

    Links are summed per page row before any shuffle; relative links stay on their own host.
    """
    target = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), target.alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = links.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    hosts = pages.select("host").where("host <> ''").distinct()
    child = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst"))
    child = child.join(hosts.select(F.col("host").alias("dst")), "dst").where("src <> dst")
    family = child.select("src", "dst").union(child.select("dst", "src"))
    return links.union(family).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def change(before: DataFrame, after: DataFrame) -> float:
    """The largest change of a rank as a share of itself; 1 or more while new hosts are reached."""
    was = before.withColumnRenamed("rank", "was")
    share = (
        F.when(F.col("was").isNull(), F.lit(1.0))
        .when(F.col("rank") < TINY, F.lit(0.0))
        .otherwise(F.abs(F.col("rank") - F.col("was")) / F.col("rank"))
    )
    return after.join(was, ["kind", "host"], "left").agg(F.max(share)).first()[0] or 0.0


def spread(
    edges: DataFrame,
    seeds: DataFrame,
    stages: Stages,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(kind, host, rank)``: personalised PageRank per kind of ``edges(kind, src, dst, p)``.

    ``seeds(kind, host, rank)`` sum to one per kind. What reaches a host without links ends there.
    Sums combine before each shuffle, and a hot host's edges are one row per neighbour. Every
    ``rounds`` rounds the ranks are staged and compared with those before. It ends when no host is
    newly reached, none changes by more than ``tolerance`` of itself, and what is still on its way,
    at most ``damping ** done`` of all rank, is within the tolerance too.
    """
    restart = seeds.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
    before, done = stages.put(seeds), 0
    while True:
        ranks = before
        for _ in range(rounds):
            moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("p") * F.col("rank") * damping).alias("rank")
            )
            ranks = moved.union(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks, done = stages.put(ranks), done + rounds
        moving = change(before, ranks)
        stages.drop(before)
        # Without a host that has both a rank and links, nothing moves after the first rounds.
        if moving == 0 or moving <= tolerance and damping**done <= tolerance:
            return ranks
        before = ranks


def judged(pages: DataFrame, rules=RULES, share: float = SHARE, tolerance: float = TOLERANCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages(page_id, url, html)``.

    Urls that are null or have no ``://`` have empty host and path, fit no rule, and are allowed,
    as are hosts that neither trust nor distrust reaches. A host that only distrust reaches is
    blocked however far it is; a share that exceeds ``share`` by no more than ``tolerance`` of it
    is a tie and allowed. Repeated rows are judged each. An empty
    table gives an empty result; other columns are not read.
    """
    stages = Stages(pages.sparkSession)
    url = F.col("url").cast("string")
    placed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    rule, verdict = rule_columns(rules)
    ruled = placed.withColumns({"rule": rule, "ruled": verdict})
    per_host = stages.put(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"),
            F.count_if(F.col("ruled") == "block").cast("double").alias("distrust"),
        )
    )
    edges = stages.put(host_edges(placed.select("host", "html")))
    total = per_host.agg(F.sum("trust"), F.sum("distrust")).first()
    seeds = per_host.select(
        F.explode(
            F.array(
                F.struct(F.lit("trust").alias("kind"), "host", (F.col("trust") / float(total[0] or 1)).alias("rank")),
                F.struct(F.lit("distrust").alias("kind"), "host", (F.col("distrust") / float(total[1] or 1)).alias("rank")),
            )
        ).alias("s")
    ).select("s.*").where("rank > 0")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(
        edges.select(F.lit("distrust").alias("kind"), "dst", "src", "w")
    )
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    flows = stages.put(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("p")))
    ranks = spread(flows, seeds, stages, tolerance=tolerance)
    scores = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"),
        F.count_if(F.col("kind") == "trust").alias("trusting"),
    )
    above = F.col("distrust") > share * (1 + tolerance) * (F.col("trust") + F.col("distrust"))
    alone = (F.col("trusting") == 0) & F.lit(share < 1)
    blocked = stages.put(scores.where(above | alone).select("host", F.lit(True).alias("bad")))
    named = ruled.drop("html").join(blocked, "host", "left")
    last = F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return named.select("page_id", "host", "path", "rule", last.alias("verdict"))
