"""URL filter: rules first, then trust and distrust propagated over the link graph of hosts.

Rules decide the pages they fit. Their verdicts seed two walks over the host graph (edges: absolute links in the
pages, counted per pair of hosts): trust starts at hosts with allowed pages and follows links, a personalised
PageRank; distrust starts at hosts with blocked pages and follows links backwards, to those who link there. Both
masses are counted in seed pages, so they compare: a page that no rule fits is blocked when its host's distrust
exceeds ``RATIO`` times its trust, and allowed otherwise, also when no walk reaches the host. Every step is a join
and an aggregation, stored between steps. The walks end when no host is newly reached and the mass still under way
cannot turn any host's verdict; a host whose two masses tie is settled when a walk moves less than ``PRECISION`` of
its seeds' mass, seeds without links left out. The number of steps is not limited.

Cases: a null url, or one without ``://``, has an empty host and path and no rule; a null html has no links; links
of a host to itself do not count; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, salted_join

# fixed values: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, PRECISION, RATIO = 0.85, 1e-15, 2.0
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    allowed = [r for v, r in rules if v == "allow"]
    return F.when(rule.isin(*allowed), "allow").when(rule.isNotNull(), "block")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(html_col), F.lit("")), F.lit(LINK), F.lit(1)),
                                         lambda h: F.translate(h, UPPER, LOWER)))
    each = pages.filter(col(html_col).contains("//")).select(host_of(col(url_col)).alias("src"), F.explode(links).alias("dst"))
    return each.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("links"))


def _settled(total: DataFrame, moved: dict[str, float], damping: float, ratio: float) -> bool:
    """No host's verdict can change: what is under way, with all it will still pass on, is added to one side.

    Every host that a walk can reach is reached, so a walk adds nothing to the others.
    """
    rest = {kind: moved.get(kind, 0.0) * damping / (1 - damping) for kind in ("trust", "distrust")}
    hosts = total.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == kind, F.col("mass"))).alias(kind) for kind in rest])
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    most_trust = trust + F.when(F.col("trust").isNotNull(), rest["trust"]).otherwise(0.0)
    most_distrust = distrust + F.when(F.col("distrust").isNotNull(), rest["distrust"]).otherwise(0.0)
    open_ = F.when(distrust > ratio * trust, distrust <= ratio * most_trust).otherwise(most_distrust > ratio * trust)
    return not hosts.filter(open_).limit(1).count()


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, ratio: float = RATIO,
              precision: float = PRECISION) -> DataFrame:
    """edges (kind, from, dst, share: of the source's links), seeds (kind, host, mass) -> (kind, host, mass).

    What a host without links holds is not passed on. ``moving`` is the mass still under way.
    """
    spark = seeds.sparkSession
    total = moving = seeds
    start, last = None, None
    while True:
        step = Scratch(spark, "trust-step")
        out = moving.select(F.concat_ws("\x00", "kind", "host").alias("from"), "mass")
        sent = salted_join(edges, out, "from", F.xxhash64("dst")).groupBy("kind", F.col("dst").alias("host")).agg(
            (damping * F.sum(F.col("mass") * F.col("share"))).alias("mass"))
        moving = step.store(sent, "moving")
        moved = {r["kind"]: r["mass"] for r in moving.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
        if start is None:
            # a seed with links passes on all its mass, so the first step tells what the seeds with links hold
            start = {kind: mass / damping for kind, mass in moved.items()}
        new = moving.join(total, ["kind", "host"], "left_anti").limit(1).count()
        total = step.store(total.unionByName(moving).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "total")
        if last:
            last.clear()
        last = step
        if not new and (all(mass <= precision * start[kind] for kind, mass in moved.items())
                        or _settled(total, moved, damping, ratio)):
            break
    total = scratch.store(total, "total")
    last.clear()
    return total


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
                ratio: float = RATIO, **options) -> DataFrame:
    """Per page: id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(pages.sparkSession, "trust")
    slim = pages.select(col(id_col).alias("id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    slim = slim.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    slim = scratch.store(slim.withColumn("ruled", verdict_of(F.col("rule"), rules)), "slim", result=True)
    links = scratch.store(host_edges(pages, url_col, html_col), "edges")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    both = both.withColumn("from", F.concat_ws("\x00", "kind", "src"))
    sums = both.groupBy("from").agg(F.sum("links").alias("all"))
    edges = scratch.store(salted_join(both, sums, "from", F.xxhash64("dst")).select(
        "kind", "from", "dst", (F.col("links") / F.col("all")).alias("share")), "shares")
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = scratch.store(slim.filter("ruled IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(
        F.count("*").cast("double").alias("mass")), "seeds")
    mass = propagate(edges, seeds, scratch, ratio=ratio, **options)
    hosts = slim.select("host").distinct()
    told = hosts.join(mass, "host", "left").groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    told = scratch.store(told, "hosts", result=True)
    scratch.clear()
    verdict = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return salted_join(slim, told, "host", F.xxhash64("id", "path")).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), "trust", "distrust")
