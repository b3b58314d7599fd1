"""URL verdicts by rules and link-graph propagation, in DataFrame functions only.

Rules name a host with its subdomains and a path prefix; the longest that fits decides. Pages without one
get their host's verdict: personalised PageRank carries trust from hosts with allowed pages along links,
and distrust from hosts with blocked pages against them (a host that links to a bad one is suspect). Both are
shares of all ruled pages, so that pages weigh alike on either side, and both keep their sum: what reaches a host
without links to pass it on goes back to where it came from. A host is blocked when its distrust exceeds its
trust by ``margin``; a host that neither reaches stays allowed.

Edges are host pairs, counted before the shuffle. Ranks live in scratch tables, a row per host; only sums
reach the driver. A host with many links or pages is joined by broadcast.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lower_ascii, materialise

#: The rules of the registered query: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a url that is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none; of two equal ones the block counts."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from absolute links in the html.

    Relative links stay on their host unless a ``base`` names another, which is itself such a link.
    """
    host, _ = parts(F.col("url"))
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))
    found = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(links, lower_ascii))).alias("dst"))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``seeds`` (host, trust, distrust, a row per host) and ``edges`` (src, dst, links) to ranks (host, trust, distrust).

    Seeds are scaled by one number, so that all of them sum to 1. A round adds (1 - damping) of the seed to damping of
    what neighbours pass on: trust along links by their share of the source's, distrust against them by their share
    of the target's. What a host can't pass on is dealt to the seeds by their size, so without edges the ranks are the
    seeds. Stops when no more than ``tolerance`` moves, which damping below 1 sees to (some 95 rounds), or after
    ``rounds`` if they are given.
    """
    total = seeds.agg(F.sum(F.col("trust") + F.col("distrust")).alias("all")).first()["all"] or 1.0
    seeds = materialise(seeds.select("host", *[(F.col(c) / total).alias(c) for c in ("trust", "distrust")]), "seeds")
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return seeds
    links = edges.count()
    out = edges.groupBy("src").agg(F.sum("links").alias("all"), F.count("*").alias("n"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"), F.count("*").alias("n"))
    share = F.col("links") / F.col("all")
    forward = join_counted(edges, out, "src", links).select(F.col("src").alias("host"), F.col("dst").alias("to"), share.alias("t"), F.lit(0.0).alias("d"))
    against = join_counted(edges, into, "dst", links).select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), share.alias("d"))
    shares = materialise(forward.union(against).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "shares")
    fan = materialise(shares.groupBy("host").agg(F.count("*").alias("n")), "fan")
    kept = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    base = seeds.select("host", F.col("trust").alias("st"), F.col("distrust").alias("sd"), F.lit(0.0).alias("t"), F.lit(0.0).alias("d"))
    ranks = seeds
    for _ in itertools.count() if rounds is None else range(rounds):
        passed = join_counted(shares, ranks.join(fan, "host"), "host", 2 * links).select(
            F.col("to").alias("host"), F.lit(0.0).alias("st"), F.lit(0.0).alias("sd"), (F.col("t") * F.col("trust")).alias("t"), (F.col("d") * F.col("distrust")).alias("d")
        )
        now = base.union(passed).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("st", "sd", "t", "d")])
        before = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        now = materialise(now.join(before, "host", "left").fillna({"t0": 0.0, "d0": 0.0}), "ranks")
        came = now.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()

        def rank(seed: str, got: str, whole: float | None, reached: float | None) -> Column:
            back = (whole - reached) / whole if whole else 0.0  # of each seed, what hosts without links had of it
            return F.col(seed) * (1 - damping + damping * back) + F.col(got) * damping

        now = now.select("host", rank("st", "t", kept["t"], came["t"]).alias("trust"), rank("sd", "d", kept["d"], came["d"]).alias("distrust"), "t0", "d0")
        moved = now.agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0")))).first()[0] or 0.0
        ranks = now.select("host", "trust", "distrust")
        if moved <= tolerance:
            break
    return ranks


def judge(pages: DataFrame, rules=RULES, *, margin: float = 0.0) -> DataFrame:
    """Returns page_id, host, path, rule, verdict, trust and distrust, a row per row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has empty host and path, fits no rule, takes no part in the graph
    and is allowed. A null html has no links. Repeated rows are judged each and weigh each; other columns
    are ignored; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = materialise(urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)), "ruled")
    known = ruled.where("host <> ''")
    count = lambda v: F.count_if(F.col("r.verdict") == v).cast("double")
    seeds = materialise(known.groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"), F.count("*").alias("n")), "hosts")
    ranks = propagate(seeds.select("host", "trust", "distrust"), host_edges(pages))
    ranked = materialise(seeds.select("host", "n").join(ranks, "host"), "ranked")
    nowhere = ruled.where("host = ''").withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0)})
    bad = F.col("distrust") - F.col("trust") > margin
    return join_counted(known, ranked, "host", ruled.count()).unionByName(nowhere).select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
