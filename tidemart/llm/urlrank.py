"""URL filters: prefix rules, and trust and distrust spread over the host graph.

Rules name a host, with its subdomains, and a path prefix; the longest that fits decides. Other pages are
judged by their host: shares of pages that rules allow and block are the seeds of two personalised
PageRanks, trust along host edges and distrust against them, and a host is blocked where distrust reaches
a threshold and exceeds trust. Distrust comes back to a linking host by the share of its own links, so it
does not shrink with the number of linkers: it is the damped chance that a walk along links from the host meets
a blocked page, and a host that links to nothing but a blocked host has 0.1275 however many others do.

Host edges are hyperlinks with a host (``scheme://host/`` or ``//host/``) in the pages' HTML, and both directions
between a host and its parent domain (top-level domains are none). Pages whose links are all relative to their
host, as in the test tables, give edges of the second kind only. Everything is DataFrame expressions.

Ranks are iterated until no score moves by ``TOLERANCE`` in ``STEPS_AT_ONCE`` steps; each step shrinks what is left
by the damping, so this ends after some seventy steps at any size.

Edges are summed per pair of hosts before any join, and walks add contributions with partial sums, so a
host with a third of all pages or links is no bottleneck. Ranks are checkpointed while they are iterated.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed. Null
HTML has no links. Repeated rows give repeated results and count as pages. Extra columns are left out; an
empty table gives an empty result. Of rules that fit, the longest wins, and among rules of one length the last by
name; equal scores of trust and distrust allow.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import checkpointed, pick


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Ranks have converged when no score moves by so much in so many steps.
TOLERANCE, STEPS_AT_ONCE = 1e-6, 8
#: Walk edges that a task steps along: small graphs take few tasks, and few shuffle files, whatever the cluster.
EDGES_PER_TASK = 200_000
#: Least distrust that blocks a host, if it exceeds its trust.
THRESHOLD = 0.075
HREF = "(?i)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s\"'<>]*)"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Pages with host, path, the name of the longest rule that fits, and its verdict."""
    split = pages.select(*pages.columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones are longer and win
        name = F.when(fits(rule), F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits(rule), F.lit(rule.verdict)).otherwise(verdict)
    return split.withColumns({"rule": name, "by_rule": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): shares of each host's links; one row for each pair of hosts."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url"))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit(":"), F.col("url"))).otherwise(F.col("url"))
    out = links.select(F.col("host").alias("src"), host_of(url).alias("dst"))
    parent = F.regexp_extract("host", "^[^.]+\\.(.+\\..+)$", 1)
    family = pages.select("host").distinct().select(F.col("host").alias("src"), parent.alias("dst")).where("dst <> ''")
    every = out.union(family).union(family.select("dst", "src")).where("src <> '' AND dst <> '' AND src <> dst")
    pairs = every.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    return pairs.join(totals, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def ranks(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), converged; seeds: host, allowed, blocked as shares of pages."""
    walks = checkpointed(
        edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").union(
            edges.select(F.lit("distrust"), "dst", "src", "weight")
        )
    )
    tasks = 1 + walks.count() // EDGES_PER_TASK
    walks = checkpointed(walks.coalesce(tasks))
    start = seeds.select(
        "host", F.explode(F.create_map(F.lit("trust"), "allowed", F.lit("distrust"), "blocked")).alias("walk", "seed")
    )
    start = checkpointed(start.where("seed > 0").coalesce(tasks))
    base = start.select("walk", "host", ((1 - DAMPING) * F.col("seed")).alias("score"))
    score = base
    while True:
        before = score
        for _ in range(STEPS_AT_ONCE):
            moved = walks.join(score.withColumnRenamed("host", "src"), ["walk", "src"]).select(
                "walk", F.col("dst").alias("host"), (DAMPING * F.col("weight") * F.col("score")).alias("score")
            )
            score = base.union(moved).groupBy("walk", "host").agg(F.sum("score").alias("score")).coalesce(tasks)
        score = checkpointed(score)
        change = score.union(before.withColumn("score", -F.col("score"))).groupBy("walk", "host").agg(F.sum("score").alias("d"))
        if (change.agg(F.max(F.abs("d"))).first()[0] or 0.0) < tolerance:
            break
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0))
    return score.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    judged = ruled(pick(pages, page_id="bigint", url="string", html="string"), rules)
    share = lambda v: F.avg((F.coalesce("by_rule", F.lit("")) == v).cast("double"))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    scores = ranks(seeds, host_edges(judged))
    blocked = (F.coalesce("distrust", F.lit(0.0)) >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return (
        judged.select("page_id", "host", "path", "rule", "by_rule")
        .join(scores, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        )
    )
