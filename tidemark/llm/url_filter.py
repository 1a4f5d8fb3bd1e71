"""URL filter: rules first, then trust and distrust that spread over links between hosts.

Only DataFrame functions are used. Rules give seeds: the share of a host's pages that rules allow (trust) or block
(distrust). Trust follows links forward as personalised PageRank; distrust follows them backward, to hosts that link
to blocked ones. What reaches a host without links on its way stays there and goes no further. A host is blocked if its distrust exceeds its trust by more than a threshold; seeds of 1 are the unit.

Edge cases: a null url, or one without "://", has an empty host and path, no rule, and the verdict "allow"; a null html
has no links; repeated rows count again as pages but a host pair is one edge with a weight; an empty table gives no rows.
Input columns other than page_id, url and html are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: The rules of the production list.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Rounds between two writes.
TOGETHER = 5

LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty for a null url and one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits. Equal lengths: block before allow, then by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict, or null."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their number: src, dst, n."""
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"),
    ).withColumn("dst", ascii_lower(F.col("dst")))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, rules=RULES, damping: float = 0.85, max_iter: int | None = None, tol: float = 1e-6) -> DataFrame:
    """host, trust, distrust: the sums of damping**k times what k links bring, in units of a seed of 1.

    A round joins the scores to the edges (a row for each host pair), sums them by host and adds the seeds; the scores are
    written to the shared folder every few rounds. It ends when less than tol came in since the last time, which the
    damping brings about in a number of rounds known from the start (about 95 for a mass of 1), or after max_iter rounds.
    """
    seeds = judged(pages, rules).filter("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    )
    edges = staged(host_edges(pages), "host-edges")
    seeded = staged(seeds.filter("trust > 0 or distrust > 0"), "host-seeds")
    out = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select(
        F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("w")
    )
    back = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("w")
    )
    moving = seeded.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, r)")).filter("r > 0")
    mass = moving = moving.select("kind", "host", "r")
    if not edges.isEmpty():
        ways = staged(out.unionByName(back), "host-ways")
        before = moving.agg(F.sum("r")).first()[0] or 0.0
        # damping**k of the seeds moves in round k, and all of the rounds from k on bring that / (1 - damping)
        rounds = max(0, math.ceil(math.log(tol * (1 - damping) / before) / math.log(damping))) + 2 * TOGETHER if before > 0 else 0
        left, came = rounds if max_iter is None else max_iter, before
        while left > 0 and came >= tol:
            for _ in range(min(TOGETHER, left)):
                brought = mass.withColumnRenamed("host", "a").join(ways, ["kind", "a"]).select("kind", F.col("b").alias("host"), (damping * F.col("r") * F.col("w")).alias("r"))
                mass = moving.unionByName(brought).groupBy("kind", "host").agg(F.sum("r").alias("r"))
            mass, left = staged(mass, "host-mass"), left - TOGETHER
            after = mass.agg(F.sum("r")).first()[0] or 0.0
            before, came = after, after - before
        if max_iter is None and came >= tol:
            raise RuntimeError(f"{came} still moves between hosts after {rounds} rounds")
    return mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("r")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("r")).otherwise(0.0)).alias("distrust"),
    )


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, max_iter: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page: the rule's verdict, else block where the host's distrust is
    more than its trust plus threshold, else allow."""
    blocked = host_scores(pages, rules, damping, max_iter).filter(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit("block").alias("spread"))
    return judged(pages, rules).join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict")
    )
