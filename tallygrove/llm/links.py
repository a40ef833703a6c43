"""URL filtering by rules and by propagation of trust over the host graph.

Links in the pages' HTML give weighted edges between hosts. Trust spreads from allowed hosts along the edges, distrust from
blocked hosts against them (who links to a blocked host earns distrust), both as personalised PageRank: each round a host
passes on its mass, and the mass not passed on returns to the seeds, until less than a tolerance moves. A host is a seed by
the share of its ruled urls that are allowed or blocked. Rules judge the urls that they fit; every other url gets its host's
verdict: block where distrust is above trust.

The state is one row for each host that a link or a rule touches; each round is one join and one aggregation with partial
sums, so a host that everyone links to costs one row for each task.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed unless the graph says
otherwise (the empty host has no edges); null html has no links; repeated rows are judged each; links within a host, and those
that name no host (relative ones), are no edges, while ``//host/`` names one; without edges the seeds stay as they are, so an
unruled url of a host with more distrust than trust of its own is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import ascii_lower, drop, save

#: (verdict, host, path): the contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Rounds after which what moved is looked at.
CHECKED = 8
#: Distrust over trust above which a host is blocked.
MARGIN = 0.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, weight: number of links between different hosts."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[^"'\s>]*:)?//[^"'\s>]*)"""), F.lit(1)))
    whole = F.when(F.startswith("_to", F.lit("//")), F.concat(F.lit(":"), "_to")).otherwise(F.col("_to"))
    found = pages.select(host_of(F.col("url")).alias("source"), link.alias("_to")).select("source", host_of(whole).alias("target"))
    return found.where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """seeds: host, trust, distrust (each sums to 1 or 0). host, trust, distrust once a round moves less than ``tolerance``.

    What moves shrinks by ``damping`` a round at least, so 0.85 takes about 90 rounds at most; RuntimeError after ``rounds``.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("_o"))
    into = edges.groupBy("target").agg(F.sum("weight").alias("_i"))
    shares = edges.join(out, "source").join(into, "target").select("source", "target", (F.col("weight") / F.col("_o")).alias("_down"), (F.col("weight") / F.col("_i")).alias("_up"))
    # Each edge twice: trust along it, distrust against it.
    flows = save(shares.select(F.col("source").alias("host"), F.col("target").alias("_to"), "_down", F.lit(0.0).alias("_up")).unionByName(shares.select(F.col("target").alias("host"), F.col("source").alias("_to"), F.lit(0.0).alias("_down"), "_up")))
    seeds = save(seeds)
    state = seeds
    if flows.isEmpty():
        return state
    for k in range(rounds):
        passed = flows.join(state, "host").groupBy(F.col("_to").alias("host")).agg(F.sum(F.col("trust") * F.col("_down")).alias("_t"), F.sum(F.col("distrust") * F.col("_up")).alias("_d"))
        kept = passed.agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("_st"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_sd"))  # one row
        back = seeds.crossJoin(F.broadcast(kept)).select("host", (F.col("trust") * (1 - damping * F.col("_st"))).alias("trust"), (F.col("distrust") * (1 - damping * F.col("_sd"))).alias("distrust"))
        new = save(passed.select("host", (damping * F.col("_t")).alias("trust"), (damping * F.col("_d")).alias("distrust")).unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        if k % CHECKED == CHECKED - 1:
            moved = new.alias("n").join(state.alias("o"), "host", "full").agg(F.sum(F.abs(F.coalesce(F.col("n.trust"), F.lit(0.0)) - F.coalesce(F.col("o.trust"), F.lit(0.0))) + F.abs(F.coalesce(F.col("n.distrust"), F.lit(0.0)) - F.coalesce(F.col("o.distrust"), F.lit(0.0))))).first()[0]
            if moved is None or moved < tolerance:
                return new
        if state is not seeds:
            drop(state)
        state = new
    raise RuntimeError(f"more than {tolerance} still moves after {rounds} rounds")


def judge(pages: DataFrame, rules: tuple = RULES, margin: float = MARGIN, tolerance: float = 1e-6) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    seen = judged.where("_rule is not null").groupBy("host").agg(F.sum(F.when(F.col("_rule.verdict") == "allow", 1.0).otherwise(0.0)).alias("_a"), F.count("*").alias("_n"))
    shares = seen.select("host", (F.col("_a") / F.col("_n")).alias("_a"))
    total = shares.agg(F.sum("_a").alias("_ta"), F.sum(1 - F.col("_a")).alias("_tb"))  # one row
    seeds = shares.crossJoin(F.broadcast(total)).select("host", F.coalesce(F.try_divide(F.col("_a"), F.col("_ta")), F.lit(0.0)).alias("trust"), F.coalesce(F.try_divide(1 - F.col("_a"), F.col("_tb")), F.lit(0.0)).alias("distrust"))
    ranks = propagate(host_edges(pages), seeds, tolerance=tolerance)
    method = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0)) > margin, "block").otherwise("allow")
    return judged.join(ranks, "host", "left").select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
