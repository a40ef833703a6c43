"""Contributions and outside spending as of a cutoff, from committees to candidates, for all snapshots in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(rows: DataFrame, cutoff: object, on: str = "txn_date") -> DataFrame:
    """Rows dated up to the cutoff, that day included; undated rows go."""
    return rows.where(F.col(on) <= (F.col(cutoff) if isinstance(cutoff, str) and cutoff in rows.columns else F.lit(cutoff)))


def all_snapshots(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows: cycle, txn_date; cutoffs: cycle, snapshot, cutoff, a few dozen rows by their making. Each row once for each snapshot that may see it."""
    return rows.join(F.broadcast(cutoffs.select("cycle", "snapshot", "cutoff")), "cycle").where(F.col("txn_date") <= F.col("cutoff"))


def first_seen(rows: DataFrame, cutoffs: DataFrame, on: str = "txn_date") -> DataFrame:
    """rows: cycle, txn_date. Each row once, with ``_seen``, the place of the first of its cycle's cutoffs that may see it; what no cutoff sees goes.

    cutoffs: cycle, snapshot, cutoff, a few dozen rows by their making. The later cutoffs see the row as well, which running()
    makes good after the sums.
    """
    ends = cutoffs.groupBy("cycle").agg(F.array_sort(F.collect_list("cutoff")).alias("_ends"))
    seen = F.size(F.filter("_ends", lambda c: c < F.col(on)))
    return rows.where(F.col(on).isNotNull()).join(F.broadcast(ends), "cycle").withColumn("_seen", seen).where(F.col("_seen") < F.size("_ends")).drop("_ends")


def running(sums: DataFrame, cutoffs: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """sums: cycle, keys, _seen and parts, one row each. The running sums at every snapshot from the first one on: cycle, snapshot, keys, parts."""
    order = cutoffs.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("cutoff", "snapshot"))).alias("_order"))
    lists = sums.groupBy("cycle", *keys).agg(F.array_sort(F.collect_list(F.struct("_seen", *parts))).alias("_s")).join(F.broadcast(order), "cycle")  # one a snapshot
    at = lists.select("cycle", *keys, "_s", "_order", F.explode(F.sequence(F.get("_s", F.lit(0))["_seen"], F.size("_order") - 1)).alias("_at"))
    upto = lambda p: F.aggregate(F.filter("_s", lambda x: x["_seen"] <= F.col("_at")), F.lit(0).cast("bigint"), lambda a, x: a + x[p])
    return at.select("cycle", F.get("_order", F.col("_at"))["snapshot"].alias("snapshot"), *keys, *(upto(p).alias(p) for p in parts))


def as_of_sums(rows: DataFrame, cutoffs: DataFrame, linkage: DataFrame | None, parts: dict[str, Column], amount: str = "cents") -> DataFrame:
    """cycle, snapshot, cand_id and a sum for each of ``parts`` (a condition) of what each snapshot may see.

    An as-of join on intervals: a row is summed once, under the first snapshot that sees it, however many there are; only the
    candidates' sums are then run on over the snapshots. linkage: cmte_id, cand_id; without it the rows name the candidate.
    """
    rows = first_seen(rows, cutoffs)
    whole = [F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).alias(n) for n, c in parts.items()]
    keys = ["cycle", "_seen"]
    if linkage is None:
        sums = rows.groupBy(*keys, "cand_id").agg(*whole)
    else:
        linked = rows.groupBy(*keys, "cmte_id").agg(*whole).join(linkage.select("cmte_id", "cand_id").where("cand_id is not null"), "cmte_id")
        sums = linked.groupBy(*keys, "cand_id").agg(*(F.sum(n).alias(n) for n in parts))
    return running(sums, cutoffs, ["cand_id"], list(parts))


def in_whole(sums: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """Cents to whole money, cut off once."""
    return sums.select(*keys, *(F.floor(c / 100).alias(n) for n, c in names.items()))


def committee_totals(rows: DataFrame, keys: list[str], amount: str = "cents") -> DataFrame:
    """One sum for each committee and key: partial sums before the shuffle, exact, truncated once by the caller."""
    return rows.groupBy(*keys, "cmte_id").agg(F.sum(amount).alias(amount))


def aligned(rows: DataFrame, keys: list[str], amount: str = "cents") -> DataFrame:
    """rows: source (indiv, cmte). Both sources' totals of each committee side by side, 0 where there are none: one scan, no join."""
    by = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col(amount))), F.lit(0)).alias(f"by_{s}") for s in ("indiv", "cmte")]
    return rows.where(F.col("source").isin("indiv", "cmte")).groupBy(*keys, "cmte_id").agg(*by)


def candidate_totals(totals: DataFrame, linkage: DataFrame, keys: list[str]) -> DataFrame:
    """totals: keys, cmte_id, by_indiv, by_cmte (cents). A committee counts for every candidate that it is linked to, as often."""
    linked = totals.join(linkage.select("cmte_id", "cand_id").where("cand_id is not null"), "cmte_id")
    sums = linked.groupBy(*keys, "cand_id").agg(F.sum("by_indiv").alias("_i"), F.sum("by_cmte").alias("_c"))
    return sums.select(*keys, "cand_id", F.floor((F.col("_i") + F.col("_c")) / 100).alias("total_trans"), F.floor(F.col("_i") / 100).alias("trans_by_indiv"), F.floor(F.col("_c") / 100).alias("trans_by_cmte"))


def with_master(totals: DataFrame, master: DataFrame, office: str = "H") -> DataFrame:
    """Candidates of one office; the filter is put on the master table before the join."""
    return totals.join(master.where(F.col("office") == office), "cand_id")


def support_oppose(rows: DataFrame, keys: list[str], code: str = "sup_opp", amount: str = "cents") -> DataFrame:
    """ie_for_total and ie_against_total; other codes add nothing but keep the candidate at 0 and 0."""
    sums = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col(code) == c, F.col(amount))), F.lit(0)).alias(f"_{c}") for c in "SO"))
    return sums.select(*keys, F.floor(F.col("_S") / 100).alias("ie_for_total"), F.floor(F.col("_O") / 100).alias("ie_against_total"))
