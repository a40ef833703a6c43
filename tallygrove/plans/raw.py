"""From raw files to the feature matrix: readers, as-of sums, matching and joins of one cycle, all snapshots in one plan.

Layout below ``raw``: ``{cycle}/fec`` (bulk files, see delimited.bulk_paths), ``{cycle}/schedule_e.csv``, ``results.tab``,
``{cycle}/pvi.csv``, ``{cycle}/acs`` (staged responses, one JSON file a state) and the ratings pages, either for each snapshot
(``{cycle}/{snapshot}/ratings.html``, ``archive.html``) or with their logs: ``{cycle}/revisions.jsonl`` (rev, ts) and
``{cycle}/pages/{rev}.html``, ``{cycle}/archive.jsonl`` (ts) and ``{cycle}/archive/{ts}.html``. With logs the build itself takes
the page that a snapshot may see. Indexes may be missing, and the archive; any other source that cannot be read is an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.functions import text as fx
from tallygrove.operators import match, money
from tallygrove.operators import results as rs
from tallygrove.plans import features
from tallygrove.sources import delimited, html, staged

KEYS = ["cycle", "snapshot"]


def _cents(amount: str) -> F.Column:
    return F.round(F.col(amount).try_cast("decimal(18,2)") * 100).cast("bigint")


def contributions(spark: SparkSession, raw: str, cycle: int) -> DataFrame:
    """cycle, cmte_id, txn_date, cents, source of both bulk files; rows without a readable date or amount go."""
    out = None
    for key, source in (("indiv", "indiv"), ("pas", "cmte")):
        data, header = delimited.bulk_paths(raw, cycle)[key]
        rows = delimited.pipe_table(spark, data, delimited.headers(spark, header))
        rows = rows.select(F.lit(cycle).alias("cycle"), F.col("CMTE_ID").alias("cmte_id"), dates.from_mmddyyyy(F.col("TRANSACTION_DT")).alias("txn_date"), _cents("TRANSACTION_AMT").alias("cents"), F.lit(source).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out.where("txn_date is not null and cents is not null")


def candidates(spark: SparkSession, raw: str, cycle: int) -> DataFrame:
    """cand_id, last_name, party_major, office, state, district, cand_ici of the master file."""
    data, header = delimited.bulk_paths(raw, cycle)["cn"]
    rows = delimited.pipe_table(spark, data, delimited.headers(spark, header))
    return rows.select(F.col("CAND_ID").alias("cand_id"), fx.surname(F.col("CAND_NAME")).alias("last_name"), fx.party_major(F.col("CAND_PTY_AFFILIATION")).alias("party_major"), F.col("CAND_OFFICE").alias("office"), F.upper("CAND_OFFICE_ST").alias("state"), F.coalesce(F.col("CAND_OFFICE_DISTRICT").try_cast("int"), F.lit(0)).alias("district"), F.col("CAND_ICI").alias("cand_ici"))


def linkage(spark: SparkSession, raw: str, cycle: int) -> DataFrame:
    data, header = delimited.bulk_paths(raw, cycle)["ccl"]
    return delimited.pipe_table(spark, data, delimited.headers(spark, header)).select(F.col("CMTE_ID").alias("cmte_id"), F.col("CAND_ID").alias("cand_id"))


def totals(rows: DataFrame, linked: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cycle, snapshot, cand_id and the three totals, all snapshots from one scan."""
    sums = money.as_of_sums(rows, cutoffs, linked, {"i": F.col("source") == "indiv", "c": F.col("source") == "cmte"})
    return money.in_whole(sums, [*KEYS, "cand_id"], {"total_trans": F.col("i") + F.col("c"), "trans_by_indiv": F.col("i"), "trans_by_cmte": F.col("c")})


def spending(spark: SparkSession, raw: str, cycle: int, cutoffs: DataFrame) -> DataFrame:
    """cycle, snapshot, cand_id, ie_for_total, ie_against_total; KeyError for a file without one of its columns."""
    names = {"cand_id": "cand_id", "exp_date": "exp_date", "exp_amo": "exp_amo", "sup_opp": "sup_opp"}
    rows = delimited.csv_renamed(spark, f"{raw}/{cycle}/schedule_e.csv", names, list(names))
    rows = rows.select(F.lit(cycle).alias("cycle"), "cand_id", dates.from_dd_mon_yy(F.col("exp_date")).alias("txn_date"), _cents("exp_amo").alias("cents"), F.upper(F.trim("sup_opp")).alias("sup_opp"))
    sums = money.as_of_sums(rows.where("txn_date is not null and cents is not null"), cutoffs, None, {"s": F.col("sup_opp") == "S", "o": F.col("sup_opp") == "O"})
    return money.in_whole(sums, [*KEYS, "cand_id"], {"ie_for_total": F.col("s"), "ie_against_total": F.col("o")})


def results(spark: SparkSession, raw: str, cycle: int) -> DataFrame:
    """cycle, state, district, last_name, party_major, votes with margin, winner and vote_share."""
    rows = rs.general(delimited.quoted_rows(spark, f"{raw}/results.tab"), cycle)
    rows = rows.select(F.lit(cycle).alias("cycle"), F.col("state_po").alias("state"), F.col("district").try_cast("int").alias("district"), F.trim("candidate").alias("candidate_name"), fx.surname_any(F.col("candidate")).alias("last_name"), rs.parties("party").alias("party_major"), F.col("candidatevotes").try_cast("bigint").alias("votes"))
    return rs.margins(rows, ["cycle", "state", "district"])


def index(spark: SparkSession, raw: str, cycle: int) -> DataFrame:
    """cycle, state, district, cpvi; none where the file is missing."""

    def read() -> DataFrame:
        rows = delimited.csv_located(spark, f"{raw}/{cycle}/pvi.csv", {"place": ["district", "dist"], "index": ["pvi"]})
        rows = rows.select(fx.district_code(F.col("place")).alias("_d"), fx.signed_index(F.col("index")).alias("cpvi"))
        return rows.where("_d is not null").select(F.lit(cycle).alias("cycle"), "_d.state", "_d.district", "cpvi")

    return delimited.or_empty(read, "cycle int, state string, district int, cpvi int", spark)


#: What a ratings page may say besides the first forecaster's rating, and its name in the matrix.
MORE = {"sabato_ordinal": "sabato_rating", "inside_ordinal": "inside_rating", "incumbent_raw": "incumbent_raw", "flip_predicted": "flip_predicted"}


def _found(read) -> DataFrame | None:
    """What ``read()`` gives, or None where its path does not exist; any other error is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def pages(spark: SparkSession, raw: str, cycle: int, snapshots: tuple[str, ...], elections: dict, revisions: dict[str, tuple[int, str]]) -> dict[str, dict]:
    """For each snapshot the page's path, revision and time, and the archive's path and time (None where there is none).

    From the logs: the last revision that the snapshot may see, for a cycle that was filled back else its first ever; and, for
    those cycles only, the archive's last page of the year up to the snapshot. ValueError where no page can be taken.
    """
    base, fill = f"{raw}/{cycle}", cycle in features.BACKFILLED
    log, index = _found(lambda: staged.json_lines(spark, f"{base}/revisions.jsonl", "rev bigint, ts string")), None
    if fill:
        index = _found(lambda: staged.json_lines(spark, f"{base}/archive.jsonl", "ts string"))
    days = {s: dates.snapshot_date(cycle, s, elections) for s in snapshots}
    out = {}
    if log is not None:
        wanted = spark.createDataFrame([(s, d, fill) for s, d in days.items()], "snapshot string, cutoff date, may_fill boolean")  # a row a snapshot
        seen = wanted.select("snapshot").join(log.withColumn("at", F.to_timestamp("ts"))).select("snapshot", "rev", "at")  # a log for each snapshot
        taken = staged.latest_revision(seen, wanted, "snapshot", "at", "rev").join(log, "rev", "left").collect()
        for r in taken:
            if r["rev"] is None:
                raise ValueError(f"{cycle} {r['snapshot']}: no revision up to the snapshot")
            out[r["snapshot"]] = {"page": f"{base}/pages/{r['rev']}.html", "revision": r["rev"], "ts": r["ts"]}
    else:
        out = {s: {"page": f"{base}/{s}/ratings.html", "revision": revisions.get(s, (0, None))[0], "ts": revisions.get(s, (0, None))[1]} for s in snapshots}
    for s, day in days.items():
        stamp = staged.latest_stamp(index, day.strftime("%Y%m%d"), f"{day.year}0101").first()["ts"] if index is not None else None
        out[s] |= {"archive": f"{base}/archive/{stamp}.html" if stamp else None if index is not None else f"{base}/{s}/archive.html" if fill else None, "archive_ts": stamp or day.strftime("%Y%m%d")}
    return out


def ratings(spark: SparkSession, cycle: int, snapshot: str, page: dict, least_rows: int = html.LEAST_ROWS) -> DataFrame:
    """state, district, cpvi, cook_rating, what else the page says, and for each row its source, time and leak flag.

    page: one of pages(). In a cycle that was filled back the archive's value counts where there is one, and such a row bears the
    archive's time and no flag; the others keep the page's, flagged. (Row by row, so that a district that the archive lacks
    stays marked.)
    """
    text = spark.read.text(page["page"], wholetext=True).first()[0]
    wiki = html.ratings(spark, text, cycle, snapshot, page["revision"], least_rows)
    absent = F.lit(None)
    more = [F.col(c).alias(n) for c, n in MORE.items() if c in wiki.columns]
    wiki = wiki.select(F.col("state_abbr").alias("state"), "district", (F.col("cpvi_signed") if "cpvi_signed" in wiki.columns else absent.cast("int")).alias("cpvi"), (F.col("cook_ordinal") if "cook_ordinal" in wiki.columns else absent.cast("double")).alias("cook_rating"), *more)
    held = _found(lambda: spark.read.text(page["archive"], wholetext=True)) if page["archive"] else None
    if held is None:
        rated = wiki.withColumn("ratings_source", F.lit("wiki"))
    else:
        archive = html.archive_ratings(html.tables(held.select(F.col("value").alias("html"), F.lit(0).alias("page"))))
        rated = match.overlay(wiki, archive.select(F.col("state_abbr").alias("state"), "district", F.col("cook_ordinal").alias("cook_rating")), ["state", "district"], "cook_rating")
    archived = F.col("ratings_source") == "archive"
    return rated.withColumns({
        "ratings_source": F.when(archived, "wayback_cook").otherwise("wikipedia"),
        "ratings_revision_ts": F.when(archived, page["archive_ts"]).otherwise(F.lit(page["ts"]).cast("string")),
        "leaky_ratings": ~archived & F.lit(cycle in features.BACKFILLED),
    })


def identified(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Results with cand_id and cand_ici: of every record of the last name in the district, whatever its party, a row each; else by likeness; unmatched rows keep nulls."""
    records = records.select("cand_id", "cand_ici", "state", "district", "last_name", "party_major")
    hit = match.exact(rows, records).drop("record_party")
    missed = hit.where("cand_id is null and party_major in ('D', 'R')").withColumn("row_id", F.concat_ws("|", "state", "district", "party_major", "last_name", "votes"))
    near = match.fuzzy(missed.select("row_id", "state", "district", "last_name", "party_major"), records).select("row_id", F.col("cand_id").alias("_near"))
    near = near.join(records.select(F.col("cand_id").alias("_near"), F.col("cand_ici").alias("_near_ici")), "_near")
    hit = hit.withColumn("row_id", F.concat_ws("|", "state", "district", "party_major", "last_name", "votes")).join(near, "row_id", "left")
    return hit.withColumns({"cand_id": F.coalesce("cand_id", "_near"), "cand_ici": F.coalesce("cand_ici", "_near_ici")}).drop("row_id", "_near", "_near_ici")


def matrix(spark: SparkSession, raw: str, cycle: int, snapshots: tuple[str, ...] = tuple(dates.SNAPSHOTS), states: dict[str, str] | None = None, elections: dict = dates.ELECTIONS, revisions: dict[str, tuple[int, str]] | None = None, least_rows: int = html.LEAST_ROWS) -> DataFrame:
    """The audited matrix of one cycle at the given snapshots.

    states: FIPS code to postal code, for the survey; revisions: snapshot to (revision id, its time), where there is no log.
    """
    raw = raw.rstrip("/")
    cutoffs = dates.cutoffs(spark, {cycle: elections[cycle]}).where(F.col("snapshot").isin(*snapshots))
    people = candidates(spark, raw, cycle).where("office = 'H'")
    found = identified(results(spark, raw, cycle), people)
    survey = staged.acs(spark, [f"{raw}/{cycle}/acs/*.json"], cycle, states or {}).withColumnRenamed("state_abbr", "state")
    linked, ie = linkage(spark, raw, cycle), spending(spark, raw, cycle, cutoffs)
    sums, pvi = totals(contributions(spark, raw, cycle), linked, cutoffs), index(spark, raw, cycle)
    # Candidates without money are in every snapshot all the same.
    sums = people.select(F.lit(cycle).alias("cycle"), "cand_id").distinct().crossJoin(F.broadcast(cutoffs.select("snapshot", F.col("cutoff").alias("snapshot_date")))).join(sums, [*KEYS, "cand_id"], "left")  # a handful of snapshots
    out = None
    for snapshot, page in pages(spark, raw, cycle, snapshots, elections, revisions or {}).items():
        rated = ratings(spark, cycle, snapshot, page, least_rows)
        built = features.build(found, rated.withColumn("cycle", F.lit(cycle)), pvi, survey, sums.where(F.col("snapshot") == snapshot), ie)
        built = features.audited(built, page["ts"])
        out = built if out is None else out.unionByName(built, allowMissingColumns=True)
    return out
