"""Command line: ``python -m tallygrove COMMAND``, or the same under spark-submit."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.plans import backtest as bt
from tallygrove.plans import raw
from tallygrove.session import session
from tallygrove.sources import sinks, staged


def cycles(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def sinks_of_raw(spark: SparkSession, args: argparse.Namespace) -> None:
    """The commands that read raw files."""
    states = json.loads(spark.read.text(args.states, wholetext=True).first()[0]) if args.states else {}
    snapshots = tuple(args.snapshots.split(","))
    days = dates.cutoffs(spark, {args.cycle: dates.ELECTIONS[args.cycle]}).where(F.col("snapshot").isin(*snapshots))
    if args.command == "features":
        sinks.write_checked(raw.matrix(spark, args.raw, args.cycle, snapshots, states), args.out)
        return
    made = {
        "fec": lambda: raw.totals(raw.contributions(spark, args.raw, args.cycle), raw.linkage(spark, args.raw, args.cycle), days),
        "fec_ie": lambda: raw.spending(spark, args.raw, args.cycle, days),
        "results": lambda: raw.results(spark, args.raw, args.cycle),
        "pvi": lambda: raw.index(spark, args.raw, args.cycle),
        "census": lambda: staged.acs(spark, [f"{args.raw}/{args.cycle}/acs/*.json"], args.cycle, states),
        "ratings": lambda: raw.ratings(spark, args.cycle, snapshots[0], raw.pages(spark, args.raw.rstrip("/"), args.cycle, snapshots[:1], dates.ELECTIONS, {})[snapshots[0]]),
    }
    sinks.write_parquet(made[args.command](), args.out)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tallygrove", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--matrix", required=True, help="feature matrix, partitioned by cycle and snapshot")
    common.add_argument("--train", type=cycles, default=(2016, 2022))
    common.add_argument("--test", type=int, default=2024)
    common.add_argument("--snapshot", default="T-60")
    common.add_argument("--features", default="full")
    b = commands.add_parser("backtest", parents=[common])
    b.add_argument("--model", default="multi-quantile")
    b.add_argument("--combine", default="competitiveness")
    b.add_argument("--universe", default="all")
    b.add_argument("--n", type=int, default=10)
    b.add_argument("--reps", type=int, default=1000)
    b.add_argument("--log", help="JSON lines file to append to")
    c = commands.add_parser("calibrate", parents=[common])
    c.add_argument("--thresholds", help="JSON file for the decile cuts")
    c.add_argument("--out", help="folder for the three tables and the summary")
    c.add_argument("--without", type=int, help="training cycle left out in the ablation (the first)")
    c.add_argument("--reps", type=int, default=100)
    a = commands.add_parser("bake", parents=[common])
    a.add_argument("--out", required=True)
    a.add_argument("--thresholds")
    f = commands.add_parser("features", help="raw files to the matrix of a cycle")
    f.add_argument("--raw", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--cycle", type=int, required=True)
    f.add_argument("--snapshots", default="T-110,T-60,T-20")
    f.add_argument("--states", help="JSON file: FIPS code to postal code")
    for name, about in (("fec", "contributions by candidate"), ("fec_ie", "outside spending by candidate"), ("results", "votes and margins"), ("pvi", "signed indexes"), ("census", "the staged survey"), ("ratings", "ratings of a snapshot")):
        p = commands.add_parser(name, help=f"{about} of a cycle, as parquet")
        p.add_argument("--raw", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--cycle", type=int, required=True)
        p.add_argument("--snapshots", default="T-60")
        p.add_argument("--states", help="JSON file: FIPS code to postal code")
    args = top.parse_args(argv)
    spark = session()
    if hasattr(args, "raw"):
        sinks_of_raw(spark, args)
        return
    matrix = staged.processed(spark, args.matrix)
    if args.command == "backtest":
        row = bt.run(matrix, args.train, args.test, args.snapshot, args.features, args.model, args.combine, args.universe, args.n, args.reps)
        print(bt.report(row))
        if args.log:
            bt.append_json(row, args.log)
    elif args.command == "calibrate":
        tables = bt.calibrate(matrix, args.train, args.test, args.snapshot, args.without, feature_set=args.features, reps=args.reps)
        for name, df in tables.items():
            print(name, *(r.asDict() for r in df.collect()), sep="\n  ")  # a few rows each
        if args.out:
            sinks.write_calibration(tables, args.out)
        alpha = tables["summary"].first()["best_alpha"]
        if args.thresholds:
            baked = bt.bake(matrix, args.train, args.test, (args.snapshot,), feature_set=args.features, alpha=alpha)
            sinks.write_thresholds(args.thresholds, bt.deciles(baked, "impact"), alpha=alpha, cycles=list(args.train))
    else:
        cuts = sinks.read_thresholds(args.thresholds) if args.thresholds else None
        sinks.write_parquet(bt.bake(matrix, args.train, args.test, tuple(args.snapshot.split(",")), cuts, args.features), args.out)


if __name__ == "__main__":
    main()
