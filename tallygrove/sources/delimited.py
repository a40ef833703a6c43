"""Delimited sources: lenient pipe tables, headers kept apart, CSVs whose columns go by other names, quoted result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that the reader of pipe tables takes as missing.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The four bulk files of a cycle, (key, archive prefix, member).
BULK = (("indiv", "indiv", "itcont.txt"), ("pas", "pas2", "itpas2.txt"), ("ccl", "ccl", "ccl.txt"), ("cn", "cn", "cn.txt"))


def bulk_paths(raw_dir: str, cycle: int) -> dict[str, tuple[str, str]]:
    """key: (data path, header path) of each bulk file of a cycle."""
    base = f"{raw_dir.rstrip('/')}/{cycle}/fec"
    return {key: (f"{base}/{key}.txt", f"{base}/{key}_headers.csv") for key, _, _ in BULK}


def headers(spark: SparkSession, path: str) -> list[str]:
    """The names in a one-line CSV."""
    return [x.strip().strip('"') for x in spark.read.text(path).first()[0].split(",")]


def split_lines(lines: DataFrame, names: list[str], separator: str = "|") -> DataFrame:
    """lines: value. All-text columns; a row with too many fields is dropped, one with too few padded with nulls."""
    fields = F.split("value", "\\Q" + separator + "\\E", -1)
    rows = lines.where(F.length("value") > 0).select(fields.alias("_f")).where(F.size("_f") <= len(names))
    column = [F.get("_f", F.lit(i)) for i in range(len(names))]
    return rows.select(*(F.when(~c.isin(*NULLS), c).alias(n) for c, n in zip(column, names, strict=True)))


def pipe_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A headerless pipe-delimited file of any size; Spark splits it itself, so there are no chunks to carry over."""
    return split_lines(spark.read.text(path), names)


def csv_renamed(spark: SparkSession, path: str, renames: dict[str, str], required: list[str]) -> DataFrame:
    """A CSV with a header in any case: known names become canonical; KeyError if one of ``required`` is missing."""
    df = spark.read.csv(path, header=True)
    found = {c: renames[c.lower()] for c in df.columns if c.lower() in renames}
    if missing := sorted(set(required) - set(found.values())):
        raise KeyError(f"missing columns: {missing}")
    return df.withColumnsRenamed(found)


def find_column(names: list[str], keywords: list[str]) -> str | None:
    """Of the names that hold a keyword, in any case, the one that comes first."""
    for name in names:
        folded = name.casefold()
        for word in keywords:
            if folded.find(word) >= 0:
                return name
    return None


def csv_located(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """wanted: canonical name to keywords; each column is the first whose name holds one."""
    df = spark.read.csv(path, header=True)
    found = {name: find_column(df.columns, keys) for name, keys in wanted.items()}
    if missing := [n for n, c in found.items() if c is None]:
        raise KeyError(f"no column for {missing} among {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def quoted_rows(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A comma-separated file whose data rows are wrapped in outer quotes, inner ones doubled; all columns are text.

    names: the columns, if they are not those of the first line. Header lines and rows of another number of fields go.
    """
    lines = spark.read.text(path)
    names = names or [x.strip().strip('"') for x in lines.first()[0].strip().strip('"').split(",")]
    bare = F.regexp_replace(F.regexp_replace("value", r'^"(.*)"$', "$1"), '""', '"')
    rows = lines.where(F.lower(F.regexp_replace("value", '"', "")) != ",".join(names).lower()).where(F.length("value") > 0)
    schema = ", ".join(f"`{n}` string" for n in [*names, "_more"])
    parsed = rows.select(F.from_csv(bare, schema, {"mode": "PERMISSIVE"}).alias("_r"), F.size(F.split(F.regexp_replace(bare, '"[^"]*"', ""), ",")).alias("_n"))
    return parsed.where(F.col("_n") == len(names)).select(*(F.col(f"_r.`{n}`").alias(n) for n in names))


def or_empty(read, schema: str, spark: SparkSession) -> DataFrame:
    """What ``read()`` gives, or an empty table of ``schema`` if it fails: for small sources that a build can do without.

    Whether it can be read shows only in a pass over all of it, so the source is counted once.
    """
    try:
        df = read()
        df.count()
        return df
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], schema)
