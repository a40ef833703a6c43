"""Tables in HTML pages, as a Python UDTF on the standard library's parser, and what the rating pages hold."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallygrove.functions import text as fx

#: Rows that a page's ratings table has at least.
LEAST_ROWS = 50


class _Tables(HTMLParser):
    """tables: lists of rows, each of them a list of (text, is header) cells; a spanning cell counts in all its columns."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, bool]]]] = []
        self._open: list[list] = []
        self._cell: list[str] | None = None
        self._head, self._span = False, 1

    def _close_cell(self) -> None:
        if self._cell is not None and self._open and self._open[-1]:
            self._open[-1][-1] += [(" ".join("".join(self._cell).split()), self._head)] * self._span
        self._cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._open.append([])
        elif self._open and tag == "tr":
            self._close_cell()
            self._open[-1].append([])
        elif self._open and tag in ("td", "th"):
            self._close_cell()
            if not self._open[-1]:
                self._open[-1].append([])
            span = dict(attrs).get("colspan") or "1"
            self._cell, self._head, self._span = [], tag == "th", max(1, min(1000, int(span))) if span.isdigit() else 1
        elif tag == "br" and self._cell is not None:
            self._cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "table" and self._open:
            self._close_cell()
            self.tables.append([r for r in self._open.pop() if r])

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell.append(data)


def parse_tables(html: str | None) -> list[tuple[list[str], list[list[str]]]]:
    """(header, rows) of each table, inner ones first. The header is the last of the leading rows of header cells, or the first row."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for rows in parser.tables:
        n = 0
        while n < len(rows) and all(h for _, h in rows[n]):
            n += 1
        n = max(1, n)
        if rows:
            out.append(([c for c, _ in rows[n - 1]], [[c for c, _ in r] for r in rows[n:]]))
    return out


@udtf(returnType="table_no int, row_no int, header array<string>, cells array<string>")
class HtmlTables:
    """A row for each body row of each table of a page."""

    def eval(self, html: str):
        for t, (header, rows) in enumerate(parse_tables(html)):
            for r, cells in enumerate(rows):
                yield t, r, header, cells


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_tables", HtmlTables)


def tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but the page itself, with table_no, row_no, header and cells."""
    register(pages.sparkSession)
    keep = [f"p.`{c}`" for c in pages.columns if c != html]
    return pages.sparkSession.sql(f"SELECT {', '.join([*keep, 't.*'])} FROM {{pages}} p, LATERAL html_tables(p.`{html}`) t", pages=pages)


def role_of(column: str) -> str | None:
    """What a normalised column tells: the place, the index, or a forecaster's rating."""
    words = set(column.split("_"))
    if words & {"cpvi", "pvi"}:
        return "index"
    if words & {"district", "districts"} or column == "race":
        return "place"
    return "forecaster" if fx.forecaster_name(column) in MODELLED else None


#: Roles that a ratings table has a column for.
REQUIRED = {"place", "index", "forecaster"}
# The forecasters that a table must have one of, whose texts may also announce a change of party.
MODELLED = ("cook", "inside", "sabato")
#: Columns that are read besides the place: the output's name and how the text is read.
READ = {"cpvi": ("cpvi_signed", fx.signed_index), "incumbent_raw": ("incumbent_raw", F.trim)} | {n: (f"{n}_ordinal", fx.rating_ordinal) for n in fx.FORECASTERS.values() if n != "cnalysis"}


def pick_ratings_table(found: list[tuple[list[str], list[list[str]]]], least_rows: int = LEAST_ROWS) -> tuple[dict[str, int], dict[str, int], list[list[str]]] | None:
    """The first table of enough rows in which every role of REQUIRED is played: columns by role and by name (the first of each), and the rows."""
    for header, rows in found:
        names = [fx.header_name(h) for h in header]
        by_role, by_name = {}, {}
        for i in reversed(range(len(names))):
            by_role[role_of(names[i])] = i
            by_name["cpvi" if role_of(names[i]) == "index" else fx.forecaster_name(names[i])] = i
        if len(rows) >= least_rows and REQUIRED <= set(by_role):
            return by_role, by_name, rows
    return None


def ratings(spark: SparkSession, html: str, cycle: int, snapshot: str, revision_id: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One page's ratings: state, district, index, ordinals, incumbent and flip; ValueError if the page has no such table."""
    picked = pick_ratings_table(parse_tables(html), least_rows)
    if picked is None:
        raise ValueError(f"no ratings table for {cycle} {snapshot}, revision {revision_id}")
    by_role, by_name, body = picked
    page = spark.createDataFrame([(row,) for row in body], "cells array<string>")
    cell = {name: F.get("cells", F.lit(i)) for name, i in by_name.items()}
    told = {out: read(cell[name]) for name, (out, read) in READ.items() if name in cell}
    if said := [cell[n] for n in MODELLED if n in cell]:
        told["flip_predicted"] = fx.any_contains(said, "flip")
    place = fx.district_label(F.get("cells", F.lit(by_role["place"])))
    rows = page.select(place.alias("_place"), *(c.alias(n) for n, c in told.items())).where("_place is not null")
    return rows.select(F.col("_place.state").alias("state_abbr"), F.col("_place.district").alias("district"), *told, F.lit(cycle).alias("cycle"), F.lit(snapshot).alias("snapshot_date"), F.lit(revision_id).alias("revision_id"))


def archive_ratings(rows: DataFrame) -> DataFrame:
    """rows of tables(): one table of three columns for each rating, its first header the rating, its first body row skipped."""
    label = F.get("header", F.lit(0))
    code = F.trim(F.get("cells", F.lit(0)))
    kept = rows.where((F.size("header") == 3) & (F.size("cells") == 3) & (F.col("row_no") > 0) & code.rlike(r"^[A-Z]{2}-\d{1,2}$"))
    kept = kept.withColumn("cook_ordinal", fx.mapped(label, fx.ARCHIVE_RATINGS)).where("cook_ordinal is not null")
    keep = [c for c in rows.columns if c not in ("table_no", "row_no", "header", "cells")]
    return kept.select(*keep, F.substring(code, 1, 2).alias("state_abbr"), F.substring(code, 4, 2).cast("int").alias("district"), "cook_ordinal", label.alias("cook_rating_label"), F.trim(F.get("cells", F.lit(1))).alias("incumbent_raw"), F.trim(F.get("cells", F.lit(2))).alias("pvi_text"))
