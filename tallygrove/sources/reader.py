"""Staged sources as data sources of their own: ``spark.read.format("staged_survey")`` and ``format("staged_pages")``.

Each plans one partition a file, and what names the files is settled before any is opened: a survey's states by its files, and
a log's times by the log, so that an as-of cutoff opens one page. The cuts are options of the read. Pushed filters would say
the same, but Spark keeps what was pushed with the loaded source, so that a second use of the same table with another filter,
or with none, would read by the first one's. Paths are folders that all executors reach, on any file system that Arrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallygrove.sources.staged import ACS


def _at(path: str):
    """A file system of Arrow and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _text(path: str) -> str:
    """A file's text, or that of a folder's files, as Spark writes them."""
    from pyarrow import fs

    system, where = _at(path)
    whole = [where]
    if system.get_file_info(where).type == fs.FileType.Directory:
        whole = sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.is_file and not f.base_name.startswith(("_", ".")))
    out = []
    for name in whole:
        with system.open_input_stream(name) as f:
            out.append(f.read().decode())
    return "".join(out)


@dataclass
class File(InputPartition):
    """One file and what its name says."""

    path: str
    key: str
    stamp: str = ""


class _SurveyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, where = _at(self.options["path"])
        only, out = json.loads(self.options.get("only", "null")), []
        for f in system.get_file_info(fs.FileSelector(where, recursive=True)):
            named = re.search(r"(?:^|/)(?:state=)?(\d+)(?:\.json|/[^/]+)$", f.path[len(where) :])
            if f.is_file and named and not f.base_name.startswith(("_", ".")) and (only is None or named[1].zfill(2) in only):
                out.append(File(self.options["path"].rstrip("/") + f.path[len(where.rstrip("/")) :], named[1].zfill(2)))
        return sorted(out, key=lambda p: p.path)

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one task where there is no file
            return
        names, *rows = json.loads(_text(partition.path))
        states, cycle = json.loads(self.options.get("states", "{}")), int(self.options["cycle"])

        def number(kind: type, text: object) -> float | int | None:
            try:
                return kind(text)
            except (TypeError, ValueError):
                return None

        for row in rows:
            cell = dict(zip(names, row, strict=False))
            yield cell.get("NAME"), *(number(float, cell.get(v)) for v in ACS), partition.key, states.get(partition.key), number(int, cell.get("congressional district")), cycle


class Survey(DataSource):
    """Survey responses, a JSON array of rows for each state. Options: path, cycle, states (JSON: code to postal code), only (JSON: codes)"""

    @classmethod
    def name(cls) -> str:
        return "staged_survey"

    def schema(self) -> str:
        return "NAME string, " + "".join(f"{n} double, " for n in ACS.values()) + "state_fips string, state_abbr string, district int, cycle int"

    def reader(self, schema) -> DataSourceReader:
        return _SurveyReader(dict(self.options))


def stamp_of(text: str) -> str:
    """``YYYYMMDDHHMMSS`` of such a stamp or of an ISO time in UTC."""
    return text if re.fullmatch(r"\d{14}", text) else datetime.fromisoformat(text.replace("Z", "+00:00")).strftime("%Y%m%d%H%M%S")


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        base = self.options["path"].rstrip("/")
        rows = [json.loads(line) for line in _text(f"{base}/{self.options.get('log', 'revisions.jsonl')}").splitlines() if line.strip()]
        where = f"{base}/{self.options.get('pages', 'pages/{page}.html')}"
        named = [(str(r.get("rev", r["ts"])), stamp_of(r["ts"])) for r in rows]
        found = [File(where.replace("{page}", key), key, stamp) for key, stamp in named]
        found = sorted((f for f in found if self.options.get("since", "") <= f.stamp <= self.options.get("upto", "9" * 14)), key=lambda f: (f.stamp, f.key))  # a row of the log each
        return found[-1:] if self.options.get("last", "false").lower() == "true" else found

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:
            yield partition.key, partition.stamp, _text(partition.path)


class Pages(DataSource):
    """Pages kept under a log of their times. Options: path, log and pages (names in it; {page} stands for the key), since and upto (stamps, both included), last (only the last of these)."""

    @classmethod
    def name(cls) -> str:
        return "staged_pages"

    def schema(self) -> str:
        return "page string, stamp string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(dict(self.options))


def survey(spark: SparkSession, path: str, cycle: int, states: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """A row for each district; ``only``: of these states (codes of two digits), and no other state's file is opened."""
    spark.dataSource.register(Survey)
    cut = {} if only is None else {"only": json.dumps(sorted(only))}
    return spark.read.format(Survey.name()).options(path=path, cycle=str(cycle), states=json.dumps(states), **cut).load()


def pages(spark: SparkSession, path: str, since: str | None = None, upto: str | None = None, last: bool = False, **names: str) -> DataFrame:
    """page, stamp and html of the pages whose time lies between two stamps, or of the last of them: as of ``upto``."""
    spark.dataSource.register(Pages)
    cut = {k: v for k, v in (("since", since), ("upto", upto)) if v is not None}
    return spark.read.format(Pages.name()).options(path=path, last=str(last).lower(), **cut, **names).load()
