"""A paged source: a service that hands out rows page by page, read as a table, a task for a few pages.

What the service is, a caller says with a client (``pages`` and ``rows``); conditions of a read that it can judge are pushed
down to it, so that only pages that may hold such rows are asked for. ``FilePages`` is a client over pages in a folder.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, IntegralType, StringType, StructType

from .. import attach, numbered, written
from . import storage

#: Rows of a page, and pages that a task reads one after the other.
PAGE, PAGES = 100, 16
#: What a condition that can be pushed down is called, and how it is judged.
KINDS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
TESTS: dict[str, Callable[[Any, Any], bool]] = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda x, y: x in y}
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

Condition = tuple[str, str, Any]


class Client(Protocol):
    """What a paged service can do. Clients go to the executors: connections are made where they are used."""

    #: Columns whose conditions the service judges itself.
    filterable: set[str]

    def pages(self, conditions: list[Condition]) -> Iterable[int]:
        """The numbers of pages that may hold rows for all conditions."""

    def rows(self, page: int, conditions: list[Condition]) -> Iterable[tuple]:
        """The rows of a page for which all conditions hold, as tuples of the schema's columns."""


@dataclass
class _Pages(InputPartition):
    numbers: list[int]


class _Reader(DataSourceReader):
    def __init__(self, client: Client, conditions: list[Condition], per_task: int, retries: int, on_error: str, columns: int):
        self.client, self.conditions, self.per_task, self.retries, self.on_error, self.columns = client, conditions, per_task, retries, on_error, columns

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """The service judges the frame's own conditions; what else a query asks is Spark's, as Spark may share one reader between
        several scans of a frame."""
        for f in filters:
            asked = (f.attribute[0], KINDS[type(f)], list(f.value) if type(f) is In else f.value) if type(f) in KINDS and len(f.attribute) == 1 else None
            if asked not in self.conditions:
                yield f

    def partitions(self) -> list[InputPartition]:
        numbers = list(self.client.pages(self.conditions))
        return [_Pages(numbers[i:i + self.per_task]) for i in range(0, len(numbers), self.per_task)] or [_Pages([])]

    def read(self, part: _Pages) -> Iterator[tuple]:
        for n in part.numbers:
            try:
                for row in self._page(n):
                    yield (*row, n, None)
            except Exception as e:  # noqa: BLE001  told in the row
                if self.on_error == "raise":
                    raise
                yield (*[None] * self.columns, n, f"{type(e).__name__}: {e}")

    def _page(self, n: int) -> list[tuple]:
        """A whole page, or an error: never the first rows of one that breaks off."""
        for turn in range(self.retries + 1):
            try:
                return list(self.client.rows(n, self.conditions))
            except Exception:  # noqa: BLE001  the last one is raised
                if turn == self.retries:
                    raise
                time.sleep(min(30.0, 0.1 * 2 ** turn))
        return []


def _held(c: Condition) -> Column:
    column, op, value = c
    x = F.col(column)
    return x.isin(value) if op == "in" else TESTS[op](x, F.lit(value))


def paged(spark: SparkSession, client: Client, schema: StructType, conditions: Iterable[Condition] = (), per_task: int = PAGES, retries: int = 2, on_error: str = "raise") -> DataFrame:
    """The rows of all pages for which all ``conditions`` (column, one of = > >= < <= in, value) hold, with ``_page`` and ``_error``.

    Conditions on columns that the client can filter are pushed down to it, and only pages that it then names are asked for;
    others are Spark's, as is whatever is put on the frame. Nothing holds for a null. A page that fails is asked ``retries`` times
    more, then the read fails, or, with ``on_error="keep"``, it is a row of nulls with its number and the error: see ``until_error``.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError(f"on_error is raise or keep, not {on_error}")
    conditions = list(conditions)
    if odd := [c for c in conditions if c[1] not in TESTS or c[0] not in schema.names or c[2] is None]:
        raise ValueError(f"not a condition: {odd[0]}")
    attach(spark).conf.set(_PUSHDOWN, "true")
    name = f"papyra_pages_{uuid.uuid4().hex[:12]}"
    whole = StructType([*schema.fields]).add("_page", "long").add("_error", "string")
    pushed = [c for c in conditions if c[0] in client.filterable]

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return whole

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(client, pushed, per_task, retries, on_error, len(whole) - 2)

    spark.dataSource.register(Pages)
    out = spark.read.format(name).load()
    for c in conditions if on_error == "raise" else [c for c in conditions if c not in pushed]:  # a failed page's row has nulls
        out = out.where(_held(c) if on_error == "raise" else _held(c) | F.col("_error").isNotNull())
    return out


def until_error(rows: DataFrame) -> DataFrame:
    """The rows of the pages before the first that failed: what a reader gets that asks for one page after the other."""
    first = rows.where(F.col("_error").isNotNull()).agg(F.min("_page").alias("_first"))
    return rows.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col("_page") < F.col("_first"))).drop("_first", "_page", "_error")


# --- pages in a folder

def _told(value: Any) -> Any:
    return value.isoformat() if isinstance(value, dt.date) else value


def _asked(value: Any) -> Any:
    return [_told(v) for v in value] if isinstance(value, list) else _told(value)


class FilePages:
    """Pages as files of JSON lines, and an index with the least and greatest value of some columns in each."""

    def __init__(self, path: str, schema: StructType, index: list[str]):
        if odd := [c for c in index if not isinstance(schema[c].dataType, (DateType, IntegralType, StringType))]:
            raise ValueError(f"an index takes whole numbers, strings and dates, not {', '.join(odd)}")
        self.path, self.names, self.filterable = path, schema.names, set(index)
        self.dates = {f.name for f in schema.fields if isinstance(f.dataType, DateType)}

    def pages(self, conditions: list[Condition]) -> Iterator[int]:
        for name in storage.names(f"{self.path}/index"):
            if not name.startswith("part-"):
                continue
            for line in storage.get(f"{self.path}/index/{name}").splitlines():
                r = json.loads(line)
                if all(self._may(r.get(f"least_{c}"), r.get(f"most_{c}"), op, _asked(value)) for c, op, value in conditions):
                    yield r["page"]

    @staticmethod
    def _may(least: Any, most: Any, op: str, value: Any) -> bool:
        if least is None:  # nulls only: no comparison holds
            return False
        if op == "in":
            return any(least <= v <= most for v in value)
        return {"=": least <= value <= most, ">": most > value, ">=": most >= value, "<": least < value, "<=": least <= value}[op]

    def rows(self, page: int, conditions: list[Condition]) -> Iterator[tuple]:
        for name in storage.names(f"{self.path}/pages/_page={page}"):
            if not name.startswith("part-"):
                continue
            for line in storage.get(f"{self.path}/pages/_page={page}/{name}").splitlines():
                r = json.loads(line)
                if all(r.get(c) is not None and TESTS[op](r[c], _asked(value)) for c, op, value in conditions):
                    yield tuple(self._value(c, r.get(c)) for c in self.names)

    def _value(self, column: str, value: Any) -> Any:
        return dt.date.fromisoformat(value) if column in self.dates and value is not None else value


def laid_down(rows: DataFrame, path: str, order: list[str], index: list[str], page: int = PAGE) -> FilePages:
    """Writes rows as pages in the order of some columns, and the index; returns a client for them.

    Null values of the order come first.
    """
    placed = numbered(rows, order, "_place")
    told = written(placed.withColumn("_page", F.floor(F.col("_place") / page)).drop("_place"), "pages")
    told.repartition("_page").write.partitionBy("_page").option("ignoreNullFields", "false").json(f"{path}/pages")
    ends = [f(c).alias(f"{k}_{c}") for c in index for k, f in (("least", F.min), ("most", F.max))]
    told.groupBy(F.col("_page").alias("page")).agg(*ends).orderBy("page").write.json(f"{path}/index")
    return FilePages(path, rows.schema, index)
