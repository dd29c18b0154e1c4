"""Mailboxes as a stream that goes on where it stopped: no mail is lost, and each comes once.

The offset is, for each account, the last uid that was taken and the time of that check. The next check asks the server for
mails since that time less a day, as a server's dates are coarse, and takes those with a larger uid; what a batch
holds is fixed when it is planned, so that a batch that runs again after a failure reads the same mails. An account
that can't be reached keeps its place, and the others go on.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .. import attach
from ..sources import commits, storage
from ..sources.mailbox import since

SCHEMA = "account string, uid long, sent timestamp, content binary"
#: Mails of an account that one task fetches, one after the other.
FETCH = 1000
RETRIES = 2


class Server(Protocol):
    """A mail server of several accounts. It goes to the executors: connections are made where they are used."""

    def accounts(self) -> Iterable[str]: ...

    def uids(self, account: str, after: int, asked: dt.datetime | None) -> Iterable[int]:
        """Uids larger than ``after`` of the mails that arrived since ``asked``, in order."""

    def fetch(self, account: str, uids: list[int]) -> Iterable[tuple[int, dt.datetime | None, bytes]]:
        """``uid, sent, content`` of mails; one that is gone is left out."""


@dataclass
class _Fetch(InputPartition):
    account: str
    uids: list[int]


class _Reader(DataSourceStreamReader):
    def __init__(self, server: Server, most: int):
        self.server, self.most = server, most
        self.at: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far each account can be read now: uids are only listed, mails aren't fetched."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        for account in self.server.accounts():
            last = self.at.get(account, {})
            try:
                found = self._listed(account, last)
            except Exception as e:  # noqa: BLE001  this account is asked again next time
                self.at[account] = {"uid": last.get("uid", 0), "checked": last.get("checked"), "error": f"{type(e).__name__}: {e}"}
                continue
            self.at[account] = {"uid": max([last.get("uid", 0), *found]), "checked": now.isoformat(), "error": None}
        return {a: {"uid": v["uid"], "checked": v["checked"]} for a, v in self.at.items()}

    def _listed(self, account: str, last: dict, to: int | None = None) -> list[int]:
        checked = last.get("checked")
        asked = since(None, dt.datetime.fromisoformat(checked) if checked else None)
        found = sorted(u for u in self.server.uids(account, last.get("uid", 0), asked) if u > last.get("uid", 0) and (to is None or u <= to))
        return found[:self.most] if to is None else found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {a: {**v, "error": None} for a, v in end.items()}  # after a restart the stream goes on from here
        out: list[InputPartition] = []
        for account, to in end.items():
            last = start.get(account, {})
            if to["uid"] > last.get("uid", 0):
                uids = self._listed(account, last, to["uid"])
                out += [_Fetch(account, uids[i:i + FETCH]) for i in range(0, len(uids), FETCH)]
        return out

    def read(self, part: _Fetch) -> Iterator[tuple]:
        left = list(part.uids)
        for turn in range(RETRIES + 1):
            try:
                for uid, sent, content in self.server.fetch(part.account, left):
                    yield part.account, uid, sent, content
                    left = [u for u in left if u > uid]
                return
            except OSError:  # the connection is lost: the rest is fetched again
                if turn == RETRIES:
                    raise
                time.sleep(min(30.0, 0.1 * 2 ** turn))


def mails(spark: SparkSession, server: Server, most: int = 100_000) -> DataFrame:
    """A streaming frame of ``account, uid, sent, content``; at most ``most`` mails of an account in a batch, the rest in the next ones."""
    name = f"papyra_mails_{uuid.uuid4().hex[:12]}"

    class Mails(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Reader(server, most)

    attach(spark).dataSource.register(Mails)
    return spark.readStream.format(name).load()


def taken(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Takes what has arrived since the last run and ends; returns all mails that were taken so far."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class FolderServer:
    """A server over a folder: ``<account>/<first uid>-<last uid>.jsonl``, a line for each mail, in the order of uids."""

    def __init__(self, path: str):
        self.path = path

    def accounts(self) -> list[str]:
        return [n for n in storage.names(self.path) if not n.startswith(".")]

    def _parts(self, account: str, least: int, most: int | None = None) -> Iterator[tuple[int, int, str]]:
        for n in storage.names(f"{self.path}/{account}"):
            if n.endswith(".jsonl"):
                a, b = map(int, n.removesuffix(".jsonl").split("-"))
                if b >= least and (most is None or a <= most):
                    yield a, b, f"{self.path}/{account}/{n}"

    def uids(self, account: str, after: int, asked: dt.datetime | None) -> Iterator[int]:
        # a part's name tells its uids, without gaps: nothing is read
        for a, b, _ in self._parts(account, after + 1):
            yield from range(max(a, after + 1), b + 1)

    def fetch(self, account: str, uids: list[int]) -> Iterator[tuple[int, dt.datetime | None, bytes]]:
        wanted = set(uids)
        for _, _, path in sorted(self._parts(account, min(uids, default=0), max(uids, default=0))):
            for line in storage.get(path).splitlines():
                r = json.loads(line)
                if r["uid"] in wanted:
                    yield r["uid"], dt.datetime.fromisoformat(r["sent"]) if r["sent"] else None, r["content"].encode()


def delivered(rows: DataFrame, path: str, part: int = 10_000) -> None:
    """Puts ``account, uid, sent, content`` (texts) into a folder that ``FolderServer`` serves; uids of an account have no gaps."""
    line: Column = F.to_json(F.struct("uid", F.date_format("sent", "yyyy-MM-dd'T'HH:mm:ss").alias("sent"), "content"), {"ignoreNullFields": "false"})
    parts = rows.withColumn("line", line).groupBy("account", F.floor(F.col("uid") / part).alias("part")).agg(
        F.min("uid").alias("a"), F.max("uid").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "line"))), lambda x: x["line"]), "\n").alias("text"))
    commits.files(parts.select(F.concat_ws("/", "account", F.concat(F.lpad(F.col("a").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("b").cast("string"), 12, "0"), F.lit(".jsonl"))).alias("path"), F.encode("text", "utf-8").alias("content")), path)
