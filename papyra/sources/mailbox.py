"""Mailboxes: the search, and the fetch of every account by a given function, each account on its own."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import totals_within
from ..functions.files import numbered

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def search(unseen: bool = False, since: dt.date | None = None, sender: str | None = None, subject: str | None = None) -> str:
    """What a mail server is asked: the conditions that are given, all of them; none is ALL. Quotes in texts are escaped."""
    text = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = (["UNSEEN"] if unseen else []) + ([f'SINCE "{since.day:02d}-{MONTHS[since.month - 1]}-{since.year}"'] if since else [])
    parts += ([f"FROM {text(sender)}"] if sender else []) + ([f"SUBJECT {text(subject)}"] if subject else [])
    return " ".join(parts) or "ALL"


def since(asked: dt.datetime | None, last: dt.datetime | None) -> dt.datetime | None:
    """Where a fetch begins: as asked, else a day before the last one, else at the beginning."""
    return asked or (last - dt.timedelta(days=1) if last else None)


def fetched(spark: SparkSession, accounts: list[dict], fetch: Callable[[dict, str], Iterable[tuple[str, bytes]]], query: str = "ALL") -> DataFrame:
    """``account, uid, content, error`` of all accounts together: ``fetch(account, query)`` gives (uid, message); an
    account that fails is a row with an error, the others go on. A task for each account."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for k in d["k"]:
                a, rows = accounts[k], []
                try:
                    for uid, content in fetch(a, query):
                        rows.append((a["account"], str(uid), bytes(content), None))
                        if len(rows) >= 100:
                            yield pd.DataFrame(rows, columns=["account", "uid", "content", "error"], dtype=object)
                            rows = []
                except Exception as e:  # noqa: BLE001  told in the row
                    rows.append((a["account"], None, None, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=["account", "uid", "content", "error"], dtype=object)

    n = max(1, len(accounts))
    return spark.createDataFrame([(k,) for k in range(len(accounts))], "k int").repartition(n, "k").mapInPandas(run, "account string, uid string, content binary, error string")


def unprocessed(mails: DataFrame, done: DataFrame) -> DataFrame:
    """Mails whose account and uid were not processed before."""
    return mails.join(done.select("account", "uid").distinct(), ["account", "uid"], "left_anti")


def attachment_files(attachments: DataFrame) -> DataFrame:
    """``directory, filename, content`` with ``path``: files of one name in a directory get a counter, in the order of ``uid``, which tells
    them apart. Files of a common name needn't meet in one task."""
    d = totals_within(attachments, ["directory", "filename"], ["uid"], {"_turn": F.lit(1).cast("long")})
    return d.withColumn("path", F.concat_ws("/", "directory", numbered(F.col("filename"), F.col("_turn") - 1))).drop("_turn")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes ``path, content`` under a shared local or mounted folder, each file beside its place first and then renamed,
    so that a task that runs again leaves whole files. Returns ``path, bytes``; nothing is written until it is read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for d in parts:
            size = []
            for path, content in zip(d["path"], d["content"]):
                full = os.path.normpath(os.path.join(root, path))
                if os.path.commonpath([full, root]) != os.path.normpath(root):
                    raise ValueError(f"{path} lies outside the folder")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(f"{full}.{os.getpid()}.part", "wb") as f:
                    f.write(content)
                os.replace(f.name, full)
                size.append(len(content))
            yield pd.DataFrame({"path": d["path"].to_numpy(), "bytes": size})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long")
