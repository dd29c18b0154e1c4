"""Sinks that are there whole or not at all: tasks write beside the place, and the commit of the job puts it there.

A task writes under ``<path>/.staging/<job>``; what tasks that failed or ran twice have written is not named in the
commit and goes with that folder. A job that fails leaves nothing but what was there before; tasks of it that were still
running when it was given up may leave files under ``.staging``, which ``cleaned`` removes.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import attach, small_batches
from . import storage
from .sinks import BOM, cell, header

#: Bytes up to which the parts of a report are put into one file by the driver, a block at a time.
ONE_FILE = 1 << 30
#: Renames that the commit has under way.
RENAMES = 16


@dataclass
class _Part(WriterCommitMessage):
    #: The number of the task, the file that it wrote (for files: the list of them), rows or files, and bytes.
    number: int
    name: str
    rows: int
    size: int


class _Staged(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex[:12]
        self.staging = f"{self.path}/.staging/{self.job}"

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        storage.delete(self.staging)
        if not storage.names(f"{self.path}/.staging"):
            storage.delete(f"{self.path}/.staging")

    @staticmethod
    def _attempt() -> tuple[int, str]:
        t = TaskContext.get()
        return t.partitionId(), f"{t.partitionId():06d}-{t.taskAttemptId()}"


class _Lines(_Staged):
    """Rows of text, in the order of the tasks: after ``first``, with ``between`` between two of them, before ``last``, in which
    ``{rows}`` stands for their number."""

    def __init__(self, path: str, name: str, first: str, between: str, last: str, most: int):
        super().__init__(path)
        self.name, self.first, self.between, self.last, self.most = name, first.encode(), between.encode(), last, most

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        number, attempt = self._attempt()
        fs, folder = storage.at(self.staging)
        fs.create_dir(folder, recursive=True)
        rows = size = 0
        with fs.open_output_stream(f"{folder}/{attempt}") as f:
            for row in iterator:
                line = (self.between if rows else b"") + row[0].encode()
                f.write(line)
                rows, size = rows + 1, size + len(line)
        return _Part(number, attempt, rows, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        fs, folder = storage.at(self.staging)
        fs.create_dir(folder, recursive=True)
        goal = storage.at(self.path)[1]
        last = self.last.replace("{rows}", str(sum(p.rows for p in parts))).encode() if parts or "{rows}" in self.last else b""
        if sum(p.size for p in parts) <= self.most:
            with fs.open_output_stream(f"{folder}/whole") as f:
                f.write(self.first)
                for k, p in enumerate(parts):
                    f.write(self.between if k else b"")
                    for block in storage.blocks(f"{self.staging}/{p.name}"):
                        f.write(block)
                f.write(last)
            fs.move(f"{folder}/whole", f"{goal}/{self.name}")
        else:  # a folder of parts that are the file, one after the other
            fs.create_dir(f"{folder}/all")
            for k, text in enumerate([self.first, *[self.between] * (len(parts) - 1), last]):
                with fs.open_output_stream(f"{folder}/all/part-{2 * k:06d}") as f:
                    f.write(text)
            for k, p in enumerate(parts):
                fs.move(f"{folder}/{p.name}", f"{folder}/all/part-{2 * k + 1:06d}")
            storage.delete(f"{self.path}/{self.name}")
            fs.move(f"{folder}/all", f"{goal}/{self.name}")
        self._clear()


class _Files(_Staged):
    """``path, content``: each row a file. Tasks write them and a list; the commit renames what the lists name."""

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        number, attempt = self._attempt()
        fs, folder = storage.at(f"{self.staging}/{attempt}")
        fs.create_dir(folder, recursive=True)
        files = size = 0
        with fs.open_output_stream(f"{folder}.list") as told:
            for path, content in iterator:
                inside = posixpath.normpath(path)
                if inside.startswith(("/", "..")) or inside == "." or inside.split("/", 1)[0] == ".staging":
                    raise ValueError(f"{path} lies outside the folder")
                fs.create_dir(posixpath.dirname(f"{folder}/{inside}"), recursive=True)
                with fs.open_output_stream(f"{folder}/{inside}") as f:
                    f.write(bytes(content))
                told.write(json.dumps([inside, len(content)]).encode() + b"\n")
                files, size = files + 1, size + len(content)
        return _Part(number, attempt, files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, goal = storage.at(self.path)
        staging = storage.at(self.staging)[1]
        parts = [m for m in messages if m is not None]

        def renamed(task: str) -> Iterator[tuple[str, str]]:
            with fs.open_input_stream(f"{staging}/{task}.list") as told:
                rest = b""
                while block := told.read(storage.BLOCK):
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        inside = json.loads(line)[0]
                        yield f"{staging}/{task}/{inside}", f"{goal}/{inside}"

        made: set[str] = set()

        def move(pair: tuple[str, str]) -> None:
            folder = posixpath.dirname(pair[1])
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(*pair)

        with ThreadPoolExecutor(RENAMES) as pool:
            for p in parts:
                held: list = []
                for pair in renamed(p.name):
                    held.append(pair)
                    if len(held) == 1024:  # a bounded number is under way
                        list(pool.map(move, held))
                        held = []
                list(pool.map(move, held))
        storage.put(f"{self.path}/.commits/{self.job}.json", json.dumps({"files": sum(p.rows for p in parts), "bytes": sum(p.size for p in parts)}).encode())
        self._clear()


def _source(spark: SparkSession, kinds: str, writer) -> str:
    name = f"papyra_commit_{uuid.uuid4().hex[:12]}"

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kinds

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return writer

    attach(spark).dataSource.register(Sink)
    return name


def csv_file(df: DataFrame, folder: str, name: str, german: bool = True, one_file: int = ONE_FILE) -> None:
    """One CSV file in a shared folder, in the order of the frame's partitions (order it first): a byte order mark, the header and the
    flat cells, quoted where needed. It replaces one of the same name when all is written. Beyond ``one_file`` bytes it is a folder of
    that name, whose parts are the file one after the other. Without rows it is the header alone."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[quoted(cell(df, c)) for c in df.columns])
    first = BOM + header(df, german) + "\n"
    kind = _source(df.sparkSession, "value string", _Lines(folder, name, first, "\n", "\n", one_file))
    df.select(line.alias("value")).write.format(kind).mode("append").save()


def json_file(df: DataFrame, folder: str, name: str, generated_at: str, version: str = "1.0.0", one_file: int = ONE_FILE) -> None:
    """One JSON file in the same way: ``data``, the rows, and ``metadata``, with when, by what and how many."""
    told = json.dumps({"generated_at": generated_at, "generator": "papyra", "version": version}, ensure_ascii=False)
    last = f'\n], "metadata": {told[:-1]}, "record_count": {{rows}}}}}}\n'
    kind = _source(df.sparkSession, "value string", _Lines(folder, name, '{"data": [\n', ",\n", last, one_file))
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.format(kind).mode("append").save()


def files(df: DataFrame, folder: str) -> None:
    """``path, content``, and other columns, which lie beside each file as ``<path>.json``: files in a shared folder, all or none.

    Files of the same path are replaced; of one path in several rows any one stays (see ``mailbox.attachment_files``, which
    numbers them). Rows without a path or content are an error."""
    rest = [c for c in df.columns if c not in ("path", "content")]
    content = F.col("content").cast("binary")
    rows = [F.struct(F.assert_true(F.col("path").isNotNull() & F.col("content").isNotNull(), "a file without a path or content").alias("ok"), F.col("path"), content.alias("content"))]
    if rest:
        rows.append(F.struct(F.lit(None).cast("void").alias("ok"), F.concat("path", F.lit(".json")).alias("path"), F.to_json(F.struct(*rest)).cast("binary").alias("content")))
    told = df.select(F.explode(F.array(*rows)).alias("f")).select("f.ok", "f.path", "f.content").where("ok is null").select("path", "content")
    kind = _source(df.sparkSession, "path string, content binary", _Files(folder))
    with small_batches(df.sparkSession):  # a batch of whole files would hold up to 64 MB, several times over, in each task
        told.write.format(kind).mode("append").save()


def committed(folder: str) -> list[dict]:
    """Files and bytes of each job that was committed to a folder of files."""
    return [json.loads(storage.get(f"{folder}/.commits/{n}")) for n in storage.names(f"{folder}/.commits") if n.endswith(".json")]


def cleaned(folder: str) -> int:
    """Removes what jobs whose driver was lost have left, when none is running; returns how many there were."""
    left = storage.names(f"{folder}/.staging")
    with contextlib.suppress(FileNotFoundError):
        storage.delete(f"{folder}/.staging")
    return len(left)


def stored(folder: str) -> Iterator[tuple[str, int]]:
    """The files in a folder and their sizes, without those of the sink itself."""
    fs, top = storage.at(folder)
    for i in fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)):
        inside = i.path[len(top) + 1:]
        if i.type == pafs.FileType.File and not inside.startswith((".staging", ".commits")):
            yield inside, i.size
