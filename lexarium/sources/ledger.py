"""A transactional folder of JSON lines as a Python data source: tasks write files, the driver's commit names them.

Readers see only files that a commit names, so a failed task or job leaves no row.  A stream's commit has its batch's number as name: a batch that is run again finds it there and leaves nothing of its own, so every batch counts
exactly once.  Files lie under ``data``, commits under ``commits``; both in any file system that Arrow opens."""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .files import store_of


def registered(spark: SparkSession) -> None:
    """Make ``format("ledger")`` known to a session."""
    spark.dataSource.register(LedgerSink)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class LedgerSink(DataSource):
    """``format("ledger")`` with option ``path``, and ``stream``, a name that tells streams into one folder apart."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return _Writer(self.options["path"], "")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], self.options.get("stream") or "stream")


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep="T")
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return str(value)
    raise TypeError(f"{type(value).__name__} has no JSON form here")


class _Folder:
    def __init__(self, path: str, stream: str):
        self.path, self.stream = path, stream

    def write(self, iterator: Iterator[Row]) -> _Written:
        """A task's rows as a file of its own; none for no rows. If it fails, what it wrote goes, and would be seen by nobody if it couldn't."""
        first = next(iterator, None)
        if first is None:
            return _Written(None, 0)
        store, base = store_of(self.path)
        store.create_dir(f"{base}/data", recursive=True)
        name, n = f"data/{uuid.uuid4().hex}.jsonl", 0
        try:
            with store.open_output_stream(f"{base}/{name}") as out:
                row: Row | None = first
                while row is not None:
                    out.write((json.dumps(row.asDict(recursive=True), default=_plain, ensure_ascii=False) + "\n").encode())
                    n, row = n + 1, next(iterator, None)
        except BaseException:
            store.delete_file(f"{base}/{name}")
            raise
        return _Written(name, n)

    def _commit(self, name: str, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.path)
        at = f"{base}/commits/{name}.json"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            self._drop(messages)  # this batch was committed before
            return
        store.create_dir(f"{base}/commits", recursive=True)
        held = f"{base}/commits/.{uuid.uuid4().hex}"
        with store.open_output_stream(held) as out:
            out.write(json.dumps({"files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        store.move(held, at)

    def _drop(self, messages: list[_Written | None]) -> None:
        store, base = store_of(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{base}/{m.file}")


class _Writer(_Folder, DataSourceWriter):
    def commit(self, messages: list[_Written | None]) -> None:
        self._commit(uuid.uuid4().hex, messages)

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(messages)


class _StreamWriter(_Folder, DataSourceStreamWriter):
    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        self._commit(f"{self.stream}-{batchId:012d}", messages)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self._drop(messages)


def _committed(path: str) -> list[str]:
    """Files that commits name."""
    from pyarrow import fs

    store, base = store_of(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    names = []
    for commit in sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".json")):
        with store.open_input_stream(commit) as f:
            names += json.loads(f.read())["files"]
    return names


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of all committed files."""
    names = _committed(path)
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(shape).json([f"{path.rstrip('/')}/{n}" for n in names]) if names else spark.createDataFrame([], shape)


def vacuumed(path: str) -> int:
    """Delete files that no commit names, those of lost executors; how many. To be called when nothing is being written."""
    from pyarrow import fs

    store, base = store_of(path)
    wanted = {n.rpartition("/")[2] for n in _committed(path)}
    lost = [i.path for i in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)) if i.base_name not in wanted]
    for at in lost:
        store.delete_file(at)
    return len(lost)
