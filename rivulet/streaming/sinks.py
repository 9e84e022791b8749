"""A sink that appends JSON lines, each micro-batch once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    part: int
    staged: str
    lines: int


class JsonLog(DataSource):
    """``writeStream.format("json_log").option("path", uri)``: a folder of JSON lines with sorted keys, in a store that pyarrow opens by its URI."""

    @classmethod
    def name(cls) -> str:
        return "json_log"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return JsonLogWriter(self.options["path"])


class JsonLogWriter(DataSourceStreamWriter):
    """Tasks write beside the log; the driver's commit renames their files to names made of batch and part.

    A batch that runs again after a restart gets the same names, so its lines replace
    those of the first attempt, and files of parts that are no longer there go.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        store, base = pafs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        staged = f"{base}/_staged/{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}.jsonl"
        store.create_dir(f"{base}/_staged", recursive=True)
        n = 0
        with store.open_output_stream(staged) as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), sort_keys=True, separators=(",", ":"), default=str) + "\n").encode())
                n += 1
        return Written(task.partitionId(), staged, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        wanted = {f"{base}/batch-{batchId:09d}-{m.part:05d}.jsonl": m.staged for m in messages if m and m.lines}
        for old in store.get_file_info(pafs.FileSelector(base)):
            if old.base_name.startswith(f"batch-{batchId:09d}-") and old.path not in wanted:
                store.delete_file(old.path)
        for name, staged in wanted.items():
            store.move(staged, name)
        for m in messages:
            if m and not m.lines:
                store.delete_file(m.staged)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(m.staged)
