"""A data source that writes one text file per image, all or none of a job's files.

Tasks write to folders of their own below ``_jobs/<job>/<task attempt>``. Once all tasks are done, their files move to
``<split>/<image_stem>.txt``; a failed job's folder is removed, and what attempts that failed or ran twice left goes
with it. The folder is a path that the driver and all executors have mounted (no scheme but ``file:``).
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "split string, image_stem string, line string"


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task attempt and the number of its files."""

    folder: str
    files: int


def _name(value: str) -> str:
    """``value`` as the name of a file or folder."""
    if not value or value in (".", "..") or "/" in value or "\0" in value or value.startswith("_jobs"):
        raise ValueError(f"not a file name: {value!r}")
    return value


class LabelFileWriter(DataSourceWriter):
    """Rows come with the lines of a file in a row."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.job = os.path.join(folder, "_jobs", uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Written:
        own, files = os.path.join(self.job, uuid.uuid4().hex), 0
        at, out = None, None
        try:
            for row in iterator:
                if (row["split"], row["image_stem"]) != at:
                    if out is not None:
                        out.close()
                    at = row["split"], row["image_stem"]
                    folder = os.path.join(own, _name(at[0]))
                    os.makedirs(folder, exist_ok=True)
                    # A file that is there already means that its lines didn't come in a row.
                    out = open(os.path.join(folder, f"{_name(at[1])}.txt"), "x", encoding="utf-8")
                    files += 1
                if row["line"] is not None:
                    out.write(row["line"] + "\n")
        finally:
            if out is not None:
                out.close()
        return Written(own, files)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.files]
        splits = {split for m in done for split in os.listdir(m.folder)}
        if self.overwrite and os.path.isdir(self.folder):
            for split in os.listdir(self.folder):
                path = os.path.join(self.folder, split)
                if split != "_jobs" and os.path.isdir(path):
                    shutil.rmtree(path)
        for split in splits:
            os.makedirs(os.path.join(self.folder, split), exist_ok=True)
        for message in done:
            for split in os.listdir(message.folder):
                for entry in os.scandir(os.path.join(message.folder, split)):
                    os.replace(entry.path, os.path.join(self.folder, split, entry.name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
        jobs = os.path.dirname(self.job)
        # Other jobs may be writing.
        if os.path.isdir(jobs) and not os.listdir(jobs):
            os.rmdir(jobs)


class LabelFiles(DataSource):
    """``df.write.format("label_files").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> LabelFileWriter:
        path = self.options.get("path", "")
        path = path.removeprefix("file://").removeprefix("file:")
        if not os.path.isabs(path):
            raise ValueError(f"label files need an absolute path that all executors have mounted, not {path!r}")
        return LabelFileWriter(path, overwrite)
