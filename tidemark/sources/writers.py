"""A sink that users can write their own kind of: a Python data source whose tasks write files and whose commit names them.

`DayFiles` writes JSON lines, a file for each task; the manifest, written when all tasks are done, names the files and
counts their rows, so readers never see those of a task that failed or ran twice. Derive from it and override `line` for
another format.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_MANIFEST.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class DayFileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def line(self, row) -> str:
        plain = lambda v: float(v) if isinstance(v, Decimal) else v.isoformat() if isinstance(v, (date, datetime)) else v
        return json.dumps({k: plain(v) for k, v in row.asDict().items()}, ensure_ascii=False)

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        with open(f"{self.path}/{name}", "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(self.line(row) + "\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        with open(f"{self.path}/{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump({"files": [m.file for m in messages if m], "rows": sum(m.rows for m in messages if m)}, f)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(f"{self.path}/{m.file}"):
                os.remove(f"{self.path}/{m.file}")


class DayFiles(DataSource):
    """df.write.format("day_files").option("path", ...).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self):
        raise NotImplementedError("day_files are read by read_day_files")

    def writer(self, schema, overwrite: bool) -> DayFileWriter:
        return DayFileWriter(self.options)


def read_day_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the files that the manifest names."""
    with open(f"{path.removeprefix('file://')}/{MANIFEST}", encoding="utf-8") as f:
        files = json.load(f)["files"]
    return spark.read.schema(schema).json([f"{path}/{x}" for x in files])
