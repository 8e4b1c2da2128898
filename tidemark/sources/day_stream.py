"""The daily fetch as a streaming source: each batch asks for the days since the last one, and again for days that failed.

A batch's offset names the day after its last one and the days it asks for again, so Spark's checkpoint alone says what
a batch is made of: a batch that was interrupted asks for the very same days when it runs again. Responses come from
a store as in `pages`; its column `asked` tells which time of asking a response answers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.pages import SCHEMA, fetched, pages_of, stored_rows

ONE = timedelta(days=1)


class Days(InputPartition):
    """Days of one month, asked for the same number of times before."""

    def __init__(self, month: str, days: list[str], asked: int):
        self.month, self.days, self.asked = month, days, asked


def by_month(days: list[date], asked: int) -> list[Days]:
    return [Days(month, [f"{d:%Y.%m.%d}" for d in some], asked) for month, some in groupby(sorted(days), key=lambda d: f"{d:%Y.%m}")]


class DayStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.tries = options["path"], int(options.get("tries", 3))
        self.start, self.until = options["start"], date.fromisoformat(options["until"])
        self.again = json.loads(options.get("again", "{}"))  # day: how often it was asked for
        self.run = int(options.get("run", 1))

    def initialOffset(self) -> dict:
        return {"next": self.start, "again": {}, "run": 0}

    def latestOffset(self) -> dict:
        return {"next": str(max(self.until + ONE, date.fromisoformat(self.start))), "again": self.again, "run": self.run}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        first, beyond = date.fromisoformat(start["next"]), date.fromisoformat(end["next"])
        out = by_month([first + k * ONE for k in range((beyond - first).days)], 0)
        again = end["again"] if end["run"] != start["run"] else {}
        for asked in sorted(set(again.values())):
            out += by_month([date.fromisoformat(d.replace(".", "-")) for d, n in again.items() if n == asked], asked)
        return out

    def read(self, partition: Days) -> Iterator[tuple]:
        wanted, stored = list(partition.days), stored_rows(f"{self.path}/month={partition.month}", partition.days[0], partition.days[-1], partition.asked)
        days = groupby(stored, key=lambda r: r["date"])
        name, rows = next(days, (None, ()))
        for day in wanted:
            while name is not None and name < day:
                name, rows = next(days, (None, ()))
            answers: dict[int, list] = {}
            if name == day:
                for r in rows:
                    answers.setdefault(r["page"], []).append((r["status"], r["html"]))
            html, ok, attempts, waited = self.page(answers, 1)
            yield day, 1, html, ok, attempts, waited
            for page in range(2, pages_of(html) + 1 if ok else 2):
                yield day, page, *self.page(answers, page)

    def page(self, answers: dict, page: int) -> tuple[str, bool, int, float]:
        stored = answers.get(page, [])
        return fetched(lambda attempt: stored[attempt] if attempt < len(stored) else (404, ""), self.tries)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class DayStream(DataSource):
    """spark.readStream.format("stored_days") with options path, start and until (yyyy-MM-dd), again (JSON: day to times asked), run."""

    @classmethod
    def name(cls) -> str:
        return "stored_days"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DayStreamReader:
        return DayStreamReader(self.options)
