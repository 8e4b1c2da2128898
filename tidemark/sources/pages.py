"""Pages from a store of responses, as a Python data source: paging, retries and limits of the daily fetch, without a network.

A store is a folder of Parquet files below month=yyyy.MM with the responses of each date and page in the order in which
they came: date, page, attempt, status, html; a file is sorted by the first three. Status 200 is a page, 429 asks to wait, other numbers fail; a status of
BROKEN stands for a lost connection, one of UNEXPECTED for an error that isn't tried again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BROKEN, UNEXPECTED = -1, -2
SCHEMA = "date string, page int, html string, ok boolean, attempts int, waited double"
#: Seconds between two requests of a reader.
DELAY = 1.5


def pages_of(html: str) -> int:
    """The page of the pager's last button, else the largest page that is linked, else 1."""
    last, most = 0, 1
    for anchor in re.findall(r"<a\s[^>]*>", html, re.I):
        number = re.search(r"\((\d+)\)", anchor)
        if number and re.search(r"class\s*=\s*[\"'][^\"']*\blast\b", anchor, re.I):
            last = last or int(number[1])
        elif number:
            most = max(most, int(number[1]))
    return last or most


def fetched(answer: Callable[[int], tuple[int, str]], tries: int) -> tuple[str, bool, int, float]:
    """html, whether it came, attempts made and seconds to wait in all. answer(attempt) gives status and html."""
    waited = 0.0
    for attempt in range(tries):
        status, html = answer(attempt)
        waited += DELAY
        if status == 200:
            return html, True, attempt + 1, waited
        if status == UNEXPECTED:
            return "", False, attempt + 1, waited
        if status == 429:
            waited += 60 * (attempt + 1)
        elif status == BROKEN and attempt < tries - 1:
            waited += 2**attempt
    return "", False, tries, waited


def stored_rows(folder: str, first: str, last: str, asked: int | None = None) -> Iterator[dict]:
    """Stored responses from first to last day, in the order of date, page and attempt, of one time of asking where that is told.

    Files hold their rows in this order, so they are merged as they are read and a batch of each is held.
    """
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return
    store = ds.dataset(path, filesystem=system, format="parquet")
    where = (ds.field("date") >= first) & (ds.field("date") <= last)
    if asked is not None and "asked" in store.schema.names:
        where &= ds.field("asked") == asked
    columns = ["date", "page", "attempt", "status", "html"]

    def rows(file) -> Iterator[dict]:
        for batch in file.to_batches(columns=columns, filter=where, batch_size=256):
            yield from batch.to_pylist()

    yield from heapq.merge(*map(rows, store.get_fragments()), key=lambda r: (r["date"], r["page"], r["attempt"]))


class Month(InputPartition):
    def __init__(self, start: date, end: date):
        self.start, self.end = start, end


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tries = options["path"], int(options.get("tries", 3))
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])

    def partitions(self) -> list[Month]:
        out, day = [], self.start
        while day <= self.end:
            beyond = (day.replace(day=1) + timedelta(days=32)).replace(day=1)
            out.append(Month(day, min(self.end, beyond - timedelta(days=1))))
            day = beyond
        return out

    def read(self, partition: Month) -> Iterator[tuple]:
        stored = stored_rows(f"{self.path}/month={partition.start:%Y.%m}", f"{partition.start:%Y.%m.%d}", f"{partition.end:%Y.%m.%d}")
        days = groupby(stored, key=lambda r: r["date"])
        name, rows = next(days, (None, ()))
        day = partition.start
        while day <= partition.end:
            wanted, answers = f"{day:%Y.%m.%d}", {}
            if name == wanted:
                for r in rows:
                    answers.setdefault(r["page"], []).append((r["status"], r["html"]))
                name, rows = next(days, (None, ()))
            html, ok, attempts, waited = self.page(answers, 1)
            yield wanted, 1, html, ok, attempts, waited
            for page in range(2, pages_of(html) + 1 if ok else 2):
                yield wanted, page, *self.page(answers, page)
            day += timedelta(days=1)

    def page(self, answers: dict, page: int) -> tuple[str, bool, int, float]:
        stored = answers.get(page, [])
        return fetched(lambda attempt: stored[attempt] if attempt < len(stored) else (404, ""), self.tries)


class PageSource(DataSource):
    """spark.read.format("stored_pages").option("path", ...).option("start", "yyyy-MM-dd").option("end", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)
