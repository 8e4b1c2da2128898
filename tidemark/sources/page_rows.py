"""The page parser in its extensible form: a polymorphic table function over a partitioned table of pages.

`page_lots(TABLE(pages) PARTITION BY date ORDER BY page)` gives all columns of the lots; `columns => 'species,price_avg'`
gives those only, in that order, and what isn't asked for isn't parsed. Further columns are added to PARSERS.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from tidemark import schemas
from tidemark.operators.cleaning import STATED
from tidemark.sources.html import BODY, CELL, NO_ROW, ROW


def text_of(cell: str) -> str:
    return re.sub("<[^>]+>", "", cell).replace("&nbsp;", " ").strip(" ")


def number_of(cell: str) -> float | None:
    digits = re.sub(r"[^0-9.]", "", cell)
    try:
        return float(digits) if digits else 0.0
    except ValueError:
        return None


def whole_of(cell: str) -> int | None:
    value = number_of(cell)
    return None if value is None else int(value)


#: Column: its type and how it follows from the texts of a row's cells.
PARSERS: dict[str, tuple[T.DataType, Callable[[list[str]], object]]] = {
    "species_raw": (T.StringType(), lambda c: c[0]),
    "species": (T.StringType(), lambda c: m[2] if (m := re.match(STATED, c[0])) else c[0]),
    "state": (T.StringType(), lambda c: m[1] if (m := re.match(STATED, c[0])) else None),
    "origin": (T.StringType(), lambda c: c[1]), "spec": (T.StringType(), lambda c: c[2]), "packaging": (T.StringType(), lambda c: c[3]),
    "quantity": (T.DoubleType(), lambda c: number_of(c[4])), "price_high": (T.LongType(), lambda c: whole_of(c[5])),
    "price_low": (T.LongType(), lambda c: whole_of(c[6])), "price_avg": (T.LongType(), lambda c: whole_of(c[7])),
}
#: Columns without which a row is no lot.
NEEDED = ("quantity", "price_high", "price_low", "price_avg")


def rows_of(html: str | None) -> Iterator[list[str]]:
    """The cells' texts of each row of the first table body: eight cells at least, a species, no mark of a row without data."""
    if not html or schemas.NO_DATA in html:
        return
    body = re.search(BODY, html)
    for row in re.findall(ROW, body[1] if body else ""):
        cells = [text_of(c) for c in re.findall(CELL, row)]
        if NO_ROW not in row and len(cells) >= 8 and cells[0] and all(PARSERS[c][1](cells) is not None for c in NEEDED):
            yield cells


def register(spark: SparkSession) -> None:
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class PageLots:
        @staticmethod
        def analyze(pages: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pages.isTable or not {"date", "html"} <= set(pages.dataType.names):
                raise ValueError("page_lots takes a table with the columns date and html")
            names = [c.strip() for c in columns.value.split(",")] if columns is not None and columns.value else list(PARSERS)
            unknown = [n for n in names if n not in PARSERS]
            if unknown:
                raise ValueError(f"no such columns: {', '.join(unknown)}")
            return AnalyzeResult(T.StructType([T.StructField("trade_date", T.StringType()), *(T.StructField(n, PARSERS[n][0]) for n in names)]))

        def eval(self, pages: T.Row, columns: str | None = None):
            names = [c.strip() for c in columns.split(",")] if columns else list(PARSERS)
            for cells in rows_of(pages["html"]):
                yield (pages["date"], *(PARSERS[n][1](cells) for n in names))

    spark.udtf.register("page_lots", udtf(PageLots))
