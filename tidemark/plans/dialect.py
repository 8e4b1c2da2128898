"""Queries as SQL text that Spark and the checking engine both run; the few functions they name differently are macros."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.lots import LOTS_SQL, star_lots

# Macro, its form in Spark, its form in the checking engine.
MACROS = {
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "BROUND": ("bround({0}, {1})", "round_even({0}, {1})"),
    "DAYS": ("datediff({0}, {1})", "date_diff('day', {1}, {0})"),
    "DADD": ("date_add({0}, {1})", "CAST({0} + {1} AS DATE)"),
    "DOW": ("weekday({0})", "(isodow({0}) - 1)"),
    "WOY": ("weekofyear({0})", "weekofyear({0})"),
    "DOY": ("dayofyear({0})", "dayofyear({0})"),
    "TRUNC": ("CAST({0} AS BIGINT)", "CAST(trunc({0}) AS BIGINT)"),
    "BUCKET": ("CAST(floor({0}) AS BIGINT)", "CAST(floor({0}) AS BIGINT)"),
    "MONTHOF": ("CAST(date_trunc('month', {0}) AS DATE)", "CAST(date_trunc('month', {0}) AS DATE)"),
    "WEEKOF": ("CAST(date_trunc('week', {0}) AS DATE)", "CAST(date_trunc('week', {0}) AS DATE)"),
    "JSON": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "MATCHES": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "ARR": ("array({0})", "[{0}]"),
    "CAL": ("explode(sequence({0}, {1}, interval 1 day))", "CAST(unnest(generate_series({0}, {1}, INTERVAL 1 DAY)) AS DATE)"),
    "SERIES": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "SKEW": ("skewness({0})", "((avg({0} * {0} * {0}) - 3 * avg({0}) * avg({0} * {0}) + 2 * avg({0}) * avg({0}) * avg({0})) / power(stddev_pop({0}), 3))"),
    "KURT": ("kurtosis({0})", "kurtosis_pop({0})"),
    "SLOPE": ("regr_slope({0}, {1})", "regr_slope({0}, {1})"),
    "KEYHASH": ("sha2({0}, 256)", "sha256({0})"),
    "LASTKNOWN": ("last_value({0}, true)", "last_value({0} IGNORE NULLS)"),
    "TIMEBUCKET": ("CAST(date_trunc('{0}', {1}) AS TIMESTAMP)", "CAST(date_trunc('{0}', {1}) AS TIMESTAMP)"),
    "EPOCH": ("unix_micros({0})", "epoch_us({0})"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at this place, and where it ends."""
    depth, start, out, quoted = 0, at + 1, [], False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("a macro's parenthesis is open")


def expanded(sql: str, engine: int) -> str:
    while m := re.search(r"\b(" + "|".join(MACROS) + r")\(", sql):
        args, end = _arguments(sql, m.end() - 1)
        form = MACROS[m[1]][engine]
        if m[1] == "ARR":
            args = [", ".join(args)]
        elif m[1] == "JSON":
            args[1] = args[1].strip("'")
        elif m[1] == "TIMEBUCKET":
            args[0] = args[0].strip("'")
        sql = sql[: m.start()] + form.format(*args) + sql[end:]
    if engine == 0:  # numbers with a point are doubles, not decimals
        sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", sql)
    return sql.replace("GROUPREF", ("'$1'", "'\\1'")[engine])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query over the lots and tables it names; views are read where they lie, nothing is cached."""
    text = expanded(sql, 0)
    frames = {}
    for name in (*TABLES, "lots"):
        if re.search(rf"\b{name}\b", text):
            frames[name] = star_lots(spark, sf_dir) if name == "lots" else spark.read.parquet(f"{sf_dir}/{name}.parquet")
            text = re.sub(rf"(?<![\w.])((?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", text)
    return spark.sql(text, **frames)


def oracle(sql: str) -> str:
    text = expanded(sql, 1)
    if not re.search(r"\blots\b", text):
        return text
    if text.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {LOTS_SQL}, {text.lstrip()[15:]}"
    return f"WITH {LOTS_SQL}, {text.lstrip()[5:]}" if text.lstrip().startswith("WITH ") else f"WITH {LOTS_SQL} {text}"
