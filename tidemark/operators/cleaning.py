"""Projections, predicates and normalisation of lots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas


def mapped(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c if default is None else default)


def species_alias(c: Column) -> Column:
    return mapped(c, schemas.SPECIES_ALIASES)


# A padded count, and a state before a name.
PADDED, STATED = r"^0(\d+미)$", r"^\(([^)]+)\)(.+)$"


def spec_unpadded(c: Column) -> Column:
    """One leading zero of a plain count goes; ranges stay as they are."""
    return F.regexp_replace(c, PADDED, "$1")


def avg_repaired(high: Column, low: Column, avg: Column) -> Column:
    return F.when((avg == 0) & (high > 0) & (low > 0), F.floor((high + low) / 2).cast("long")).otherwise(avg)


def state_of(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, STATED, 1), F.lit(""))


def species_of(raw: Column) -> Column:
    return F.regexp_replace(raw, STATED, "$2")


def is_foreign(origin: Column) -> Column:
    return F.coalesce(origin.rlike("|".join(map(re.escape, schemas.FOREIGN_KEYWORDS))), F.lit(False))


def spec_class(spec: Column) -> Column:
    return (F.when(spec.isNull(), "null").when(spec.rlike("^(특대|대|중|소)$"), "size_grade").when(spec.rlike(r"^\d+미$"), "count")
            .when(spec.rlike(r"^\d+/\d+미$"), "count_range").when(spec.rlike(r"^\d+/\d+$"), "weight_range").otherwise("other"))


def is_valid() -> Column:
    """Species present, nothing negative, high at least low, and an average within one per cent of the range."""
    high, low, avg = F.col("price_high"), F.col("price_low"), F.col("price_avg")
    off = (avg > 0) & ~avg.between(low, high) & ((avg < low * 0.99) | (avg > high * 1.01))
    return F.coalesce((F.col("species") != "") & (avg >= 0) & (high >= 0) & (low >= 0) & (high >= low) & ~off & (F.col("quantity") >= 0), F.lit(False))


def normalised(lots: DataFrame) -> DataFrame:
    """Rules in order: alias, padded spec, empty strings to null, repaired average."""
    lots = lots.withColumns({"species": species_alias(F.col("species")), "spec": spec_unpadded(F.col("spec"))})
    lots = lots.withColumns({c: F.nullif(c, F.lit("")) for c in ("state", "origin", "spec", "packaging")})
    return lots.withColumn("price_avg", avg_repaired(F.col("price_high"), F.col("price_low"), F.col("price_avg")))


def change_counts(lots: DataFrame) -> DataFrame:
    """One row with the number of changes of each rule."""
    count = lambda c, name: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias(name)
    high, low, avg = F.col("price_high"), F.col("price_low"), F.col("price_avg")
    empty = sum((F.when(F.col(c) == "", 1).otherwise(0) for c in ("origin", "spec", "packaging")), F.lit(0))
    return lots.agg(
        F.count("*").alias("rows"), count(species_alias(F.col("species")) != F.col("species"), "alias"), count(F.col("state") == "", "state"),
        count(spec_unpadded(F.col("spec")) != F.col("spec"), "spec"), F.sum(empty).alias("empty"), count(avg_repaired(high, low, avg) != avg, "avg"))


def freshness(days: Column) -> Column:
    return F.when(days >= 100, "active").when(days >= 1, "caution").otherwise("stopped")


def for_configs(lots: DataFrame, configs: DataFrame, shared_packaging: bool = False) -> DataFrame:
    """Lots of each configuration (config_id, species, state, packaging, spec, domestic); a null key matches all.

    With shared_packaging the packaging "S/P" matches any.
    """
    l, c = lots.alias("l"), configs.alias("c")
    same = lambda k: F.col(f"c.{k}").isNull() | (F.col(f"l.{k}") == F.col(f"c.{k}"))
    packaging = same("packaging") | (F.col("c.packaging") == "S/P") if shared_packaging else same("packaging")
    on = (F.col("l.species") == F.col("c.species")) & same("state") & packaging & same("spec") & (~F.col("c.domestic") | ~is_foreign(F.col("l.origin")))
    return l.join(c, on).select("c.config_id", "l.*")
