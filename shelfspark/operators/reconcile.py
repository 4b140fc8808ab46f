"""What becomes of a model's suggestions: validators, tag types, new tags, merged tags, ranked selectors. The model's answer is
a column; nothing here calls one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import tag_type

def valid_title(c: Column) -> Column:
    return F.length(F.trim(c)).between(5, 180) & ~((F.length(c) > 20) & (F.upper(c) == c)) & ~c.rlike("(?i)^(home|menu|search|cart|login|shop)$")


def valid_price(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(\.\d+)?", 0).try_cast("double").between(1, 10000) & c.rlike(r"\p{Sc}|USD|EUR|GBP")


def clean_brand(c: Column) -> Column:
    b = F.trim(F.regexp_replace(c, r"(?i)[,\s]+(inc|llc|ltd|gmbh|co|corp)\.?$", ""))
    return F.when(F.length(b).between(2, 50), b)


def new_tags(suggested: DataFrame, known: DataFrame) -> DataFrame:
    """Suggested names that no known tag has, whatever the case, with their type."""
    s = suggested.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return s.join(known.select(F.lower("name").alias("name")).distinct(), "name", "left_anti").select("name", tag_type(F.col("name")).alias("tag_type"))


def merge_tags(auto: DataFrame, ai: DataFrame, key: str) -> DataFrame:
    """(key, name, source): one row a name, whatever the case; the first of the automatic ones wins over suggestions."""
    both = auto.select(key, "name", "seq", F.lit("AUTO").alias("source"), F.lit(0).alias("o")).unionByName(ai.select(key, "name", "seq", F.lit("AI").alias("source"), F.lit(1).alias("o")))
    w = Window.partitionBy(key, F.lower("name")).orderBy("o", "seq")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "name", "source")


def rank_selectors(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Validated before merely successful before others, otherwise in the order given."""
    w = Window.partitionBy(*key).orderBy(F.desc("validated"), F.desc("success"), "seq")
    return candidates.withColumn("rank", F.row_number().over(w))
