"""Choosing among candidates: majorities, bumps, containers, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the one that came up last. Counted before the shuffle."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return n.groupBy(key).agg(F.max(F.struct("n", "first", value)).alias("b")).select(key, f"b.{value}", "b.n")


def bump_largest(df: DataFrame, key: list[str], measure: str, seq: str, bonus: int = 25) -> DataFrame:
    """In groups of two and more, the first row with the largest measure gains the bonus."""
    w = Window.partitionBy(*key)
    first = F.row_number().over(w.orderBy(F.desc(measure), seq))
    return df.withColumn("score", F.col("score") + F.when((first == 1) & (F.count("*").over(w) > 1), bonus).otherwise(0))


def winning_container_first(ranked: DataFrame, key: str, selector: str, top: int = 6) -> DataFrame:
    """Of the containers of the top rows (a selector's path without its last step), the first with two of them wins, if there is one;
    rows whose selector begins with it move to the front. All keep their order otherwise."""
    path = F.regexp_extract(selector, r"(?s)^(.+) > ", 1)
    container = F.when(path != "", path).otherwise(F.col(selector))
    n = ranked.where((F.col("rank") <= top) & F.col(selector).isNotNull()).groupBy(key, container.alias("container")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    win = n.where("n >= 2").groupBy(key).agg(F.min_by("container", "first").alias("win"))
    front = F.coalesce(F.startswith(F.col(selector), F.col("win")), F.lit(False))
    order = Window.partitionBy(key).orderBy(F.desc(front), "rank")
    return ranked.join(win, key, "left").withColumn("new_rank", F.row_number().over(order)).drop("win")


def first_matches(df: DataFrame, key: str, seq: str, matches: Column, quota: int = 3) -> DataFrame:
    """Adds in_quota: whether a matching row is one of the first ``quota`` of its key."""
    n = F.sum(F.when(matches, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("in_quota", matches & (n <= quota))


def ordered_union(*arrays: Column) -> Column:
    return F.filter(F.array_distinct(F.concat(*arrays)), lambda x: x.isNotNull() & (x != ""))


def keep_best(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Of each key the row with the largest order, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best")).select(*key, "best.*")
