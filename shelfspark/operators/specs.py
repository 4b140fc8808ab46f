"""Specifications of a page: lines ``label: value`` of tables, and lines of lists, from the first container that has two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from ..sources.html import html_nodes
from .selectors import matches, stripped, wants

#: Containers in order (those of the first group are read as lists only), their rows, labels, values, and leads of
#: lines that are no specification.
BY_DATA = ('[data-testid*="spec" i]', '[data-testid*="specification" i]', '[id*="specification" i]', '[data-test*="spec" i]')
BY_CLASS = (".specifications", ".specs", ".product-specs", ".product-specifications", ".product-info-specs", '[class*="specification" i]', '[class*="specs" i]', ".product-attributes", ".product-features")
ACCORDIONS, AROUND = ('[role="region"]', ".accordion-content", "[aria-expanded]"), ('[class*="spec" i]', '[id*="spec" i]')
LABELS = (".spec-name", '[class*="spec-label"]', '[class*="attr-name"]', "th")
VALUES = (".spec-value", '[class*="spec-value"]', '[class*="attr-value"]', "td")
LINES, ROWS = ("li", "tr"), ("tr", ".row")
NO_SPEC = r"(?i)^(shop|buy|add to|view|see|free|sale|limited)"


def _containers(n: DataFrame) -> DataFrame:
    """page_id, rank, method, top, end: of each selector the first element of the page, and the accordions within a part for
    specifications, in order."""
    ranked = [(s, "data-attribute") for s in BY_DATA] + [(s, "class-pattern") for s in BY_CLASS]
    first = [F.min_by(F.when(matches(s), F.struct("pos", "last")), F.when(matches(s), F.col("pos"))).alias(f"s{i}") for i, (s, _) in enumerate(ranked)]
    each = F.explode(F.array(*[F.struct(F.struct(F.lit(i).alias("a"), F.lit(0).alias("b")).alias("rank"), F.lit(m).alias("method"), F.col(f"s{i}").alias("at")) for i, (_, m) in enumerate(ranked)])).alias("c")
    one = n.groupBy("page_id").agg(*first).select("page_id", each).where("c.at IS NOT NULL").select("page_id", "c.rank", "c.method", F.col("c.at.pos").alias("top"), F.col("c.at.last").alias("end"))
    around = n.where(matches(*AROUND)).select("page_id", F.col("pos").alias("o"), F.col("last").alias("o_last"))
    rank = F.struct(F.lit(len(ranked)).alias("a"), F.col("pos").alias("b")).alias("rank")
    inner = n.where(matches(*ACCORDIONS)).join(around.hint("merge"), "page_id").where("o <= pos AND pos <= o_last").select("page_id", rank, F.lit("accordion").alias("method"), F.col("pos").alias("top"), F.col("last").alias("end"))
    return one.unionByName(inner.distinct())


def _first_below(items: DataFrame, n: DataFrame, what: Column, name: str) -> DataFrame:
    """items with the text of the first element below each that fits; null where there is none."""
    below = n.where(what).select("page_id", F.col("pos").alias("at"), F.col("content").alias("said"))
    found = items.select("page_id", "pos", "last").distinct().join(below.hint("merge"), "page_id").where("at > pos AND at <= last").groupBy("page_id", "pos").agg(F.min_by("said", "at").alias(name))
    return items.join(found.hint("merge"), ["page_id", "pos"], "left")


def specifications(pages: DataFrame) -> DataFrame:
    """page_id, method, specs (lines): of pages that have any."""
    parts = wants(*LINES, *ROWS, *LABELS, *VALUES)
    n = written(html_nodes(pages, keep=wants(*BY_DATA, *BY_CLASS, *ACCORDIONS, *AROUND, *LINES, *ROWS, *LABELS, *VALUES), text=parts).withColumn("content", stripped(F.col("content"))))
    items = n.where(matches(*LINES, *ROWS)).select("page_id", "pos", "last", "content", matches(*LINES).alias("line"), matches(*ROWS).alias("row"))
    items = _first_below(_first_below(items, n, matches(*LABELS), "label"), n, matches(*VALUES), "value")
    text = F.col("content")
    short = (F.length(text) > 3) & (F.length(text) < 200)
    pair = F.when(F.col("label").isNotNull() & F.col("value").isNotNull(), F.when((F.col("label") != "") & (F.col("value") != ""), F.concat("label", F.lit(": "), "value"))).when(short & text.contains(":"), text)
    lines = items.select("page_id", "pos", F.when(F.col("row"), pair).alias("pair"), F.when(F.col("line") & short & ~text.rlike(NO_SPEC), text).alias("line"))
    held = _containers(n).join(lines.hint("merge"), "page_id").where("pos > top AND pos <= end").groupBy("page_id", "rank", "method")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("s"))))), lambda x: x["s"])
    made = held.agg(listed("pair").alias("pairs"), listed("line").alias("lines"))
    specs = F.when((F.col("method") == "class-pattern") & (F.size("pairs") >= 2), F.col("pairs")).when(F.size("lines") >= 2, F.col("lines"))
    best = made.withColumn("specs", specs).where("specs IS NOT NULL").groupBy("page_id").agg(F.min_by(F.struct("method", F.array_join("specs", "\n").alias("specs")), "rank").alias("b"))
    return best.select("page_id", "b.*")
