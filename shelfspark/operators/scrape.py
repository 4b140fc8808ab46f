"""Fields of pages from all their sources, arbitrated: what a host's memory selects, what a site's own rules gave, what holds anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import written
from ..sources.html import html_nodes
from . import breadcrumbs, extract, selectors, specs

#: Sources, the one that wins first.
SOURCES = ("memory", "site", "generic")
#: What holds anywhere gives these, the first five of a page's record.
FIELDS = ("title", "brand", "sku", "description", "price", "breadcrumbs", "specs")
LD = 'script[type="application/ld+json"]'


def _from_memory(pages: DataFrame, memory: DataFrame) -> DataFrame:
    """page_id, field, value, selector: by stored selectors; a selector of structured data stands for the page's Product's field."""
    stored = memory.where(F.col("selector") != LD)
    keep, last = selectors.needed(stored)
    nodes = written(html_nodes(pages, keep=keep, text=last, carry=("host",)))
    found = selectors.first_values(selectors.select(nodes, stored, ("content",)))
    value = F.when(F.col("field") == "breadcrumbs", F.array_join("values", " > ")).otherwise(F.col("value"))
    by_selector = found.select("page_id", "field", value.alias("value"), "selector")
    by_rule = memory.where(F.col("selector") == LD).select("host", "field", "selector").distinct()
    if by_rule.isEmpty():
        return by_selector
    ld = extract.product_json_ld(pages).join(pages.select("page_id", "host").hint("merge"), "page_id")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ld_{c}").alias("value")) for f, c in (("title", "title"), ("brand", "brand"), ("sku", "sku"), ("description", "description"), ("price", "money"))])).alias("f")
    by_data = ld.select("page_id", "host", each).select("page_id", "host", "f.*").join(by_rule.hint("merge"), ["host", "field"])
    # structured data is looked at before any selector
    both = by_selector.withColumn("r", F.lit(1)).unionByName(by_data.where("value <> ''").select("page_id", "field", "value", "selector", F.lit(0).alias("r")))
    return both.groupBy("page_id", "field").agg(F.min_by(F.struct("value", "selector"), "r").alias("b")).select("page_id", "field", "b.*")


def _generic(pages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    of_record = [f for f in FIELDS[:5] if f in fields]
    rows = []
    if of_record:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in of_record])).alias("f")
        rows.append(extract.page_record(pages).select("page_id", each).select("page_id", "f.*"))
    if "breadcrumbs" in fields:
        rows.append(breadcrumbs.breadcrumbs(pages).select("page_id", F.lit("breadcrumbs").alias("field"), F.array_join("items", " > ").alias("value")))
    if "specs" in fields:
        rows.append(specs.specifications(pages).select("page_id", F.lit("specs").alias("field"), F.col("specs").alias("value")))
    return reduce(DataFrame.unionByName, rows).where("value IS NOT NULL AND value <> ''")


def _price(field: Column, value: Column) -> Column:
    return F.when(field == "price", F.coalesce(value.try_cast("double"), text.best_price(value)).cast("string")).otherwise(value)


def scrape(pages: DataFrame, memory: DataFrame, mode: str = "normal", site: DataFrame | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """pages (page_id, url, html, host), memory (host, field, rank, selector, attr), site (page_id, field, value).

    ``normal``: page_id, field, value, source, selector, the first source that has a value giving it. ``memoryOnly``: the same, without
    any other source. ``compare``: page_id, field, what each source gives, and whether those that give something agree. All sources
    of all fields meet in one aggregate. fields: only these, from all their sources (the rows that a filter on the result leaves, but
    pages are not read for others)."""
    if fields:
        memory = memory.where(F.col("field").isin(*fields))
        site = site if site is None else site.where(F.col("field").isin(*fields))
    none = F.lit(None).cast("string")
    rows = _from_memory(pages, memory).withColumn("source", F.lit("memory"))
    if mode != "memoryOnly":
        if not fields or set(fields) & set(FIELDS):
            rows = rows.unionByName(_generic(pages, fields or FIELDS).withColumns({"selector": none, "source": F.lit("generic")}))
        if site is not None:
            rows = rows.unionByName(site.select("page_id", "field", "value").withColumns({"selector": none, "source": F.lit("site")}))
    rows = rows.withColumn("value", _price(F.col("field"), F.col("value"))).where("value IS NOT NULL AND value <> ''")
    if mode == "compare":
        given = [F.max(F.when(F.col("source") == s, F.col("value"))).alias(s) for s in SOURCES]
        return rows.groupBy("page_id", "field").agg(*given, (F.min("value") == F.max("value")).alias("agree"))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    best = rows.groupBy("page_id", "field").agg(F.min_by(F.struct("value", "source", "selector"), rank).alias("b"))
    return best.select("page_id", "field", "b.*")
