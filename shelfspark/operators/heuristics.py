"""Which fields of a page are plain enough to need no model: marked up, or standing in the product's root, and plausible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import is_navigation
from ..functions.images import is_product_image
from ..sources.html import html_nodes
from .dom import product_roots
from .selectors import stripped, wants

#: Selectors of each field in order, and the attribute that is looked at besides a meta element's content.
TITLE = ('[itemprop="name"]', '[property="og:title"]', 'meta[name="title"]')
MARKED = {
    "price": (('[itemprop="price"]', '[property="product:price:amount"]', 'meta[property="og:price:amount"]', "[data-price]", ".price[data-value]"), "data-value"),
    "brand": (('[itemprop="brand"]', '[property="product:brand"]', 'meta[property="og:brand"]', "[data-brand]"), "data-brand"),
    "description": (('[itemprop="description"]', '[property="og:description"]', 'meta[name="description"]', "[data-description]"), "data-description"),
}
IMAGES = ('[itemprop="image"]', '[property="og:image"]', "[data-product-image]", ".product-image img", ".hero-image img")
FIELDS = ("title", "price", "brand", "description", "images")
MOST_IMAGES = 6


def _fits(field: str, value: Column) -> Column:
    n = F.length(value)
    return {"title": (n > 5) & (n < 200), "price": value.rlike("[0-9.,]"), "brand": (n > 1) & (n < 50), "description": n > 50}[field]


def good_fields(pages: DataFrame) -> DataFrame:
    """page_id, field, selector, value (of images the first six, a line each): one row for each field that is good as it is."""
    marks = {"title": wants(*TITLE), "h1": wants("h1"), **{f"{f} {i}": wants(s) for f, (ss, _) in MARKED.items() for i, s in enumerate(ss)}, **{f"images {i}": wants(s) for i, s in enumerate(IMAGES[:3])}, "img": wants("img"), "product": wants(".product-image"), "hero": wants(".hero-image")}
    every = [*TITLE, "h1", *[s for ss, _ in MARKED.values() for s in ss], *IMAGES[:3], "img", ".product-image", ".hero-image"]
    no_text = wants("meta", "img")
    n = html_nodes(pages, keep=wants(*every), text=lambda tag, attrs: not no_text(tag, attrs), marks=marks)
    is_a, a = lambda m: F.array_contains("marks", m), F.col("attrs")
    given = lambda c: F.nullif(c, F.lit(""))
    content = F.when(F.col("tag") == "meta", given(a["content"]))
    n = n.join(product_roots(pages).select("page_id", F.col("pos").alias("root"), F.col("last").alias("end")).hint("merge"), "page_id", "left")
    inside = F.coalesce((F.col("pos") > F.col("root")) & (F.col("pos") <= F.col("end")), F.lit(False))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda m: F.coalesce(F.max(F.when(is_a(m), F.col("last"))).over(before) >= F.col("pos"), F.lit(False))
    n = n.withColumns({"inside": inside, "in_product": below("product"), "in_hero": below("hero")})
    n = n.withColumn("said", stripped(F.coalesce(content, F.col("content"))))
    first = lambda ok, value: F.min_by(F.when(ok, F.struct(value.alias("value"), F.col("attrs"), F.col("tag"))), F.when(ok, F.col("pos")))
    aggs = [first(is_a("title"), F.col("said")).alias("title"), first(is_a("h1") & F.col("inside"), F.col("said")).alias("h1")]
    for f, (ss, also) in MARKED.items():
        value = stripped(F.coalesce(content, given(a[also]), F.col("content")))
        aggs += [first(is_a(f"{f} {i}"), value).alias(f"{f}{i}") for i in range(len(ss))]
    kinds = [is_a(f"images {i}") for i in range(3)] + [is_a("img") & F.col("in_product"), is_a("img") & F.col("in_hero")]
    src = F.coalesce(F.when(F.col("tag") == "img", given(a["src"])), content, given(a["data-src"]))
    nr = F.filter(F.array(*[F.when(k & F.col("inside"), F.lit(i)) for i, k in enumerate(kinds)]), lambda x: x.isNotNull())
    seen = F.transform(nr, lambda i: F.struct(i.alias("nr"), F.col("pos").alias("pos"), F.when(is_product_image(src), src).alias("src")))
    aggs.append(F.sort_array(F.flatten(F.collect_list(seen))).alias("images"))
    g = n.groupBy("page_id").agg(*aggs)
    one = lambda field, selector, value, ok: F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), selector.alias("selector"), value.alias("value")))
    h1 = F.col("h1.value")
    rows = [F.coalesce(one("title", F.lit(", ".join(TITLE)), F.col("title.value"), _fits("title", F.col("title.value"))), one("title", F.lit("h1"), h1, _fits("title", h1) & ~is_navigation(h1)))]
    for f, (ss, _) in MARKED.items():
        rows.append(F.coalesce(*[one(f, F.lit(s), F.col(f"{f}{i}.value"), _fits(f, F.col(f"{f}{i}.value"))) for i, s in enumerate(ss)]))
    urls = F.filter(F.transform("images", lambda x: x["src"]), lambda x: x.isNotNull())
    rows.append(one("images", F.get(F.array(*map(F.lit, IMAGES)), F.get("images", 0)["nr"]), F.array_join(F.slice(urls, 1, MOST_IMAGES), "\n"), F.size(urls) > 0))
    return g.select("page_id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("page_id", "r.*")


def fields_for_model(pages: DataFrame) -> DataFrame:
    """page_id, fields: those that are not good as they are, in their order; every page has a row."""
    got = good_fields(pages).groupBy("page_id").agg(F.collect_set("field").alias("good"))
    missing = F.array_except(F.array(*map(F.lit, FIELDS)), F.coalesce("good", F.array().cast("array<string>")))
    return pages.select(F.col("page_id").cast("long").alias("page_id")).distinct().join(got.hint("merge"), "page_id", "left").select("page_id", missing.alias("fields"))
