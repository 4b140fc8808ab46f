"""SKU and brand of a page by tiers: structured data, marks, attributes within the product's container, patterns in its text, URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from ..sources.html import html_nodes
from .extract import product_json_ld
from .selectors import stripped, wants

#: Selectors in order; attributes in order; patterns of texts and URLs.
MARKS = ('meta[itemprop="sku"]', 'meta[itemprop="productID"]', 'meta[property="product:sku"]', 'meta[name="sku"]', '[itemprop="sku"]', '[itemprop="productID"]')
CONTAINERS = (".product", ".product-detail", "#product", "[data-product-id]", ".product-info", ".product-main")
DATA = ("[data-sku]", "[data-product-id]", "[data-itemid]", "[data-pid]", "[data-product-sku]", 'input[name="sku"]', 'input[name="productId"]', 'input[type="hidden"][name*="sku" i]')
#: The last of the selectors by attribute, of which two are on one name: both must hold.
HIDDEN_ID = ('input[type="hidden"][name*="product" i]', 'input[type="hidden"][name*="id" i]')
ATTRS = ("data-sku", "data-product-id", "data-itemid", "data-pid", "data-product-sku", "value")
TEXTS = (".product-details", ".product-info", ".sku", ".item-number", ".model-number", '[class*="sku" i]')
TEXT_PATTERNS = (r"(?i)(?:SKU|Item\s*#?|Product\s*Code|Article\s*#?|Model\s*#?|UPC|MPN)[\s:]+([A-Z0-9-]{3,30})", r"(?i)(?:Style\s*#?)[\s:]+([A-Z0-9-]{3,20})")
URL_PATTERNS = (r"(?i)/product/([A-Z0-9-]+)", r"(?i)/item/([A-Z0-9-]+)", r"(?i)/p/([A-Z0-9-]+)", r"(?i)[?&]sku=([A-Z0-9-]+)", r"(?i)[?&]pid=([A-Z0-9-]+)")


def _found(value: Column, *patterns: str) -> Column:
    """The first group of the first pattern that fits."""
    return F.coalesce(*[F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in patterns])


def skus(pages: DataFrame) -> DataFrame:
    """page_id, sku, method (jsonld, meta, dom-attr, pattern, url): of pages that have one, from the first tier that gives it."""
    marks = {f"m{i}": wants(s) for i, s in enumerate(MARKS)} | {f"d{i}": wants(s) for i, s in enumerate((*DATA, *HIDDEN_ID))} | {"box": wants(*CONTAINERS), "text": wants(*TEXTS)}
    n = written(html_nodes(pages, ("body",), keep=wants(*MARKS, *CONTAINERS, *DATA, *HIDDEN_ID, *TEXTS), text=wants(*MARKS[4:], *TEXTS), marks=marks))
    is_a, a = lambda m: F.array_contains("marks", m), F.col("attrs")
    given = lambda c: F.nullif(a[c], F.lit(""))
    # the first container of the page, else its body; what is looked for stands below
    box = n.where(is_a("box") | (F.col("tag") == "body")).groupBy("page_id").agg(F.min_by(F.struct("pos", "last"), F.struct(F.when(is_a("box"), 0).otherwise(1).alias("o"), "pos")).alias("b"))
    n = n.join(box.select("page_id", F.col("b.pos").alias("top"), F.col("b.last").alias("end")).hint("merge"), "page_id", "left")
    inside = F.coalesce((F.col("pos") > F.col("top")) & (F.col("pos") <= F.col("end")), F.lit(False))
    first = lambda ok, value: F.min_by(F.when(ok, F.struct(value.alias("v"))), F.when(ok, F.col("pos")))["v"]
    good = lambda c: F.when((F.trim(given(c)) != "") & (F.length(given(c)) < 100), stripped(given(c)))
    by_attr = F.coalesce(*[good(c) if c != "value" else F.when(F.col("tag") == "input", good(c)) for c in ATTRS])
    kinds = [is_a(f"d{i}") for i in range(len(DATA))] + [is_a(f"d{len(DATA)}") & is_a(f"d{len(DATA) + 1}")]
    text = F.when(is_a("text") & inside, _found(F.col("content"), *TEXT_PATTERNS))
    g = n.groupBy("page_id").agg(
        *[first(is_a(f"m{i}"), F.coalesce(given("content"), F.nullif(stripped(F.col("content")), F.lit("")))).alias(f"m{i}") for i in range(len(MARKS))],
        *[first(k & inside, by_attr).alias(f"d{i}") for i, k in enumerate(kinds)], F.min_by(text, F.when(text.isNotNull(), F.col("pos"))).alias("text"),
    )
    ld = product_json_ld(pages).select("page_id", F.nullif(F.trim("ld_sku"), F.lit("")).alias("ld"))
    url = F.coalesce(*[F.when(F.length(F.regexp_extract("url", p, 1)) >= 3, F.regexp_extract("url", p, 1)) for p in URL_PATTERNS])
    every = pages.where(F.col("url").rlike("(?i)^https?:")).select("page_id", url.alias("url")).join(g.hint("merge"), "page_id", "left").join(ld.hint("merge"), "page_id", "left")
    tiers = {"jsonld": F.col("ld"), "meta": F.coalesce(*[f"m{i}" for i in range(len(MARKS))]), "dom-attr": F.coalesce(*[f"d{i}" for i in range(len(kinds))]), "pattern": F.col("text"), "url": F.col("url")}
    best = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("sku"), F.lit(m).alias("method"))) for m, v in tiers.items()]).alias("b")
    return every.select("page_id", best).where("b IS NOT NULL").select("page_id", "b.*")
