"""Page fields by chains of sources: the first source that has a value gives it. All tiers of all fields are one aggregate over
the few nodes of a page that can matter, so pages are parsed once and shuffled never as a whole."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fields import described, ld_images
from ..sources.html import html_nodes, json_ld_products

#: Meta properties, in order.
META = {"title": ["og:title", "twitter:title"], "brand": ["product:brand", "og:brand"], "sku": ["product:retailer_item_id", "sku"], "description": ["og:description", "description", "twitter:description"], "price": ["product:price:amount", "og:price:amount", "price"]}
#: itemprop names and class patterns of the fields.
ITEM = {"title": "name", "brand": "brand", "sku": "sku", "description": "description", "price": "price"}
CLASS = {"title": r"product-?title", "brand": r"\bbrand\b|vendor", "sku": r"\bsku\b", "description": r"product-?description", "price": r"sale-?price|current-?price|\bprice\b"}


def _first(cond: Column, what: Column) -> Column:
    ok = cond & what.isNotNull() & (what != "")
    return F.min_by(F.when(ok, what), F.when(ok, F.col("pos")))


def _ld(path: str) -> Column:
    return F.try_variant_get("ld", path, "string")


def product_json_ld(pages: DataFrame) -> DataFrame:
    """page_id with the fields of the page's first Product, whole: price from offers (one or a list), then low and high price."""
    p = json_ld_products(pages)
    price = F.coalesce(*[_ld(p) for p in ("$.offers.price", "$.offers.priceSpecification.price", "$.offers.lowPrice", "$.offers.highPrice", "$.offers[0].priceSpecification.price", "$.offers[0].price", "$.offers[0].lowPrice", "$.offers[0].highPrice")])
    currency = F.coalesce(_ld("$.priceCurrency"), _ld("$.offers.priceCurrency"), _ld("$.offers[0].priceCurrency"))
    fields = F.struct(
        _ld("$.name").alias("title"), F.coalesce(_ld("$.brand.name"), _ld("$.brand")).alias("brand"), F.coalesce(*[_ld(f"$.{k}") for k in ("sku", "productID", "gtin13", "mpn", "itemID")]).alias("sku"),
        _ld("$.description").alias("description"), price.alias("price"), F.concat_ws(" ", currency, price).alias("money"), ld_images("ld").alias("images"), described("ld").alias("described"),
    )
    one = p.groupBy("page_id").agg(F.min_by(fields, F.struct("block", "item")).alias("f"))
    return one.select("page_id", *[F.col(f"f.{c}").alias(f"ld_{c}") for c in ("title", "brand", "sku", "description", "price", "money", "images", "described")])


_ANY_CLASS = re.compile("(?i)" + "|".join([*CLASS.values(), "breadcrumb"]))


def _matters(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element can give a field; the others do not leave the parser."""
    return (tag == "meta" and ("property" in attrs or "name" in attrs)) or "itemprop" in attrs or bool(_ANY_CLASS.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def page_record(pages: DataFrame) -> DataFrame:
    """page_id, title, brand, sku, description, price, breadcrumbs, is_product_page."""
    n = html_nodes(pages, ("h1", "title", "img"), keep=_matters, text=lambda tag, _: tag not in ("meta", "img"))
    own, attr = text.collapse_space(F.col("content")), F.col("attrs")
    name = F.coalesce(attr["property"], attr["name"])
    cls = F.lower(F.concat_ws(" ", attr["class"], attr["id"]))
    aggs = []
    for f in META:
        for i, m in enumerate(META[f]):
            aggs.append(_first((F.col("tag") == "meta") & (name == m), attr["content"]).alias(f"{f}_m{i}"))
        aggs.append(_first(attr["itemprop"] == ITEM[f], F.coalesce(attr["content"], own)).alias(f"{f}_i"))
        aggs.append(_first(cls.rlike(CLASS[f]), own).alias(f"{f}_c"))
    aggs += [_first(F.col("tag") == t, own).alias(t) for t in ("h1", "title")]
    aggs.append(F.count_if(F.col("tag") == "img").alias("n_img"))
    crumbs = cls.rlike("breadcrumb") & (own != "")
    aggs.append(F.transform(F.array_sort(F.collect_list(F.when(crumbs, F.struct("pos", own.alias("t"))))), lambda x: x["t"]).alias("crumbs"))
    g = n.groupBy("page_id").agg(*aggs).join(product_json_ld(pages).hint("merge"), "page_id", "left")
    metas = lambda f: [F.col(f"{f}_m{i}") for i in range(len(META[f]))]
    title = F.coalesce(*metas("title"), "h1", "title_c", "title_i", "title", "ld_title")
    brand = F.coalesce("ld_brand", *metas("brand"), "brand_i", "brand_c")
    sku = F.coalesce("ld_sku", *metas("sku"), "sku_i", "sku_c")
    description = F.coalesce(*[F.when(F.length(c) > 30, c) for c in metas("description")], "description_i", F.when(F.length("description_c") > 50, F.col("description_c")), "ld_description")
    price = F.coalesce(*[m.try_cast("double") for m in metas("price")], text.best_price(F.coalesce("price_i", "price_c")), F.col("ld_price").try_cast("double"))
    return g.select("page_id", title.alias("title"), brand.alias("brand"), sku.alias("sku"), description.alias("description"), price.alias("price"), text.drop_title_crumb(F.col("crumbs"), title).alias("breadcrumbs"), (F.col("h1").isNotNull() & (price.isNotNull() | (F.col("n_img") > 0))).alias("is_product_page"))
