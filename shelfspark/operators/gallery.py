"""Image candidates of pages: elements by gallery selectors, their URLs with provenance, ranked; all images where that gives none."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import OTHER_PRODUCTS, upgrade_cdn
from ..functions.text import absolute_url, best_of_srcset
from ..sources.files import written
from ..sources.html import html_nodes
from .catalog import ImageAudit, rank_images
from .selectors import chains

#: Where galleries are looked for, in order.
GALLERY = (
    ".product-media img", ".gallery img", ".image-gallery img", ".product-images img", ".product-gallery img", ".product_media_item img", ".product__media-item img.image__img", "img.image_img", "img.image__img", "[class*=gallery] img", '[class*="slider-image"] img',
    '[class*="slider-img"] img', ".thumbnails img", ".pdp-gallery img", "[data-testid*=image] img", ".big-picture img", '[class*="big-picture"] img', "#mainProductImage", "#zoomImage", ".product-media picture source", ".gallery picture source",
    ".product-gallery picture source", ".pdp-gallery picture source", ".pdp-images__desktop picture source", '[class*="pdp-image"] picture source', "[class*=gallery] picture source",
)
#: Attributes that may hold the URL, in order.
SOURCES = ("src", "data-src", "data-image", "data-zoom-image", "data-large")
FALLBACK = "img"


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, fallback, pos, url, from_srcset, from_zoom, from_large, selector: every URL that an element of a gallery offers, and (as
    fallback) those of all images. An element found by two selectors stands there for both, as each has a place of its own."""
    return _offered(_nodes(pages))


def _nodes(pages: DataFrame) -> DataFrame:
    """The elements that any selector selects, with the numbers of these selectors; pictures and their sources; meta elements."""
    other = re.compile(OTHER_PRODUCTS, re.ASCII)
    others = lambda tag, attrs: bool(other.search(" ".join(attrs[k] for k in ("class", "id") if k in attrs).lower()))
    others.names = ("class", "id")
    return written(html_nodes(pages, ("picture", "source", "meta"), text=lambda tag, _: False, carry=("url",), marks={"other": others}, chains=chains(*GALLERY, FALLBACK), around=2))


def _offered(nodes: DataFrame) -> DataFrame:
    # of the element and its next two ancestors, none may belong to a section of other products
    e = nodes.where((F.size("selected") > 0) & (F.size("around") == 0)).select("page_id", "pos", F.col("parent").alias("p1"), "above", "attrs", F.col("url").alias("page"), "selected")
    # sources of a picture that the element stands in
    s = nodes.where("tag = 'source'").select("page_id", F.col("pos").alias("at"), F.coalesce(F.col("attrs")["data-srcset"], F.col("attrs")["srcset"]).alias("set")).where("set IS NOT NULL")
    box = nodes.where("tag = 'picture'").select("page_id", F.col("pos").alias("p1"), F.col("last").alias("end")).join(s.hint("merge"), "page_id").where("at > p1 AND at <= end")
    box = box.groupBy("page_id", "p1").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "set"))), lambda x: x["set"]).alias("sets"))
    box = box.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("p1", "sets"))).alias("boxes"))
    e = e.join(box.hint("merge"), "page_id", "left")
    a = F.col("attrs")
    given = lambda c: F.nullif(a[c], F.lit(""))
    offer = lambda u, srcset: F.struct(u.alias("url"), F.lit(srcset).alias("from_srcset"), F.lit(not srcset).alias("main"))
    sets = F.coalesce(F.when(F.col("above") == "picture", F.try_element_at("boxes", F.col("p1"))), F.array().cast("array<string>"))
    urls = F.concat(F.array(offer(F.coalesce(*map(given, SOURCES)), False), offer(best_of_srcset(F.coalesce(given("data-srcset"), given("srcset"))), True)), F.transform(sets, lambda x: offer(best_of_srcset(x), True)))
    e = e.select("page_id", "pos", "page", "selected", given("data-zoom-image").isNotNull().alias("zoom"), given("data-large").isNotNull().alias("large"), F.posexplode(F.filter(urls, lambda x: x["url"].isNotNull())).alias("k", "x"))
    # a URL is rewritten once, as a row of its own, before the selectors of its element multiply it
    e = e.select("*", F.explode(F.array(upgrade_cdn(absolute_url(F.col("x.url"), F.col("page"))))).alias("url")).select("*", F.explode("selected").alias("rank"))
    e = e.withColumns({"fallback": F.col("rank") == len(GALLERY), "selector": F.get(F.array(*map(F.lit, (*GALLERY, FALLBACK))), F.col("rank"))})
    e = e.withColumn("place", F.dense_rank().over(Window.partitionBy("page_id", "fallback").orderBy("rank", "pos")) - 1)
    return e.select("page_id", "fallback", "place", (F.col("place") * 1000 + F.least("k", F.lit(999))).alias("pos"), "url", "x.from_srcset", (F.col("x.main") & F.col("zoom")).alias("from_zoom"), (F.col("x.main") & F.col("large")).alias("from_large"), "selector")


def page_images(pages: DataFrame, keep: int = 30, audit: ImageAudit | None = None) -> DataFrame:
    """page_id, rank, url, score, selector (that found it), method: the images of a page's galleries; where none of them passes, the
    page's own image and all others, without points for their place. Both are ranked in one pass, and a window over the page
    decides which counts."""
    nodes = _nodes(pages)
    c = _offered(nodes).withColumn("key", F.struct("page_id", "fallback"))
    place = F.when(~F.col("fallback"), F.col("place"))
    r = rank_images(c, "key", keep, place, ("selector", "from_zoom", "from_large"), audit).select("key.*", "rank", "url", "score", "selector")
    og = nodes.where((F.col("tag") == "meta") & (F.col("attrs")["property"] == "og:image") & (F.col("attrs")["content"] != ""))
    og = og.groupBy("page_id").agg(F.min_by(F.col("attrs")["content"], "pos").alias("content"))
    extra = og.select("page_id", F.lit(True).alias("fallback"), F.lit(0).alias("rank"), upgrade_cdn(F.col("content")).alias("url"), F.lit(None).cast("int").alias("score"), F.lit('meta[property="og:image"]').alias("selector"))
    # candidates are ranked once: the page's own image stands among those that give way
    both = r.unionByName(extra).withColumn("any", F.max(~F.col("fallback")).over(Window.partitionBy("page_id"))).where("NOT any OR NOT fallback").drop("any")
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("rank")) == 1
    ordered = both.withColumn("first", first).where("first").withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("rank"))).where(F.col("rank") <= keep)
    return ordered.select("page_id", "rank", "url", "score", "selector", F.when(F.col("fallback"), "generic-fallback").otherwise("gallery-combined").alias("method"))
