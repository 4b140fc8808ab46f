"""Breadcrumbs by tiers: structured data, containers by meaning, by class, and lists of links, the first that gives two crumbs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import clean_crumbs, is_breadcrumb
from ..sources.files import written
from ..sources.html import html_nodes
from .selectors import matches, stripped, wants

#: Containers in order (a list within a navigation stands for the last of the first group).
BY_MEANING = ('[aria-label*="breadcrumb" i]', '[role="navigation"][aria-label*="breadcrumb" i]', 'nav[aria-label*="breadcrumb" i]', '[itemprop="breadcrumb"]')
BY_CLASS = ((".breadcrumb", ".breadcrumbs"), ('[class*="breadcrumb"]',), ('nav[class*="breadcrumb"]',), (".woocommerce-breadcrumb",), (".yoast-breadcrumb",))
NO_CRUMBS = r"footer|header|sidebar|menu|nav-|navigation-main|site-nav"
SITE_LINKS = r"(?i)^(new|sale|shop|gifts|accessories|about|contact|blog|account|cart|checkout)$"


def json_ld_crumbs(pages: DataFrame) -> DataFrame:
    """page_id, items: of the first BreadcrumbList of a page with two crumbs, in the order of its list."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    ld = pages.select("page_id", F.posexplode(blocks).alias("block", "raw")).select("page_id", "block", F.try_parse_json(F.trim("raw")).alias("ld")).where("ld IS NOT NULL")
    many = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    each = ld.select("page_id", "block", F.posexplode(F.coalesce(many("ld", "$"), F.array("ld"))).alias("nr", "x"))
    kinds = F.coalesce(F.try_variant_get("x", "$['@type']", "array<string>"), F.array(F.try_variant_get("x", "$['@type']", "string")))
    name = lambda v: F.coalesce(F.nullif(F.try_variant_get(v, "$.name", "string"), F.lit("")), F.try_variant_get(v, "$.item.name", "string"))
    listed = each.where(F.exists(kinds, lambda k: F.coalesce(k.rlike("(?i)breadcrumb"), F.lit(False)))).withColumn("list", many("x", "$.itemListElement")).where(F.size("list") >= 2)
    crumbs = listed.withColumn("items", clean_crumbs(F.filter(F.transform("list", name), lambda n: n.isNotNull() & (n != "")))).where(F.size("items") >= 2)
    return crumbs.groupBy("page_id").agg(F.min_by("items", F.struct("block", "nr")).alias("items"))


def _said(links: DataFrame) -> Column:
    own = stripped(F.col("own"))
    return F.when(own != "", own).otherwise(stripped(F.col("content")))


def _fit(texts: Column) -> Column:
    return F.filter(texts, lambda t: (t != "") & (F.length(t) < 50))


def _from_links(containers: DataFrame, links: DataFrame) -> DataFrame:
    """containers (page_id, rank, top, end) with the crumbs of their links: of the first kind of link of which there are two."""
    kinds = {"k0": matches('span[itemprop="name"]') & (F.col("above") == "li"), "k1": (F.col("tag") == "a") & (F.col("above") == "li"), "k2": matches('a[itemprop="item"]'), "k3": F.lit(True)}
    named = links.select("page_id", "pos", _said(links).alias("said"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in kinds.items()])
    held = containers.join(named.hint("merge"), "page_id").where("pos > top AND pos <= end").groupBy("page_id", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "said", *kinds))).alias("x"))
    of = lambda k: F.filter("x", lambda e: e[k])
    chosen = F.when(F.size(of("k0")) >= 2, of("k0")).when(F.size(of("k1")) >= 2, of("k1")).when(F.size(of("k2")) >= 2, of("k2")).otherwise(F.col("x"))
    return held.withColumn("items", clean_crumbs(_fit(F.transform(chosen, lambda e: e["said"])))).where((F.size("x") >= 2) & _valid())


def _valid() -> Column:
    return (F.size("items") >= 2) & is_breadcrumb(F.array_join("items", " > "), F.size("items"))


def _lists_of_links(n: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, rank (the place), items: of lists and boxes with two to eight links of their own, which are no part of a menu."""
    no = n.where(F.lower(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"])).rlike(NO_CRUMBS)).select("page_id", F.col("pos").alias("box"))
    by_class = n.where(F.lower(F.col("attrs")["class"]).rlike(NO_CRUMBS)).select("page_id", F.col("pos").alias("parent"))
    boxes = n.where(F.col("tag").isin("nav", "ol", "ul", "div")).join(by_class.hint("merge"), ["page_id", "parent"], "left_anti").select("page_id", F.col("pos").alias("box")).join(no.hint("merge"), ["page_id", "box"], "left_anti")
    a = links.where("tag = 'a'").select("page_id", "pos", "parent", "above", stripped(F.col("content")).alias("said"))
    step = n.where(F.col("tag").isin("li", "span")).select("page_id", F.col("pos").alias("parent"), F.col("parent").alias("grand"))
    a = a.join(step.hint("merge"), ["page_id", "parent"], "left").withColumn("box", F.coalesce("grand", "parent"))
    held = boxes.join(a.hint("merge"), ["page_id", "box"]).groupBy("page_id", "box").agg(F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("x")).where(F.size("x").between(2, 8))
    held = held.withColumn("texts", _fit(F.transform("x", lambda e: e["said"]))).where(~F.exists("texts", lambda t: t.rlike(SITE_LINKS)) & (F.size("texts") >= 2))
    return held.withColumn("items", clean_crumbs(F.col("texts"))).where(_valid()).select("page_id", F.col("box").alias("rank"), "items")


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """page_id, method (jsonld, semantic, class-pattern, structural), items: of pages that have any."""
    linked = wants("a", 'span[itemprop="name"]')
    junk = re.compile(NO_CRUMBS)
    fixed = wants(*BY_MEANING, *[s for x in BY_CLASS for s in x])
    keep = lambda tag, attrs: fixed(tag, attrs) or bool(junk.search(attrs.get("class", "").lower()))
    n = written(html_nodes(pages, ("nav", "ol", "ul", "div", "li", "span", "a"), keep=keep, text=linked))
    links = n.where(matches("a", 'span[itemprop="name"]'))
    far = F.max(F.when(matches('nav[role="navigation"]'), F.col("last"))).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("in_nav", F.coalesce(far >= F.col("pos"), F.lit(False)))
    ranked = [*[matches(s) for s in BY_MEANING], F.col("in_nav") & F.col("tag").isin("ol", "ul"), *[matches(*s) for s in BY_CLASS]]
    first = [F.min_by(F.when(c, F.struct("pos", "last")), F.when(c, F.col("pos"))).alias(f"s{i}") for i, c in enumerate(ranked)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"s{i}").alias("at")) for i in range(len(ranked))])).alias("c")
    containers = n.groupBy("page_id").agg(*first).select("page_id", each).where("c.at IS NOT NULL").select("page_id", "c.rank", F.col("c.at.pos").alias("top"), F.col("c.at.last").alias("end"))
    by_container = _from_links(containers, links)
    of = len(BY_MEANING) + 1
    found = json_ld_crumbs(pages).select("page_id", F.struct(F.lit(0).alias("tier"), F.lit(0).alias("rank")).alias("o"), F.lit("jsonld").alias("method"), "items")
    found = found.unionByName(by_container.select("page_id", F.struct(F.lit(1).alias("tier"), "rank").alias("o"), F.when(F.col("rank") < of, "semantic").otherwise("class-pattern").alias("method"), "items"))
    found = found.unionByName(_lists_of_links(n, links).select("page_id", F.struct(F.lit(2).alias("tier"), "rank").alias("o"), F.lit("structural").alias("method"), "items"))
    return found.groupBy("page_id").agg(F.min_by(F.struct("method", "items"), "o").alias("b")).select("page_id", "b.*")
