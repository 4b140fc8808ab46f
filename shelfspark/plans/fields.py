"""Queries on pages and on single fields of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, text
from ..operators import extract
from ..sources import html
from .registry import query, spread, table

_UNESCAPED = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_OWN = lambda tag: _UNESCAPED(f"trim(regexp_replace(regexp_extract(html, '<{tag}[^>]*>([^<]*)<', 1), '\\s+', ' ', 'g'))")


@query(f"""SELECT page_id, {_OWN('title')} AS page_title, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_links FROM pages WHERE regexp_matches(url, '^https?:', 'i')""")
def page_counts(spark, sf_dir):
    """Scan, parse and project; non-HTTP pages are refused."""
    n = html.html_nodes(table(spark, sf_dir, "pages"), ("title", "a"))
    title = F.col("tag") == "title"
    return n.groupBy("page_id").agg(F.min_by(F.when(title, text.collapse_space(F.col("content"))), F.when(title, F.col("pos"))).alias("page_title"), F.count_if(F.col("tag") == "a").alias("n_links"))


@query(f"""SELECT page_id, coalesce(NULLIF({_OWN('h1')}, ''), NULLIF({_OWN('title')}, '')) AS title, NULLIF({_OWN('h1')}, '') AS h1, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_links
  FROM pages WHERE regexp_matches(url, '^https?:', 'i')""")
def page_extract(spark, sf_dir):
    return html.page_fields(table(spark, sf_dir, "pages"))


#: Pages of products as shops make them: structured data in two blocks (a list and a graph), marked-up fields, crumbs.
_PAGE = """concat('<title>Shop</title><script type="application/ld+json">[{"@type":"WebSite","name":"x"},{"@type":"Product","name":"', p_name, '","brand":{"name":"', p_brand, '"},"image":["a.jpg","b.jpg"],"offers":[{"price":"', CAST(p_size AS STRING), '.50","priceCurrency":"USD"}]}]</script>',
  '<script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"other","sku":"S9","offers":{"lowPrice":"1"}}]}</script><script type="application/ld+json">{broken</script>',
  CASE WHEN p_size % 2 = 0 THEN '<h1>A fine thing</h1>' ELSE '' END, '<div class="breadcrumb">Home</div><div class="breadcrumb">', p_type, '</div><img src=x.jpg>')"""


def product_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://www.shop.com/p/"), "p_partkey").alias("url"), F.expr(_PAGE).alias("html"))


@query("""SELECT p_partkey AS page_id, p_name AS title, p_brand AS brand, CAST(NULL AS VARCHAR) AS sku, p_size || '.50' AS price, 'USD ' || p_size || '.50' AS money, ['a.jpg', 'b.jpg'] AS images FROM part""")
def product_data(spark, sf_dir):
    """Of each page the first Product of its structured data, whole: fields of several are not mixed."""
    d = extract.product_json_ld(product_pages(spark, sf_dir))
    return d.select("page_id", *[F.col(f"ld_{c}").alias(c) for c in ("title", "brand", "sku", "price", "money", "images")])


@query("""SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN 'A fine thing' ELSE 'Shop' END AS title, p_brand AS brand, CAST(p_size + 0.5 AS DOUBLE) AS price, ['Home', p_type] AS breadcrumbs, p_size % 2 = 0 AS is_product_page FROM part""")
def page_record(spark, sf_dir):
    """The record of a product page by chains of sources."""
    return extract.page_record(product_pages(spark, sf_dir)).select("page_id", "title", "brand", "price", "breadcrumbs", "is_product_page")


@query("""SELECT doc_id, coalesce(length(text) < 20 OR regexp_matches(trim(text), '^(shop |buy |get |order |see all |view all |free shipping|sale|limited time|exclusive)', 'i'), true) AS fluff, substring(text, 1, 400) AS head,
  length(regexp_replace(text, '\\s+', ' ', 'g')) AS n_chars FROM documents""")
def text_flags(spark, sf_dir):
    """Promotional or too short; the first 400 characters, and the length with white space collapsed."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fields.is_fluff(F.col("text")).alias("fluff"), fields.cut(F.col("text"), 400).alias("head"), F.length(F.regexp_replace("text", r"\s+", " ")).cast("long").alias("n_chars"))


@query("""SELECT p_partkey, [p_brand, p_type, 'Zip Ups'] AS crumbs, true AS valid, [p_brand, p_type] AS split FROM part""")
def breadcrumbs(spark, sf_dir):
    """Crumbs with words run together, separators, leads, entities, junk and an error, cleaned."""
    items = F.array(F.lit("BackHome"), F.lit("Home"), F.concat(F.lit("Go to "), "p_brand", F.lit(" / "), "p_type"), F.lit("Shop All"), F.lit("Zip Ups&nbsp;"), F.lit("404 page"), F.lit(None).cast("string"))
    p = table(spark, sf_dir, "part")
    clean = F.filter(fields.clean_crumbs(items), lambda x: x != "Home")
    return p.select("p_partkey", clean.alias("crumbs"), fields.is_breadcrumb(F.concat_ws(" > ", "p_brand", "p_type"), F.lit(2)).alias("valid"), fields.split_crumbs(F.concat_ws(" » ", "p_brand", "p_type")).alias("split"))


_HOSTS = [("www.amazon.de", "amazon"), ("boohooman.com", "boohoo"), ("shop.lululemon.com", "lululemon"), ("home.com", "homedepot"), ("ae.com", "ae"), ("example.com", None), ("m.nike.com", "nike"), ("bestbuy.com", "bestbuy")]


@query("SELECT p_partkey, host, site FROM part, (VALUES " + ", ".join(f"({i}, '{h}', {repr(s) if s else 'NULL'})" for i, (h, s) in enumerate(_HOSTS)) + f") AS t(i, host, site) WHERE i = p_size % {len(_HOSTS)}")
def site_names(spark, sf_dir):
    """The first site whose pattern a host fits."""
    host = F.get(F.array(*[F.lit(h) for h, _ in _HOSTS]), (F.col("p_size") % len(_HOSTS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", host.alias("host"), fields.site_of(host).alias("site"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'materials' WHEN 1 THEN 'colors' WHEN 2 THEN 'fit' WHEN 3 THEN 'styles' WHEN 4 THEN 'activities' ELSE 'features' END AS tag_type FROM part""")
def tag_types(spark, sf_dir):
    """Types of tags that no dictionary knows."""
    name = F.get(F.array(*map(F.lit, ("Faux Suede", "Navy", "relaxed", "Boho chic", "hiking", "pocket"))), (F.col("p_size") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.tag_type(name).alias("tag_type"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['.a', '.b', '.c', '.d'] WHEN 1 THEN ['h1'] ELSE [] END AS candidates FROM part""")
def model_answers(spark, sf_dir):
    """The first four selectors of a model's answer, well formed or not."""
    answer = F.get(F.array(F.lit('{"label":"x","candidates":[".a",1,".b",".c",".d",".e"]}'), F.lit('Sure: ["h1", 2] is best'), F.lit("none"), F.lit("[broken")), (F.col("p_size") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.parsed_candidates(answer).alias("candidates"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 12.5 WHEN 1 THEN CAST(p_size + 100 AS DOUBLE) ELSE 20.25 END AS price, CAST(p_size + 100 AS VARCHAR) AS shown FROM part""")
def refined_prices(spark, sf_dir):
    """A price from an attribute, else the one found, else the plausible one around."""
    k = F.col("p_size") % 3
    base = F.when(k == 1, F.col("p_size") + 100).otherwise(F.lit(0.5)).cast("double")
    around = F.array(F.lit("only $30"), F.lit("now $20.25"), F.lit("$15"), F.lit("$1.99"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.refined_price(F.when(k == 0, "12.5"), base, around).alias("price"), fields.sale_price(F.concat(F.lit("Now $"), F.col("p_size") + 100)).alias("shown"))


@query("""SELECT event_type, event_type = 'error' AS debug, event_type IN ('view', 'click') AS nav, CAST(event_type = 'purchase' AS INTEGER) * 2 AS selling, count(*) AS n FROM events GROUP BY event_type""")
def message_flags(spark, sf_dir):
    """Debug messages, navigation texts and selling phrases."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    message = F.when(F.col("event_type") == "error", "DEBUG: gone").when(F.col("event_type") == "view", " Sign In ").when(F.col("event_type") == "click", "42").when(F.col("event_type") == "purchase", "Buy now, in stock").otherwise("hello")
    return e.select("event_type", fields.is_debug(message).alias("debug"), fields.is_navigation(message).alias("nav"), fields.selling_phrases(message).alias("selling"), "n")
