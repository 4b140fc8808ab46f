"""Queries on image URLs. Candidates of a product are URLs of several hosts made from its name and key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import images as img
from ..functions.text import best_of_srcset, canonical_image_key
from ..operators import catalog as ops
from ..operators import selection
from .registry import query, spread, table

_SLUG = "replace(p_name, ' ', '-')"
#: A candidate's URL, its large version and its canonical key, as SQL that both engines read; whether it is neither junk nor
#: refused by name; whether it comes from a srcset.
FORMS = [
    (f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '_94x.jpg')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '_1020x.jpg')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '.jpg')", True, False),
    (f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '_640x.jpg?v=1')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '_1020x.jpg?v=1')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '.jpg')", True, True),
    (f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '-back_1200x1200.webp')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '-back_1200x1200.webp')", f"concat('https://cdn.shopify.com/s/files/1/products/', {_SLUG}, '-back.webp')", True, False),
    (f"concat('https://img.ltwebstatic.com/images3/', {_SLUG}, '_thumbnail_220x293.webp')", f"concat('https://img.ltwebstatic.com/images3/', {_SLUG}, '.webp')", f"concat('https://img.ltwebstatic.com/images3/', {_SLUG}, '.webp')", False, False),
    (f"concat('https://res.cloudinary.com/shop/w_400/', {_SLUG}, '.jpg')", f"concat('https://res.cloudinary.com/shop/w_1280/', {_SLUG}, '.jpg')", f"concat('https://res.cloudinary.com/shop//', {_SLUG}, '.jpg')", True, False),
    (f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_b?$a15-pdp-detail-shot$')", f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_b?$redesign-zoom-5x$')", f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_b')", True, False),
    (f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_swatch/x?wid=100')", f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_swatch/x')", f"concat('https://images.urbndata.com/is/image/', {_SLUG}, '_swatch/x')", True, False),
    (f"concat('https://cdn.shocho.co/sc-image/', {_SLUG}, '.jpg')", f"concat('https://cdn.shocho.co/sc-image/', {_SLUG}, '.jpg')", f"concat('https://cdn.shocho.co/sc-image/', {_SLUG}, '.jpg')", True, False),
    (f"concat('https://www.shop.com/assets/', {_SLUG}, '-logo.png')", f"concat('https://www.shop.com/assets/', {_SLUG}, '-logo.png')", f"concat('https://www.shop.com/assets/', {_SLUG}, '-logo.png')", True, False),
    (f"concat('https://www.shop.com/media/', {_SLUG}, '.svg')", f"concat('https://www.shop.com/media/', {_SLUG}, '.svg')", f"concat('https://www.shop.com/media/', {_SLUG}, '.svg')", False, False),
    (f"concat('data:image/png;base64,', {_SLUG})", f"concat('data:image/png;base64,', {_SLUG})", f"concat('data:image/png;base64,', {_SLUG})", False, False),
    (f"concat('https://i.etsystatic.com/il_340x270.', {_SLUG}, '.jpg')", f"concat('https://i.etsystatic.com/il_1200x1200.', {_SLUG}, '.jpg')", f"concat('https://i.etsystatic.com/il.', {_SLUG}, '.jpg')", True, False),
]
_LIST = lambda k: "[" + ", ".join(f[k] if isinstance(f[k], str) else str(f[k]).lower() for f in FORMS) + "]"
SQL_CANDIDATES = f"(SELECT p_partkey AS page_id, unnest({_LIST(0)}) AS url, unnest({_LIST(1)}) AS large, unnest({_LIST(2)}) AS canonical, unnest({_LIST(3)}) AS fine, unnest({_LIST(4)}) AS from_srcset, unnest(range({len(FORMS)})) AS pos FROM part)"


def candidates(spark, sf_dir):
    """page_id, pos, url, from_srcset"""
    each = F.array(*[F.struct(F.expr(f[0]).alias("url"), F.lit(i).cast("int").alias("pos"), F.lit(f[4]).alias("from_srcset")) for i, f in enumerate(FORMS)])
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("page_id"), F.explode(each).alias("i")).select("page_id", "i.*")


def _sql_score() -> str:
    """The additive score in SQL, from the same fixed values."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    has = lambda p: f"regexp_matches(url, {q(p)}, 'i')"
    number = lambda p: f"TRY_CAST(regexp_extract(url, {q(p)}, 1, 'i') AS INTEGER)"
    thumb, px = number(r"_(?:AC_)?(?:US|SS|SY|SR|UL)(\d+)(?:_|\.)"), "greatest(" + ", ".join(number(p) for p in img.SIZES) + ")"
    quality = "coalesce(" + ", ".join(number(p) for p in ("quality=([0-9]+)", "q_([0-9]+)", "q([0-9]+)")) + ")"
    parts = [
        f"CASE WHEN {thumb} <= 40 THEN -60 WHEN {thumb} <= 64 THEN -50 WHEN {thumb} <= 100 THEN -40 WHEN {thumb} <= 200 THEN -20 WHEN {thumb} >= 800 THEN 25 WHEN {thumb} >= 400 THEN 15 ELSE 0 END",
        f"CASE WHEN {px} >= 1200 THEN 100 WHEN {px} >= 800 THEN 80 WHEN {px} >= 600 THEN 60 WHEN {px} >= 400 THEN 30 WHEN {px} > 0 AND {px} < 200 THEN 10 ELSE 0 END",
        f"CASE WHEN {quality} >= 90 THEN 20 WHEN {quality} >= 80 THEN 15 WHEN {quality} >= 70 THEN 10 WHEN {quality} < 50 THEN -15 ELSE 0 END",
        *[f"CASE WHEN {has(p)} THEN {n} ELSE 0 END" for n, p in img.URL_POINTS],
        "CASE WHEN pos < 1 THEN 60 WHEN pos < 3 THEN 50 WHEN pos < 5 THEN 40 WHEN pos < 10 THEN 30 ELSE 0 END", "CASE WHEN from_srcset THEN 15 ELSE 0 END",
    ]
    own = "CASE WHEN contains(url, 'urbndata') THEN CASE WHEN contains(url, '_swatch/') THEN 0 WHEN contains(url, '$redesign-zoom-5x$') THEN 95 ELSE 55 END WHEN contains(url, 'cdn.shocho.co') THEN 90 END"
    return f"coalesce({own}, greatest(0, 50 + {' + '.join(parts)}))"


_SCORED = f"(SELECT *, CAST({_sql_score()} AS INTEGER) AS score FROM {SQL_CANDIDATES})"
_BYTES = "CASE WHEN px IS NULL THEN 30000 WHEN px >= 1000 THEN 100000 WHEN px >= 600 THEN 60000 WHEN px >= 300 THEN 25000 ELSE 8000 END"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, score FROM {_SCORED}")
def image_score(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("page_id", "pos", img.image_score(F.col("url"), F.col("pos"), F.col("from_srcset")).alias("score"))


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, large, canonical FROM {SQL_CANDIDATES}")
def cdn_upgrade(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("large", img.upgrade_cdn(F.col("url")))
    return c.select("page_id", "pos", "large", canonical_image_key(F.col("large")).alias("canonical"))


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY page_id, canonical ORDER BY score DESC, pos) AS r, TRY_CAST(regexp_extract(lower(large), '([0-9]{{3,4}})x', 1) AS INTEGER) AS px FROM {_SCORED} WHERE fine AND score >= 40),
  k AS (SELECT *, CAST({_BYTES} AS INTEGER) AS bytes FROM b WHERE r = 1)
  SELECT page_id, canonical, large AS url, score, CAST(pos AS INTEGER) AS pos, bytes, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, bytes DESC, pos) AS INTEGER) AS rank
  FROM k WHERE contains(large, 'shopify') OR score >= 65 AND bytes >= 15000 OR bytes >= 20000""")
def image_ranking(spark, sf_dir):
    """Candidate images of products: filtered, scored, rewritten, deduplicated and ranked for each product."""
    return ops.rank_images(candidates(spark, sf_dir)).select("page_id", "canonical", "url", "score", "pos", "bytes", "rank")


@query(f"""SELECT count(*) FILTER (WHERE contains(url, 'data:')) AS invalid, count(*) FILTER (WHERE NOT contains(url, 'data:') AND NOT fine) AS junk, count(*) FILTER (WHERE fine AND score < 40) AS low_score, count(*) FILTER (WHERE fine AND score >= 40) AS kept FROM {_SCORED}""")
def image_filter_counts(spark, sf_dir):
    """What the filters of the ranking refuse, by reason."""
    c = candidates(spark, sf_dir).select(F.explode(F.array(img.judged(F.col("url"), F.col("pos"), F.col("from_srcset")))).alias("j")).select("j.*")
    why, score = F.col("why"), F.col("score")
    return c.agg(F.count_if(why.isin("empty", "invalid")).alias("invalid"), F.count_if(why == "junk").alias("junk"), F.count_if(score < 40).alias("low_score"), F.count_if(score >= 40).alias("kept"))


@query(f"""WITH g AS (SELECT page_id, canonical, count(*) AS n, arg_max(large, 100000 * score - pos) AS large, max(score) AS score FROM {_SCORED} WHERE fine AND score >= 40 GROUP BY ALL),
  k AS (SELECT *, TRY_CAST(regexp_extract(lower(large), '([0-9]{{3,4}})x', 1) AS INTEGER) AS px FROM g), f AS (SELECT *, contains(large, 'shopify') OR score >= 65 AND {_BYTES} >= 15000 OR {_BYTES} >= 20000 AS fits FROM k)
  SELECT (SELECT count(*) FROM {_SCORED} WHERE url = '') AS empty, (SELECT count(*) FROM {_SCORED} WHERE contains(url, 'data:')) AS invalid, (SELECT count(*) FROM {_SCORED} WHERE NOT contains(url, 'data:') AND NOT fine) AS junk, (SELECT count(*) FROM {_SCORED} WHERE fine AND score < 40) AS low_score,
  count(*) FILTER (WHERE n > 1) AS duplicate_groups, count(*) FILTER (WHERE NOT fits) AS small_file, count(*) FILTER (WHERE fits) AS kept FROM f""")
def image_audit(spark, sf_dir):
    """What each step of the ranking refused and kept, counted by the very job that ranked."""
    audit = ops.ImageAudit()
    ops.rank_images(candidates(spark, sf_dir), audit=audit).write.format("noop").mode("overwrite").save()
    names = ("empty", "invalid", "junk", "low_score", "duplicate_groups", "small_file", "kept")
    return spark.createDataFrame([tuple(audit.counts()[c] for c in names)], ", ".join(f"{c} long" for c in names))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
  s AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'div.main > ul > img' WHEN 1 THEN 'div.main > img' WHEN 2 THEN 'img' END AS path, CASE p_size % 4 WHEN 0 THEN 'div.main > ul' WHEN 1 THEN 'div.main' WHEN 2 THEN 'img' END AS container FROM r),
  w AS (SELECT p_brand, arg_min(container, first) AS win FROM (SELECT p_brand, container, min(rank) AS first FROM s WHERE rank <= 6 AND container IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
  SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(starts_with(path, win), false) DESC, rank) AS INTEGER) AS new_rank FROM s LEFT JOIN w USING (p_brand)""")
def container_consensus(spark, sf_dir):
    """Images of the first container with two among a brand's first six move to the front."""
    path = F.get(F.array(F.lit("div.main > ul > img"), F.lit("div.main > img"), F.lit("img"), F.lit(None).cast("string")), (F.col("p_size") % 4).cast("int"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    ranked = table(spark, sf_dir, "part").select("p_brand", "p_partkey", path.alias("selector"), rank.alias("rank"))
    return selection.winning_container_first(ranked, "p_brand", "selector").select("p_brand", "p_partkey", "new_rank")


_PLAIN = ["concat('https://a.com/x/', p_name, '_web.png')", "concat('https://a.com/cdn/shop/files/logo.png?', p_name)", "concat('https://a.com/cdn/shop/files/', p_size, '_300x300.jpg')", "concat('https://a.com/velvet/', p_size, '.jpg')", "concat('https://a.com/gallery/', p_size)", "concat('/p/', p_size, '?$n_640w')", "''", "concat('https://a.com/page?id=', p_size)"]


@query(f"""SELECT p_partkey, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'Feature icon' WHEN 1 THEN 'Shopify theme asset' WHEN 3 THEN 'Fabric pattern' WHEN 6 THEN 'empty URL' END AS reason, i NOT IN (6, 7) AS looks, i IN (0, 1, 2, 3, 4, 5, 7) AS is_real, i <> 1 AS product
  FROM (SELECT p_partkey, unnest(range({len(_PLAIN)})) AS i FROM part)""")
def image_predicates(spark, sf_dir):
    u = F.col("url")
    c = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*map(F.expr, _PLAIN))).alias("pos", "url"))
    return c.select("p_partkey", "pos", img.junk_reason(u).alias("reason"), img.looks_like_image(u).alias("looks"), img.is_real_url(u).alias("is_real"), img.is_product_image(u).alias("product"))


@query("""SELECT p_partkey, 'https://b.com/' || p_size || '.jpg' AS widest, 'https://b.com/' || p_size || '.jpg' AS last, 'https://c.com/a,b/' || p_size || '.jpg' AS last_url,
  CAST(p_size * (p_size + 1) AS BIGINT) AS pixels, CAST(p_size * p_size AS BIGINT) AS square, 'https://d.com/a' AS bare FROM part""")
def srcset_choices(spark, sf_dir):
    """Which URL of a srcset is taken, and the pixels that a URL names."""
    p = table(spark, sf_dir, "part")
    one = F.concat(F.lit("https://a.com/x.jpg 1w, https://b.com/"), "p_size", F.lit(".jpg 900w"))
    commas = F.concat(F.lit("https://c.com/a,b/1.jpg 1x, https://c.com/a,b/"), "p_size", F.lit(".jpg"))
    sized, square = F.concat(F.lit("https://d.com/s"), "p_size", F.lit("x"), F.col("p_size") + 1, F.lit("/a")), F.concat(F.lit("https://d.com/a_"), "p_size", F.lit("x/b"))
    return p.select("p_partkey", best_of_srcset(one).alias("widest"), img.last_of_srcset(one).alias("last"), img.last_url_of_srcset(commas).alias("last_url"), img.pixel_count(sized).alias("pixels"), img.pixel_count(square).alias("square"), F.regexp_replace(img.without_dimensions(sized), "/a$|//a$", "/a").alias("bare").substr(1, 15).alias("bare"))


@query("""SELECT page_id, NULLIF(regexp_extract(url, '/([A-Za-z0-9]+)\\.html', 1), '') AS product_id, list_filter(string_split(coalesce(list_last(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'),
  lambda x: NOT regexp_matches(x, '^[A-Za-z0-9_-]{3,15}$') AND NOT regexp_matches(x, '\\.(html?|php|aspx?)$', 'i') AND (contains(x, '-') OR length(x) > 15))), ''), '-'), lambda x: length(x) > 3 AND NOT regexp_matches(x, '^[0-9]+$')) AS keywords FROM pages""")
def page_product(spark, sf_dir):
    """Product id and keywords that a page's URL names."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", img.page_product_id(path).alias("product_id"), img.product_keywords(path).alias("keywords"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST(CASE i WHEN 0 THEN 100 + 50 + 50 WHEN 1 THEN 75 WHEN 2 THEN -50 + 50 ELSE 0 END AS INTEGER) AS relevance FROM (SELECT p_partkey, unnest(range(4)) AS i FROM part)""")
def image_relevance(spark, sf_dir):
    """Place on the page, product id and keywords in one score."""
    pid = F.lpad(F.col("p_partkey").cast("string"), 8, "9")
    rows = [(F.concat(F.lit("https://a.com/"), pid, F.lit("_suede.jpg")), "product-gallery"), (F.lit("https://a.com/b.jpg"), "swiper-slide"), (F.lit("https://a.com/suede.jpg"), "related-items"), (F.lit("https://a.com/c.jpg"), "img")]
    each = F.array(*[F.struct(u.alias("url"), F.lit(s).alias("selector")) for u, s in rows])
    c = table(spark, sf_dir, "part").select("p_partkey", pid.alias("pid"), F.posexplode(each).alias("pos", "i"))
    return c.select("p_partkey", "pos", img.relevance(F.col("i.url"), F.col("i.selector"), F.col("pid"), F.array(F.lit("suede"))).alias("relevance"))


@query("""WITH c AS (SELECT p_brand, p_size, max(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS jpg, max(p_size + 30) AS prefix FROM part GROUP BY 1, 2)
  SELECT p_brand, 'k' || p_size AS key, CAST(CASE WHEN prefix >= 81 THEN 90 WHEN prefix >= 71 THEN 80 WHEN prefix >= 61 THEN 60 WHEN prefix >= 51 THEN 40 WHEN prefix >= 41 THEN 20 ELSE 10 END AS INTEGER) AS quality FROM c""")
def best_by_quality(spark, sf_dir):
    """The best version of each image of a brand, quality being a number in its URL."""
    u = F.concat(F.lit("https://m.media-amazon.com/images/I/"), F.col("p_size") + 30, F.lit("k"), "p_size", F.lit("._AC_SX300_.jpg?x"))
    p = table(spark, sf_dir, "part").select("p_brand", img.amazon_large(u).alias("url"))
    keyed = p.select("p_brand", F.regexp_replace(img.amazon_key(F.col("url")), r"^\d\d", "").alias("key"), img.amazon_quality(F.col("url")).alias("quality"), "url")
    return selection.keep_best(keyed, ["p_brand", "key"], F.col("quality"), F.col("url")).select("p_brand", "key", "quality")
