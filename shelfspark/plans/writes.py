"""Queries that read products with all that belongs to them, and that give tables as they stand after a write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import catalog as ops
from ..operators import logs, reconcile, selection
from ..sources import files
from . import hierarchy, tagger
from .registry import query, table, values


@query(f"""WITH RECURSIVE {hierarchy._PATHS}, t AS (SELECT p_partkey, list_sort(list(DISTINCT {{'name': name, 'type': tag_type}})) AS tag_details FROM {tagger._MATCH} GROUP BY 1),
  b AS (SELECT DISTINCT p_partkey, c.* FROM part JOIN c ON c.category_id IN (p_partkey % 5 + 1, 100 + p_partkey % 25)),
  k AS (SELECT p_partkey, list_sort(list({{'name': b.name, 'level': b.level, 'full_path': p.path}})) AS category_details, arg_max(p.path, b.level) AS category_full_path FROM b JOIN p USING (category_id) GROUP BY 1)
  SELECT p_partkey, p_name, coalesce(tag_details, []) AS tag_details, category_details, category_full_path FROM part JOIN k USING (p_partkey) LEFT JOIN t USING (p_partkey)""")
def get_products(spark, sf_dir):
    """Products with tags, categories and the path of the deepest category."""
    p = tagger.products(spark, sf_dir)
    t = tagging_of(spark, sf_dir)
    c = hierarchy.nodes(spark, sf_dir)
    b = p.select("p_partkey", F.explode(F.array((F.col("p_partkey") % 5 + 1).cast("int"), (100 + F.col("p_partkey") % 25).cast("int"))).alias("category_id")).join(c.hint("merge"), "category_id").select("p_partkey", "category_id", "name", "level")
    return ops.product_star(p.select("p_partkey", "p_name"), t, b, ops.category_paths(c), "p_partkey")


def tagging_of(spark, sf_dir):
    from ..operators import tagging

    return tagging.match_tags(tagger.products(spark, sf_dir), tagger.tags(spark), "p_partkey", "title")


@query("""SELECT n_name, r_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers, count(*) FILTER (WHERE s_acctbal > 0) AS solvent FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def star_join(spark, sf_dir):
    """A fact is aggregated before it meets its dimensions."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    s = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("solvent"))
    d = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return d.select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("solvent", F.lit(0)).alias("solvent"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
  UNION ALL SELECT c_custkey + 1000000, upper(c_mktsegment), c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 1""")
def upsert_products(spark, sf_dir):
    """Every customer is new again: the even ones under their own key, the others under another."""
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1000000)
    new = c.select(key.alias("c_custkey"), F.upper("c_mktsegment").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return ops.upsert(c.select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey")


@query("""SELECT 'https://s/' || p_partkey AS url, p_name AS title, CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(NULL AS VARCHAR) AS category, 0.0::DOUBLE AS confidence_score, true AS linked FROM part""")
def saved_products(spark, sf_dir):
    """Scraped records as raw rows and products that point to them."""
    p = table(spark, sf_dir, "part")
    scraped = p.select(F.concat(F.lit("https://s/"), "p_partkey").alias("url"), F.lit("2025-01-01").cast("timestamp").alias("ts"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("description"), F.format_string("$%.2f", "p_retailprice").alias("price"))
    raw, product = ops.raw_and_product(scraped)
    d = product.join(raw.select("raw_id", "url"), "raw_id")
    return d.select("url", "title", "price", "category", "confidence_score", (F.col("product_id") == F.xxhash64("raw_id")).alias("linked"))


@query("""SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def replaced_bridges(spark, sf_dir):
    """A bridge table in which some keys have got other rows."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"))
    return ops.replace_bridges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), new, "l_orderkey")


@query("""SELECT p_brand, name, source FROM (SELECT p_brand, name, source, row_number() OVER (PARTITION BY p_brand, lower(name) ORDER BY source DESC, p_partkey) AS r FROM
  (SELECT p_brand, p_name AS name, p_partkey, 'AUTO' AS source FROM part UNION ALL SELECT p_brand, upper(p_type || ' ' || p_name), p_partkey, 'AI' FROM part UNION ALL SELECT p_brand, upper(p_name), p_partkey, 'AI' FROM part)) WHERE r = 1""")
def merge_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey"))
    ai = p.withColumn("name", F.explode(F.array(F.upper(F.concat_ws(" ", "p_type", "p_name")), F.upper("p_name"))))
    return reconcile.merge_tags(p.withColumn("name", F.col("p_name")), ai, "p_brand")


_SQL_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(w, '{words}') THEN '{kind}'" for kind, words in fields.TAG_TIERS) + " ELSE 'features' END"


@query(f"""SELECT DISTINCT w AS name, {_SQL_TYPE} AS tag_type FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) WHERE w <> '' AND w NOT IN (SELECT name FROM {values(tagger.TAGS, "name, tag_type")})""")
def new_tags(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("name"))
    return reconcile.new_tags(s, tagger.tags(spark))


_MESSAGES = "CASE event_type WHEN 'error' THEN 'fetch failed' WHEN 'click' THEN 'blocked: ' || event_id ELSE event_type END"


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM events GROUP BY user_id""")
def session_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("message", F.col("event_type"))
    return logs.summary(e, "user_id").select("user_id", "started", "ended", "n")


@query(f"""WITH e AS (SELECT *, {_MESSAGES} AS message FROM events), r AS (SELECT user_id, message, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, message DESC) AS k FROM e WHERE event_type = 'click')
  SELECT e.user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS rejections, min(e.ts) AS started, max(e.ts) AS ended,
  coalesce((SELECT list(message ORDER BY k DESC) FROM r WHERE r.user_id = e.user_id AND k <= 10), []) AS last_rejections, coalesce(list('fetch failed') FILTER (WHERE event_type = 'error'), [])[1:5] AS last_errors FROM e GROUP BY e.user_id""")
def log_summary(spark, sf_dir):
    """Counts, and the last rejections and errors of each session."""
    e = table(spark, sf_dir, "events")
    message = F.when(F.col("event_type") == "error", "fetch failed").when(F.col("event_type") == "click", F.concat(F.lit("blocked: "), "event_id")).otherwise(F.col("event_type"))
    return logs.summary(e.withColumn("message", message), "user_id")


@query("""SELECT event_id, user_id AS host, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 10""")
def last_ten(spark, sf_dir):
    """The last ten entries of each host's history."""
    return files.last_history(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), "ts"), "event_id")


@query("""SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def fresh_cache(spark, sf_dir):
    """What a cache still holds at the time of its last entry."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]  # one value
    return files.fresh(e, F.lit(now)).select("event_id", "event_type")


@query("""SELECT c_custkey AS url, c_name AS answer FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0""")
def cache_writes(spark, sf_dir):
    """A cache after keyed puts and deletes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("answer"))
    return files.delete(files.put(c, c.where("url % 3 = 0").withColumn("answer", F.lit("new"))), c.where("url % 7 = 0"))


@query("""SELECT s_nationkey AS host, s_name AS field FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey % 4 <> 0""")
def memory_writes(spark, sf_dir):
    """Selector memory after some fields, and all fields of some hosts, have been deleted."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), F.col("s_name").alias("field"), "s_suppkey")
    gone = s.where("s_suppkey % 4 = 0").select("host", "field").unionByName(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("host"), F.lit(None).cast("string").alias("field")))
    return files.delete_fields(s.select("host", "field"), gone)


@query("""SELECT p_type AS synonym, p_type || '!' AS name FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT DISTINCT c_mktsegment, 'saved' FROM customer""")
def merged_synonyms(spark, sf_dir):
    """Saved synonyms win over built-in ones."""
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("synonym"), F.lit("saved").alias("name")).distinct()
    built_in = table(spark, sf_dir, "part").select(F.col("p_type").alias("synonym"), F.concat("p_type", F.lit("!")).alias("name")).distinct().unionByName(seg.withColumn("name", F.lit("built in")))
    return ops.merged_synonyms(built_in, seg)


@query("""SELECT 'https://c/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 2 THEN 'unknown' ELSE 'sel' || p_size END AS selector FROM part""")
def selector_lineage(spark, sf_dir):
    """The selector that found an image, by its URL as it is, or without its protocol."""
    p = table(spark, sf_dir, "part")
    scheme = F.when(F.col("p_partkey") % 3 == 0, "https").when(F.col("p_partkey") % 3 == 1, "http").otherwise("ftp")
    known = p.select(F.concat(scheme, F.lit("://c/"), "p_partkey").alias("url"), F.concat(F.lit("sel"), "p_size").alias("selector"))
    return ops.selector_lineage(p.select(F.concat(F.lit("https://c/"), "p_partkey").alias("url")), known)


@query("""WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f DESC, l_suppkey DESC) AS r FROM n) WHERE r = 1""")
def majority_value(spark, sf_dir):
    return selection.majority(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")
