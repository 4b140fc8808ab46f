"""The catalog's queries over the test tables, each with the SQL it is held against.

Products are the rows of part: title p_name, brand p_brand, breadcrumbs and price derived from type and retail price.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import catalog as ops
from ..operators import selection, taxonomy
from ..streaming import sessions
from .registry import query, table, values

TAGS = values(rules.TAGS, "name, tag_type")


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, md5(url) AS url_hash FROM pages""")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.md5("url").alias("url_hash"))


@query("""SELECT page_id, replace(replace(array_to_string(list_filter(list_transform(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''),
  lambda x: regexp_replace(x, '\\.(html|php|aspx)$', '', 'i')), lambda x: NOT regexp_matches(x, '^[A-Za-z0-9]{8,}$')), ' '), '-', ' '), '_', ' ') AS keywords FROM pages""")
def url_keywords(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_keywords(F.col("url")).alias("keywords"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(p_name), '\\s+', '-', 'g') AS tag_slug FROM part""")
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"), text.space_slug(F.col("p_name")).alias("tag_slug"))


@query("""SELECT p_partkey, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS now_price FROM part WHERE p_retailprice BETWEEN 5 AND 100000""")
def sale_prices(spark, sf_dir):
    """Prices read back out of the text a page would show."""
    p = table(spark, sf_dir, "part").where("p_retailprice BETWEEN 5 AND 100000")
    shown = F.concat(F.lit("Was $"), F.format_number(F.col("p_retailprice") + 100, 2), F.lit(" Now $"), F.format_number("p_retailprice", 2))
    return p.select("p_partkey", text.best_price(shown).alias("now_price"))


@query("""SELECT count(*) AS total, count(DISTINCT p_type) AS categories, CAST(avg(p_size) AS DECIMAL(12,2)) AS avg_size, count(*) FILTER (WHERE p_size < 10) AS small FROM part""")
def product_stats(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("total"), F.countDistinct("p_type").alias("categories"), F.avg("p_size").cast("decimal(12,2)").alias("avg_size"), F.count_if(F.col("p_size") < 10).alias("small"))


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#11' AND p_retailprice >= 900 ORDER BY p_retailprice DESC, p_partkey LIMIT 50""")
def product_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_brand = 'Brand#11' AND p_retailprice >= 900")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_retailprice")


@query(f"""SELECT name FROM {TAGS} UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part""")
def insert_absent_tags(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    return ops.insert_absent(words, ops.tags(spark).select("name"), ["name"])


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return sessions.session_summary(table(spark, sf_dir, "events"))


@query("""SELECT event_id, event_type FROM events WHERE event_type ILIKE '%ER%' OR event_type ILIKE 'c%k'""")
def log_search(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").ilike("%ER%") | F.col("event_type").ilike("c%k")).select("event_id", "event_type")


@query("""SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("n > 1")


@query("""SELECT event_type, count(*) AS n, avg(CAST(props->>'$.k' AS DOUBLE)) AS avg_k, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY event_type""")
def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("avg_k"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\b(ring|gear)\\b') THEN 'Jewelry & Watches' END AS dept, array_to_string(list_filter([p_type, p_type, p_brand], lambda x, i: i = 1 OR x <> [p_type, p_type, p_brand][i - 1]), ' > ') AS path FROM part""")
def consecutive_path(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = text.drop_repeats(F.array("p_type", "p_type", "p_brand"))
    return p.select("p_partkey", F.when(F.col("p_name").rlike(r"\b(ring|gear)\b"), "Jewelry & Watches").alias("dept"), F.array_join(path, " > ").alias("path"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_of_group(spark, sf_dir):
    """Arg-max per key as an aggregate, which combines before the shuffle."""
    o = table(spark, sf_dir, "orders")
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN r = 1 THEN s ELSE s || '-' || (r - 1) END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def unique_slugs(spark, sf_dir):
    return taxonomy.unique_slugs(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "slug")


@query(f"""WITH p AS (SELECT DISTINCT 'Hardware' AS a, 'Widgets' AS b, p_type AS c FROM part), x AS (SELECT a AS path, 0 AS level FROM p UNION SELECT a || ' > ' || b, 1 FROM p UNION SELECT a || ' > ' || b || ' > ' || c, 2 FROM p)
  SELECT path, level FROM x WHERE path NOT IN ('Hardware', 'Hardware > Widgets')""")
def path_walk_creates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" > ", F.lit("Hardware"), F.lit("Widgets"), "p_type").alias("path")).distinct()
    return taxonomy.missing_levels(p, ops.category_paths(ops.categories(spark)).select("path").distinct())


@query("""SELECT DISTINCT 'Hardware > Widgets > ' || p_type AS path, 2 AS depth FROM part""")
def path_walk_stops(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" > ", F.lit("Hardware"), F.lit("Widgets"), "p_type").alias("path")).distinct()
    return taxonomy.known_prefix(p, ops.category_paths(ops.categories(spark)).select("path").distinct())


@query("""SELECT lower(trim(c_mktsegment)) AS synonym, arg_max(c_name, c_custkey) AS category_name, max(c_custkey) AS seq FROM customer GROUP BY 1""")
def synonyms_latest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("synonym"), F.col("c_name").alias("category_name"), F.col("c_custkey").alias("seq"))
    return taxonomy.save_synonyms(c.limit(0), c)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity > 20 AND sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) <= 3 AS in_quota FROM lineitem""")
def first_matches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return selection.first_matches(li, "l_orderkey", "seq", F.col("l_quantity") > 20).select("l_orderkey", "l_linenumber", "l_suppkey", "in_quota")
