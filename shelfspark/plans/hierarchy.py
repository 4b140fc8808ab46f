"""Queries on a taxonomy of three levels, made of regions, nations and customers: a customer is a node named by its segment and a
digit, so nodes have twins; one node hangs in the air and one root has a twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..operators import taxonomy
from .registry import query, table

_NODES = """SELECT CAST(r_regionkey + 1 AS INT) AS category_id, r_name AS name, CAST(NULL AS INT) AS parent_id, 0 AS level, 0 AS llm_discovered FROM {region}
  UNION ALL SELECT CAST(100 + n_nationkey AS INT), n_name, CAST(n_regionkey + 1 AS INT), 1, 0 FROM {nation}
  UNION ALL SELECT CAST(1000 + c_custkey AS INT), concat(c_mktsegment, ' ', CAST(c_custkey % 7 AS STRING)), CAST(100 + c_nationkey AS INT), 2, CAST(c_custkey % 3 = 0 AS INT) FROM {customer}
  UNION ALL SELECT 97, 'Orphan', 999999, 2, 0 UNION ALL SELECT 98, 'ASIA', CAST(NULL AS INT), 0, 1"""
CATS = "(" + _NODES.format(region="region", nation="nation", customer="customer") + ")"
_PATHS = f"""c AS {CATS}, p AS (SELECT category_id, name AS path, 0 AS depth FROM c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT category_id FROM c)
  UNION ALL SELECT c.category_id, p.path || ' > ' || c.name, p.depth + 1 FROM p JOIN c ON c.parent_id = p.category_id)"""


def nodes(spark, sf_dir):
    """category_id, name, parent_id, level, llm_discovered"""
    return spark.sql(_NODES, **{t: table(spark, sf_dir, t) for t in ("region", "nation", "customer")})


@query(f"WITH RECURSIVE {_PATHS} SELECT category_id, path, depth FROM p")
def category_paths(spark, sf_dir):
    return ops.category_paths(nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE c AS {CATS}, d AS (SELECT category_id FROM c WHERE name = 'ASIA' AND parent_id IS NULL UNION ALL SELECT c.category_id FROM d JOIN c ON c.parent_id = d.category_id)
  SELECT category_id, name FROM c WHERE category_id NOT IN (SELECT category_id FROM d)""")
def subtree_delete(spark, sf_dir):
    c = nodes(spark, sf_dir)
    return c.join(ops.subtree(c, "ASIA"), "category_id", "left_anti").select("category_id", "name")


@query(f"""WITH RECURSIVE c AS {CATS}, d AS (SELECT category_id FROM c WHERE name = 'EUROPE' AND parent_id IS NULL AND llm_discovered = 0 UNION ALL SELECT c.category_id FROM d JOIN c ON c.parent_id = d.category_id WHERE c.llm_discovered = 0)
  SELECT category_id FROM d""")
def seed_subtree(spark, sf_dir):
    """Below a root, as far as nodes are built in."""
    return ops.subtree(nodes(spark, sf_dir), "EUROPE", seed_only=True)


@query(f"""WITH RECURSIVE c AS {CATS}, u AS (SELECT category_id, category_id AS above FROM c UNION ALL SELECT u.category_id, c.parent_id FROM u JOIN c ON c.category_id = u.above WHERE c.parent_id IS NOT NULL)
  SELECT above AS category_id, count(*) AS n FROM u WHERE above IN (SELECT category_id FROM c) GROUP BY above""")
def category_subtree_sizes(spark, sf_dir):
    return ops.subtree_sizes(nodes(spark, sf_dir))


@query(f"""WITH c AS {CATS}, r AS (SELECT *, row_number() OVER (PARTITION BY name, parent_id ORDER BY llm_discovered DESC, category_id) AS rn FROM c) SELECT category_id, name, parent_id FROM r WHERE rn = 1""")
def dedupe_categories(spark, sf_dir):
    """Of twins, the one a model found stays; a null parent groups like a value."""
    return ops.keep_one(nodes(spark, sf_dir), ["name", "parent_id"], F.desc("llm_discovered"), F.col("category_id")).where("rank_in_key = 1").select("category_id", "name", "parent_id")


@query(f"""WITH c AS {CATS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY llm_discovered DESC, category_id) AS rn FROM c WHERE name = 'BUILDING 3') SELECT category_id FROM c WHERE category_id NOT IN (SELECT category_id FROM r WHERE rn > 1)""")
def dedupe_one_name(spark, sf_dir):
    """All nodes but the twins of one name."""
    c = nodes(spark, sf_dir)
    gone = ops.keep_one(c.where("name = 'BUILDING 3'"), ["name"], F.desc("llm_discovered"), F.col("category_id")).where("rank_in_key > 1")
    return c.join(gone.select("category_id"), "category_id", "left_anti").select("category_id")


@query(f"""WITH c AS {CATS} SELECT a.category_id FROM c a WHERE a.llm_discovered = 1 AND EXISTS (SELECT 1 FROM c b WHERE b.name = a.name AND b.parent_id IS NOT DISTINCT FROM a.parent_id AND b.category_id <> a.category_id)""")
def twin_categories(spark, sf_dir):
    a, b = nodes(spark, sf_dir).alias("a"), nodes(spark, sf_dir).alias("b")
    twin = (F.col("a.name") == F.col("b.name")) & F.col("a.parent_id").eqNullSafe(F.col("b.parent_id")) & (F.col("a.category_id") != F.col("b.category_id"))
    return a.where("llm_discovered = 1").join(b, twin, "left_semi").select("category_id")


@query(f"""WITH c AS {CATS} SELECT category_id, count(*) OVER (PARTITION BY parent_id, name) AS n_twins FROM c""")
def twin_counts(spark, sf_dir):
    return nodes(spark, sf_dir).select("category_id", F.count("*").over(Window.partitionBy("parent_id", "name")).alias("n_twins"))


@query(f"""WITH c AS {CATS} SELECT name, parent_id, count(*) AS n, string_agg(CAST(category_id AS VARCHAR), ', ' ORDER BY category_id) AS ids, list(category_id ORDER BY llm_discovered DESC, category_id) AS keep_list FROM c GROUP BY name, parent_id HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    """Twins with all their ids, and in the order in which they are kept."""
    ids = F.array_sort(F.collect_list("category_id"))
    keep = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("llm_discovered")).alias("f"), "category_id"))), lambda x: x["category_id"])
    g = nodes(spark, sf_dir).groupBy("name", "parent_id").agg(F.count("*").alias("n"), F.array_join(ids.cast("array<string>"), ", ").alias("ids"), keep.alias("keep_list"))
    return g.where("n > 1")


@query(f"""WITH c AS {CATS} SELECT level, count(*) AS n, count(*) FILTER (WHERE llm_discovered = 1) AS found, min(name) AS first_name FROM c GROUP BY level""")
def level_view(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("llm_discovered") == 1).alias("found"), F.min("name").alias("first_name"))


@query(f"""WITH c AS {CATS} SELECT a.name, (SELECT count(*) FROM c b WHERE b.parent_id = a.category_id) AS children, (SELECT count(*) FROM c WHERE level = 0) AS departments, (SELECT count(*) FROM c) AS total FROM c a WHERE a.level < 2""")
def child_counts(spark, sf_dir):
    """Scalar counts beside each row: a grouped count and totals of one row."""
    c = nodes(spark, sf_dir)
    children = c.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("category_id")).agg(F.count("*").alias("children"))
    total = c.agg(F.count_if(F.col("level") == 0).alias("departments"), F.count("*").alias("total")).first()  # one row
    d = c.where("level < 2").join(children, "category_id", "left")
    return d.select("name", F.coalesce("children", F.lit(0)).alias("children"), F.lit(total["departments"]).alias("departments"), F.lit(total["total"]).alias("total"))


@query("""SELECT CAST(r_regionkey * 1000 AS INT) AS seq, r_name AS name, 0 AS level, r_name AS path FROM region UNION ALL SELECT CAST(n_regionkey * 1000 + 1 + n_nationkey AS INT), n_name, 1, r_name || ' > ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def ancestor_paths(spark, sf_dir):
    """Paths from the order of a seed file."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 1000).cast("int").alias("seq"), F.col("r_name").alias("name"), F.lit(0).alias("level"))
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).cast("int").alias("seq"), F.col("n_name").alias("name"), F.lit(1).alias("level"))
    return taxonomy.ancestor_paths(r.unionByName(n))


@query("""SELECT CASE WHEN n_nationkey % 3 = 0 THEN r_name || ' > ' || n_name WHEN n_nationkey % 3 = 1 THEN lower(r_name) || ' > ' || n_name || 's' END AS path, r_name || ' > ' || n_name AS match, CASE WHEN n_nationkey % 3 = 0 THEN 1.0 ELSE 0.975 END AS score FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 < 2""")
def path_reconciliation(spark, sf_dir):
    """Suggested paths against the taxonomy: as they are, in the plural, and unknown ones."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    path = F.when(k == 0, F.concat_ws(" > ", "r_name", "n_name")).when(k == 1, F.concat(F.lower("r_name"), F.lit(" > "), "n_name", F.lit("s"))).otherwise(F.concat_ws(" > ", "r_name", F.lit("Elsewhere")))
    s = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(path.alias("path"))
    return ops.best_path(s, ops.category_paths(nodes(spark, sf_dir)).select("path")).select("path", "match", F.round("score", 6).alias("score"))


@query(f"""WITH c AS {CATS}, k AS (SELECT *, first_value(category_id) OVER (PARTITION BY name, parent_id ORDER BY llm_discovered DESC, category_id) AS kept FROM c)
  SELECT DISTINCT o_orderkey AS product_id, k.kept AS category_id FROM orders JOIN k ON k.category_id = 1000 + o_custkey""")
def merge_twins(spark, sf_dir):
    """Bridges re-pointed to the categories that stay."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("product_id"), (F.col("o_custkey") + 1000).cast("int").alias("category_id"))
    c = nodes(spark, sf_dir)
    return taxonomy.merge_twins(c, b.join(c.select("category_id"), "category_id", "left_semi"))[1]


@query(f"""WITH c AS {CATS} SELECT category_id, CASE WHEN category_id IN (SELECT 1000 + o_custkey FROM orders) THEN 1 ELSE llm_discovered END AS llm_discovered FROM c""")
def touched_categories(spark, sf_dir):
    """Seed nodes that a product has been put under count as found."""
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).cast("int").alias("category_id"))
    return ops.mark_touched(nodes(spark, sf_dir), t).select("category_id", "llm_discovered")


@query(f"""WITH RECURSIVE c AS {CATS}, d AS (SELECT category_id FROM c WHERE name = 'ASIA' AND parent_id IS NULL UNION ALL SELECT c.category_id FROM d JOIN c ON c.parent_id = d.category_id)
  SELECT category_id, name, llm_discovered FROM c WHERE llm_discovered = 1 AND category_id NOT IN (SELECT category_id FROM d) UNION ALL SELECT CAST(500000 + n_nationkey AS INT), n_name, 0 FROM nation""")
def seeded_taxonomy(spark, sf_dir):
    seed = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 500000).cast("int").alias("category_id"), F.col("n_name").alias("name"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("level"))
    return ops.seed_taxonomy(nodes(spark, sf_dir), seed, "ASIA").select("category_id", "name", "llm_discovered")


@query("""SELECT s_suppkey AS seq, CASE s_suppkey % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'exists' WHEN 2 THEN 'same slug' ELSE 'created' END AS status FROM supplier""")
def created_categories(spark, sf_dir):
    """Categories asked for: blank names, known ones, ones with a known slug, and new ones."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "  ").when(k == 1, F.col("n_name")).when(k == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("s_name"))
    asked = s.select(F.col("s_suppkey").alias("seq"), name.alias("name"), (F.col("n_regionkey") + 1).cast("int").alias("parent_id"))
    return ops.create_categories(asked, nodes(spark, sf_dir)).select("seq", "status")


_WALK = "(SELECT DISTINCT r_name || ' > ' || n_name || ' > ' || c_mktsegment || ' > ' || substr(c_mktsegment, 1, 3) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH RECURSIVE {_PATHS}, k AS (SELECT path, min(category_id) AS known FROM p GROUP BY path),
  l AS (SELECT DISTINCT level, array_to_string(s[1:level + 1], ' > ') AS path, s[level + 1] AS name FROM (SELECT string_split(path, ' > ') AS s FROM {_WALK}), (SELECT unnest(range(4)) AS level))
  SELECT l.path, l.name, CAST(l.level AS INTEGER) AS level, NULLIF(regexp_extract(l.path, '^(.*) > ', 1), '') AS parent, u.known IS NULL AND l.level > 0 AS parent_is_new, 1 AS walk
  FROM l LEFT JOIN k ON l.path = k.path LEFT JOIN k u ON regexp_extract(l.path, '^(.*) > ', 1) = u.path WHERE k.path IS NULL""")
def created_paths(spark, sf_dir):
    """A walk that creates missing categories: each new node with its parent, found by the parent's id, and what a second walk adds: nothing."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = c.select(F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment", F.substring("c_mktsegment", 1, 3)).alias("path"))
    known = ops.category_paths(nodes(spark, sf_dir)).select(F.col("category_id").cast("long").alias("category_id"), "path")
    made = taxonomy.create_paths(paths, known)
    every = known.withColumn("new", F.lit(False)).unionByName(made.select("category_id", "path", F.lit(True).alias("new")))
    again = taxonomy.create_paths(paths, every.select("category_id", "path"))
    both = made.withColumn("walk", F.lit(1)).unionByName(again.withColumn("walk", F.lit(2)))
    parents = every.select(F.col("category_id").alias("parent_id"), F.col("path").alias("parent"), F.col("new").alias("parent_is_new"))
    return both.join(parents.hint("merge"), "parent_id", "left").select("path", "name", F.col("level").cast("int").alias("level"), "parent", F.coalesce("parent_is_new", F.lit(False)).alias("parent_is_new"), "walk")
