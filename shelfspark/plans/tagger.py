"""Queries of the tagger. Products are parts whose titles, URLs and crumbs are made from name, size and key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, words
from ..operators import catalog as ops
from ..operators import tagger, tagging, taxonomy
from .registry import query, table, values

#: As SQL that both engines read.
_TITLE = """concat(p_name, CASE p_size % 6 WHEN 0 THEN ' with faux suede, Leather' WHEN 1 THEN ' short sleeve tee' WHEN 2 THEN ' Slouchy suede bag' WHEN 3 THEN ' high heel with hardware' WHEN 4 THEN ' trousers & shorts' ELSE ' for his sister' END)"""
_CRUMBS = "CASE WHEN p_size % 5 = 0 THEN 'Women > Tops' WHEN p_size % 5 = 1 THEN 'Men > Women' ELSE '' END"
TREE = [(1, "Fashion", None, 0, 0), (2, "Accessories", 1, 1, 0), (3, "Bags", 2, 2, 0), (4, "Handbag", 3, 3, 0), (5, "Clothing", 1, 1, 0), (6, "Shorts", 5, 2, 0), (7, "Hardware", None, 0, 0), (8, "Pants", 5, 2, 0), (9, "Shirts", 5, 2, 0), (10, "T-Shirt", 9, 3, 0), (11, "Widgets", 7, 1, 0)]
TAGS = [("red", "colors"), ("blue", "colors"), ("green", "colors"), ("yellow", "colors"), ("black", "colors"), ("suede", "materials"), ("leather", "materials"), ("brass", "materials"), ("tin", "materials"), ("widget", "features"), ("gears", "features"), ("bolt", "features"), ("plate", "features"), ("short sleeve", "styles"), ("ring", "styles")]
_TAGS = values([(n, t, v) for n, t in TAGS for v in ({"gears": ("gear", "gears")}.get(n) or (n, n + "s", n + "es"))], "name, tag_type, variant")
_P = f"(SELECT p_partkey, lower({_TITLE}) AS title, {_CRUMBS} AS crumbs, p_size FROM part)"
_MATCH = f"""(SELECT DISTINCT p_partkey, name, tag_type FROM {_P} p JOIN {_TAGS} t ON regexp_matches(p.title, '\\b' || t.variant || '\\b') WHERE NOT (p_size % 6 = 0 AND name IN ('suede', 'leather'))
  UNION ALL SELECT p_partkey, unnest(['faux-suede', 'faux-leather']), 'materials' FROM part WHERE p_size % 6 = 0)"""
_CONF = "CAST(least(95, " + " + ".join(f"CASE WHEN list_contains(types, '{k}') THEN {v} ELSE 0 END" for k, v in rules.CONFIDENCE.items()) + ") AS DECIMAL(18,2)) / 100"


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.expr(_TITLE).alias("title"), F.expr(_CRUMBS).alias("crumbs"))


def tags(spark):
    return spark.createDataFrame(TAGS, "name string, tag_type string")


def tree(spark):
    return spark.createDataFrame(TREE, "category_id int, name string, parent_id int, level int, llm_discovered int")


@query(f"SELECT p_partkey, name, tag_type FROM {_MATCH}")
def tag_matches(spark, sf_dir):
    return tagging.match_tags(products(spark, sf_dir), tags(spark), "p_partkey", "title")


@query(f"""SELECT p.p_partkey, p.p_name, coalesce(t.tags, []) AS tags, {_CONF} AS confidence, CASE WHEN {_CONF} < 0.70 THEN true ELSE false END AS needs_enrichment FROM part p LEFT JOIN
  (SELECT p_partkey, list_sort(list(name)) AS tags, list(DISTINCT tag_type) AS types FROM {_MATCH} GROUP BY 1) t USING (p_partkey)""".replace("list_contains(types", "list_contains(coalesce(t.types, [])"))
def tagged_products(spark, sf_dir):
    """Products with their tags: the bridge is aggregated before the join, so nothing fans out."""
    p = products(spark, sf_dir)
    t = tagging.match_tags(p, tags(spark), "p_partkey", "title").groupBy("p_partkey").agg(F.array_sort(F.collect_list("name")).alias("tags"), F.collect_set("tag_type").alias("types"))
    none = F.array().cast("array<string>")
    d = p.join(t.hint("merge"), "p_partkey", "left").withColumn("confidence", ops.confidence(F.coalesce("types", none)))
    return d.select("p_partkey", "p_name", F.coalesce("tags", none).alias("tags"), F.col("confidence").cast("decimal(18,2)").cast("double").alias("confidence"), (F.col("confidence") < 0.7).alias("needs_enrichment"))


@query(f"""SELECT p_partkey, name, tag_type FROM {_MATCH} WHERE CASE WHEN p_partkey % 3 = 0 THEN tag_type IN ('colors', 'materials', 'patterns', 'styles', 'fit', 'occasions', 'features') WHEN p_partkey % 3 = 1 THEN tag_type IN ('materials', 'features', 'finishes', 'colors') ELSE true END""")
def department_tags(spark, sf_dir):
    m = tagging.match_tags(products(spark, sf_dir), tags(spark), "p_partkey", "title")
    dept = F.when(F.col("p_partkey") % 3 == 0, "Fashion").when(F.col("p_partkey") % 3 == 1, "Hardware").otherwise("Toys")
    return m.where(taxonomy.allowed_types(dept, F.col("tag_type")))


#: What a title's words are worth: category, word, points for each hit, levels; and what is left out or added by context.
_WORTH = values([(3, "bag", 3), (3, "bags", 3), (8, "trousers", 3), (8, "trouser", 3), (6, "shorts", 3), (6, "short", 3), (7, "hardware", 1), (11, "widget", 2), (11, "widgets", 2), (10, "tee", 4), (10, "t-shirt", 4)], "category_id, word, levels")


@query(f"""WITH h AS (SELECT p_partkey, category_id, levels, 1000 * sum(len(regexp_extract_all(title, '\\b' || word || '\\b'))) AS n FROM {_P} JOIN {_WORTH} ON regexp_matches(title, '\\b' || word || '\\b') GROUP BY ALL
  UNION ALL SELECT p_partkey, 4, 4, 5000 FROM part WHERE p_size % 6 = 2)
  SELECT p_partkey, category_id, CAST(sum(n) + 10 * max(levels) AS BIGINT) AS score FROM h JOIN part USING (p_partkey) WHERE NOT (category_id = 7 AND p_size % 6 = 3) AND NOT (category_id = 6 AND p_size % 6 = 1) GROUP BY ALL""")
def category_matches(spark, sf_dir):
    """Plurals, synonyms, phrases in any order, "with X" and descriptive contexts."""
    return tagging.match_categories(products(spark, sf_dir), tree(spark), "p_partkey", {"title": "title"}).select("p_partkey", "category_id", "score")


@query(f"""SELECT p_partkey, c AS color FROM (SELECT p_partkey, list_filter(string_split(regexp_replace(title, '[^a-z ]', ' ', 'g'), ' '), lambda x: x IN ('red', 'blue', 'green', 'yellow', 'black'))[1] AS c FROM {_P}) WHERE c IS NOT NULL""")
def first_color(spark, sf_dir):
    """The colour that stands first."""
    colors = tags(spark).where("tag_type = 'colors'").select("name")
    return tagging.first_color(products(spark, sf_dir), colors, "p_partkey", "title", "crumbs")


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'women' ELSE 'unisex' END AS gender, CASE WHEN p_size % 5 = 0 THEN 'breadcrumbs' ELSE 'default' END AS source, CASE WHEN p_size % 5 = 0 THEN 'highest' ELSE 'default' END AS confidence FROM part WHERE p_size % 6 <> 5
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'women' ELSE 'women' END, CASE WHEN p_size % 5 = 0 THEN 'breadcrumbs' ELSE 'specs' END, CASE WHEN p_size % 5 = 0 THEN 'highest' ELSE 'medium' END FROM part WHERE p_size % 6 = 5""")
def gender_tiers(spark, sf_dir):
    """Crumbs, title, specs and description in turn; a tier with two genders is passed over ("for his sister")."""
    p = products(spark, sf_dir)
    specs = F.when(F.col("p_size") % 6 == 5, "a handbag")
    return p.select("p_partkey", tagging.gender(F.col("crumbs"), F.col("title"), specs, F.lit(None).cast("string")).alias("g")).select("p_partkey", "g.*")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Pet Supplies > Dog > Beds & Furniture' WHEN 1 THEN 'Beauty & Personal Care > Tanning > Tanning Beds' END AS path, string_split(p_name, ' ')[2] AS tag, CASE p_size % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'men' ELSE 'unisex' END AS gender FROM part""")
def gender_and_override(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " dog bed for women").when(F.col("p_size") % 3 == 1, " tanning bed for men").otherwise(" tanning bed pool for men and women"))
    return p.select("p_partkey", ops.phrase_override(title).alias("path"), ops.canonical_tag(F.split("p_name", " ")[1]).alias("tag"), tagging.gender(F.lit(""), title, F.lit(""), F.lit("")).gender.alias("gender"))


_FORMS = [("berry", ["berries", "berrys", "berryes"]), ("glass", ["glasses", "glasss"]), ("Knife", ["knives", "knifes", "knifees"]), ("men", ["man", "mens", "menes"]), ("boxes", ["box", "boxe", "boxess", "boxeses"]), ("tomatoes", ["tomato", "tomatoe", "tomatoess", "tomatoeses"]), ("dresses", ["dress", "dresse", "dressess", "dresseses"])]


#: Endings that make words of a table's words, and the forms that such a word has besides itself.
_ENDINGS = [("", "[w || 's', w || 'es']"), ("y", "list_concat([w || 'ys', w || 'yes'], CASE WHEN regexp_matches(w, '[^aeiou]$') THEN [w || 'ies'] ELSE [] END)"), ("f", "[w || 'ves', w || 'fs', w || 'fes']"), ("ches", "[w || 'ch', w || 'che', w || 'chess', w || 'cheses']")]


@query(f"""WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT word, list_sort(list_append(f, lower(word))) AS forms FROM (VALUES {", ".join(f"('{w}', {f})" for w, f in _FORMS)}) AS t(word, f)
  UNION ALL """ + " UNION ALL ".join(f"SELECT w || '{e}', list_sort(list_append({f}, w || '{e}')) FROM p" for e, f in _ENDINGS))
def plural_forms(spark, sf_dir):
    """The words of the products' names with endings that the rules know, and words by hand, in all their forms."""
    own = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    made = own.select(F.explode(F.array(*[F.concat("w", F.lit(e)) for e, _ in _ENDINGS])).alias("word"))
    every = made.unionByName(spark.createDataFrame([(w,) for w, _ in _FORMS], "word string"))
    return every.select("word", F.array_sort(words.plural_forms(F.col("word"))).alias("forms"))


@query("SELECT p_type AS tag_type, count(DISTINCT string_split(p_name, ' ')[1]) AS n, string_agg(DISTINCT string_split(p_name, ' ')[1], ', ' ORDER BY string_split(p_name, ' ')[1]) AS names FROM part GROUP BY p_type")
def tags_by_type(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name"), F.col("p_type").alias("tag_type")).distinct()
    return t.groupBy("tag_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


#: A taxonomy whose leaves are the second words of the products' names, and departments with rules of their own.
SHOP = [
    (1, "Fashion", None), (2, "Accessories", 1), (3, "Rings", 2), (4, "Tools & Hardware", None), (5, "Bolts", 4), (6, "Rods", 4), (7, "Gears", 4), (8, "Anvils", 4), (9, "Electronics", None), (10, "Gizmos", 9), (11, "Widgets", 9), (12, "Kitchen & Dining", None),
    (13, "Plates", 12),
]
_LEAF = {"ring": "Fashion > Accessories > Rings", "bolt": "Tools & Hardware > Bolts", "rod": "Tools & Hardware > Rods", "gear": "Tools & Hardware > Gears", "anvil": "Tools & Hardware > Anvils", "gizmo": "Electronics > Gizmos", "widget": "Electronics > Widgets", "plate": "Kitchen & Dining > Plates"}
_WORD_TYPES = {"red": "colors", "blue": "colors", "small": "fit", "large": "fit", "old": "styles", "new": "styles", "hot": "occasions", "cold": "activities", "stripe": "patterns", "striped": "patterns", "brass": "finishes"}
_SHOP_TITLE = "concat(p_name, ' m', CAST(p_partkey AS STRING), CASE WHEN p_size % 4 = 0 THEN ' stripes and striped' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' for women' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN ' phone case' ELSE '' END)"
_SPECS = "CASE WHEN p_size % 2 = 0 THEN 'finish: brass' END"
_DESCRIPTION = "CASE WHEN p_size % 9 = 0 THEN 'nice for toddlers and a toddler' END"
_CASE = lambda x, m: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
_LEAVES = _CASE("noun", _LEAF)


@query(f"""WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun FROM part),
  c AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'Electronics > Mobile Accessories > Cases' ELSE {_LEAVES} END AS path FROM p),
  d AS (SELECT *, coalesce(lower(string_split(path, ' > ')[1]), '') AS dept FROM c),
  g AS (SELECT *, CASE WHEN dept = 'electronics' THEN 'unisex' WHEN p_size % 5 = 0 THEN 'women' WHEN p_size % 9 = 0 THEN 'kids' ELSE 'unisex' END AS gender FROM d),
  w AS (SELECT p_partkey, adj AS name, {_CASE('adj', _WORD_TYPES)} AS type FROM p UNION ALL SELECT p_partkey, noun, {_CASE('noun', _WORD_TYPES)} FROM p UNION ALL SELECT p_partkey, 'm' || p_partkey, 'features' FROM p
    UNION ALL SELECT p_partkey, 'striped', 'patterns' FROM p WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'brass', 'finishes' FROM p WHERE p_size % 2 = 0),
  a AS (SELECT DISTINCT w.p_partkey, name, type FROM w JOIN g USING (p_partkey) WHERE type IS NOT NULL AND CASE dept {" ".join(f"WHEN '{k}' THEN type IN ({', '.join(repr(t) for t in v)})" for k, v in {'fashion': ['colors', 'patterns', 'finishes', 'materials', 'fit', 'styles', 'occasions', 'activities'], 'tools & hardware': ['materials', 'features', 'activities', 'finishes'], 'electronics': ['features', 'materials', 'colors', 'finishes'], 'kitchen & dining': ['materials', 'features', 'colors', 'finishes']}.items())} ELSE true END),
  f AS (SELECT p_partkey, list(name || ':' || type ORDER BY list_position(['colors', 'patterns', 'finishes', 'materials', 'activities', 'styles', 'features', 'fit', 'occasions'], type), name) AS tags,
    least(95, sum(points)) AS points FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_partkey, type ORDER BY name) = 1 THEN CASE WHEN type IN ('materials', 'styles', 'features') THEN 15 ELSE 10 END ELSE 0 END AS points FROM a) GROUP BY 1)
  SELECT p_partkey AS product_id, path AS primary_category, gender, list_concat(list_concat(coalesce(tags, []), [gender || ':demographic']), CASE WHEN p_size % 9 = 0 THEN ['kids:demographic'] ELSE [] END) AS tags, CAST(coalesce(points, 0) AS INTEGER) AS confidence, coalesce(points, 0) < 70 AS needs_enrichment
  FROM g LEFT JOIN f USING (p_partkey)""")
def assembled_tags(spark, sf_dir):
    """Final tags, primary category, gender and confidence of every product; the dictionary has a tag for each product besides its words."""
    part = table(spark, sf_dir, "part")
    own = part.select(F.concat(F.lit("m"), "p_partkey").alias("name"), F.lit("features").alias("tag_type"))
    dictionary = own.unionByName(spark.createDataFrame(list(_WORD_TYPES.items()), "name string, tag_type string"))
    cats = spark.createDataFrame([(i, n, p, 0, 0) for i, n, p in SHOP], "category_id int, name string, parent_id int, level int, llm_discovered int")
    p = part.select(F.col("p_partkey").alias("product_id"), F.expr(_SHOP_TITLE).alias("title"), F.lit("https://shop.com/").alias("url"), F.array(F.lit("Home"), F.expr(_SHOP_TITLE)).alias("breadcrumbs"), F.lit(None).cast("string").alias("json_ld"), F.expr(_SPECS).alias("specs"), F.lit(None).cast("string").alias("brand"), F.expr(_DESCRIPTION).alias("description"))
    out = tagger.tag_products(p, dictionary, cats)
    return out.select("product_id", "primary_category", "gender", F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["type"])).alias("tags"), (F.col("confidence") * 100).cast("int").alias("confidence"), "needs_enrichment")
