"""The whole tagger: search texts, tags, colour, category, gender and age of each product, put together as its final tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import tagging
from .catalog import canonical_tag, confidence, phrase_override

#: Tag types, in the order of the final list.
TYPES = ("colors", "patterns", "finishes", "materials", "activities", "styles", "features", "fit", "occasions")
#: Departments and the types that they allow; any other allows all.
DEPARTMENT_TYPES = {
    "fashion": "colors patterns finishes materials fit styles occasions activities", "tools & hardware": "tool-types materials features activities finishes", "automotive": "automotive materials features finishes",
    "sports & outdoors": "activities materials features colors patterns styles", "kitchen & dining": "kitchen materials features colors finishes", "home & garden": "materials features colors patterns finishes styles",
    "beauty & personal care": "beauty features occasions finishes", "electronics": "features materials colors finishes", "pet supplies": "materials features patterns", "toys & games": "features materials occasions patterns", "office & school": "materials features patterns",
    "health & wellness": "features occasions", "baby & kids": "materials features occasions fit patterns", "books & media": "features occasions", "grocery & food": "features occasions", "jewelry & watches": "materials styles occasions finishes",
    "luggage & travel": "materials features styles patterns", "musical instruments": "features materials finishes", "arts & crafts": "materials features patterns finishes",
}
#: Words of an age, the first that stands in the text counts.
AGES = {"kids": r"\b(kids|child|children|toddler|boys|girls|youth)\b", "baby": r"\b(baby|infant|newborn|baby boy|baby girl)\b", "teen": r"\b(teen|teenager|adolescent)\b"}
#: Fixed value: below this a model is asked.
SURE = 0.70


def search_texts(products: DataFrame) -> DataFrame:
    """products (product_id, title, url, breadcrumbs, json_ld, specs, brand, description) with ``url_words``, ``crumbs`` (without the
    title) and the texts that are searched: ``tier1`` (title, URL, crumbs, structured data), ``tier2``, ``tier3``, and ``all_of``."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    p = products.withColumns({"url_words": blank(text.url_keywords(F.col("url"))), "crumbs": blank(F.array_join(text.drop_title_crumb(F.col("breadcrumbs"), F.col("title")), " "))})
    p = p.withColumns({"tier1": F.concat_ws(" ", blank(F.col("title")), "url_words", "crumbs", blank(F.col("json_ld"))), "tier2": F.concat_ws(" ", blank(F.col("specs")), blank(F.col("brand"))), "tier3": blank(F.col("description"))})
    return p.withColumn("all_of", F.concat_ws(" ", "tier1", "tier2", "tier3"))


def allowed(department: Column, tag_type: Column) -> Column:
    types = F.create_map(*[F.lit(x) for d, t in DEPARTMENT_TYPES.items() for x in (d, t)])
    return F.coalesce(F.array_contains(F.split(F.try_element_at(types, F.lower(department)), " "), tag_type), F.lit(True))


def primary_category(texts: DataFrame, cats: DataFrame) -> DataFrame:
    """product_id, primary_category, matched (best first: score, then id): a phrase that overrides, else the category with the highest
    score, of equal ones that with the smallest id. Products without any are left out."""
    sources = {"title": "title", "url": "url_words", "crumbs": "crumbs", "specs": "specs", "description": "description"}
    m = tagging.match_categories(texts, cats, "product_id", sources)
    best = m.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "category_id", "path"))).alias("m"))
    over = texts.select("product_id", phrase_override(F.col("all_of")).alias("over")).where("over IS NOT NULL")
    matched = F.when(F.col("over").isNull(), F.transform("m", lambda x: F.struct(x["category_id"].alias("category_id"), x["path"].alias("path"), (-x["less"]).alias("score"))))
    both = best.join(over, "product_id", "full_outer").select("product_id", F.coalesce("over", F.get("m", 0)["path"]).alias("primary_category"), matched.alias("matched"))
    return both


def tag_products(products: DataFrame, tags: DataFrame, cats: DataFrame) -> DataFrame:
    """product_id, primary_category, gender, tags (name, type), confidence, needs_enrichment, matched: one row for each product.

    tags: name, tag_type. Matched tags that the department does not allow go; variations of one tag become one; colours are not
    matched like others but the first of the first tier that has one; every product gets a gender and, where the text says so, an
    age. The list is ordered by type, then name."""
    t = search_texts(products)
    cat = primary_category(t, cats)
    color = tagging.first_color(t, tags.where("tag_type = 'colors'").select("name"), "product_id", "tier1", "tier2", "tier3").select("product_id", F.col("color").alias("name"), F.lit("colors").alias("tag_type"))
    other = tagging.match_tags(t, tags.where("tag_type <> 'colors'"), "product_id", "all_of").where(F.col("tag_type").isin(*TYPES))
    department = F.get(F.split("primary_category", " > "), 0)
    found = color.unionByName(other).join(cat.select("product_id", "primary_category").hint("merge"), "product_id", "left").where(allowed(department, F.col("tag_type")))
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("tag_type")).cast("int")
    one = found.select("product_id", rank.alias("nr"), canonical_tag(F.col("name")).alias("name"), F.col("tag_type").alias("type")).distinct()
    listed = one.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("nr", "name", "type"))).alias("found"), F.collect_set("type").alias("types"))
    out = t.join(cat.hint("merge"), "product_id", "left").join(listed.hint("merge"), "product_id", "left")
    electronic = F.coalesce(F.startswith(F.lower("primary_category"), F.lit("electronics")), F.lit(False))
    sex = tagging.gender(F.col("crumbs"), F.concat_ws(" ", "title", "url_words", "json_ld"), F.col("specs"), F.col("description"), F.col("primary_category"))["gender"]
    out = out.withColumn("gender", F.when(electronic, "unisex").otherwise(sex))
    low = F.lower("all_of")
    age = F.coalesce(*[F.when(low.rlike(p), a) for a, p in AGES.items()])
    demographic = F.filter(F.array(F.col("gender"), age), lambda x: x.isNotNull())
    named = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    final = F.concat(F.coalesce(F.transform("found", lambda x: named(x["name"], x["type"])), F.array().cast("array<struct<name:string,type:string>>")), F.transform(demographic, lambda x: named(x, F.lit("demographic"))))
    sure = confidence(F.coalesce("types", F.array().cast("array<string>")))
    return out.select("product_id", "primary_category", "gender", final.alias("tags"), sure.alias("confidence"), (sure < SURE).alias("needs_enrichment"), F.coalesce("matched", F.array().cast("array<struct<category_id:int,path:string,score:bigint>>")).alias("matched"))
