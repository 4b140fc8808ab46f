"""The tagger's relations: tags, categories, colours and gender of products.

Texts meet dictionaries in equi-joins of word windows, so the cost follows the text and not text x dictionary. Dictionaries
are DataFrames; small ones are broadcast, what has a row for each product never is. A null text is an empty one; products without
a hit have no row in ``match_tags``, ``match_categories`` and ``first_color``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.words import END, START, gram, grams, plural_forms, stands_in, words
from .catalog import category_paths


#: Entries of a dictionary that is no longer small, and shuffled. Both are said, as Spark's estimates are far off: a table made of
#: Python rows counts as endless, and one made of a compressed file as small.
LARGE = 100_000


def _hits(texts: DataFrame, id_col: str, text_col: str, entries: DataFrame) -> DataFrame:
    """texts x entries(variant, ...) that stand in them: id, at (word), the columns of entries. Entries of several words or with
    hyphens are looked at again as they are written."""
    # how many words the entries have: a handful of numbers
    lengths = {r[0]: r[1] for r in entries.groupBy(F.size(words(F.col("variant"))).alias("n")).count().where("n > 0").collect()}
    e = entries.withColumn("gram", gram(F.col("variant")))
    e = e.hint("merge") if sum(lengths.values()) > LARGE else F.broadcast(e)
    found = texts.select(id_col, text_col, words(F.col(text_col)).alias("w")).select(id_col, text_col, F.explode(grams(F.col("w"), sorted(lengths))).alias("g"))
    hits = found.select(id_col, F.when(F.col("g.gram").contains(" "), F.col(text_col)).alias("text"), "g.at", "g.gram").join(e, "gram")
    return hits.where((F.col("variant") == F.col("gram")) & ~F.col("gram").contains(" ") | stands_in(F.col("variant"), F.col("text"))).drop("gram", "text")


def match_tags(products: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, tag_type) of every tag that stands in the text in its singular or plural. A compound material whose words all
    stand in the text, wherever, gives its own tag and keeps its base material out."""
    spark = products.sparkSession
    tags = dictionary.select("name", "tag_type", F.explode(plural_forms(F.col("name"))).alias("variant"))
    hits = _hits(products, id_col, text_col, tags).select(id_col, "name", "tag_type").distinct()
    compounds = spark.createDataFrame(rules.COMPOUND_MATERIALS, "compound string, base string, preferred string")
    found = all_words(products, id_col, text_col, compounds.select("compound")).join(F.broadcast(compounds), "compound")
    blocked = found.select(id_col, F.col("base").alias("name")).distinct()
    made = found.select(id_col, F.col("preferred").alias("name"), F.lit("materials").alias("tag_type"))
    return hits.join(blocked.hint("merge"), [id_col, "name"], "left_anti").unionByName(made).distinct()


def all_words(products: DataFrame, id_col: str, text_col: str, phrases: DataFrame) -> DataFrame:
    """(id, phrase) where every word of the phrase (the one column, of fixed values) stands in the text, in any order and place."""
    name = phrases.columns[0]
    p = phrases.select(name, words(F.col(name)).alias("ws")).select(name, F.size("ws").alias("need"), F.explode("ws").alias("word"))
    t = products.select(id_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("word"))
    return t.join(F.broadcast(p), "word").groupBy(id_col, name, "need").agg(F.countDistinct("word").alias("n")).where("n = need").select(id_col, name)


def match_categories(products: DataFrame, cats: DataFrame, id_col: str, sources: dict[str, str], synonyms: dict[str, str] | None = None) -> DataFrame:
    """(id, category_id, path, score) of the categories whose name, or a synonym of it, stands in a source in any plural form, or
    of which all words of a phrase stand in the text. sources: source -> column. Hits count by the weight of their source; a
    phrase adds 5000, a neckline or sleeve 200 to tops, each level 10. Categories that only describe ("short sleeve") or follow
    "with" are left out. An entry that is a form of a name and of a synonym counts for each."""
    spark = products.sparkSession
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in sources.values()])
    p = products.select(id_col, *dict.fromkeys(sources.values()), F.lower(text).alias("all_text"))
    names = cats.select("category_id", F.lower("name").alias("key"))
    paths = category_paths(cats).groupBy("category_id").agg(F.min("path").alias("path"), F.min("depth").alias("depth"))
    syn = spark.createDataFrame(list((rules.CATEGORY_SYNONYMS if synonyms is None else synonyms).items()), "synonym string, name string")
    by_name = names.select("category_id", F.explode(plural_forms(F.col("key"))).alias("variant"))
    by_synonym = syn.select(F.lower("name").alias("key"), F.explode(plural_forms(F.col("synonym"))).alias("variant")).join(names.select("category_id", "key"), "key").select("category_id", "variant")
    entries = by_name.unionByName(by_synonym)
    each = None
    for source, col in sources.items():
        h = _hits(p, id_col, col, entries).groupBy(id_col, "category_id").agg((F.count("*") * rules.SOURCE_WEIGHTS[source]).alias("n"))
        each = h if each is None else each.unionByName(h)
    phrases = spark.createDataFrame(rules.MULTI_WORD_SYNONYMS, "phrase string, name string")
    boost = all_words(p, id_col, "all_text", phrases.select("phrase")).join(F.broadcast(phrases), "phrase").select(id_col, F.lower("name").alias("key")).distinct().join(names.select("category_id", "key"), "key").select(id_col, "category_id", F.lit(5000).cast("long").alias("n"))
    hits = each.unionByName(boost).groupBy(id_col, "category_id").agg(F.sum("n").alias("n")).join(names, "category_id").join(paths, "category_id").join(p.select(id_col, "all_text").hint("merge"), id_col)
    forms = F.array_join(F.transform(plural_forms(F.col("key")), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
    after_with = F.col("all_text").contains("with") & F.rlike(F.col("all_text"), F.concat(F.lit(rf"{START}with\s+[A-Za-z0-9_]*(?:"), forms, F.lit(")")))
    describes = F.lit(False)
    for name, pattern in rules.CATEGORY_BLACKLIST.items():
        describes = describes | (F.col("key") == name) & F.col("all_text").rlike(f"(?i){pattern}")
    tops = F.lower("path").rlike("shirts|sweaters|tanks") & F.col("all_text").rlike(f"(?i){START}(?:{rules.NECK_OR_SLEEVE}){END}")
    return hits.where(~after_with & ~describes).select(id_col, "category_id", "path", (F.col("n") + F.when(tops, 200).otherwise(0) + 10 * (F.col("depth") + 1)).alias("score"))


def first_color(products: DataFrame, colors: DataFrame, id_col: str, *tiers: str) -> DataFrame:
    """(id, color): of the first tier (a column) with a colour in it, the colour that stands first. colors: name."""
    entries = colors.select("name", F.explode(plural_forms(F.col("name"))).alias("variant"))
    each = None
    for k, col in enumerate(tiers):
        h = _hits(products, id_col, col, entries).select(id_col, F.struct(F.lit(k).alias("tier"), "at", "name").alias("hit"))
        each = h if each is None else each.unionByName(h)
    return each.groupBy(id_col).agg(F.min("hit").alias("hit")).select(id_col, F.col("hit.name").alias("color"))


def genders_in(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    patterns = {g: f"{START}(?:{w}){END}" for g, w in rules.GENDER.items()}
    patterns["men"] += f"|{START}{rules.MEN_BEFORE_LETTER}(?=[a-z0-9_])"
    return F.array_compact(F.array(*[F.when(low.rlike(p), g) for g, p in patterns.items()]))


def gender(breadcrumbs: Column, title: Column, specs: Column, description: Column, path: Column | None = None) -> Column:
    """struct<gender, source, confidence>: the first tier in which exactly one gender is found, then the category's path, then
    unisex. title: with the URL's words and the structured data."""
    tiers = [(breadcrumbs, "breadcrumbs", "highest"), (title, "title/url", "high"), (specs, "specs", "medium"), (description, "description", "low")]
    made = lambda g, source, sure: F.struct(g.alias("gender"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    out = [F.when(F.size(genders_in(t)) == 1, made(genders_in(t)[0], s, c)) for t, s, c in tiers]
    if path is not None:
        low = F.lower(path)
        g = F.when(low.contains("unisex"), "unisex").when(low.contains("women"), "women").when(low.contains("men"), "men").when(low.rlike("kids|boys|girls"), "kids")
        out.append(F.when(g.isNotNull(), made(g, "category-path", "fallback")))
    return F.coalesce(*out, made(F.lit("unisex"), "default", "default"))
