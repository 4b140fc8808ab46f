"""Relational operators of the catalog: hierarchy, upserts, duplicate clean-up, tagging and reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images as img
from ..functions import rules, text
from ..sources import files


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.CATEGORIES, "category_id int, name string, parent_id int, level int, llm_discovered int")


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.TAGS, "name string, tag_type string")


#: A hierarchy of more levels is taken for a cycle.
MOST_LEVELS = 100


def _level_by_level(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of first, of step(first), and so on until a level is empty. A level is a job, which writes it to the shared folder in
    spark.checkpoint.dir; no level passes through the driver, and their rows have no limit. A cycle is an error."""
    files.ensure_checkpoint_dir(first.sparkSession)
    every, level = [], first.checkpoint()
    while not level.isEmpty():
        every.append(level)
        if len(every) > MOST_LEVELS:
            raise ValueError(f"a cycle, or more than {MOST_LEVELS} levels")
        level = step(level).checkpoint()
    return reduce(DataFrame.unionAll, every, level)


def category_paths(cats: DataFrame) -> DataFrame:
    """category_id, path from the root, depth; a node whose parent is missing starts its own path. Top-down, a join a level; nodes that
    only a cycle leads to have no path."""
    c = cats.select("category_id", "name", "parent_id")
    roots = c.join(c.select(F.col("category_id").alias("parent_id")).hint("merge"), "parent_id", "left_anti").select("category_id", F.col("name").alias("path"), F.lit(0).alias("depth"))
    below = lambda p: c.join(p.select(F.col("category_id").alias("parent_id"), "path", "depth").hint("merge"), "parent_id").select("category_id", F.concat("path", F.lit(" > "), "name").alias("path"), (F.col("depth") + 1).alias("depth"))
    return _level_by_level(roots, below)


def subtree(cats: DataFrame, root: str, seed_only: bool = False) -> DataFrame:
    """category_id of the root of that name and of all below it; seed_only: not beyond nodes that a model found."""
    c = cats.where("llm_discovered = 0") if seed_only else cats
    first = c.where((F.col("name") == root) & F.col("parent_id").isNull()).select("category_id").distinct()
    below = lambda d: c.join(d.select(F.col("category_id").alias("parent_id")).hint("merge"), "parent_id").select("category_id")
    return _level_by_level(first, below).distinct()


def subtree_sizes(cats: DataFrame) -> DataFrame:
    """category_id and the number of nodes below it, itself included: counts go up a level at a time, added up for each parent on the
    way, so a level never has more rows than there are nodes."""
    c = cats.select("category_id", "parent_id").where("parent_id IS NOT NULL")
    up = lambda u: c.join(u.hint("merge"), "category_id").groupBy(F.col("parent_id").alias("category_id")).agg(F.sum("n").alias("n"))
    every = _level_by_level(cats.groupBy("category_id").agg(F.count("*").alias("n")), up).groupBy("category_id").agg(F.sum("n").alias("n"))
    return every.join(cats.select("category_id").hint("merge"), "category_id", "left_semi")


def keep_one(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """df with ``rank_in_key``, 1 for the row of each key that stays; nulls are a key of their own."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank_in_key", F.row_number().over(w))


def insert_absent(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key old lacks (a null key never conflicts), one for each key, after old."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    return old.unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where they are given; rows of either side stay."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols])


def confidence(types: Column) -> Column:
    total = sum((F.when(F.array_contains(types, k), v).otherwise(0) for k, v in rules.CONFIDENCE.items()), F.lit(0))
    return (F.least(total, F.lit(95)) / 100).cast("decimal(3,2)")


def phrase_override(c: Column) -> Column:
    low, out = F.lower(c), F.lit(None).cast("string")
    for phrase, without, path in reversed(rules.PHRASE_OVERRIDES):
        hit = low.contains(phrase)
        for w in without:
            hit = hit & ~low.contains(w)
        out = F.when(hit, path).otherwise(out)
    return out


def canonical_tag(name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in rules.TAG_CANONICALS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, name), name)


#: Fixed values.
PATH_SYNONYMS = {"trousers": "pants", "sneakers": "trainers", "jumper": "sweater", "purse": "handbag", "tee": "t-shirt"}


def path_similarity(a: Column, b: Column) -> Column:
    """Of two paths of equal depth: mean over segments of 1, 0.95 (plural) or 0.9 (synonym); 0 if any segment has none."""
    m = F.create_map(*[F.lit(x) for kv in PATH_SYNONYMS.items() for x in kv])
    cut = lambda p: F.transform(F.split(p, " > "), lambda x: F.lower(F.trim(x)))

    def one(x: Column, y: Column) -> Column:
        same = (F.try_element_at(m, x) == y) | (F.try_element_at(m, y) == x)
        return F.when(x == y, 1.0).when((F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x), 0.95).when(F.coalesce(same, F.lit(False)), 0.9).otherwise(0.0)

    s = F.zip_with(cut(a), cut(b), one)
    return F.when(F.size(cut(a)) == F.size(cut(b)), F.when(F.array_min(s) > 0, F.aggregate(s, F.lit(0.0), lambda x, y: x + y) / F.size(s)).otherwise(0.0)).otherwise(0.0)


def best_path(suggested: DataFrame, paths: DataFrame, least: float = 0.8) -> DataFrame:
    """suggested(path) -> path, match, score: the most similar known path, the first by name on ties. Paths meet in an equi-join on
    their segments with plurals and synonyms taken off, so only paths that can be similar are compared."""
    m = F.create_map(*[F.lit(x.rstrip("s")) for k, v in PATH_SYNONYMS.items() for x in (k, v)])
    stem = lambda x: F.regexp_replace(F.lower(F.trim(x)), "s+$", "")
    base = lambda p: F.array_join(F.transform(F.split(p, " > "), lambda x: F.coalesce(F.try_element_at(m, stem(x)), stem(x))), " > ")
    s = suggested.select("path").distinct().withColumn("base", base(F.col("path")))
    p = paths.select(F.col("path").alias("match")).distinct().withColumn("base", base(F.col("match")))
    scored = s.join(p, "base").withColumn("score", path_similarity(F.col("path"), F.col("match"))).where(F.col("score") >= least)
    w = Window.partitionBy("path").orderBy(F.desc("score"), "match")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", "match", "score")


class ImageAudit:
    """What the steps of a ranking refuse and keep, counted by the job that runs it. Complete after that job's action."""

    def __init__(self):
        self.found, self.grouped = Observation(), Observation()

    def counts(self) -> dict[str, int]:
        return {**self.found.get, **self.grouped.get}


def rank_images(images: DataFrame, page: str = "page_id", keep: int = 30, place: Column | None = None, extra: tuple[str, ...] = (), audit: ImageAudit | None = None) -> DataFrame:
    """Images of a page, best first: junk and low scores go (both by the URL as it is found), the rest get their large version,
    the best of each canonical key stays (the first on ties), and small files go. Images are dealt by page once, after the
    filters, so one shuffle serves aggregate and window; a page has few of them.

    place: what the score takes for an image's place, if not ``pos``; extra: columns of images that the ranking keeps (from_zoom and
    from_large count in the score); audit: counts empty, invalid, junk, low_score, duplicate_groups, small_file and kept as it runs."""
    u, has = F.col("url"), lambda c: F.col(c) if c in extra else None
    # a row of its own for each verdict: a filter on it is not moved before it, where it would be computed once more
    verdict = img.judged(u, F.col("pos") if place is None else place, F.col("from_srcset"), from_zoom=has("from_zoom"), from_large=has("from_large"))
    i = images.drop("why", "score").select("*", F.inline(F.array(verdict)))
    if audit:
        i = i.observe(audit.found, *[F.count_if(F.col("why") == c).alias(c) for c in ("empty", "invalid", "junk")], F.count_if(F.col("score") < 40).alias("low_score"))
    i = i.where("score >= 40").drop("why").repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), page)
    i = i.drop("large").select("*", F.explode(F.array(img.upgrade_cdn(u))).alias("large"))
    best = F.max(F.struct("score", (-F.col("pos")).alias("pos"), "large", "from_srcset", *extra)).alias("b")
    b = i.groupBy(page, text.canonical_image_key(F.col("large")).alias("canonical")).agg(best, F.count("*").alias("n"))
    b = b.select(page, "canonical", "b.score", (-F.col("b.pos")).alias("pos"), F.col("b.large").alias("url"), "b.from_srcset", *[f"b.{c}" for c in extra], "n")
    b = b.withColumn("fits", img.large_enough(F.col("url"), F.col("score")))
    if audit:
        b = b.observe(audit.grouped, F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(~F.col("fits")).alias("small_file"), F.count_if(F.col("fits")).alias("kept"))
    b = b.where("fits").drop("n", "fits").withColumn("bytes", img.estimated_bytes(F.col("url")))
    order = Window.partitionBy(page).orderBy(F.desc("score"), F.desc("bytes"), "pos")
    return b.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def product_star(products: DataFrame, tags: DataFrame, categories: DataFrame, paths: DataFrame, id_col: str) -> DataFrame:
    """Products with their tags (name, type) and categories (name, level, full_path), and the path of the deepest category (the
    smallest id on ties). Bridges are aggregated before they meet the products, so nothing multiplies.
    tags: (id, name, tag_type); categories: (id, category_id, name, level); paths: (category_id, path)."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    t = tags.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("name", F.col("tag_type").alias("type")))).alias("tag_details"))
    c = categories.join(paths.groupBy("category_id").agg(F.min("path").alias("full_path")).hint("merge"), "category_id", "left")
    c = c.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("name", "level", "full_path"))).alias("category_details"), F.max_by("full_path", F.struct("level", -F.col("category_id"))).alias("category_full_path"))
    out = products.join(t.hint("merge"), id_col, "left").join(c.hint("merge"), id_col, "left")
    return out.withColumns({"tag_details": none(F.col("tag_details"), "array<struct<name:string,type:string>>"), "category_details": none(F.col("category_details"), "array<struct<name:string,level:int,full_path:string>>")})


def raw_and_product(scraped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scraped records (url, title, brand, description, price, ts) as rows of the raw table and of the products: ids are hashes
    of URL and time, so that a record saved again has the same; a new product has no tags, no category and confidence 0."""
    s = scraped.withColumn("raw_id", F.xxhash64("url", "ts"))
    product = s.select(F.xxhash64("raw_id").alias("product_id"), "raw_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "brand", "description", text.saved_price(F.col("price")).alias("price"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("confidence_score"))
    return s, product


def replace_bridges(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The bridge table after the keys in new have got exactly new's rows, once each."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def create_categories(asked: DataFrame, cats: DataFrame) -> DataFrame:
    """asked (seq, name, parent_id) with slug and status: "required" (blank name), "exists" (name and parent), "same slug" (slug
    and parent), or "created" for the first of a slug and parent, "same slug" for the rest."""
    a = asked.withColumn("slug", text.slug(F.col("name")))
    by = lambda c: cats.select(F.col(c).alias(f"known_{c}"), F.col("parent_id").alias(f"parent_{c}")).distinct()
    slugs = cats.withColumn("slug", text.slug(F.col("name")))
    n, s = by("name"), slugs.select(F.col("slug").alias("known_slug"), F.col("parent_id").alias("parent_slug")).distinct()
    d = a.join(n, (F.col("name") == F.col("known_name")) & F.col("parent_id").eqNullSafe(F.col("parent_name")), "left").join(s, (F.col("slug") == F.col("known_slug")) & F.col("parent_id").eqNullSafe(F.col("parent_slug")), "left")
    first = F.row_number().over(Window.partitionBy("parent_id", "slug").orderBy("seq")) == 1
    status = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "required").when(F.col("known_name").isNotNull(), "exists").when(F.col("known_slug").isNotNull() | ~first, "same slug").otherwise("created")
    return d.select("seq", "name", "parent_id", "slug", status.alias("status"))


def seed_taxonomy(cats: DataFrame, seed: DataFrame, root: str) -> DataFrame:
    """The taxonomy with its built-in nodes and the whole subtree of root replaced by seed (category_id, name, parent_id, level);
    nodes that a model found elsewhere stay."""
    kept = cats.where("llm_discovered = 1").join(subtree(cats, root), "category_id", "left_anti")
    return kept.unionByName(seed.withColumn("llm_discovered", F.lit(0)))


def mark_touched(cats: DataFrame, touched: DataFrame) -> DataFrame:
    """cats with llm_discovered set to 1 on the seed nodes in touched (category_id)."""
    t = touched.select("category_id", F.lit(1).alias("t")).distinct()
    return cats.join(t, "category_id", "left").withColumn("llm_discovered", F.greatest("llm_discovered", F.coalesce("t", F.lit(0)))).drop("t")


def merged_synonyms(built_in: DataFrame, saved: DataFrame) -> DataFrame:
    """(synonym, name): what has been saved wins over what is built in."""
    return built_in.join(saved.select("synonym"), "synonym", "left_anti").unionByName(saved)


def selector_lineage(images: DataFrame, selectors: DataFrame) -> DataFrame:
    """images (url, ...) with the selector (of selectors: url, selector) that found them: by the URL, else without its protocol."""
    bare = lambda c: F.regexp_replace(c, "^https?:", "")
    exact = selectors.groupBy("url").agg(F.min("selector").alias("exact"))
    loose = selectors.groupBy(bare(F.col("url")).alias("bare")).agg(F.min("selector").alias("loose"))
    d = images.join(exact, "url", "left").withColumn("bare", bare(F.col("url"))).join(loose, "bare", "left")
    return d.select(*images.columns, F.coalesce("exact", "loose", F.lit("unknown")).alias("selector"))
