"""Building and writing the taxonomy: ancestors from file order, slug counters, path walks, synonyms, clean-up.

The seed taxonomy itself is a parameter: a DataFrame of (seq, name, level), of the size of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def ancestor_paths(seed: DataFrame, levels: int = 4) -> DataFrame:
    """seq, name, level, path: a row's parent is the last row one level up, in file order. One ordered pass over a dictionary."""
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.col("name")), ignorenulls=True).over(w) for k in range(levels)]
    kept = seed.withColumns({f"l{k}": c for k, c in enumerate(last)})
    return kept.select("seq", "name", "level", F.array_join(F.array(*[F.when(F.col("level") >= k, F.col(f"l{k}")) for k in range(levels)]), " > ").alias("path"))


def unique_slugs(df: DataFrame, name: str, seq: str) -> DataFrame:
    """The first of a slug keeps it; the nth gets -(n-1)."""
    d = df.withColumn("slug", text.slug(F.col(name)))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(seq))
    return d.withColumn("slug", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n - 1)))


def missing_levels(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """The prefixes of paths that existing (path) lacks, once each: what a walk that creates categories adds."""
    parts = F.split("path", " > ")
    prefixes = paths.select(parts.alias("p")).select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"), "p").select((F.col("n") - 1).alias("level"), F.array_join(F.slice("p", F.lit(1), F.col("n")), " > ").alias("path"))
    return prefixes.distinct().join(existing.select("path").hint("merge"), "path", "left_anti")


def create_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """What a walk along paths adds to known (category_id, path): category_id, name, slug, parent_id, level, path of every level that is
    missing. An id is a hash of its whole path, so parents and children agree on it without an order of writing, two walks
    of one path make one node, and a walk over what is already there makes none."""
    new_id = lambda p: F.xxhash64(p).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))  # noqa: E731  far from ids that were counted up
    n = missing_levels(paths, known).withColumns({"name": F.element_at(F.split("path", " > "), -1), "parent": F.regexp_extract("path", r"^(.*) > ", 1)})
    ids = known.groupBy(F.col("path").alias("parent")).agg(F.min("category_id").cast("long").alias("known_id"))
    n = n.join(ids.hint("merge"), "parent", "left").withColumn("parent_id", F.when(F.col("parent") != "", F.coalesce("known_id", new_id(F.col("parent")))))
    return n.select(new_id(F.col("path")).alias("category_id"), "name", text.slug(F.col("name")).alias("slug"), "parent_id", "level", "path")


def known_prefix(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """path, depth: how many levels exist before the first gap."""
    parts = F.split("path", " > ")
    pre = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " > "))).alias("i", "prefix"))
    there = pre.join(existing.select(F.col("path").alias("prefix"), F.lit(True).alias("there")), "prefix", "left")
    gap = F.min(F.when(F.col("there").isNull(), F.col("i")))
    return there.groupBy("path").agg(F.coalesce(gap, F.max("i") + 1).alias("depth"))


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row written for each key."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))).where("r = 1").drop("r")


def save_synonyms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(synonym, category_name, seq): trimmed, lower-cased, the latest wins; blanks are refused."""
    n = new.withColumn("synonym", text.normalize_text(F.col("synonym"))).where("synonym <> ''")
    return latest(old.unionByName(n), ["synonym"], "seq")


def merge_twins(cats: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each (name, parent) the model-found or else oldest row stays; children and bridges follow it."""
    first = F.first("category_id").over(Window.partitionBy("name", "parent_id").orderBy(F.desc("llm_discovered"), "category_id"))
    kept = cats.withColumn("kept", first)
    moved = kept.select(F.col("category_id").alias("was"), "kept")
    to = moved.withColumnRenamed("was", "parent_id").withColumnRenamed("kept", "new_parent")
    out = kept.where("category_id = kept").drop("kept").join(to, "parent_id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")
    b = bridges.join(moved, bridges.category_id == moved.was, "left").select("product_id", F.coalesce("kept", "category_id").alias("category_id")).distinct()
    return out.select(*cats.columns), b


#: Departments and the tag types that they allow; a department not listed allows all.
DEPARTMENT_TYPES = {"Fashion": ["colors", "materials", "patterns", "styles", "fit", "occasions", "features"], "Hardware": ["materials", "features", "finishes", "colors"]}


def allowed_types(department: Column, tag_type: Column) -> Column:
    ok = F.lit(True)
    for d, types in DEPARTMENT_TYPES.items():
        ok = F.when(department == d, tag_type.isin(types)).otherwise(ok)
    return ok
