"""Mixing sources to target word counts with a multivariate-hypergeometric splitting tree.

1. Sources in code-point order, null last, weigh ``weights`` repeating. They share ``share`` of all words; a target stops at
   ``most`` times its source's words and the rest is shared again by weight until none is above (``source_targets``).
2. Every source is cut into ``BLOCKS`` blocks by a hash of the document, and each block into as many parts. A source's blocks
   stand in a random order; its quota is the whole passes that fit into the target, and blocks and parts of the next pass up
   to it. In the one part where the quota ends, every document gives the same share of its words, so the quota is met within
   one word a document.
3. The tree: the blocks drawn from all sources are the root's. A node's blocks, in random order, are cut into two equal
   halves, so how many blocks of each source go left is a multivariate-hypergeometric draw with the node's exact quotas;
   leaves are output shards. One random permutation serves all levels, since within a half the order is still uniform.
4. Documents follow their block, and are ordered in the shard by a hash (``assign`` returns one row for each document and
   pass).

Everything is a DataFrame expression. Sources may be many (hosts, say): orders over all of them are made by ranges, in many
tasks (``ranked``); only the order of one source's blocks and parts, at most BLOCKS x BLOCKS rows, is made in one.

Result of ``mix``: id, ``size``, ``source_size``, ``target``, ``taken``, and for each pass in which the document is taken its
shard (``shards``) and place in the shard's shuffle (``orders``). ``assign`` deals the same passes as rows, of whole documents.
The draw depends on ids, texts and the seed only, so reruns agree. Defined cases: null text has no words; very long texts are counted whole; rows
equal in id and text fall into one part and are taken alike; null ids are allowed; a table without words has targets 0; an
empty table gives an empty result; ``mix`` reads no column but the three it is given, and ``assign`` keeps all others, but for
those named like the ones it adds, all of which begin with ``mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ensure_checkpoint_dir

BLOCKS = 64


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*cols: Column, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n)).cast("int")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """id, source, size, the document's block and part, and a key of its id and text."""
    key = [F.col(id_col), F.length(text_col)]
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        _uniform(*key, n=blocks, seed=seed).alias("block"), _uniform(*key, n=blocks, seed=seed + 1).alias("part"), F.xxhash64(id_col, text_col).alias("key"),
    )


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``rank`` (from 0) by order: ranges of it in many tasks, whose counts, a row a range, are summed up."""
    ensure_checkpoint_dir(df.sparkSession)
    d = df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).checkpoint()
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = d.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return d.withColumn("rank", place).join(counts, "range").withColumn("rank", F.col("rank") + F.col("before")).drop("range", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> source, source_size, target. What a unit of weight gets rises as sources reach their cap; each
    round is one aggregate, and the last caps no source more."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = ranked(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap")).checkpoint()
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        r = s.agg(F.sum("source_size"), F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if r[1] == capped or not r[3]:
            break
        level, capped = (r[0] * share - (r[2] or 0.0)) / r[3], r[1]
    return s.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level) if r[3] else F.col("cap")).alias("target"))


def quotas(docs: DataFrame, seed: int, weights, share, most) -> DataFrame:
    """One row for each source, block and part with words: passes (whole copies), frac (share of one copy more), target."""
    ensure_checkpoint_dir(docs.sparkSession)
    parts = docs.groupBy("source", "block", "part").agg(F.sum("size").alias("words")).checkpoint()
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    draw = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block", F.xxhash64(F.lit(seed + 3), "source", "block", "part"), "part").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.withColumnRenamed("source", "s")
    q = parts.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    q = q.withColumn("before", F.coalesce(F.sum("words").over(draw), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    q = q.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    frac = F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rest") - F.col("before")) / F.col("words")))).otherwise(0.0)
    return q.select("source", "block", "part", "source_size", "target", "passes", frac.alias("frac")).checkpoint()


def shards(quota: DataFrame, depth: int, seed: int) -> DataFrame:
    """The splitting tree over drawn blocks: (source, block, pass) -> shard of 2**depth."""
    drawn = quota.groupBy("source", "block").agg(F.max(F.col("passes") + F.when(F.col("frac") > 0, 1).otherwise(0)).alias("n")).where("n > 0")
    blocks = drawn.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("pass"))
    node = ranked(blocks, F.xxhash64(F.lit(seed + 10), "source", "block", "pass"), F.col("source"), F.col("block"), F.col("pass"))
    node = node.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(node.count()), "shard": F.lit(0)})
    for _ in range(depth):
        middle = F.col("lo") + F.ceil((F.col("hi") - F.col("lo")) / 2)
        right = F.col("rank") >= middle
        node = node.select("source", "block", "pass", "rank", F.when(right, middle).otherwise(F.col("lo")).alias("lo"), F.when(right, F.col("hi")).otherwise(middle).alias("hi"), (F.col("shard") * 2 + right.cast("int")).alias("shard"))
    return node.select("source", "block", "pass", "shard")


def _on(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Joins on keys of which the first may be null; b has a fixed number of rows for each source."""
    b = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return a.join(b, cond, "left").drop(*[f"{k}_" for k in keys])


def _quotas_with_shards(sizes: DataFrame, depth: int, seed: int, weights, share, most) -> DataFrame:
    """quotas, and with each part the shards of its block by pass, so that documents are shuffled once."""
    quota = quotas(sizes, seed, weights, share, most)
    s = shards(quota, depth, seed).groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    return _on(quota, s, "source", "block")


def _takes(size: Column, passes: Column, frac: Column, shards: Column, key: Column, seed: int) -> Column:
    """For each pass in which a document is taken: pass, words, shard, order."""
    words = F.concat(F.array_repeat(size, passes.cast("int")), F.array(F.floor(frac * size).cast("long")))
    each = F.transform(words, lambda n, i: F.struct((i + 1).alias("pass"), n.alias("words"), F.get(shards, i).alias("shard"), F.xxhash64(F.lit(seed + 5), key, i + 1).alias("order")))
    return F.filter(each, lambda x: x["words"] > 0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, depth: int = 4, seed: int = 17) -> DataFrame:
    d = sized(docs, id_col, text_col, source_col, seed)
    out = _on(d, _quotas_with_shards(d, depth, seed, weights, share, most), "source", "block", "part")
    out = out.withColumn("takes", _takes(*map(F.col, ("size", "passes", "frac", "shards", "key")), seed))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.col("takes.shard").alias("shards"), F.col("takes.order").alias("orders"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, depth: int = 4, seed: int = 17) -> DataFrame:
    """One row for each pass in which a document is taken, with all its columns, ``mix_words`` (its words), ``mix_shard`` and
    ``mix_order`` (place in the shard's local shuffle). Documents are taken whole: one of the part in which its source's quota
    ends is taken once more with the probability of the share that ``mix`` counts."""
    added = ("mix_words", "mix_shard", "mix_order")
    key = [F.col(id_col), F.length(text_col)]
    d = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _uniform(*key, n=BLOCKS, seed=seed).alias("block"), _uniform(*key, n=BLOCKS, seed=seed + 1).alias("part"),
        F.xxhash64(id_col, text_col).alias("key"),
    )
    q = _quotas_with_shards(sized(docs, id_col, text_col, source_col, seed), depth, seed, weights, share, most)
    whole = F.when((F.pmod(F.xxhash64(F.lit(seed + 7), "key"), F.lit(1 << 30)) / (1 << 30)) < F.col("frac"), 1.0).otherwise(0.0)
    d = _on(d, q.select("source", "block", "part", "passes", "frac", "shards"), "source", "block", "part")
    d = d.select("row", F.explode(_takes(F.col("size"), F.col("passes"), whole, F.col("shards"), F.col("key"), seed)).alias("t"))
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], F.col("t.words").alias("mix_words"), F.col("t.shard").alias("mix_shard"), F.col("t.order").alias("mix_order"))
