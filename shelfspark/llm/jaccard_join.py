"""Chosen-path Jaccard join on word shingles.

Texts that are equal as shingle sets are folded into one set first. A run grows a tree over the sets: the sets of a node go
to the children of one or two of ``COORDS`` sampled coordinates (a coordinate's value is the shared token that comes first in
its random order, so two sets follow the same path with a probability equal to their similarity; two coordinates are drawn
as often as keeps the expected number of shared children of a pair at the threshold at one). Nodes of at most ``bucket`` sets
are compared by brute force on sketches. In a larger node every set is also compared with one set of it drawn at random;
those close to it are linked and leave the node, so groups of near copies dissolve in linear time and all others are split
on, however often it takes. After each batch of runs a random sample of sets is compared by brute force with all sets; runs
repeat until ``recall`` of the pairs so found are in one family. Later runs compare only sets of different families.

Every family is then compared exactly, all sets with all, in blocks, in tasks that return counts and a spanning forest
rather than pairs. Nothing is capped: exact counts inside a family take time by the square of its different texts.

Result, one row per input row: the id column, ``class_id`` (smallest id of the class; links are closed transitively),
``n_links`` (other rows at or above the threshold, copies included), ``n_copies`` (other rows of the same shingle set).

Defined cases: a null text counts as empty; a text without words has no shingle, and such rows form one class of copies;
fewer words than a shingle: one shingle of all words; rows with a null id keep a null class and no links; a repeated id
counts as several rows, each with the links of its own text; very long texts are cut into shingles whole; an empty table
gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import connected_components, ensure_checkpoint_dir, mix64, shingle_hashes, word_hashes, word_spans

#: Sampled coordinates of a set: its path is chosen from them, and 16 bits of each make its sketch.
COORDS = 32
_SEEDS = mix64(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def needed(threshold: float) -> int:
    """Coordinates in which a pair at the threshold agrees, less four standard deviations."""
    return math.floor(COORDS * threshold - 4 * math.sqrt(COORDS * threshold * (1 - threshold)))


def _shingles(text: str | None, n: int) -> np.ndarray:
    b, s, e = word_spans((text or "").encode("utf-8", "surrogatepass"))
    return shingle_hashes(word_hashes(b, s, e), n)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDS 32-bit values for each set, none of them empty. Sets go through numpy together."""
    out = np.zeros((len(sets), COORDS), np.uint32)
    size = np.array([len(s) for s in sets])
    step, done = 1 << 20, 0
    while done < len(sets):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(size[done:]), step)) + done)
        flat, at = np.concatenate(sets[done:upto]), np.concatenate([[0], np.cumsum(size[done : upto - 1])])
        for k, seed in enumerate(_SEEDS):
            out[done:upto, k] = mix64(np.minimum.reduceat(flat * seed, at)).astype(np.uint32)
        done = upto
    return out


def _signer(n: int):
    """Of each text: two hashes and the size of its shingle set, the minima (path) and 16 bits of each (sig)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):  # sets of so many texts in memory
            sets = [_shingles(t.as_py(), n) for t in batch.column(2)]
            full = [i for i, s in enumerate(sets) if len(s)]
            m = np.zeros((len(sets), COORDS), np.uint32)
            if full:
                m[full] = minima([sets[i] for i in full])
            k1, k2 = (np.array([h(s) for s in sets], np.uint64).astype(np.int64) for h in (lambda s: mix64(s).sum(), lambda s: mix64(s ^ np.uint64(0xABCDEF)).sum()))
            cols = [batch.column(0), batch.column(1), pa.array(k1), pa.array(k2), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in m], pa.binary()), pa.array([r.tobytes() for r in m.astype(np.uint16)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "k1", "k2", "size", "path", "sig"])

    return sign


def _sketches(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, COORDS)


def _forest(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """roots: the component label of 0..n-1, refined by the links a-b."""
    while True:
        low = np.minimum(roots[a], roots[b])
        new = roots.copy()
        np.minimum.at(new, roots[a], low)
        np.minimum.at(new, roots[b], low)
        new = new[new]
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def _bucket_links(need: int):
    """Rows of (node, comp, sig) in order of node: every node's sets meet in numpy, all nodes of a batch at once, and each
    component that meets another gives one link."""

    def met(node: np.ndarray, comp: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        n, roots, a, b = len(node), np.arange(len(node)), [], []
        at = np.arange(n)
        d = 1
        while len(at):
            at = at[at + d < n]
            at = at[node[at] == node[at + d]]  # who has a partner d places on is among those that had one d - 1 places on
            i = at[comp[at] != comp[at + d]]
            for x in range(0, len(i), 1 << 17):
                j = i[x : x + (1 << 17)]
                j = j[(sk[j] == sk[j + d]).sum(1) >= need]
                a.append(j)
                b.append(j + d)
            d += 1
        if a:
            roots = _forest(n, np.concatenate(a), np.concatenate(b), roots)
        new = np.flatnonzero(comp != comp[roots])
        return pa.RecordBatch.from_arrays([pa.array(comp[new]), pa.array(comp[roots[new]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, comp, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, COORDS), np.uint16)
        for batch in batches:
            node = np.concatenate([node, batch.column(0).to_numpy()])
            comp = np.concatenate([comp, batch.column(1).to_numpy()])
            sig = np.concatenate([sig, _sketches(batch.column(2).to_pylist())])
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last node may go on in the next batch
            if cut:
                yield met(node[:cut], comp[:cut], sig[:cut])
                node, comp, sig = node[cut:], comp[cut:], sig[cut:]
        if len(node):
            yield met(node, comp, sig)

    return run


def _close(need: int):
    @F.pandas_udf("boolean")
    def close(a, b):
        return pd.Series((_sketches(a) == _sketches(b)).sum(1) >= need)

    return close


def _value(col: str, at: Column, width: int) -> Column:
    return F.substring(F.col(col), at * width + 1, F.lit(width))


def _paths(sets: DataFrame, runs: range, more: float) -> DataFrame:
    """Of every set the nodes at the first level of these runs: a coordinate of each run, and another one of some runs."""
    roots = [(r, r % COORDS) for r in runs]
    for r in runs:
        if int((r + 1) * more) > int(r * more):
            roots.append((r, (r + COORDS // 2) % COORDS))
    node = lambda r, c: F.xxhash64(F.lit(r), F.lit(c), _value("path", F.lit(c), 4))
    return sets.select(F.explode(F.array(*[node(r, c) for r, c in roots])).alias("node"), "set", "comp", "sig")


def _children(rows: DataFrame, level: int, more: float) -> DataFrame:
    """A node's coordinates are drawn by a hash of the node, so that all its sets draw the same."""
    draw = lambda i: F.xxhash64("node", F.lit(level), F.lit(i))
    first = F.pmod(draw(0), F.lit(COORDS)).cast("int")
    other = F.pmod(first + 1 + F.pmod(draw(1), F.lit(COORDS - 1)), F.lit(COORDS)).cast("int")
    child = lambda c: F.xxhash64("node", c, _value("sig", c, 2))
    two = F.pmod(draw(2), F.lit(1000)) < round(1000 * more)
    return rows.select(F.explode(F.when(two, F.array(child(first), child(other))).otherwise(F.array(child(first)))).alias("node"), "set", "comp", "sig")


def _batch_links(sets: DataFrame, runs: range, need: int, threshold: float, bucket: int) -> DataFrame:
    """(a, b): links between the components of sets that meet in these runs."""
    more = 1 / threshold - 1
    close, rows, level = _close(need), _paths(sets, runs, more), 1
    small, links = [], []
    while True:
        order = F.xxhash64("set", F.lit(level * 7919 + runs.start))
        # a node of one component has nothing to find; sums alone are shuffled here. What remains is written with what is known of
        # its node, in one job a level, as the brute force, the pivots and the next level all read it
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("pick")).where("lo < hi").select("node", "n", "pick")
        seen = Observation()
        at = rows.join(nodes, "node").observe(seen, F.count_if(F.col("n") > bucket).alias("large")).checkpoint()
        small.append(at.where(F.col("n") <= bucket).select("node", "comp", "sig"))
        if not seen.get["large"]:
            break
        large = at.where(F.col("n") > bucket).withColumn("picked", order == F.col("pick")).drop("n", "pick")
        pivot = large.where("picked").select("node", F.col("comp").alias("pivot"), F.col("sig").alias("pivot_sig"))
        met = large.join(pivot, "node").withColumn("close", close("sig", "pivot_sig")).checkpoint()
        links.append(met.where("close AND comp <> pivot").select(F.col("comp").alias("a"), F.col("pivot").alias("b")))
        # the picked one stays, for those close to it that are not close enough here
        rows, level = _children(met.where("NOT close OR picked").select("node", "set", "comp", "sig"), level, more), level + 1
    all_small = small[0]
    for s in small[1:]:
        all_small = all_small.unionByName(s)
    found = all_small.repartition("node").sortWithinPartitions("node").mapInArrow(_bucket_links(need), "a long, b long")
    for x in links:
        found = found.unionByName(x)
    return found


def _found_of(sample: list[tuple[int, bytes]], comps: dict[int, int], least: int):
    """Counts, in a task, of the pairs of a sampled set and another set that agree in so many coordinates, and of those in one component."""
    keys, sk = np.array([s for s, _ in sample]), _sketches([x for _, x in sample])
    own = np.array([comps[s] for s, _ in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = found = 0
        for batch in batches:
            node, comp, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sketches(batch.column(2).to_pylist())
            for k in range(len(keys)):
                near = (sig == sk[k]).sum(1) >= least
                near &= node != keys[k]
                total += int(near.sum())
                found += int((comp[near] == own[k]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([found])], ["total", "found"])

    return run


def families(sets: DataFrame, threshold: float, recall: float, bucket: int, batch: int, sample: int) -> DataFrame:
    """sets (set, path, sig) -> set, comp: sets whose sketches agree as a pair's at the threshold are in one component, up to recall."""
    need, start = needed(threshold), 0
    drawn = [tuple(r) for r in sets.orderBy(F.xxhash64("path"), "set").limit(sample).select("set", "sig").collect()]
    few = sets.sparkSession.createDataFrame([(s,) for s, _ in drawn], "set long")
    comps = sets.select("set", F.col("set").alias("comp")).checkpoint()
    while drawn:
        rows = sets.join(comps, "set")
        links = connected_components(_batch_links(rows, range(start, start + batch), need, threshold, bucket))
        comps = comps.join(links.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("set", F.coalesce("root", "comp").alias("comp")).checkpoint()
        own = dict(map(tuple, comps.join(F.broadcast(few), "set").collect()))
        total, found = sets.join(comps, "set").select("set", "comp", "sig").mapInArrow(_found_of(drawn, own, math.ceil(COORDS * threshold)), "total long, found long").agg(F.sum("total"), F.sum("found")).first()
        start += batch
        if found >= recall * total and (total or start > batch):  # a sample without a pair says nothing: one more batch
            break
    return comps


def _exact(n: int, threshold: float):
    """For one family, or two blocks of it (a cell): exact counts of links and a spanning forest. side 0: all with all; 1 and 2: across."""
    exact = Fraction(str(threshold))  # in integers: 0.8 is 4 of 5

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set").sort_values("set")
        ids, weight, side = pdf["set"].to_numpy(), pdf["weight"].to_numpy(), pdf["side"].to_numpy()
        sets = [_shingles(t, n) for t in pdf["text"]]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        df = np.bincount(token)
        keep = df[token] > 1
        row, token = row[keep], np.unique(token[keep], return_inverse=True)[1]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        step = max(64, 8_000_000 // max(1, len(sets)))
        for t in range(0, int(token[-1]) + 1 if len(token) else 0, step):
            lo, hi = np.searchsorted(token, [t, t + step])
            x = np.zeros((len(sets), min(step, int(token[-1]) + 1 - t)), np.float32)
            x[row[lo:hi], token[lo:hi] - t] = 1
            inter += x @ x.T
        union = size[:, None] + size[None, :] - inter
        link = inter * exact.denominator >= exact.numerator * union
        np.fill_diagonal(link, False)
        if side.any():
            link &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(link))
        roots = _forest(len(ids), a, b, np.arange(len(ids)))
        return pd.DataFrame({"set": ids, "root": ids[roots], "n": link @ weight, "whole": not pdf["cell"].iat[0]})

    return compare


def _in_blocks(df: DataFrame, rank_by: str, per: int) -> DataFrame:
    """Adds cell and side: a group whose ``load`` is over `per` is cut into blocks, and each pair of blocks is a cell of its own."""
    nb = F.ceil(F.col("load") / F.lit(per)).cast("int")
    blk = F.pmod(F.xxhash64(rank_by), nb).cast("int")
    cells = F.when(nb <= 1, F.array(F.struct(F.lit("").alias("cell"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), nb - 1), lambda o: F.struct(F.concat_ws("-", F.least(blk, o), F.greatest(blk, o)).alias("cell"), F.when(o == blk, 0).when(o > blk, 1).otherwise(2).alias("side")))
    )
    # in a cell of a block with itself all rows have side 0
    return df.withColumn("c", F.explode(cells)).select("*", "c.cell", "c.side").drop("c", "load")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, recall: float = 0.995, bucket: int = 128, batch: int = 5, sample: int = 1024, block: int = 1024) -> DataFrame:
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    key = ["k1", "k2", "size"]
    signed = rows.where("id is not null").mapInArrow(_signer(words), "id long, h long, k1 long, k2 long, size long, path binary, sig binary").checkpoint()
    # a set is known by a number that is written with it; its text is that of one row, known by id and hash
    one = F.min(F.struct("id", "h", "path", "sig")).alias("one")
    folded = signed.groupBy(*key).agg(one, F.count("*").alias("weight")).select(*key, F.monotonically_increasing_id().alias("set"), "one.*", "weight").checkpoint()
    # a text without a shingle has no partner but its copies
    sets = folded.where("size > 0").select("set", "path", "sig")
    comps = families(sets, threshold, recall, bucket, batch, sample)

    info = comps.join(folded.select("set", "id", "h", "size", "weight"), "set").checkpoint()
    load = info.groupBy("comp").agg(F.greatest(F.ceil(F.sum("size") / 1000), F.count("*")).alias("load"), F.count("*").alias("n")).where("n > 1").select("comp", "load")
    cells = _in_blocks(info.join(load, "comp").select("comp", "set", "id", "h", "weight", "load"), "set", block)
    texts = rows.join(cells, ["id", "h"]).select("comp", "cell", "side", "set", "weight", "text")
    found = texts.groupBy("comp", "cell").applyInPandas(_exact(words, threshold), "set long, root long, n long, whole boolean").checkpoint()
    # a family that was one cell has its classes; the forests of a family's cells are put together
    edges = found.where("NOT whole AND set <> root").select(F.col("set").alias("a"), F.col("root").alias("b"))
    classes = found.where("whole").select("set", F.col("root").alias("comp")).unionByName(connected_components(edges).withColumnRenamed("node", "set"))
    least = classes.join(folded.select("set", "id"), "set").groupBy("comp").agg(F.min("id").alias("class_id"))
    links = found.groupBy("set").agg(F.sum("n").alias("n"))
    result = folded.select(*key, "set", "id", "weight").join(links, "set", "left").join(classes.join(least, "comp"), "set", "left")
    result = result.select(*key, F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))
    out = signed.select("id", *key).join(result, key).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")
    none = rows.where("id is null").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return out.unionByName(none)
