"""Exact top-k inner-product search with a KD-tree per shard.

Rows are cut into at most ``CELLS`` cells of space by median splits of the widest dimension, fitted on a bounded sample, and a
cell of more than ``shard_rows`` rows (copies of one vector, say) into shards by a hash of the id. Every shard builds its
KD-tree once (median splits of the widest dimension, tight bounding boxes), which is written to the shared folder. The boxes
of the cells, at most ``CELLS``, are what goes to all tasks. A query is first answered in one shard of the cell whose box
promises most; the kth score found there goes along to those other shards only whose box can reach it. Within a shard it
goes through the nodes best bound first (the largest inner product any point of the box can have) and stops when the bound
is below its kth best score. Vectors move once, and again only for each further ``group`` queries; k rows for each query and
shard leave a task.

Vectors are made whole by ``floor(scale * x)``; scores are integers; ties go to the smaller id. Rows with a null id, a null
or empty vector, or a null or non-finite component take no part; vectors are compared with those of the same length;
repeated ids are separate rows and separate queries, and none of them answers a query of its own id; an empty table gives an
empty result; further columns are ignored, whatever their names. Scores must fit in 64 bits.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

LEAF, CELLS, SAMPLE = 256, 1024, 1 << 14


def _widest(x: np.ndarray) -> tuple[int, int]:
    spread = x.max(0) - x.min(0)
    wide = int(np.argmax(spread))
    return wide, int(spread[wide])


class KDTree:
    """Rows in the order of the leaves; of each node its box, its children (0: a leaf) and its rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order, self.lo, self.hi, self.kids, self.span = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me, part = len(self.lo), x[order[a:b]]
            if parent >= 0:
                self.kids[parent][side] = me
            self.lo.append(part.min(0))
            self.hi.append(part.max(0))
            self.kids.append([0, 0])
            self.span.append((a, b))
            wide, spread = _widest(part)
            if b - a > leaf and spread:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], half)]
                todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.ids, self.x = ids[order], x[order]
        self.lo, self.hi, self.kids, self.span = map(np.array, (self.lo, self.hi, self.kids, self.span))

    def saved(self) -> bytes:
        out = io.BytesIO()
        small = np.abs(self.x).max(initial=0) < 2**31
        np.savez(out, ids=self.ids, x=self.x.astype(np.int32) if small else self.x, lo=self.lo, hi=self.hi, kids=self.kids, span=self.span)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> KDTree:
        tree, parts = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.x, tree.lo, tree.hi, tree.kids, tree.span = (parts[n] for n in ("ids", "x", "lo", "hi", "kids", "span"))
        tree.x = tree.x.astype(np.int64)
        return tree

    def search(self, qid: int, q: np.ndarray, bound: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of those at or above kth. bound: of each node."""
        best_s, best_i = np.zeros(0, self.x.dtype), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.kids[node, 0]:
                for c in self.kids[node]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            s = self.x[a:b] @ q
            good = np.flatnonzero(s >= kth)
            good = good[self.ids[a:b][good] != qid]
            if len(good):
                s, i = np.concatenate([best_s, s[good]]), np.concatenate([best_i, self.ids[a:b][good]])
                order = np.lexsort((i, -s))[:k]
                best_s, best_i = s[order], i[order]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
        return best_s, best_i


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query and box, the largest inner product of a point in the box; never less, where doubles are not exact."""
    exact = q.dtype == np.float64
    q, lo, hi = (a.astype(np.float64) for a in (q, lo, hi))
    out = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    return out if exact else out + 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """In doubles, whose products are fast, where they are exact: below 2**52."""
    big = max([1.0, *(float(np.abs(p).max()) for p in parts if p.size)])
    return [p.astype(np.float64) for p in parts] if parts[0].shape[-1] * big * big < 2**52 else list(parts)


def space_splits(x: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """A tree of median splits: (dimension, value, left, right), a child below 0 being the cell -1 - child."""
    out: list[tuple[int, int, int, int]] = []
    made = 0

    def cut(rows: np.ndarray, n: int) -> int:
        nonlocal made
        wide, spread = _widest(rows) if len(rows) else (0, 0)
        value = int(np.partition(rows[:, wide], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]) if spread else 0
        left = rows[:, wide] <= value
        if n < 2 or not spread or left.all():
            made += 1
            return -made
        me = len(out)
        out.append((0, 0, 0, 0))
        out[me] = (wide, value, cut(rows[left], n // 2), cut(rows[~left], n - n // 2))
        return me

    cut(x, cells)
    return out


def cell_of(x: np.ndarray, splits: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if splits else []
    while todo:
        node, rows = todo.pop()
        wide, value, a, b = splits[node]
        left = x[rows, wide] <= value
        for child, mine in ((a, rows[left]), (b, rows[~left])):
            if child < 0:
                out[mine] = -1 - child
            else:
                todo.append((child, mine))
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.array(pdf["v"].tolist(), np.int64)
    tree = KDTree(pdf["id"].to_numpy(), x)
    return pd.DataFrame({"dim": [x.shape[1]], "cell": [pdf["cell"].iat[0]], "sub": [pdf["sub"].iat[0]], "lo": [x.min(0)], "hi": [x.max(0)], "tree": [tree.saved()]})


def _answer(k: int):
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(trees) and len(queries):
            tree = KDTree.loaded(trees["tree"].iat[0])
            q, tree.x, tree.lo, tree.hi = _exact(np.array(queries["v"].tolist(), np.int64), tree.x, tree.lo, tree.hi)
            ids, keys, kth = queries["id"].to_numpy(), queries["q"].to_numpy(), queries["kth"].astype("float64").fillna(-np.inf).to_numpy()
            for a in range(0, len(q), 512):
                bound = bounds(q[a : a + 512], tree.lo, tree.hi)
                for j in range(len(bound)):
                    s, i = tree.search(ids[a + j], q[a + j], bound[j], k, kth[a + j])
                    out.append((np.full(len(s), keys[a + j]), i, s.astype(np.int64)))
        return pd.DataFrame({n: np.concatenate([x[c] for x in out]) for c, n in enumerate(("q", "vec_id", "score"))})

    return run


def _route(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """boxes: for each length of vectors the cells, their numbers of shards, lo and hi. Of a query the shard to begin with, or
    all others whose box can reach its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                if dim not in boxes:
                    continue
                cells, subs, lo, hi = boxes[dim]
                for rows in np.array_split(of := np.flatnonzero(dims == dim), -(-len(of) // 1024)):
                    some = batch.take(pa.array(rows))
                    q, low, high = _exact(some.column(3).flatten().to_numpy().reshape(-1, dim), lo, hi)
                    bound = bounds(q, low, high)
                    home = bound.argmax(1)
                    sub = (some.column(0).to_numpy() * 7919 + 13) % subs[home]
                    if first:
                        at, cell, every = np.arange(len(q)), home, sub
                    else:
                        at, cell = np.nonzero(bound >= some.column(4).cast(pa.float64()).fill_null(-np.inf).to_numpy()[:, None])
                        n = subs[cell]
                        at, cell, every = np.repeat(at, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        rest = (cell != home[at]) | (every != sub[at])
                        at, cell, every = at[rest], cell[rest], every[rest]
                    for b in range(0, len(at), 8192):
                        x = slice(b, b + 8192)
                        sent = some.take(pa.array(at[x]))
                        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cells[cell[x]]), pa.array(every[x])], ["q", "id", "dim", "v", "kth", "cell", "sub"])

    return run


def _whole(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"), F.size(vec_col).cast("long").alias("dim"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shard_rows: int = 16384, group: int = 1 << 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; queries has the columns of vectors."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = _whole(vectors, id_col, vec_col, scale)
    # a number that is written with the query tells queries of a repeated id apart
    asked = _whole(queries, id_col, vec_col, scale).withColumn("q", F.monotonically_increasing_id()).checkpoint()
    n, m = rows.count(), asked.count()
    cells, groups = min(CELLS, max(1, -(-n // shard_rows))), max(1, -(-m // group))

    drawn: dict[int, list] = {}
    for dim, v in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE if cells > 1 else 0).select("dim", "v").collect():
        drawn.setdefault(dim, []).append(v)
    splits = {dim: space_splits(np.array(v, np.int64), cells) for dim, v in drawn.items()}

    @F.pandas_udf("long")
    def cell(v: pd.Series, dim: pd.Series) -> pd.Series:
        out = pd.Series(0, v.index, dtype="int64")
        for d, part in v.groupby(dim):
            out[part.index] = cell_of(np.array(part.tolist(), np.int64), splits.get(d, []))
        return out

    placed = rows.withColumn("cell", cell("v", "dim"))
    size = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("subs"))  # a row a cell
    subs = {(d, c): s for d, c, s in size.collect()}
    many = F.create_map(*[F.lit(x) for (d, c), s in subs.items() if s > 1 for x in (f"{d} {c}", s)]) if any(s > 1 for s in subs.values()) else None
    parts = F.lit(1) if many is None else F.coalesce(F.try_element_at(many, F.concat_ws(" ", "dim", "cell")), F.lit(1))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("id"), parts).cast("long"))
    trees = placed.groupBy("dim", "cell", "sub").applyInPandas(_build, "dim long, cell long, sub long, lo array<long>, hi array<long>, tree binary").checkpoint()
    corners = trees.select("dim", "cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "c")).groupBy("dim", "cell", "at").agg(F.min("c.lo").alias("lo"), F.max("c.hi").alias("hi"))
    box = corners.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("b")).select("dim", "cell", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")).orderBy("dim", "cell").collect()
    boxes = {d: tuple(np.array(x, np.int64) for x in zip(*[(r["cell"], subs[d, r["cell"]], r["lo"], r["hi"]) for r in box if r["dim"] == d])) for d in {r["dim"] for r in box}}

    spread = trees.select("dim", "cell", "sub", "tree", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    key = ["dim", "cell", "sub", "grp"]

    def search(qs: DataFrame, first: bool) -> DataFrame:
        routed = qs.mapInArrow(_route(boxes, first), "q long, id long, dim long, v array<long>, kth long, cell long, sub long")
        routed = routed.withColumn("grp", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
        return spread.groupBy(key).cogroup(routed.groupBy(key)).applyInPandas(_answer(k), "q long, vec_id long, score long")

    cols = ["q", "id", "dim", "v"]
    begun = search(asked.select(*cols, F.lit(None).cast("long").alias("kth")), True).checkpoint()
    kth = begun.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = search(asked.join(kth, "q", "left").select(*cols, "kth"), False)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = begun.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
