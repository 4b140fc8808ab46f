"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(col: Column | str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text leaves 1 when divided by 3. A null id is no part of it."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col) % 3 == 1, F.lit(False))


def smallest(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest hash of their id: a sample that does not depend on how rows are dealt."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def made_of(docs: DataFrame, ids: DataFrame, make: Callable[[str | None], bytes]) -> dict[int, bytes]:
    """make(text) for the documents in ids, a bounded sample, which is broadcast; texts stay in the tasks that read them.
    Of rows that repeat an id the smallest result counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(t.as_py()) for t in batch.column(1)], pa.binary())], ["doc_id", "made"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id")
    return dict(sorted(map(tuple, texts.mapInArrow(run, "doc_id long, made binary").groupBy("doc_id").agg(F.min("made")).collect())))


def bin_counts(texts: DataFrame, bins_of: Callable[[str | None], np.ndarray], bins: int) -> tuple[np.ndarray, int]:
    """In how many texts (the one column) each bin stands, and the number of texts. Counted in tasks; a row a bin comes back.
    bins_of: the distinct bins of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total[bins_of(t.as_py())] += 1
            total[bins] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bin", "n"])

    out = np.zeros(bins + 1, np.int64)
    for at, n in texts.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[at] = n
    return out[:bins], int(out[bins])


def known_ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder in spark.checkpoint.dir, or the one that the context has been given. Where neither is set, only a
    session whose executors are threads of this process (as in tests) gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and sc.master.split("[")[0] == "local":
            place = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
        if place is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_POW = np.cumprod(np.full(4096, np.uint64(0x100000001B3) | np.uint64(1), np.uint64), dtype=np.uint64)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and the byte offsets at which words start and end."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b, edges[::2], edges[1::2]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word. value: what to hash instead of the bytes themselves, such as lower-cased ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts[1:]]), np.diff(np.concatenate([[0], starts[1:], [len(b)]])))
    v = (b if value is None else value).astype(np.uint64) + np.uint64(1)
    v *= _POW[at & 4095]
    v[_SPACE[b]] = 0
    return mix64(np.add.reduceat(v, starts) + lens.astype(np.uint64) * _M)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of the n-word windows, sorted; a shorter text has one window, its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * _M + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp), comp the smallest node of its component; nodes without an edge are left out.

    Alternates large-star and small-star until nothing moves, which takes a logarithmic number of rounds and keeps no more
    edges than it was given. Edges stay in executors. A round is one job, a checkpoint in the shared folder (so a lost
    executor costs one round), which counts and sums its edges as it writes them."""
    ensure_checkpoint_dir(edges.sparkSession)

    def star(e: DataFrame, small: bool) -> DataFrame:
        two = e if small else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # small star: a > b already; large star: every node sees all its neighbours
        low = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = two.join(low, "a")
        if small:
            out = j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        else:
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = out.union(low.where("m <> a").select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).checkpoint()
        return e, (seen.get["n"], seen.get["h"])

    e, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        e, now = written(star(star(e, False), True).distinct())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def partitions_for(rows: int, per: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per))
