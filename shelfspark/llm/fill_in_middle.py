"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut into units (white space with the word after it; white space at the end). Two automata read its bytes: one of two
states (between words, inside a word) that counts ends of words, and one that looks for the marks. A chunk of a text says, for every
state it may be entered in, in which state it is left and how many words end in it. These functions compose associatively, so the
entry states and running counts of all chunks of a document follow from a scan over their small tables, by doubling steps, and the
two cuts, the a-th and b-th ends of words, are then looked for only in the chunks that hold them.

A document of at most ``chunk`` bytes is one chunk and is done where it is read. Chunks of longer ones are dealt to all tasks as rows
of their own; a task that composes holds one small row for each chunk of one document (65,536 for the largest Spark string), and
the chunks with a cut are found by a join on their number. Spark expressions put the output together, so texts do not come
back from Python.

``transform(docs)`` keeps all columns of docs and adds ``fim_n`` (units), ``fim_form`` (plain, psm, spm), ``fim_prefix_chars``,
``fim_middle_chars`` (code points, null if plain) and ``fim_output``; columns of these names in docs are replaced. ``restore(output,
form)`` is the text again.

Defined cases: null text counts as empty; an empty text, or one that holds a mark, is plain; a null id draws from the empty string;
rows that repeat an id and text give the same result, one row each; texts of any length are whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, ensure_checkpoint_dir

P, S, M = "<P>", "<S>", "<M>"
MARKS = tuple(x.encode() for x in (P, S, M))
#: Bytes of a chunk.
CHUNK = 1 << 15
ADDED = ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
#: States of the automaton of marks: nothing of one read, its first character, its first two, a whole one (for good).
SEEN = (b"", b"<", b"<P")


def _mark_state(b: bytes) -> int:
    if any(m in b for m in MARKS):
        return 3
    return 2 if b[-2:] in (b"<P", b"<S", b"<M") else 1 if b[-1:] == b"<" else 0


def chunk_function(b: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of a chunk of at least one byte: the state it is left in and the words that end in it, for either state before (0 between words,
    1 inside one), and the state of the marks after it, for each of the four before."""
    space = _SPACE[np.frombuffer(b, np.uint8)]
    left = 1 - int(space[-1])
    ends = int(np.count_nonzero(space[1:] & ~space[:-1]))
    inside = _mark_state(b)
    marks = [inside if inside == 3 else _mark_state(seen + b[:2]) if len(b) < 3 or _mark_state(seen + b[:2]) == 3 else inside for seen in SEEN]
    return [left, left], [ends, ends + int(space[0])], [*marks, 3]


def compose(left: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions of consecutive chunks (a row each) -> functions of everything up to and with each chunk. Doubling steps: composition is
    associative, so row k takes what row k - d has composed in front of its own."""
    left, ends, marks, d = left.copy(), ends.copy(), marks.copy(), 1
    while d < len(left):
        l0, e0, m0 = left[:-d], ends[:-d], marks[:-d]
        ends[d:] = e0 + np.take_along_axis(ends[d:], l0, 1)
        left[d:], marks[d:] = np.take_along_axis(left[d:], l0, 1), np.take_along_axis(marks[d:], m0, 1)
        d *= 2
    return left, ends, marks


def nth_end(b: bytes, entered: int, nth: int) -> int:
    """Code points before the place in this chunk where its nth word (from 1) ends."""
    raw = np.frombuffer(b, np.uint8)
    space = _SPACE[raw]
    at = np.flatnonzero(space & ~np.concatenate([[not entered], space[:-1]]))[nth - 1]
    return int(np.count_nonzero((raw[:at] & 0xC0) != 0x80))


def _code_points(b: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) != 0x80))


def _units(h1: int, h2: int, n: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def _short(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    out = []
    for t, x, y in zip(texts, h1, h2):
        if not t:
            out.append((0, False, 0, 0))
            continue
        b = t.encode()
        _, ends, marks = chunk_function(b)
        n, total = ends[0] + 1, len(t)
        cuts = [0 if u == 0 else total if u == n else nth_end(b, 0, u) for u in _units(x, y, n)]
        out.append((n, marks[0] == 3, *cuts))
    return pd.DataFrame(out, columns=["n", "marked", "p", "m"])


CUTS = "n long, marked boolean, p long, m long"
FUNCTION = "left array<long>, ends array<long>, marks array<long>, points long"


def _slices(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = row["t"].encode()
                at = [[i, b[i * size : (i + 1) * size]] for i in range(-(-len(b) // size))]
                for k in range(0, len(at), 256):
                    some = at[k : k + 256]
                    yield pa.RecordBatch.from_pylist([{"id": row["id"], "key": row["key"], "h1": row["h1"], "h2": row["h2"], "no": i, "bytes": x} for i, x in some], SLICE)

    return run


SLICE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("no", pa.int64()), ("bytes", pa.binary())])


def _functions(b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*chunk_function(x), _code_points(x)) for x in b], columns=["left", "ends", "marks", "points"])


CUT = "id long, key long, n long, marked boolean, which int, before long, no long, entered int, nth long"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, from the functions of its chunks in order: its units and marks, and for each of its two cuts the code points
    before, and the chunk, entry state and rank of the end of a word that has still to be found there (no is -1 where the cut
    is an end of the text)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            chunks = row["chunks"]
            left, ends, marks = compose(*[np.array([c[k] for c in chunks], np.int64) for k in ("left", "ends", "marks")])
            points = np.concatenate([[0], np.cumsum([c["points"] for c in chunks])])
            upto, n = ends[:, 0], int(ends[-1, 0]) + 1
            head = (row["id"], row["key"], n, bool(marks[-1, 0] == 3))
            for which, u in enumerate(_units(row["h1"], row["h2"], n)):
                if u in (0, n):
                    out.append((*head, which, int(points[-1]) if u else 0, -1, 0, 0))
                else:
                    k = int(np.searchsorted(upto, u))
                    out.append((*head, which, int(points[k]), k, int(left[k - 1, 0]) if k else 0, u - (int(upto[k - 1]) if k else 0)))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in CUT.split(", ")])


def _found(b: pd.Series, entered: pd.Series, nth: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None else nth_end(x, int(e), int(k)) for x, e, k in zip(b, entered, nth)])


def _long_cuts(rows: DataFrame, size: int) -> DataFrame:
    """id, key and the cuts of every document in rows (id, key, t, h1, h2), by chunks dealt to all tasks."""
    at = ["id", "key", "no"]
    chunks = rows.mapInArrow(_slices(size), "id long, key long, h1 long, h2 long, no long, bytes binary").repartition(*at)
    parts = chunks.withColumn("f", F.pandas_udf(_functions, FUNCTION)("bytes")).select("id", "key", "h1", "h2", "no", "f.*", "bytes").checkpoint()
    # a set, as rows that repeat a document repeat its chunks; ordered by their number
    table = F.sort_array(F.collect_set(F.struct("no", "left", "ends", "marks", "points"))).alias("chunks")
    cuts = parts.groupBy("id", "key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), table).mapInArrow(_resolve, CUT)
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}")) for c in at]
    held = cuts.alias("c").join(parts.select(*at, "bytes").dropDuplicates(at).alias("p"), same, "left").select("c.*", "p.bytes")
    where = held.select("id", "key", "n", "marked", "which", (F.col("before") + F.pandas_udf(_found, "long")("bytes", "entered", "nth")).alias("at"))
    return where.groupBy("id", "key").agg(F.first("n").alias("n"), F.first("marked").alias("marked"), F.max(F.when(F.col("which") == 0, F.col("at"))).alias("p"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("m"))


def _draws(id_text: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """percent: of documents to be transformed; spm_percent: of those, in the order suffix, prefix, middle."""
    ensure_checkpoint_dir(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ADDED]
    t = F.coalesce(F.col(text_col), F.lit(""))
    draws = _draws(F.col(id_col).cast("string"), seed)
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).cast("long").alias("id"), t.alias("t"), *[d.alias(f"h{i + 1}") for i, d in enumerate(draws)])
    short, long = rows.where(F.octet_length("t") <= chunk), rows.where(F.octet_length("t") > chunk).withColumn("key", F.xxhash64("t"))
    short = short.withColumn("cuts", F.pandas_udf(_short, CUTS)("t", "h1", "h2")).select("row", "t", "h3", "h4", "cuts.*")
    cuts = _long_cuts(long.select("id", "key", "t", "h1", "h2"), chunk).alias("c")
    long = long.alias("l").join(cuts, F.col("l.id").eqNullSafe(F.col("c.id")) & (F.col("l.key") == F.col("c.key"))).select("row", "t", "h3", "h4", "n", "marked", "p", "m")
    return _put_together(short.unionByName(long), kept, percent, spm_percent)


def _put_together(cut: DataFrame, kept: list[str], percent: int, spm_percent: int) -> DataFrame:
    form = F.when((F.col("t") == "") | F.col("marked") | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    p, m = F.col("p").cast("int"), F.col("m").cast("int")
    prefix, middle, suffix = F.substring("t", F.lit(1), p), F.substring("t", p + 1, m - p), F.substring("t", m + 1, F.length("t"))
    psm, spm = F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle), F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle)
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", psm).otherwise(spm)
    cutting = F.col("form") != "plain"
    return cut.select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("n").alias("fim_n"), F.col("form").alias("fim_form"), F.when(cutting, F.col("p")).alias("fim_prefix_chars"), F.when(cutting, F.col("m") - F.col("p")).alias("fim_middle_chars"), output.alias("fim_output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form. Only texts without a mark are transformed, so the output splits at its three marks."""
    at = lambda i: F.get(F.split(output, "<[PSM]>", -1), i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    made = transform(docs.select(id_col, text_col), id_col, text_col)
    return made.select(
        id_col, F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )
