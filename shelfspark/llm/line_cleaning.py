"""Line-first cleaning: every line is judged on its own, lines that fail are removed, and a document that loses too much
text is rejected.

A line with a word fails if it is *navigation* (as many separators as a third of its words; or one of ``menu`` lines in turn, blank
ones apart, of at most three words without end punctuation), *unpunctuated* (over ``loose`` words and no end punctuation),
*symbols* (at least one of ``#*$%&|<>`` for three words), *shouting* (most letters upper case, or an exclamation mark for three
words, in a line of five words or more), *boilerplate* (a fixed phrase in a line of up to 30 words), or *repeats* (one word
makes up more than half of a line of ten words or more; or the line equals an earlier one). Short headings and lists with
punctuation are text. Documents are rejected when failing lines hold more than ``lost`` of their word characters, or by the
base rules.

Result of ``report``: see the columns; ``clean`` gives the remaining text. Null text has no words (n_words 0: base_failed);
one output row for each input row, repeated rows included; very long texts are read once, whole; an empty table gives an
empty result; ``report`` reads no column but id and text, and ``clean`` keeps all others, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, mix64, word_hashes, word_spans

SYMBOLS = "#*$%&|<>"
BOILERPLATE = re.compile(rb"(?i)\b(cookie policy|accept cookies|enable javascript|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log ?in|subscribe|lorem ipsum|powered by|share this|back to top)\b")
_IS = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
_SYMBOL, _UPPER, _LOWER, _BANG, _BAR, _FIRST = _IS(SYMBOLS), np.zeros(256, bool), np.zeros(256, bool), _IS("!"), _IS("|>"), np.ones(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
#: What a line of prose may end with.
ENDS = tuple(c.encode() for c in ".!?:;,\"')]…”’»。！？")
_FIRST[128:192] = False  # bytes that go on with a character


def judge(text: str | None, lost: float = 0.5, loose: int = 25, menu: int = 4) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the text of the lines left."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b, s, e = word_spans(data)
    n = len(s)
    lines = data.split(b"\n")
    if not n:
        return 0, 0, int(_SYMBOL[b].sum()) if len(b) else 0, 0, 0, True, False, ""
    solid = ~_SPACE[b]
    words = word_hashes(b, s, e)
    chars = int((_FIRST[b] & solid).sum())
    # windows of five words
    repeat = 0
    if n >= 5:
        five = words[: n - 4].copy()
        for i in range(1, 5):
            five = mix64(five) + words[i : n - 4 + i]
        _, inv, cnt = np.unique(five, return_inverse=True, return_counts=True)
        twice = (cnt[inv] > 1).astype(np.int64)
        edge = np.zeros(n + 1, np.int64)
        edge[: n - 4] += twice
        edge[5 : n + 1] -= twice
        repeat = int((np.cumsum(edge)[:n] > 0).sum())
    # per line
    row = np.cumsum(b == 10)
    of_line = lambda mask: np.bincount(row[mask], minlength=len(lines))
    line_of = row[s]
    n_in = np.bincount(line_of, minlength=len(lines))
    weight = of_line(_FIRST[b] & solid)
    symbols, bars, bangs, upper, lower = (of_line(m[b]) for m in (_SYMBOL, _BAR, _BANG, _UPPER, _LOWER))
    pair = np.unique(mix64(words + mix64(line_of.astype(np.uint64))), return_index=True, return_counts=True)
    most = np.zeros(len(lines), np.int64)
    np.maximum.at(most, line_of[pair[1]], pair[2])
    seen: set[bytes] = set()
    dup = np.zeros(len(lines), bool)
    phrase = np.zeros(len(lines), bool)
    end = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if n_in[i]:
            dup[i] = line in seen
            seen.add(line)
            phrase[i] = bool(BOILERPLATE.search(line)) and n_in[i] <= 30
            end[i] = line.rstrip().endswith(ENDS)
    fails = (3 * bars >= n_in) & (bars >= 2) | (3 * symbols >= n_in) & (symbols >= 2) | (n_in >= 5) & ((upper > lower) & (upper >= 10) | (3 * bangs >= n_in)) | phrase | dup
    fails |= (n_in >= 10) & (2 * most > n_in)
    fails |= ~end & (n_in > loose)
    full = np.flatnonzero(n_in)
    short = np.concatenate([[False], ~end[full] & (n_in[full] <= 3), [False]])
    edge = np.flatnonzero(short[1:] != short[:-1])
    for a, z in zip(edge[::2], edge[1::2]):
        if z - a >= menu:
            fails[full[a:z]] = True
    fails &= n_in > 0
    base_failed = n < 10 or 100 * repeat > 20 * n
    kept = not base_failed and float(weight[fails].sum()) <= lost * float(weight.sum())
    clean = b"\n".join(x for x, f in zip(lines, fails) if not f).decode("utf-8", "surrogatepass") if fails.any() else text or ""
    return n, chars, int(symbols.sum()), int(dup.sum()), repeat, base_failed, kept, clean


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lost: float = 0.5, loose: int = 25, menu: int = 4) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t.as_py(), lost, loose, menu)[:7] for t in batch.column(1)]
            cols = list(zip(*got)) if got else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(cols)]], [id_col, *names])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, {COLUMNS}")


def clean(docs: DataFrame, text_col: str = "text", lost: float = 0.5, loose: int = 25, menu: int = 4) -> DataFrame:
    """The kept rows of docs with their remaining lines as text."""

    @F.pandas_udf("kept boolean, clean string")
    def run(text):
        import pandas as pd

        return pd.DataFrame([judge(t, lost, loose, menu)[6:] for t in text], columns=["kept", "clean"])

    d = docs.select(F.struct(*docs.columns).alias("row"), run(F.coalesce(F.col(text_col), F.lit(""))).alias("made")).where("made.kept")
    return d.select(*[F.col("made.clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
