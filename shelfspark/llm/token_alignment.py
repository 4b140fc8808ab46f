"""Alignment of two tokenizers: which tokens of a byte-level BPE (A) and of a SentencePiece BPE (B) cover the same bytes of a text.

Both encode the text with one space in front. Ends of tokens are running sums of their byte lengths; ends that both share (an
intersection of sorted arrays) cut the tokens into groups, whose labels come from a binary search; tokens of A and B that end
together are linked by repeating each A token for every B token of its end. A text is encoded once: what its links need later is
written, compressed, to the shared checkpoint folder.

No token of A or B crosses a single space between two characters that are not white space: A's pattern lets a space only begin a
token, and no piece of B holds a space after another character (checked on loading). So a text is the sequence of its words, cut there, and
groups and links stay within a word. A worker remembers those of the words it met and encodes and aligns only others, many at once. A
text with a word that the tokens do not spell is judged as a whole.

Counts of id pairs over all documents: of two tokens that end together, one's bytes are the end of the other's, so the pairs that
can occur are known from the vocabularies alone, fewer than the bytes of all their tokens (``possible_pairs``), whatever
the data. Each task sums its counts by pair and emits a row for each that it saw, with a salt; a first shuffle sums by pair and
salt, a second one by pair. The table of counts is thus bounded by the vocabularies, and goes to all tasks as one dense array.

``align(docs, a, b)`` returns id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (text, as digested below) and ``pairs`` (packed);
``pair_counts(aligned, a, b)`` the counts; ``digests(docs, a, b)`` one row for each input row: ``n_best`` (links whose count is the highest
of their B id, ties included), ``count_sum`` (sum of the counts of its links), and ``groups_sha256``.

Defined cases: texts that are null, empty, or whose tokens do not spell the text (with its space) have no tokens: zeros, and '' for
the digest; ids may be null or repeated, one output row for each input row, each counted; texts are whole, however long; an
empty table gives an empty result; only id and text are read, whatever else there is.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Salts of the first sum.
SALTS = 16
#: Words kept in a worker's memory, twice at most, some 350 bytes each; characters of texts whose unknown words are aligned at once.
CACHE, AT_ONCE = 100_000, 1 << 20
#: Where no token of A or B crosses: no white space stands before or behind.
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A tokenizer file of byte-level BPE: bytes of each id, and ids of a text whose special strings are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, special, chars = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}, _byte_chars()
        self.raw = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.raw[i] = token.encode() if token in special else bytes(chars[c] for c in token)
        # merges in the order of the ids that they make: then an id is the rank of its bytes, which the faster library goes by
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
        if made != sorted(made) or data["normalizer"] or not data["pre_tokenizer"]["use_regex"]:
            raise ValueError("only byte-level BPE whose ids follow its merges")
        ranks = {self.raw[i]: i for t, i in vocab.items() if t not in special}
        self._encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)


class Pieces:
    """A SentencePiece model: bytes of each id (a space for its mark), and ids of a text, to which the model adds the space."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces):
            raise ValueError("only models no piece of which holds a space behind another character")
        self.raw = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else b"" if self._model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, text: str) -> list[int]:
        return self._model.encode(text)


#: Groups as text, links as places of pairs (32 bits each), number of A and of B tokens.
Word = tuple[bytes, bytes, int, int]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes a * len(b) + b of the pairs of which one's bytes end the other's; tokens of no bytes go with all that can end where
    they do, which no token of these vocabularies needs: they are left out, as no text contains them."""
    by_a, by_b, out = {}, {}, set()
    for by, raw in ((by_a, a), (by_b, b)):
        for i, x in enumerate(raw):
            if x:
                by.setdefault(x, []).append(i)
    for x, ids in by_a.items():
        for k in range(len(x)):
            out.update(i * len(b) + j for j in by_b.get(x[k:], ()) for i in ids)
    for x, ids in by_b.items():
        for k in range(1, len(x)):
            out.update(i * len(b) + j for i in by_a.get(x[k:], ()) for j in ids)
    return np.array(sorted(out), np.int64)


class Both:
    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.raw], np.int64) for t in (self.a, self.b))
        self.codes = possible_pairs(self.a.raw, self.b.raw)
        self._words: dict[str, Word | None] = {}
        self._older: dict[str, Word | None] = {}

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and by B, if both spell the text."""
        if not text:
            return None
        want, ids_a, ids_b = f" {text}".encode(), self.a.ids(f" {text}"), self.b.ids(text)
        if b"".join(map(self.a.raw.__getitem__, ids_a)) != want or b"".join(map(self.b.raw.__getitem__, ids_b)) != want:
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def _align(self, words: list[str]) -> list[Word | None]:
        """Of words, which make up one text with a space between each two: their groups, links (places in ``codes``), and numbers of tokens;
        None for those that the tokens do not spell."""
        got = self.tokens(" ".join(words))
        if got is None:
            half = len(words) // 2
            return self._align(words[:half]) + self._align(words[half:]) if half else [None]
        ids_a, ids_b = got
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts, group_a, group_b = grouped(end_a, end_b)
        i, j = links(end_a, end_b, cuts)
        pairs = np.searchsorted(self.codes, ids_a[i] * len(self.b.raw) + ids_b[j]).astype("<u4").tobytes()
        groups = render(ids_a, ids_b, group_a, group_b)
        stop = np.cumsum([len(w.encode()) + 1 for w in words])
        upto = lambda ends: [0, *np.searchsorted(ends, stop, "right").tolist()]
        of_a, of_b, of_links, marks = upto(end_a), upto(end_b), upto(end_a[i]), np.flatnonzero(np.frombuffer(groups, np.uint8) == _SEMI)
        at = [-1, *np.append(marks, len(groups))[np.searchsorted(cuts, stop, "right") - 1].tolist()]
        return [(groups[at[k] + 1 : at[k + 1]], pairs[4 * of_links[k] : 4 * of_links[k + 1]], of_a[k + 1] - of_a[k], of_b[k + 1] - of_b[k]) for k in range(len(words))]

    def words(self, words: set[str]) -> dict[str, Word | None]:
        """Each word aligned, those not remembered at once; only words with white space at an end, which a text begins or ends with, alone."""
        out, new = {}, []
        for w in words:
            known = self._words.get(w, 0) or self._older.get(w, 0)
            if known == 0:
                new.append(w)
            else:
                out[w] = known
        joined = [w for w in new if not (w[0].isspace() or w[-1].isspace())]
        out.update(zip(joined, self._align(joined) if joined else ()))
        out.update((w, self._align([w])[0]) for w in new if w[0].isspace() or w[-1].isspace())
        for w, x in out.items():
            if len(w) < 64:
                if len(self._words) >= CACHE:
                    self._words, self._older = {}, self._words
                self._words[w] = x
        return out

    def texts(self, texts: list[str | None]) -> list[Word | None]:
        """Groups, links and numbers of tokens of each text, if both spell it."""
        cut = [BETWEEN_WORDS.split(t) if t else [] for t in texts]
        known, out = self.words({w for c in cut for w in c}), []
        for text, c in zip(texts, cut):
            of = [known[w] for w in c]
            if None in of or not of:
                out.append(self._align([text])[0] if text else None)
            else:
                groups, pairs, n_a, n_b = zip(*of)
                out.append((b";".join(groups), b"".join(pairs), sum(n_a), sum(n_b)))
        return out


@functools.cache
def load(a: str, b: str) -> Both:
    """One for each worker. The files must be on every machine, as the tokenizers' package is."""
    return Both(a, b)


def grouped(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common ends, and the group of every token of A and of B."""
    cuts = np.intersect1d(end_a, end_b)
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)


def expand(at_a: np.ndarray, at_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs whose labels, sorted and below n, are the same."""
    of_a, of_b = np.bincount(at_a, minlength=n), np.bincount(at_b, minlength=n)
    each = of_b[at_a]  # every A token stands once for each B token of its label
    i = np.repeat(np.arange(len(at_a)), each)
    first = (np.cumsum(of_b) - of_b)[at_a]
    j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    return i, j


def links(end_a: np.ndarray, end_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B that end together."""
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = lambda end: np.minimum(np.searchsorted(cuts, end), len(cuts) - 1)
    on_a, on_b = (np.flatnonzero(cuts[label(end)] == end) for end in (end_a, end_b))
    i, j = expand(label(end_a[on_a]), label(end_b[on_b]), len(cuts))
    return on_a[i], on_b[j]


_COMMA, _BAR, _SEMI = map(ord, ",|;")


def render(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimals written into one buffer, a column of digits at a time."""
    n = len(ids_a) + len(ids_b)
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)  # behind the B tokens of earlier groups
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark[place_a] = np.where(np.append(group_a[1:] != group_a[:-1], True), _BAR, _COMMA)
    mark[place_b] = np.where(np.append(group_b[1:] != group_b[:-1], True), _SEMI, _COMMA)
    width = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    stop = np.cumsum(width + 1) - 1
    out = np.empty(int(stop[-1]) + 1, np.uint8)
    out[stop] = mark
    for k in range(int(width.max())):
        has = width > k
        out[stop[has] - 1 - k] = ids[has] // 10**k % 10 + 48
    return out[:-1].tobytes()


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 as differences, and their counts."""
    return zlib.compress(np.concatenate([np.diff(values.astype(np.int64), prepend=0), counts]).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts of AT_ONCE characters together, or one longer."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def _aligner(a: str, b: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a, b)
        for batch in batches:
            out = []
            for texts in _slices(batch.column(1).to_pylist()):
                for got in both.texts(texts):
                    if got is None:
                        out.append((0, 0, 0, 0, "", _packed(np.zeros(0, np.int64), np.zeros(0, np.int64))))
                        continue
                    groups, pairs, n_a, n_b = got
                    at = np.unique(np.frombuffer(pairs, "<u4"), return_counts=True)
                    out.append((n_a, n_b, groups.count(b"|"), len(pairs) // 4, groups.decode() if whole else hashlib.sha256(groups).hexdigest(), _packed(*at)))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return run


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """a, b: paths of the tokenizers' files. digest: groups as their sha256."""
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_aligner(a, b, not digest), ALIGNED)
    return out.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, a: str, b: str, salts: int = SALTS) -> DataFrame:
    """a_id, b_id, n: links of all documents that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a, b)
        total, rows = np.zeros(len(both.codes), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for data in batch.column(0):
                at, n = _unpacked(data.as_py())
                total[at] += n
        at = np.flatnonzero(total)
        salt = np.full(len(at), (int(total.sum()) * 31 + rows) % salts, np.int32)
        a_id, b_id = np.divmod(both.codes[at], len(both.b.raw))
        yield pa.RecordBatch.from_arrays([pa.array(a_id.astype(np.int32)), pa.array(b_id.astype(np.int32)), pa.array(salt), pa.array(total[at])], ["a_id", "b_id", "salt", "n"])

    seen = aligned.select("pairs").mapInArrow(run, "a_id int, b_id int, salt int, n long")
    return seen.groupBy("a_id", "b_id", "salt").agg(F.sum("n").alias("n")).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def digests(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    aligned = align(docs, a, b, id_col, text_col, digest=True).checkpoint()
    both = load(a, b)
    table = pair_counts(aligned, a, b).toArrow()  # a row for each pair seen, of the pairs that the vocabularies make possible
    a_id, b_id, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a_id", "b_id", "n"))
    counts, most = np.zeros(len(both.codes), np.int64), np.zeros(len(both.b.raw), np.int64)
    counts[np.searchsorted(both.codes, a_id * len(both.b.raw) + b_id)] = n
    np.maximum.at(most, b_id, n)
    best = (counts > 0) & (counts == most[both.codes % len(both.b.raw)])
    known = spark.sparkContext.broadcast((counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            of = [_unpacked(x.as_py()) for x in batch.column("pairs")]
            sums = [int((counts[at] * n).sum()) for at, n in of]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([int(n[best[at]].sum()) for at, n in of], pa.int64()), pa.array(sums, pa.int64()), batch.column("groups")], NAMES)

    NAMES = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in NAMES))
