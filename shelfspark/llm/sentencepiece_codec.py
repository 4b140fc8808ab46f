"""SentencePiece (BPE) encoding with offsets, and decoding.

The model file is read here: pieces, scores, and the compiled character map (a double-array trie over byte prefixes with a
pool of replacements). Normalisation walks the text by the longest prefix in that map and notes, for every normalised
character, the source byte it came from; white space becomes U+2581 with one put in front. Each run of U+2581 with the word
after it is merged on its own, which is exact as long as no piece holds U+2581 after another character (checked on
loading). Merges take the best score, leftmost on ties; characters outside the vocabulary become byte pieces.

``encode(df, model)`` adds ``ids array<int>``, ``begins``/``ends array<int>`` (byte spans in the source) and ``decoded``.
``digests(df, model)`` has digests of the same arrays: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``spans_sha256`` over
begin and end of every id in turn, as little-endian unsigned 32-bit integers.
Defined cases: null text as empty; an empty text has the begin and end ids only, whose spans are empty; one output row per
input row, repeated rows included; very long texts are encoded whole; an empty table gives an empty result; further columns
are left out of the digests and kept by ``encode``, but for those named like the four it adds.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words kept in a worker's memory, twice at most: with the bytes of their ids some 200 bytes each.
CACHE = 200_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: longest byte prefix -> replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, b: bytes, at: int) -> tuple[bytes, int] | None:
        if not self.units:
            return None
        best, node = None, self._offset(self.units[0])
        for i in range(at, len(b)):
            node ^= b[i]
            unit = self.units[node]
            if unit & 0x800000FF != b[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = self.pool[start : self.pool.index(b"\0", start)], i + 1 - at
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, self.trim, self.escape, blob, self.bos, self.eos, self.unk, surface = True, True, True, b"", 1, 2, 0, " ⁇ "
        for k, v in _fields(data):
            if k == 1:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p.get(2, b"\0" * 4))[0])
                self.kinds.append(p.get(3, 1))
            elif k == 2:
                t = dict(_fields(v))
                self.unk, self.bos, self.eos = t.get(40, 0), t.get(41, 1), t.get(42, 2)
                surface = t.get(44, surface.encode()).decode() if 44 in t else surface
                if t.get(3, 1) != 2 or t.get(24, 0):
                    raise ValueError("only BPE models that mark white space in front of words")
            elif k == 3:
                n = dict(_fields(v))
                blob, self.dummy_prefix, self.trim, self.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        self.charmap, self.surface = CharMap(blob), surface
        self.rank = {p: (s, i) for i, (p, s, kind) in enumerate(zip(self.pieces, self.scores, self.kinds)) if kind == 1}
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE, " ").encode() for p, kind in zip(self.pieces, self.kinds)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        if any(kind in (4, 5) for kind in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        by_score = {x: i for i, x in enumerate(sorted({r[0] for r in self.rank.values()}, reverse=True))}
        self.order = {p: by_score[r[0]] for p, r in self.rank.items()}
        # bytes of the source that a piece covers where the map changes nothing and a mark stands for one blank
        self.covers = np.array([1 if kind == 6 else len(raw) if kind == 1 else 0 for raw, kind in zip(self.raw, self.kinds)], np.int64)
        self.is_byte = np.array([kind == 6 for kind in self.kinds])
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: What each id spells, for a model whose pieces and bytes spell everything.
        self.spelled = [b"" if kind == 3 else raw for raw, kind in zip(self.raw, self.kinds)] if len(self.byte) == 256 and not self.trim else None
        self.marked = np.array([1 if kind == 6 else len(p.encode()) if kind == 1 else 0 for p, kind in zip(self.pieces, self.kinds)], np.int64)

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and the source byte of each of its characters with the end (None: as the text itself)."""
        if not self.charmap.units and not self.trim:
            return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE), None
        b, i, out, at = text.encode(), 0, [], []
        while i < len(b):
            hit = self.charmap.longest(b, i)
            if hit:
                piece, n = hit[0].decode(), hit[1]
            else:
                n = 1 if b[i] < 128 else 2 if b[i] < 224 else 3 if b[i] < 240 else 4
                piece = b[i : i + n].decode()
            for c in piece:
                out.append(c)
                at.append(i)
            i += n
        if self.trim:
            keep = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            end = at[keep[-1] + 1] if keep and keep[-1] + 1 < len(at) else len(b)
            out, at = [out[k] for k in keep], [at[k] for k in keep]
        else:
            end = len(b)
        if self.dummy_prefix and out:
            out.insert(0, " ")
            at.insert(0, at[0])
        return "".join(out).replace(" ", SPACE), [*at, end]

    def _merge(self, word: str) -> list[str]:
        if len(word) <= 48:
            return self._merge_short(list(word))
        n = len(word)
        parts: list[str | None] = list(word)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self.rank.get(parts[i] + parts[j])):
                heapq.heappush(heap, (-r[0], i, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or len(parts[i]) + len(parts[after[i]]) != size:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        get, none = self.order.get, len(self.order)
        pairs = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def split(self, normal: str) -> list[str]:
        return [normal] if self.whole else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)

    def _ids(self, piece: str) -> list[int]:
        if r := self.rank.get(piece):
            return [r[1]]
        return [self.byte[x] for x in piece.encode()] if self.byte else [self.unk]

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        got = self._words.get(word)
        if got is None:
            got = self._older.get(word)
            if got is None:
                ids = [i for p in self._merge(word) for i in self._ids(p)]
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) < 64:
                if len(self._words) >= CACHE:
                    self._words, self._older = {}, self._words
                self._words[word] = got
        return got

    def _packed_spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """begin and end of every id where the map changes nothing: running sums of what the pieces cover; byte pieces get the whole
        character that their byte belongs to."""
        data = np.frombuffer(text.encode(), np.uint8)
        size = self.covers[ids]
        end = np.cumsum(size) - bool(self.dummy_prefix and text)
        begin = np.maximum(end - size, 0)
        if (byte := self.is_byte[ids]).any():
            first = np.flatnonzero((data & 0xC0) != 0x80)
            char = np.searchsorted(first, begin[byte], "right") - 1
            begin[byte], end[byte] = first[char], np.append(first[1:], len(data))[char]
        begin[-1] = end[-1] = len(data)
        begin[0] = end[0] = 0
        return np.column_stack([begin, end])

    def encode_packed(self, text: str) -> tuple[bytes, str, bytes]:
        """All ids as little-endian 32-bit integers, the text that they decode to, and begin and end of every id's bytes in the
        source. Where the map changes nothing, spans follow from the ids; else they are carried along from the map."""
        normal, at = self.normalise(text)
        known, words = self._words, self.split(normal)
        ids = b"".join([struct.pack("<I", self.bos), *[known.get(w) or self.word(w) for w in words], struct.pack("<I", self.eos)])
        packed = np.frombuffer(ids, "<u4")
        if at is not None or not self.byte:
            spans = np.column_stack(self.spans(text)[1:])
        else:
            spans = self._marked_spans(text, normal, packed) if SPACE in text else self._packed_spans(text, packed)
        return ids, self._decoded(packed.tolist()), spans.astype("<u4").tobytes()

    def _marked_spans(self, text: str, normal: str, ids: np.ndarray) -> np.ndarray:
        """The same for a text that holds the mark itself, which is longer than a blank: by places in the normalised text."""
        data = np.frombuffer(normal.encode(), np.uint8)
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        source = np.concatenate([[0] * (1 + bool(self.dummy_prefix)), np.cumsum([len(c.encode()) for c in text])])
        end = np.cumsum(self.marked[ids])
        char = np.searchsorted(first, end - self.marked[ids], "right") - 1
        begin, end = source[char], source[np.where(self.is_byte[ids], char + 1, np.searchsorted(first, end))]
        begin[-1] = end[-1] = source[-1]
        return np.column_stack([begin, end])

    def _decoded(self, ids: list[int]) -> str:
        """decode(ids), at once where what the ids spell is well-formed."""
        if self.spelled:
            try:
                whole = b"".join(map(self.spelled.__getitem__, ids)).decode()
                return whole[1:] if self.dummy_prefix and whole.startswith(" ") else whole
            except UnicodeDecodeError:
                pass
        return self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids with the source bytes of each; begin and end ids have empty spans; byte pieces share their character's span."""
        normal, at = self.normalise(text)
        if at is None:
            source = [len(c.encode()) for c in text]
            at = ([0] if self.dummy_prefix and text else []) + np.concatenate([[0], np.cumsum(source)]).astype(int).tolist()
        ids, lo, hi, i = [self.bos], [0], [0], 0
        for w in self.split(normal):
            for p in self._merge(w):
                for x in self._ids(p):
                    ids.append(x)
                    lo.append(at[i])
                    hi.append(at[i + len(p)])
                i += len(p)
        end = len(text.encode())
        return [*ids, self.eos], [*lo, end], [*hi, end]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """first: whether the text starts here, so that the mark put in front of it is taken off."""
        if not first and not any(self.kinds[i] in (2, 3) for i in ids):
            try:
                return b"".join([self.raw[i] for i in ids]).decode()
            except UnicodeDecodeError:
                pass
        out, raw = [], bytearray()

        def flush() -> None:
            if raw:
                out.append(_replace(bytes(raw)))
                raw.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == 6:
                raw.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            flush()
            if kind == 3:
                continue
            piece = self.surface if kind == 2 else self.pieces[i]
            if first and kind == 1 and (self.dummy_prefix or self.trim):
                piece = piece[1:] if piece.startswith(SPACE) and not self.trim else piece.lstrip(SPACE) if self.trim else piece
            first = False
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def _replace(raw: bytes) -> str:
    """Well-formed characters as they are, every other byte as one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 128 else 2 if 194 <= raw[i] < 224 else 3 if 224 <= raw[i] < 240 else 4 if 240 <= raw[i] < 245 else 0
        try:
            out.append(raw[i : i + n].decode() if n else "�")
            i += n or 1
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    """One model for each path and worker. The path must exist on every machine, as the tokenizers' package does."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


def encode(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """df with ids, begins, ends and decoded; columns of these names in df are replaced."""

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>, decoded string")
    def run(text):
        import pandas as pd

        m, out = load(model), []
        for t in text:
            ids, lo, hi = m.spans(t or "")
            out.append((ids, lo, hi, m.decode(ids)))
        return pd.DataFrame(out, columns=["ids", "begins", "ends", "decoded"])

    return df.withColumn("ids", run(F.coalesce(text_col, F.lit("")))).withColumns({c: F.col("ids")[c] for c in ("begins", "ends", "decoded")}).withColumn("ids", F.col("ids.ids"))


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids, decoded, spans = m.encode_packed(text.as_py() or "")
                out.append((len(ids) // 4, *[hashlib.sha256(x).hexdigest() for x in (ids, decoded.encode(), spans)]))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], [id_col, *names])

    return df.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
