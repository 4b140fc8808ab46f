"""Secret scans: candidates from patterns, false positives removed by a random forest.

The forest (numpy, grown here) sees a candidate's length, its character classes and transitions, how much of it dictionary
pieces cover, its path (the source it came from) and the neighbouring words. It is trained from labelled findings; where no
table of findings is given, ``labelled_findings`` draws a fixed set from the published formats of keys and from the usual
false alarms (identifiers, digests in lock files, versions, words, card and phone numbers, addresses, placeholders).

``scan`` returns one row for each document: id, ``n_candidates``, ``n_secrets``, ``spans`` (start:end in code points, comma-joined),
``top_score``; it reads no column but id, text and path. ``redact`` puts ``<SECRET>`` in their place and keeps all columns,
whatever their names. Null text counts as empty; one output row for each input row, repeated rows included; texts and
candidates are seen whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How published formats of keys begin. After these a key is a candidate wherever it stands.
KNOWN = r"(?:AKIA|ASIA|gh[po]_|github_pat_|[sr]k_live_|AIza|glpat-|xox[abp]-|npm_|pypi-|eyJ|SG\.)"
#: A value after a name that speaks of secrets, a private key with its header lines, a key of a known beginning, or a run that mixes
#: letters and digits (or opens like a web token), with the runs that dots join to it. Repeats are possessive, so each is passed
#: over once.
CANDIDATE = re.compile(
    r"-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY(?: BLOCK)?-----(?:\s*+[A-Z0-9]++(?:-[A-Z0-9]++)*+:(?:[^\r\n-]|-(?!----))*+)*+[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]++ )*?PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<![A-Za-z0-9])(?:password|passwd|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*+[:=]\s*+[\"']?(?P<value>[^\s\"']{6,}+)"
    rf"|(?-i:{KNOWN})[A-Za-z0-9_-]{{16,}}+(?:\.[A-Za-z0-9_-]++)*+"
    r"|(?<![A-Za-z0-9_+/@.-])(?:(?=eyJ)|(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z]))[A-Za-z0-9_+/-]{16,}+(?:\.{1,2}[A-Za-z0-9_+/-]++)*+={0,2}(?![A-Za-z0-9@])",
    re.I,
)
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "key", "auth", "private")
CALM = ("sha", "commit", "version", "uuid", "id", "checksum", "integrity", "example", "page", "order", "isbn", "digest", "build")
PIECES = ("the", "ing", "tion", "ent", "and", "er", "on", "an", "re", "es", "or", "in", "at", "en", "st", "th", "ha", "le", "de", "ou", "user", "name", "test", "example", "file", "path", "data", "value", "change", "your", "here", "class", "index", "config")
_PREFIX = re.compile(rf"^({KNOWN}|sk-|-----BEGIN)")


_KIND = np.full(256, 3)  # 0 upper case, 1 lower case, 2 digit, 3 anything else
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2


def features(value: str, path: str, before: str, after: str) -> list[float]:
    raw, n = np.frombuffer(value.encode("latin-1", "replace"), np.uint8), len(value)
    kinds, low = _KIND[raw], value.lower()
    share = np.bincount(kinds, minlength=4) / n
    covered = np.zeros(n + 1, np.int64)
    for p in PIECES:
        for m in re.finditer(f"(?={p})", low):
            covered[m.start()] += 1
            covered[m.start() + len(p)] -= 1
    counts = np.bincount(raw) / n
    counts = counts[counts > 0]
    words, near = re.findall(r"[a-z_-]+", before.lower())[-4:], re.findall(r"[a-z]+", after.lower())[:2]
    return [
        float(n), *map(float, share), float((kinds[1:] != kinds[:-1]).sum()) / n, float((np.cumsum(covered)[:n] > 0).mean()), float(-(counts * np.log2(counts)).sum()), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(bool(_PREFIX.match(value))), float(any(x in NAMES for x in words)), float(any(x in CALM for x in words)), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(re.search(r"test|example|doc|lock|sample", path.lower()))), float(bool(re.search(r"(?i)example|placeholder|changeme|xxxx|your|<|\*\*|dummy", value))), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))), float(len(near)), float(value.count("-") + value.count("/") + value.count("_")) / n,
    ]


_HEX, _DIGITS, _UP, _LOW = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ANY = _UP + _LOW + _DIGITS
#: Published formats of keys: lead, prefix, alphabet, lengths, suffix.
FORMATS = {
    "aws": ("", ("AKIA", "ASIA"), _UP + _DIGITS, (16,), ""), "aws secret": ("secret_key=", ("",), _ANY + "+/", (40,), ""), "github": ("", ("ghp_", "gho_", "github_pat_"), _ANY, (36, 82), ""), "stripe": ("", ("sk_live_", "rk_live_"), _ANY, (24, 99), ""),
    "google": ("", ("AIza",), _ANY + "_-", (35,), ""), "gitlab": ("", ("glpat-",), _ANY + "_-", (20,), ""), "slack": ("", ("xoxb-", "xoxp-"), _DIGITS + _LOW, (48, 60), ""), "npm": ("", ("npm_",), _ANY, (36,), ""),
    "sendgrid": ("", ("SG.",), _ANY + "_-", (66,), ""), "pypi": ("", ("pypi-AgEI",), _ANY + "_-", (120, 160), ""), "web token": ("", ("eyJhbGciOi",), _ANY + "_-", (80, 160), ""), "bearer": ("auth: ", ("",), _ANY + "_-", (40, 64), ""),
    "password hex": ("password=", ("",), _HEX, (16, 18, 20, 24, 32), ""), "password": ("pwd: ", ("",), _ANY + "!@#$%^&*", (10, 12, 16, 20), ""), "token hex": ('token = "', ("",), _HEX, (32, 40, 64), ""), "api key": ("api_key: ", ("",), _ANY, (20, 32, 40), ""),
    "account key": ("secret=", ("",), _ANY + "+/", (86,), "=="), "private key": ("", ("-----BEGIN PRIVATE KEY-----\n",), _ANY + "+/", (128, 1600), "\n-----END PRIVATE KEY-----"),
}
PATHS = ("src1", "src12", "web", "repo/app/settings.py", "config/prod.yml", "docs/readme.md", "deploy/values.yaml", "tests/test_login.py", ".env", "forum", "package-lock.json")


def labelled_findings(n: int = 4000, seed: int = 7, without: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, int]]:
    """(value, path, before, after, label); without: names of formats that are left out."""
    r = random.Random(seed)
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(PIECES[:20]) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    formats = [f for name, f in FORMATS.items() if name not in without]
    no = [
        lambda: (draw(_HEX, r.choice([32, 40])), r.choice(["commit ", "sha1 ", "digest ", "etag: "])), lambda: ("-".join(draw(_HEX, k) for k in (8, 4, 4, 4, 12)), r.choice(["id ", "uuid=", ""])), lambda: (r.choice(["your_token_here_1", "changeme123456", "xxxxxxxxxxxx1234", "<password1>", "example_key_123"]), r.choice(["password=", "token = "])),
        lambda: (f"{word()}_{word()}_{word()}{r.randint(1, 99)}"[:60], ""), lambda: (f"{word()}/{word()}/{word()}-{r.randint(1, 99)}", ""), lambda: (f"{word()}-{word()}-20{r.randint(10, 29)}-0{r.randint(1, 9)}", ""), lambda: (draw(_DIGITS, 16) + "a", "order "), lambda: (word() + word() + str(r.randint(1, 9)), ""), lambda: (draw(_HEX, 64), r.choice(["integrity ", "checksum: "])),
        lambda: (word(), r.choice(["password: ", "token=", "secret = "])), lambda: (f"os.environ[{word()}]", "password="), lambda: ("sha512-" + draw(_ANY + "+/", 86) + "==", "integrity "),
    ]
    out = []
    for i in range(n):
        if i % 2:
            lead, prefix, chars, sizes, end = formats[(i // 2) % len(formats)]
            value = r.choice(prefix) + draw(chars, r.choice(sizes)) + end
        else:
            value, lead = no[(i // 2) % len(no)]()
        out.append((value, r.choice(PATHS), f"{prose(3)} {lead}", f" {prose(3)}", i % 2))
    return out


class Forest:
    """Random forest of depth-bounded trees in arrays: feature, threshold, children, and the share of positives."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, least: int = 5, seed: int = 11) -> Forest:
        rng, out = np.random.default_rng(seed), []
        for _ in range(trees):
            f, t, kids, p = [], [], [], []

            def grow(rows: np.ndarray, level: int) -> int:
                me = len(f)
                f.append(-1)
                t.append(0.0)
                kids.append((0, 0))
                p.append(float(y[rows].mean()))
                if level == depth or len(rows) < 2 * least or p[me] in (0.0, 1.0):
                    return me
                best = (1e9, -1, 0.0)
                for j in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
                    order = rows[np.argsort(x[rows, j], kind="stable")]
                    v, ones = x[order, j], np.cumsum(y[order])
                    n = np.arange(1, len(order))
                    a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                    gini = n * a * (1 - a) + (len(order) - n) * b * (1 - b)
                    gini[(v[1:] == v[:-1]) | (n < least) | (len(order) - n < least)] = 1e9
                    i = int(np.argmin(gini))
                    if gini[i] < best[0]:
                        best = (gini[i], j, (v[i] + v[i + 1]) / 2)
                if best[1] >= 0:
                    f[me], t[me] = int(best[1]), best[2]
                    left = x[rows, best[1]] <= best[2]
                    kids[me] = (grow(rows[left], level + 1), grow(rows[~left], level + 1))
                return me

            grow(rng.integers(0, len(x), len(x)), 0)
            out.append((np.array(f), np.array(t), np.array(kids), np.array(p)))
        return cls(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, kids, p in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = np.where(x[np.arange(len(x)), f[at]] <= t[at], kids[at, 0], kids[at, 1])
                at = np.where(inner, go, at)
            total += p[at]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, int]] | None = None, **options) -> Forest:
    """findings: labelled ones; ``DataFrame.collect()`` of at most some ten thousand rows serves."""
    rows = findings or labelled_findings()
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]), **options)


_GATE = re.compile(rf"[0-9]|-----BEGIN|passw|pwd|secret|token|api[_-]?key|access[_-]?key|auth|{KNOWN}", re.I)


def find(texts: list[str | None], paths: list[str | None], forest: Forest, threshold: float = 0.5) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates as (start, end, score)."""
    out, rows, where = [[] for _ in texts], [], []
    for i, text in enumerate(texts):
        if text and _GATE.search(text):
            for m in CANDIDATE.finditer(text):
                a, b = m.span("value") if m["value"] else m.span()
                rows.append(features(text[a:b], paths[i] or "", text[max(0, a - 40) : a], text[b : b + 30]))
                where.append((i, a, b))
    if rows:
        for (i, a, b), p in zip(where, forest.predict(np.array(rows))):
            out[i].append((a, b, float(p)))
    return out


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shared.value, threshold)
            hits = [[c for c in g if c[2] >= threshold] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b, _ in h) for h in hits], pa.string()), pa.array([max((c[2] for c in g), default=0.0) for g in got], pa.float64())],
                [id_col, "n_candidates", "n_secrets", "spans", "top_score"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col, F.col(path_col).cast("string")).mapInArrow(run, f"{id_col} long, n_candidates long, n_secrets long, spans string, top_score double")


def redact(docs: DataFrame, forest: Forest | None = None, text_col: str = "text", path_col: str = "source", threshold: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """docs with the secrets in its text replaced; other texts, nulls included, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())

    @F.pandas_udf("string")
    def run(text, path):
        import pandas as pd

        out = text.tolist()
        for i, hits in enumerate(find(out, path.tolist(), shared.value, threshold)):
            for a, b, p in reversed(hits):
                if p >= threshold:
                    out[i] = out[i][:a] + mark + out[i][b:]
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col), F.col(path_col).cast("string")))
