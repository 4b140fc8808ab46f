"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are found by regular expressions for each kind, strict and loose. Four labelers vote on every candidate (1 for,
-1 against, 0 silent): its format (regex), a gazetteer of issuer prefixes, top-level domains and address blocks, cue words
just before it, and its neighbouring characters. Votes are counted by pattern over the whole table, at most 81 patterns a
kind, so expectation-maximisation (which estimates how reliable each labeler is, and each pattern's probability) works on a
table of bounded size. A logistic span classifier on votes and length is trained on those probabilities and scores every
candidate as a column expression. Candidates of the base patterns that pass their checks always stay; others join where the
classifier gives at least ``threshold`` and they overlap no kept span.

Offsets are code points, the end exclusive; null text counts as empty; one output row for each input row, whatever its id;
very long texts are scanned whole by patterns that do not backtrack over groups, in time linear in their matches; an empty table gives an empty result;
``report`` reads no column but id and text, and ``find`` keeps all but those of its own names, which begin with ``pii_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns; possessive, with the start of a run looked for once, so that they take linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, of which the classifier decides.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE_GATE = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"}
GAZETTEER = {
    "email": r"(?i)(\.|dot[\])] ?)(com|org|net|edu|gov|io|info|eu|uk|de|fr|es|it|nl|ch|at|ca|us|au|jp)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|2[345][0-9]\.)[0-9A-Fa-f]",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(\+?1[ (.-]|\(?[2-9][0-9]{2}\)?[ .-]|\+(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]))",
}
CUES = {
    "email": r"(?i)(e-?mail|contact|write|reach|address|courriel|correo)\W+(\w+\W+){0,2}$",
    "ip": r"(?i)(\bip|host|server|address|from|client|login)\W+(\w+\W+){0,2}$",
    "card": r"(?i)(card|visa|master|credit|debit|payment|carte|tarjeta)\W+(\w+\W+){0,2}$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|cell|dial|t[eé]l[eé]phone|tel[eé]fono)\W+(\w+\W+){0,2}$",
}
AGAINST = r"(?i)(version|order|isbn|issn|invoice|chapter|section|build|release|sku|part no|article)\W+(\w+\W+){0,1}$"
LABELERS = 4


#: Characters in front of a candidate that its labelers see.
BEFORE = 40
#: A shorter match of these kinds can't pass, whatever it holds, and is no candidate.
LEAST = {"card": 14, "phone": 11}


FOUND = "array<struct<start:int,m:string,before:string,after:string>>"
#: Elements of an array that are scanned together.
RUN = 256


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state before, item) of every item, in order, the state carried along by step. Items go in runs, and the states before the
    runs are found first, so that no array grows by one element at a time over the whole length: the time is linear."""

    def one_run(states: Column):
        def go(run: Column, k: Column) -> Column:
            first = F.struct(F.get(states, k).alias("s"), F.array().cast(kind).alias("out"))
            return F.aggregate(run, first, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], emit(a["s"], x)).alias("out")), lambda a: a["out"])

        return go

    def runs(all_of: Column) -> Column:
        at = F.when(F.size(all_of) > 0, F.sequence(F.lit(0), F.size(all_of) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(all_of, i + 1, RUN))

    def from_runs(all_of: Column) -> Column:
        first = F.struct(zero.alias("s"), F.filter(F.array(zero), lambda z: F.lit(False)).alias("out"))
        states = F.aggregate(all_of, first, lambda a, run: F.struct(F.aggregate(run, a["s"], step).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])
        return _bound(states, lambda s: F.flatten(F.transform(all_of, one_run(s))))

    return _bound(items, lambda x: _bound(runs(x), from_runs))


def _found(text: Column, pattern: str, gate: str, least: int = 0) -> Column:
    """array<struct<start, m, before, after>> of the pattern's matches, in order: gaps from split(), matches from
    regexp_extract_all(). Offsets, and the characters before and after, are carried along, so the text is not looked into again."""
    hit = F.when(text.contains(gate) if gate == "@" else text.rlike(gate), text)
    one = lambda c: F.nullif(F.substring(c, 1, 1), F.lit(""))

    def places(s: Column) -> Column:
        next_to = lambda i: F.coalesce(one(F.get(s["g"], i + 1)), one(F.get(s["m"], i + 1)), F.lit(""))
        pairs = F.transform(s["m"], lambda m, i: F.struct(F.get(s["g"], i).alias("g"), m.alias("m"), next_to(i).alias("after")))
        return _scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, emit, FOUND)

    start = lambda a, x: a["at"] + F.length(x["g"])
    before = lambda a, x: F.right(F.concat(a["tail"], F.right(x["g"], F.lit(BEFORE))), F.lit(BEFORE))
    step = lambda a, x: F.struct((start(a, x) + F.length(x["m"])).alias("at"), F.right(F.concat(before(a, x), F.right(x["m"], F.lit(BEFORE))), F.lit(BEFORE)).alias("tail"))
    emit = lambda a, x: F.struct(start(a, x).alias("start"), x["m"].alias("m"), before(a, x).alias("before"), x["after"].alias("after"))
    found = _bound(F.when(hit.isNotNull(), F.struct(F.split(hit, pattern, -1).alias("g"), F.regexp_extract_all(hit, F.lit(pattern), F.lit(0)).alias("m"))), places)
    found = F.coalesce(found, F.array().cast(FOUND))
    return F.filter(found, lambda x: F.length(x["m"]) >= least) if least else found


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _passes(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _candidate(kind: str, base: bool):
    def make(x: Column) -> Column:
        m, start, before, after = x["m"], x["start"], x["before"], x["after"]
        ok = _passes(kind, m) if base else F.lit(False)
        fmt = F.when(ok, 1).when(F.lit(base), -1).otherwise(0)
        gaz = F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(-1)
        cue = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
        edge = F.when((before == "") | before.rlike(r"[\s(\[<:;,\"']$"), F.when((after == "") | after.rlike(r"[\s)\]>:;,.!?\"']"), 1).otherwise(0)).otherwise(-1)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), ok.alias("base"),
            F.concat_ws(",", *[v.cast("string") for v in (fmt, gaz, cue, edge)]).alias("votes"), (F.length(_digits(m)) >= 9).cast("int").alias("long"),
        )

    return make


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with ``pii_text`` and ``pii_found``, an array of candidates."""
    df = df.withColumn("pii_text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("pii_text")
    raw = {f"pii_b_{k}": _found(text, BASE[k], GATE[k], LEAST.get(k, 0)) for k in KINDS} | {f"pii_l_{k}": _found(text, LOOSE[k], LOOSE_GATE[k]) for k in LOOSE}
    df = df.withColumns(raw)
    parts = [F.transform(c, _candidate(c.split("_")[2], c[4] == "b")) for c in raw]
    return df.withColumn("pii_found", F.concat(*parts)).drop(*raw)


def reliabilities(patterns: list[tuple[str, str, int, int]], rounds: int = 50) -> dict[str, dict[str, float]]:
    """EM over (kind, votes, long, count): each pattern's probability, by kind. Two classes, labelers independent in each."""
    out: dict[str, dict[str, float]] = {}
    for kind in sorted({p[0] for p in patterns}):
        rows: dict[tuple[int, ...], int] = {}
        for k, votes, _, n in patterns:
            if k == kind:
                key = tuple(map(int, votes.split(",")))
                rows[key] = rows.get(key, 0) + n
        belief = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in rows}  # the majority, to begin with
        for _ in range(rounds):
            table = {(j, x, c): 1.0 + (0.5 if x == (1 if c else -1) else 0) for j in range(LABELERS) for x in (-1, 0, 1) for c in (0, 1)}
            size = [1.0, 1.0]
            for v, n in rows.items():
                for c in (0, 1):
                    w = n * (belief[v] if c else 1 - belief[v])
                    size[c] += w
                    for j, x in enumerate(v):
                        table[j, x, c] += w
            for v in rows:
                z = math.log(size[1] / size[0])
                for j, x in enumerate(v):
                    z += math.log(table[j, x, 1] / sum(table[j, y, 1] for y in (-1, 0, 1))) - math.log(table[j, x, 0] / sum(table[j, y, 0] for y in (-1, 0, 1)))
                belief[v] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        out[kind] = {",".join(map(str, v)): b for v, b in belief.items()}
    return out


def _features(votes: str, long: int) -> list[float]:
    return [1.0, *(float(x) for x in votes.split(",")), float(long)]


def span_classifier(patterns: list[tuple[str, str, int, int]], belief: dict[str, dict[str, float]], steps: int = 300) -> dict[str, list[float]]:
    """Logistic weights of each kind, fitted to the patterns' probabilities."""
    model = {}
    for kind in belief:
        rows = [(_features(v, lg), belief[kind][v], math.sqrt(n)) for k, v, lg, n in patterns if k == kind]
        w, total = [0.0] * (LABELERS + 2), sum(r[2] for r in rows)
        for _ in range(steps):
            grad = [0.002 * x for x in w]
            for x, y, n in rows:
                p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x))))))
                for i, xi in enumerate(x):
                    grad[i] += n / total * (p - y) * xi
            w = [a - 1.0 * g for a, g in zip(w, grad)]
        model[kind] = w
    return model


def train(df: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    c = candidates(df.select(text_col), text_col).select(F.explode("pii_found").alias("c"))
    rows = c.groupBy("c.kind", "c.votes", "c.long").agg(F.count("*").alias("n")).orderBy("kind", "votes", "long").collect()  # at most 4 x 81 x 2
    patterns = [(r["kind"], r["votes"], r["long"], r["n"]) for r in rows]
    return span_classifier(patterns, reliabilities(patterns))


def _score(model: dict[str, list[float]], c: Column) -> Column:
    z = F.lit(-30.0)
    for kind, w in model.items():
        v = F.split(c["votes"], ",")
        s = F.lit(w[0]) + sum((F.element_at(v, j + 1).cast("double") * w[j + 1] for j in range(LABELERS)), F.lit(0.0)) + c["long"] * w[-1]
        z = F.when(c["kind"] == kind, s).otherwise(z)
    return 1 / (1 + F.exp(-z))


def find(df: DataFrame, model: dict[str, list[float]], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with ``pii_base`` and ``pii_spans``: arrays of struct<start, k, kind, end>, ordered by start and kind."""
    df = candidates(df, text_col)
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    entry = lambda c: F.struct(c["start"].alias("start"), rank(c).alias("k"), c["kind"].alias("kind"), c["end"].alias("end"))
    df = df.withColumn("pii_base", F.array_sort(F.transform(F.filter("pii_found", lambda c: c["base"]), entry)))
    more = F.transform(F.filter("pii_found", lambda c: ~c["base"] & (_score(model, c) >= threshold)), entry)
    return df.withColumn("pii_spans", F.when(F.size(more) == 0, F.col("pii_base")).otherwise(_joined(F.col("pii_base"), more))).drop("pii_found", "pii_text")


def _joined(base: Column, more: Column) -> Column:
    """base, and those of more that overlap no span of base; ordered. Spans are scanned by start, for the furthest end of a base span
    before, and backwards, for the nearest start of one behind, so that none is held against all others."""
    kind = "array<struct<start:int,k:int,kind:string,end:int,b:boolean,out:boolean>>"
    flat = lambda x, out: F.struct(*[x[c].alias(c) for c in ("start", "k", "kind", "end", "b")], out.alias("out"))
    marked = lambda spans, b: F.transform(spans, lambda x: F.struct(*[x[c].cast("int" if c != "kind" else "string").alias(c) for c in ("start", "k", "kind", "end")], F.lit(b).alias("b"), F.lit(False).alias("out")))
    both = F.array_sort(F.concat(marked(base, True), marked(more, False)))
    ahead = _scan(both, F.lit(0), lambda a, x: F.when(x["b"], F.greatest(a, x["end"])).otherwise(a), lambda a, x: flat(x, ~x["b"] & (a > x["start"])), kind)
    last = F.lit(2**31 - 1)
    back = _scan(F.reverse(ahead), last, lambda a, x: F.when(x["b"], x["start"]).otherwise(a), lambda a, x: flat(x, x["out"] | (~x["b"] & (a < x["end"]))), kind)
    return F.array_sort(F.transform(F.filter(back, lambda x: ~x["out"]), lambda x: F.struct(x["start"].alias("start"), x["k"].cast("long").alias("k"), x["kind"].alias("kind"), x["end"].alias("end"))))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find(docs.select(id_col, text_col), train(docs, text_col), text_col)
    counts = [F.size(F.filter("pii_base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(render(F.col("pii_base")), 256).alias("base_sha256"), render(F.col("pii_spans")).alias("spans"))
