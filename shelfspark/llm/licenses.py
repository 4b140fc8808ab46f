"""License scans with a positional index of rare words, in DataFrame expressions only.

Templates (``license_texts``, or a table of your own) are whole license texts and notices. Their words' document frequencies
are counted in one scan of the whole table; of each template the words with the highest IDF that the file holds are looked up
in the template postings, and postings that agree on (position in the file) minus (position in the template) point to a place
where the template stands. A template is reported where words with enough of the looked-up IDF agree on one offset and its
mandatory phrases stand in the file. Rarity is a rank within the template, so a license that many documents carry is found
like any. The index has a row for each word of the templates, which bounds it.

Words are runs of [0-9a-z] and characters beyond ASCII after lower-casing A-Z. Null text counts as empty; one output row for
each input row, repeated rows included; texts without a license word are not split into words at all; very long texts are
read whole; a tie of words in IDF goes by the alphabet; an empty table gives an empty result; no column is read but id and text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Written out character by character, since Java tests listed characters by a bit set and ranges one after another.
_GAPS = "".join(rf"\x{i:02X}" for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
WORD = f"[^{_GAPS}]+"
#: Fixed by the contract: phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A file looks up so many of each template's words, the rarest that it holds.
RARE = 6
#: Added to every IDF, so words that stand in all documents still count, and alike.
IDF_MORE = 0.01


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The words as they stand before lower-casing, and a part of each key phrase; Java ignores case for ASCII only, as wanted.
_RAW_GAPS = "".join(rf"\x{i:02X}" for i in range(128) if not chr(i).isalnum())
RAW_WORD = f"[^{_RAW_GAPS}]+"
CHEAP = r"(?i)license|reserved|hereby|redistribution|waiving|public domain|misrepresented|(?<![0-9a-z\u0080-\x{10FFFF}])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _words(raw: Column) -> Column:
    """The lower-cased words, of texts that may hold a key phrase; else an empty array."""
    return F.when(raw.rlike(CHEAP), F.regexp_extract_all(_lower(raw), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def postings(templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """word -> (number of the template, position in it)"""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text, _) in enumerate(templates):
        for i, w in enumerate(words_of(text)):
            out.setdefault(w, []).append((k, i))
    return out


def idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """IDF of the templates' words over all documents, in one scan; a row for each word of the templates, and one for the number
    of documents, come back."""
    known = sorted(postings(templates))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: w.isin(known)))
    df = dict(map(tuple, docs.select(F.explode(F.array_append(words, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*")).collect()))
    n = df.get("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in postings(templates)}


def _within(k: int, words: Column):
    return lambda h: (h["k"] == k) & F.array_contains(words, h["w"])


def _most_agreeing(hits: Column) -> Column:
    """The most weight of distinct words that stand at one offset: one pass over the hits in order of offset and word."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["off"].alias("off"), h["w"].alias("w"), h["r"].alias("r"))))
    start = F.struct(F.lit(None).cast("int").alias("off"), F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["off"] == x["off"], a["n"] + F.when(a["w"] == x["w"], 0.0).otherwise(x["r"])).otherwise(x["r"])
        return F.struct(x["off"].alias("off"), x["w"].alias("w"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(ordered, start, step, lambda a: a["best"])


def scan(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, templates=TEMPLATES) -> DataFrame:
    d = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    n_words = F.regexp_count("raw", F.lit(RAW_WORD))
    d = d.select(id_col, n_words.cast("long").alias("n_words"), _words(F.col("raw")).alias("w"))
    d = d.withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    stands = lambda phrase: F.col("joined").contains(f" {phrase} ")
    n = F.size("w")
    word = lambda i: F.get("w", i)

    def starts(phrase: str) -> Column:
        ws = phrase.split()
        here = lambda i: F.when(word(i) == ws[0], sum(((word(i + j) == w).cast("int") for j, w in enumerate(ws) if j), F.lit(0)) == len(ws) - 1).otherwise(False)
        return F.when(stands(phrase), F.filter(F.sequence(F.lit(0), n - 1), here)).otherwise(F.array().cast("array<int>"))

    d = d.withColumns({f"p_{label}": starts(p) for p, label in BASE.items()})
    places = F.concat(*[F.col(f"`p_{label}`") for label in BASE.values()])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"`p_{label}`") > 0, F.lit(label)) for label in BASE.values()])))
    # the rarest words of each template whose phrases stand in the file, each with its places
    index = F.create_map(*[x for w, ps in postings(templates).items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in ps]))])
    rarity = F.create_map(*[x for w, v in weights.items() for x in (F.lit(w), F.lit(v + IDF_MORE))])

    def rarest(text: str, phrases: tuple[str, ...]) -> Column:
        ranked = sorted(dict.fromkeys(words_of(text)), key=lambda w: (-weights[w], w))
        verified = F.lit(True)
        for p in phrases:
            verified = verified & stands(p)
        return F.when(verified, F.slice(F.array_intersect(F.array(*map(F.lit, ranked)), "w"), 1, RARE)).otherwise(F.array().cast("array<string>"))

    d = d.select("*", places.alias("places"), base.alias("base"), *[rarest(*t[1:]).alias(f"r_{k}") for k, t in enumerate(templates)])
    d = d.withColumn("rare", F.array_distinct(F.concat(*[F.col(f"r_{k}") for k in range(len(templates))])))
    at = F.when(F.size("rare") > 0, F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: F.array_contains("rare", x["w"]))).otherwise(F.array().cast("array<struct<w:string,at:int>>"))
    d = d.withColumn("hits", F.flatten(F.transform(at, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["k"].alias("k"), (x["at"] - p["i"]).alias("off"), x["w"].alias("w"), F.element_at(rarity, x["w"]).alias("r"))))))
    found = []
    for k, (label, _, _) in enumerate(templates):
        mine = F.col(f"r_{k}")
        looked_up = F.aggregate(mine, F.lit(0.0), lambda a, w: a + F.element_at(rarity, w))
        found.append(F.when(F.size(mine) > 0, F.struct(F.lit(label).alias("label"), (_most_agreeing(F.filter("hits", _within(k, mine))) / looked_up).alias("score"))))
    d = d.withColumn("found", F.filter(F.array_compact(F.array(*found)), lambda x: x["score"] >= least))
    extra = F.transform("found", lambda x: x["label"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)))
    return d.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.array_union("base", extra))), ",").alias("labels"), F.least(F.lit(1.0), score).alias("score"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    return scan(docs, idf(docs, text_col, templates), id_col, text_col, templates=templates)
