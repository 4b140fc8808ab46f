"""Words, their plural forms, and phrases as Column expressions. A word is a run of [a-z0-9_]; bounds of words are those."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plurals that follow no rule.
IRREGULAR = {"man": "men", "woman": "women", "child": "children", "person": "people", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "ox": "oxen", "sheep": "sheep", "deer": "deer", "fish": "fish"}
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def plural_forms(word: Column) -> Column:
    """The lower-cased word with its singular and plural forms, each once."""
    w = F.lower(word)
    less = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    both = F.create_map(*[F.lit(x) for a, b in IRREGULAR.items() for x in (a, b)]), F.create_map(*[F.lit(x) for a, b in IRREGULAR.items() for x in (b, a)])
    plus = lambda end: F.concat(w, F.lit(end))
    one = less(1)
    forms = [
        w, F.try_element_at(both[0], w), F.try_element_at(both[1], w),
        F.when(w.rlike("^.+ies$"), F.concat(less(3), F.lit("y"))).when(w.rlike("^.*[^aeiou]y$"), F.concat(one, F.lit("ies"))),
        F.when(w.rlike("^.+ves$"), F.concat(less(3), F.lit("f"))).when(w.rlike("^.+fe$"), F.concat(less(2), F.lit("ves"))).when(w.rlike("^..+f$"), F.concat(one, F.lit("ves"))),
        F.when(w.rlike("^.+ves$"), F.concat(less(3), F.lit("fe"))),
        F.when(w.rlike("(sses|xes|zes|shes|ches)$"), less(2)),
        F.when(w.rlike("^.+oes$"), less(2)),
        F.when(w.rlike("([^s]|^)s$"), one), F.when(w.rlike("ses$"), less(2)),
        plus("s"), plus("es"),
    ]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]+"), lambda x: x != "")


def gram(c: Column) -> Column:
    """The words of a dictionary's entry as they stand in ``grams``."""
    return F.array_join(words(c), " ")


def grams(ws: Column, lengths: list[int]) -> Column:
    """array<struct<at, gram>>: all windows of as many words."""

    def windows(n: int) -> Column:
        whole = F.size(ws) >= n
        at = F.when(whole, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), (F.get(ws, i - 1) if n == 1 else F.array_join(F.slice(ws, i, F.lit(n)), " ")).alias("gram")))

    return F.concat(*[windows(n) for n in lengths])


def stands_in(phrase: Column, text: Column) -> Column:
    """Whether the phrase stands in the text as it is written, between bounds of words."""
    return F.rlike(text, F.concat(F.lit(f"(?i){START}\\Q"), phrase, F.lit(f"\\E{END}")))
