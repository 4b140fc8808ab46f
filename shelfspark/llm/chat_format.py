"""Chat formatting with Spark expressions only: turns are collected by conversation as structs and sorted, runs of turns with the
same role are merged into one block by array functions, and blocks are concatenated.

A block is ``start role body text (part text)* end``; ``part`` stands between the texts of merged turns, so that every turn can be
read back. Control strings inside roles and texts (those of the template and ``CONTROL``) are escaped by one backslash after their
first character; as a control string with k backslashes there becomes one with k + 1, this can be undone exactly.

``format_chats(turns)`` returns, one row for each conversation, its id, ``formatted``, and ``segments``, the loss mask: pieces of
``formatted`` in order (``text``, ``loss``), of which the texts of ``LOSS_ROLES`` bear the loss, nothing else.
``read_back(formatted)`` gives the turns again (array of ``role``, ``text``), ``masked(segments)`` the text under the mask.

Defined cases: a null text or role counts as empty; rows of one conversation that share a turn number are ordered by role, then
text, null turn numbers come first, repeated rows stay; rows with a null id are one conversation; an empty text is a turn of its
own; texts of any length are kept whole, up to the size of a Spark string for one conversation; an empty table gives an empty
result; further columns are ignored, whatever their names. Arrays are bound to columns or lambda variables before they are
indexed, so work grows with the length of a conversation, not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template.
START, BODY, PART, END = "<|im_start|>", "<|im_body|>", "<|im_part|>", "<|im_end|>"
#: Control strings of common vocabularies, which must not appear in a text as such either.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|begin_of_text|>", "[INST]", "[/INST]", "<SYS>", "</SYS>")
LOSS_ROLES = ("assistant",)


def _by_first() -> dict[str, str]:
    """First character -> pattern of what follows it. No control string holds a backslash or, further on, the first character of any,
    so matches never overlap and none can begin in a text and end in a mark."""
    all_of = (START, BODY, PART, END, *CONTROL)
    firsts = {c[0] for c in all_of}
    assert not any("\\" in c or firsts & set(c[1:]) for c in all_of)
    return {f: "|".join(re.escape(c[1:]) for c in all_of if c[0] == f) for f in sorted(firsts)}


RESTS = _by_first()


def escape(text: Column) -> Column:
    for first, rests in RESTS.items():
        text = F.when(text.contains(first), F.regexp_replace(text, rf"{re.escape(first)}(\\*(?:{rests}))", rf"{re.escape(first)}\\$1")).otherwise(text)
    return text


def unescape(text: Column) -> Column:
    for first, rests in RESTS.items():
        text = F.when(text.contains(f"{first}\\"), F.regexp_replace(text, rf"{re.escape(first)}\\(\\*(?:{rests}))", rf"{re.escape(first)}$1")).otherwise(text)
    return text


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    empty = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    chats = turns.select(F.col(id_col).alias("id"), one.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    n = F.size("turns")
    opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    chats = chats.select("id", "turns", opens.alias("opens"))

    seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def block(at: Column, k: Column) -> Column:
        many = F.slice("turns", at + 1, F.coalesce(F.get("opens", k + 1), n) - at)
        head = F.concat(F.lit(START), escape(role(at)), F.lit(BODY))
        plain = lambda ts: F.array(seg(F.concat(head, F.array_join(F.transform(ts, lambda t: escape(t["text"])), PART), F.lit(END)), False))
        parts = lambda ts: F.flatten(F.transform(ts, lambda t, i: F.array(seg(F.when(i == 0, head).otherwise(F.lit(PART)), False), seg(escape(t["text"]), True))))
        return _bound(many, lambda ts: F.when(role(at).isin(*LOSS_ROLES), F.concat(parts(ts), F.array(seg(F.lit(END), False)))).otherwise(plain(ts)))

    chats = chats.select("id", F.flatten(F.transform("opens", block)).alias("segments"))
    return chats.select(F.col("id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns in the formatted text: array<struct<role, text>>."""
    quoted = lambda mark: F.lit(re.escape(mark))
    blocks = F.filter(F.split(formatted, re.escape(END), -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        return _bound(F.split(b, quoted(BODY), -1), lambda x: _bound(unescape(F.replace(x[0], F.lit(START), F.lit(""))), lambda r: F.transform(F.split(x[1], quoted(PART), -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text")))))

    return F.flatten(F.transform(blocks, turns))


def masked(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its pieces."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations and their masks give when they are read back."""
    chats = format_chats(turns, id_col).select(id_col, "formatted", masked(F.col("segments")).alias("loss"), read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
