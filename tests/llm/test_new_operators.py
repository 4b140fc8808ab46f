"""Chat formatting, fill-in-middle and token alignment against brute-force versions, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import chat_format, fill_in_middle, jaccard_join, queries, sentencepiece_codec, token_alignment

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fim_n string, n long, form string, id long, t string, row long, key long"
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "word " * 30_000), (6, "é\U0001f600 ü\r\n x  y\x0b\x0cz "), (7, "a <P> b c d"), (8, "<"), (None, "no id"), (9, "x" * 200_000), (10, " lead and trail  "), (11, "a▁b ▁"),
    (12, "<|endoftext|> <s> </s> <unk> <0x41>"), (13, "  wide　space"), (14, "ab\0cd"), (15, "日本語のテキスト 𝔘𝔫𝔦"), (9, "x" * 200_000), (None, "w " * 40_000), (16, "y" * 32_767 + "<M>" + "z" * 40_000), (17, " " * 70_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "a", 0, "x", 0, "y", 0, "z", 0, 0) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# chat formatting


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, segments long")


HARD = ["", "<|im_end|>", r"<\|im_end|>", r"<\\|im_part|>", "<|im_", "|im_end|>", "</s>[INST] ok [/INST]", r"[\INST]", "<<s>>", "\\", "<", "[", "a\nb\r\n", "é\U0001f600<|im_start|>x<|im_body|>"]


def test_chat_turns_come_back(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|im_body|>", ""]), "".join(r.choices(HARD, k=r.randint(0, 4)))) for c in range(60) for t in range(r.randint(1, 12))]
    rows += [(100, None, None, None), (100, 1, "assistant", "b"), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    r.shuffle(rows)
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    got = chat_format.format_chats(chats(spark, rows)).withColumns({"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked(F.col("segments"))}).collect()
    assert {x.conv_id for x in got} == set(want) and len(got) == len(want)
    for x in got:
        turns = [t[1:] for t in sorted(want[x.conv_id])]
        assert [tuple(t) for t in x.turns] == turns
        assert x.loss == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s.text for s in x.segments) == x.formatted
        starts = sum(i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns)))
        assert x.formatted.count(chat_format.START) == starts == x.formatted.count(chat_format.END)  # same roles in a row are one block
        assert x.formatted.count(chat_format.PART) == len(turns) - starts
        assert not any(c in x.formatted for c in chat_format.CONTROL)


def test_chat_escape(spark):
    df = spark.createDataFrame([(h + g,) for h in HARD for g in HARD], "t string")
    rows = df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in (*chat_format.CONTROL, chat_format.START, chat_format.END, chat_format.PART, chat_format.BODY))


def test_chat_long_conversation(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<s>"), "id").alias("text"))
    r = chat_format.digests(rows).collect()
    assert [(x.conv_id, x.n_turns) for x in r] == [(1, 30_000)]
    assert r[0].loss_sha256 == sha("".join(f"t<s>{i}" for i in range(30_000) if i % 3))


def test_chat_empty(spark):
    assert chat_format.digests(chats(spark, [])).count() == 0


@pytest.mark.parametrize("name, table", [("op11_chat_format", "conversations"), ("op12_fill_in_middle", "documents")])
def test_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    rel = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(map(str, map(tuple, got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


# fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim(doc_id, text):
    t = text or ""
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(t)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, t)
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("chunk", [1 << 15, 7, 1])
def test_fim(spark, odd, chunk):
    r = random.Random(chunk)
    texts = [(i, "".join(r.choices(["a", "bc", " ", "\n", "é", "\U0001f600", "<", "<P", "P>", "M", ">"], k=r.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    if chunk > 7:
        df = df.unionByName(odd.select("doc_id", "text"))
        texts = texts + TEXTS
    got = fill_in_middle.transform(df, chunk=chunk).withColumn("back", fill_in_middle.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert collections.Counter((x.doc_id, x.fim_n, x.fim_form, x.fim_prefix_chars, x.fim_middle_chars, x.fim_output) for x in got) == collections.Counter(fim(*t) for t in texts)
    assert all(x.back == (x.text or "") for x in got)


def test_fim_composition_is_associative():
    r = random.Random(5)
    for _ in range(300):
        b = "".join(r.choices(["a", " ", "<", "P", ">", "<S>", "é"], k=r.randint(1, 30))).encode()
        size = r.randint(1, 5)
        parts = [fill_in_middle.chunk_function(b[i : i + size]) for i in range(0, len(b), size)]
        left, ends, marks = fill_in_middle.compose(*[np.array([p[k] for p in parts]) for k in range(3)])
        whole = fill_in_middle.chunk_function(b)
        assert (left[-1].tolist(), ends[-1].tolist(), marks[-1].tolist()) == whole
        for k in range(len(parts)):
            assert ends[k][0] == fill_in_middle.chunk_function(b[: size * (k + 1)])[1][0]


def test_fim_keeps_columns(spark, odd, none):
    out = fill_in_middle.transform(odd)
    assert out.columns == [c for c in odd.columns if c != "fim_n"] + list(fill_in_middle.ADDED)
    assert fill_in_middle.transform(none).count() == 0 and fill_in_middle.digests(odd).count() == odd.count()


# token alignment


def paths():
    return queries.tokenizer_model("byte_bpe_50k.json"), queries.tokenizer_model()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths()[1])


def brute(libraries, texts):
    a, b = libraries
    both = token_alignment.load(*paths())
    docs, count = [], collections.Counter()
    for t in texts:
        ia, ib = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ra, rb = [both.a.raw[i] for i in ia], [both.b.raw[i] for i in ib]
        if not t or b"".join(ra) != f" {t}".encode() or b"".join(rb) != f" {t}".encode():
            docs.append(([], [], [], ""))
            continue
        ea, eb = (list(np.cumsum([len(x) for x in r])) for r in (ra, rb))
        at = {}
        for j, e in enumerate(eb):
            at.setdefault(e, []).append(j)
        pairs = [(i, j) for i, e in enumerate(ea) for j in at.get(e, ())]
        cuts = sorted(set(ea) & set(eb))
        ga, gb = collections.defaultdict(list), collections.defaultdict(list)
        for ids, ends, g in ((ia, ea, ga), (ib, eb, gb)):
            k = 0
            for i, e in zip(ids, ends):
                while cuts[k] < e:
                    k += 1
                g[cuts[k]].append(str(i))
        links = [(ia[i], ib[j]) for i, j in pairs]
        count.update(links)
        docs.append((ia, ib, links, ";".join(f"{','.join(ga[c])}|{','.join(gb[c])}" for c in cuts)))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(ia), len(ib), len(g.split(";")) if g else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha(g) if g else "") for ia, ib, links, g in docs], count


def test_alignment(spark, odd, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()
    want, count = brute(libraries, [r.text for r in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in token_alignment.digests(df, *paths()).collect()]
    assert collections.Counter(got) == collections.Counter((r.doc_id, *w) for r, w in zip(docs, want))
    aligned = token_alignment.align(df, *paths())
    assert {(r.a_id, r.b_id): r.n for r in token_alignment.pair_counts(aligned, *paths()).collect()} == count
    assert {sha(r.groups) if r.groups else "" for r in aligned.collect()} == {w[-1] for w in want}


def test_alignment_ids_are_the_library_s(spark, libraries):
    both = token_alignment.load(*paths())
    r = random.Random(9)
    chars = [*map(chr, range(1, 0x250)), " ", " ", "\n", "'s", "'ll", "<|endoftext|>", " ", "　", "日", "ि", "\U0001f600", "١٢", "́", "ǅ", "²", "Ⅷ", "​", "﻿", "\x85"]
    for _ in range(1500):
        t = "".join(r.choices(chars, k=r.randint(1, 40)))
        assert both.a.ids(t) == libraries[0].encode(t, add_special_tokens=False).ids, t


def test_possible_pairs_are_few():
    both = token_alignment.load(*paths())
    assert len(both.codes) < sum(map(len, both.a.raw)) + sum(map(len, both.b.raw))
    a, b = [b"x", b"ab", b"", b"cab"], [b"b", b"ab", b"zcab", b""]
    want = sorted(i * 4 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert token_alignment.possible_pairs(a, b).tolist() == want


def test_expansion_with_tokens_of_no_bytes():
    r = random.Random(1)
    for _ in range(200):
        a, b = (np.cumsum([r.randint(0, 3) for _ in range(r.randint(1, 8))]) for _ in range(2))
        cuts, ga, gb = token_alignment.grouped(a, b)
        i, j = token_alignment.links(a, b, cuts)
        assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]]


def test_alignment_by_words_is_that_of_whole_texts(monkeypatch):
    both = token_alignment.Both(*paths())
    r = random.Random(4)
    chars = [*map(chr, range(0, 0x180)), *" " * 150, *"\n\t\x1c\x85\u3000", "'s", "<|endoftext|>", "</s>", "<0x41>", "▁", "日", "ि", "\U0001f600", "́"]
    texts = ["".join(r.choices(chars, k=r.randint(1, 60))) for _ in range(1500)] + [None, "", " ", "  ", " a", "a ", "a  b", "x▁ y", "ab " * 3000, "x" * 3000]
    got = both.texts(texts)
    assert got == [both._align([t])[0] if t else None for t in texts] and got.count(None) > 10
    monkeypatch.setattr(token_alignment, "CACHE", 50)
    assert token_alignment.Both.texts(both, texts) == got
    encoded, plain = [], both.b.ids
    monkeypatch.setattr(both.b, "ids", lambda t: encoded.append(t) or plain(t))
    monkeypatch.setattr(token_alignment, "CACHE", 100_000)
    both.texts(["words that every text holds"] * 50)
    both.texts(["words every text holds"])
    assert sum(map(len, encoded)) == len("words that every text holds")


def test_alignment_empty(spark, none, odd):
    assert token_alignment.digests(none, *paths()).count() == 0
    assert token_alignment.digests(odd.where("text is null or text = ''"), *paths()).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]


def test_codec_in_one_pass_is_that_by_pieces(libraries):
    """ids, spans and decoded text of the packed form, against the walk by pieces and the library; with marks and odd characters."""
    m, lib = sentencepiece_codec.load(paths()[1]), libraries[1]
    r = random.Random(2)
    for _ in range(600):
        t = "".join(r.choices(["▁", " ", "the", "ab", "é", "日", "\U0001f600", "\n", "\0", "<0x41>", "</s>", "x"], k=r.randint(0, 25)))
        ids, decoded, spans = m.encode_packed(t)
        want = m.spans(t)
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == want[0] == lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(spans, "<u4").reshape(-1, 2).T.tolist() == [want[1], want[2]], t
        assert decoded == m.decode(ids) == lib.decode(ids), t


def test_join_finds_all_links_of_a_whole_table(spark):
    """The ids divisible by 20 against all rows of sf0.01, by exact Jaccard."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, holds = {}, collections.defaultdict(list)
    for d, t in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for x in sets[d]:
            holds[x].append(d)
    got = {r.doc_id: r for r in jaccard_join.join(docs).collect()}
    for d in (d for d in sets if d % 20 == 0 and sets[d]):
        shared = collections.Counter(e for x in sets[d] for e in holds[x] if e != d)
        links = [e for e, n in shared.items() if 5 * n >= 4 * (len(sets[d]) + len(sets[e]) - n)]
        assert got[d].n_links == len(links) and all(got[e].class_id == got[d].class_id for e in links)
