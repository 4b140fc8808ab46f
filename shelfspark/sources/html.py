"""Pages to nodes, from Python's own parser in Arrow batches: elements as nested intervals, and the text of whole subtrees.

Places are given in document order to elements and texts alike, so a node at ``pos`` has exactly the nodes from ``pos + 1`` to ``last``
below it. What is asked of ancestors or descendants is then a question of intervals: a range join, a running maximum or a
difference of running sums over the places of a page (see operators/dom.py)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
#: Open elements that a start tag ends, and the elements that it does not look beyond.
ENDS = {tag: ({"p"}, {"table", "td", "th", "button"}) for tag in _BLOCKS} | {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
TEXT = "#text"


#: Start tags that a task remembers, rows and characters of text of one of the parser's batches.
REMEMBERED, ROWS, CHARS = 10_000, 8_192, 4_000_000


class _Nodes(HTMLParser):
    """nodes: [parent, depth, nth, tag, attrs, last, begin, end], begin and end being offsets in the page's text. seen: start tags
    that have been read, which pages may share; nobody changes their attributes."""

    def __init__(self, seen: dict[str, tuple[str, dict[str, str]]] | None = None):
        super().__init__(convert_charrefs=True)
        self.seen = {} if seen is None else seen
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = [0]
        self.pieces: list[str] = []
        self.length = 0

    def _node(self, tag: str, attrs: dict[str, str] | None) -> int:
        self.children[-1] += attrs is not None
        self.nodes.append([self.open[-1] if self.open else -1, len(self.open), self.children[-1] if attrs is not None else 0, tag, attrs, len(self.nodes), self.length, self.length])
        return len(self.nodes) - 1

    def _close(self, k: int) -> None:
        for at in self.open[k:]:
            self.nodes[at][5], self.nodes[at][7] = len(self.nodes) - 1, self.length
        del self.open[k:], self.children[k + 1 :]

    def updatepos(self, i, j):
        """Nobody asks for lines and columns."""
        return j

    def parse_starttag(self, i):
        """Start tags that are written alike are read once."""
        end = self.check_for_whole_start_tag(i)
        raw = self.rawdata[i:end] if end >= 0 else ""
        if raw in self.seen:
            self._start(*self.seen[raw])
            return end
        self.started = None
        end = super().parse_starttag(i)
        if self.started and not self.cdata_elem and not raw.endswith("/>"):
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[raw] = self.started
        return end

    def handle_starttag(self, tag, attrs):
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.started = (tag, first)
        self._start(tag, first)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        ended, within = ENDS.get(tag, ((), ()))
        for k in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[k]][3]
            if name in within:
                break
            if name in ended:
                self._close(k)
        at = self._node(tag, attrs)
        if tag not in VOID:
            self.open.append(at)
            self.children.append(0)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][3] == tag:
                return self._close(k)

    def handle_data(self, data):
        last = self.nodes[-1] if self.nodes else None
        if not (last and last[4] is None and last[0] == (self.open[-1] if self.open else -1)):
            last = self.nodes[self._node(TEXT, None)]
        self.pieces.append(data)
        self.length += len(data)
        last[7] = self.length

    def read(self, html: str) -> str:
        """Reads a page; returns its text."""
        self.feed(html)
        self.close()
        if self.cdata_elem and self.rawdata:  # a script that does not end
            self.handle_data(self.rawdata)
        self._close(0)
        return "".join(self.pieces)


NODE = "pos int, last int, parent int, depth int, nth int, tag string, attrs map<string,string>, content string, chars int, own string, above string"
_NAMES = [x.split()[0] for x in NODE.split(", ")]
_TYPES = [pa.int32()] * 5 + [pa.string(), None, pa.string(), pa.int32(), pa.string(), pa.string()]
Wanted = Callable[[str, dict[str, str]], bool]
#: Of an element (tag, attributes) and its parent's state: its own state, and the numbers of the selectors that select it.
Chains = Callable[[str, dict[str, str], tuple[int, int]], tuple[tuple[int, int], list[int]]]


def _maps(column: tuple[dict[str, str] | None, ...]) -> pa.Array:
    """The column as Arrow's maps, made of all keys and all values at once."""
    starts, keys, values = [], [], []
    for x in column:
        starts.append(None if x is None else len(keys))
        if x:
            keys += x.keys()
            values += x.values()
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def html_nodes(
    pages: DataFrame, tags: tuple[str, ...] | None = None, keep: Wanted | None = None, text: Wanted | None = None, texts: bool = False, carry: tuple[str, ...] = (), marks: dict[str, Wanted] | None = None,
    chains: Chains | None = None, around: int = 0, below: tuple[str, ...] = (),
) -> DataFrame:
    """page_id, pos, last, parent, depth, nth (place among its parent's elements, from 1), tag, attrs, content, chars, own, above.

    Only elements of these tags, that ``keep`` (of tag and attributes) wants or that ``chains`` selects leave the parser; without any of
    the three, all do. content is the text of the whole subtree, for elements that ``text`` wants (all, if it is not given); chars the
    length of that text without the white space around it, for every element; own the text that stands in the element itself (where
    content is given), above the tag of its parent. texts: text nodes are rows too, as ``#text``. carry: further columns of pages.
    marks: adds ``marks``, the names of those predicates (of selectors.wants) that hold for the element (null for texts). around: adds
    ``around``, the marks of the element and of so many of its ancestors. below: adds ``below``, how many elements below have each of these
    marks. chains (of selectors.chains): adds ``selected``, the numbers of the selectors that select the element."""
    all_of = tags is None and keep is None and chains is None
    looked_at = sorted({a for holds in (marks or {}).values() for a in holds.names})
    more = {"marks": "array<string>"} if marks else {}
    more |= ({"around": "array<string>"} if around else {}) | ({"below": "array<int>"} if below else {}) | ({"selected": "array<int>"} if chains else {})
    kinds_of = {"array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[str]] = {}  # elements alike in tag and these attributes have the same marks
        starts: dict[str, tuple[str, dict[str, str]]] = {}

        def marks_of(tag: str, attrs: dict[str, str]) -> list[str]:
            key = (tag, *map(attrs.get, looked_at))
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[key] = [m for m, holds in marks.items() if holds(tag, attrs)]
            return seen[key]

        def page(html: str) -> Iterator[tuple]:
            p = _Nodes(starts)
            whole = p.read(html)
            nodes, own, named, states, sums, counted = p.nodes, {}, [], [], [], [0] * len(below)
            for parent, _, _, tag, attrs, _, begin, end in nodes:
                if attrs is None:
                    own[parent] = own.get(parent, "") + whole[begin:end]
                if below or around:  # of elements that stay behind, too
                    named.append(marks_of(tag, attrs) if attrs is not None else ())
                if below:
                    counted = [n + (m in named[-1]) for n, m in zip(counted, below)] if named[-1] else counted
                    sums.append(counted)
            for pos, (parent, depth, nth, tag, attrs, last, begin, end) in enumerate(nodes):
                over = nodes[parent][3] if parent >= 0 else None
                if attrs is None:
                    if chains:
                        states.append((0, 0))
                    if texts:
                        yield (pos, last, parent, depth, nth, tag, None, whole[begin:end], end - begin, None, over, *[None] * len(more))
                    continue
                if chains:
                    state, selected = chains(tag, attrs, states[parent] if parent >= 0 else (0, 0))
                    states.append(state)
                if not (all_of or (tags and tag in tags) or (keep and keep(tag, attrs)) or (chains and selected)):
                    continue
                content, asked = whole[begin:end], text is None or text(tag, attrs)
                extra = [marks_of(tag, attrs)] if marks else []
                if around:
                    near, at = dict.fromkeys(named[pos]), parent
                    for _ in range(around):
                        if at >= 0:
                            near |= dict.fromkeys(named[at])
                            at = nodes[at][0]
                    extra.append(list(near))
                if below:
                    extra.append([a - b for a, b in zip(sums[last], sums[pos])])
                if chains:
                    extra.append(selected)
                yield (pos, last, parent, depth, nth, tag, attrs, content if asked else None, len(content.strip()), own.get(pos, "") if asked else None, over, *extra)

        def made(batch: pa.RecordBatch, out: list[tuple], rows: list[int]) -> pa.RecordBatch:
            head = [batch.column(c).take(pa.array(rows)) for c in (0, *range(2, batch.num_columns))]
            types = [*_TYPES, *map(kinds_of.get, more.values())]
            cols = [pa.array(c, t) if t else _maps(c) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays([head[0], *cols, *head[1:]], ["page_id", *_NAMES, *more, *carry])

        for batch in batches:
            out, rows, size = [], [], 0
            for row, html in enumerate(batch.column(1)):
                for node in page(html.as_py() or ""):
                    out.append(node)
                    rows.append(row)
                    size += len(node[7] or "")
                if len(out) >= ROWS or size >= CHARS:
                    yield made(batch, out, rows)
                    out, rows, size = [], [], 0
            if out:
                yield made(batch, out, rows)

    kinds = dict(pages.dtypes)
    given = pages.where(F.col("url").rlike("(?i)^https?:")).select(F.col("page_id").cast("long").alias("page_id"), "html", *carry)
    return given.mapInArrow(parse, ", ".join(["page_id long", NODE, *[f"{n} {t}" for n, t in more.items()], *[f"{c} {kinds[c]}" for c in carry]]))


def _products(ld: object, path: tuple[int, ...] = (0,)) -> Iterator[tuple[tuple[int, ...], str]]:
    """Every Product in the data, in order, with its place; what stands inside one belongs to it."""
    waiting = [(path, ld)]
    while waiting:
        at, x = waiting.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                yield at, json.dumps(x, ensure_ascii=False)
                continue
        inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        waiting += [((*at, i), y) for i, y in reversed(list(enumerate(inner))) if isinstance(y, (dict, list))]


def json_ld_products(pages: DataFrame) -> DataFrame:
    """page_id, block, item (their places) and the VARIANT of every Product in the page's JSON-LD, however deep in lists, graphs and
    objects. Blocks that do not parse are skipped."""

    def find(blocks: pd.Series) -> pd.Series:
        out = []
        for raws in blocks:
            found = []
            for block, raw in enumerate(raws):
                try:
                    found += [{"block": block, "item": list(at), "raw": text} for at, text in _products(json.loads(raw))]
                except (ValueError, RecursionError):
                    pass
            out.append(found)
        return pd.Series(out, dtype=object)

    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    some = pages.where(F.col("html").contains("ld+json")).select("page_id", blocks.alias("blocks"))
    each = some.select("page_id", F.explode(F.pandas_udf(find, "array<struct<block int, item array<int>, raw string>>")("blocks")).alias("p"))
    return each.select("page_id", "p.block", "p.item", F.try_parse_json("p.raw").alias("ld")).where("ld IS NOT NULL")


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, first heading, paragraph text and link count of each page, the title by its chain of sources, without a shuffle of
    the pages themselves: only the few nodes that matter are grouped."""
    n = html_nodes(pages, ("meta", "h1", "title", "p", "a"), text=lambda tag, _: tag in ("h1", "title"))
    first = lambda cond, what: F.min_by(F.when(cond, what), F.when(cond, F.col("pos")))
    own = F.trim(F.regexp_replace("content", r"\s+", " "))
    og = (F.col("tag") == "meta") & F.col("attrs")["property"].isin("og:title", "twitter:title")
    g = n.groupBy("page_id").agg(
        first(og, F.col("attrs")["content"]).alias("og"), first((F.col("tag") == "h1") & (own != ""), own).alias("h1"), first((F.col("tag") == "title") & (own != ""), own).alias("page_title"),
        F.count_if(F.col("tag") == "p").alias("n_paragraphs"), F.count_if(F.col("tag") == "a").alias("n_links"),
    )
    return g.select("page_id", F.coalesce("og", "h1", "page_title").alias("title"), F.col("h1"), "n_paragraphs", "n_links")
