"""How much work page queries plan: pages parsed once, candidates judged once, few exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import gallery, scrape, selectors
from shelfspark.sources import html
from tests.test_dom import brute, by_page, pages, random_page

CHAINS = ["div", ".a", "[data-x~=two]", "div span", "div > span", "section div > b.a span", "div, em.b", ".a .a .a", "span span > b, ul em", "* > *", "ul em, em", ".a > .b .a"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chains_by_brute_force(spark):
    """What the parser selects, and marks around and below, against all relatives of every element."""
    r = random.Random(5)
    p = pages(spark, [random_page(r) for _ in range(40)])
    marks = {"a": selectors.wants(".a"), "ul": selectors.wants("ul")}
    got = html.html_nodes(p, chains=selectors.chains(*CHAINS), marks=marks, around=2, below=("ul", "a")).collect()
    found = {(x.page_id, x.pos): x for x in got}
    n = 0
    for page, nodes in by_page(html.html_nodes(p)).items():
        want = [set().union(*[brute(nodes, steps) for steps in selectors.parse(s)]) for s in CHAINS]
        for pos, x in nodes.items():
            own = [k for k, at in enumerate(want) if pos in at]
            assert own == (found[page, pos].selected if (page, pos) in found else [])
            n += len(own)
            if own:
                up = [y for y in (x, nodes.get(x.parent), nodes.get(nodes[x.parent].parent) if x.parent >= 0 else None) if y]
                assert set(found[page, pos].around) == {m for y in up for m, holds in marks.items() if holds(y.tag, y.attrs)}
                inside = [y for y in nodes.values() if pos < y.pos <= x.last]
                assert found[page, pos].below == [sum(marks[m](y.tag, y.attrs) for y in inside) for m in ("ul", "a")]
    assert n > 300
    for s in ("a + b", "a ~ b", "a:first-child", "a["):
        with pytest.raises(ValueError):
            selectors.chains(s)


def test_batches_hold_many_pages(spark):
    p = pages(spark, ["<b>x</b>" * 5_000, None, "<i id=1>" + "y" * 10, "<b>z</b>" * 9_000, "<br/><BR class=q><br/>"]).withColumn("host", F.concat(F.lit("h"), "page_id")).coalesce(1)
    n = html.html_nodes(p, texts=True, carry=("host",))
    got = {r.page_id: (r.n, r.texts, r.hosts, r.last) for r in n.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("attrs").isNull()).alias("texts"), F.collect_set("host").alias("hosts"), F.max("last").alias("last")).collect()}
    assert got == {0: (10_000, 5_000, ["h0"], 9_999), 2: (2, 1, ["h2"], 1), 3: (18_000, 9_000, ["h3"], 17_999), 4: (3, 0, ["h4"], 2)}
    assert [r.attrs for r in n.where("page_id = 4").orderBy("pos").collect()] == [{}, {"class": "q"}, {}]
    # a batch of the parser is no page, but thousands of rows
    parsed = html.html_nodes(pages(spark, ["<b>x</b>"] * 3_000).coalesce(1)).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), html_schema())
    assert parsed.count() < 10


def html_schema():
    return f"page_id long, {html.NODE}"


def test_gallery_is_parsed_and_judged_once(spark):
    p = pages(spark, ['<meta property="og:image" content="https://a.com/o.jpg"><div class="gallery"><img src="/a_1200x.jpg"></div>'] * 3)
    text = plan(gallery.page_images(p))
    assert "MapInArrow" not in text and text.count("inline(") <= 1


def test_scrape_reads_what_memory_and_fields_ask_for(spark, monkeypatch):
    p = pages(spark, ['<main><h1 class="t"><i>A</i> <b>B</b></h1>' + "<p>x</p>" * 50 + '<em id="e" data-q="7">$9.50</em><u class="price">$9.50</u></main>', "<h1>C</h1>", None]).withColumn("host", F.lit("a.com"))
    memory = spark.createDataFrame([("a.com", "title", 1, "main > h1 b", "text"), ("a.com", "price", 1, "[data-q]", "data-q"), ("a.com", "sku", 1, "#e", "text"), ("b.com", "brand", 1, "u", "text"), ("a.com", "brand", 2, "a[", "text")], "host string, field string, rank int, selector string, attr string")
    sizes, write = [], scrape.written
    monkeypatch.setattr(scrape, "written", lambda df: sizes.append(df.count()) or write(df))
    for mode in ("normal", "compare", "memoryOnly"):
        whole = scrape.scrape(p, memory, mode)
        some = scrape.scrape(p, memory, mode, fields=("title", "price"))
        want = sorted(map(str, whole.where("field IN ('title', 'price')").collect()))
        assert sorted(map(str, some.collect())) == want and len(want) >= 2
    assert sizes == [6, 5] * 3  # main, both h1, b, em (and u): of 57 elements
    every, last = selectors.needed(spark.createDataFrame([("h", "f", 1, "*", "text")], memory.schema))
    assert every("p", {}) and last("p", {"a": "b"})
    every, last = selectors.needed(memory)
    assert every("main", {}) and not last("main", {}) and last("b", {}) and last("p", {"id": "e"}) and not every("p", {"class": "t"})


def test_scrape_compares_in_one_aggregate(spark):
    p = pages(spark, ["<h1>C</h1>"]).withColumn("host", F.lit("a.com"))
    memory = spark.createDataFrame([("a.com", "title", 1, "h1", "text")], "host string, field string, rank int, selector string, attr string")
    assert "count(" not in plan(scrape.scrape(p, memory, "compare", fields=("title",)).select("agree"))
