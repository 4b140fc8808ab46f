"""Nodes as intervals, selectors, roots, trimming and specifications: by brute force on random pages, and on odd ones."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import breadcrumbs, catalog, dom, extract, gallery, heuristics, scrape, selectors, sku, specs, tagger
from shelfspark.sources import files, html


def pages(spark, htmls, url="https://a.com/x"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def random_page(r):
    def element(depth):
        tag = r.choice(["div", "span", "section", "b", "ul", "em"])
        attrs = "".join(r.choice(["", f' class="{" ".join(r.choices(["a", "b", "c-d"], k=2))}"', f' id="i{r.randint(0, 3)}"', f' data-x="{r.choice(["one two", "en-GB", "Two"])}"']) for _ in range(2))
        inner = "".join(r.choice(["", "t ", "x&amp;y "]) + (element(depth + 1) if depth < 5 and r.random() < 0.7 else "") for _ in range(r.randint(0, 3)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "".join(element(0) for _ in range(r.randint(1, 4)))


@pytest.fixture(scope="module")
def random_pages(spark):
    r = random.Random(8)
    return pages(spark, [random_page(r) for _ in range(40)])


def by_page(nodes):
    out = {}
    for n in nodes.collect():
        out.setdefault(n.page_id, {})[n.pos] = n
    return out


def test_intervals_texts_and_counts(random_pages):
    n = html.html_nodes(random_pages, texts=True).cache()
    counts = {(r.page_id, r.pos): (r.spans, r.texts) for r in dom.counts_below(n, {"spans": F.col("tag") == "span", "texts": F.col("tag") == "#text"}).collect()}
    below = {(r.page_id, r.pos): r.content for r in dom.subtree_text(n.where("tag <> '#text'").select("page_id", "pos", "last"), n).collect()}
    for page, nodes in by_page(n).items():
        for pos, x in nodes.items():
            inside = [y for y in nodes.values() if pos < y.pos <= x.last]
            for y in inside:  # exactly the descendants
                up = y
                while up.parent > pos:
                    up = nodes[up.parent]
                assert up.parent == pos
            assert counts[page, pos] == (sum(y.tag == "span" for y in inside), sum(y.tag == "#text" for y in inside))
            if x.tag != "#text":
                assert x.content == "".join(y.content for y in sorted(inside, key=lambda y: y.pos) if y.tag == "#text") == below.get((page, pos), "")
                assert x.chars == len(x.content.strip())
                assert x.nth == sum(y.tag != "#text" and y.parent == x.parent and y.pos <= pos for y in nodes.values())


SELECTORS = [
    "div", "*", ".a", "#i1", "div.a.b", "[data-x]", '[data-x="one two"]', "[data-x~=two]", "[data-x|=en]", "[data-x^='on']", "[data-x$=GB]", "[data-x*=wo]", "[data-x*=WO i]", "div span", "div > span", "div + span", "div ~ span", "section div > b.a span", "div, em.b",
    "ul > :first-child", "span:nth-child(2)", ".a .a .a", ".a > .b ~ * em", "div + div + *", "span span > b, ul em", "#i1 #i2",
]


def brute(nodes, steps):
    """Elements that a parsed selector selects, by looking at every element's relatives."""
    def fits(x, s):
        classes = x.attrs.get("class", "").split()
        return (not s["tag"] or x.tag == s["tag"]) and (not s["id"] or x.attrs.get("id") == s["id"]) and set(s["classes"]) <= set(classes) and all(selectors._holds(x.attrs.get(a), *v) for a, *v in s["attrs"]) and s["nth"] in (None, x.nth)

    def relatives(x, how):
        if how == "child":
            return [nodes[x.parent]] if x.parent >= 0 else []
        if how == "descendant":
            return [y for y in nodes.values() if y.pos < x.pos <= y.last]
        return [y for y in nodes.values() if y.parent == x.parent and (y.nth == x.nth - 1 if how == "next" else y.nth < x.nth)]

    def ok(x, k):
        return fits(x, steps[k]) and (k == 0 or any(ok(y, k - 1) for y in relatives(x, steps[k]["join"])))

    return {x.pos for x in nodes.values() if ok(x, len(steps) - 1)}


def test_selectors_by_brute_force(spark, random_pages):
    host = random_pages.withColumn("host", F.when(F.col("page_id") % 2 == 0, "even.com").otherwise("odd.com"))
    nodes = html.html_nodes(host, carry=("host",)).cache()
    hosts = {r.page_id: r.host for r in host.collect()}
    stored = spark.createDataFrame([(h, "f", i, s, "text") for i, s in enumerate(SELECTORS) for h in ("even.com", "odd.com") if not (h == "odd.com" and i == 0)] + [("even.com", "f", 99, "a[", "text"), ("even.com", "f", 98, None, "text")], "host string, field string, rank int, selector string, attr string")
    got = {}
    for r in selectors.select(nodes, stored).collect():
        got.setdefault((r.page_id, r.rank), set()).add(r.pos)
    want = {}
    for page, own in by_page(nodes).items():
        for i, s in enumerate(SELECTORS):
            found = set().union(*[brute(own, steps) for steps in selectors.parse(s)])
            if found and not (hosts[page] == "odd.com" and i == 0):
                want[page, i] = found
    assert got == want and len(want) > 300


def test_fixed_selectors_agree(random_pages):
    """The parser's predicate, the column, and the stored form read a compound alike."""
    one = [s for s in SELECTORS if not set(" >+~,:") & set(s.split("[")[0])]
    nodes = html.html_nodes(random_pages)
    rows = nodes.select("tag", "attrs", *[selectors.matches(s).alias(f"c{i}") for i, s in enumerate(one)]).collect()
    assert all(r[f"c{i}"] == selectors.wants(s)(r.tag, r.attrs) for i, s in enumerate(one) for r in rows)
    assert sum(r.c0 for r in rows) == html.html_nodes(random_pages, keep=selectors.wants(one[0])).count()


@pytest.mark.parametrize("bad", ["", "a[", "> a", "a >", "a,", "a::before", "a:hover", ".", "a b[c"])
def test_selectors_that_cannot_be_read(bad):
    with pytest.raises(ValueError):
        selectors.parse(bad)


def test_first_stored_selector_with_a_value(spark):
    p = pages(spark, ['<h1> </h1><h2 title="">Two <i>words</i></h2><img src=""><img src="b.jpg"><img src="c.jpg">', None, ""]).withColumn("host", F.lit("a.com"))
    stored = spark.createDataFrame([("a.com", "title", 1, "h1", "text"), ("a.com", "title", 2, "h2", "title"), ("a.com", "images", 1, "img", "src"), ("b.com", "title", 0, "h2", "text")], "host string, field string, rank int, selector string, attr string")
    n = html.html_nodes(p, texts=True, carry=("host",))
    got = {r.field: (r.selector, r.value, r["values"], r.n) for r in selectors.first_values(selectors.select(n, stored), n).collect()}
    assert got == {"title": ("h2", "Two words", ["Two words"], 1), "images": ("img", "b.jpg", ["b.jpg", "c.jpg"], 2)}
    assert selectors.select(n, stored.limit(0)).count() == 0


def test_text_of_nested_elements_in_fields(spark):
    p = pages(spark, ['<title>Shop</title><h1><span>Nike</span> <b>Air</b></h1><div class="price"><span>$</span><span>35.99</span></div><img src=x>', "<h1>cut<script>var a = '", "<p>one<ul><li>two<li>three</ul>four"])
    assert html.page_fields(p).where("page_id = 0").first().title == "Nike Air"
    r = extract.page_record(p).where("page_id = 0").first()
    assert (r.title, r.price, r.is_product_page) == ("Nike Air", 35.99, True)
    n = {(r.page_id, r.tag, r.nth): r.content for r in html.html_nodes(p).collect()}
    assert n[1, "script", 1] == "var a = '" and n[2, "p", 1] == "one" and n[2, "li", 1] == "two" and n[2, "li", 2] == "three"


def test_products_at_any_depth(spark):
    inner = '{"@type":"Product","name":"deep"}'
    for i in range(40):
        inner = f'[{{"x{i}":{inner}}}]'
    p = pages(spark, [f'<script type="application/ld+json">{inner}</script><script type="application/ld+json">{{"@type":["A","Product"],"name":"p","isRelatedTo":{{"@type":"Product"}}}}</script><script type="application/ld+json">{{]</script>'])
    rows = html.json_ld_products(p).select("block", F.expr("try_variant_get(ld, '$.name', 'string')").alias("name")).collect()
    assert sorted(map(tuple, rows)) == [(0, "deep"), (1, "p")]


IMG = "<img src=a>"
WORDS = "word " * 30


def roots(spark, *htmls):
    return {r.page_id: (r.tier, r.tag) for r in dom.product_roots(pages(spark, htmls)).collect()}


def test_roots(spark):
    assert roots(
        spark,
        f"<body><nav itemtype='x/Product'>{IMG}{WORDS}</nav><section>{IMG}{WORDS}</section></body>",  # marked, but navigation: the densest
        f"<body><div><div><p>{WORDS}</p>{IMG}{IMG}</div>{IMG}{WORDS}</div></body>",  # the outer one has more images
        f"<body><div>{IMG}{WORDS}</div><div>{IMG}{WORDS}</div></body>",  # a tie: the first
        f"<body><div>{IMG}{IMG}{WORDS}<nav></nav></div></body>",  # nothing scores above 0
        "<body><article><i class=price></i><i class=cost></i><b>Buy</b> now</article></body>",  # a phrase across elements
        "<body><article><i class=price></i></article><div class=pdp><i class=price></i><i class=option></i><i data-zoom></i></div></body>",
        "no body", None,
    ) == {0: (5, "section"), 1: (5, "div"), 2: (5, "div"), 3: (6, "body"), 4: (3, "article"), 5: (4, "div")}
    r = dom.product_roots(pages(spark, [f"<body><div>{IMG}{WORDS}</div><div>{IMG}{WORDS}</div></body>"])).first()
    assert (r.pos, r.score) == (1, 5)


def test_trimming(spark):
    long = "x" * 600
    p = pages(spark, [
        f'<body><p title="a&quot;b">1 &lt; 2 &amp; 3</p><div class="menu x"><b>no</b></div><p>{long}<!-- c -->{long}</p><p>{long}<br></p><a>' + "<a>".join(["l<i>i</i></a>"] * 25) + "<div>" + "<img>" * 6 + "<header><img></header>" + "<img>" * 6 + "</div><style>s</style></body>",
        "<body></body>", "<div>none</div>",
    ])
    got = {r.page_id: r for r in dom.trim_pages(p).collect()}
    want = f'<body><p title="a&quot;b">1 &lt; 2 &amp; 3</p><p>{"x" * 500}...</p><p>{long}<br></p>' + "<a>l<i>i</i></a>" * 20 + "<div>" + "<img>" * 10 + "</div></body>"
    assert got[0].trimmed == want and got[0].chars_after == len(want) and got[1].trimmed == "<body></body>" and set(got) == {0, 1}


def test_specifications(spark):
    table = "<tr><th> A </th><td>1</td></tr><tr><td><b>B: 2</b></td></tr><tr><th></th><td>x</td></tr>"
    p = pages(spark, [
        f"<table class=specs>{table}</table>", f"<div data-test=spec><ul><li>alone</ul></div><div id=Specification><table>{table}</table><ul><li>Width 3 cm</li><li>Shop all</li><li>ab</li><li>{'l' * 200}</li></ul></div>",
        "<div class=specs><tr><th>A</th><td>1</td></tr></div>", "<div class=my-SPEC><div role=region><li>one line</li></div><div aria-expanded><li>first</li><li>second</li></div></div>", None, "",
    ])
    got = {r.page_id: (r.method, r.specs) for r in specs.specifications(p).collect()}
    assert got == {0: ("class-pattern", "A: 1\nB: 2"), 1: ("data-attribute", "B: 2\nWidth 3 cm"), 3: ("accordion", "first\nsecond")}


def test_empty_tables(spark):
    none = pages(spark, ["x"]).limit(0)
    assert dom.trim_pages(none).count() == dom.product_roots(none).count() == specs.specifications(none).count() == 0


def crumbs(spark, *htmls):
    return {r.page_id: (r.method, r["items"]) for r in breadcrumbs.breadcrumbs(pages(spark, htmls)).collect()}


def test_breadcrumbs(spark):
    a = "<a>Women</a><a>Shoes</a>"
    assert crumbs(
        spark,
        f'<script type="application/ld+json">{{"@type":"BreadcrumbList","itemListElement":[{{"name":"Home"}},{{"name":"Bags"}}]}}</script><div class="breadcrumb">{a}</div>',  # one crumb is none
        '<script type="application/ld+json">{"@type":["x","BreadcrumbList"],"itemListElement":[{"name":""},{"item":{"name":"Bags"}},{"name":"Tote"}]}</script>',
        '<ol aria-label="BREADCRUMB"><li><span itemprop="name">Women</span><a>help</a></li><li><span itemprop="name">Shoes</span><a>help</a></li></ol>',  # names before links
        '<nav role="navigation"><p>x<ul><li><a>Women <i>(3)</i></a></li><li><a><i>Shoes</i></a></li></ul></nav>',  # a list in a navigation; own text first
        f'<div class="breadcrumb"><a>one</a></div><p class="breadcrumbs">{a}</p>',  # only the first element of a selector is looked at
        f'<div class="footer"><div>{a}</div></div><div id="menu">{a}</div><div>{"<a>x</a>" * 9}</div><section><div><a>Sale</a>{a}</div><ul><li><a>Men</a></li><li><a>Hats</a></li></ul></section>',
        "<div><a>Women</a></div>", None, "",
    ) == {0: ("class-pattern", ["Women", "Shoes"]), 1: ("jsonld", ["Bags", "Tote"]), 2: ("semantic", ["Women", "Shoes"]), 3: ("semantic", ["Women", "Shoes"]), 5: ("structural", ["Men", "Hats"])}


CDN = "https://cdn.shopify.com/s/files/1/products"


def test_gallery_candidates(spark):
    p = pages(spark, [
        f'<div class="gallery"><img src="" data-src="{CDN}/a_1200x.jpg" srcset="{CDN}/b_400x.jpg 400w, {CDN}/c_900x.jpg 900w"><picture><source srcset="{CDN}/s.jpg 1x"><source data-srcset="{CDN}/t.jpg"><img data-zoom-image="//cdn.shopify.com/z.jpg"></picture></div>'
        f'<section class="you-might also"><div><img class="image__img" src="{CDN}/r.jpg"></div></section><div class="similar"><b><i><u><img id="zoomImage" src="/far.jpg"></u></i></b></div>',
        f'<img src="{CDN}/only_1200x.jpg">', "", None,
    ], "https://shop.com/p/1")
    rows = gallery.candidates(p).orderBy("page_id", "fallback", "pos").collect()
    got = [(r.selector, r.url.rsplit("/", 1)[1], r.from_srcset, r.from_zoom) for r in rows if r.page_id == 0 and not r.fallback]
    assert [x[1:] for x in got] == [("a_1200x.jpg", False, False), ("c_1020x.jpg", True, False), ("z.jpg", False, True), ("s.jpg", True, False), ("t.jpg", True, False)] * 2 + [("far.jpg", False, False)] + [(f"{x}.jpg", True, False) for x in "ssttst"] * 2
    assert got[0][0] == ".gallery img" and got[5][0] == "[class*=gallery] img" and got[10][0] == "#zoomImage"
    assert [r.selector for r in rows if r.page_id == 1] == ["img"] and {r.page_id for r in rows} == {0, 1}
    audit = catalog.ImageAudit()
    ranked = gallery.page_images(p, audit=audit).collect()
    assert {(r.page_id, r.method) for r in ranked} == {(0, "gallery-combined"), (1, "generic-fallback")}
    assert [r.rank for r in ranked if r.page_id == 0] == sorted(r.rank for r in ranked if r.page_id == 0)


def test_audit_counts(spark):
    urls = [None, "", "data:image/png;base64,x", "https://a.com/logo.png", f"{CDN}/a_1200x.jpg", f"{CDN}/a_600x.jpg", "https://b.com/x_94x.jpg", "https://b.com/media/y.jpg"]
    df = spark.createDataFrame([(1, i, u, False) for i, u in enumerate(urls)], "page_id int, pos int, url string, from_srcset boolean")
    audit = catalog.ImageAudit()
    n = len(catalog.rank_images(df, audit=audit).collect())
    c = audit.counts()
    assert (c["empty"], c["invalid"], c["junk"], c["duplicate_groups"], c["kept"]) == (2, 1, 1, 1, n) and sum(c.values()) - c["duplicate_groups"] + 1 == len(urls)


def test_tagger_on_odd_products(spark):
    rows = [(1, None, None, None, None, None, None, None), (2, "", "", [], "", "", "", ""), (3, "phone case for kids", "https://a.com/red-wool-thing", ["Home", "phone case for kids"], '{"color":"blue"}', "stripes, wool", "x", "a teen girl")]
    p = spark.createDataFrame(rows, "product_id int, title string, url string, breadcrumbs array<string>, json_ld string, specs string, brand string, description string")
    tags = spark.createDataFrame([("red", "colors"), ("blue", "colors"), ("wool", "materials"), ("stripe", "patterns"), ("odd", "no-such-type")], "name string, tag_type string")
    cats = spark.createDataFrame([(1, "Fashion", None, 0, 0)], "category_id int, name string, parent_id int, level int, llm_discovered int")
    got = {r.product_id: r for r in tagger.tag_products(p, tags, cats).collect()}
    for i in (1, 2):
        assert (got[i].primary_category, got[i].gender, [tuple(t) for t in got[i].tags], got[i].matched, got[i].needs_enrichment) == (None, "unisex", [("unisex", "demographic")], [], True)
    r = got[3]  # an overriding phrase; electronics are unisex and know no patterns; the URL's colour stands first
    assert (r.primary_category, r.gender) == ("Electronics > Mobile Accessories > Cases", "unisex")
    assert [tuple(t) for t in r.tags] == [("red", "colors"), ("wool", "materials"), ("unisex", "demographic"), ("kids", "demographic")] and float(r.confidence) == 0.25


def test_scrape_modes(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"From data","offers":{"price":"7","priceCurrency":"USD"}}</script>'
    p = pages(spark, [f"<title>t</title>{ld}<h1>Heading</h1><b class=price>$9.50</b>", "<h1>Heading</h1><b class=price>$9.50</b>", None]).withColumn("host", F.lit("a.com"))
    memory = spark.createDataFrame([("a.com", "title", 1, scrape.LD, "text"), ("a.com", "price", 1, ".none", "text"), ("a.com", "price", 2, ".price", "text"), ("b.com", "title", 1, "title", "text")], "host string, field string, rank int, selector string, attr string")
    site = spark.createDataFrame([(1, "title", "By the site"), (1, "price", "1.0"), (0, "title", "")], "page_id long, field string, value string")
    all_of = lambda *a: {(r.page_id, r.field): (r.value, r.source, r.selector) for r in scrape.scrape(p, memory, *a).collect()}
    assert all_of("normal", site) == {(0, "title"): ("From data", "memory", scrape.LD), (0, "price"): ("9.5", "memory", ".price"), (1, "title"): ("By the site", "site", None), (1, "price"): ("9.5", "memory", ".price")}
    assert all_of("memoryOnly", site) == {(0, "title"): ("From data", "memory", scrape.LD), (0, "price"): ("9.5", "memory", ".price"), (1, "price"): ("9.5", "memory", ".price")}
    both = {(r.page_id, r.field): (r.memory, r.site, r.generic, r.agree) for r in scrape.scrape(p, memory, "compare", site).collect()}
    assert both[0, "title"] == ("From data", None, "Heading", False) and both[0, "price"][-1] and both[1, "price"] == ("9.5", "1.0", "9.5", False)


def test_good_fields(spark):
    p = pages(spark, [
        "<body><h1>Sign In</h1><i itemprop=name>abc</i><meta property='og:title' content='A fine title'></body>",  # the first marked is too short, the heading navigates
        "<body><b data-price=1>$</b><b class=price data-value=7>x</b><b itemprop=brand content=no>By Us</b></body>", None,
    ])
    got = {(r.page_id, r.field): (r.selector, r.value) for r in heuristics.good_fields(p).collect()}
    assert got == {(1, "price"): (".price[data-value]", "7"), (1, "brand"): ('[itemprop="brand"]', "By Us")}
    assert {r.page_id: r.fields for r in heuristics.fields_for_model(p).collect()} == {0: list(heuristics.FIELDS), 1: ["title", "description", "images"], 2: list(heuristics.FIELDS)}


def test_skus(spark):
    p = pages(spark, ['<div class=product data-product-id=own><input name=sku value=""><input name=sku value=2><input name=productId value=" P 3 "></div>', "<body><p class=sku>Style: AB-12 or SKU : ab</p></body>", None, "<div class=product-info>UPC 12345</div>"])
    # the first input of a name has no value, and the next name's has; a page without body or container has nothing below it; the container is not looked at itself
    assert {r.page_id: (r.sku, r.method) for r in sku.skus(p).collect()} == {0: ("P 3", "dom-attr"), 1: ("AB-12", "pattern")}


def test_references_are_read_as_browsers_do(spark):
    n = html.html_nodes(pages(spark, ['<h1>a &amp;&amp</h1><p title="x&amp">&quot;b&quot; c&lt; &nosuch; &</p>']))
    assert {r.tag: (r.content, r.attrs) for r in n.collect()} == {"h1": ("a &&", {}), "p": ('"b" c< &nosuch; &', {"title": "x&"})}


def test_pages_are_parsed_once_and_never_broadcast(spark):
    p = pages(spark, ['<main class="product"><h1>A</h1><ul class="specs"><li>one: 1</li></ul><div class="gallery"><img src="/a.jpg"></div></main>'] * 3)
    memory = spark.createDataFrame([("a.com", "title", 1, "main > h1", "text")], "host string, field string, rank int, selector string, attr string")
    nodes = files.written(html.html_nodes(p.withColumn("host", F.lit("a.com")), carry=("host",)))
    made = {"roots": dom.product_roots(p), "specs": specs.specifications(p), "crumbs": breadcrumbs.breadcrumbs(p), "skus": sku.skus(p), "selected": selectors.select(nodes, memory), "trimmed": dom.trim_pages(p)}
    for name, df in made.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, name  # all read what has been written
        assert name == "selected" or "BroadcastExchange" not in plan, name  # there, only the steps of selectors are
    assert "BroadcastExchange" not in heuristics.good_fields(p)._jdf.queryExecution().executedPlan().toString()
    assert made["selected"].count() == 3


def test_pages_of_a_compact_file_are_dealt_to_tasks(spark):
    from shelfspark.plans import dom as plans

    assert plans.shop_pages(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 8
    assert plans.shop_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
