"""Functions against values worked out by hand, and queries against their SQL in DuckDB."""

import decimal
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import fields, images, text
from shelfspark.operators import catalog as ops
from shelfspark.operators import tagging
from shelfspark.plans import all_queries as catalog
from shelfspark.sources import files, html

DATA = "/root/testdata/sf0.001"


def value(spark, f, *args):
    return spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args)))).select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.slug, "Tools & Hardware", "tools-hardware"), (text.slug, "Men's", "men-s"), (text.space_slug, "slim fit", "slim-fit"), (text.space_slug, "men's", "men's"),
        (text.url_keywords, "https://x.com/women/apparel/jackets/eco-myles-canvas-field-jacket-green/W5BL0BWL372.html", "women apparel jackets eco myles canvas field jacket green"), (text.url_keywords, "https://x.com/headphones/abc", "abc"),
        (text.money_tokens, "$1,234.56", [1234.56]), (text.money_tokens, "€1.234,56", [1234.56]), (text.money_tokens, "€33,99", [33.99]), (text.money_tokens, "$1,234", [1234.0]),
        (text.best_price, "Was $50.00 Now $35.99", 35.99), (text.best_price, "$26 99", 26.99), (text.best_price, "$2699", 26.99), (text.best_price, "$1299", 12.99), (text.best_price, "$1,299", 1299.0), (text.best_price, "See price in cart", None), (text.best_price, "$3", 3.0),
        (text.saved_price, "1,234.56", decimal.Decimal("1234.56")), (text.saved_price, "1.234,56", decimal.Decimal("1.23")),
        (text.best_of_srcset, "a.jpg 700w, b.jpg 1400w", "b.jpg"), (text.best_of_srcset, "a.jpg 1x, b.jpg 2x", "a.jpg"),
        (text.canonical_image_key, "https://c.com/w_500/p/shoe_640x.jpg?v=1#z", "https://c.com//p/shoe.jpg"), (text.split_breadcrumbs, "Ace,Hardware,Tools,Power Tools", ["Ace", "Hardware", "Tools", "Power Tools"]),
        (images.upgrade_cdn, "https://cdn.shopify.com/x_94x.jpg", "https://cdn.shopify.com/x_1020x.jpg"), (images.upgrade_cdn, "https://img.ltwebstatic.com/a_thumbnail_220x293.webp", "https://img.ltwebstatic.com/a.webp"),
        (tagging.genders_in, "for him and his beard", ["men"]), (tagging.genders_in, "Boys and girls", ["women", "men"]), (tagging.genders_in, "the fiancée", ["women", "men"]), (tagging.genders_in, "Shoulder-bag", ["women"]), (ops.phrase_override, "Inflatable tanning bed float", None), (ops.canonical_tag, "stripes", "striped"),
    ],
)
def test_function(spark, f, given, want):
    assert value(spark, f, given) == want


def test_image_score(spark):
    assert value(spark, lambda u: images.image_score(u, F.lit(0), F.lit(False)), "https://cdn.shopify.com/s/files/1/products/shoe_1020x.jpg") == 265
    assert value(spark, lambda u: images.image_score(u, F.lit(20), F.lit(False)), "https://x.com/logo.svg") == 0


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://coach.scene7.com/is/image/a?$desktopThumbnail$", "https://coach.scene7.com/is/image/a?$desktopProductZoom$&wid=2000&qlt=90&op_usm=1.0,1.0,0.0,0"), ("https://mediahub.boohooman.com/a?w=112&h=200", "https://mediahub.boohooman.com/a?w=1000&h=1500"),
        ("https://prodimage.images-bn.com/p/s600x595/a.jpg", "https://prodimage.images-bn.com/p/s600x600/a.jpg"), ("https://www.ikea.com/x/images/a.jpg?f=s", "https://www.ikea.com/x/images/a.jpg?f=xxxl"), ("https://img.kwcdn.com/a/w/800/q/70/b", "https://img.kwcdn.com/a/w/1200/q/90/b"), ("https://a.b/c.jpg?&", "https://a.b/c.jpg"),
    ],
)
def test_cdn(spark, given, want):
    assert value(spark, images.upgrade_cdn, given) == want


def test_paths(spark):
    assert value(spark, lambda c: text.drop_repeats(F.split(c, ",")), "a,a,b,a,b,b") == ["a", "b", "a", "b"]
    score = lambda a, b: value(spark, ops.path_similarity, a, b)
    assert score("Fashion > Clothing > Trousers", "Fashion > Clothing > Pants") == pytest.approx((1 + 1 + 0.9) / 3)
    assert score("Fashion > Top", "Fashion > Tops") == pytest.approx(0.975)
    assert score("Fashion > Top", "Fashion") == 0


def test_gender(spark):
    of = lambda *t: tuple(value(spark, tagging.gender, *t))
    assert of("Women Tops", "Baby Tee", "", "") == ("women", "breadcrumbs", "highest") and of("", "", "", "") == ("unisex", "default", "default")
    assert of("", "men and women", "for boys", "") == ("men", "specs", "medium") and of("", "", "", "", "Fashion > Women") == ("women", "category-path", "fallback")


def test_fields(spark):
    long = "A long and plain description of it"
    assert value(spark, fields.is_fluff, "Shop all the new things here") and not value(spark, fields.is_fluff, long) and value(spark, fields.is_fluff, "short")
    assert value(spark, lambda c: fields.clean_crumbs(F.split(c, "~")), "Home~BackHome~Go to Sale/Men~Shop All~404~x&amp;") == ["Home", "Sale", "Men", "x"]
    assert value(spark, fields.shown_number, "5") == "5" and value(spark, fields.parsed_candidates, '["a", 1, "b"] and more') == ["a", "b"]


def test_images(spark):
    assert value(spark, images.amazon_large, "https://m.media-amazon.com/images/I/81abc._AC_SR116,116_.jpg?x=1") == "https://m.media-amazon.com/images/I/81abc._AC_.jpg"
    assert value(spark, images.amazon_large, "https://m.media-amazon.com/images/I/81a%2Bc._AC_SX300_.jpg") == "https://m.media-amazon.com/images/I/81a+c._AC_SL1500_.jpg"
    assert value(spark, images.amazon_quality, "https://x/I/71a.jpg") == 80 and value(spark, images.pixel_count, "https://x/s300x200/a.jpg") == 60000
    assert value(spark, images.product_keywords, "/women/red-suede-boots-for-2020/AB12.html") == ["suede", "boots", "2020"][:2]
    assert value(spark, lambda u: images.image_score(u, F.lit(0), F.lit(False)), None) is None
    one = spark.createDataFrame([(["card", "x", "y related-items"], ["a", "b", "c", "related"])], "near array<string>, far array<string>")
    assert tuple(one.select(images.among_other_products(F.col("near")), images.among_other_products(F.col("far"))).first()) == (True, False)


def test_confidence(spark):
    assert value(spark, lambda c: ops.confidence(F.split(c, ",")), "colors,materials,fit,styles") == decimal.Decimal("0.50")


def test_compound_material_blocks_its_base(spark):
    p = spark.createDataFrame([(1, "faux leather bag"), (2, None), (3, "")], "id int, t string")
    d = spark.createDataFrame([("faux leather", "materials"), ("leather", "materials")], "name string, tag_type string")
    assert sorted(tuple(r) for r in tagging.match_tags(p, d, "id", "t").collect()) == [(1, "faux leather", "materials"), (1, "faux-leather", "materials")]


def test_html_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a/b", '<title>t</title><meta property="og:title" content="og"><p>a<p>b <a href=x>l</a><script type="application/ld+json">{"@type":"Product"}</script>'), (2, "ftp://x", "<h1>no</h1>"), (3, "http://e", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.page_fields(pages).collect()] == [(1, "og", None, 2, 1)]
    assert html.json_ld_products(pages).count() == 1
    graph = '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Product"],"name":"deep"}]}</script><script type="application/ld+json">{"itemListElement":[{"item":{"@type":"Product","name":"listed"}}]}</script>'
    deep = spark.createDataFrame([(1, "http://a", graph)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.json_ld_products(deep).select("block", F.expr("try_variant_get(ld, '$.name', 'string')")).orderBy("block").collect()] == [(0, "deep"), (1, "listed")]
    (tmp_path / "a.txt").write_text("Session ID: s1\nURL: x\n[2025-10-02T23:08:42.000Z] INFO: hello\n  Call Trace: y\n")
    assert [(r.session_id, r.level, r.message) for r in files.session_logs(spark, str(tmp_path)).collect()] == [("s1", "INFO", "hello")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"host":"a.com","updated":"x","title":{"selectors":["h1"],"attr":"text"},"__history":[]}')
    assert [tuple(r) for r in files.selector_memory(spark, str(tmp_path / "m")).collect()] == [("a.com", "title", ["h1"], "text")]


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dict):
        v = list(v.values())
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.execute(catalog.ORACLE[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(plain([r[c] for c in cols])) for r in rows) == sorted(repr(plain(list(r))) for r in got.fetchall())


def test_many_levels_and_cycles(spark):
    chain = spark.createDataFrame([(i, f"c{i}", i - 1 if i else None, i, 0) for i in range(30)], "category_id int, name string, parent_id int, level int, llm_discovered int")
    assert {r.category_id: r.n for r in ops.subtree_sizes(chain).collect()} == {i: 30 - i for i in range(30)}
    assert max(len(r.path.split(" > ")) for r in ops.category_paths(chain).collect()) == 30
    cycle = spark.createDataFrame([(1, "a", 2, 0, 0), (2, "b", 1, 0, 0)], chain.schema)
    assert ops.category_paths(cycle).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        ops.subtree_sizes(cycle)


def test_hierarchies_have_no_limit_of_rows(spark):
    rows = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        wide = spark.range(100).select(F.col("id").cast("int").alias("category_id"), F.col("id").cast("string").alias("name"), F.when(F.col("id") > 0, 0).cast("int").alias("parent_id"), F.lit(0).alias("level"), F.lit(0).alias("llm_discovered"))
        assert ops.subtree_sizes(wide).agg(F.max("n")).first()[0] == 100 and ops.category_paths(wide).count() == 100 and ops.subtree(wide, "0").count() == 100
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", rows)


def broadcast(df):
    """What stands below the broadcasts of a plan."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return "\n".join(out)


def test_tables_of_products_are_not_broadcast(spark):
    p = spark.range(50).select("id", F.lit("red suede bag, faux").alias("title"))
    found = tagging.match_tags(p, spark.createDataFrame([("red", "colors"), ("suede", "materials")], "name string, tag_type string"), "id", "title")
    assert "Range" not in broadcast(found) and "Scan ExistingRDD" in broadcast(found)
    assert {r.name for r in found.collect()} == {"red", "faux-suede"}


def _texts(parsed) -> list[str]:
    """Texts that a parsed pattern finds, in lower case: every branch, options with and without, the shortest of repeats ('~': any other character)."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            each = [chr(arg).lower()]
        elif kind == "IN":
            each = [next((chr(x if str(o) == "LITERAL" else x[0]).lower() for o, x in arg if str(o) in ("LITERAL", "RANGE")), "0")]
        elif kind == "BRANCH":
            each = [t for b in arg[1] for t in _texts(b)]
        elif kind == "SUBPATTERN":
            each = _texts(arg[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            each = [t * n for t in _texts(arg[2]) for n in {arg[0], max(arg[0], 1)}]
        else:
            each = ["~"] if kind in ("ANY", "NOT_LITERAL") else [""]
        out = [a + b for a in out for b in each]
    return out


@pytest.mark.parametrize("pattern", [*images.NEEDLES, *images.PLAINER])
def test_whatever_a_pattern_finds_holds_one_of_its_literals(pattern):
    plainer = images.PLAINER.get(pattern)
    for t in _texts(re._parser.parse(pattern)):
        assert re.search(plainer, t) if plainer else any(n in t for n in images.NEEDLES[pattern]), t


def test_scores_of_a_ranking_are_computed_once(spark, tmp_path):
    spark.createDataFrame([(1, "red shoe")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("image_ranking", "image_filter_counts", "image_score"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") < 60 and plan.count("|searchburger)") == 1, name


def test_judged(spark):
    rows = [(None, "empty"), ("", "empty"), ("data:image/png;base64,x", "invalid"), ("ftp://a/b.jpg", "invalid"), ("https://a.com/ICON.jpg", "junk"), ("//a.com/" + "x" * 80, "junk"), ("/a/b-123.PNG", "junk"), ("https://a.com/LOGOS/b.jpg", None), ("www.a.com/NAV/99999999999x/b.jpg", None)]
    got = spark.createDataFrame([(u,) for u, _ in rows], "u string").select(F.explode(F.array(images.judged(F.col("u"), F.lit(0), F.lit(None).cast("boolean")))).alias("j")).select("j.*").collect()
    assert [r.why for r in got] == [why for _, why in rows]
    assert [r.score is None for r in got] == [r.why is not None for r in got]
