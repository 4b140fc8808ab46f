"""Operators without SQL of their own, on small hand-made inputs; and a stream."""

from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.fields import tag_type
from shelfspark.operators import catalog, extract, logs, reconcile, selection, tagging, taxonomy
from shelfspark.streaming import sessions


def test_merge_twins(spark):
    b = spark.createDataFrame([(1, 1), (1, 10), (2, 2), (3, 14)], "product_id int, category_id int")
    cats, bridges = taxonomy.merge_twins(catalog.categories(spark), b)
    kept = {r.category_id: r.parent_id for r in cats.collect()}
    assert kept[10] is None and 1 not in kept and 2 not in kept and kept[14] == 10 and kept[5] == 10
    assert sorted(tuple(r) for r in bridges.collect()) == [(1, 10), (2, 14), (3, 14)]


def test_selection(spark):
    d = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 2, 30), (1, "b", 3, 30), (1, "a", 4, 5)], "k int, v string, rank int, score int")
    assert selection.majority(d, "k", "v", "rank").first().v == "b"
    assert [r.score for r in selection.bump_largest(d, ["k"], "score", "rank").orderBy("rank").collect()] == [10, 55, 30, 5]
    order = lambda *paths: [r.rank for r in selection.winning_container_first(spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(paths)], "k int, s string, rank int"), "k", "s").orderBy("new_rank").collect()]
    assert order("a > i", "b > i", "b > i", "b > i", "a > i") == [1, 5, 2, 3, 4]  # the first with two, not the commonest
    assert order("a > i", "b > i", None, "c") == [1, 2, 3, 4] == order("x") + [2, 3, 4]  # none has two
    assert order("a > b > i", "z", "a > b > i", "a > b c", "y > i") == [1, 3, 4, 2, 5]  # what begins with it moves
    assert order(*"uvwxyz", "p > i", "p > i") == list(range(1, 9))  # beyond the first six
    row = spark.createDataFrame([(["b", "", "a"], ["a", "c", None])], "x array<string>, y array<string>").select(selection.ordered_union(F.col("x"), F.col("y")).alias("u")).first()
    assert row.u == ["b", "a", "c"]


def test_path_walk_gives_ids(spark):
    known = spark.createDataFrame([(1, "A"), (2, "A > B"), (3, "A > B")], "category_id long, path string")
    walk = spark.createDataFrame([("A > B > C > D",), ("A > B > C",), ("X",), ("A",)], "path string")
    made = {r.path: r for r in taxonomy.create_paths(walk, known).collect()}
    assert set(made) == {"A > B > C", "A > B > C > D", "X"} and made["X"].parent_id is None and made["A > B > C"].parent_id == 2
    assert made["A > B > C > D"].parent_id == made["A > B > C"].category_id and made["A > B > C > D"].level == 3 and made["X"].slug == "x"
    every = known.unionByName(spark.createDataFrame([(r.category_id, r.path) for r in made.values()], "category_id long, path string"))
    assert taxonomy.create_paths(walk, every).count() == 0


def test_reconcile(spark):
    d = spark.createDataFrame([("Layered garment", "Acme, Inc.", "$1,234.50"), ("wool", "x", "12")], "t string, b string, p string")
    got = d.select(tag_type(F.col("t")), reconcile.clean_brand(F.col("b")), reconcile.valid_price(F.col("p")), reconcile.valid_title(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("colors", "Acme", True, True), ("materials", None, False, False)]
    s = spark.createDataFrame([("f", 0, False, True), ("f", 1, True, True), ("f", 2, False, False)], "field string, seq int, validated boolean, success boolean")
    assert [r.seq for r in reconcile.rank_selectors(s, ["field"]).orderBy("rank").collect()] == [1, 0, 2]


def test_logs(spark):
    d = spark.sql("SELECT 's' AS session_id, TIMESTAMP '2025-01-01 00:00:00' AS ts, 'INFO' AS level, 'found: 7 score: -3 https://a/b failed' AS message")
    m = d.select(logs.metadata(F.col("message")).alias("m")).first().m
    assert (m.input_count, m.elements_found, m.score, m.url, m.is_error) == (None, 7, -3, "https://a/b", True)
    assert logs.render(d).first().value == "[2025-01-01T00:00:00.000Z] INFO: found: 7 score: -3 https://a/b failed"
    assert '"errors":1' in logs.report(d).first().report


def test_page_record(spark):
    html = '<title>T</title><h1>Suede Bag</h1><div class="breadcrumb">Home</div><div class=breadcrumb>Suede Bag</div><span class="sale-price">Was $50.00 Now $35.99</span><script type="application/ld+json">{"@type":"Product","brand":{"name":"Acme"},"sku":"S1","offers":[{"price":"40"}]}</script>'
    d = spark.createDataFrame([(1, "http://a/b", html), (2, "http://a/c", None), (3, "http://a/d", '<h1>x</h1><script type="application/ld+json">{bad</script>')], "page_id long, url string, html string")
    rows = {r.page_id: r for r in extract.page_record(d).collect()}
    assert tuple(rows[1]) == (1, "Suede Bag", "Acme", "S1", None, 35.99, ["Home"], True)
    assert rows[3].title == "x" and not rows[3].is_product_page and 2 not in rows


def test_match_categories(spark):
    rows = [(1, "Hazel Slouchy Suede Bag", ""), (2, None, ""), (3, "High Heel with Hardware", ""), (4, "short sleeve tee", ""), (5, "two bags", "a purse")]
    p = spark.createDataFrame(rows, "id int, t string, d string")
    got = tagging.match_categories(p, catalog.categories(spark), "id", {"title": "t", "description": "d"}, {"purse": "Handbag"}).collect()
    assert sorted((r.id, r.category_id, r.score) for r in got) == [(1, 3, 1030), (1, 4, 5040), (5, 3, 1030), (5, 4, 90)]


def test_best_path_on_ties_and_odd_rows(spark):
    paths = spark.createDataFrame([("A > Pants",), ("A > Trousers",), ("B",)], "path string")
    s = spark.createDataFrame([("A > trouser",), ("C",), (None,)], "path string")
    assert [tuple(r) for r in catalog.best_path(s, paths).collect()] == [("A > trouser", "A > Trousers", 0.975)]


def test_confidence_stays_in_range(spark):
    every = spark.createDataFrame([(list(rules.CONFIDENCE),)], "t array<string>")
    assert float(every.select(catalog.confidence(F.col("t"))).first()[0]) == 0.95


def test_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS user_id, TIMESTAMP '2025-01-01 00:00:00' AS ts UNION ALL SELECT 1L, TIMESTAMP '2025-01-01 00:10:00' UNION ALL SELECT 1L, TIMESTAMP '2025-01-01 09:00:00'").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.session_summary(s).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("sessions_out").collect()] == [2]  # the later session is still open
