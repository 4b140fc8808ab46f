"""Streams that keep something: a dictionary that learns, a cache whose entries expire."""

import pytest
from pyspark.sql import functions as F

from shelfspark.streaming import learning, ttl_cache

PRODUCTS = "product_id long, text string, suggested array<string>"


def test_a_tag_learnt_in_one_batch_matches_in_the_next(spark, tmp_path):
    seed = spark.createDataFrame([("wool", "materials")], learning.TAGS)
    run = lambda: learning.start(spark.readStream.schema(PRODUCTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), seed, f"{tmp_path}/tags", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    put = lambda *rows: spark.createDataFrame(rows, PRODUCTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, "a wool coat in boucle", ["Boucle ", "WOOL", ""]))
    run()
    put((2, "boucle chairs, one wool", None))
    run()
    out = {(r.batch, r.product_id, r.name) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {(0, 1, "wool"), (1, 2, "wool"), (1, 2, "boucle")}
    # the same batch again, as after a failure, reads what it read and writes what it wrote
    learning.learner(seed, f"{tmp_path}/tags", f"{tmp_path}/out")(spark.createDataFrame([(1, "a wool coat in boucle", ["Boucle "])], PRODUCTS), 0)
    assert {(r.batch, r.product_id, r.name) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == out
    assert learning.latest_before(spark, f"{tmp_path}/tags", 2).count() == 2 and learning.latest_before(spark, f"{tmp_path}/tags", 0) is None


def test_a_snapshot_that_is_not_complete_is_not_read(spark, tmp_path):
    tags = spark.createDataFrame([("wool", "materials")], learning.TAGS)
    learning.write_snapshot(tags, f"{tmp_path}/t", 0)
    tags.union(tags).write.parquet(f"{tmp_path}/t/batch=1")  # written, not named
    assert learning.latest_before(spark, f"{tmp_path}/t", 5).count() == 1


def test_entries_expire_and_survive_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def write(*rows):
            spark.createDataFrame(rows, "url string, value string, at string").select("url", "value", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            s = spark.readStream.schema("url string, value string, ts timestamp").parquet(f"{tmp_path}/in")
            q = ttl_cache.ttl_cache(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)

        write(("a", "1", "2025-01-01 00:00:00"), ("b", "1", "2025-01-01 00:00:00"))
        write(("b", "2", "2025-01-05 00:00:00"), ("b", "late", "2025-01-04 00:00:00"))  # b lives on
        write(("c", "1", "2025-01-08 02:00:00"))  # a's seven days are over, by the watermark
        write(("d", "1", "2025-01-08 03:00:00"))
        got = {(r.url, r.event, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == {("a", "put", "1"), ("b", "put", "1"), ("b", "replaced", "2"), ("a", "evicted", "1"), ("c", "put", "1"), ("d", "put", "1")}
    finally:
        spark.conf.unset(provider)
