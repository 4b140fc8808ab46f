"""A stream of products that teaches its own dictionary: each batch is tagged with all that earlier batches have taught.

The dictionary is a series of snapshots, one for each batch, with a list of those that are complete: a snapshot is written first, then
named in the list by one small file, so a reader sees a whole one or none. A batch reads the last one that is older than itself,
whatever has been written since; so a batch that runs again after a failure writes the same again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import tag_type
from ..functions.text import normalize_text
from ..operators.tagging import match_tags

TAGS = "name string, tag_type string"


def latest_before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The newest complete snapshot of an earlier batch."""
    try:
        last = spark.read.schema("batch long").parquet(f"{path}/complete").where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
    except AnalysisException:  # no snapshot yet
        return None
    return None if last is None else spark.read.schema(TAGS).parquet(f"{path}/batch={last}")


def write_snapshot(tags: DataFrame, path: str, batch: int) -> None:
    tags.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    tags.sparkSession.range(batch, batch + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("append").parquet(f"{path}/complete")


def learner(seed: DataFrame, path: str, out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over products (product_id, text, suggested array<string>): writes (product_id, name, tag_type) of the tags that stand
    in the texts to ``out``/batch=N, and a snapshot with the suggested tags that no dictionary has had."""

    def learn(products: DataFrame, batch: int) -> None:
        known = latest_before(products.sparkSession, path, batch)
        tags = seed.select("name", "tag_type") if known is None else known
        match_tags(products, tags, "product_id", "text").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        asked = products.select(F.explode("suggested").alias("name")).select(normalize_text(F.col("name")).alias("name")).where("name <> ''").distinct()
        new = asked.join(tags.select(F.lower("name").alias("name")), "name", "left_anti").select("name", tag_type(F.col("name")).alias("tag_type"))
        write_snapshot(tags.unionByName(new), path, batch)

    return learn


def start(products: DataFrame, seed: DataFrame, path: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    return products.writeStream.foreachBatch(learner(seed, path, out)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
