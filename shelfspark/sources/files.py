"""File sources and sinks: selector memory (JSON), session logs (text), keyed caches with a time to live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_LINE = r"^\[([^\]]+)\] (\w+): (.*)$"


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    """session_id, ts, level, message; the header of each file names its session."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"Session ID: (\S+)", 1).alias("session_id"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    t = t.where(F.col("raw").rlike(LOG_LINE))
    return t.select("session_id", "line", F.regexp_extract("raw", LOG_LINE, 1).try_cast("timestamp").alias("ts"), F.regexp_extract("raw", LOG_LINE, 2).alias("level"), F.regexp_extract("raw", LOG_LINE, 3).alias("message"))


def selector_memory(spark: SparkSession, path: str) -> DataFrame:
    """host, field, selectors, attr from a JSON object for each host; bookkeeping keys are left out."""
    entry = "struct<selectors: array<string>, attr: string>"
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.host").alias("host"), F.from_json("value", f"map<string, string>").alias("m"))
    e = raw.select("host", F.explode("m").alias("field", "json")).where("field NOT IN ('host', 'updated') AND field NOT LIKE '\\_\\_%'")
    return e.select("host", "field", F.from_json("json", entry).alias("e")).select("host", "field", "e.selectors", "e.attr")


def last_history(history: DataFrame, *ties: str, keep: int = 10) -> DataFrame:
    """The last entries of each host, entries of one time in the order of ties."""
    w = Window.partitionBy("host").orderBy(F.desc("ts"), *ties)
    return history.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")


def fresh(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return cache.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def put(cache: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """The cache after new's rows have taken the place of those with their keys."""
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*cache.columns))


def delete(cache: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def delete_fields(memory: DataFrame, gone: DataFrame) -> DataFrame:
    """Selector memory (host, field, ...) without the pairs in gone (host, field; a null field stands for all of its host). A host
    without a field left is gone with its last row."""
    whole, some = gone.where("field IS NULL"), gone.where("field IS NOT NULL")
    return memory.join(whole.select("host").distinct(), "host", "left_anti").join(some.select("host", "field").distinct(), ["host", "field"], "left_anti").select(*memory.columns)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder in spark.checkpoint.dir, from where each of its readers takes its columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder in spark.checkpoint.dir, or what the context has been given; only a session of one process may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and sc.master.split("[")[0] == "local":
            place = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
        if place is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place)
