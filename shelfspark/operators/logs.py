"""Log analytics: fields of a message, summaries, rendered sessions, a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata(message: Column) -> Column:
    """Fields that a message names; null where it names none."""
    number = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("int")
    return F.struct(
        number(r"(?i)input(?: count)?[:=]\s*(\d+)").alias("input_count"), number(r"(?i)(?:found|elements)[:=]?\s*(\d+)").alias("elements_found"), number(r"(?i)score[:=]?\s*(-?\d+)").alias("score"),
        F.nullif(F.regexp_extract(message, r"(https?://\S+)", 1), F.lit("")).alias("url"), message.rlike("(?i)error|fail").alias("is_error"), message.rlike("(?i)block|reject|filter").alias("is_rejection"),
    )


def summary(log: DataFrame, key: str, rejections: int = 10, errors: int = 5) -> DataFrame:
    """Of each key the counts by kind, start and end, and its last rejections and errors in order of time. Only these few rows a
    key are gathered, after a window has ranked them."""
    m = metadata(F.col("message"))
    d = log.withColumns({"is_error": m["is_error"], "is_rejection": m["is_rejection"]})
    counts = d.groupBy(key).agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.count_if("is_rejection").alias("rejections"), F.min("ts").alias("started"), F.max("ts").alias("ended"))

    def last(kind: str, n: int, name: str) -> DataFrame:
        r = d.where(kind).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("message")))).where(F.col("r") <= n)
        return r.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "message"))), lambda x: x["message"]).alias(name))

    out = counts.join(last("is_rejection", rejections, "last_rejections"), key, "left").join(last("is_error", errors, "last_errors"), key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("last_rejections", "last_errors")})


def render(log: DataFrame) -> DataFrame:
    """Lines of a session file, for write.partitionBy('session_id').text()."""
    return log.select("session_id", F.format_string("[%s] %s: %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "level", "message").alias("value"))


def report(log: DataFrame) -> DataFrame:
    """One row of JSON."""
    m = metadata(F.col("message"))
    a = log.agg(F.count("*").alias("total"), F.count_if(m["is_error"]).alias("errors"), F.count_if(m["is_rejection"]).alias("rejections"), F.count_if(F.col("level") == "SUCCESS").alias("successes"))
    return a.select(F.to_json(F.struct("*")).alias("report"))
