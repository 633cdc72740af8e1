"""Mention monitor and feedback loop as streams.

Every function takes a streaming DataFrame (or a table) and gives one; ``run_once`` drives it through what is there and ends.
Time-limited de-duplication is by event time. ``dispatches`` keeps the exact rule, where a skipped mention doesn't extend the period, as ``sessions.dispatched_once`` does on a table;
``fresh_mentions`` drops an id seen within the period of the first, at once and without waiting for the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import iso_week, month
from ..operators import sessions
from . import stateful

FEEDBACK = "event string, timestamp string, user_request string, query string, result_paths array<string>, expected_result string, proposed_solution string"


def with_event_time(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark needs a timestamp with a zone; wall times are read in the session's zone."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def both_sources(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """``id, ts, text, source``: a post's text is its title and body, a comment's its body."""
    a = posts.select("id", "ts", F.concat_ws(" ", "title", "body").alias("text"), F.lit("post").alias("source"))
    return a.unionByName(comments.select("id", "ts", F.col("body").alias("text"), F.lit("comment").alias("source")))


def fresh_mentions(rows: DataFrame, keywords: list[str], period: str = "7 days") -> DataFrame:
    """Mentions, each id once within the period; ids are remembered only after a match."""
    found = sessions.mentions(rows, "id", "ts", F.col("text"), keywords)
    return with_event_time(found, "ts", period).dropDuplicatesWithinWatermark(["id"])


def dispatches(rows: DataFrame, keywords: list[str], days: int = 7, delay: str = "1 hour") -> DataFrame:
    """``id, ts`` of the mentions that are dispatched: the first of an id, and any over ``days`` days after its last dispatch."""
    return stateful.dispatched_once(sessions.mentions(rows, "id", "ts", F.col("text"), keywords), days, delay)


def living_months(found: DataFrame, days: int = 90, delay: str = "1 hour") -> DataFrame:
    """Counters by keyword and month that live ``days`` days after their last mention: ``key`` (``keyword:month``), ``ts, n``."""
    each = found.select("ts", F.explode("keywords").alias("keyword"))
    return stateful.living_counts(each, F.concat_ws(":", "keyword", month(F.col("ts"))), "ts", days, delay)


def living_weeks(dispatched: DataFrame, days: int = 14, delay: str = "1 hour") -> DataFrame:
    """Counters of dispatches by ISO week that live ``days`` days after their last: ``key`` (the week), ``ts, n``."""
    return stateful.living_counts(dispatched, iso_week(F.col("ts")), "ts", days, delay)


def monthly_counts(found: DataFrame, late: str = "90 days") -> DataFrame:
    """Counts by keyword and month; state older than ``late`` is dropped."""
    rows = with_event_time(found, "ts", late).select("ts", F.explode("keywords").alias("keyword"))
    return rows.groupBy("keyword", month(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))


def windowed_counts(rows: DataFrame, ts: str, by: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Event-time windows (an addition of this engine): tumbling, or sliding with ``slide``."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return with_event_time(rows, ts, late).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def feedback_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback lines as a stream of rows."""
    return spark.readStream.schema(FEEDBACK).json(folder)


def testbench_cases(feedback: DataFrame) -> DataFrame:
    """Distinct (query, expected) cases of feedback rows that have both."""
    rows = feedback.where((F.coalesce("query", F.lit("")) != "") & (F.coalesce("expected_result", F.lit("")) != ""))
    return rows.select("user_request", "query", F.regexp_replace(F.regexp_replace("expected_result", r"^/+|/+$", ""), r"\.mdx$", "").alias("expected")).dropDuplicates(["query", "expected"])


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is available and stop; a batch that is replayed gets the same number, so sinks can be idempotent."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def append_feedback(rows: DataFrame, folder: str) -> None:
    """Feedback rows appended as JSON lines."""
    rows.select("event", "timestamp", "user_request", "query", "result_paths", "expected_result", "proposed_solution").write.mode("append").json(folder)
