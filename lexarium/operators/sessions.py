"""Agent event sessions and keyword mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import iso_week, month
from ..functions.text import keywords_in

EVENT = "type string, data struct<turn:string,text:string,tool:string,call:string,ok:boolean,tokens:long,code:int>"


def bounded_lines(rows: DataFrame, session: str, raw: str, most_bytes: int, most_lines: int) -> DataFrame:
    """Lines of event texts with their physical numbers: blank lines count but go; lines beyond either budget go."""
    lines = rows.select(session, F.posexplode(F.split(raw, "\r?\n")).alias("i", "line"))
    w = Window.partitionBy(session).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("_bytes", F.sum(F.octet_length("line") + 1).over(w))
    return cut.where((F.col("_bytes") <= most_bytes) & (F.col("i") < most_lines) & (F.trim("line") != "")).select(session, (F.col("i") + 1).cast("long").alias("number"), "line")


def parsed(lines: DataFrame) -> DataFrame:
    """Events of JSON lines, only the fields that are used; ``bad`` where a line isn't an object."""
    return lines.withColumn("event", F.from_json("line", EVENT)).withColumn("bad", F.col("event.type").isNull()).select("*", "event.type", "event.data").drop("event")


def metrics(events: DataFrame, session: str) -> DataFrame:
    """Per session: distinct turns, tool calls and errors, tokens, last nonempty message, result, and what is wrong.

    Events after the first ``result`` aren't counted but are an error; so are tool ends without a start, and an answer before the last successful tool."""
    w = Window.partitionBy(session)
    marked = events.withColumn("_end", F.min(F.when(F.col("type") == "result", F.col("number"))).over(w))
    live = (F.col("_end").isNull()) | (F.col("number") <= F.col("_end"))
    is_type = lambda t: live & (F.col("type") == t)
    message = is_type("message") & (F.coalesce("data.text", F.lit("")) != "")
    done = is_type("tool_end") & F.coalesce("data.ok", F.lit(False))
    out = marked.groupBy(session).agg(
        F.countDistinct(F.when(is_type("turn"), F.col("data.turn"))).alias("turns"),
        F.count_if(is_type("tool_start")).alias("tool_calls"),
        F.count_if(is_type("tool_end") & ~F.coalesce("data.ok", F.lit(False))).alias("tool_errors"),
        F.coalesce(F.sum(F.when(live, F.col("data.tokens"))), F.lit(0)).alias("tokens"),
        F.max_by("data.text", F.when(message, F.col("number"))).alias("answer"),
        F.max(F.when(message, F.col("number"))).alias("_answer_line"),
        F.max(F.when(done, F.col("number"))).alias("_tool_line"),
        F.max(F.when(is_type("result"), F.col("data.code"))).alias("code"),
        F.count_if(~live).alias("after_result"),
        F.count_if("bad").alias("bad_lines"),
    )
    late = F.coalesce(F.col("_answer_line") < F.col("_tool_line"), F.lit(False))
    rules = [F.when(F.col("bad_lines") > 0, "bad-line"), F.when(F.col("after_result") > 0, "after-result"), F.when(F.col("code").isNull(), "no-result"), F.when(late, "answer-before-tool")]
    return out.withColumn("errors", F.array_compact(F.array(*rules))).drop("_answer_line", "_tool_line")


def paired_tools(events: DataFrame, session: str) -> DataFrame:
    """Every call with ``outcome``: paired, orphan (no start), open (no end), repeated, or renamed."""
    one = lambda t, n: events.where(F.col("type") == t).groupBy(session, F.col("data.call").alias("call")).agg(F.count("*").alias(n), F.min("data.tool").alias(f"{n}_tool"))
    both = one("tool_start", "starts").join(one("tool_end", "ends"), [session, "call"], "full_outer")
    outcome = (
        F.when(F.col("starts").isNull(), "orphan").when(F.col("ends").isNull(), "open").when((F.col("starts") > 1) | (F.col("ends") > 1), "repeated")
        .when(F.col("ends_tool").isNotNull() & (F.col("ends_tool") != F.col("starts_tool")), "renamed").otherwise("paired")
    )
    return both.select(session, "call", outcome.alias("outcome"))


def mentions(rows: DataFrame, id_col: str, ts: str, text: Column, keywords: list[str]) -> DataFrame:
    """Rows that name a keyword: ``id, ts, keywords``. Works on a stream as on a table."""
    found = keywords_in(text, F.array(*map(F.lit, keywords)))
    return rows.select(F.col(id_col).alias("id"), F.col(ts).alias("ts"), found.alias("keywords")).where(F.size("keywords") > 0)


#: Keywords of one automaton; more are several passes.
AUTOMATON = 200_000


def keyword_hits(rows: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """``key, keyword`` for every keyword (``keyword``, distinct, of any number) that a text has as a substring whatever the case, by ``F.lower``.

    An automaton of all keywords goes through a text once, however many they are, in place of a search a keyword; rows give each keyword once."""
    listed = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    parts = max(1, -(-listed.count() // AUTOMATON))
    kind = rows.schema[key].dataType.simpleString()
    lower = rows.select(key, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    out = None
    for i in range(parts):
        words = [r["keyword"] for r in listed.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == i).collect()]  # about ``AUTOMATON``
        sent = rows.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in sent.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    hits = {w for _, w in automaton.iter(t)} if sent.value else ()
                    at += [n] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [key, "keyword"])

        part = lower.mapInArrow(run, f"`{key}` {kind}, keyword string")
        out = part if out is None else out.unionByName(part)
    return out


def keyword_months(found: DataFrame) -> DataFrame:
    """Mentions by keyword and calendar month."""
    return found.select(F.explode("keywords").alias("keyword"), month(F.col("ts")).alias("month")).groupBy("keyword", "month").agg(F.count("*").alias("n"))


def dispatch_weeks(found: DataFrame) -> DataFrame:
    """Mentions by ISO week."""
    return found.groupBy(iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


def digest(weeks: DataFrame, months: DataFrame, week: str, month_: str) -> DataFrame:
    """``kind, name, n``: dispatches of a week and keyword counts of a month; zeros don't show."""
    a = weeks.where(F.col("week") == week).select(F.lit("dispatches").alias("kind"), F.col("week").alias("name"), "n")
    b = months.where(F.col("month") == month_).select(F.lit("keyword").alias("kind"), F.col("keyword").alias("name"), "n")
    return a.unionByName(b).where("n > 0")


def dispatched_once(found: DataFrame, days: int) -> DataFrame:
    """First mention of each id, and any that comes over ``days`` days after the last dispatched one: ``id, ts``.

    A dispatch restarts the period and a skipped mention doesn't, so it is a fold over an id's mentions in order.  Ids and times alone are shuffled and sorted;
    the fold streams through them and remembers one time, however many mentions an id has."""
    gap = days * 86_400_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            kept = []
            for i, (name, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or name != last_id or at - last > gap:
                    last_id, last = name, at
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    times = found.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("at IS NOT NULL")
    kept = times.repartition("id").sortWithinPartitions("id", "at").mapInArrow(fold, times.schema)
    return kept.select("id", F.timestamp_micros("at").alias("ts"))


def living_counts(rows: DataFrame, key: Column, ts: str, days: int) -> DataFrame:
    """``key, ts, n``: counters that live ``days`` days after their last row: the count at each time that adds to one, begun anew after a life without a row.

    Rows are first counted by key and time; a key's times are then numbered by lives.  ``n`` is a running sum within a life."""
    each = rows.select(key.alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at IS NOT NULL").groupBy("key", "at").agg(F.count("*").alias("many"))
    w = Window.partitionBy("key").orderBy("at")
    begun = each.withColumn("_new", F.coalesce((F.col("at") - F.lag("at").over(w) >= days * 86_400_000_000).cast("int"), F.lit(0)))
    lives = begun.withColumn("_life", F.sum("_new").over(w))
    return lives.select("key", F.timestamp_micros("at").alias("ts"), F.sum("many").over(Window.partitionBy("key", "_life").orderBy("at")).alias("n"))


def living_now(counts: DataFrame, days: int, now: Column) -> DataFrame:
    """``key, n`` of the counters of ``living_counts`` that live at a time: their last row by then is less than ``days`` days old."""
    last = counts.where(F.col("ts") <= now).groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("n", "ts").alias("n"))
    return last.where(F.unix_micros(now) - F.unix_micros("ts") < days * 86_400_000_000).select("key", "n")
