"""Queries of sessions, mentions and rule lists."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import sessions, validation
from ..registry import query
from ..session import table
from ..storage import new_path
from ..streaming import mentions, stateful
from .inline import Extended, Grown, Inline


def _log(*events) -> str:
    return "\n".join(e if isinstance(e, str) else json.dumps({"type": e[0], "data": e[1]}) for e in events)


LOGS = [
    ("s1", _log(("turn", {"turn": "1"}), "", ("tool_start", {"tool": "search", "call": "c1"}), ("tool_end", {"tool": "search", "call": "c1", "ok": True}), ("message", {"text": "found it", "tokens": 12}), ("turn", {"turn": "2"}), ("message", {"text": "", "tokens": 3}), ("result", {"code": 0}))),
    ("s2", _log(("message", {"text": "early", "tokens": 5}), ("tool_end", {"tool": "x", "call": "c9", "ok": True}), ("tool_start", {"tool": "y", "call": "c2"}), "not json", ("result", {"code": 1}), ("message", {"text": "late", "tokens": 7}))),
    ("s3", _log(("tool_start", {"tool": "a", "call": "c1"}), ("tool_start", {"tool": "a", "call": "c1"}), ("tool_end", {"tool": "a", "call": "c1", "ok": False}), ("tool_start", {"tool": "b", "call": "c2"}), ("tool_end", {"tool": "z", "call": "c2", "ok": True}))),
]
STREAMS = Inline({"session": "string", "raw": "string"}, LOGS)


@query("session_metrics", "SELECT * FROM (VALUES ('s1', 2::BIGINT, 1::BIGINT, 0::BIGINT, 15::BIGINT, 'found it', 0, 0::BIGINT, ''), ('s2', 0, 1, 0, 5, 'early', 1, 1, 'bad-line|after-result|answer-before-tool'), ('s3', 0, 3, 1, 0, NULL, NULL, 0, 'no-result')) AS t(session, turns, tool_calls, tool_errors, tokens, answer, code, after_result, errors)")
def session_metrics(spark, sf_dir):
    events = sessions.parsed(sessions.bounded_lines(STREAMS.df(spark), "session", "raw", 4_000_000, 5_000))
    return sessions.metrics(events, "session").drop("bad_lines").withColumn("errors", F.array_join("errors", "|"))


@query("tool_pairing", "SELECT * FROM (VALUES ('s1', 'c1', 'paired'), ('s2', 'c9', 'orphan'), ('s2', 'c2', 'open'), ('s3', 'c1', 'repeated'), ('s3', 'c2', 'renamed')) AS t(session, call, outcome)")
def tool_pairing(spark, sf_dir):
    events = sessions.parsed(sessions.bounded_lines(STREAMS.df(spark), "session", "raw", 4_000_000, 5_000))
    return sessions.paired_tools(events, "session")


def event_logs(spark, sf_dir):
    """Event logs of every user, a log for each stretch of events: turns, tool calls and ends, messages, broken lines and now and then a result."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    none = lambda t: F.lit(None).cast(t)
    data = lambda **f: F.struct(*[f.get(c, none(t)).cast(t).alias(c) for c, t in (("turn", "string"), ("text", "string"), ("tool", "string"), ("call", "string"), ("ok", "boolean"), ("tokens", "long"), ("code", "int"))])
    line = lambda name, **f: F.to_json(F.struct(F.lit(name).alias("type"), data(**f).alias("data")))
    call = F.floor(n / 40).cast("string")
    log = (
        F.when(n % 997 == 0, line("result", code=n % 3)).when(kind == "error", F.lit("not json")).when(kind == "signup", line("turn", turn=(n % 7).cast("string"))).when(kind == "click", line("tool_start", tool=F.lit("search"), call=call))
        .when(kind == "purchase", line("tool_end", tool=F.when(n % 5 == 0, "other").otherwise("search"), call=call, ok=F.col("value") > 20)).otherwise(line("message", text=F.concat(F.lit("v"), n.cast("string")), tokens=n % 11))
    )
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.expr("event_id div 5000").cast("string"))
    lines = e.select(session.alias("session"), F.struct("event_id", log.alias("line")).alias("l")).groupBy("session").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return lines.select("session", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw"))


EVENT_LINES = """l AS (SELECT 'u' || user_id || '-' || (event_id // 5000) AS session, row_number() OVER (PARTITION BY user_id, event_id // 5000 ORDER BY event_id) AS number, event_id AS n, value,
      CASE WHEN event_id % 997 = 0 THEN 'result' WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'signup' THEN 'turn' WHEN event_type = 'click' THEN 'tool_start' WHEN event_type = 'purchase' THEN 'tool_end' ELSE 'message' END AS type FROM events)"""


@query(
    "event_session_metrics",
    f"""WITH {EVENT_LINES}, e AS (SELECT *, MIN(number) FILTER (WHERE type = 'result') OVER (PARTITION BY session) AS stop FROM l), m AS (SELECT *, stop IS NULL OR number <= stop AS live FROM e),
    s AS (SELECT session, COUNT(DISTINCT n % 7) FILTER (WHERE live AND type = 'turn')::BIGINT AS turns, COUNT(*) FILTER (WHERE live AND type = 'tool_start')::BIGINT AS tool_calls,
      COUNT(*) FILTER (WHERE live AND type = 'tool_end' AND NOT value > 20)::BIGINT AS tool_errors, COALESCE(SUM(n % 11) FILTER (WHERE live AND type = 'message'), 0)::BIGINT AS tokens,
      arg_max('v' || n, number) FILTER (WHERE live AND type = 'message') AS answer, MAX(number) FILTER (WHERE live AND type = 'message') AS al, MAX(number) FILTER (WHERE live AND type = 'tool_end' AND value > 20) AS tl,
      MAX(n % 3) FILTER (WHERE live AND type = 'result')::INTEGER AS code, COUNT(*) FILTER (WHERE NOT live)::BIGINT AS after_result, COUNT(*) FILTER (WHERE type = 'bad') AS bad FROM m GROUP BY session)
    SELECT session, turns, tool_calls, tool_errors, tokens, answer, code, after_result, concat_ws('|', CASE WHEN bad > 0 THEN 'bad-line' END, CASE WHEN after_result > 0 THEN 'after-result' END, CASE WHEN code IS NULL THEN 'no-result' END, CASE WHEN al < tl THEN 'answer-before-tool' END) AS errors FROM s""",
)
def event_session_metrics(spark, sf_dir):
    """Metrics of every user's log."""
    events = sessions.parsed(sessions.bounded_lines(event_logs(spark, sf_dir), "session", "raw", 1 << 40, 1 << 30))
    return sessions.metrics(events, "session").drop("bad_lines").withColumn("errors", F.array_join("errors", "|"))


@query(
    "event_tool_pairing",
    f"""WITH {EVENT_LINES}, a AS (SELECT session, (n // 40)::VARCHAR AS call, COUNT(*) AS starts FROM l WHERE type = 'tool_start' GROUP BY ALL), b AS (SELECT session, (n // 40)::VARCHAR AS call, COUNT(*) AS ends, MIN(CASE WHEN n % 5 = 0 THEN 'other' ELSE 'search' END) AS tool FROM l WHERE type = 'tool_end' GROUP BY ALL)
    SELECT COALESCE(a.session, b.session) AS session, COALESCE(a.call, b.call) AS call, CASE WHEN starts IS NULL THEN 'orphan' WHEN ends IS NULL THEN 'open' WHEN starts > 1 OR ends > 1 THEN 'repeated' WHEN tool <> 'search' THEN 'renamed' ELSE 'paired' END AS outcome
    FROM a FULL JOIN b ON a.session = b.session AND a.call = b.call""",
)
def event_tool_pairing(spark, sf_dir):
    """Tool calls of every user's log with their ends."""
    events = sessions.parsed(sessions.bounded_lines(event_logs(spark, sf_dir), "session", "raw", 1 << 40, 1 << 30))
    return sessions.paired_tools(events, "session")


@query(
    "byte_budget",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    b AS (SELECT *, SUM(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM l) SELECT doc_id, i::BIGINT AS number, md5(line) AS line_md5 FROM b WHERE bytes <= 2000 AND i <= 10 AND trim(line) <> ''""",
)
def byte_budget(spark, sf_dir):
    lines = sessions.bounded_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 10)
    return lines.select("doc_id", "number", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("last_message", "SELECT conv_id, COUNT(*)::BIGINT AS turns, arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS answer, COUNT(DISTINCT role)::BIGINT AS roles FROM conversations GROUP BY conv_id")
def last_message(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("turn"))).alias("answer"), F.countDistinct("role").alias("roles"))


@query(
    "event_sessions",
    """SELECT user_id, COUNT(*)::BIGINT AS n, COUNT(DISTINCT event_type)::BIGINT AS kinds, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, arg_max(event_type, (ts, event_id)) AS last_type,
    COUNT(*) FILTER (WHERE ts > (SELECT MIN(ts) FROM events e WHERE e.user_id = events.user_id AND event_type = 'purchase'))::BIGINT AS after_first_purchase FROM events GROUP BY user_id""",
)
def event_sessions(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("first", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id")))
    k = F.from_json("props", "k long")["k"]
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.sum(k).alias("k"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count_if(F.col("ts") > F.col("first")).alias("after_first_purchase"))


WORDS = ["license", "email", "the ", "zu"]
FOUND = f"(SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01' + INTERVAL (conv_id * 7 % 200) HOUR AS ts, list_filter({WORDS}, lambda k: contains(lower(text), k)) AS keywords FROM conversations)"


def found(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 7 % 200 * 3600)
    return sessions.mentions(rows.withColumn("ts", ts), "id", "ts", F.col("text"), WORDS)


@query("keyword_mentions", f"SELECT id, array_to_string(keywords, '|') AS keywords FROM {FOUND} WHERE len(keywords) > 0")
def keyword_mentions(spark, sf_dir):
    return found(spark, sf_dir).select("id", F.array_join("keywords", "|").alias("keywords"))


@query("keyword_month", f"SELECT keyword, strftime(ts, '%Y-%m') AS month, COUNT(*)::BIGINT AS n FROM (SELECT unnest(keywords) AS keyword, ts FROM {FOUND}) GROUP BY ALL")
def keyword_month(spark, sf_dir):
    return sessions.keyword_months(found(spark, sf_dir))


@query("dispatch_week", f"SELECT strftime(ts, '%G-W%V') AS week, COUNT(*)::BIGINT AS n FROM {FOUND} WHERE len(keywords) > 0 GROUP BY week")
def dispatch_week(spark, sf_dir):
    return sessions.dispatch_weeks(found(spark, sf_dir))


@query(
    "keyword_automaton",
    "SELECT doc_id, keyword FROM documents JOIN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS keyword FROM benchmark) ON contains(lower(text), keyword)",
)
def keyword_automaton(spark, sf_dir):
    """Long words of the benchmark, wherever they stand in documents, inside other words too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)).alias("keyword"))
    return sessions.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", words)


@query(
    "weekly_digest",
    f"""SELECT 'dispatches' AS kind, '2024-W01' AS name, COUNT(*)::BIGINT AS n FROM {FOUND} WHERE len(keywords) > 0 AND strftime(ts, '%G-W%V') = '2024-W01' HAVING COUNT(*) > 0
    UNION ALL SELECT 'keyword', keyword, COUNT(*) FROM (SELECT unnest(keywords) AS keyword, ts FROM {FOUND}) WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY keyword""",
)
def weekly_digest(spark, sf_dir):
    rows = found(spark, sf_dir)
    return sessions.digest(sessions.dispatch_weeks(rows), sessions.keyword_months(rows), "2024-W01", "2024-01")


@query(
    "mention_dedupe_ttl",
    """WITH RECURSIVE e AS (SELECT user_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'click'),
    w(id, ts, n, last, keep) AS (SELECT id, ts, n, ts, true FROM e WHERE n = 1 UNION ALL
      SELECT e.id, e.ts, e.n, CASE WHEN e.ts - w.last > INTERVAL 2 DAY THEN e.ts ELSE w.last END, e.ts - w.last > INTERVAL 2 DAY FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1)
    SELECT id, epoch_us(ts)::BIGINT AS at FROM w WHERE keep""",
)
def mention_dedupe_ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), "ts")
    return sessions.dispatched_once(rows, 2).select("id", F.unix_micros("ts").alias("at"))


def replayed(spark, sf_dir, make):
    """What a stream of the clicks (``id, ts``) in the events' file gives, written by the batch that it is. A clock, whose id is -1, ticks long after all clicks, so the watermark passes them."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")  # a stream reads a pattern or a folder
    clock = stream.where("event_id % 100 = 0").select(F.lit(-1).cast("long").alias("id"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    clicks = stream.where("event_type = 'click'").select(F.col("user_id").alias("id"), "ts").unionByName(clock)
    path = new_path(spark, "stream")
    mentions.run_once(make(clicks), f"{path}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    return spark.read.parquet(f"{path}/out").drop("batch")


@query(
    "dispatch_stream",
    """WITH RECURSIVE e AS (SELECT user_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'click'),
    w(id, ts, n, last, keep) AS (SELECT id, ts, n, ts, true FROM e WHERE n = 1 UNION ALL
      SELECT e.id, e.ts, e.n, CASE WHEN e.ts - w.last > INTERVAL 2 DAY THEN e.ts ELSE w.last END, e.ts - w.last > INTERVAL 2 DAY FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1)
    SELECT id, epoch_us(ts)::BIGINT AS at FROM w WHERE keep""",
)
def dispatch_stream(spark, sf_dir):
    """The rule of ``mention_dedupe_ttl`` in a stream: state by id, timers by event time."""
    return replayed(spark, sf_dir, lambda s: stateful.dispatched_once(s, 2, "0 seconds")).where("id >= 0").select("id", F.unix_micros("ts").alias("at"))


LIVING = """WITH e AS (SELECT user_id AS key, ts, COUNT(*) AS many FROM events WHERE event_type = 'click' GROUP BY ALL),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) >= INTERVAL 3 DAY THEN 1 ELSE 0 END AS new FROM e),
    l AS (SELECT *, SUM(new) OVER (PARTITION BY key ORDER BY ts) AS life FROM g)
    SELECT key, epoch_us(ts)::BIGINT AS at, (SUM(many) OVER (PARTITION BY key, life ORDER BY ts))::BIGINT AS n FROM l"""


@query("living_counters", LIVING)
def living_counters(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    return sessions.living_counts(clicks, F.col("user_id"), "ts", 3).select("key", F.unix_micros("ts").alias("at"), "n")


@query("living_counters_stream", LIVING)
def living_counters_stream(spark, sf_dir):
    """The same in a stream; states that were forgotten aren't counts."""
    got = replayed(spark, sf_dir, lambda s: stateful.living_counts(s, F.col("id"), "ts", 3, "0 seconds"))
    return got.where("key >= 0 AND n > 0").select("key", F.unix_micros("ts").alias("at"), "n")


@query("event_windows", "SELECT epoch(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, COUNT(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = rows.groupBy(F.window("ts", "7 days"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


@query("feedback_cases", "SELECT 'q' || (event_id % 97) AS query, 'docs/p' || (event_id % 13) AS expected, COUNT(*)::BIGINT AS n, MIN(event_id) AS first FROM events GROUP BY ALL")
def feedback_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.concat(F.lit("q"), F.col("event_id") % 97).alias("query"), F.concat(F.lit("docs/p"), F.col("event_id") % 13).alias("expected")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# ---- rule lists

LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in validation.PLACEHOLDERS) + "]"
REPORTS = Extended(
    "documents", "SELECT doc_id + 100 AS id, text AS body FROM documents",
    
    {"id": "int", "body": "string"},
    [
        (1, "I followed the task at https://site.example/a, then https://site.example/b. and (https://site.example/c) which was confusing. Critical issue: broken link. What worked: search. Recommendation: fix it. " + "word " * 150),
        (2, "TODO: lorem ipsum. [insert page] xxx"),
        (3, "No issues found. I tried https://site.example/a https://site.example/a https://other.example/z. Worked well; I suggest nothing."),
        (4, ""),
    ],
)


def _any(words):
    return "(" + " OR ".join(f"contains(lower(body), '{w}')" for w in words) + ")"


URLS = r"list_distinct(list_filter(list_transform(regexp_extract_all(body, 'https?://[^\s)\]}""''>]+'), lambda u: regexp_replace(u, '[).,;:*_]+$', '')), lambda u: starts_with(u, 'https://site.example/')))".replace('""', '"')


@query(
    "report_rules",
    rf"""SELECT id, array_to_string(list_filter([CASE WHEN len(list_filter({LIST}, lambda p: regexp_matches(lower(body), p))) > 0 THEN 'placeholder' END, CASE WHEN len(regexp_extract_all(body, '\S+')) < 150 THEN 'short' END, CASE WHEN len({URLS}) < 3 THEN 'few-urls' END,
    {', '.join(f"CASE WHEN NOT {_any(w)} THEN 'no-{n}' END" for n, w in validation.EVIDENCE.items())}], lambda x: x IS NOT NULL), '|') AS errors, len({URLS})::BIGINT AS n_urls FROM {REPORTS.sql}""",
)
def report_rules(spark, sf_dir):
    body = F.col("body")
    errors = validation.report_errors(body, prefixes=("https://site.example/",))
    return REPORTS.df(spark, sf_dir).select("id", F.array_join(errors, "|").alias("errors"), F.size(text.addresses(body, ("https://site.example/",))).cast("long").alias("n_urls"))


OUTAGES = Extended(
    "events", "SELECT event_id + 100 AS id, CASE event_id % 4 WHEN 0 THEN 'Infrastructure blocked: ' WHEN 1 THEN 'BLOCKED: TBD ' WHEN 2 THEN 'blocked ' ELSE 'infrastructure-blocked ' END || event_type || CASE event_id % 3 WHEN 0 THEN ' timed out' WHEN 1 THEN ' (403)' ELSE '' END || CASE WHEN event_id % 5 <> 0 THEN ' at https://site.example/' || event_id ELSE ' at https://other.example/x' END AS body FROM events",
    {"id": "int", "body": "string"}, [(1, "Infrastructure blocked: the browser was denied at https://site.example/a."), (2, "blocked"), (3, "infrastructure-blocked, network; https://site.example/a https://other.example/b TODO"), (4, "")],
)


@query(
    "blocked_report_rules",
    rf"""SELECT id, array_to_string(list_filter([CASE WHEN len(list_filter({LIST}, lambda p: regexp_matches(lower(body), p))) > 0 THEN 'placeholder' END, CASE WHEN NOT {_any(validation.BLOCKED)} THEN 'no-mark' END,
    CASE WHEN NOT {_any(validation.CAUSES)} THEN 'no-cause' END, CASE WHEN len({URLS}) < 1 THEN 'few-urls' END], lambda x: x IS NOT NULL), '|') AS errors FROM {OUTAGES.sql}""",
)
def blocked_report_rules(spark, sf_dir):
    return OUTAGES.df(spark, sf_dir).select("id", F.array_join(validation.blocked_errors(F.col("body"), prefixes=("https://site.example/",)), "|").alias("errors"))


@query("placeholder_hits", f"SELECT doc_id, array_to_string(list_filter({LIST}, lambda p: regexp_matches(lower(text), p)), ' ') AS hits FROM documents")
def placeholder_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(validation.placeholder_hits(F.col("text")), " ").alias("hits"))


@query("url_allowlist", r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(concat(url, ' ', html), 'https?://[^\s)\]}""''>]+'), lambda u: regexp_replace(u, '[).,;:*_]+$', '')), lambda u: starts_with(u, 'https://')))), ' ') AS urls FROM pages".replace('""', '"'))
def url_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.addresses(F.concat_ws(" ", "url", "html"), ("https://",))), " ").alias("urls"))


def part_issues(spark, sf_dir):
    """An issue of every part, whose marker is whole, short, broken, twice or not there."""
    name = F.col("p_name")
    marker = lambda fields: F.concat(F.lit("<!-- report: "), fields, F.lit(" -->"))
    whole = marker(F.concat(F.lit('{"run": "1", "key": "'), name, F.lit('"}')))
    shapes = F.array(F.concat(name, F.lit("\n"), whole), marker(F.concat(F.lit('{"key": "'), name, F.lit('"}'))), marker(name), F.concat(whole, F.lit("\n"), whole), F.concat(F.lit("see "), whole))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).cast("int").alias("number"), F.element_at(shapes, (F.col("p_size") % 5 + 1).cast("int")).alias("body"))


PART_OUTCOMES = "SELECT (p_partkey + 1000)::INTEGER AS number, ['valid', 'mismatched', 'malformed', 'repeated', 'missing'][p_size % 5 + 1] AS outcome FROM part"
ISSUES = Grown(
    {"number": "int", "body": "string"},
    [(1, 'text\n<!-- report: {"key": "a", "run": "1"} -->\nmore'), (2, "no marker"), (3, '<!-- report: {"key": "a"} -->'), (4, "<!-- report: nonsense -->"), (5, '<!-- report: {"key": "a", "run": "1"} -->\n<!-- report: {"key": "b", "run": "2"} -->'), (6, ' <!-- report: {"key": "a", "run": "1"} -->')],
    part_issues,
    "SELECT NULL AS number, NULL AS body WHERE false",
)


@query("marker_identity", f"SELECT * FROM (VALUES (1, 'valid'), (2, 'missing'), (3, 'mismatched'), (4, 'malformed'), (5, 'repeated'), (6, 'missing')) AS t(number, outcome) UNION ALL {PART_OUTCOMES}")
def marker_identity(spark, sf_dir):
    return ISSUES.df(spark, sf_dir).select("number", validation.marker_outcome(F.col("body"), "report", ("key", "run")).alias("outcome"))


@query("cleanup_counts", f"SELECT outcome, SUM(n)::BIGINT AS n FROM (SELECT * FROM (VALUES ('valid', 1::BIGINT), ('missing', 2), ('mismatched', 1), ('malformed', 1), ('repeated', 1)) AS t(outcome, n) UNION ALL SELECT outcome, COUNT(*) FROM ({PART_OUTCOMES}) GROUP BY outcome) GROUP BY outcome")
def cleanup_counts(spark, sf_dir):
    return marker_identity(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


LISTING = Inline({"id": "int", "body": "string"}, [(1, '{"value": [{"name": "a", "version": "1"}], "token": "t"}'), (2, '{"token": null}'), (3, '{"value": [{"name": "a"}]}'), (4, '{"value": []}')])


@query("page_contract", "SELECT * FROM (VALUES (1, ''), (2, 'no-list'), (3, 'incomplete-member'), (4, '')) AS t(id, errors) UNION ALL SELECT (p_partkey + 1000)::INTEGER, ['', 'incomplete-member', 'no-list'][p_size % 3 + 1] FROM part")
def page_contract(spark, sf_dir):
    member = F.concat(F.lit('{"name": "'), "p_name", F.lit('"'), F.when(F.col("p_size") % 3 == 1, "}").otherwise(F.concat(F.lit(', "version": "'), F.col("p_size").cast("string"), F.lit('"}'))))
    body = F.when(F.col("p_size") % 3 == 2, '{"token": "t"}').otherwise(F.concat(F.lit('{"value": [{"name": "a", "version": "1"}, '), member, F.lit('], "token": null}')))
    pages = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).cast("int").alias("id"), body.alias("body"))
    raw = LISTING.df(spark).unionByName(pages).select("id", F.from_json("body", "value array<struct<name:string,version:string>>, token string").alias("j")).select("id", "j.*")
    return validation.page_errors(raw, "value").select("id", F.array_join("errors", "|").alias("errors"))
