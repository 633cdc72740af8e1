"""Queries of record-level rules."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, records, search
from ..registry import query
from ..session import table
from ..sources import files
from .inline import Extended, Inline
from .text import duck_tokens

EVAL = Inline(
    {"id": "int", "scenario_id": "string", "server": "string", "model": "string", "category": "string", "question": "string", "status": "string", "response": "string", "turns": "long", "composite": "double"},
    [
        (1, "s", "a", "m", "c", "q", "ok", "text", 3, 0.5), (2, "", "a", "m", "c", "q", "ok", "text", None, None), (3, "s", "a", "m", "c", "q", "odd", None, -1, 1.5),
        (4, "s", "a", "m", "c", " ", "error", "left over", 1, 0.0), (5, "s", "a", "m", "c", "q", "timeout", None, 0, None),
    ],
)
_TEXT = ("scenario_id", "server", "model", "category", "question", "status")


@query(
    "row_schema",
    f"""SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN trim(COALESCE({c}, '')) = '' THEN 'blank-{c}' END" for c in _TEXT)},
    CASE WHEN status NOT IN ('ok', 'error', 'timeout', 'skipped') THEN 'unknown-status' END, CASE WHEN (trim(COALESCE(response, '')) <> '') <> (status = 'ok') THEN 'response-status' END,
    CASE WHEN turns NOT BETWEEN 0 AND 1000000000000000 THEN 'range-turns' END, 'missing-x', CASE WHEN composite NOT BETWEEN 0 AND 1 THEN 'range-composite' END], lambda x: x IS NOT NULL AND x <> 'missing-x'), '|') AS errors FROM {EVAL.sql}""",
)
def row_schema(spark, sf_dir):
    rows = EVAL.df(spark)
    return rows.select("id", F.array_join(records.row_errors(set(rows.columns)), "|").alias("errors"))


PROBED = Inline(
    {"route": "string", "status": "int", "error": "string", "body": "string", "final_url": "string", "markers": "array<string>"},
    [
        ("a", 200, None, "Hello World and more", "https://h/a", ["hello world"]), ("b", None, "timeout", None, None, []), ("c", 404, None, "x", "https://h/c", []),
        ("d", 200, None, "x", "https://other/d", []), ("e", 200, None, "  ", "https://h/e", []), ("f", 200, None, "old", "https://h/f", ["old", "new"]), ("g", 204, None, "fine", "https://h/g", []),
    ],
)


@query(
    "probe_verdict",
    f"""SELECT route, CASE WHEN status IS NULL OR error IS NOT NULL THEN 'unreachable' WHEN status NOT BETWEEN 200 AND 299 THEN 'bad-status' WHEN NOT starts_with(final_url, 'https://h') THEN 'redirected-away'
    WHEN trim(COALESCE(body, '')) = '' THEN 'empty' WHEN len(list_filter(markers, lambda m: NOT contains(lower(body), lower(m)))) > 0 THEN 'stale' END AS verdict FROM {PROBED.sql}""",
)
def probe_verdict(spark, sf_dir):
    c = F.col
    return PROBED.df(spark).select("route", records.probe_verdict(c("status"), c("error"), c("body"), c("final_url"), F.lit("https://h"), c("markers")).alias("verdict"))


SPEC = json.dumps({"paths": {"/w": {"get": {"summary": "List", "operationId": "l", "tags": ["T"]}, "post": {"operationId": "p"}, "parameters": []}, "/x": {"get": {"x-excluded": True}, "delete": {"tags": []}}}})
SPECS = Inline({"content": "string"}, [(SPEC,)])


@query("api_operations", """SELECT * FROM (VALUES ('/w', 'get', 'T', 'List'), ('/w', 'post', 'default', 'POST /w'), ('/x', 'delete', 'default', 'DELETE /x')) AS t(path, method, tag, summary)
    UNION ALL SELECT '/p/' || p_partkey, 'get', p_brand, p_name FROM part UNION ALL SELECT '/p/' || p_partkey, 'put', 'default', 'PUT /p/' || p_partkey FROM part WHERE p_size % 2 = 0""")
def api_operations(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    put = F.concat(F.lit('"put": {"x-excluded": '), F.when(F.col("p_size") % 2 == 0, "false").otherwise("true"), F.lit("}"))
    spec = F.concat(F.lit('{"paths": {"/p/'), n, F.lit('": {"parameters": [], "get": {"tags": ["'), "p_brand", F.lit('"], "summary": "'), "p_name", F.lit('"}, '), put, F.lit("}}}"))
    return files.operations_of(SPECS.df(spark).unionByName(table(spark, sf_dir, "part").select(spec.alias("content"))), "content")


OPS = Extended(
    "part", "SELECT 'o' || p_partkey AS operation, CASE WHEN p_size % 2 = 0 THEN p_name END AS example FROM part",
    {"operation": "string", "example": "string"}, [("l", "own"), ("p", None), ("q", None)])
EXAMPLES = Extended(
    "part", "SELECT 'o' || p_partkey AS operation, p_type AS example FROM part WHERE p_size % 3 <> 0",
    {"operation": "string", "example": "string"}, [("l", "given"), ("p", "given p"), ("z", "unused")])


@query("spec_examples", f"SELECT o.operation, COALESCE(o.example, e.example) AS example FROM {OPS.sql} o LEFT JOIN {EXAMPLES.sql} e ON e.operation = o.operation")
def spec_examples(spark, sf_dir):
    return records.with_examples(OPS.df(spark, sf_dir), EXAMPLES.df(spark, sf_dir), "operation", "example")


BATCHES = Extended(
    "part", "SELECT 'p' || p_partkey AS batch, 'sync/p' || p_partkey AS branch FROM part",
    {"batch": "string", "branch": "string"}, [("b1", "sync/1"), ("b2", "sync/2"), ("b3", "sync/3")])
HEADS = Extended(
    "part", "SELECT p_partkey + 100 AS number, 'sync/p' || (p_partkey - p_partkey % 3) AS head_ref FROM part WHERE p_size % 2 = 0",
    {"number": "int", "head_ref": "string"}, [(4, "sync/1"), (5, "sync/2"), (6, "sync/2"), (7, "other")])


@query("branch_match", f"SELECT b.batch, CASE WHEN COUNT(h.number) = 1 THEN MIN(h.number) END AS number, CASE WHEN COUNT(h.number) > 1 THEN 'ambiguous' END AS problem FROM {BATCHES.sql} b LEFT JOIN {HEADS.sql} h ON h.head_ref = b.branch GROUP BY b.batch")
def branch_match(spark, sf_dir):
    return records.matched_branches(BATCHES.df(spark, sf_dir), HEADS.df(spark, sf_dir))


SEEN = Inline({"tool": "string"}, [("docs-search",), ("docs__fetch",), ("search",), ("web-search",), ("docs-delete",), ("other",)])
CONFIGURED = Inline({"prefix": "string", "tool": "string"}, [("docs", "search"), ("docs", "fetch")])


@query("tool_membership", "SELECT unnest(['docs-search', 'docs__fetch', 'search']) AS tool")
def tool_membership(spark, sf_dir):
    return records.source_tools(SEEN.df(spark), CONFIGURED.df(spark))


RUNS = Inline({"seq": "int", "servers": "array<string>", "models": "array<string>"}, [(2, ["b", "c"], ["m2"]), (1, ["a", "b"], ["m1", "m2"]), (3, [], ["m0"])])


@query("metadata_union", "SELECT 'a|b|c' AS servers, 'm1|m2|m0' AS models")
def metadata_union(spark, sf_dir):
    got = records.merged_metadata(RUNS.df(spark), "seq", ["servers", "models"])
    return got.select(F.array_join("servers", "|").alias("servers"), F.array_join("models", "|").alias("models"))


@query(
    "set_operations",
    "WITH a AS (SELECT p_brand, p_type FROM part WHERE p_size < 20), b AS (SELECT p_brand, p_type FROM part WHERE p_size > 45) SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
)
def set_operations(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    a, b = part.where("p_size < 20").drop("p_size"), part.where("p_size > 45").drop("p_size")
    named = lambda df, side: df.withColumn("side", F.lit(side))
    return named(a.subtract(b), "left").unionByName(named(b.subtract(a), "right")).unionByName(named(a.intersect(b), "both"))


@query(
    "apply_preconditions",
    "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS planned, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS found FROM documents WHERE (CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END) IS DISTINCT FROM (CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END)",
)
def apply_preconditions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    plan = docs.select("path", F.when(F.col("doc_id") % 11 != 0, F.sha2(F.encode("text", "UTF-8"), 256)).alias("target_sha"))
    now = docs.where("doc_id % 13 <> 0").select("path", F.sha2(F.encode(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8"), 256).alias("sha256"))
    return records.unmet(plan, now)


GATES = Extended(
    "part", "SELECT CASE p_size % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'blocked' ELSE 'error' END AS status, CASE p_partkey % 2 WHEN 0 THEN 'gate' ELSE 'report' END AS phase FROM part",
    {"status": "string", "phase": "string"}, [(s, p) for s in ("pass", "fail", "blocked", "error") for p in ("gate", "report")])


@query("gate_exit_codes", f"SELECT status, phase, CASE WHEN status IN ('blocked', 'error') THEN 2 WHEN status = 'fail' AND phase = 'gate' THEN 1 ELSE 0 END AS code FROM {GATES.sql}")
def gate_exit_codes(spark, sf_dir):
    return GATES.df(spark, sf_dir).select("status", "phase", records.exit_code(F.col("status"), F.col("phase")).alias("code"))


@query("blocked_result", "SELECT 0::BIGINT AS total, 0::BIGINT AS passed, 0.0::DOUBLE AS pass_rate, 0.85::DOUBLE AS threshold, 'blocked' AS status")
def blocked_result(spark, sf_dir):
    return spark.range(1).select(records.result_row("blocked", 0.85).alias("r")).select("r.*")


@query("state_markers", "SELECT user_id, COUNT(*)::BIGINT AS n, MAX(event_id)::BIGINT AS last FROM events GROUP BY user_id")
def state_markers(spark, sf_dir):
    """Counts written into comment markers and read back."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    body = F.concat(F.lit("text\n"), records.state_marker(F.struct("n", "last"), "state"), F.lit("\nmore"))
    return counts.select("user_id", records.state_of(body, "state", "n long, last long").alias("s")).select("user_id", "s.*")


@query("icon_source", "SELECT 'p' || p_partkey AS publisher, '<svg ' || p_name || '>' AS icon FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 1")
def icon_source(spark, sf_dir):
    """Encoded icons, some of which aren't images or can't be decoded."""
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<svg "), F.col("p_name"), F.lit(">"))).otherwise(F.lit("png"))
    data = F.when(F.col("p_partkey") % 5 == 1, F.lit("***")).otherwise(F.base64(F.encode(body, "UTF-8")))
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), data.alias("data"))
    return files.icons(raw, "name", "data")


@query(
    "two_phase_sync",
    """WITH v AS (SELECT p_brand AS publisher, p_name AS name, substr(p_brand, 7, 1)::INT AS g, p_partkey AS id FROM part),
    m AS (SELECT publisher, id, CASE WHEN g = 1 AND id % 5 = 0 THEN NULL ELSE name END AS name, g FROM v), s AS (SELECT publisher, COUNT(*) FILTER (WHERE g = 1 AND id % 5 = 0) AS behind, COUNT(*) FILTER (WHERE g IN (1, 2) AND id % 7 = 0) AS fresh FROM v GROUP BY publisher)
    SELECT publisher, CASE WHEN behind > 0 THEN 'mirror' WHEN fresh > 0 THEN 'primary' ELSE 'noop' END AS phase, CASE WHEN behind > 0 THEN behind WHEN fresh > 0 THEN fresh ELSE 0 END::BIGINT AS changes FROM s""",
)
def two_phase_sync(spark, sf_dir):
    """Catalogues by brand: some mirrors miss rows of the primary copy, some generated ones changed or lost some."""
    primary = table(spark, sf_dir, "part").select(F.col("p_brand").alias("publisher"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    group = F.substring("publisher", 7, 1).cast("int")
    mirror = primary.where(~((group == 1) & (F.col("id") % 5 == 0)))
    changed = primary.withColumn("name", F.when(group.isin(1, 2) & (F.col("id") % 14 == 0), F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    generated = changed.where(~(group.isin(1, 2) & (F.col("id") % 14 == 7)))
    return catalog.sync_phases(mirror, primary, generated, "publisher", ["publisher", "id"], ["name"])


@query(
    "captions",
    f"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i, q FROM (SELECT *, list_distinct({duck_tokens("COALESCE(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")}) AS q FROM conversations)),
    c AS (SELECT conv_id, turn, s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect(list_distinct({duck_tokens('s')}), q)) DESC, i) AS n FROM s) SELECT conv_id, turn, s AS caption FROM c WHERE n = 1""",
)
def captions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = rows.withColumn("asked", text.tokens(before))
    return asked.select("conv_id", "turn", search.caption(F.split("text", r"\. "), F.col("asked")).alias("caption"))


@query("front_matter_lines", "SELECT * FROM (VALUES (1, 'Quoted', NULL), (2, 'plain text', 'x: y'), (3, NULL, NULL), (4, 'it''s', '''')) AS t(id, title, other) UNION ALL SELECT (p_partkey + 1000)::INTEGER, p_name, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN 'x: ' || p_brand END FROM part")
def front_matter_lines(spark, sf_dir):
    blocks = spark.createDataFrame([(1, 'title: "Quoted"\nx: 1'), (2, "a: b\ntitle:   plain text  \nother: 'x: y'"), (3, "subtitle: no"), (4, "title: it's\nother: '")], "id int, block string")
    other = F.element_at(F.array(F.concat(F.lit("other:  "), "p_type"), F.concat(F.lit("other: 'x: "), "p_brand", F.lit("'")), F.lit("nothing: 1")), (F.col("p_size") % 3 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).cast("int").alias("id"), F.concat(F.lit('subtitle: no\ntitle: "'), "p_name", F.lit('"\n'), other, F.lit("\ntitle: later")).alias("block"))
    blocks = blocks.unionByName(parts)
    return blocks.select("id", text.front_matter_line(F.col("block"), "title").alias("title"), text.front_matter_line(F.col("block"), "other").alias("other"))


@query("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    """Hash embeddings of all conversation turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.hashed_embedding(text.tokens(F.col("text"))).alias("embedding"))
