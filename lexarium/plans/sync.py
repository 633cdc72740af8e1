"""Queries of sync operators; documents stand for files of two trees."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import sync
from ..operators.ordering import numbered
from ..registry import query
from ..session import table
from .inline import Extended, Inline

PATH = "source || '/' || (doc_id % 50)::VARCHAR || '/doc' || doc_id::VARCHAR || '.mdx'"
RULES = [("directory", "src3"), ("file", "src1/1/doc1.mdx"), ("directory", "nowhere")]
RULE = f"CASE {' '.join(f"WHEN path = '{p}' OR ({str(k == 'directory').upper()} AND starts_with(path, '{p}/')) THEN '{k}:{p}'" for k, p in RULES)} END"
LEFT = f"SELECT {PATH} AS path, text AS content FROM documents WHERE doc_id % 9 <> 0"
RIGHT = f"SELECT {PATH} AS path, CASE doc_id % 4 WHEN 1 THEN text || chr(10) || 'one more line' WHEN 2 THEN 'first of two' || chr(10) || chr(10) || text WHEN 3 THEN regexp_replace(text, '\\n[^\\n]*$', '') ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0"


def path_of() -> Column:
    return F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".mdx"))


def trees(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = path_of()
    left = docs.where("doc_id % 9 <> 0").select(path.alias("path"), F.col("text").alias("content"))
    n = F.col("doc_id") % 4
    changed = F.when(n == 1, F.concat("text", F.lit("\none more line"))).when(n == 2, F.concat(F.lit("first of two\n\n"), "text")).when(n == 3, F.regexp_replace("text", r"\n[^\n]*\z", "")).otherwise(F.col("text"))
    return left, docs.where("doc_id % 7 <> 0").select(path.alias("path"), changed.alias("content"))


def inventories(spark, sf_dir):
    return [sync.inventory(t, F.col("path"), F.col("content")) for t in trees(spark, sf_dir)]


@query("file_inventory", f"SELECT path, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM (SELECT {PATH} AS path, text AS content FROM documents)")
def file_inventory(spark, sf_dir):
    return sync.inventory(table(spark, sf_dir, "documents"), path_of(), F.col("text"))


BOTH = f"(SELECT COALESCE(l.path, r.path) AS path, l.content AS l, r.content AS r FROM ({LEFT}) l FULL JOIN ({RIGHT}) r ON l.path = r.path)"


@query("index_diff", f"SELECT path, CASE WHEN r IS NULL THEN 'new' WHEN l IS NULL THEN 'deleted' WHEN l = r THEN 'unchanged' ELSE 'changed' END AS state FROM {BOTH}")
def index_diff(spark, sf_dir):
    left, right = inventories(spark, sf_dir)
    return sync.index_diff(left, right, "path", "sha256")


@query("index_upsert", f"SELECT path, octet_length(encode(COALESCE(l, r)))::BIGINT AS bytes FROM {BOTH}")
def index_upsert(spark, sf_dir):
    left, right = inventories(spark, sf_dir)
    return sync.upserted(right, left, ["path"]).select("path", "bytes")


@query("index_deletes", f"SELECT path FROM ({RIGHT}) WHERE path NOT IN (SELECT path FROM ({LEFT}))")
def index_deletes(spark, sf_dir):
    left, right = inventories(spark, sf_dir)
    return sync.deleted(right, left, ["path"]).select("path")


PLAN = f"""(SELECT sha256(decision || chr(0) || path) AS id, decision, path, rule, (CASE decision WHEN 'add' THEN s WHEN 'modify' THEN s + t WHEN 'remove' THEN t ELSE 0 END)::BIGINT AS payload_bytes, tb AS t_bytes FROM
    (SELECT *, {RULE} AS rule, COALESCE(octet_length(encode(l)), 0) AS s, COALESCE(octet_length(encode(r)), 0) AS t, octet_length(encode(r))::BIGINT AS tb,
       CASE WHEN ({RULE}) IS NOT NULL THEN 'preserve' WHEN l IS NULL THEN 'remove' WHEN r IS NULL THEN 'add' WHEN l <> r THEN 'modify' END AS decision FROM {BOTH}) WHERE decision IS NOT NULL)"""


def plan(spark, sf_dir):
    return sync.tree_plan(*inventories(spark, sf_dir), RULES)


@query("tree_sync_plan", f"SELECT id, decision, path, rule, payload_bytes FROM {PLAN}")
def tree_sync_plan(spark, sf_dir):
    return plan(spark, sf_dir).drop("t_bytes")


@query("decision_summary", f"SELECT d.decision, COUNT(p.path)::BIGINT AS files, COALESCE(SUM(payload_bytes), 0)::BIGINT AS bytes FROM (SELECT unnest(['add', 'modify', 'remove', 'preserve']) AS decision) d LEFT JOIN {PLAN} p ON p.decision = d.decision GROUP BY d.decision")
def decision_summary(spark, sf_dir):
    return sync.decision_summary(plan(spark, sf_dir))


@query("preserve_rules", f"SELECT r.rule, COUNT(p.path)::BIGINT AS files, COALESCE(SUM(t_bytes), 0)::BIGINT AS bytes FROM (SELECT unnest([{', '.join(f"'{k}:{p}'" for k, p in RULES)}]) AS rule) r LEFT JOIN {PLAN} p ON p.rule = r.rule GROUP BY r.rule")
def preserve_rules(spark, sf_dir):
    return sync.rule_summary(plan(spark, sf_dir), RULES)


@query("decision_order", f"SELECT path, row_number() OVER (ORDER BY list_position(['add', 'modify', 'remove', 'preserve'], decision), path)::INTEGER AS seq FROM {PLAN}")
def decision_order(spark, sf_dir):
    return sequenced(spark, sf_dir).select("path", "seq")


def sequenced(spark, sf_dir):
    return numbered(plan(spark, sf_dir), [sync.decision_order(F.col("decision")), F.col("path")])


@query("partition_check", "SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS problem WHERE false UNION ALL SELECT 'zz', 'extra'")
def partition_check(spark, sf_dir):
    rows = sequenced(spark, sf_dir)
    batches = sync.planned_batches(rows, 50, 400_000).select("id").unionByName(spark.createDataFrame([("zz",)], "id string"))
    return sync.assigned_once(rows, batches)


WORDS = r"len(regexp_extract_all(COALESCE({}, ''), '\S+'))"


@query("tree_compare", f"SELECT path, CASE WHEN r IS NULL THEN 'left-only' WHEN l IS NULL THEN 'right-only' WHEN l = r THEN 'same' ELSE 'modified' END AS side, ({WORDS.format('r')} - {WORDS.format('l')})::BIGINT AS word_delta FROM {BOTH}")
def tree_compare(spark, sf_dir):
    return sync.tree_compare(*trees(spark, sf_dir))


@query("tree_totals", f"SELECT CASE WHEN r IS NULL THEN 'left-only' WHEN l IS NULL THEN 'right-only' WHEN l = r THEN 'same' ELSE 'modified' END AS side, COUNT(*)::BIGINT AS n, SUM({WORDS.format('r')} - {WORDS.format('l')})::BIGINT AS word_delta FROM {BOTH} GROUP BY 1")
def tree_totals(spark, sf_dir):
    return sync.tree_compare(*trees(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("n"), F.sum("word_delta").alias("word_delta"))


@query("line_diff", f"SELECT path, (CASE d WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END)::BIGINT AS added, (d = 3)::BIGINT AS removed FROM (SELECT *, regexp_extract(path, 'doc([0-9]+)', 1)::BIGINT % 4 AS d FROM {BOTH}) WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r")
def line_diff(spark, sf_dir):
    return sync.line_diff(*trees(spark, sf_dir))


@query(
    "line_diff_edits",
    """WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
    SELECT doc_id, (COUNT(*) FILTER (WHERE i % 5 = 2) + COUNT(*) FILTER (WHERE i % 11 = 4))::BIGINT AS added, COUNT(*) FILTER (WHERE i % 7 = 3 OR i % 5 = 2)::BIGINT AS removed FROM l GROUP BY doc_id HAVING added + removed > 0""",
)
def line_diff_edits(spark, sf_dir):
    """Edits inside files: lines replaced, deleted and put in. All lines are told apart, so what is kept is the longest common part."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(line, F.lit("~"), i.cast("string")))
    edit = lambda line, i: (
        F.when((i + 1) % 5 == 2, F.concat(F.lit("other "), line)).when((i + 1) % 7 != 3, line), F.when((i + 1) % 11 == 4, F.concat(F.lit("new "), line)),
    )
    edited = F.array_compact(F.flatten(F.transform(lines, lambda line, i: F.array(*edit(line, i)))))
    # no other sign that ends a line
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", " "))
    left = docs.select(F.col("doc_id").alias("path"), F.array_join(lines, "\n").alias("content"))
    right = docs.select(F.col("doc_id").alias("path"), F.array_join(edited, "\n").alias("content"))
    return sync.line_diff(left, right).withColumnRenamed("path", "doc_id")


@query("churn_order", f"SELECT path, abs({WORDS.format('r')} - {WORDS.format('l')})::BIGINT AS churn, rn::INTEGER AS n FROM (SELECT *, row_number() OVER (ORDER BY abs({WORDS.format('r')} - {WORDS.format('l')}) DESC, path) AS rn FROM {BOTH}) WHERE rn <= 50")
def churn_order(spark, sf_dir):
    rows = sync.tree_compare(*trees(spark, sf_dir)).withColumn("churn", F.abs("word_delta"))
    first = rows.orderBy(F.col("churn").desc(), "path").limit(50)
    return first.select("path", "churn", F.row_number().over(Window.orderBy(F.col("churn").desc(), "path")).alias("n"))


@query("stale_files", f"SELECT path FROM ({LEFT}) WHERE path NOT IN (SELECT path FROM ({RIGHT})) AND path NOT IN ('src7/7/doc7.mdx')")
def stale_files(spark, sf_dir):
    left, right = trees(spark, sf_dir)
    return sync.stale(left, right.select("path"), ["src7/7/doc7.mdx"]).select("path")


PATHS = Inline({"seq": "int", "path": "string", "payload_bytes": "long"}, [(1, "a", 4), (2, "a-b", 6), (3, "a/b", 1), (4, "c/d/e", 9), (5, "c/dd", 2), (6, "c/d", 3), (7, "z", 5), (8, "y/x", 1)])


FOLDERS = Extended(
    "part", "SELECT p_partkey + 100 AS seq, CASE WHEN p_partkey <= 40 THEN 'k' || p_partkey WHEN p_partkey <= 400 THEN 'k' || (p_partkey % 40) || '/m' || p_partkey ELSE 'k' || (p_partkey % 40) || '/m' || (p_partkey % 400) || '/' || p_partkey END AS path, 1 AS payload_bytes FROM part",
    PATHS.columns, PATHS.rows,
)


@query("prefix_conflicts", f"SELECT x.path, y.path AS ancestor FROM {FOLDERS.sql} x JOIN {FOLDERS.sql} y ON starts_with(x.path, y.path || '/')")
def prefix_conflicts(spark, sf_dir):
    return sync.path_conflicts(FOLDERS.df(spark, sf_dir))


@query("minimal_pathspecs", f"SELECT path FROM {FOLDERS.sql} x WHERE NOT EXISTS (SELECT 1 FROM {FOLDERS.sql} y WHERE starts_with(x.path, y.path || '/'))")
def minimal_pathspecs(spark, sf_dir):
    return sync.minimal_paths(FOLDERS.df(spark, sf_dir))


@query("atomic_groups", "SELECT * FROM (VALUES (1, 1::BIGINT), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3), (8, 4)) AS t(seq, group_no)")
def atomic_groups(spark, sf_dir):
    return sync.atomic_groups(PATHS.df(spark)).select("seq", "group_no")


PULLS = Extended(
    "part", "SELECT p_partkey + 100 AS number, CASE p_size % 3 WHEN 0 THEN 'MERGED' ELSE 'OPEN' END AS state, CASE p_size % 4 WHEN 0 THEN '2026-01-05T00:00:00Z' WHEN 1 THEN 'bad' ELSE '2025-12-0' || (p_size % 9 + 1) || 'T00:00:00Z' END AS created, CASE WHEN p_size % 3 = 0 THEN '2026-01-0' || (p_size % 9 + 1) || 'T10:00:00Z' END AS merged, p_brand AS label FROM part",
    
    {"number": "int", "state": "string", "created": "string", "merged": "string", "label": "string"},
    [(1, "MERGED", "2026-01-01T00:00:00Z", "2026-01-09T10:00:00Z", "docs"), (1, "MERGED", "2026-01-01T00:00:00Z", "2026-01-09T10:00:00Z", "sync"), (2, "OPEN", "2026-01-08T00:00:00Z", None, "docs"), (3, "OPEN", "2025-12-01T00:00:00Z", None, "docs"), (4, "CLOSED", "bad", "", "sync"), (5, "MERGED", "2025-12-30T00:00:00Z", "2026-01-03T00:00:00Z", "sync"), (6, "OPEN", "2026-01-05T08:00:00Z", None, "sync")],
)
RECENT = f"(SELECT DISTINCT number, state, created, merged FROM {PULLS.sql} WHERE COALESCE(TRY_CAST(replace(merged, 'Z', '') AS TIMESTAMP) >= TIMESTAMP '2026-01-03 00:00:00', false) OR COALESCE(TRY_CAST(replace(created, 'Z', '') AS TIMESTAMP) >= TIMESTAMP '2026-01-03 00:00:00', false))"


def recent(spark, sf_dir):
    rows = PULLS.df(spark, sf_dir).drop("label").dropDuplicates(["number"])
    return sync.within_window(rows, ["merged", "created"], F.lit("2026-01-10 00:00:00").cast("timestamp"), 7)


@query("pull_window", f"SELECT number, state FROM {RECENT}")
def pull_window(spark, sf_dir):
    return recent(spark, sf_dir).select("number", "state")


@query("merge_rate", f"SELECT COUNT(*)::BIGINT AS created, COUNT(merged)::BIGINT AS merged, round(COUNT(merged) / COUNT(*) * 100, 1) AS rate FROM (SELECT * FROM {RECENT} ORDER BY number LIMIT 3)")
def merge_rate(spark, sf_dir):
    return sync.merge_rate(recent(spark, sf_dir), "merged", "created", [F.col("number")], 3)
