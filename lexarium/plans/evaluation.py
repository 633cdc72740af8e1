"""Queries of evaluation operators; orders and customers stand for evaluation rows.

Prices are whole cents, so that means are one division of exact sums in either engine, whatever the order of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..registry import query
from ..session import table
from .inline import Extended, Inline

ROWS = "SELECT c_mktsegment AS server, n_name AS model, o_orderpriority AS category, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderstatus AS status, o_orderdate, round(o_totalprice * 100) > 100000 AS valid FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def rows(spark, sf_dir):
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows by definition
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("server"), F.col("n_name").alias("model"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), "o_orderdate")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("valid", F.col("price") > 100_000)


# observed cells: some are missing, some are outside what was asked for
CELL = f"(SELECT server, model, category, price > 200000 AS valid FROM ({ROWS}) WHERE NOT (server = 'BUILDING' AND category LIKE '1%'))"


def cells(spark, sf_dir):
    return rows(spark, sf_dir).where("NOT (server = 'BUILDING' AND category LIKE '1%')").select("server", "model", "category", (F.col("price") > 200_000).alias("valid"))


MODELS = Inline({"model": "string"}, [("FRANCE",), ("GERMANY",), ("JAPAN",), ("ATLANTIS",)])


@query(
    "required_matrix",
    f"""WITH o AS (SELECT server, model, category, COUNT(*)::BIGINT AS n, bool_and(valid) AS valid FROM {CELL} GROUP BY ALL),
    w AS (SELECT server, model, category FROM (SELECT DISTINCT c_mktsegment AS server FROM customer), {MODELS.sql}, (SELECT DISTINCT o_orderpriority AS category FROM orders))
    SELECT COALESCE(w.server, o.server) AS server, COALESCE(w.model, o.model) AS model, COALESCE(w.category, o.category) AS category, COALESCE(n, 0)::BIGINT AS n,
      CASE WHEN w.server IS NULL THEN 'unexpected' WHEN o.server IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN NOT valid THEN 'invalid' ELSE 'complete' END AS status
    FROM w FULL JOIN o ON w.server = o.server AND w.model = o.model AND w.category = o.category""",
)
def required_matrix(spark, sf_dir):
    servers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("server")).distinct()
    categories = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category")).distinct()
    wanted = ev.required([MODELS.df(spark), servers, categories])
    return ev.completeness(cells(spark, sf_dir), wanted, ["server", "model", "category"], "valid")


@query("matrix_status", f"SELECT status, COUNT(*)::BIGINT AS n FROM (SELECT CASE WHEN model NOT IN ('FRANCE', 'GERMANY', 'JAPAN', 'ATLANTIS') THEN 'unexpected' ELSE 'known' END AS status FROM (SELECT DISTINCT server, model, category FROM {CELL})) GROUP BY status")
def matrix_status(spark, sf_dir):
    seen = cells(spark, sf_dir).select("server", "model", "category").distinct().join(MODELS.df(spark).withColumn("known", F.lit(True)), "model", "left")
    return seen.groupBy(F.when(F.col("known").isNull(), "unexpected").otherwise("known").alias("status")).agg(F.count("*").alias("n"))


@query(
    "score_matrix",
    f"SELECT server, model, category, AVG(price) AS mean, COUNT(*)::BIGINT AS n FROM ({ROWS}) WHERE valid GROUP BY GROUPING SETS ((server, model), (category, server), (server))",
)
def score_matrix(spark, sf_dir):
    got = ev.means_by(rows(spark, sf_dir), "price", [["server", "model"], ["category", "server"], ["server"]], "valid")
    return got.select("server", "model", "category", "mean", "n")


LATE = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE price END"


@query(
    "operational_metrics",
    f"""SELECT server, COUNT(*)::BIGINT AS n, AVG(m) AS avg_m, COUNT(m)::BIGINT AS present_m, COUNT(*) FILTER (WHERE m IS NULL)::BIGINT AS missing_m, SUM(m)::BIGINT AS sum_m, COUNT(*) FILTER (WHERE status = 'F')::BIGINT AS n_final
    FROM (SELECT *, {LATE} AS m FROM ({ROWS})) GROUP BY server""",
)
def operational_metrics(spark, sf_dir):
    return ev.operational(rows(spark, sf_dir).withColumn("m", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("price"))), ["server"], ["m"], "status")


@query("success_rates", f"SELECT category, server, AVG((status = 'F')::INT) AS rate FROM ({ROWS}) GROUP BY ALL")
def success_rates(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("category", "server").agg(F.avg((F.col("status") == "F").cast("int")).alias("rate"))


def halves(spark, sf_dir):
    rate = F.avg((F.col("status") == "F").cast("int")).alias("rate")
    early = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    whole = rows(spark, sf_dir).where("NOT (server = 'MACHINERY' AND model = 'FRANCE')")
    return whole.where(~early).where("model <> 'CHINA'").groupBy("model", "server").agg(rate), whole.where(early).groupBy("model", "server").agg(rate)


@query(
    "baseline_compare",
    f"""WITH w AS (SELECT * FROM ({ROWS}) WHERE NOT (server = 'MACHINERY' AND model = 'FRANCE')), c AS (SELECT model, server, AVG((status = 'F')::INT) AS rate FROM w WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND model <> 'CHINA' GROUP BY ALL),
    b AS (SELECT model, server, AVG((status = 'F')::INT) AS rate FROM w WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY ALL)
    SELECT COALESCE(c.model, b.model) AS model, COALESCE(c.server, b.server) AS server, c.rate AS current, b.rate AS baseline,
      CASE WHEN c.rate - b.rate IS NULL THEN 'inconclusive' WHEN c.rate - b.rate > 0.05 THEN 'better' WHEN c.rate - b.rate < -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM c FULL JOIN b ON c.model = b.model AND c.server = b.server""",
)
def baseline_compare(spark, sf_dir):
    return ev.compared(*halves(spark, sf_dir), ["model", "server"], "rate")


MEANS = f"(SELECT model, server, AVG(price) AS mean FROM ({ROWS}) GROUP BY ALL)"


def means(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("model", "server").agg(F.avg("price").alias("mean"))


@query("server_ranking", f"SELECT model, server, mean, rank::INTEGER AS rank, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, server) AS rank FROM {MEANS})")
def server_ranking(spark, sf_dir):
    return ev.ranked(means(spark, sf_dir), ["model"], "mean", "server")


@query("ranking_agreement", f"WITH o AS (SELECT model, string_agg(server, '>' ORDER BY mean DESC, server) AS o FROM {MEANS} GROUP BY model) SELECT COUNT(*)::BIGINT AS n_groups, COUNT(DISTINCT o)::BIGINT AS n_orders, COUNT(DISTINCT o) <= 1 AS agree FROM o")
def ranking_agreement(spark, sf_dir):
    return ev.rankings_agree(means(spark, sf_dir), "model", "mean", "server")


BOARD = Extended(
    "part", "SELECT 'p' || p_partkey AS name, CASE WHEN p_size % 9 <> 0 THEN p_size / 64.0e0 END AS current, (p_size + p_partkey % 9 - 4) / 64.0e0 AS base FROM part",
    {"name": "string", "current": "double", "base": "double"}, [("one", 0.908, 0.906), ("two", 0.904, 0.906), ("three", 0.97, 0.90), ("four", 0.5, 0.5), ("five", None, 0.4)])


@query("hypothesis_bands", f"SELECT name, CASE WHEN d IS NULL THEN 'untested' WHEN d > 0.05 THEN 'supported' WHEN d > 0 THEN 'marginal' WHEN d = 0 THEN 'neutral' ELSE 'rejected' END AS band FROM (SELECT name, round(current - base, 6) AS d FROM {BOARD.sql})")
def hypothesis_bands(spark, sf_dir):
    return BOARD.df(spark, sf_dir).select("name", ev.delta_band(F.round(F.col("current") - F.col("base"), 6)).alias("band"))


SCORED = Extended(
    "part", "SELECT p_partkey + 100 AS id, split(p_name, ' ') AS topics, split(p_type, ' ') AS seen_topics, split(p_brand, '#') AS sources, split(p_name || ' 11', ' ') AS seen_sources FROM part",
    
    {"id": "int", "topics": "array<string>", "seen_topics": "array<string>", "sources": "array<string>", "seen_sources": "array<string>"},
    [(1, ["a", "b"], ["a"], ["x"], ["x", "y"]), (2, [], ["a"], ["x", "y"], []), (3, ["a"], ["a"], [], []), (4, ["a", "b", "c"], ["c", "b"], ["z"], ["q"])],
)


@query(
    "composite_scores",
    f"""SELECT id, round(0.4 * CASE WHEN len(topics) = 0 THEN 1 ELSE len(list_filter(topics, lambda x: list_contains(seen_topics, x))) / len(topics) END
      + 0.6 * CASE WHEN len(sources) = 0 THEN 1 ELSE len(list_filter(sources, lambda x: list_contains(seen_sources, x))) / len(sources) END, 6) AS score,
      len(list_filter(seen_sources, lambda x: NOT list_contains(sources, x))) = 0 AS within FROM {SCORED.sql}""",
)
def composite_scores(spark, sf_dir):
    score = ev.composite([(ev.hit_share(F.col("topics"), F.col("seen_topics")), 0.4), (ev.hit_share(F.col("sources"), F.col("seen_sources")), 0.6)])
    return SCORED.df(spark, sf_dir).select("id", F.round(score, 6).alias("score"), (F.size(F.array_except("seen_sources", "sources")) == 0).alias("within"))


TRUST = Extended(
    "part", "SELECT 's' || p_partkey || 'x' AS id, p_name AS question, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS category FROM part",
    {"id": "string", "question": "string", "category": "string"}, [("s1", "q1", "c1"), ("s2", "q2", None), ("s3", "q3", "c3")])
GIVEN = Extended(
    "part", "SELECT 's' || p_partkey || CASE WHEN p_size % 7 = 0 THEN 'y' ELSE 'x' END AS id, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END AS question, p_brand AS category FROM part",
    {"id": "string", "question": "string", "category": "string"}, [("s1", "q1", "c1"), ("s2", "q2", None), ("s3", "other", "c9"), ("s9", "q", "c")])


@query(
    "trusted_join",
    f"""SELECT g.id, CASE WHEN t.id IS NULL THEN 'unknown' ELSE array_to_string(list_filter([CASE WHEN g.question IS DISTINCT FROM t.question THEN 'question' END, CASE WHEN g.category IS DISTINCT FROM t.category THEN 'category' END], lambda x: x IS NOT NULL), '|') END AS differs
    FROM {GIVEN.sql} g LEFT JOIN {TRUST.sql} t ON t.id = g.id""",
)
def trusted_join(spark, sf_dir):
    t = TRUST.df(spark, sf_dir).select("id", F.col("question").alias("tq"), F.col("category").alias("tc"), F.lit(True).alias("known"))
    both = GIVEN.df(spark, sf_dir).join(t, "id", "left")
    differs = ev.mismatches([("question", F.col("question"), F.col("tq")), ("category", F.col("category"), F.col("tc"))])
    return both.select("id", F.when(F.col("known").isNull(), "unknown").otherwise(F.array_join(differs, "|")).alias("differs"))


EVIDENCE = Extended(
    "part", "SELECT p_partkey + 100 AS id, p_size % 4 AS turns, CASE WHEN p_size % 3 <> 0 THEN p_name ELSE '' END AS answer, p_size % 2 AS tools, p_partkey % 3 AS errors FROM part",
    {"id": "int", "turns": "int", "answer": "string", "tools": "int", "errors": "int"}, [(1, 2, "ok", 1, 0), (2, 0, "ok", 1, 0), (3, 1, "", 0, 2), (4, None, None, None, None), (5, 3, "fine", 1, 1)])
RULES_SQL = [("turns > 0", "no-turns"), ("answer <> ''", "no-answer"), ("tools > 0", "no-tool-call"), ("errors = 0", "tool-errors")]


@query("row_evidence", f"SELECT id, CASE {' '.join(f"WHEN NOT COALESCE({c}, false) THEN '{r}'" for c, r in RULES_SQL)} END AS reason, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT COALESCE({c}, false) THEN '{r}' END" for c, r in RULES_SQL)}], lambda x: x IS NOT NULL), '|') AS reasons FROM {EVIDENCE.sql}")
def row_evidence(spark, sf_dir):
    rules = [(F.expr(c), r) for c, r in RULES_SQL]
    return EVIDENCE.df(spark, sf_dir).select("id", ev.first_failure(rules).alias("reason"), F.array_join(ev.failures(rules), "|").alias("reasons"))


PROBES = Extended(
    "part", "SELECT 'p' || p_partkey AS route, CASE p_size % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'ok' WHEN 2 THEN 'stale' WHEN 3 THEN 'dns' WHEN 4 THEN 'ok' ELSE 'empty' END AS failure FROM part",
    {"route": "string", "failure": "string"}, [(f"r{i:02}", f) for i, f in enumerate(["timeout", "ok", "stale", "timeout", "empty", "stale", "stale", "ok", "dns", "stale"])])


@query("diagnostic_histogram", f"SELECT failure, COUNT(*)::BIGINT AS n, array_to_string(list_sort(list(route))[1:2], '|') AS first FROM {PROBES.sql} WHERE failure <> 'ok' GROUP BY failure")
def diagnostic_histogram(spark, sf_dir):
    bad = PROBES.df(spark, sf_dir).where("failure <> 'ok'")
    counts, detail = ev.histogram(bad, "failure", ["route"], 2)
    return counts.join(detail.groupBy("failure").agg(F.array_join(F.array_sort(F.collect_list("route")), "|").alias("first")), "failure")


@query("host_failure", f"SELECT bool_and(failure IN ('timeout', 'dns')) AS blocked, COUNT(DISTINCT failure)::BIGINT AS kinds, COUNT(*) FILTER (WHERE failure <> 'ok')::BIGINT AS failed FROM {PROBES.sql}")
def host_failure(spark, sf_dir):
    return PROBES.df(spark, sf_dir).agg(F.bool_and(F.col("failure").isin("timeout", "dns")).alias("blocked"), F.countDistinct("failure").alias("kinds"), F.count_if(F.col("failure") != "ok").alias("failed"))


DEPLOYED = Extended(
    "part", "SELECT 'p' || p_partkey AS site, p_brand AS commit, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS expected_commit, p_name AS title, CASE WHEN p_size % 5 <> 0 THEN p_name END AS expected_title FROM part",
    {"site": "string", "commit": "string", "expected_commit": "string", "title": "string", "expected_title": "string"}, [("a", "c1", "c1", "T", "T"), ("b", "c0", "c1", "T", "U"), ("c", None, "c1", None, None)])


@query("deployment_freshness", f"SELECT site, array_to_string(list_filter([CASE WHEN commit IS DISTINCT FROM expected_commit THEN 'commit' END, CASE WHEN title IS DISTINCT FROM expected_title THEN 'title' END], lambda x: x IS NOT NULL), '|') AS mismatches FROM {DEPLOYED.sql}")
def deployment_freshness(spark, sf_dir):
    pairs = [(n, F.col(n), F.col(f"expected_{n}")) for n in ("commit", "title")]
    return DEPLOYED.df(spark, sf_dir).select("site", F.array_join(ev.mismatches(pairs), "|").alias("mismatches"))


INCIDENTS = Inline({"number": "int", "title": "string", "keyed": "boolean", "state": "string"}, [(9, "Search regression", False, "open"), (4, "Search regression", False, "open"), (7, "other", True, "open"), (5, "Search regression", True, "open"), (12, "misc", False, "open")])


@query("canonical_incident", f"SELECT number, n::INTEGER AS n FROM (SELECT number, row_number() OVER (ORDER BY CASE WHEN keyed THEN 0 ELSE 1 END, number) AS n FROM {INCIDENTS.sql} WHERE keyed OR title = 'Search regression')")
def canonical_incident(spark, sf_dir):
    rows_ = INCIDENTS.df(spark).where("keyed OR title = 'Search regression'")
    return rows_.select("number", F.row_number().over(Window.orderBy(F.when(F.col("keyed"), 0).otherwise(1), "number")).alias("n"))


@query(
    "bounded_history",
    """WITH d AS (SELECT user_id, (event_id % 40) AS run, ts, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC) AS d FROM events), n AS (SELECT user_id, run, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run) AS position FROM d WHERE d = 1)
    SELECT user_id, run, position::INTEGER AS position FROM n WHERE position <= 25""",
)
def bounded_history(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("run"), "ts")
    return ev.bounded_history(events, "user_id", "run", "ts", 25).select("user_id", "run", "position")


RESULT = Inline({"query": "string", "passed": "boolean", "score": "double"}, [(f"q{i}", i % 6 != 0, 0.5 + i / 100) for i in range(20)])


@query(
    "regression_validation",
    f"""SELECT array_to_string(list_filter([CASE WHEN n <> 20 THEN 'total' END, CASE WHEN p <> 17 THEN 'passed' END, CASE WHEN abs(p / n - 0.8) > 1e-12 THEN 'rate' END, CASE WHEN d <> n THEN 'repeated' END, CASE WHEN o > 0 THEN 'score' END], lambda x: x IS NOT NULL), '|') AS errors
    FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE passed) AS p, COUNT(DISTINCT query) AS d, COUNT(*) FILTER (WHERE score NOT BETWEEN 0 AND 0.6) AS o FROM {RESULT.sql})""",
)
def regression_validation(spark, sf_dir):
    """A header that says 20 tests, 17 passed and a rate of 0.8, held against the rows."""
    stats = RESULT.df(spark).agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), F.countDistinct("query").alias("d"), F.count_if(~F.col("score").between(0, 0.6)).alias("o"))
    rules = [(F.col("n") == 20, "total"), (F.col("p") == 17, "passed"), (F.abs(F.col("p") / F.col("n") - 0.8) <= 1e-12, "rate"), (F.col("d") == F.col("n"), "repeated"), (F.col("o") == 0, "score")]
    return stats.select(F.array_join(ev.failures(rules), "|").alias("errors"))


@query("gate_boundary", "SELECT * FROM (VALUES (1000::BIGINT, 849::BIGINT, 0.849::DOUBLE, 'fail'), (100, 85, 0.85, 'pass'), (0, 0, 0.0, 'fail')) AS t(total, passed, pass_rate, decision)")
def gate_boundary(spark, sf_dir):
    made = lambda n, k: ev.gate(spark.range(n).select((F.col("id") < k).alias("ok")), "ok", 0.85)
    return made(1000, 849).unionByName(made(100, 85)).unionByName(made(0, 0))


@query(
    "backend_summary",
    """WITH r AS (SELECT role AS backend, turn % 3 <> 0 AS hit, CASE WHEN turn % 2 = 0 THEN length(text) END AS chars FROM conversations)
    SELECT backend, COUNT(*)::BIGINT AS n, COALESCE(AVG(chars) FILTER (WHERE hit), 0) AS chars_of_hits, COUNT(*) FILTER (WHERE hit) / greatest(COUNT(*), 1) AS hit_rate FROM r GROUP BY backend""",
)
def backend_summary(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("role").alias("backend"), (F.col("turn") % 3 != 0).alias("hit"), F.when(F.col("turn") % 2 == 0, F.length("text")).alias("chars"))
    return r.groupBy("backend").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("hit"), F.col("chars"))), F.lit(0.0)).alias("chars_of_hits"), (F.count_if("hit") / F.count("*")).alias("hit_rate"))
