"""Queries of retrieval and its measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import index, neighbors, search, segments
from ..registry import query
from ..session import table
from ..storage import new_path
from .inline import Inline
from .text import duck_tokens

ASKED = Inline({"query_id": "int", "q": "string"}, [(1, "license version public"), (2, "stupid idiot clown"), (3, "the of and"), (4, "token email token")])


def bm25_sql(asked: str, docs: str, k: int, digits: int = 4) -> str:
    """``asked``: query_id, token; ``docs``: doc, t (token list)."""
    return f"""WITH asked AS ({asked}), d AS ({docs}), size AS (SELECT doc, len(t)::BIGINT AS n FROM d), corpus AS (SELECT COUNT(*) AS total, greatest(AVG(n), 1.0) AS mean FROM size),
    post AS (SELECT doc, token, COUNT(*) AS tf FROM (SELECT doc, unnest(t) AS token FROM d) GROUP BY doc, token), terms AS (SELECT token, COUNT(*) AS df FROM post GROUP BY token),
    s AS (SELECT query_id, doc, SUM(ln((total - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (n / mean)))) AS score
          FROM asked JOIN post USING (token) JOIN terms USING (token) JOIN size USING (doc), corpus GROUP BY query_id, doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0)
    SELECT query_id, rank::INTEGER AS rank, doc, round(score, {digits}) AS score FROM r WHERE rank <= {k}"""


DOCS_SQL = f"SELECT doc_id AS doc, {duck_tokens('text')} AS t FROM documents"


def documents_index(spark, sf_dir) -> str:
    """The stored index of the documents: the first query of a session that needs it writes it, the others read it."""
    return index.stored(table(spark, sf_dir, "documents"), "doc_id", "text", text.tokens(F.col("text")))


def found(spark, sf_dir, asked, k):
    return index.search(spark, documents_index(spark, sf_dir), asked, k)


@query("bm25_topk", bm25_sql(f"SELECT query_id, unnest({duck_tokens('q')}) AS token FROM {ASKED.sql}", DOCS_SQL, 10))
def bm25_topk(spark, sf_dir):
    asked = search.query_tokens(ASKED.df(spark), "query_id", "q")
    return found(spark, sf_dir, asked, 10).withColumn("score", F.round("score", 4))


@query("bm25_unindexed", bm25_sql(f"SELECT query_id, unnest({duck_tokens('q')}) AS token FROM {ASKED.sql}", DOCS_SQL, 10))
def bm25_unindexed(spark, sf_dir):
    """The same from the texts themselves: one pass, for a table that is searched once."""
    asked = search.query_tokens(ASKED.df(spark), "query_id", "q")
    return search.bm25(asked, table(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")), 10).withColumn("score", F.round("score", 4))


@query("bm25_batch_topk", bm25_sql(f"SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS token FROM benchmark", DOCS_SQL, 5))
def bm25_batch_topk(spark, sf_dir):
    asked = search.query_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found(spark, sf_dir, asked, 5).withColumn("score", F.round("score", 4))


def grown(spark, sf_dir, merge: bool) -> str:
    """An index that comes to hold the documents in steps: most of them, some with other texts; then the others; then the right texts, and what doesn't belong goes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, words = new_path(spark, "grown"), text.tokens(F.col("text"))
    wrong = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("license "), "text")).otherwise(F.col("text")).alias("text"))
    stray = docs.where("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    segments.create(wrong.unionByName(stray), "doc_id", words, path)
    segments.updated(spark, path, docs.where("doc_id % 3 = 0"), words)
    segments.updated(spark, path, docs.where("doc_id % 3 <> 0 AND doc_id % 7 = 0"), words, stray.select("doc_id"))
    if merge:
        segments.merged(spark, path, [[s["id"] for s in segments.manifest(spark, path).segments]])
    return path


@query("bm25_after_updates", bm25_sql(f"SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS token FROM benchmark", DOCS_SQL, 10))
def bm25_after_updates(spark, sf_dir):
    """Three segments and their deletions answer as an index made at once."""
    asked = search.query_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return segments.search(spark, grown(spark, sf_dir, False), asked, 10).withColumn("score", F.round("score", 4))


@query("bm25_after_merge", bm25_sql(f"SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS token FROM benchmark", DOCS_SQL, 10))
def bm25_after_merge(spark, sf_dir):
    """And so does the one segment that they become."""
    asked = search.query_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return segments.search(spark, grown(spark, sf_dir, True), asked, 10).withColumn("score", F.round("score", 4))


@query("bm25_work", f"SELECT query_id, COUNT(DISTINCT token)::BIGINT AS tokens, TRUE AS skips FROM (SELECT query_id, unnest({duck_tokens('q')}) AS token FROM {ASKED.sql}) WHERE token IN (SELECT unnest({duck_tokens('text')}) FROM documents) GROUP BY query_id")
def bm25_work(spark, sf_dir):
    """How much of their lists searches score: never more blocks than there are."""
    asked = search.query_tokens(ASKED.df(spark), "query_id", "q")
    path = documents_index(spark, sf_dir)
    tokens = asked.join(segments.term_stats(spark, path), "token", "left_semi").groupBy("query_id").agg(F.countDistinct("token").alias("tokens"))
    return segments.opened(spark, path, asked, 10).join(tokens, "query_id").select("query_id", "tokens", (F.col("opened") <= F.col("blocks")).alias("skips"))


@query(
    "term_stats",
    f"""WITH p AS (SELECT DISTINCT doc_id, unnest({duck_tokens('text')}) AS token FROM documents), n AS (SELECT COUNT(*) AS total FROM documents)
    SELECT token, COUNT(*)::BIGINT AS df, round(ln((any_value(total) - COUNT(*) + 0.5) / (COUNT(*) + 0.5) + 1), 6) AS idf FROM p, n GROUP BY token""",
)
def term_stats(spark, sf_dir):
    terms = index.term_stats(spark, documents_index(spark, sf_dir))
    return terms.select("token", "df", F.round(search.idf(F.col("total"), F.col("df")), 6).alias("idf"))


@query("corpus_stats", f"SELECT COUNT(*)::BIGINT AS total_docs, round(AVG(len({duck_tokens('text')})), 6) AS avg_len, MAX(len({duck_tokens('text')}))::BIGINT AS max_len FROM documents")
def corpus_stats(spark, sf_dir):
    n = search.lengths(table(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))
    return n.agg(F.count("*").alias("total_docs"), F.round(F.avg("n"), 6).alias("avg_len"), F.max("n").alias("max_len"))


@query("term_frequencies", f"SELECT doc_id AS doc, token, COUNT(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({duck_tokens('text')}) AS token FROM documents) GROUP BY ALL")
def term_frequencies(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))


GROUPS = Inline({"group": "int", "term": "string"}, [(i, t) for i, g in enumerate(search.SYNONYMS) for t in g] + [(90, "stupid"), (90, "idiot"), (91, "license"), (91, "licensed")])
SHORT = Inline({"query_id": "int", "q": "string"}, [(1, "license"), (2, "stupid stupid"), (3, "deploy"), (4, "released"), (5, "a rate limit of the released"), (6, "rate of limit"), (7, "access control license")])
EXPANDED = f"""(WITH g AS (SELECT "group", list_filter({duck_tokens('term')}, lambda t: true) AS ws FROM {GROUPS.sql.replace('group', '"group"')}),
    q AS (SELECT query_id, {duck_tokens('q')} AS ws FROM {SHORT.sql}),
    m AS (SELECT DISTINCT query_id, "group" FROM q JOIN g ON contains(' ' || array_to_string(q.ws, ' ') || ' ', ' ' || array_to_string(g.ws, ' ') || ' ') AND len(g.ws) > 0),
    o AS (SELECT query_id, unnest(ws) AS token FROM q), a AS (SELECT DISTINCT query_id, unnest(ws) AS token FROM m JOIN g USING ("group"))
    SELECT query_id, token FROM o UNION ALL SELECT a.query_id, a.token FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = a.query_id AND o.token = a.token))"""


@query("synonym_tokens", f"SELECT query_id, token, COUNT(*)::BIGINT AS n FROM {EXPANDED} GROUP BY ALL")
def synonym_tokens(spark, sf_dir):
    return search.expanded(SHORT.df(spark), "query_id", "q", GROUPS.df(spark)).groupBy("query_id", "token").agg(F.count("*").alias("n"))


@query("synonym_expanded_search", bm25_sql(f"SELECT * FROM {EXPANDED}", DOCS_SQL, 10))
def synonym_expanded_search(spark, sf_dir):
    asked = search.expanded(SHORT.df(spark), "query_id", "q", GROUPS.df(spark))
    return found(spark, sf_dir, asked, 10).withColumn("score", F.round("score", 4))


@query(
    "best_chunk_per_doc",
    f"""WITH r AS (SELECT conv_id, turn, len(list_distinct({duck_tokens('text')}))::BIGINT AS score FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM r) SELECT conv_id, turn, score FROM k WHERE n = 1""",
)
def best_chunk_per_doc(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(text.tokens(F.col("text")))).cast("long").alias("score"))
    return search.best_part(turns, "conv_id", "turn", "score")


SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
KNN = f"""SELECT a.vec_id, b.vec_id AS neighbor, {SIM} AS sim, a.label AS own, b.label AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"""


@query("knn_cosine_topk", f"SELECT vec_id, neighbor, rank::INTEGER AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM ({KNN})) WHERE rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 10).withColumn("sim", F.round("sim", 6))


@query(
    "ann_recall",
    "SELECT COUNT(*) FILTER (WHERE vec_id % 20 = 0)::BIGINT AS queries, (COUNT(*) FILTER (WHERE vec_id % 20 = 0) * least(10, COUNT(*) - 1))::BIGINT AS neighbors, TRUE AS reached FROM embeddings",
)
def ann_recall(spark, sf_dir):
    """An inverted file finds nine tenths at least of the exact neighbours of all queries; what it probes is measured on a sample of them."""
    vectors = table(spark, sf_dir, "embeddings")
    path, asked = new_path(spark, "inverted-file"), vectors.where("vec_id % 20 = 0")
    neighbors.build(vectors, path)
    best, found = neighbors.nearest(asked, vectors, 10), neighbors.search(spark, path, asked, 10)
    hits = best.select("vec_id", "neighbor").join(found.select("vec_id", "neighbor", F.lit(1).alias("hit")), ["vec_id", "neighbor"], "left")
    return hits.agg(F.countDistinct("vec_id").alias("queries"), F.count("*").alias("neighbors"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))


@query(
    "knn_label_purity",
    f"""SELECT own AS label, COUNT(*)::BIGINT AS n, AVG((own = other)::INT) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM ({KNN})) WHERE rank <= 10 GROUP BY own""",
)
def knn_label_purity(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    near = search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 10)
    own = vectors.select("vec_id", F.col("label").alias("own"))
    other = vectors.select(F.col("vec_id").alias("neighbor"), F.col("label").alias("other"))
    return near.join(own, "vec_id").join(other, "neighbor").groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("own") == F.col("other")).cast("int")).alias("purity"))


@query(
    "hybrid_rrf",
    f"""WITH lex AS ({bm25_sql(f"SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS token FROM benchmark WHERE item_id % 20 = 0", DOCS_SQL, 20)}),
    vec AS (SELECT vec_id AS query_id, neighbor AS doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM ({KNN})) WHERE rank <= 20 AND vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)),
    f AS (SELECT query_id, doc, SUM(1.0 / (60 + rank)) AS rrf FROM (SELECT query_id, doc, rank FROM lex UNION ALL SELECT query_id, doc, rank FROM vec) GROUP BY ALL)
    SELECT query_id, doc, rank::INTEGER AS rank, round(rrf, 8) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, doc) AS rank FROM f) WHERE rank <= 10""",
)
def hybrid_rrf(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    lex = found(spark, sf_dir, search.query_tokens(items, "item_id", "text"), 20)
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    vec = search.nearest(asked, vectors, 20).select(F.col("vec_id").alias("query_id"), F.col("neighbor").alias("doc"), "rank")
    ranked = search.top(search.fused([lex, vec], ["query_id", "doc"]), ["query_id"], [F.round("rrf", 9).desc(), F.col("doc")], 10)
    return ranked.select("query_id", "doc", "rank", F.round("rrf", 8).alias("rrf"))


# ---- measures of retrieval: benchmark items are queries, documents that contain the passage are expected


def hits(spark, sf_dir, k: int = 10):
    """``item_id, n_expected, first_rank``: the rank of the first expected document among the k found."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hit = found(spark, sf_dir, search.query_tokens(items, "item_id", "text"), k)
    near = hit.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "query_id").join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body")), "doc")
    good = near.where(F.contains("body", F.col("passage"))).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    n = hit.groupBy("query_id").agg(F.count("*").alias("n_found"))
    return items.select(F.col("item_id").alias("query_id")).join(n, "query_id", "left").join(good, "query_id", "left").select("query_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), "first_rank")


HITS = f"""f AS ({bm25_sql(f"SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS token FROM benchmark", DOCS_SQL, 10)}),
    g AS (SELECT f.query_id, MIN(rank) FILTER (WHERE contains(d.text, b.text)) AS first_rank, COUNT(*) AS n_found FROM f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc GROUP BY f.query_id),
    h AS (SELECT item_id AS query_id, COALESCE(n_found, 0)::BIGINT AS n_found, first_rank FROM benchmark LEFT JOIN g ON g.query_id = item_id)"""


@query("first_relevant_rank", f"WITH {HITS} SELECT * FROM h")
def first_relevant_rank(spark, sf_dir):
    return hits(spark, sf_dir)


@query("hit_and_mrr", f"WITH {HITS} SELECT COUNT(*)::BIGINT AS n, AVG((first_rank IS NOT NULL)::INT) AS hit_at_k, round(AVG(COALESCE(1.0 / first_rank, 0)), 6) AS mrr FROM h")
def hit_and_mrr(spark, sf_dir):
    hit = F.col("first_rank").isNotNull().cast("int")
    return hits(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(hit).alias("hit_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


@query(
    "testbench_gate",
    f"""WITH {HITS}, t AS (SELECT COUNT(*)::BIGINT AS total, COUNT(*) FILTER (WHERE first_rank IS NOT NULL AND n_found >= 1)::BIGINT AS passed FROM h)
    SELECT total, passed, CASE WHEN total = 0 THEN 0 ELSE passed / total END AS pass_rate, CASE WHEN total >= 1 AND passed / greatest(total, 1) >= 0.85 THEN 'pass' ELSE 'fail' END AS decision FROM t""",
)
def testbench_gate(spark, sf_dir):
    from ..operators.evaluation import gate

    rows = hits(spark, sf_dir).select((F.col("first_rank").isNotNull() & (F.col("n_found") >= 1)).alias("ok"))
    return gate(rows, "ok", 0.85, 1)


@query(
    "sufficiency",
    f"""WITH {HITS}, c AS (SELECT h.query_id, h.first_rank IS NOT NULL AS hit, COALESCE(MAX(length(d.text)) FILTER (WHERE f.rank = h.first_rank), 0) AS chars FROM h LEFT JOIN f USING (query_id) LEFT JOIN documents d ON d.doc_id = f.doc GROUP BY ALL)
    SELECT COUNT(*)::BIGINT AS n, AVG((hit AND chars >= 500)::INT) AS one_step, AVG(hit::INT) AS two_step, COALESCE(AVG(chars) FILTER (WHERE hit), 0) AS mean_chars FROM c""",
)
def sufficiency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = found(spark, sf_dir, search.query_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text"), 10)
    chars = ranked.join(docs.select(F.col("doc_id").alias("doc"), F.length("text").alias("chars")), "doc").select("query_id", F.col("rank").alias("first_rank"), "chars")
    rows = hits(spark, sf_dir).join(chars, ["query_id", "first_rank"], "left").select(F.col("first_rank").isNotNull().alias("hit"), F.coalesce("chars", F.lit(0)).alias("chars"))
    return rows.agg(
        F.count("*").alias("n"), F.avg((F.col("hit") & (F.col("chars") >= 500)).cast("int")).alias("one_step"), F.avg(F.col("hit").cast("int")).alias("two_step"),
        F.coalesce(F.avg(F.when(F.col("hit"), F.col("chars"))), F.lit(0.0)).alias("mean_chars"),
    )
