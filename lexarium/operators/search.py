"""Lexical retrieval: postings, term statistics, BM25, synonyms, and fusion of ranked lists.

The layout is an inverted index as tables: ``postings(doc, token, tf)``, ``lengths(doc, n)``, ``terms(token, df)``.  A batch of
queries is scored by equi-joins on tokens, so any number of queries is one pass over their tokens' postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens as token_list
from .neighbors import nearest  # noqa: F401, the exact one stands beside the other ways to search

K1, B = 1.5, 0.75
#: Synonyms that are broadcast; a longer dictionary is joined.
MOST_TERMS = 100_000

# Groups of search terms that stand for each other.
SYNONYMS = (
    ("rate limit", "throttle", "quota", "rate limiting", "throttling", "429"),
    ("safety", "guardrails", "content filter", "content filtering", "harm"),
    ("getting started", "quickstart", "tutorial", "onboarding", "first steps"),
    ("troubleshoot", "debug", "fix", "diagnose", "error", "problem", "issue"),
    ("evaluate", "evaluation", "assess", "test", "benchmark", "measure"),
    ("prompt injection", "jailbreak", "prompt attack", "prompt shield"),
    ("rbac", "role based access", "permissions", "authorization", "access control"),
    ("rag", "retrieval augmented generation", "grounding", "knowledge retrieval"),
    ("mcp", "model context protocol"),
    ("deploy", "deployment", "provision", "release", "ship"),
    ("observe", "observability", "monitor", "trace", "tracing", "logging"),
    ("fine-tune", "fine-tuning", "customize", "train", "training"),
)


def token_rows(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """One row per token occurrence."""
    return docs.select(F.col(key).alias("doc"), F.explode(tokens).alias("token"))


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``doc, token, tf``: partial counts before the shuffle."""
    return token_rows(docs, key, tokens).groupBy("doc", "token").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``doc, n`` of every document, also those without tokens; no shuffle."""
    return docs.select(F.col(key).alias("doc"), F.size(tokens).cast("long").alias("n"))


def term_stats(post: DataFrame) -> DataFrame:
    """``token, df``."""
    return post.groupBy("token").agg(F.count("*").alias("df"))


def idf(total: Column, df: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def bm25(queries: DataFrame, docs: DataFrame, key: str, tokens: Column, k: int, query_key: str = "query_id") -> DataFrame:
    """Top ``k`` documents of each query: ``query_id, rank, doc, score``.

    ``queries``: ``query_id, token``, a row per occurrence, so a repeated token counts twice.  Ties go to the smaller key.  Only the queries'
    tokens are shuffled: the token filter joins before postings are counted.  Scores are positive by construction of idf."""
    asked = queries.groupBy(query_key, "token").agg(F.count("*").alias("times"))
    wanted = asked.select("token").distinct()
    base = docs.select(F.col(key).alias("doc"), tokens.alias("tokens"))
    size = base.select("doc", F.size("tokens").cast("long").alias("n"))
    corpus = size.agg(F.count("*").alias("total"), F.greatest(F.avg("n"), F.lit(1.0)).alias("mean"))
    rows = base.select("doc", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token")).join(wanted, "token")
    post = rows.groupBy("doc", "token").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    terms = post.groupBy("token").agg(F.count("*").alias("df"))
    scored = post.join(terms, "token").join(asked, "token").crossJoin(F.broadcast(corpus))  # one row
    norm = 1 - B + B * (F.col("n") / F.col("mean"))
    part = F.col("times") * idf(F.col("total"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)
    totals = scored.groupBy(query_key, "doc").agg(F.sum(part).alias("score")).where("score > 0")
    return top(totals, [query_key], [F.round("score", 9).desc(), F.col("doc")], k).select(query_key, "rank", "doc", "score")


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; Spark keeps k rows per group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def query_tokens(queries: DataFrame, key: str, text: str, name: str = "query_id") -> DataFrame:
    return queries.select(F.col(key).alias(name), F.explode(token_list(F.col(text))).alias("token"))


def expanded(queries: DataFrame, key: str, text: str, groups: DataFrame, name: str = "query_id") -> DataFrame:
    """``name, token`` of queries, with the tokens of the other members of their synonym groups added, each once.

    ``groups``: ``group, term``, a small dictionary; a term may be several words, and is there when its tokens stand together in the query."""
    listed = groups.select("group", token_list(F.col("term")).alias("words")).where(F.size("words") > 0)
    longest = listed.agg(F.max(F.size("words"))).first()[0] or 1
    own = queries.select(F.col(key).alias(name), token_list(F.col(text)).alias("words"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)) + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    spans = F.flatten(F.array(*[F.when(F.size("words") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))
    named = listed.select("group", F.array_join("words", " ").alias("term"), "words")
    if listed.count() <= MOST_TERMS:
        named = F.broadcast(named)
    mine = own.select(name, F.explode(F.array_distinct(spans)).alias("term")).join(named.select("group", "term"), "term").select(name, "group").distinct()
    other = mine.join(named.select("group", F.explode("words").alias("token")), "group").select(name, "token").distinct()
    rows = own.select(name, F.explode("words").alias("token"))
    return rows.unionByName(other.join(rows.distinct(), [name, "token"], "left_anti"))


def best_part(scored: DataFrame, whole: str, part: str, score: str) -> DataFrame:
    """The best part of each whole: highest score, then the smallest part."""
    return top(scored, [whole], [F.col(score).desc(), F.col(part)], 1).drop("rank")


def fused(lists: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``keys`` and ``rank``): sum of 1 / (k + rank)."""
    all_lists = lists[0].select(*keys, "rank")
    for more in lists[1:]:
        all_lists = all_lists.unionByName(more.select(*keys, "rank"))
    return all_lists.groupBy(*keys).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def caption(sentences: Column, query: Column) -> Column:
    """The sentence that shares most tokens with the query, the earliest of equals."""
    scored = F.transform(sentences, lambda s, i: F.struct((-F.size(F.array_intersect(token_list(s), query))).alias("miss"), i.alias("i"), s.alias("s")))
    return F.array_min(scored)["s"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embedded(rows: DataFrame, text: str, out: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """``rows`` with ``out``, the vectors that ``embed`` gives for the texts, ``batch`` at a time, in each task. Null texts are embedded as empty ones.

    ``embed`` is the caller's: a model in the worker, or a client that ``campaign.retried`` guards."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for start in range(0, found.num_rows, batch):
                part = found.slice(start, batch)
                vectors = embed([t or "" for t in part.column(at).to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], [*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def reranked(found: DataFrame, query: str, text: str, score: Callable[[list[str], list[str]], list[float]], k: int, by: str = "query_id") -> DataFrame:
    """The first ``k`` of each query's rows by the caller's ``score(queries, texts)``, in place of their rank; ties keep the order they had."""
    q, t = found.columns.index(query), found.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(batch.column(q).to_pylist(), [x or "" for x in batch.column(t).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(s) for s in scores], pa.float64())], [*batch.schema.names, "_score"])

    scored = found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("_score", T.DoubleType())]))
    return top(scored.withColumnRenamed("rank", "_before"), [by], [F.col("_score").desc(), F.col("_before")], k).withColumnRenamed("_score", "rerank_score").drop("_before")
