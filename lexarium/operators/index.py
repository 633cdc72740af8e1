"""Stored indexes: of a table of files, found again by what the table is, and of chunk tables with vectors.

Postings, their search and their upkeep are ``segments``'; here stand the tables that are indexed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens as token_list
from ..sources import files
from ..storage import exists, new_path
from . import neighbors, segments
from .search import SYNONYMS, embedded, expanded, fused, top
from .segments import search, term_frequencies, term_stats
from .sync import index_diff

__all__ = ["chunk_metadata", "create", "hybrid", "search", "stored", "synced", "term_frequencies", "term_stats"]


def stored(docs: DataFrame, key: str, how: str, tokens: Column) -> str:
    """Path of the index of a table of files, written once for each state of the table in a session, and anew if it has gone (``storage.release`` frees it).

    A state is the table's plan, so a filtered table isn't the whole one, the names, lengths and times of its files, and ``how``, the caller's name for the way that ``tokens`` cuts texts.
    A table that doesn't come from files alone has no state to know it by and is an error: index it by ``segments.create``."""
    spark, state = docs.sparkSession, _state(docs)
    if state is None:
        raise ValueError("the table has no files to know it by")
    for plan, known, path in _STORED:
        if known == (key, how, state, spark.sparkContext.applicationId) and plan.sameSemantics(docs) and exists(spark, f"{path}/current"):
            return path
    path = new_path(spark, "index")
    segments.create(docs, key, tokens, path)
    _STORED.append((docs, (key, how, state, spark.sparkContext.applicationId), path))
    return path


#: Tables, the states they were in, and their indexes.
_STORED: list[tuple[DataFrame, tuple, str]] = []


def _state(docs: DataFrame) -> tuple | None:
    """Number, bytes and a digest of the names, lengths and times of a table's files, found by one small job; null if a leaf of the plan isn't files."""
    spark = docs.sparkSession
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    if any("relation" not in leaves.apply(i).nodeName().lower() or leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size())):
        return None
    names = docs.inputFiles()
    if not names:
        return None
    listed = spark.read.format("binaryFile").load(names).select("path", "modificationTime", "length")
    return tuple(listed.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())


# ---- chunks with vectors

CHUNKS = "chunk_id string, path string, title string, description string, heading string, content string, content_hash string, embedding array<float>"
_NAMES = [column.split()[0] for column in CHUNKS.split(", ")]


def _words() -> Column:
    return token_list(F.concat_ws(" ", "title", "heading", "content"))


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a chunk table as they are now."""
    found = segments.rows(spark, path) if files.current(spark, path) else None
    return found if found is not None else spark.createDataFrame([], CHUNKS)


def chunk_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Keys and hashes of a stored chunk table: three columns of the scan."""
    return chunks_of(spark, path).select("chunk_id", "path", "content_hash")


SYNONYM_COLUMNS = "`group` int, term string"


def create(spark: SparkSession, path: str, synonyms: tuple[tuple[str, ...], ...] = SYNONYMS, recreate: bool = False) -> bool:
    """An empty chunk table with its synonyms at ``path``, unless there is one; with ``recreate`` in any case. Whether it was made."""
    if files.current(spark, path) and not recreate:
        return False
    spark.createDataFrame([(i, t) for i, g in enumerate(synonyms) for t in g], SYNONYM_COLUMNS).write.mode("overwrite").parquet(f"{path}/synonyms")
    segments.create(spark.createDataFrame([], CHUNKS), "chunk_id", _words(), path, _NAMES)
    return True


def hybrid(spark: SparkSession, path: str, queries: DataFrame, k: int, embed: Callable[[list[str]], list[list[float]]] | None = None, wide: int = 30, near_at: str | None = None) -> DataFrame:
    """Top ``k`` pages of each query (``query_id string, q``): ``query_id, rank, path, chunk_id, title, heading, score``.

    Chunks are ranked by BM25 over the queries with their synonyms and, with ``embed``, by the cosine of vectors, ``wide`` of each; the lists are fused by reciprocal ranks, and a page
    counts by its best chunk.  ``near_at``: an inverted file of the chunks' vectors (``neighbors.build``), in whose nearest cells they are then sought."""
    chunks = chunks_of(spark, path)
    asked = expanded(queries, "query_id", "q", spark.read.parquet(f"{path}/synonyms"))
    lists = [search(spark, path, asked, wide).select("query_id", F.col("doc").alias("chunk_id"), "rank")]
    if embed:
        vectors = embedded(queries.select(F.col("query_id").alias("chunk_id"), "q"), "q", "embedding", embed)
        near = neighbors.search(spark, near_at, vectors, wide, key="chunk_id") if near_at else neighbors.nearest(vectors, chunks, wide, "chunk_id")
        lists.append(near.select(F.col("chunk_id").alias("query_id"), F.col("neighbor").alias("chunk_id"), "rank"))
    scored = fused(lists, ["query_id", "chunk_id"]).join(chunks.select("chunk_id", "path", "title", "heading"), "chunk_id")
    best = top(scored, ["query_id", "path"], [F.round("rrf", 9).desc(), F.col("chunk_id")], 1).drop("rank")
    return top(best, ["query_id"], [F.round("rrf", 9).desc(), F.col("path")], k).select("query_id", "rank", "path", "chunk_id", "title", "heading", F.col("rrf").alias("score"))


def synced(spark: SparkSession, path: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, recreate: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Bring the chunk table at ``path`` to ``chunks`` (columns of ``CHUNKS`` but the vector): how many were new, changed, unchanged and deleted.

    Only new and changed chunks are embedded, and only they are written, as a segment of the index; those that changed or went are marked in it.  Segments are joined when enough of a size are
    there.  A run that is repeated finds nothing to do.  ``recreate`` takes the table for empty, ``dry_run`` only counts."""
    old = spark.createDataFrame([], CHUNKS) if recreate else chunks_of(spark, path)
    states = index_diff(chunks, old, "chunk_id", "content_hash")
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    counts = {s: counts.get(s, 0) for s in ("new", "changed", "unchanged", "deleted")}
    there = bool(files.current(spark, path)) and not recreate
    if dry_run or (there and not counts["new"] + counts["changed"] + counts["deleted"]):
        return counts
    fresh = chunks.join(states.where("state IN ('new', 'changed')").select("chunk_id"), "chunk_id", "left_semi").drop("embedding")
    fresh = embedded(fresh, "content", "embedding", embed) if embed else fresh.withColumn("embedding", F.lit(None).cast("array<float>"))
    if not there:
        segments.create(fresh.select(*_NAMES), "chunk_id", _words(), path, _NAMES)
    else:
        new = fresh.select(*_NAMES) if counts["new"] + counts["changed"] else None
        segments.updated(spark, path, new, _words(), states.where("state = 'deleted'").select("chunk_id"), _NAMES)
        segments.merged(spark, path)
    return counts
