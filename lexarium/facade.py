"""The engine's tools, resources and prompts in one place: search, feedback, lookup and sections over a table of pages."""

from __future__ import annotations

import json
import logging
import random
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import graph, index, search, segments
from .storage import exists, new_path
from .streaming.mentions import append_feedback


log = logging.getLogger(__name__)


class Backend(Protocol):
    """Another way to search: rows as ``Library.search_docs`` gives them, and the text of a page, null if it has none."""

    def search(self, query: str, limit: int) -> DataFrame: ...

    def get_content(self, path: str) -> str | None: ...


class Library:
    """Pages (``path, content``) and their navigation.

    ``backend``, a function or a ``Backend``, may answer searches instead; if it fails or finds nothing, the lexical index does, with the query as asked, and the
    failure is logged.  ``rewrite`` is applied for the backend only."""

    def __init__(self, spark: SparkSession, pages: DataFrame, nav: list | None = None, backend: Backend | Callable[[str, int], DataFrame] | None = None, rewrite: Callable[[str], str] = lambda q: q):
        self.spark, self.pages, self.backend, self.rewrite = spark, pages, backend, rewrite
        self.config = nav or []
        self._own: str | None = None
        self.nav = graph.flattened(spark, self.config)

    def search_docs(self, query: str, limit: int = 10) -> DataFrame:
        """``rank, path, title, description, score``; no rows for a query without tokens."""
        if self.backend:
            ask = getattr(self.backend, "search", self.backend)
            try:
                found = ask(self.rewrite(query), limit)
                if not found.isEmpty():
                    return found
            except Exception:  # whatever a caller's backend raises, the lexical index answers instead
                log.warning("the search backend failed", exc_info=True)
        asked = search.query_tokens(self.spark.createDataFrame([(1, query)], "id int, q string"), "id", "q")
        ranked = index.search(self.spark, self._index(), asked, limit).drop("query_id")
        meta = self.pages.select(F.col("path").alias("doc"), text.title(F.col("content")).alias("title"), text.description(F.col("content")).alias("description"))
        return ranked.join(meta, "doc").select("rank", F.col("doc").alias("path"), "title", "description", F.round("score", 4).alias("score")).orderBy("rank")

    def _index(self) -> str:
        """Path of the index of the pages: that of their files' state, or one made by the first search for pages that aren't files."""
        words = text.page_tokens(F.col("content"))
        try:
            return index.stored(self.pages, "path", "page", words)
        except ValueError:
            if self._own is None or not exists(self.spark, f"{self._own}/current"):
                self._own = new_path(self.spark, "pages-index")
                segments.create(self.pages, "path", words, self._own)
            return self._own

    def get_doc(self, path: str) -> DataFrame:
        """The page at a path, else the first whose path ends with it."""
        asked = self.spark.createDataFrame([(path,)], "asked string")
        return graph.lookup(self.pages, asked).join(self.pages, "path")

    def list_sections(self) -> DataFrame:
        return graph.pages_below(self.nav)

    def get_section(self, name: str) -> DataFrame:
        """Pages of the best matching section, with titles."""
        best = graph.matched_sections(self.nav, self.spark.createDataFrame([(name,)], "asked string"))
        group = self.nav.where("kind = 'group'").join(best.select(F.col("section").alias("value")), "value").select(F.col("node_id").alias("g"))
        parts = F.split(F.regexp_replace("node_id", "/$", ""), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
        pages = self.nav.where("kind = 'page'").select("node_id", F.col("value").alias("path"), F.explode(above).alias("g"))
        inside = pages.join(group, "g").select("node_id", "path").distinct()
        titles = self.pages.select("path", text.title(F.col("content")).alias("title"))
        return inside.join(titles, "path", "left").select("node_id", "path", F.coalesce(text.or_none(F.col("title")), F.col("path")).alias("title")).orderBy("node_id")

    def content_of(self, path: str) -> str | None:
        """Text of the page at a path: the backend's, if it is one that has texts, else the table's."""
        if hasattr(self.backend, "get_content"):
            return self.backend.get_content(path)
        row = self.get_doc(path).select("content").first()
        return row["content"] if row else None

    # ---- resources

    def navigation_resource(self) -> str:
        """The navigation as JSON."""
        return json.dumps({"navigation": {"groups": self.config}}, ensure_ascii=False)

    def page_resource(self, *parts: str) -> str:
        """A page by the parts of its path, exactly; a text that says so if there is none."""
        path = "/".join(parts)
        row = self.pages.where(F.col("path") == path).select("content").first()
        return row["content"] if row else f"Document not found: {path}"

    # ---- prompts

    def prompt(self, name: str, **fields: str) -> list[dict[str, str]]:
        """Messages of a prompt (``explain``, ``build`` or ``compare``) with its fields filled in; a field that isn't given is empty, an unknown prompt is an error."""
        role, ask, points, close = PROMPTS[name]
        given = {"concept": "", "kind": "", "tools": "", "option_a": "", "option_b": "", "context": ""} | fields
        given |= {"with_tools": f" that uses {given['tools']}" if given["tools"] else "", "in_context": f" Context: {given['context']}" if given["context"] else ""}
        listed = "\n".join(f"{i}. {p}" for i, p in enumerate(points, 1))
        return [{"role": "assistant", "content": role}, {"role": "user", "content": f"{ask.format(**given)}\n{listed}\n\n{close.format(**given)}"}]

    def submit_feedback(self, folder: str, **fields) -> None:
        row = self.spark.createDataFrame([fields], "event string, timestamp string, user_request string, query string, result_paths array<string>, expected_result string, proposed_solution string")
        append_feedback(row, folder)


#: By name: who answers, what is asked, its points, and where to look.
PROMPTS = {
    "explain": (
        "You are an expert on these documents. Ground every answer in them.", "Explain '{concept}' from the documents:",
        ("What it is and why it matters", "What it offers", "How to begin", "What is related, and what comes next"), "Search the documents for '{concept}'.",
    ),
    "build": (
        "You help to build with these documents at hand.", "Guide me through building {kind}{with_tools}:",
        ("What is needed first", "Setting up and deploying", "Adding tools and connections", "Testing and watching it run"), "Find the pages on {kind} with search_docs.",
    ),
    "compare": (
        "You advise on choices, and ground comparisons in these documents.", "Compare '{option_a}' with '{option_b}'.{in_context} For each:",
        ("When to use it", "What speaks for and against it", "What it costs", "What you recommend for common cases"), "Search the documents for both.",
    ),
}


def retry_after(raw: str | None, now: float | None = None) -> float | None:
    """Seconds to wait from a header: whole seconds, or a date; null if it can't be read."""
    from email.utils import parsedate_to_datetime

    if raw is None or not raw.strip():
        return None
    try:
        return max(0.0, float(int(raw)))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(raw).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, told: float | None = None, jitter: float = 0.0, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: what the server told, else doubling from ``base``; never over ``most``."""
    wait = told if told is not None else base * 2 ** (attempt - 1)
    return min(most, wait) + jitter * draw()
