"""Sections and overlapping chunks of Markdown pages."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import text
from .batches import sliced

HEADING = r"^#{2,4}\s+"
#: A break before a heading line; lines hold no white space but blanks and tabs.
BREAK = r"\n(?=#{2,4}[ \t])"


def section_list(content: Column) -> Column:
    """Sections of a page (``section, heading, body``) that start at headings of levels two to four; before the first, ``Introduction``.

    A heading line belongs to its section; empty sections go but keep their number; fences aren't looked at, so a heading in one counts.
    A page is split once, at its headings: what a lambda names of the page would be made again for every line."""
    parts = F.split(F.regexp_replace(text.without_front_matter(content), text.LINE_BREAK, "\n"), BREAK)
    first = lambda part: F.substring_index(part, "\n", 1)
    named = F.transform(parts, lambda part: F.struct(
        F.coalesce(text.or_none(F.when(first(part).rlike(HEADING), text.strip(F.regexp_replace(first(part), HEADING, "")))), F.lit("Introduction")).alias("heading"),
        text.strip(part).alias("body"),
    ))
    return F.transform(F.filter(named, lambda s: s["body"] != ""), lambda s, i: F.struct(i.alias("section"), s["heading"].alias("heading"), s["body"].alias("body")))


def sections(pages: DataFrame, key: str, content: str) -> DataFrame:
    """``key, section, heading, body`` of every page's ``section_list``; a page is cut where it lies."""
    return pages.select(key, F.inline(section_list(F.col(content)))).select(key, "heading", "body", "section")


def windows(line: str, ends: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Cut points of a line whose sentences end at ``ends``: each window takes as many whole sentences as fit, the next starts
    ``overlap`` characters before its end, past white space, and what no sentence end is in reach of is cut hard."""
    start = taken = 0
    while taken < len(ends):
        if ends[taken] - start > most:
            yield start, start + most
            start += most
            continue
        taken = bisect_right(ends, start + most)
        end = ends[taken - 1]
        yield start, end
        start = max(start, end - overlap) if overlap > 0 else end
        while start < len(line) and line[start].isspace():
            start += 1


def split_with_overlap(body: str, most: int, overlap: int) -> list[str]:
    """Pieces of at most ``most`` characters: the text in sentences, as one line, cut into ``windows``. Nothing is lost; a text that fits stays as it is."""
    if len(body) <= most:
        return [body]
    sentences = [s for s in (s.strip() for s in re.split(r"(?<=[.!?])\s+", body)) if s]
    line = " ".join(sentences)
    ends = [end - 1 for end in accumulate(len(s) + 1 for s in sentences)]
    return [line[a:b] for a, b in windows(line, ends, most, overlap)]


#: Columns of ``chunks``.
CHUNK = "chunk_id string, path string, title string, description string, heading string, content string, char_count int, content_hash string, section int, part int"


def chunks(pages: DataFrame, path: str, content: str, most: int = 4000, overlap: int = 400) -> DataFrame:
    """``chunk_id, path, title, description, heading, content, char_count, content_hash, section, part``: sections cut with overlap, prefixed by title and heading. Each row of ``pages`` is a page of its own."""
    body = F.col(content)
    page_title = F.coalesce(text.or_none(text.title(body)), F.element_at(F.split(path, "/"), -1))
    cut_pages = pages.select(F.col(path).alias("path"), page_title.alias("title"), text.description(body).alias("description"), section_list(body).alias("_sections"))
    listed = cut_pages.select("path", "title", "description", F.inline("_sections"))
    whole = listed.withColumn("whole", text.strip(F.concat(F.col("title"), F.lit(" > "), F.col("heading"), F.lit("\n\n"), F.col("body"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5):
            pieces = [split_with_overlap(t, most, overlap) for t in batch.column(5).to_pylist()]
            row = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int32())
            own = [batch.column(i).take(row) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([n for p in pieces for n in range(len(p))], pa.int32()), pa.array([t for p in pieces for t in p], pa.string())], [*batch.schema.names[:5], "part", "content"])

    rows = whole.select("path", "title", "description", "heading", "section", "whole").mapInArrow(cut, "path string, title string, description string, heading string, section int, part int, content string")
    raw_id = F.concat(F.col("path"), F.lit("#"), text.slug(F.col("heading")), F.lit("#"), F.col("section"), F.lit("-"), F.col("part"))
    return rows.select(text.safe_key(raw_id).alias("chunk_id"), "path", "title", "description", "heading", "content", F.length("content").alias("char_count"), F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"), "section", "part")


class Pieces:
    """``SELECT … FROM pieces(TABLE(rows), 'column', most, overlap)``: the rows with ``part`` and ``piece``, the overlapping pieces of a text column; all other columns come along as they are.

    A polymorphic table function: its columns are found when a query is analysed. Null texts give no rows."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.analyzed = analyzed

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, most: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("pieces() takes a table: pieces(TABLE(rows), 'column', most, overlap)")
        name = next((f.name for f in rows.dataType.fields if f.name.lower() == str(column.value).lower()), None)
        if name is None:
            raise ValueError(f"there is no column {column.value}")
        if not 0 <= (overlap.value or 0) < (most.value or 0):
            raise ValueError("overlap must be below the most characters of a piece")
        fields = [*rows.dataType.fields, T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType())]
        return AnalyzeResult(schema=T.StructType(fields))

    def eval(self, row: Row, column: str, most: int, overlap: int) -> Iterator[tuple]:
        name = next(f for f in row.__fields__ if f.lower() == column.lower())
        if row[name] is not None:
            for part, piece in enumerate(split_with_overlap(row[name], most, overlap)):
                yield (*row, part, piece)


def registered(spark: SparkSession) -> None:
    """Make ``pieces`` known to a session's SQL."""
    spark.udtf.register("pieces", udtf(Pieces))
