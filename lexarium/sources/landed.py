"""What other systems left behind, as tables: YAML contents, issues, pull requests, search answers, fetched pages and files.

Nothing here calls a network: a fetcher lands its answers as files, and these readers check and shape them."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import absolute_to_page, output_path, reference_kind, resolved
from ..functions.text import without_tags
from ..storage import exists

try:
    import yaml
except ImportError:  # only the YAML sources need it
    yaml = None


def yaml_of(text: str):
    """The value of YAML text, whose first line may name its kind; null for what can't be read."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    try:
        return yaml.safe_load("\n".join(line for line in text.split("\n") if not line.startswith("### YamlMime")))
    except yaml.YAMLError:
        return None


def small_text(spark: SparkSession, paths: list[str]) -> str | None:
    """The text of the first of ``paths`` that is there: a landed file, else its fallback. Small files that the driver reads."""
    found = next((p for p in paths if exists(spark, p)), None)
    return None if found is None else spark.read.text(found, wholetext=True).first()["value"]


def files_with_fallback(spark: SparkSession, wanted: DataFrame, roots: list[str]) -> DataFrame:
    """``path, content, root`` of wanted paths, each from the first root that has it; a file that none has is a row with neither, not an error."""
    out = wanted.select("path").distinct()
    found = None
    for i, root in enumerate(roots):
        base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        local = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:/*", "/")
        rows = files.select(F.substr(local, F.length(base) + 2).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.lit(i).alias("i"), F.lit(root).alias("root"))
        found = rows if found is None else found.unionByName(rows)
    first = found.join(out, "path", "left_semi").groupBy("path").agg(F.min(F.struct("i", "root", "content")).alias("f"))
    return out.join(first, "path", "left").select("path", "f.content", "f.root")


# ---- tables of contents

TOC = "seq int, name string, href string, section string, hierarchy array<string>, folder string"


def _entries(items: list, section: str, above: list[str], folder: str) -> Iterator[tuple]:
    for item in items or []:
        here = [*above, item.get("name", "")]
        if item.get("href"):
            yield item.get("name", ""), item["href"], section, here, folder
        yield from _entries(item.get("items"), section, here, folder)


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def read_toc_tree(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Entries of the table of contents at ``root/path`` and of the tables it refers to, depth first: columns of ``TOC``.

    A top-level item that refers to another table is a section of that table's entries; one that refers to a page is a section of one. Tables are small files and read by
    the driver; one that isn't there gives no rows."""
    rows: list[tuple] = []
    top = yaml_of(small_text(spark, [f"{root}/{path}"]) or "") or []
    for item in top.get("items", []) if isinstance(top, dict) else top:
        name, href = item.get("name", ""), item.get("href") or ""
        if href.split("?")[0].endswith("toc.yml"):
            at = "/".join(_walked([*_folder(path).split("/"), *href.split("?")[0].replace("\\", "/").split("/")]))
            below = yaml_of(small_text(spark, [f"{root}/{at}"]) or "") or {}
            rows += _entries(below.get("items") if isinstance(below, dict) else below, name, [name], _folder(at))
        elif href:
            rows.append((name, href, name, [name], _folder(path)))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TOC)


def _walked(parts: list[str]) -> list[str]:
    out: list[str] = []
    for p in parts:
        if p == "..":
            del out[-1:]
        elif p not in ("", "."):
            out.append(p)
    return out


def manifest_of(toc: DataFrame, own: tuple[str, ...] = (), other: tuple[str, ...] = (), site: str = "", prefix: str = "/", articles: str = "", slugs: dict[str, str] | None = None) -> DataFrame:
    """``seq, name, section, hierarchy, category, source_path, output_path, url`` of table entries: page and table references resolved against their table's folder, site paths that are
    the repository's own as its files, those of others by address."""
    bare = F.regexp_replace("href", r"[?#].*$", "")
    nowhere = ("\0",)
    category = reference_kind(F.col("href"), own or nowhere, other or nowhere)
    inside = F.when(bare.startswith("/"), absolute_to_page(bare, prefix, articles)).otherwise(resolved(F.regexp_replace(bare, r"\\\\", "/"), F.col("folder")))
    source = F.when(category.isin("page", "table"), inside).when(category == "other-repository", bare).otherwise(F.col("href"))
    rows = toc.withColumn("category", category).withColumn("source_path", source)
    out = F.when(F.col("category").isin("page", "table"), output_path(F.col("section"), F.col("source_path"), slugs or {}))
    return rows.select("seq", "name", "section", "hierarchy", "category", "source_path", out.alias("output_path"), F.when(F.col("category") == "other-repository", F.concat(F.lit(site), "source_path")).alias("url"))


# Titles of pivots that a site without a file of them shows, by id.
PIVOT_TITLES = {"python": "Python", "csharp": "C#", "typescript": "TypeScript", "javascript": "JavaScript", "rest": "REST API", "rest-api": "REST API", "java": "Java", "portal": "Portal"}


def pivot_titles(text: str | None, otherwise: dict[str, str] | None = None) -> dict[str, str]:
    """Titles of pivots by id from a YAML file of groups, the first of an id; without any, ``otherwise`` or ``PIVOT_TITLES``."""
    data = yaml_of(text) if text else None
    titles: dict[str, str] = {}
    for group in (data.get("groups") or []) if isinstance(data, dict) else []:
        for pivot in group.get("pivots") or []:
            if pivot.get("id") and (pivot.get("title") or "").strip():
                titles.setdefault(pivot["id"], pivot["title"].strip())
    return titles or dict(PIVOT_TITLES if otherwise is None else otherwise)


def read_navigation(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Navigation nodes and redirects (``source, destination``) of the first site description that is there; both empty if none is."""
    from ..operators.graph import flattened

    config = json.loads(small_text(spark, paths) or "{}")
    nav = config.get("navigation") or {}
    groups = nav if isinstance(nav, list) else [{"group": t.get("tab", ""), "pages": t.get("groups") or t.get("pages") or []} for t in nav.get("tabs", [])] or nav.get("groups", [])
    redirects = [(r["source"].strip("/"), r["destination"].strip("/")) for r in config.get("redirects") or []]
    return flattened(spark, groups), spark.createDataFrame(redirects, "source string, destination string")


# ---- trackers

PULLS = "number int, title string, url string, state string, createdAt string, mergedAt string, labels array<struct<name:string>>"
ISSUES = "number int, body string"


def read_pulls(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pull requests of landed lists, one list a label; one that several lists have is one row, with its labels in ``label_names``."""
    rows = spark.read.schema(PULLS).option("multiLine", True).json(paths).where("number IS NOT NULL")
    once = rows.groupBy("number").agg(*[F.min(c).alias(c) for c in ("title", "url", "state", "createdAt", "mergedAt")], F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col("labels.name"), F.array().cast("array<string>")))))).alias("label_names"))
    return once


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Open issues of a landed list; a file that isn't a JSON list of objects with numbers is an error."""
    raw = small_text(spark, [path])
    try:
        found = json.loads(raw or "")
    except ValueError as problem:
        raise ValueError(f"{path} holds no JSON") from problem
    if not isinstance(found, list) or not all(isinstance(i, dict) and isinstance(i.get("number"), int) for i in found):
        raise ValueError(f"{path} holds no list of issues")
    return spark.createDataFrame([(i["number"], i.get("body")) for i in found], ISSUES)


# ---- answers of search services

RESULTS = "query_id int, rank int, path string, title string, description string, url string"


def site_answers(raw: DataFrame, query: str, body: str, pattern: str) -> DataFrame:
    """Rows of ``RESULTS`` from a site search's JSON answers (``results`` of ``title, url, description``): tags go, addresses become paths by ``pattern``."""
    hits = F.from_json(body, "results array<struct<title:string,url:string,description:string>>")["results"]
    rows = raw.select(F.col(query).alias("query_id"), F.posexplode(hits).alias("i", "h"))
    path = F.coalesce(F.nullif(F.regexp_extract("h.url", pattern, 1), F.lit("")), F.col("h.url"))
    return rows.select("query_id", (F.col("i") + 1).alias("rank"), path.alias("path"), without_tags(F.col("h.title")).alias("title"), without_tags(F.coalesce("h.description", F.lit(""))).alias("description"), F.col("h.url").alias("url"))


def stream_answers(raw: DataFrame, query: str, body: str, pattern: str) -> DataFrame:
    """Rows of ``RESULTS`` from event streams of a tool server: the first data line's content texts, whose ``Title``, ``Link`` and ``Content`` fields are lines; those without a
    path by ``pattern`` go."""
    data = F.regexp_extract(body, r"(?m)^data: (.*)$", 1)
    texts = F.from_json(data, "result struct<content:array<struct<text:string>>>")["result"]["content"]["text"]
    rows = raw.select(F.col(query).alias("query_id"), F.posexplode(texts).alias("i", "t"))
    line = lambda name, rest=r"(.+)$": F.trim(F.regexp_extract("t", rf"(?m)^{name}:\s*{rest}", 1))
    url = line("Link")
    path = F.regexp_replace(F.regexp_extract(url, pattern, 1), "/+$", "")
    content = F.trim(F.regexp_extract("t", r"(?ms)^Content:\s*(.+)\z", 1))
    found = rows.select("query_id", "i", path.alias("path"), line("Title").alias("title"), without_tags(content).alias("description"), url.alias("url")).where("path <> ''")
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("i"))).select("query_id", "rank", "path", "title", "description", "url")


# ---- fetched pages

FETCHED = "route string, status int, body string, final_url string, error string, oversize boolean"


def fetched_pages(raw: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``FETCHED`` from landed answers (``route, status, body, final_url, error``): a failure is a row without status, and a body above the bound is cut there and marked."""
    size = F.octet_length(F.col("body").cast("binary"))
    cut = F.make_valid_utf8(F.substring(F.col("body").cast("binary"), 1, most_bytes).cast("string"))
    failed = F.col("error").isNotNull()
    return raw.select("route", F.when(~failed, F.col("status")).alias("status"), F.when(~failed, F.when(size > most_bytes, cut).otherwise(F.col("body"))).alias("body"), F.when(~failed, F.col("final_url")).alias("final_url"), "error", F.coalesce(size > most_bytes, F.lit(False)).alias("oversize"))


# Tokens of JSON.
JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<word>true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.+-]))')


def strict_object(line: str) -> bool:
    """Whether a line is one JSON object, no object in it repeats a key, and every number is finite.

    Tokens are pulled one at a time: what is held is the names of the open objects, never a value, whatever a line's size."""
    at, end = 0, len(line.rstrip(" \t\n\r"))
    open_: list[set | None] = []  # names of an object, nothing of a list
    wants = "value"  # or: name, name or end, colon, comma, value or end, nothing
    while at < end:
        m = JSON_TOKEN.match(line, at)
        if m is None or wants == "nothing":
            return False
        at = m.end()
        mark = m["mark"]
        if wants in ("name", "name or end") and m["text"]:
            name = json.loads(m["text"])
            if name in open_[-1]:
                return False
            open_[-1].add(name)
            wants = "colon"
        elif wants == "colon" and mark == ":":
            wants = "value"
        elif wants == "comma" and mark == ",":
            wants = "value" if open_[-1] is None else "name"
        elif mark in ("}", "]") and wants in ("comma", "name or end" if mark == "}" else "value or end") and open_ and (open_[-1] is None) == (mark == "]"):
            open_.pop()
            wants = "comma" if open_ else "nothing"
        elif wants in ("value", "value or end") and (mark == "{" or open_ and (mark == "[" or not mark)):
            if mark:
                open_.append(set() if mark == "{" else None)
            elif m["word"] and m["word"][0] in "-0123456789" and math.isinf(float(m["word"])):
                return False
            wants = "name or end" if mark == "{" else "value or end" if mark == "[" else "comma"
        else:
            return False
    return wants == "nothing"


def projected_event(line: Column, schema: str, most: int = 512_000) -> Column:
    """A JSON event: small ones whole as a variant in ``whole``, large ones only as the fields of ``schema``, in ``fields``; both null for a line that isn't one strict JSON object.

    Strict is the same on both sides of the bound: no repeated keys, no NaN or infinity, nothing after the object (``strict_object``)."""

    @F.pandas_udf("boolean")
    def strict(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: t is not None and strict_object(t))

    small, good = F.octet_length(line) < most, strict(line)
    return F.struct(F.when(small & good, F.try_parse_json(line)).alias("whole"), F.when(good, F.from_json(line, schema)).alias("fields"), (~small).alias("large"))
