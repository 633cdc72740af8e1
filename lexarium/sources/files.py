"""Readers and writers: page trees, tables of contents, JSON shards, manifests, indexes, reports."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import upserted
from ..storage import exists

MODEL = "id string, displayName string, publisher string, latestVersion string, regions map<string,array<string>>"


def read_pages(spark: SparkSession, root: str, pattern: str = "*.mdx") -> DataFrame:
    """``path, content`` of all pages below ``root``; the path is relative, without suffix; bad bytes become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    local = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), r"^[a-z]+:/*", "/")
    relative = F.regexp_replace(F.substr(local, F.length(base) + 2), r"\.[^./]+$", "")
    return files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def store_of(path: str):
    """File system and path in it of a Hadoop path, for streams that workers open."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*", "/", path))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, sha256`` of every file below ``root``, empty ones too. The driver lists names; contents stream through the workers, so their size doesn't matter."""
    from pyarrow import fs

    store, base = store_of(root)
    found = [i for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    names = pa.table({"path": pa.array([i.path.removeprefix(base).lstrip("/") for i in found], pa.string()), "bytes": pa.array([i.size for i in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, below = store_of(root)
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with own.open_input_stream(f"{below.rstrip('/')}/{name}", compression=None) as stream:
                    while part := stream.read(1 << 20):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    return spark.createDataFrame(names).repartition(max(1, min(1000, len(found) // 16))).mapInArrow(run, "path string, bytes long, sha256 string")


def toc_entries(items: list[dict], above: tuple[str, ...] = ()) -> Iterator[dict]:
    """Entries of a nested table of contents (``name``, ``href``, ``items``), depth first, with their hierarchy."""
    for item in items:
        name = item.get("name", "")
        if item.get("href"):
            yield {"name": name, "href": item["href"], "hierarchy": list(above)}
        yield from toc_entries(item.get("items") or [], (*above, name))


def read_toc(spark: SparkSession, items: list[dict], section: str) -> DataFrame:
    """A table of contents as rows: ``seq, name, href, section, hierarchy``. The file is small and read by the driver."""
    rows = [(i, e["name"], e["href"], section, [section, *e["hierarchy"]]) for i, e in enumerate(toc_entries(items))]
    return spark.createDataFrame(rows, "seq int, name string, href string, section string, hierarchy array<string>")


def asset_references(pages: DataFrame, path: str, content: str) -> DataFrame:
    """``path, kind, reference`` of distinct includes and images of pages."""
    includes = F.regexp_extract_all(content, F.lit(r"\[!INCLUDE\s*\[[^\]]*\]\(([^)]+)\)\]"), 1)
    images = F.concat(F.regexp_extract_all(content, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1), F.regexp_extract_all(content, F.lit(r':::image[^\n]*?source="([^"]+)"'), 1))
    named = lambda values, kind: F.transform(F.array_distinct(values), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reference")))
    return pages.select(path, F.explode(F.concat(named(includes, "include"), named(images, "image"))).alias("r")).select(path, "r.*")


def read_catalog(spark: SparkSession, paths: list[str], models: str = MODEL) -> DataFrame:
    """Records of catalogue shards, with the shard's name; the time of generation isn't read."""
    shards = spark.read.schema(f"models array<struct<{models.replace(' string', ':string').replace(' map', ':map')}>>").option("multiLine", True).json(paths)
    return shards.select(F.input_file_name().alias("shard"), F.explode("models").alias("m")).select("shard", "m.*")


def read_pages_of_listing(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Members of landed listing pages, one JSON file per page. A last page that still has a token means that pages are missing: an error."""
    pages = spark.read.schema(f"page int, token string, value array<struct<{member}>>").option("multiLine", True).json(path)
    last = F.max_by(F.coalesce("token", F.lit("")), "page")
    open_end = pages.agg(last.alias("token")).first()["token"]
    if open_end:
        raise ValueError("the listing's last page has a continuation token: pages are missing")
    return pages.select(F.explode("value").alias("m")).select("m.*")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    from ..streaming.mentions import FEEDBACK

    return spark.read.schema(FEEDBACK).json(path)


def icons(raw: DataFrame, name: str, data: str) -> DataFrame:
    """``publisher, icon`` from base64 columns; only what is an SVG."""
    text = F.make_valid_utf8(F.try_to_binary(F.col(data), F.lit("base64")).cast("string"))
    return raw.select(F.col(name).alias("publisher"), text.alias("icon")).where(F.contains("icon", F.lit("<svg")))


def operations_of(specs: DataFrame, content: str) -> DataFrame:
    """``path, method, tag, summary`` of an API description's operations; excluded ones and keys that aren't methods go."""
    kind = "paths map<string,map<string,string>>"
    rows = specs.select(F.explode(F.from_json(content, kind)["paths"]).alias("path", "methods")).select("path", F.explode("methods").alias("method", "body"))
    body = F.from_json("body", "summary string, operationId string, tags array<string>, `x-excluded` boolean")
    rows = rows.where(F.lower("method").isin("get", "put", "post", "delete", "patch", "head", "options", "trace")).withColumn("o", body)
    return rows.where(~F.coalesce(F.col("o.x-excluded"), F.lit(False))).select(
        "path", F.lower("method").alias("method"), F.coalesce(F.try_element_at("o.tags", F.lit(1)), F.lit("default")).alias("tag"), F.coalesce("o.summary", F.concat_ws(" ", F.upper("method"), "path")).alias("summary")
    )


# ---- writers


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_line_granular(rows: DataFrame, header: dict, member: str, path: str, order: list[str]) -> None:
    """One JSON document whose header keys stand first, then its members one a line in order, so a changed member is a changed line. A shard of a catalogue: the driver writes
    it as rows come, one at a time."""
    head = json.dumps(header, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[1:-1]

    def lines() -> Iterator[str]:
        yield "{" + (head + "," if head else "") + f"{json.dumps(member)}:[\n"
        before = ""
        for r in rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
            yield before + r["j"]
            before = ",\n"
        yield "\n]}\n"

    write_atomically(path, lines())


def write_pages(pages: DataFrame, root: str, suffix: str = ".mdx") -> int:
    """A file for each ``path, page`` below ``root``, written by the tasks; how many. Paths that lead outside are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        n = 0
        for batch in batches:
            for path, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ".." in path.split("/"):
                    raise ValueError(f"{path} leads outside")
                at = f"{base.rstrip('/')}/{path.lstrip('/')}{suffix}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((page or "").encode("utf-8"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return pages.select("path", "page").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def copy_images(references: DataFrame, source: str, target: str) -> list[str]:
    """Local images of ``reference`` (paths below ``source``) as files by name in one folder, the first of a name; addresses and missing files go. Returns the names."""
    import shutil

    done: list[str] = []
    os.makedirs(target, exist_ok=True)
    for r in references.select("reference").distinct().orderBy("reference").toLocalIterator():
        path, name = r["reference"], r["reference"].split("/")[-1]
        found = os.path.realpath(os.path.join(source, path))
        if path.startswith(("/", "http")) or name in done or not found.startswith(os.path.realpath(source) + os.sep) or not os.path.isfile(found):
            continue
        if not os.path.exists(os.path.join(target, name)):
            shutil.copyfile(found, os.path.join(target, name))
        done.append(name)
    return done


def write_testbench(cases: DataFrame, path: str) -> int:
    """Distinct cases (``query, expected``) as a JSON array; how many. A testbench is a file that people edit, so it is one."""
    rows = [{"query": r["query"], "expected_paths": [r["expected"]], "min_results": 1} for r in cases.select("query", "expected").distinct().orderBy("query", "expected").toLocalIterator()]
    write_atomically(path, json.dumps(rows, indent=2, ensure_ascii=False) + "\n")
    return len(rows)


def enriched_spec(spec: str, examples: dict[str, object], samples: dict[str, list[dict]] | None = None) -> str:
    """An API description with examples and code samples by operation id, where an operation has none of its own."""
    data = json.loads(spec)
    for methods in (data.get("paths") or {}).values():
        for operation in methods.values() if isinstance(methods, dict) else ():
            if not isinstance(operation, dict):
                continue
            own = operation.get("operationId")
            if samples and own in samples:
                operation.setdefault("x-codeSamples", samples[own])
            for status, answer in (operation.get("responses") or {}).items():
                for body in (answer.get("content") or {}).values() if str(status).startswith("2") else ():
                    if own in examples and "example" not in body and "examples" not in body:
                        body["example"] = examples[own]
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"


def write_shards(rows: DataFrame, shard: Column, path: str) -> None:
    """Rows in folders by shard."""
    rows.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").json(path)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that a table of versions points to; null if there is none."""
    return f"{path}/v{spark.read.text(f'{path}/current').first()['value']}" if exists(spark, f"{path}/current") else None


def point_to(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """``rows`` as the next version of a table of versions: ``path/v<n>`` is written whole, then the pointer file names it, so readers never see a
    half-written state. Returns the version's folder. The pointer goes through Hadoop's file system, as tables do."""
    now = current(spark, path)
    number = int(now.rpartition("/v")[2]) + 1 if now else 0
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    put_text(spark, f"{path}/current", str(number))
    return f"{path}/v{number}"


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small file in any of Hadoop's file systems; without ``overwrite`` one that is there is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, overwrite)
    stream.write(bytearray(text.encode()))
    stream.close()


def removed_below(spark: SparkSession, folder: str, keep: set[str]) -> int:
    """Delete what lies in a folder but for the names in ``keep``; how many entries went."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [entry.getPath() for entry in store.listStatus(at)] if store.exists(at) else []
    return sum(store.delete(path, True) for path in found if path.getName() not in keep and not path.getName().startswith("."))


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str]) -> str:
    """Incoming rows into a table of versions, in place of those of the same keys. Returns the new version's folder."""
    now = current(spark, path)
    return point_to(spark, path, upserted(spark.read.parquet(now), incoming, keys) if now else incoming)


def manifest_text(plan: dict) -> str:
    """Byte-reproducible JSON of a plan."""
    return json.dumps(plan, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_atomically(path: str, text: str | Iterator[str]) -> None:
    """A small driver-side file, from a text or its parts, that is either the old or the new one."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, held = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines([text] if isinstance(text, str) else text)
    os.replace(held, path)


def markdown_table(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A report table of at most ``most`` rows; more is an error, for a report is read by people."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [columns, ["---"] * len(columns), *[[cell(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"
