"""WARC records, and resolution of not-modified revisits.

A revisit says that a page had not changed.  It is resolved by an as-of join: by canonical URL, to the latest earlier
full response; its validators must agree with that response's, and the headers that a 304 may
update are merged into the response's headers.

The join is a running maximum over (URL, time), not a pairing.  Time is cut into ranges at quantiles of all
records, and a range starts from the latest response of the ranges before it, so one URL that holds a large
part of the records is spread over many tasks.  Everything but the WARC reader is DataFrame code.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import store_of

# Response headers that a 304 updates in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't choose the content.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|mc_eid|ref)="
# What a revisit's profile says, by the end of its address.
NOT_MODIFIED, SAME_PAYLOAD = "server-not-modified", "identical-payload-digest"
TIME_RANGES = 64
#: Bytes read at once, the largest block of a record that is given as payload, and what is kept of a larger one, for its headers.
CHUNK, MOST_PAYLOAD, HEAD = 1 << 20, 256 << 20, 1 << 16


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, trailing slash and tracking parameters dropped; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _etag(value: Column) -> Column:
    """Weak comparison: the mark of a weak validator is dropped."""
    return F.regexp_replace(value, r"^W/", "")


def resolve(records: DataFrame, ranges: int = TIME_RANGES) -> DataFrame:
    """Every revisit with its response.

    ``records``: ``record_id``, ``url``, ``ts long``, ``kind`` (``response`` or ``revisit``; others are ignored), ``headers
    map<string,string>`` with lower-case names; and if they are there, ``status int``, ``truncated string``, ``profile string``, ``refers_to_url``
    and ``refers_to_ts``.  Returns per revisit ``record_id, canonical_url, ts, outcome, response_id,
    response_ts, headers``.

    A response is full if its status is from 200 to 299 but not 206, or unknown, and it isn't truncated.  Earlier is strictly earlier than the
    revisit, and if the revisit names the time it refers to, not later than that; a URL that it refers to stands for its own.  Of
    responses at one time the one with the largest id counts.  ``outcome``:

    * ``resolved``: etags agree or, if either has none, last-modified does; ``headers`` are merged
    * ``mismatch``: a validator that both have differs; ``no_validator``: they share none; the headers are the revisit's
    * ``no_response``: nothing earlier; also for a null URL or time
    * ``other_profile``: the revisit doesn't say "not modified" by its profile, or without one by a status that is null or 304: an equal payload, say.  Its validators say
      nothing of a stored state; no response is given

    Repeated revisits are resolved one by one; null headers are empty; other columns are ignored; an empty table gives an empty result."""
    of = lambda name, kind: F.col(name).cast(kind) if name in records.columns else F.lit(None).cast(kind)
    status, profile = of("status", "int"), F.lower(of("profile", "string"))
    whole = (status.isNull() | (status.between(200, 299) & (status != 206))) & of("truncated", "string").isNull()
    told = F.when(profile.isNull() | (profile == ""), status.isNull() | (status == 304)).otherwise(profile.contains(NOT_MODIFIED))
    response, ts = F.col("kind") == "response", F.col("ts").cast("long")
    rows = records.where((response & whole) | (F.col("kind") == "revisit")).select(
        "record_id",
        canonical_url(F.when(response, F.col("url")).otherwise(F.coalesce(of("refers_to_url", "string"), F.col("url")))).alias("canonical_url"),
        ts.alias("own_ts"),
        F.when(response, ts).otherwise(F.least(ts, of("refers_to_ts", "long") + 1) + ts * 0).alias("ts"),
        response.alias("full"),
        told.alias("told"),
        F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))).alias("headers"),
    )
    cuts = rows.agg(F.percentile_approx("ts", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    # a null URL meets no other, and stays out of the windows
    null = rows.where(F.col("canonical_url").isNull() & ~F.col("full"))
    rows = rows.where(F.col("canonical_url").isNotNull()).withColumn("part", F.coalesce(part, F.lit(-1)))

    own = F.when(F.col("full") & F.col("ts").isNotNull(), F.struct(F.col("ts").alias("response_ts"), F.col("record_id").alias("response_id"), F.col("headers").alias("stored")))
    by_part = rows.groupBy("canonical_url", "part").agg(F.max(own).alias("latest"))
    ahead = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_part.select("canonical_url", "part", F.max("latest").over(ahead).alias("carried"))
    earlier = Window.partitionBy("canonical_url", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    revisits = rows.withColumn("inside", F.max(own).over(earlier)).where(~F.col("full"))
    found = revisits.join(carried, ["canonical_url", "part"], "left").withColumn("r", F.when(F.col("ts").isNotNull() & F.col("told"), F.coalesce("inside", "carried")))

    mine, stored = F.map_from_entries("headers"), F.map_from_entries("r.stored")
    tag, date = _etag(F.try_element_at(mine, F.lit("etag"))), F.try_element_at(mine, F.lit("last-modified"))
    stored_tag, stored_date = _etag(F.try_element_at(stored, F.lit("etag"))), F.try_element_at(stored, F.lit("last-modified"))
    outcome = (
        F.when(~F.col("told"), "other_profile")
        .when(F.col("r").isNull(), "no_response")
        .when(tag.isNotNull() & stored_tag.isNotNull(), F.when(tag == stored_tag, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & stored_date.isNotNull(), F.when(date == stored_date, "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    permitted = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    found = found.withColumn("outcome", outcome)
    out = found.select("record_id", "canonical_url", F.col("own_ts").alias("ts"), "outcome", "r.response_id", "r.response_ts", F.when(F.col("outcome") == "resolved", merged).otherwise(mine).alias("headers"))
    lost = null.select("record_id", "canonical_url", F.col("own_ts").alias("ts"), F.when(F.col("told"), "no_response").otherwise("other_profile").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast("long").alias("response_ts"), F.map_from_entries("headers").alias("headers"))
    return out.unionByName(lost)


def header_text(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


# ---- WARC files


class _Plain:
    """What a file's gzip members hold, as far as they can be read, or the file itself: read by lines and sizes, a chunk at a time."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.read_raw, self.chunk = stream.read, chunk
        self.held, self.at = bytearray(), 0
        first = self.read_raw(chunk)
        self.member = zlib.decompressobj(wbits=31) if first[:2] == b"\x1f\x8b" else None
        self.over = not first
        self._take(first)

    def _take(self, raw: bytes) -> None:
        if self.member is None:
            self.held += raw
            return
        try:
            while raw:
                # a chunk may hold much more than its size: it is opened piece by piece, as it is asked for
                self.held += self.member.decompress(raw, self.chunk)
                raw = self.member.unconsumed_tail
                if self.member.eof:
                    raw, self.member = self.member.unused_data, zlib.decompressobj(wbits=31)
                elif raw:
                    self.left = raw
                    return
        except zlib.error:
            self.over = True
        self.left = b""

    left = b""

    def _more(self) -> bool:
        if self.at > self.chunk:
            del self.held[: self.at]
            self.at = 0
        if self.over:
            return False
        raw = self.left or self.read_raw(self.chunk)
        self.left = b""
        if not raw:
            self.over = True
            return False
        self._take(raw)
        return True

    def line(self) -> bytes:
        """The next line with its end; empty at the end of the file."""
        begin = self.at
        while (end := self.held.find(b"\n", begin)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                end = len(self.held) - 1
                break
            begin = self.at + seen
        got = bytes(self.held[self.at : end + 1])
        self.at = end + 1
        return got

    def take(self, size: int, keep: int) -> bytes | None:
        """The first ``keep`` of the next ``size`` bytes, all of which are passed; None if the file ends before."""
        out = bytearray()
        while size:
            if self.at >= len(self.held):
                self.held.clear()
                self.at = 0
                if not self._more():
                    return None
                continue
            got = min(size, len(self.held) - self.at)
            if len(out) < keep:
                out += memoryview(self.held)[self.at : self.at + min(got, keep - len(out))]
            self.at += got
            size -= got
        return bytes(out)


def records_of(stream, most: int = MOST_PAYLOAD) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers with lower-case names, block, whether it is whole) of each record of a WARC file, compressed by record, whole or not at all.

    ``stream`` has ``read(n)``; memory holds one record.  Of a block of more than ``most`` bytes the first ``HEAD`` are given.  A broken record ends the
    file: what stands before it is given."""
    plain = _Plain(stream)
    while line := plain.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers, last = {}, ""
        while (line := plain.line()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit():
            return
        whole = int(length) <= most
        block = plain.take(int(length), most if whole else HEAD)
        if block is None:
            return
        yield headers, block, whole


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    """One uncompressed record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers with lower-case names, and body of an HTTP response; of a block that isn't one: None, {}, the block."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    first = lines[0].split(" ")
    if not lines[0].startswith("HTTP/") or len(first) < 2 or not first[1].isdigit():
        return None, {}, block
    return int(first[1]), {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:]) if n}, body


def micros(date: str | None) -> int | None:
    """Microseconds since 1970 of a WARC date; without a zone it is UTC, as the format says."""
    from datetime import UTC, datetime

    try:
        at = datetime.fromisoformat(date or "")
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return round((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)


FIELDS = {
    "record_id": pa.string(), "kind": pa.string(), "url": pa.string(), "ts": pa.int64(), "status": pa.int32(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(),
    "truncated": pa.string(), "profile": pa.string(), "refers_to_url": pa.string(), "refers_to_ts": pa.int64(),
}


def read_warc(spark: SparkSession, path: str, most: int = MOST_PAYLOAD) -> DataFrame:
    """Records of WARC files, with the columns of ``FIELDS``; ``ts`` and ``refers_to_ts`` in microseconds.

    Spark lists the files, and one file is one task's work: it streams, so neither its size nor that of what it unpacks to matters.  A record of more than
    ``most`` bytes has a null payload; its status and headers are there, and it counts as the full response that it is.  ``truncated`` is what the record itself says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = store_of(name)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for head, block, whole in records_of(stream, most):
                        status, headers, body = http_parts(block) if head.get("warc-type") in ("response", "revisit") else (None, {}, block)
                        body = body if whole else None
                        rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), micros(head.get("warc-date")), status, list(headers.items()), body, head.get("warc-truncated"), head.get("warc-profile"), head.get("warc-refers-to-target-uri"), micros(head.get("warc-refers-to-date"))))
                        held += len(body or b"")
                        if len(rows) >= 256 or held >= CHUNK * 16:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path")
    schema = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, payload binary, truncated string, profile string, refers_to_url string, refers_to_ts long"
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)], list(FIELDS))
