"""The ``opN_<name>`` queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import fingerprint, html_extract, jaccard_join, language_id, license_scan, mixing, multi_index, packing, quality_rules, resampling, toxicity, warc_revisit, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op4_mixing",
    r"""
WITH sized AS (SELECT doc_id, source, md5(COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k, COALESCE(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w, 3 * source_size AS cap FROM src),
f AS (SELECT *, (SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(cap) OVER b, 0)::DOUBLE AS lft, (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0))::DOUBLE AS wlft FROM w
      WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap::DOUBLE * wlft < lft * w AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
        ELSE first_value(lft) OVER c * w / first_value(wlft) OVER c END AS target FROM g
      WINDOW c AS (PARTITION BY capped ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS e,
        COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - e * source_size - before)))::BIGINT AS taken FROM p
""",
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_quality_rules",
    r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, n, i,
        CASE WHEN i + 2 <= n THEN array_to_string(ws[i:i + 2], ' ') END AS g3,
        CASE WHEN i + 5 <= n THEN array_to_string(ws[i:i + 5], ' ') END AS g6,
        CASE WHEN i + 59 <= n THEN md5(array_to_string(ws[i:i + 59], ' ')) END AS g60 FROM p),
f AS (SELECT doc_id, i,
        g3 IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
        g6 IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, g6) > 1 AS r6,
        g60 IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, g60) > 1 AS r60 FROM g),
c AS (SELECT doc_id, r60,
        MAX(r3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        MAX(r6::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6 FROM f),
s AS (SELECT doc_id, SUM(c3)::BIGINT AS n3, SUM(c6)::BIGINT AS n6, BOOL_OR(r60) AS long FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, COALESCE(dup, 0)::BIGINT AS n_dup_lines,
        COALESCE(n3, 0)::BIGINT AS n_repeat_words, COALESCE(n6, 0) AS n6, COALESCE(long, false) AS long
      FROM w LEFT JOIN s USING (doc_id) LEFT JOIN u USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n6 <= 40 * n_words AND NOT long AS kept FROM b
""",
)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.assess(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = language_id.identify(docs, language_id.learn(docs))
    return got.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op6_ngram_jaccard_join",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[k:k + 3], ' ')) AS g FROM i),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, p.r FROM reach p JOIN links l ON l.a = p.doc_id)
SELECT r.doc_id, COALESCE(MAX(n.n), 0)::BIGINT AS n_shingles, MIN(r.r) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
)
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.linked(documents(spark, sf_dir), jaccard_join.Setting(n=4, least=85))
    return got.select("doc_id", "n_shingles", "component_id")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.tokenizer_path("byte_bpe_50k.json"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = toxicity.score(docs, index)
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(documents(spark, sf_dir))


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.extract(pages.select("page_id", "url", "html"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of pages: each page as a full response at ten times its id, and a revisit of it 75 later.

    A page's etag is a digest of its html; every third page sends a date only, every seventh nothing, and the revisit of every fifth
    page tells of another state.  So pages that share a canonical URL compete as the latest earlier response."""
    digest = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    number, n = F.col("page_id").cast("string"), F.col("page_id")
    text = F.lit(None).cast("string")
    entries = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    plain = (n % 3 != 0) & (n % 7 != 0)
    first = entries(("etag", F.when(plain, digest).otherwise(text)), ("last-modified", F.when(n % 7 != 0, F.concat(F.lit("day "), (n % 5).cast("string"))).otherwise(text)), ("content-type", F.lit("text/html")), ("date", F.concat(F.lit("t"), number)), ("content-length", F.length(F.coalesce("html", F.lit(""))).cast("string")))
    again = entries(("etag", F.when(plain, F.when(n % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), digest))).otherwise(text)), ("last-modified", F.when(n % 7 != 0, F.concat(F.lit("day "), F.when(n % 5 == 0, F.lit("x")).otherwise((n % 5).cast("string")))).otherwise(text)), ("date", F.concat(F.lit("u"), number)), ("content-length", F.lit("0")), ("expires", F.lit("never")))
    responses = pages.select((n * 2).alias("record_id"), "url", (n * 10).alias("ts"), F.lit("response").alias("kind"), first.alias("headers"))
    revisits = pages.select((n * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (n * 10 + 75).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers"))
    return responses.unionByName(revisits)


@query(
    "op10_warc_revisits",
    r"""
WITH b AS (SELECT page_id AS n, COALESCE(html, '') AS html, regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS u FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|msclkid|mc_eid|ref)='))), '&') AS query FROM b),
c AS (SELECT n, html, concat(host, path, CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS canonical_url, '"' || md5(html) || '"' AS digest, n % 3 <> 0 AND n % 7 <> 0 AS plain FROM q),
r AS (SELECT canonical_url, 2 * n AS response_id, 10 * n AS response_ts, n, CASE WHEN plain THEN digest END AS etag, CASE WHEN n % 7 <> 0 THEN 'day ' || (n % 5) END AS lm, length(html) AS len FROM c),
v AS (SELECT canonical_url, 2 * n + 1 AS record_id, 10 * n + 75 AS ts, n, CASE WHEN plain THEN CASE WHEN n % 5 = 0 THEN '"other"' ELSE digest END END AS etag,
        CASE WHEN plain THEN CASE WHEN n % 5 = 0 THEN '"other"' ELSE 'W/' || digest END END AS sent, CASE WHEN n % 7 <> 0 THEN 'day ' || CASE WHEN n % 5 = 0 THEN 'x' ELSE (n % 5)::VARCHAR END END AS lm FROM c),
m AS (SELECT v.*, response_id, response_ts, r.n AS rn, r.etag AS retag, r.lm AS rlm, r.len,
        CASE WHEN response_id IS NULL THEN 'no_response'
             WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN v.etag = r.etag THEN 'resolved' ELSE 'mismatch' END
             WHEN v.lm IS NOT NULL AND r.lm IS NOT NULL THEN CASE WHEN v.lm = r.lm THEN 'resolved' ELSE 'mismatch' END
             ELSE 'no_validator' END AS outcome
      FROM v ASOF LEFT JOIN r ON v.canonical_url = r.canonical_url AND v.ts > r.response_ts)
SELECT record_id, canonical_url, ts, outcome, response_id, response_ts,
  array_to_string(list_sort(list_filter(CASE WHEN outcome = 'resolved'
    THEN ['etag: ' || COALESCE(sent, retag), 'last-modified: ' || COALESCE(lm, rlm), 'content-type: text/html', 'date: u' || n, 'content-length: ' || len, 'expires: never']
    ELSE ['etag: ' || sent, 'last-modified: ' || lm, 'date: u' || n, 'content-length: 0', 'expires: never'] END, lambda x: x IS NOT NULL)), chr(10)) AS headers
FROM m
""",
)
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_revisit.resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.withColumn("headers", warc_revisit.header_text(F.col("headers")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op11_multi_index")
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return multi_index.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return whitening.whiten(vectors, whitening.fit(vectors))


@query("op13_resampling")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
