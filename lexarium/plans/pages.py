"""Queries of chunking, page conversion, visible text and redaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking, markdown, redaction
from ..registry import query
from ..session import table
from .inline import Grown, Inline
from .text import PAGES, B, duck_strip, duck_title


@query(
    "section_headings",
    rf"""WITH l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT path, string_split(regexp_replace(content, '(?s)^---\n.*?---\n', ''), chr(10)) AS ls FROM {PAGES.sql})),
    m AS (SELECT *, SUM(regexp_matches(line, '^#{{2,4}}\s+')::INT) OVER (PARTITION BY path ORDER BY i) AS s FROM l),
    g AS (SELECT path, s, COALESCE(NULLIF(MAX(CASE WHEN regexp_matches(line, '^#{{2,4}}\s+') THEN {duck_strip("regexp_replace(line, '^#{2,4}\\s+', '')")} END), ''), 'Introduction') AS heading, {duck_strip("string_agg(line, chr(10) ORDER BY i)")} AS body FROM m GROUP BY path, s)
    SELECT path, (row_number() OVER (PARTITION BY path ORDER BY s) - 1)::INTEGER AS section, heading, length(body)::INTEGER AS n FROM g WHERE body <> ''""",
)
def section_headings(spark, sf_dir):
    return chunking.sections(PAGES.df(spark, sf_dir), "path", "content").select("path", "section", "heading", F.length("body").alias("n"))


SLUG = f"COALESCE(NULLIF(regexp_replace(regexp_replace(regexp_replace({duck_strip('lower(heading)')}, '[^a-z0-9 \\t\\n\\x0B\\f\\r-]', '', 'g'), '{B}+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"


@query(
    "section_chunks",
    rf"""WITH l AS (SELECT path, content, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT path, content, string_split(regexp_replace(content, '(?s)^---\n.*?---\n', ''), chr(10)) AS ls FROM {PAGES.sql})),
    m AS (SELECT *, SUM(regexp_matches(line, '^#{{2,4}}\s+')::INT) OVER (PARTITION BY path ORDER BY i) AS s FROM l),
    g AS (SELECT path, any_value(content) AS content, s, COALESCE(NULLIF(MAX(CASE WHEN regexp_matches(line, '^#{{2,4}}\s+') THEN {duck_strip("regexp_replace(line, '^#{2,4}\\s+', '')")} END), ''), 'Introduction') AS heading, {duck_strip("string_agg(line, chr(10) ORDER BY i)")} AS body FROM m GROUP BY path, s),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS section, COALESCE(NULLIF({duck_title('content')}, ''), regexp_extract(path, '[^/]*$')) AS title FROM g WHERE body <> ''),
    c AS (SELECT *, {duck_strip("title || ' > ' || heading || chr(10) || chr(10) || body")} AS whole FROM n)
    SELECT translate(replace(to_base64(encode(path || '#' || {SLUG} || '#' || section || '-0')), '=', ''), '+/', '-_') AS chunk_id, path, title, heading, length(whole)::INTEGER AS char_count, sha256(whole) AS content_hash FROM c WHERE length(whole) <= 4000""",
)
def section_chunks(spark, sf_dir):
    """Chunks of the sections that are one chunk, of all pages."""
    rows = chunking.chunks(PAGES.df(spark, sf_dir), "path", "content")
    alone = rows.withColumn("parts", F.count("*").over(Window.partitionBy("path", "section"))).where("parts = 1")
    return alone.select("chunk_id", "path", "title", "heading", "char_count", "content_hash")


@query(
    "chunk_pieces",
    """WITH RECURSIVE w(id, n, part, s, e) AS (SELECT p_partkey, p_size, 0, 0, least(54, 11 * p_size - 1) FROM part UNION ALL
      SELECT id, n, part + 1, b, least(11 * ((b + 65) // 11) - 1, 11 * n - 1) FROM (SELECT *, CASE WHEN (e - 15) % 11 = 10 THEN e - 14 ELSE e - 15 END AS b FROM w WHERE e < 11 * n - 1))
    SELECT id, part::INTEGER AS part, substr(repeat('abcdefghi. ', n), s + 1, e - s) AS piece FROM w""",
)
def chunk_pieces(spark, sf_dir):
    """The table function over texts of equal sentences: five to a piece of 64 characters, the next begins 15 before its end."""
    chunking.registered(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("trim(repeat('abcdefghi. ', p_size))").alias("body")).createOrReplaceTempView("sentences")
    return spark.sql("SELECT id, part, piece FROM pieces(TABLE(sentences), 'body', 64, 15)")


@query(
    "heading_counts",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, (COUNT(*) FILTER (WHERE regexp_matches(line, '^#{2,4}\s+')))::BIGINT AS n FROM l GROUP BY doc_id""",
)
def heading_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"^#{2,4}\s+")).alias("n"))


@query("chunk_overlap")
def chunk_overlap(spark, sf_dir):
    """Chunks of all documents with their place and size."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunking.chunks(docs, "path", "text").select("chunk_id", "path", "heading", "char_count", "content_hash")


@query("chunk_totals", "SELECT COUNT(DISTINCT doc_id)::BIGINT AS docs, true AS bounded FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def chunk_totals(spark, sf_dir):
    return chunk_overlap(spark, sf_dir).agg(F.countDistinct("path").alias("docs"), F.bool_and(F.col("char_count") <= 4000).alias("bounded"))


@query("visible_text")
def visible_text(spark, sf_dir):
    return redaction.mapped(table(spark, sf_dir, "pages"), "page_id", "html", "visible", redaction.visible_text)


@query("redacted_documents")
def redacted_documents(spark, sf_dir):
    """Diagnostics of all documents, secrets and paths redacted, whole texts."""
    return redaction.mapped(table(spark, sf_dir, "documents"), "doc_id", "text", "redacted", lambda t: redaction.redacted(t, max(4000, 2 * len(t)))[0])


SECRETS = Inline(
    {"id": "int", "raw": "string"},
    [
        (1, "token = abc123def, ok"), (2, "Authorization: Basic zzz\nnext"), (3, "see /home/me/file.txt, and C:\\Users\\x"), (4, "Bearer a.b-c_d~e"), (5, "password='two words' pat=XYZ."),
        (6, "plain text stays https://site.example/a/b"), (7, "x%74oken%3Dsecret"), (8, None),
    ],
)


@query(
    "redaction_rules",
    """SELECT * FROM (VALUES (1, 'token = [REDACTED], ok'), (2, 'Authorization: [REDACTED]' || chr(10) || 'next'), (3, 'see <PATH>, and <PATH>'), (4, 'Bearer [REDACTED]'), (5, 'password=[REDACTED] pat=[REDACTED].'), (6, 'plain text stays https://site.example/a/b'), (7, '[REDACTED]'), (8, NULL)) AS t(id, redacted)""",
)
def redaction_rules(spark, sf_dir):
    return redaction.mapped(SECRETS.df(spark), "id", "raw", "redacted", redaction.linked)


@query(
    "order_diagnostics",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'order ' || o_orderkey || ' token=[REDACTED], rest' WHEN 1 THEN 'see <PATH>, then [doc](/docs/' || o_custkey || ')' WHEN 2 THEN 'Authorization=[REDACTED]'
    WHEN 3 THEN 'open https://h.example/o/' || o_orderkey || '?sig=[REDACTED]&page=2 now' WHEN 4 THEN 'x [REDACTED] y' ELSE 'order ' || o_orderkey || ' is ' || o_orderstatus END AS redacted FROM orders""",
)
def order_diagnostics(spark, sf_dir):
    """A diagnostic of every order, in six shapes."""
    n, key = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    shapes = [
        F.concat(F.lit("order "), key, F.lit(" token="), F.md5(key), F.lit(", rest")),
        F.concat(F.lit("see /home/u"), key, F.lit("/f.txt, then [doc](/docs/"), F.col("o_custkey").cast("string"), F.lit(")")),
        F.concat(F.lit("authorization = Basic "), F.base64(F.encode(key, "UTF-8")), F.lit(" more")),
        F.concat(F.lit("open https://h.example/o/"), key, F.lit("?sig="), F.md5(key), F.lit("&page=2 now")),
        F.concat(F.lit("x p%61ssword%3D"), key, F.lit(" y")),
        F.concat(F.lit("order "), key, F.lit(" is "), F.col("o_orderstatus")),
    ]
    raw = F.element_at(F.array(*shapes), (n + 1).cast("int"))
    return redaction.mapped(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw", "redacted", redaction.linked)


def part_texts(spark, sf_dir, raw):
    """``id, raw``: a text made of every part, ids after those of the literal rows."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).cast("int").alias("id"), raw.alias("raw"))


def part_json(spark, sf_dir):
    n, name = F.col("p_partkey"), F.col("p_name")
    whole = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "name":  "'), name, F.lit('", "brand": {"b": [1, 2], "a": null}}'))
    twice = F.concat(F.lit('{"name": 1, "name": "'), name, F.lit('"}'))
    return part_texts(spark, sf_dir, F.when(n % 7 == 0, twice).when(n % 11 == 0, F.concat(name, F.lit("}"))).otherwise(whole))


JSONS = Grown({"id": "int", "raw": "string"}, [(1, '{"b": 1, "a": [2, {"z": null}]}'), (2, '{"a": 1, "a": 2}'), (3, "nope"), (4, '{"x": NaN}'), (5, '"t"')], part_json, "SELECT NULL AS id, NULL AS raw WHERE false")


@query("canonical_json", """SELECT * FROM (VALUES (1, '{"a":[2,{"z":null}],"b":1}'), (2, NULL), (3, NULL), (4, NULL), (5, '"t"')) AS t(id, canonical)
    UNION ALL SELECT (p_partkey + 1000)::INTEGER, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN '{"brand":{"a":null,"b":[1,2]},"name":"' || p_name || '","size":' || p_size || '}' END FROM part""")
def canonical_json(spark, sf_dir):
    return redaction.mapped(JSONS.df(spark, sf_dir), "id", "raw", "canonical", redaction.canonical_json)


def part_names(spark, sf_dir):
    return part_texts(spark, sf_dir, F.concat(F.lit("Crème "), F.col("p_name"), F.lit(" &amp;  "), F.col("p_size").cast("string"), F.lit("_ﬂ!")))


UNICODE = Grown({"id": "int", "raw": "string"}, [(1, "Crème Brûlée  & more"), (2, "a `code` [x]"), (3, "ﬁne—print")], part_names, "SELECT NULL AS id, NULL AS raw WHERE false")


@query("ascii_slugs", "SELECT * FROM (VALUES (1, 'creme-brulee-more'), (2, 'a-`code`-[x]'), (3, 'fineprint')) AS t(id, slug) UNION ALL SELECT (p_partkey + 1000)::INTEGER, 'creme-' || replace(p_name, ' ', '-') || '-amp-' || p_size || '_fl' FROM part")
def ascii_slugs(spark, sf_dir):
    return redaction.slugs(UNICODE.df(spark, sf_dir), "id", "raw")


@query("normal_texts", "SELECT * FROM (VALUES (1, 'crème brûlée more'), (2, 'a code x'), (3, 'ﬁne print')) AS t(id, normal) UNION ALL SELECT (p_partkey + 1000)::INTEGER, 'crème ' || p_name || ' ' || p_size || '_ﬂ' FROM part")
def normal_texts(spark, sf_dir):
    return redaction.mapped(UNICODE.df(spark, sf_dir), "id", "raw", "normal", redaction.normal_text)


@query("converted_pages")
def converted_pages(spark, sf_dir):
    """All documents through the page conversion."""
    return markdown.converted(table(spark, sf_dir, "documents"), "doc_id", "text")
