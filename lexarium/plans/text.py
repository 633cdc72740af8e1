"""Queries of text, path and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..registry import query
from ..session import table
from .inline import Extended, Grown, Inline

STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
B = r"[ \t\n\x0B\f\r]"


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def duck_plain(x: str) -> str:
    x = rf"regexp_replace({x}, '(?s)^---\n.*?---\n', '', 'g')"
    for pattern, by in ((r"<[^>]+>", " "), (r"(?s)```.*?```", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"[#*_`~]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def duck_tokens(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({x}), '<[^>]+>', ' ', 'g'), '(?s)```.*?```', ' ', 'g')"
    return f"list_filter(regexp_extract_all({x}, '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def duck_field(x: str, field: str) -> str:
    return duck_strip(rf"""regexp_extract({x}, '(?s)^---\n.*?{field}:\s*"?([^"\n]+)"?\n.*?---', 1)""")


def duck_title(x: str) -> str:
    return rf"COALESCE(NULLIF({duck_field(x, 'title')}, ''), {duck_strip(rf"regexp_extract({x}, '(?m)^#\s+([^\n]+)$', 1)")})"


def document_pages(spark, sf_dir):
    """A page of every document: front matter, two headings and the text."""
    n, docs = F.col("doc_id").cast("string"), table(spark, sf_dir, "documents")
    content = F.concat(F.lit('---\ntitle: "Doc '), n, F.lit('"\ndescription: in '), F.col("source"), F.lit("\n---\n# Heading "), n, F.lit("\nlead\n## Part "), n, F.lit("\n"), F.col("text"))
    return docs.select(F.concat(F.lit("docs/"), "source", F.lit("/d"), n).alias("path"), content.alias("content"))


DOCUMENT_PAGES = """SELECT 'docs/' || source || '/d' || doc_id AS path,
    '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'description: in ' || source || chr(10) || '---' || chr(10) || '# Heading ' || doc_id || chr(10) || 'lead' || chr(10) || '## Part ' || doc_id || chr(10) || text AS content FROM documents"""

PAGES = Grown(
    {"path": "string", "content": "string"},
    [
        ("agents/overview", '---\ntitle: "Agent Overview"\ndescription: All about agents\nkeep: 1\n---\n# Heading one\n\nAgents *run* tools. See [the guide](guide.md).\n'),
        ("agents/plain", "# Only a heading\nText with <b>tags</b> and ```code <x> here``` after.\n## Second\n- fine-tuning a_b\n"),
        ("models/none", "No heading at all, `inline` ~struck~."),
        ("models/tail", "---\ntitle: Late\n---\nbody\n---\ndescription: below the matter\n---\n"),
        ("models/empty", "---\ntitle: \"\"\nx: y\n---\n# Fallback\n"),
        ("a/b", ""),
        ("guide/fence", "---\ntitle: Fence\n---\nIntro\n## One\ntext\n```\n## not a heading\n```\n### Two\nmore\n##### five\n"),
    ],
    document_pages,
    DOCUMENT_PAGES,
)


@query(
    "page_titles",
    f"SELECT path, {duck_title('content')} AS title, {duck_field('content', 'description')} AS description, {duck_plain('content')} AS plain FROM {PAGES.sql}",
)
def page_titles(spark, sf_dir):
    c = F.col("content")
    return PAGES.df(spark, sf_dir).select("path", text.title(c).alias("title"), text.description(c).alias("description"), text.plain(c).alias("plain"))


@query("page_tokens", f"SELECT path, array_to_string({duck_tokens(f"concat_ws(' ', {duck_title('content')}, {duck_title('content')}, {duck_field('content', 'description')}, {duck_plain('content')})")}, ' ') AS tokens FROM {PAGES.sql}")
def page_tokens(spark, sf_dir):
    return PAGES.df(spark, sf_dir).select("path", F.array_join(text.page_tokens(F.col("content")), " ").alias("tokens"))


@query(
    "tokenize_counts",
    f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {duck_tokens('text')} AS t FROM documents)",
)
def tokenize_counts(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("document_markup", f"SELECT doc_id, md5({duck_plain('text')}) AS plain_md5, {duck_title('text')} AS title FROM documents")
def document_markup(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain(c).cast("binary")).alias("plain_md5"), text.title(c).alias("title"))


@query(
    "content_completeness",
    r"SELECT doc_id, length(text)::BIGINT AS n_chars, len(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+'))::BIGINT AS n_headings, (len(regexp_extract_all(text, '```')) // 2)::BIGINT AS n_blocks FROM documents",
)
def content_completeness(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), text.headings(c).alias("n_headings"), text.code_blocks(c).alias("n_blocks"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256, sha256(concat('modify', chr(0), doc_id)) AS operation_id FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), text.digest(F.lit("modify"), F.col("doc_id").cast("string")).alias("operation_id"))


@query("search_key", "SELECT doc_id, translate(replace(to_base64(encode(concat(source, '#', text))), '=', ''), '+/', '-_') AS key FROM documents")
def search_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_key(F.concat("source", F.lit("#"), "text")).alias("key"))


@query("page_visible", r"SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def page_visible(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.without_tags(F.col("html")).alias("stripped"))


@query(
    "page_main_text",
    rf"""SELECT page_id, CASE WHEN length(t) > 200 THEN t END AS main_text FROM (SELECT page_id,
    {duck_strip(rf"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '{B}+', ' ', 'g')")} AS t FROM pages)""",
)
def page_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.element_text(F.col("html"), "article").alias("main_text"))


@query(
    "url_host",
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)) AS host,
    lower(regexp_extract(url, '^(https?://[^/?#:]+)', 1)) AS origin,
    COALESCE(NULLIF(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), ''), url) AS path FROM pages""",
)
def url_host(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.host(u).alias("host"), paths.origin(u).alias("origin"), paths.address_path(u, r"^https?://[^/]+/([^?#]*)").alias("path"))


URLS = Extended(
    "part", "SELECT CASE p_size % 4 WHEN 0 THEN 'https://' || p_brand || '.example:443/' || p_name WHEN 1 THEN 'HTTP://h' || p_size || '.example:8080?q=' || p_partkey WHEN 2 THEN 'ftp://' || p_name ELSE 'http://u@h' || p_partkey END AS url FROM part",
    
    {"url": "string"},
    [("HTTPS://Example.Org:443/a",), ("http://example.org:8080/",), ("http://user@example.org/",), ("ftp://example.org",), ("https://a.b",), ("http://a.b:80?x=1",), ("",), ("nonsense",)],
)


@query(
    "url_origin",
    f"""WITH m AS (SELECT url, lower(regexp_extract(url, '^(?i)(https?)://([^/?#:@\\s]+)(?::(\\d+))?(?:[/?#].*)?$', 1)) AS s, lower(regexp_extract(url, '^(?i)(https?)://([^/?#:@\\s]+)(?::(\\d+))?(?:[/?#].*)?$', 2)) AS h,
    regexp_extract(url, '^(?i)(https?)://([^/?#:@\\s]+)(?::(\\d+))?(?:[/?#].*)?$', 3) AS p FROM {URLS.sql})
    SELECT url, CASE WHEN h <> '' THEN s || '://' || h || CASE WHEN p = '' OR (s = 'http' AND p = '80') OR (s = 'https' AND p = '443') THEN '' ELSE ':' || p END END AS origin FROM m""",
)
def url_origin(spark, sf_dir):
    return URLS.df(spark, sf_dir).select("url", paths.origin(F.col("url")).alias("origin"))


NAMES = Extended(
    "part", "SELECT p_name || CASE p_size % 3 WHEN 0 THEN '!' WHEN 1 THEN ' (' || p_type || ') ' ELSE ' -- ' || p_brand END AS name FROM part",
    {"name": "string"}, [("Getting Started!",), ("  What's new?  ",), ("***",), ("A -- B & C",), ("Prompt [flow] (v2)",), ("",), ("Ünïcode näme",), ("tab\there",)])


@query(
    "slugs",
    f"""SELECT name, COALESCE(NULLIF(regexp_replace(regexp_replace(regexp_replace({duck_strip('lower(name)')}, '[^a-z0-9 \\t\\n\\x0B\\f\\r-]', '', 'g'), '{B}+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
    regexp_replace(regexp_replace(regexp_replace(replace(lower(name), ' ', '-'), '[?#&%!''"()\\[\\]{{}}]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS url_slug FROM {NAMES.sql}""",
)
def slugs(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("name", text.slug(F.col("name")).alias("slug"), text.url_slug(F.col("name")).alias("url_slug"))


RAW_KEYWORDS = Extended(
    "part", "SELECT p_partkey + 100 AS id, p_name || CASE p_size % 3 WHEN 0 THEN ', ' WHEN 1 THEN ' ,,' ELSE ',' END || p_type AS raw FROM part",
    {"id": "int", "raw": "string"}, [(1, "Agents, RAG ,, fine-tuning"), (2, ""), (3, None), (4, " , "), (5, "ONE")])


@query("keyword_parse", f"SELECT id, array_to_string(list_filter(list_transform(string_split(COALESCE(raw, ''), ','), lambda k: lower(trim(k))), lambda k: k <> ''), '|') AS keywords FROM {RAW_KEYWORDS.sql}")
def keyword_parse(spark, sf_dir):
    return RAW_KEYWORDS.df(spark, sf_dir).select("id", F.array_join(text.keyword_list(F.col("raw")), "|").alias("keywords"))


LINKS = Extended(
    "part", "SELECT CASE p_size % 3 WHEN 0 THEN '/r/' || p_name WHEN 1 THEN 'https://h.example/' || p_partkey ELSE '' END AS path FROM part",
    
    {"path": "string"},
    [("",), ("/r/x/comments/1",), ("https://elsewhere.example/1",), (None,)],
)


@query("permalinks", f"SELECT path, CASE WHEN COALESCE(path, '') = '' OR starts_with(path, 'https://') THEN COALESCE(path, '') ELSE 'https://site.example' || path END AS link FROM {LINKS.sql}")
def permalinks(spark, sf_dir):
    return LINKS.df(spark, sf_dir).select("path", text.permalink(F.col("path"), "https://site.example").alias("link"))


@query("body_snippets", "SELECT conv_id, turn, substr(text, 1, 60) AS snippet, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS bounded FROM conversations")
def body_snippets(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.truncated(c, 60).alias("snippet"), text.truncated(c, 60, "...").alias("bounded"))


@query(
    "number_labels",
    r"""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN regexp_replace(printf('%.1f', round(n / 1000000.0, 1)), '\.0$', '') || 'M' WHEN n >= 1000 THEN regexp_replace(printf('%.1f', round(n / 1000.0, 1)), '\.0$', '') || 'K' ELSE n::VARCHAR END AS label
    FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)""",
)
def number_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_number(F.col("o_orderkey") * 37).alias("label"))


@query("time_labels", "SELECT event_id, strftime(ts, '%G-W%V') AS iso_week, strftime(ts, '%Y-%m') AS month FROM events")
def time_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", labels.iso_week(F.col("ts")).alias("iso_week"), labels.month(F.col("ts")).alias("month"))


DAYS = Extended(
    "orders", "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders",
    {"day": "string"}, [(f"{y}-{md}",) for y in (2019, 2020, 2024, 2025, 2026, 2027, 2030) for md in ("01-01", "01-04", "06-15", "12-28", "12-31")])


@query("iso_week_edges", f"SELECT day, strftime(day::DATE, '%G-W%V') AS iso_week FROM {DAYS.sql}")
def iso_week_edges(spark, sf_dir):
    return DAYS.df(spark, sf_dir).select("day", labels.iso_week(F.col("day").cast("date")).alias("iso_week"))


TIMES = Extended(
    "orders", "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN 'T03:04:05Z' WHEN 1 THEN ' 01:02:03' ELSE 'Tx' END AS raw FROM orders",
    {"raw": "string"}, [("2025-01-02T03:04:05Z",), ("2025-01-02T03:04:05",), ("yesterday",), ("",), (None,)])


@query("time_parse", f"SELECT raw, epoch(TRY_CAST(replace(raw, 'Z', '') AS TIMESTAMP))::BIGINT AS seconds FROM {TIMES.sql}")
def time_parse(spark, sf_dir):
    return TIMES.df(spark, sf_dir).select("raw", F.unix_seconds(labels.parsed_time(F.col("raw"))).alias("seconds"))


STATUSES = Extended(
    "part", "SELECT p_size * 12 AS status FROM part",
    {"status": "int"}, [(200,), (204,), (301,), (401,), (403,), (404,), (429,), (500,), (503,), (None,)])


@query(
    "http_classes",
    f"""SELECT status, CASE WHEN status IS NULL THEN 'unreachable' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (401, 403) THEN 'auth-required' WHEN status = 404 THEN 'not-found'
    WHEN status = 429 THEN 'rate-limited' WHEN status >= 500 THEN 'server-error' ELSE 'unexpected' END AS label FROM {STATUSES.sql}""",
)
def http_classes(spark, sf_dir):
    return STATUSES.df(spark, sf_dir).select("status", labels.http_class(F.col("status")).alias("label"))


VALUES = Extended(
    "part", "SELECT p_partkey + 100 AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN p_brand || ', ' || p_type ELSE p_size || 'k' END AS raw FROM part",
    {"id": "int", "raw": "string"}, [(1, "128000"), (2, "12k"), (3, ""), (4, None), (5, " 7 "), (6, "a, b,,c ")])


@query("safe_casts", f"SELECT id, TRY_CAST(raw AS BIGINT) AS n, array_to_string(list_filter(list_transform(string_split(COALESCE(raw, ''), ','), lambda k: trim(k)), lambda k: k <> ''), '|') AS items FROM {VALUES.sql}")
def safe_casts(spark, sf_dir):
    return VALUES.df(spark, sf_dir).select("id", labels.int_or_none(F.col("raw")).alias("n"), F.array_join(labels.text_list(F.col("raw")), "|").alias("items"))


HREFS = Extended(
    "part", "SELECT CASE p_size % 5 WHEN 0 THEN '../' || p_name || '.md' WHEN 1 THEN './x/../' || p_partkey || '.yml' WHEN 2 THEN '/site/own/' || p_name WHEN 3 THEN '/site/' || p_partkey || '.md?x#y' ELSE 'https://' || p_name END AS href, 'f' || p_size || '/g' AS folder FROM part",
    
    {"href": "string", "folder": "string"},
    [("../a/b.md?x#y", "c/d"), ("./e.md", "c"), ("../../../up.md", "c"), ("/abs/f.md", "c"), ("g//h/../i.md", "c"), ("", "c"), ("toc.yml", ""), ("https://x.example/y", "c"), ("/site/own/z", "c"), ("/site/else", "c"), ("/api/q", "c"), ("x.yaml#t", "c")],
)
WALK = """list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(w, '/'), lambda x: [x])),
    lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END)"""


@query(
    "path_resolve",
    f"""WITH c AS (SELECT href, folder, regexp_replace(href, '[?#].*$', '') AS p FROM {HREFS.sql}), v AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE folder || '/' || p END AS w FROM c)
    SELECT href, folder, array_to_string({WALK}, '/') AS resolved,
      CASE WHEN regexp_matches(href, '^https?://') THEN 'external' WHEN starts_with(p, '/site/own/') THEN 'page' WHEN starts_with(p, '/site/') OR starts_with(p, '/rest/') THEN 'other-repository'
           WHEN p LIKE '%.md' THEN 'page' WHEN p LIKE '%.yml' OR p LIKE '%.yaml' THEN 'table' ELSE 'external' END AS kind,
      CASE WHEN starts_with(p, '/site/') THEN 'articles/' || substr(p, 7) || CASE WHEN p LIKE '%.md' THEN '' ELSE '.md' END ELSE p END AS page FROM v""",
)
def path_resolve(spark, sf_dir):
    h = F.col("href")
    return HREFS.df(spark, sf_dir).select(
        "href", "folder", paths.resolved(h, F.col("folder")).alias("resolved"), paths.reference_kind(h, ("/site/own/",), ("/site/", "/rest/")).alias("kind"), paths.absolute_to_page(h, "/site/", "articles/").alias("page")
    )


EXPECTED = Extended(
    "part", "SELECT CASE p_size % 3 WHEN 0 THEN '/docs/' ELSE '' END || p_name || CASE p_size % 2 WHEN 0 THEN '.mdx' ELSE '/' END AS value FROM part",
    {"value": "string"}, [("/docs/agents/overview.mdx",), ("agents/overview",), ("docs/a/",), ("/x.mdx",), ("",)])


@query("expected_paths", f"SELECT value, regexp_replace(regexp_replace(regexp_replace(value, '^/+|/+$', '', 'g'), '^docs/', ''), '\\.mdx$', '') AS path FROM {EXPECTED.sql}")
def expected_paths(spark, sf_dir):
    return EXPECTED.df(spark, sf_dir).select("value", paths.expected_path(F.col("value")).alias("path"))


ENTRIES = Extended(
    "part", "SELECT CASE p_size % 4 WHEN 0 THEN 'Known' ELSE p_name || ' & more?' END AS section, 'a/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.b.md' WHEN 1 THEN '.md' ELSE '' END AS source_path FROM part",
    {"section": "string", "source_path": "string"}, [("Agents & Tools", "articles/x/how-to.md"), ("Known", "a/b.c.md"), ("Set up?", "readme")])


@query(
    "output_paths",
    f"""SELECT section, source_path, concat_ws('/', CASE WHEN section = 'Known' THEN 'known-slug' ELSE regexp_replace(regexp_replace(regexp_replace(replace(lower(section), ' ', '-'), '[?#&%!''"()\\[\\]{{}}]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') END,
    regexp_replace(string_split(source_path, '/')[-1], '(.)\\.[^.]*$', '\\1')) AS path FROM {ENTRIES.sql}""",
)
def output_paths(spark, sf_dir):
    return ENTRIES.df(spark, sf_dir).select("section", "source_path", paths.output_path(F.col("section"), F.col("source_path"), {"Known": "known-slug"}).alias("path"))


ROUTES = Extended(
    "part", "SELECT CASE p_size % 6 WHEN 0 THEN 'a/' || p_partkey WHEN 1 THEN '/' || p_partkey || '/x' WHEN 2 THEN p_partkey || '/../b' WHEN 3 THEN 'p' || p_partkey || '.md' WHEN 4 THEN 'q?' || p_name ELSE '//' || p_name END AS value FROM part",
    {"value": "string"}, [("agents/overview",), ("a.mdx",), ("/abs",), ("a/../b",), ("a?b",), (" a",), ("https://x",), ("a//b",), ("",), ("v1.2/x",), ("/root/ok",), ("//x",)])


@query(
    "route_rules",
    f"""WITH r AS (SELECT value, value AS v, CASE WHEN starts_with(value, '/') AND NOT starts_with(value, '//') THEN regexp_replace(value, '^/+', '') END AS w FROM {ROUTES.sql}),
    ok AS (SELECT value, {', '.join(f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '^\\s|\\s$') AND NOT contains({c}, chr(92)) AND NOT regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND NOT regexp_matches({c}, '[?#]') AND NOT starts_with({c}, '/') AND NOT regexp_matches(string_split({c}, '/')[-1], '[^.]\\.[^.]+$') AND len(list_filter(string_split({c}, '/'), lambda p: p IN ('', '.', '..'))) = 0 THEN {c} END AS {n}" for c, n in (('v', 'page_route'), ('w', 'root_route')))} FROM r) SELECT * FROM ok""",
)
def route_rules(spark, sf_dir):
    v = F.col("value")
    return ROUTES.df(spark, sf_dir).select("value", paths.page_route(v).alias("page_route"), paths.root_route(v).alias("root_route"))


@query("empty_pages", f"""SELECT path, {duck_strip(r"regexp_replace(regexp_replace(regexp_replace(content, '(?s)^---\n.*?\n---\s*(?:\n|$)', ''), '(?s)\{/\*.*?\*/\}', '', 'g'), '(?s)<!--.*?-->', '', 'g')")} = '' AS empty FROM {PAGES.sql}""")
def empty_pages(spark, sf_dir):
    return PAGES.df(spark, sf_dir).select("path", text.empty_page(F.col("content")).alias("empty"))
