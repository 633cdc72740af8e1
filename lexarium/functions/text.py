"""Text columns: Markdown pages, tokens, slugs, keys and labels.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither documents nor queries are searched by.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "what", "which", "who", "whom", "this", "that", "these", "those",
    "of", "to", "in", "on", "for", "with", "as", "by", "at", "from",
    "and", "or", "but", "if", "so", "than", "then", "not", "no",
    "do", "does", "did", "can", "could", "will", "would", "should",
    "it", "its", "you", "your", "i", "we", "our", "they", "their",
)
TOKEN = r"([a-z0-9]+(?:[-_][a-z0-9]+)*)"
#: White space as Java's and RE2's \s have it.
BLANK = r"[ \t\n\x0B\f\r]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` drops spaces alone)."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def or_none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def front_matter(content: Column, field: str) -> Column:
    """A field of the front matter of a page, empty if absent.

    Any later ``---`` closes the match, so a field line below the front matter is found too."""
    return strip(F.regexp_extract(content, rf'(?s)^---\n.*?{field}:\s*"?([^"\n]+)"?\n.*?---', 1))


def title(content: Column) -> Column:
    """The front matter's title, else the first level-one heading, else empty."""
    heading = strip(F.regexp_extract(content, r"(?m)^#\s+([^\n]+)$", 1))
    return F.coalesce(or_none(front_matter(content, "title")), heading)


def description(content: Column) -> Column:
    return front_matter(content, "description")


def front_matter_line(block: Column, key: str) -> Column:
    """First ``key:`` line of a front matter block, unquoted; null if absent."""
    value = or_none(strip(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n]+?)[ \t]*$", 1)))
    return F.when(value.rlike("""^(".*"|'.*')$""") & (F.length(value) >= 2), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def without_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)^---\n.*?---\n", "")


def plain(content: Column) -> Column:
    """Markdown as plain text: front matter, tags, fences, link targets and marks go, in this order, so a tag
    inside a fence goes before the fence does."""
    out = without_front_matter(content)
    for pattern, by in ((r"<[^>]+>", " "), (r"(?s)```.*?```", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[#*_`~]", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def tokens(text: Column) -> Column:
    """Search tokens in order: lower-cased, without tags, fences, single characters and stop words."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"<[^>]+>", " "), r"(?s)```.*?```", " ")
    # a set of literals is looked up by hash, an array of them would be walked for every token
    return F.filter(F.regexp_extract_all(clean, F.lit(TOKEN), 1), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def page_tokens(content: Column) -> Column:
    """A page's tokens with its title twice and its description once besides the body."""
    return tokens(F.concat_ws(" ", title(content), title(content), description(content), plain(content)))


def slug(value: Column) -> Column:
    """Heading slug: letters, digits and hyphens; ``section`` if nothing is left."""
    kept = F.regexp_replace(strip(F.lower(value)), r"[^a-z0-9 \t\n\x0B\f\r-]", "")
    return F.coalesce(or_none(F.regexp_replace(F.regexp_replace(kept, rf"{BLANK}+", "-"), r"^-+|-+$", "")), F.lit("section"))


def url_slug(value: Column) -> Column:
    """Path slug: characters that break routing go, runs of hyphens shrink."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(value), " ", "-"), r"""[?#&%!'"()\[\]{}]""", "")
    return F.regexp_replace(F.regexp_replace(kept, r"-{2,}", "-"), r"^-+|-+$", "")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def element_text(html: Column, tag: str = "main", least: int = 200) -> Column:
    """Text of the first ``tag`` element, white space as single spaces; null if it has no more than ``least`` characters."""
    body = F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    text = strip(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), rf"{BLANK}+", " "))
    return F.when(F.length(text) > least, text)


def truncated(text: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` characters, the last of them ``mark`` where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def permalink(path: Column, site: str) -> Column:
    """Empty for none, a full address as it is, else the site's."""
    path = F.coalesce(path, F.lit(""))
    return F.when((path == "") | path.startswith("https://"), path).otherwise(F.concat(F.lit(site), path))


def keyword_list(raw: Column) -> Column:
    """Comma list as lower-cased keywords; nothing for null."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda k: F.lower(strip(k))), lambda k: k != "")


def keywords_in(text: Column, keywords: Column) -> Column:
    """Those of ``keywords`` that the text has, as substrings whatever the case."""
    low = F.lower(text)
    return F.filter(keywords, lambda k: F.contains(low, k))


def safe_key(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.regexp_replace(F.base64(F.encode(raw, "UTF-8")), r"[\r\n=]", ""), "+/", "-_")


def digest(*parts: Column) -> Column:
    """SHA-256 in hex of the parts, joined by NUL."""
    return F.sha2(F.encode(F.concat_ws("\u0000", *parts), "UTF-8"), 256)


def short_number(n: Column) -> Column:
    """1.5K, 2M: thousands and millions with at most one decimal; plain below a thousand."""
    scaled = lambda by, mark: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(n / by, 1)), r"\.0$", ""), F.lit(mark))
    return F.when(n >= 1_000_000, scaled(1_000_000, "M")).when(n >= 1000, scaled(1000, "K")).otherwise(n.cast("string"))


def headings(text: Column) -> Column:
    """Number of Markdown headings."""
    return F.regexp_count(text, F.lit(r"(?m)^#{1,6}[ \t]+")).cast("long")


def code_blocks(text: Column) -> Column:
    """Number of fenced blocks."""
    return F.floor(F.regexp_count(text, F.lit("```")) / 2).cast("long")


def addresses(text: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Distinct addresses in order of appearance, without punctuation after them; of ``prefixes`` only, if given."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s)\]}"'>]+)"""), 1), lambda u: F.regexp_replace(u, r"[).,;:*_]+$", ""))
    if prefixes:
        found = F.filter(found, lambda u: F.array_contains(F.array(*[u.startswith(p) for p in prefixes]), F.lit(True)))
    return F.array_distinct(found)


def empty_page(content: Column) -> Column:
    """Nothing left but front matter and comments."""
    body = F.regexp_replace(content, r"(?s)^---\n.*?\n---\s*(?:\n|$)", "")
    return strip(F.regexp_replace(F.regexp_replace(body, r"(?s)\{/\*.*?\*/\}", ""), r"(?s)<!--.*?-->", "")) == ""
