"""Rule lists over texts and records: reports, pages, markers, catalogue pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import addresses
from .evaluation import failures

# Signs of text that was left unfilled.
PLACEHOLDERS = (
    r"\blorem ipsum\b", r"\btodo\b", r"\btbd\b", r"\[insert[^\]]*\]", r"<insert[^>]*>", r"as an ai (language model|assistant)", r"\bi (do not|don't) have (access|the ability)\b",
    r"\bplaceholder\b", r"\bexample\.com\b", r"\bxxx+\b", r"page name here", r"issue description here", r"\bfill (this|it) (out|in)\b", r"\blorem\b.{0,20}\bipsum\b",
)
# Words that show each kind of evidence.
NONE_FOUND = ("no critical issue", "no issues found", "no user-facing")
EVIDENCE = {
    "task": ("task", "attempt", "follow", "step", "tried", "navigat"),
    "friction": ("confus", "friction", "unclear", "difficult", "hard to", *NONE_FOUND),
    "failure": ("critical issue", "broken", "404", "fail", "error", "bug", *NONE_FOUND),
    "worked": ("what worked", "worked well", "positive feedback", "good stuff"),
    "recommendation": ("recommendation", "suggest"),
}


def placeholder_hits(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in PLACEHOLDERS]))


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def report_errors(text: Column, min_words: int = 150, min_urls: int = 3, prefixes: tuple[str, ...] = (), scope: tuple[str, ...] = ()) -> Column:
    """Names of the rules that a report breaks, in order."""
    rules = [
        (F.size(placeholder_hits(text)) == 0, "placeholder"),
        (F.regexp_count(text, F.lit(r"\S+")) >= min_words, "short"),
        (F.size(addresses(text, prefixes)) >= min_urls, "few-urls"),
    ]
    if scope:
        rules.append((mentions_any(text, scope), "no-scope"))
    rules += [(mentions_any(text, words), f"no-{name}") for name, words in EVIDENCE.items()]
    return failures(rules)


# What says that a run was blocked, and what says why.
BLOCKED = ("infrastructure blocked", "infrastructure-blocked", "blocked:")
CAUSES = ("timeout", "timed out", "denied", "unreachable", "refused", "403", "network", "firewall", "playwright", "browser", "dns", "connection")


def blocked_errors(text: Column, min_urls: int = 1, prefixes: tuple[str, ...] = ()) -> Column:
    """Names of the rules that the report of a blocked run breaks, in order: no placeholders, a mark that says so, a cause, and an address that was tried."""
    rules = [
        (F.size(placeholder_hits(text)) == 0, "placeholder"),
        (mentions_any(text, BLOCKED), "no-mark"),
        (mentions_any(text, CAUSES), "no-cause"),
        (F.size(addresses(text, prefixes)) >= min_urls, "few-urls"),
    ]
    return failures(rules)


def page_errors(raw: DataFrame, items: str) -> DataFrame:
    """What breaks a page of a listing's contract: no list, a token that isn't text, members without their parts."""
    members = F.col(items)
    rules = [
        (members.isNotNull(), "no-list"),
        (F.coalesce(F.col("token"), F.lit("")).cast("string").isNotNull(), "bad-token"),
        (F.coalesce(F.forall(members, lambda m: m["name"].isNotNull() & m["version"].isNotNull()), F.lit(True)), "incomplete-member"),
    ]
    return raw.withColumn("errors", failures(rules))


def marker_outcome(body: Column, prefix: str, keys: tuple[str, ...]) -> Column:
    """Outcome of a generated-report marker, a comment line ``<!-- prefix: {json} -->``: exactly one, an object with exactly these keys."""
    found = F.regexp_extract_all(body, F.lit(rf"(?m)^<!-- {prefix}: (.*) -->$"), 1)
    parsed = F.from_json(F.element_at(found, 1), "map<string,string>")
    return (
        F.when(F.size(found) == 0, "missing").when(F.size(found) > 1, "repeated").when(parsed.isNull() | (F.size(parsed) <= 0), "malformed")
        .when(F.array_join(F.array_sort(F.map_keys(parsed)), ",") != ",".join(sorted(keys)), "mismatched").otherwise("valid")
    )


def marker(prefix: str, fields: Column) -> Column:
    return F.concat(F.lit(f"<!-- {prefix}: "), F.to_json(fields), F.lit(" -->"))
