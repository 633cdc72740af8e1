"""Paths, references and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_none

ASSET = r"\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|json|ya?ml|css|js|mp4|txt|xml)$"


def _walk(parts: Column, escape_is_empty: bool) -> Column:
    """Segments with ``.`` and ``..`` worked off. ``..`` above the root is dropped, or makes the path null."""
    start = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.lit(None).cast("array<string>") if escape_is_empty else acc)
    step = lambda acc, x: F.when(acc.isNull() | x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, start, step)


def resolved(href: Column, folder: Column) -> Column:
    """``href`` against ``folder``, without query and fragment; ``..`` above the root is dropped."""
    clean = F.regexp_replace(href, r"[?#].*$", "")
    whole = F.when(clean.startswith("/"), clean).otherwise(F.concat_ws("/", folder, clean))
    return F.array_join(_walk(F.split(whole, "/"), False), "/")


def link_target(route: Column, link: Column) -> Column:
    """Route that a link of a page leads to: null if it isn't internal, empty if it leaves the tree."""
    bare = F.regexp_replace(link, r"^<(.*)>$", "$1")
    path = F.regexp_replace(bare, r"[?#].*$", "")
    inside = ~bare.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//|#)") & (path != "") & ~F.contains(path, F.lit("\\")) & ~F.lower(path).rlike(ASSET)
    folder = F.regexp_replace(route, r"/?[^/]*$", "")
    parts = _walk(F.split(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path)), "/"), True)
    target = F.regexp_replace(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "/"), r"(?i)\.mdx?$", "")
    return F.when(inside, target)


def page_route(value: Column) -> Column:
    """A navigation entry as a route; null unless it is a plain relative path without suffix, query or fragment."""
    last = F.element_at(F.split(value, "/"), -1)
    ok = (
        (value != "") & ~value.rlike(r"^\s|\s$") & ~F.contains(value, F.lit("\\")) & ~value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~value.rlike("[?#]")
        & ~value.startswith("/") & ~last.rlike(r"[^.]\.[^.]+$") & ~F.exists(F.split(value, "/"), lambda p: p.isin("", ".", ".."))
    )
    return F.when(ok, value)


def root_route(value: Column) -> Column:
    """A root-relative address as a route."""
    return F.when(value.startswith("/") & ~value.startswith("//"), page_route(F.regexp_replace(value, "^/+", "")))


def expected_path(value: Column) -> Column:
    """A path as the index names it: no outer slashes, ``docs/`` prefix or page suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"^/+|/+$", ""), r"^docs/", ""), r"\.mdx$", "")


def address_path(url: Column, pattern: str) -> Column:
    """The part of an address that ``pattern`` captures, else the address."""
    return F.coalesce(or_none(F.regexp_extract(url, pattern, 1)), url)


def reference_kind(href: Column, own: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Class of a table-of-contents reference: own pages, own sub-tables, another repository, or outside."""
    clean = F.regexp_replace(href, r"[?#].*$", "")
    starts = lambda prefixes: clean.rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    return (
        F.when(href.rlike("^https?://"), "external")
        .when(starts(own), "page")
        .when(starts(other), "other-repository")
        .when(clean.endswith(".md"), "page")
        .when(clean.rlike(r"\.ya?ml$"), "table")
        .otherwise("external")
    )


def absolute_to_page(href: Column, prefix: str, folder: str) -> Column:
    """A site path below ``prefix`` as a source file below ``folder``; others without query and fragment."""
    clean = F.regexp_replace(href, r"[?#].*$", "")
    page = F.concat(F.lit(folder), F.substring(clean, len(prefix) + 1, 1 << 20))
    return F.when(clean.startswith(prefix), F.when(page.endswith(".md"), page).otherwise(F.concat(page, F.lit(".md")))).otherwise(clean)


def output_path(section: Column, source_path: Column, known: dict[str, str]) -> Column:
    """Section slug and file stem."""
    from .text import url_slug

    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    stem = F.regexp_replace(F.element_at(F.split(source_path, "/"), -1), r"(.)\.[^.]*$", "$1")
    return F.concat_ws("/", F.coalesce(F.try_element_at(pairs, section), url_slug(section)), stem)


def origin(url: Column) -> Column:
    """Scheme, host and port (unless the default) in lower case; null for other schemes, none, or with user data."""
    whole = r"^(?i)(https?)://([^/?#:@\s]+)(?::(\d+))?(?:[/?#].*)?$"
    scheme, host, port = (F.regexp_extract(url, whole, i) for i in (1, 2, 3))
    plain_port = (port == "") | ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    return F.when(host != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(plain_port, "").otherwise(F.concat(F.lit(":"), port))))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#:]+)", 1)


def ancestors(path: Column) -> Column:
    """Every proper ancestor of a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
