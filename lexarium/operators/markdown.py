"""Conversion of vendor-flavoured Markdown to plain components: an ordered list of text steps.

Each step is a function of a page's text; steps that must not touch code run on the prose between protected parts.
``converted`` runs the list in one Arrow pass over a table of pages.
"""

from __future__ import annotations

import json
import re
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import resolved
from ..sources.landed import yaml_of
from ..storage import written
from .batches import sliced

# Callout words and their components.
CALLOUTS = {"TIP": "Tip", "NOTE": "Note", "WARNING": "Warning", "IMPORTANT": "Info", "CAUTION": "Danger"}
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
#: Tags that stay tags when angle brackets are escaped.
KNOWN_TAG = re.compile(r"</?(?:[A-Z][A-Za-z]*|a|b|blockquote|br|code|dd|details|div|dl|dt|em|h[1-6]|hr|i|img|kbd|li|ol|p|pre|span|strong|sub|summary|sup|table|tbody|td|th|thead|tr|u|ul|video)\b[^<>]*>")


def split_protected(text: str) -> list[str]:
    """Prose and protected parts in turn, beginning and ending with prose; joined they are the text. Protected are closed
    fences and component comments."""
    parts, prose, lines, i = [], [], re.split(r"(?<=\n)", text), 0
    while i < len(lines):
        fence = re.match(r"[ \t]{0,9}(`{3,}|~{3,})[^`\n]*\n?$", lines[i])
        end = None
        if fence:
            closing = re.compile(rf"[ \t]*{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*\n?$")
            end = next((j for j in range(i + 1, len(lines)) if closing.match(lines[j])), None)
        if end is None:
            prose.append(lines[i])
            i += 1
            continue
        parts += ["".join(prose), "".join(lines[i : end + 1])]
        prose, i = [], end + 1
    parts.append("".join(prose))
    out: list[str] = []
    for k, part in enumerate(parts):
        out += [part] if k % 2 else re.split(r"(\{/\*[\s\S]*?\*/\})", part)
    return out


def in_prose(step: Callable[[str], str]) -> Callable[[str], str]:
    """The step on prose alone."""
    return lambda text: "".join(part if k % 2 else step(part) for k, part in enumerate(split_protected(text)))


def monikers(keep: str, drop: str) -> Callable[[str], str]:
    """Blocks for version ``drop`` alone go, those for ``keep`` lose their marks."""
    block = re.compile(r':::\s?moniker\s+range="([^"]*)"\s*\n(.*?):::\s?moniker-end', re.S)

    def step(text: str) -> str:
        def one(m: re.Match) -> str:
            names = {n.strip() for n in m[1].split("||")}
            return m[2] if keep in names else "" if names == {drop} else m[0]

        return block.sub(one, text)

    return step


def _unquoted(block: str, indent: str = "") -> list[str]:
    return [re.sub(r"^>\s?", "", line.removeprefix(indent)) for line in block.split("\n")]


def callouts(text: str) -> str:
    """Marked block quotes as components."""

    def one(m: re.Match) -> str:
        name, indent = CALLOUTS[m[2].upper()], m[1]
        inner = "\n".join(_unquoted(m[3], indent)).strip()
        return "".join(f"{indent}{line}\n" for line in (f"<{name}>", "", inner, "", f"</{name}>"))

    return re.sub(rf"^([ \t]*)>\s*\[!({'|'.join(CALLOUTS)})\]\s*\n((?:\1>.*\n?)*)", one, text, flags=re.I | re.M)


def quoted_blocks(text: str) -> str:
    """Block quotes with a class: next steps become cards, checklists lists, selectors tabs, and table wrappers go."""

    def one(m: re.Match) -> str:
        lines = [line.strip() for line in _unquoted(m[2])]
        links = re.findall(r"\[([^\]]+)\]\(([^)]+)\)", "\n".join(lines))
        if m[1] == "nextstepaction":
            return "\n".join(f'<Card title="{t}" icon="arrow-right" href="{h}" />' for t, h in links) or "\n".join(lines).strip()
        if m[1] == "checklist":
            return "\n".join(re.sub(r"^[*-] +", "- ", line) for line in lines if line)
        if m[1] == "op_single_selector":
            return "<Tabs>\n" + "\n".join(f'  <Tab title="{t}">\n    [{t}]({h})\n  </Tab>' for t, h in links) + "\n</Tabs>" if links else ""
        return "\n".join(_unquoted(m[2]))

    return re.sub(r'>\s*\[!div\s+class="(nextstepaction|checklist|op_single_selector|op_multi_selector|mx-td[^"]*)"[^\]]*\]\s*\n((?:>.*\n?)*)', one, text)


def columns(text: str) -> str:
    """Rows of columns as cards side by side."""

    def one(m: re.Match) -> str:
        cells = [re.sub(r":::column-end:::\s*\n?", "", c).strip() for c in re.split(r":::column[^:-][^:]*:::\s*\n?|:::column:::\s*\n?", m[1])]
        cells = [c for c in cells if c]
        cards = "\n".join(f"<Card>\n\n{c}\n\n</Card>" for c in cells)
        return f"<Columns cols={{{len(cells)}}}>\n{cards}\n</Columns>\n" if cells else ""

    return re.sub(r":::row:::\s*\n(.*?):::row-end:::\s*\n?", one, text, flags=re.S)


def images(text: str) -> str:
    """Image directives as framed images; icons stay inline, and a long description ends with the directive."""

    def one(m: re.Match) -> str:
        fields = dict(re.findall(r'([\w-]+)="([^"]*)"', m[1]))
        alt = fields.get("alt-text", "").replace('"', "&quot;")
        image = f'<img src="{fields.get("source", "")}" alt="{alt}" />'
        return image if fields.get("type") == "icon" else f"<Frame>\n  {image}\n</Frame>"

    text = re.sub(r":::image\s+([^\n]*?type=\"complex\"[^\n]*?):::[\s\S]*?:::image-end:::", one, text)
    return re.sub(r":::image\s+([^\n]*?):::", one, text)


def image_paths(text: str) -> str:
    """Image sources by file name below /images."""
    named = lambda m: m[1] + "/images/" + m[2].split("/")[-1] + m[3]
    text = re.sub(r'(<img\b[^>]*?\bsrc=")(?!https?:|/images/)([^"]+)(")', named, text)
    return re.sub(r"(!\[[^\]]*\]\()(?!https?:|/images/)([^)\s]+)(\))", named, text)


def tabs(text: str) -> str:
    """Runs of tab headings up to a rule as tab groups; a group of one is just its content."""
    out: list[str] = []
    group: list[tuple[str, list[str]]] = []

    def close() -> None:
        if len(group) == 1:
            out.extend(group[0][1])
        elif group:
            out.append("<Tabs>")
            for title, lines in group:
                out.extend([f'  <Tab title="{title}">', *("    " + line if line.strip() else "" for line in lines), "  </Tab>"])
            out.append("</Tabs>")
        group.clear()

    for line in text.split("\n"):
        heading = re.match(r"^#{1,6}\s+\[([^\]]+)\]\(#tab/[^)]+\)\s*$", line)
        if heading:
            group.append((heading[1], []))
        elif group and line.strip() == "---":
            close()
        elif group and re.match(r"\s*</?(?:Tabs?|ZonePivot|ZoneContent)\b", line):
            close()
            out.append(line)
        else:
            (group[-1][1] if group else out).append(line)
    close()
    return "\n".join(out)


def zones(titles: dict[str, str]) -> Callable[[str], str]:
    """Adjacent pivot zones as one group with one selector per page; a repeated pivot starts a new group, a lone zone is its content."""
    start, stop = re.compile(r':::\s*zone\s+pivot="([^"]+)"\s*$'), re.compile(r":::\s*zone-end\s*$")

    def step(text: str) -> str:
        groups: list = []  # lines, or lists of (pivot, lines)
        blank: list[str] = []
        zone: tuple[str, list[str]] | None = None
        for line in text.split("\n"):
            opened = start.match(line.strip())
            if zone is not None:
                if stop.match(line.strip()):
                    zone = None
                else:
                    zone[1].append(line)
            elif opened:
                zone = (opened[1], [])
                last = groups[-1] if groups else None
                if isinstance(last, list) and opened[1] not in {p for p, _ in last}:
                    last.append(zone)
                else:
                    groups.append([zone])
                blank.clear()
            elif not line.strip() and groups and isinstance(groups[-1], list):
                blank.append(line)
            else:
                groups += [*blank, line]
                blank.clear()
        out: list[str] = []
        shown: dict[str, str] = {}
        for item in [*groups, *blank]:
            if isinstance(item, str):
                out.append(item)
                continue
            pivots = [p for p, _ in item]
            if len(pivots) == 1:
                out += item[0][1]
                continue
            name = group_name(pivots)
            if name not in shown:
                listed = json.dumps([{"id": p, "title": titles.get(p, p.replace("-", " ").title())} for p in pivots], ensure_ascii=False)
                shown[name] = f'options={{{listed}}}', f'values={{{json.dumps(pivots, ensure_ascii=False)}}}', f'defaultValue="{pivots[0]}"'
                options, _, default = shown[name]
                out += [f'<ZonePivot group="{name}" {options} {default} />', ""]
            for pivot, lines in item:
                out += [f'<ZoneContent group="{name}" value="{pivot}" {" ".join(shown[name])}>', "", *lines, "", "</ZoneContent>"]
        return "\n".join(out)

    return step


def group_name(pivots: list[str]) -> str:
    """A group's name: its pivots in order, without signs that an attribute can't have."""
    return "-".join(re.findall(r"[A-Za-z0-9_-]+", "__".join(sorted(set(pivots))))).strip("-") or "default"


def zone_import(text: str) -> str:
    """Pages with zones import their components, once."""
    line = 'import { ZoneContent, ZonePivot } from "/snippets/zone-pivot.jsx"'
    uses = re.search(r"<Zone(?:Pivot|Content)\b", text)
    return f"{line}\n\n{text}" if uses and 'from "/snippets/zone-pivot.jsx"' not in text else text


def code_groups(text: str) -> str:
    """Tab groups of nothing but code become code groups, each block under its tab's title; up to twenty characters beside the code don't matter."""
    fence = re.compile(r"(```)(\w*)([^\n]*)\n(.*?)\n?(```)", re.S)

    def one(m: re.Match) -> str:
        blocks: list[str] = []
        for title, body in re.findall(r'<Tab\s+title="([^"]+)">\n?(.*?)</Tab>', m[1], re.S):
            body = textwrap.dedent(body)
            found = fence.findall(body)
            if not found or len(fence.sub("", body).strip()) > 20:
                return m[0]
            blocks += [f"```{lang}{rest.rstrip() or (lang and ' ' + title)}\n{code}\n```" for _, lang, rest, code, _ in found]
        return "<CodeGroup>\n" + "\n\n".join(blocks) + "\n</CodeGroup>" if blocks else m[0]

    return re.sub(r"<Tabs>(.*?)</Tabs>", one, text, flags=re.S)


def list_components(text: str) -> str:
    """Components that stand indented in list items move to the margin, with a blank line before and after: inside an item they would end it."""
    names = "Frame|Note|Info|Tip|Warning|Danger"
    lines, out, i, listed = text.split("\n"), [], 0, False
    while i < len(lines):
        line = lines[i]
        if re.match(r"\s*(?:\d+\.|[-*])\s", line):
            listed = True
        elif line[:1] not in ("", " ", "\t"):
            listed = False
        opened = listed and re.match(rf"(\s+)<({names})(?=[\s>/])", line)
        if not opened:
            out.append(line)
            i += 1
            continue
        last = i if re.search(r"/>\s*$", line) and f"</{opened[2]}>" not in line else next((j for j in range(i, len(lines)) if f"</{opened[2]}>" in lines[j]), len(lines) - 1)
        if out and out[-1].strip():
            out.append("")
        out += [x[len(opened[1]) :] if x.startswith(opened[1]) else x.strip() for x in lines[i : last + 1]]
        i = last + 1
        if i < len(lines) and lines[i].strip():
            out.append("")
    return "\n".join(out)


def code_references(text: str) -> str:
    """References to code that isn't at hand as blocks that name the file."""
    return re.sub(r"\[!code-(\w+)\[[^\]]*\]\(([^)]+)\)\]", lambda m: f"```{m[1]}\n// See: {m[2].split('?')[0].rstrip('/').split('/')[-1]}\n```", text)


@dataclass(frozen=True)
class Site:
    """Where links lead that leave the pages: paths that begin with one of ``prefixes`` are the site's, and so are pages of the repositories ``siblings``, below ``base``."""

    address: str = ""
    prefixes: tuple[str, ...] = ()
    siblings: tuple[str, ...] = ()
    base: str = ""


def links(outputs: dict[str, str], site: Site = Site()) -> Callable[[str], str]:
    """Links of one page: to other pages by ``outputs`` (target as written, without anchor, to output path), to the site's other parts by address, others without
    query and suffix; an empty link is its text."""
    sibling = re.compile(rf"^(?:\.\./)+({'|'.join(map(re.escape, site.siblings))})/(.*?)\.md$")

    def one(m: re.Match) -> str:
        text, href = m[1], m[2].replace("\\", "/")
        bare = href.split("?")[0]
        target, mark, anchor = bare.partition("#")
        if bare.startswith(("http://", "https://")):
            return f"[{text}]({href})"
        if not target and not anchor:
            return text or m[0]
        if bare.startswith(site.prefixes):
            return f"[{text}]({site.address}{bare})"
        if not target.endswith(".md"):
            return f"[{text}]({bare})"
        outside = site.siblings and sibling.match(target)
        if target in outputs:
            target = "/" + outputs[target]
        elif outside:
            target = f"{site.address}{site.base}/{outside[1]}/{outside[2]}"
        else:
            target = target.removesuffix(".md")
        return f"[{text}]({target}{mark}{anchor})"

    return lambda text: re.sub(r"(?<!!)\[([^\]]*)\]\(([^)]+)\)", one, text)


def tables(text: str) -> str:
    """Delimiter rows with as many cells as their headers; run twice it changes nothing more."""
    lines = text.split("\n")
    for i in range(1, len(lines)):
        row, head = re.match(r"^(\s*)\|(.+)\|\s*$", lines[i]), re.match(r"^\s*\|(.+)\|\s*$", lines[i - 1])
        if row and head:
            cells, n = [c.strip() for c in row[2].split("|")], len(head[1].split("|"))
            if len(cells) != n and all(re.fullmatch(r":?-{3,}:?", c) for c in cells):
                lines[i] = f"{row[1]}| " + " | ".join((cells + ["---"] * n)[:n]) + " |"
    return "\n".join(lines)


def html_comments(text: str) -> str:
    return re.sub(r"<!--([\s\S]*?)-->", lambda m: "{/*" + m[1].replace("*/", "* /") + "*/}", text)


def void_tags(text: str) -> str:
    """Void elements closed, their end tags gone."""
    text = re.sub(rf"</(?:{VOID})\s*>", "", text, flags=re.I)
    return re.sub(rf"<({VOID})\b([^<>]*?)\s*/?>", lambda m: f"<{m[1]}{m[2]} />", text, flags=re.I)


def orphan_tags(text: str) -> str:
    """End tags of divs, spans and paragraphs that nothing opened go."""
    depth: dict[str, int] = {}

    def one(m: re.Match) -> str:
        name = m[2].lower()
        if not m[1]:
            depth[name] = depth.get(name, 0) + (not m[0].endswith("/>"))
            return m[0]
        if depth.get(name, 0):
            depth[name] -= 1
            return m[0]
        return ""

    return re.sub(r"<(/?)(div|span|p)\b[^<>]*>", one, text, flags=re.I)


def _outside_spans(text: str, step: Callable[[str], str]) -> str:
    return "".join(p if k % 2 else step(p) for k, p in enumerate(re.split(r"(`+[^`]*`+)", text)))


def angle_brackets(text: str) -> str:
    """Angle brackets that open no known tag are escaped, outside code spans."""
    escape = lambda s: re.sub(r"<(?![^\n]{0,0}$)", lambda m: "<" if KNOWN_TAG.match(s, m.start()) else "&lt;", s)
    return _outside_spans(text, escape)


def braces(text: str) -> str:
    """Braces that are no attribute of a tag are escaped, outside code spans and tags."""
    outside = lambda s: "".join(p if k % 2 else re.sub(r"(?<!\\)([{}])", r"\\\1", p) for k, p in enumerate(re.split(r"(<[A-Za-z/][^<>]*>)", s)))
    return _outside_spans(text, outside)


def tidy(text: str) -> str:
    """No trailing white space, no run of blank lines, one newline at the end."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip("\n") + "\n"


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Fields of the front matter that pages keep, and the rest of the page."""
    m = re.match(r"^---\s*\n(.*?)\n---\s*\n", text, re.S)
    if not m:
        return {}, text
    given = {k: v.strip().strip("\"'") for k, v in re.findall(r"^(\w+):[ \t]*(.*)$", m[1], re.M)}
    kept = {k: given[k] for k in ("title", "description") if given.get(k)}
    if given.get("titleSuffix") and kept.get("title"):
        kept["sidebarTitle"] = kept["title"]
    return kept, text[m.end() :]


def page(text: str, steps: list[Callable[[str], str]]) -> str:
    """A whole page: its front matter simplified, its leading heading dropped (it is the title), its body by the steps."""
    fields, body = front_matter(text)
    heading = re.match(r"\s*#\s+(.+)\n", body)
    if heading:
        fields.setdefault("title", heading[1].strip())
        body = body[heading.end() :]
    for step in steps:
        body = step(body)
    head = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in fields.items())
    return f"---\n{head}---\n\n{tidy(body)}"


def standard_steps(titles: dict[str, str] | None = None, keep: str = "current", drop: str = "classic", outputs: dict[str, str] | None = None, site: Site = Site()) -> list[Callable[[str], str]]:
    """The steps in their order, which is part of their meaning. ``outputs``: a page's link targets; without them links stay as they are."""
    linked = [in_prose(links(outputs, site))] if outputs is not None else []
    return [
        monikers(keep, drop), in_prose(callouts), in_prose(quoted_blocks), zones(titles or {}), tabs, images, image_paths, columns, *linked, code_references,
        in_prose(tables), in_prose(html_comments), in_prose(void_tags), in_prose(orphan_tags), in_prose(angle_brackets), in_prose(braces), list_components, code_groups, zone_import,
    ]


def faq(title: str, sections: list[dict], summary: str = "") -> str:
    """A question list (``name``, ``questions`` of ``question`` and ``answer``) as a page."""
    head = f"title: {json.dumps(title, ensure_ascii=False)}\n" + (f"description: {json.dumps(summary.strip(), ensure_ascii=False)}\n" if summary.strip() else "")
    out = [f"---\n{head}---\n"]
    for s in sections:
        if s.get("name"):
            out.append(f"## {s['name']}\n")
        for q in s.get("questions") or []:
            asked, answer = (q.get("question") or "").strip(), (q.get("answer") or "").strip()
            out += [f"### {asked}\n"] * bool(asked) + [f"{answer}\n"] * bool(answer)
    return "\n".join(out)


def faq_page(text: str) -> str | None:
    """A question list in YAML as a page; null for YAML that holds nothing. Titles and summaries may stand in its metadata."""
    data = yaml_of(text)
    if not isinstance(data, dict) or not data:
        return None
    meta = data.get("metadata") or {}
    return faq(data.get("title") or meta.get("title") or "FAQ", data.get("sections") or [], data.get("summary") or meta.get("description") or "")


INCLUDE = r"\[!INCLUDE\s*\[[^\]]*\]\(([^)]+)\)\]"
SAMPLE = r'(?m)^([ \t]*):::code\s+language="(\w+)"\s+source="([^"]+)"(?:[ \t]+[^:\n]*)?:*'


def _replaced(rows: DataFrame, found: DataFrame, path: str, content: str) -> DataFrame:
    """``path, content`` with each ``literal`` of ``found`` (``path, literal, body``) replaced; a page's literals are few."""
    pairs = found.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("literal", "body"))).alias("_pairs"))
    text = F.aggregate(F.coalesce("_pairs", F.array().cast("array<struct<literal:string,body:string>>")), F.col(content), lambda acc, p: F.replace(acc, p["literal"], p["body"]))
    return rows.select(path, content).join(pairs, path, "left").select(path, text.alias(content))


def inlined(pages: DataFrame, includes: DataFrame, path: str = "path", content: str = "content", depth: int = 5) -> DataFrame:
    """``path, content`` of pages with their includes in place, and those that includes include, to ``depth``; unknown ones are empty.

    ``includes``: ``path, content``.  References are resolved against the file that holds them.  Includes are put together first, one level a round, as joins; then each
    page takes finished bodies."""
    literal = re.sub(r"\(\[\^\)\]\+\)", r"[^)]+", INCLUDE)

    def step(rows: DataFrame, bodies: DataFrame) -> DataFrame:
        refs = rows.select(path, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(literal), 0))).alias("literal"))
        folder = F.regexp_replace(path, r"/?[^/]*$", "")
        refs = refs.withColumn("_target", resolved(F.regexp_extract("literal", INCLUDE, 1), folder))
        known = bodies.select(F.col("path").alias("_target"), F.col("content").alias("body"))
        return _replaced(rows, refs.join(known, "_target", "left").select(path, "literal", F.coalesce("body", F.lit("")).alias("body")), path, content)

    body = F.regexp_replace(F.trim("content"), r"(?s)^---\s*\n.*?\n---\s*\n", "")
    raw = bodies = written(includes.select("path", body.alias("content")), "includes")
    for _ in range(depth):
        if bodies.where(F.col("content").rlike(INCLUDE)).isEmpty():
            break
        bodies = written(step(raw.select(F.col("path").alias(path), F.col("content").alias(content)), bodies).select(F.col(path).alias("path"), F.col(content).alias("content")), "includes")
    return step(pages, bodies)


def with_samples(pages: DataFrame, samples: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, content`` of pages with code directives as blocks of the sample files (``path, content``), indented as the directive was; a file that isn't there is named."""
    rows = pages.select(path, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(SAMPLE), 0))).alias("literal"))
    part = lambda i: F.regexp_extract("literal", SAMPLE, i)
    rows = rows.withColumn("_source", F.regexp_replace(part(3), r"^[~/]+", ""))
    files = samples.select(F.regexp_replace("path", r"^[~/]+", "").alias("_source"), F.regexp_replace("content", r"^\s+|\s+$", "").alias("_code"))
    code = F.coalesce("_code", F.concat(F.lit("// Source: "), F.element_at(F.split("_source", "/"), -1), F.lit(" (not available)")))
    block = F.concat(part(1), F.lit("```"), part(2), F.lit("\n"), F.regexp_replace(code, F.lit(r"(?m)^(?=.)"), part(1)), F.lit("\n"), part(1), F.lit("```"))
    return _replaced(pages, rows.join(files, "_source", "left").select(path, "literal", block.alias("body")), path, content)


def link_outputs(pages: DataFrame, routes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, outputs``: for each page the map of its link targets to other pages, as ``links`` takes it. ``routes``: ``source_path, output_path``."""
    hrefs = F.transform(F.regexp_extract_all(content, F.lit(r"(?<!!)\[[^\]]*\]\(([^)]+)\)"), 1), lambda h: F.regexp_replace(F.replace(h, F.lit("\\"), F.lit("/")), r"[?#].*$", ""))
    refs = pages.select(path, F.explode(F.array_distinct(F.filter(hrefs, lambda h: h.endswith(".md")))).alias("href"))
    refs = refs.withColumn("source_path", resolved(F.col("href"), F.regexp_replace(path, r"/?[^/]*$", "")))
    return refs.join(routes.select("source_path", "output_path"), "source_path").groupBy(path).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("href", "output_path")))).alias("outputs"))


def converted(
    pages: DataFrame, path: str, content: str, steps: list[Callable[[str], str]] | None = None, titles: dict[str, str] | None = None,
    includes: DataFrame | None = None, samples: DataFrame | None = None, routes: DataFrame | None = None, site: Site = Site(),
) -> DataFrame:
    """``path, page`` of every page: includes and code samples in place, links rewritten, then the steps, in one Arrow pass.

    What a page draws from other tables comes by joins; a page meets only its own."""
    rows = pages.select(path, content)
    if includes is not None:
        rows = inlined(rows, includes, path, content)
    if samples is not None:
        rows = with_samples(rows, samples, path, content)
    kind = pages.schema[path].dataType.simpleString()
    if routes is not None:
        rows = rows.join(link_outputs(rows, routes, path, content), path, "left")

    linked = routes is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standard = steps or standard_steps(titles)
        for batch in sliced(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own = [standard] * len(texts) if not linked else [steps or standard_steps(titles, outputs=dict(o or []), site=site) for o in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page(t, s) for t, s in zip(texts, own, strict=True)], pa.string())], ["path", "page"])

    return rows.mapInArrow(run, f"path {kind}, page string")
