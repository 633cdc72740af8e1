"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each block by itself: link-dense blocks and those in parts that HTML
itself declares to be something else (navigation, forms, footers ...) are bad; long blocks are good if they are dense enough in stop words and,
outside articles, bad if they have hardly any, measured against the page's own density, so that a page in another language is judged by
length and links; all others are ambiguous.  A class name or id that speaks of something beside the text is evidence: a plain one (``advert``, ``comments``) decides,
a doubtful one (``related``, ``discussion``) only together with low density or links.  In the second pass an ambiguous block inherits the label
of the nearest decided block, first of its own parent, then of its own article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rules:
    long_chars: int = 80  # blocks under this are ambiguous
    stop_share: float = 0.2  # share of stop words from which a long block is good
    stop_least: float = 0.06  # and under which it is bad
    page_part: float = 0.5  # both bars are at most this part of the page's median share
    link_share: float = 0.5  # share of characters in links from which a block is bad
    doubt_links: float = 0.2  # the same bar where a name raises doubt


# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their they this to was were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qui que sa se ses son sont sur un une vous "
    "als auch auf aus bei das dem den der die ein eine einem einen einer er es hat ich im ist mit nach nicht noch oder sich sie sind und von war werden wie wird zu zum zur "
    "al como con del el ella esta fue ha las lo los más me mi muy no o para pero por que se si sin sobre su sus también una uno y ya".split()
)

# HTML elements by what they mean here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset("head nav footer aside form button select dialog menu svg math canvas object audio video noscript datalist search".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that aren't kept on the stack unless something in them is dropped: their ends are often left out.
LOOSE_TAGS = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup caption legend figcaption summary h1 h2 h3 h4 h5 h6 hr".split())
HOLDS_NO_BLOCK = HEADINGS | {"p", "hr", "legend", "option"}
#: Siblings that end an element whose own end tag is left out.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements whose long blocks need no stop words: listings and tables are content without them.
SPARSE_TAGS = frozenset("pre td th dd".split())
# Parts of class names and ids that name something beside the main text; the plain ones, and the doubtful ones.
PLAIN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors outbrain taboola "
    "sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer pagination pager topbar "
    "cookie cookies consent gdpr notice notices notification popup popover modal paywall newsletter subscribe subscription signup login searchform searchbox "
    "comment comments commentlist disqus".split()
)
DOUBTFUL_NAMES = frozenset(
    "banner header rail widget widgets toc promo promoted promotion alert overlay register social share sharing shares sharebar related recommended recommendations "
    "respond replies reply discussion toolbar skip form hidden copyright legal disclaimer".split()
)
#: Words that after such a name say where or how it is laid out; any other word after it names something else: an ad-hoc analysis, a login tutorial.
LAYOUT = frozenset(
    "a active area bar block body bottom box btn button card cell center closed col collapsed column component container content count dark default depth desktop end even fixed first fluid form frame full group "
    "head heading icon id image in inline inner input item items label large last layer layout left level light line link links list main message mobile modal module nav odd open outer page panel part "
    "parent placeholder position primary right root row secondary section sections show slot small social stack sticky submit tab text thread title toggle top unit view visible wrap wrapper zone".split()
)
#: After such a word the name only says that the part has, or is about, one.
NOT_ITSELF = frozenset("has with no without not hide show category tag type format status".split())
#: What names an article that is a reader's comment.
COMMENT_NAMES = frozenset("comment comments reply respond".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOLD = re.compile(r"class|id|role|hidden|style", re.I)
#: Evidence of an element's attributes.
NOTHING, DOUBT, OTHER, HIDDEN = 0, 1, 2, 3


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of equal names."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def evidence(tag: str, raw: str, in_article: bool) -> int:
    """What the attributes say of an element. Names count for block-level elements, but not for headings and the page's frame."""
    if not raw or not _TOLD.search(raw):
        return NOTHING
    told = attributes_of(raw)
    if "hidden" in told and told["hidden"].lower() != "until-found" or told.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(told.get("style", "")):
        return HIDDEN
    if tag not in BLOCK_TAGS or tag in HEADINGS or tag in ("html", "body", "main"):
        return NOTHING
    if told.get("role", "").lower() in DROPPED_ROLES:
        return OTHER
    worst = NOTHING
    for token in f"{told.get('class', '')} {told.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(token)]
        if tag in ARTICLE_TAGS:
            if words and words[0] in COMMENT_NAMES and itself(words[1:]):
                return OTHER
            continue
        for i, word in enumerate(words):
            if i and words[i - 1] in NOT_ITSELF:
                continue
            if word in PLAIN_NAMES:
                if itself(words[i + 1 :]):
                    return OTHER
                worst = DOUBT
            if word in DOUBTFUL_NAMES and not (in_article and word in ("banner", "header")):
                worst = DOUBT
    return worst


def itself(after: list[str]) -> bool:
    """Whether a name with these words after it still names the thing, and not something about it."""
    return all(w in LAYOUT or w in PLAIN_NAMES or w in DOUBTFUL_NAMES or len(w) < 2 for w in after)


@dataclass
class Block:
    text: str
    link_chars: int
    other: bool  # declared to be something else
    doubt: int  # the element whose name raises doubt, 0 for none
    article: int  # 0 outside articles
    parent: int  # the innermost block-level element around
    heading: bool
    sparse: bool


def blocks_of(page: str) -> list[Block]:
    """Nonempty blocks of a page, in order, character references decoded, white space as single spaces."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, bool, int, int, int, bool]] = []  # tag, and from here on: other, doubt, article, parent, mute
    held: Counter[str] = Counter()  # tags on the stack
    number = 0
    other, doubt, article, parent, mute = False, 0, 0, 0, False
    in_link = link_inside = heading = sparse = False
    last = ""  # the last block-level start tag

    def flush() -> None:
        nonlocal heading, sparse
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html.unescape("".join(link_parts)).split())) if link_parts else 0
                out.append(Block(text, links, other, doubt, article, parent, heading, sparse))
            parts.clear()
            link_parts.clear()
        heading = sparse = False

    def restore() -> None:
        nonlocal other, doubt, article, parent, mute
        other, doubt, article, parent, mute = stack[-1][1:] if stack else (False, 0, 0, 0, False)

    def drop(k: int) -> None:
        for x in stack[k:]:
            held[x[0]] -= 1
        del stack[k:]
        restore()

    pos, n, match = 0, len(page), _TOKEN.match
    while pos < n:
        m = match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if not mute and (page[m.start()] != "<" or m.end() - m.start() == 1):
                parts.append(m[0])
                if in_link:
                    link_parts.append(m[0])
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        block = tag in BLOCK_TAGS
        if block and link_inside:
            # a link that began inside a paragraph, heading or cell ends with it, if its own end was left out
            in_link = link_inside = False
        if closing:
            if tag == "a":
                in_link = link_inside = False
            if block:
                flush()
            if held[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if any(x[0] in BLOCK_TAGS for x in stack[k:]):
                            flush()
                        drop(k)
                        break
                    # an inline end tag doesn't close containers
                    if not block and stack[k][0] in BLOCK_TAGS and stack[k][0] not in LOOSE_TAGS:
                        break
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link, link_inside = True, last in LOOSE_TAGS
        if block:
            flush()
            last = tag
            # a new block ends an element that can't hold it
            while stack and (stack[-1][0] in HOLDS_NO_BLOCK or tag in ENDED_BY.get(stack[-1][0], ())):
                drop(len(stack) - 1)
            if tag in ARTICLE_TAGS:
                # an article starts: navigation or a header left open ended before
                while stack and stack[-1][0] in ("nav", "head"):
                    drop(len(stack) - 1)
            elif tag == "body":
                drop(0)
            heading, sparse = tag in HEADINGS, tag in SPARSE_TAGS
        if tag in VOID_TAGS:
            continue
        told = evidence(tag, attributes, article > 0)
        gone = told >= OTHER or tag in DROPPED_TAGS or (tag == "header" and not article)
        if gone or told or (block and tag not in LOOSE_TAGS):
            number += 1
            if tag in ARTICLE_TAGS and not other and not gone and not article:
                article = number
            # an inline part that isn't seen leaves its block whole
            other, mute = other or (gone and block), mute or (gone and not block)
            doubt = number if told == DOUBT else doubt
            parent = number if block else parent
            stack.append((tag, other, doubt, article, parent, mute))
            held[tag] += 1
    flush()
    return out


GOOD, BAD, OPEN = 1, -1, 0


def stop_share(text: str) -> float:
    """Share of stop words among the words; what isn't a letter at a word's ends doesn't count."""
    words = [w.lower() for w in _WORDS.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def bars(blocks: list[Block], rules: Rules) -> tuple[float, float]:
    """The page's bars on stop words: the rules', or less where the page's own long blocks are poor in them."""
    shares = sorted(stop_share(b.text) for b in blocks if not b.other and not b.sparse and len(b.text) >= rules.long_chars and b.link_chars < rules.doubt_links * len(b.text))
    median = shares[len(shares) // 2] if shares else 1.0
    return min(rules.stop_share, rules.page_part * median), min(rules.stop_least, rules.page_part * median)


def first_pass(block: Block, good: float, least: float, rules: Rules) -> int:
    """Label of a block by itself, given the page's bars."""
    links = rules.doubt_links if block.doubt else rules.link_share
    if block.other or block.link_chars >= links * len(block.text):
        return BAD
    if len(block.text) < rules.long_chars:
        return OPEN
    share = stop_share(block.text)
    if share >= good:
        return GOOD
    if block.doubt:
        return BAD
    # lists of names, figures and the like are content in an article: there the blocks around decide
    return BAD if share < least and not (block.sparse or block.article) else OPEN


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels with every ambiguous block decided.

    The nearest decided blocks before and after count: those of the same parent if there are any, else those of the same article, or, outside
    articles, of the page.  If they differ, the nearer wins; at equal distance a heading follows the block after it and other blocks
    are bad.  What a doubtful name surrounds is decided by blocks inside it only, and bad without any.  Outside articles blocks are bad if an article has
    good blocks.  Without any decided neighbour blocks are good in an article, or if the page has no good block."""
    n = len(blocks)
    any_good = GOOD in labels
    articles = any(b.article and label == GOOD for b, label in zip(blocks, labels, strict=True))

    def scopes(b: Block) -> list[tuple]:
        if b.doubt:
            return [("doubt", b.doubt)]
        return [("parent", b.parent), ("article", b.article)]

    def sweep(order: Iterator[int]) -> list[list]:
        """Of each block, the nearest decided one that came before, by scope."""
        last: dict[tuple, tuple[int, int]] = {}
        seen: list[list] = [[]] * n
        for i in order:
            b = blocks[i]
            seen[i] = [last.get(scope) for scope in scopes(b)]
            if labels[i] != OPEN:
                last["parent", b.parent] = (i, labels[i])
                if b.doubt:
                    last["doubt", b.doubt] = (i, labels[i])
                # what is declared something else inside an article says nothing of the article
                if not (b.article and (b.other or b.doubt)):
                    last["article", b.article] = (i, labels[i])
        return seen

    before, after = sweep(iter(range(n))), sweep(iter(range(n - 1, -1, -1)))
    out = list(labels)
    for i, b in enumerate(blocks):
        if articles and not b.article:
            out[i] = BAD
            continue
        if labels[i] != OPEN:
            continue
        x, y = next(((x, y) for x, y in zip(before[i], after[i], strict=True) if x or y), (None, None))
        if not any_good:
            out[i] = BAD if b.doubt else GOOD
        elif x is None and y is None:
            out[i] = GOOD if b.article and not b.doubt else BAD
        elif x is None or y is None:
            out[i] = (x or y)[1]
        elif x[1] == y[1]:
            out[i] = x[1]
        elif i - x[0] != y[0] - i:
            out[i] = x[1] if i - x[0] < y[0] - i else y[1]
        else:
            out[i] = y[1] if b.heading else BAD
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Blocks of the main text joined by newlines; empty if there are none."""
    blocks = blocks_of(page or "")
    good, least = bars(blocks, rules)
    labels = second_pass(blocks, [first_pass(b, good, least, rules) for b in blocks])
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame, rules: Rules = Rules(), html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html column.

    The whole page is read; a null or empty page, or one without main text, gives an empty text and 0.  Columns named ``text`` or
    ``n_chars`` are replaced; all others, and repeated rows, pass through."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*keep, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(p.as_py(), rules) for p in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = source.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(run, schema)
