"""Main text of web pages by tag-path ratios (after Wu et al., "Web News Extraction via Path Ratios", 2013).

1. A page is cut into blocks: runs of text between block elements, each with its root-to-leaf path of tags and classes.
2. Text length (link text apart), punctuation and number of blocks are summed for each path.
3. A path's ratios are smoothed with those of its section: the nearest article or main element around it, else the nearest box.
4. The length ratio and the punctuation ratio are fused, and paths under a share of the page's best are no content.

Elements that the page itself names as something else (nav, footer, aside, forms, scripts, a class `ad` or `comments`) are no candidates.
Where a page marks its article or main element, only blocks inside it are. The work is per page, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_texts, table

#: A path is content from this share of the best path's fused ratio on.
SHARE = 0.1
#: Blocks of a list or box that are mostly links make it a menu from this many on.
MENU_BLOCKS, LINK_SHARE = 3, 2 / 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'<>]|["'])*+)(?:>|(?=<)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

# Elements of HTML by what they do, and the words that classes and ids use for what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset(["article", "main"])
BOX = frozenset("body center details div html section td th".split())
OTHER = frozenset("nav footer aside menu dialog head button select option fieldset legend search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCK - {"body", "head", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
HOLDS = frozenset("article aside blockquote body details div dl fieldset footer form header main nav ol section table td th ul".split())
NOT_ARTICLE = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form "
    "gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe tags teaser toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())


class Block(NamedTuple):
    path: int
    parent: int
    section: int
    article: bool
    heading: bool
    text: str
    linked: int


class _Open(NamedTuple):
    tag: str
    path: int  # a number for each distinct root-to-leaf path of the page
    parent: int
    section: int  # the path of the nearest article or main element, 0 for none
    box: int  # the path of the nearest element that holds a part of the page
    other: str  # why its blocks are no candidates; a form's or header's reason ends where an article begins in it
    heading: bool


@lru_cache(1 << 14)
def _other(tag: str, attributes: str) -> tuple[str, str]:
    """(the element's label in paths, why it isn't part of an article)."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    label = f"{tag}.{names[0]}" if names else tag
    if tag in OTHER or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return label, "element"
    if tag in ("html", "body"):
        return label, ""
    words = [w for w in (re.split(r"[-_]+", n) for n in names) if w[0] not in ("with", "has", "no", "is")]
    ends = {x for w in words for x in (w[0], w[-1])}
    if ends & (COMMENTS if tag in CONTENT else NOT_ARTICLE) or tag not in CONTENT and found.get("role") in ROLES:
        return label, "name"
    return label, tag if tag in ("form", "header") else ""


def blocks_of(page: str) -> list[Block]:
    """The candidate blocks of a page in order: white space is one space, character references are decoded, empty ones are left out."""
    out: list[Block] = []
    numbers: dict[tuple[int, str], int] = {}
    stack = [_Open("", 0, 0, 0, 0, "", False)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        x = stack[-1]
        # The title stands in an article's header.
        if text and (not x.other or x.other == "header" and x.section and x.heading):
            out.append(Block(x.path, x.parent, x.section or x.box, x.section > 0, x.heading, text, linked))
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at and stack[-1].other not in ("element", "name"):
            piece = html.unescape(page[at:end])
            pieces.append(piece)
            if opened["a"]:
                linked += len(" ".join(piece.split()))

    def pop_to(depth: int) -> None:
        if any(x.tag in BLOCK for x in stack[depth:]):
            close()
        opened.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    while m := _TOKEN.search(page, at):
        text_to(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in BLOCK
        if m[1]:
            if block:
                close()
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if not block and stack[i].tag in BLOCK:  # an inline element's end closes no block that was opened in it
                        break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            pieces.append(" ")
        if block:
            close()
            for i in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    pop_to(i)
                elif stack[i].tag in HOLDS:
                    break
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        above = stack[-1]
        label, why = _other(tag, m[3]) if block or "class" in m[3] or "hidden" in m[3] or "style" in m[3] else (tag, "")
        around = "" if tag in CONTENT and above.other in ("form", "header") else above.other
        # What is named outright outweighs a form or header around it.
        reason = why if why in ("element", "name") else around or why
        if block:
            path = numbers.setdefault((above.path, label), len(numbers) + 1)
            stack.append(_Open(tag, path, above.path, above.section or (path if tag in CONTENT else 0), path if tag in BOX else above.box, reason, above.heading or tag in HEADINGS))
        else:
            stack.append(above._replace(tag=tag, other=reason))
        opened[tag] += 1
    text_to(len(page))
    while stack[-1].tag not in BLOCK and len(stack) > 1:
        stack.pop()
    close()
    return out


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """The fused, smoothed ratio of each path of a page's blocks."""
    paths: dict = defaultdict(lambda: [0, 0, 0])
    sections: dict = defaultdict(lambda: [0, 0, 0])
    where = {}
    for b in blocks:
        for sums in (paths[b.path], sections[b.section]):
            sums[0] += 1
            sums[1] += max(0, len(b.text) - b.linked)
            sums[2] += len(_PUNCTUATION.findall(b.text))
        where[b.path] = b.section
    out = {}
    for path, (n, length, marks) in paths.items():
        all_n, all_length, all_marks = sections[where[path]]
        out[path] = ((length / n + all_length / all_n) / 2) * (1 + (marks / n + all_marks / all_n) / 2)
    return out


def content_blocks(page: str | None) -> list[Block]:
    """The blocks of a page's article, in page order."""
    blocks = blocks_of(page or "")
    if any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    menus: dict = defaultdict(lambda: [0, 0])
    for b in blocks:
        menus[b.parent][0] += 1
        menus[b.parent][1] += b.linked > LINK_SHARE * len(b.text)
    menu = {k for k, (n, full) in menus.items() if full >= MENU_BLOCKS and full > LINK_SHARE * n}
    blocks = [b for b in blocks if b.parent not in menu]
    scores = path_scores(blocks)
    least = SHARE * max(scores.values(), default=0.0)
    kept = [scores[b.path] >= least for b in blocks]
    for i in range(len(blocks) - 2, -1, -1):  # a heading goes with what it stands over
        kept[i] = kept[i] or kept[i + 1] and blocks[i].heading
    return [b for b, k in zip(blocks, kept) if k]


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `column` replaced by text and n_chars (code points): the article's blocks, joined by line ends.

    Null and empty pages, and such without an article's text, have the empty text. Other columns pass through, repeated rows are rows;
    columns named text or n_chars give way to these. A page is one row's work, so very long ones need the memory of a few copies of
    them. An empty table gives an empty result.
    """
    others = [f for f in pages.schema.fields if f.name.lower() not in (column.lower(), "text", "n_chars")]
    schema = StructType([*others, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(b.text for b in content_blocks(x.as_py())) for x in batch.column(0)]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[f.name for f in schema.fields])

    return map_texts(pages.select(f"`{column}`", *[f"`{f.name}`" for f in others]), run, schema)


def op13_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
