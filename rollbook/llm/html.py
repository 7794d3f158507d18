"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of presentation: a node is a path of tags and classes. Of each node the pages
that show it are counted, and of each content at a node the pages that repeat it. A content's importance is ``1 - log_m(n)``
for n of m pages; a node's is mixed from the entropy of the presentations below it and the mean importance of its contents. Branches of
low importance are removed from every page of the host.

Entropy needs several pages, and can't tell a menu that differs from page to page from an article. So the tree's importance is
weighted by what the markup says: branches that name themselves menus, headers, footers, sidebars, notices, adverts, forms
or comments count as nothing, and branches of an article or main element count in full, unless they are a small part of what the
tree leaves of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.runtime import checkpoint

#: Pages of a host that must show a node before its importance counts; the least importance; the weight of contents in it.
PAGES, LEAST, CONTENT = 8, 0.3, 0.9
#: Share of a page's text that its article and main elements must hold to be its article; with less they are teasers.
MAIN_SHARE = 0.25
#: Unimportant contents up to which their table (16 bytes and a host name each) is sent to every executor; beyond, pages are shuffled by host.
BROADCAST_ROWS = 200_000

# fixed values: HTML elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
TO_THE_END = frozenset("script style textarea title".split())  # what these hold is no markup, with or without an end tag
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
DROPPED = RAW | frozenset("head nav aside footer form button select option input menu dialog fieldset".split())
# fixed values: words in a class, id or role that name a branch as no part of the article
NOISE = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notices "
                  "popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies sidebar sidebars aside widget "
                  "widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer footnav toolbar "
                  "recommendations contentinfo complementary".split())
# fixed values: words that also belong to subjects of articles; they name a part only beside words of layout or noise
TOPICS = frozenset("alert notice recommended related search share sharing social".split())
LAYOUT = frozenset("area articles bar block box button buttons column container content field form group icons inner item items left links list media mobile page "
                   "panel posts right section site stories top bottom widget wrap wrapper".split())
# fixed values: words before a name that say that something else has, or has not, such a part; and those of whom reviews are comments
ABSENT = frozenset("has have with without no not non hide hides show shows is".split())
READERS = frozenset("user users reader readers customer customers guest guests visitor visitors".split())
OUTER_NOISE = frozenset("header masthead topbar banner".split())

# fixed values: elements that end an open one of these
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

# a short tag as a whole, or the start of any other, whose end is then searched with _close
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/><]*+)(?:((?:[^<>"']{1,200}+|"[^"]{0,200}+"|'[^']{0,200}+'){0,20}+)(>))?""", re.S)
_MARK = re.compile(r"""[<>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?|"[^"]*+"|'[^']*+'""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Block:
    """Text of one block, the hash of its style path, that of its parent's, and whether it is in an article or main element."""

    text: str
    path: int
    parent: int
    main: bool


def _names_noise(words: list[str]) -> bool:
    """Whether the words of one class, id or role name a menu, notice, advert, comments and so on.

    ``has-sidebar`` is no sidebar, and ``related-work`` or ``social-science`` are subjects, but ``related-posts`` names a part.
    """
    if words[0] in ABSENT:
        return False
    if not NOISE.isdisjoint(words) or "reviews" in words and not READERS.isdisjoint(words):
        return True
    return not TOPICS.isdisjoint(words) and all(w in TOPICS or w in LAYOUT or w.isdigit() for w in words)


def _named(tag: str, attributes: str) -> tuple[str, bool, frozenset[str], bool]:
    """The class, whether a name is one of noise, the words of class, id and role, and whether the element is hidden.

    A heading's id is the target of links to what it says, so it names no part.
    """
    style, noise, words, hidden = "", False, set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or "").lower()
        if name not in _NAMES:
            continue
        value = (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                if (own := _WORD.findall(token)) and not (name == "id" and tag in _HEADINGS):
                    words.update(own if own[0] not in ABSENT else ())
                    noise |= _names_noise(own)
            style = value if name == "class" else style
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        else:
            hidden |= name == "hidden" or value == "true"
    return style, noise, frozenset(words), hidden


def _close(page: str, at: int, dead: set[int]) -> int:
    """Where the attributes from ``at`` end, at a > outside quotes, or -1 if a < or the page's end comes first.

    Quoted values have any length; a quote that no other closes is a character like others. ``dead`` holds the quotes of this
    page from which no end is found, so each is followed once and a page takes linear time.
    """
    seen = []
    while m := _MARK.search(page, at):
        at, mark = m.start(), m[0]
        if mark == ">":
            return at
        if mark == "<" or at in dead:
            break
        seen.append(at)
        at = max(at, page.find(mark, at + 1)) + 1
    dead.update(seen)
    return -1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without the branches that name themselves noise.

    Unclosed elements end with what contains them, an unclosed drawing or frame before its contents; an end tag without a start is ignored. White space of any kind inside a block
    becomes one space, and so does a line break element.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, dropped, main
    pieces: list[str] = []
    page, at, dead = page or "", 0, set()

    def end_block() -> None:
        if not pieces:
            return
        text = "".join(pieces)
        pieces.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            holder = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCK), 0)
            out.append(Block(text, stack[holder][1], stack[max(0, holder - 1)][1], stack[-1][3]))

    def pop(size: int) -> None:
        for k in range(size, len(stack)):
            if stack[k][0] in BLOCK:
                end_block()
                break
        del stack[size:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        start, end = m.span() if m else (len(page), len(page))
        attributes = ""
        if m and m[2]:
            close = end - 1 if m[4] else _close(page, end, dead)
            attributes = m[3] if m[4] else page[end:close] if close >= 0 else ""
            if close < 0:  # no tag: text
                if not stack[-1][2]:
                    pieces.append(page[at:end])
                at = end
                continue
            end = close + 1
        if start > at and not stack[-1][2]:
            pieces.append(page[at:start])
        if not m:
            break
        at = end
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            size = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if size:
                pop(size)
            continue
        if tag in BLOCK:
            closes = _CLOSES.get(tag, ("p",))
            stops = ("ul", "ol", "dl", "table", "menu") if closes != ("p",) else ("td", "th", "article", "section", "main", "div", "li")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes or stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in stops:
                    break
            end_block()
        if tag in ("br", "wbr", "img", "hr"):
            if tag == "br" and not stack[-1][2]:
                pieces.append(" ")
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page) if tag in TO_THE_END else at
            continue
        style, noise, words, hidden = _named(tag, attributes) if attributes else ("", False, frozenset(), False)
        _, path, dropped, main = stack[-1]
        main = main or tag in ("article", "main") or "main" in words and "role" in attributes.lower()
        dropped = dropped or hidden or tag in DROPPED or noise and tag != "body" and tag != "html" or not main and (tag == "header" or bool(words & OUTER_NOISE))
        stack.append((tag, xxhash.xxh64_intdigest(f"{path}/{tag}.{style}") if tag in BLOCK else path, dropped, main))
    del stack[1:]
    end_block()
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _content(b: Block) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{b.path}:{b.text}"))


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, node, below, content: of each page the contents of each node outside articles, once, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, node, below, content = [], [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for parent, path, key in {(_signed(b.parent), _signed(b.path), _content(b)) for b in blocks(page) if not b.main}:
                    host.append(h)
                    node.append(path)
                    below.append(parent)
                    content.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (node, below, content))],
                                             names=["host", "node", "below", "content"])

    return pages.select("host", "html").mapInArrow(run, "host string, node long, below long, content long")


def unimportant(pages: DataFrame) -> DataFrame:
    """host and content of the branches of low importance. Aggregates only: a host's pages are never together in a task."""
    each = checkpoint(style_nodes(pages).groupBy("host", "node", "below", "content").agg(F.count("*").alias("n")))  # pages are parsed once for it
    shown = pages.groupBy("host").agg(F.count("*").alias("pages"))
    nodes = each.groupBy("host", "node").agg(F.sum("n").alias("m"))
    below = each.groupBy("host", "below", "node").agg(F.sum("n").alias("k"))
    total = below.groupBy("host", "below").agg(F.sum("k").alias("t"), F.count("*").alias("kinds"))
    entropy = (below.join(total, ["host", "below"]).groupBy("host", "below")
               .agg((-F.sum(F.col("k") / F.col("t") * F.log(F.col("k") / F.col("t"))) / F.log(F.greatest(F.max("kinds"), F.lit(2)))).alias("presentation")))
    mixed = each.join(nodes, ["host", "node"]).join(entropy, ["host", "below"]).join(shown, "host").where(F.col("pages") >= PAGES)
    content = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double"))
    return mixed.where(CONTENT * content + (1 - CONTENT) * F.col("presentation") < LEAST).select("host", "content").distinct()


def _article(left: list[Block]) -> list[Block]:
    """The blocks of article and main elements if they hold enough of the text, else all."""
    main = [b for b in left if b.main]
    return main if sum(len(b.text) for b in main) >= MAIN_SHARE * sum(len(b.text) for b in left) and main else left


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; null html is empty, a null or odd url is a host of its own.

    Outside article and main elements the style tree removes what is unimportant. If these elements then hold at least
    ``MAIN_SHARE`` of a page's text, they are its text; otherwise all that is left is. Extra columns are not looked at; equal pages are treated alike.
    """
    hosted = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    low = checkpoint(unimportant(hosted))
    per_host = low.groupBy("host").agg(F.collect_list("content").alias("low"))  # contents that stand on many pages each
    small = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = hosted.join(F.broadcast(per_host) if small else per_host, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, low in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                gone = frozenset(np.asarray(low.values).tolist()) if low.is_valid else frozenset()
                texts.append("\n\n".join(b.text for b in _article([b for b in blocks(page) if b.main or _content(b) not in gone])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return both.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
