"""Main text of web pages by tree scoring.

Every block of text passes points (1, 1 for each comma, up to 3 for length) to its container, half to the next ancestor,
and less to each of ten above. A container's points are discounted by the share of its text that is links. The best container,
and siblings that do well beside it, are kept. Parts that a page marks as something else (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) take no part.

Edge cases: null or empty html gives an empty text; unclosed tags, comments and cut-off ends are closed at the end;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import bounded_batches

# Element names and the words in class, id and role that mark what isn't the article.
RAW = frozenset("script style noscript template textarea select svg iframe object math canvas audio video title".split())
#: Of these, those that run to the page's end where nothing closes them, as their content is no markup, and those that can close
#: themselves. A tag of another that nothing closes is passed over, and what follows it stays.
NO_MARKUP, FOREIGN = frozenset("script style textarea title iframe noscript".split()), frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body main article section div p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "figure figcaption header footer nav aside form fieldset address details summary hr menu dialog center hgroup search".split()
)
DROP = frozenset("head nav footer aside form button menu dialog fieldset search label input".split())
KEEP = frozenset("article content main post entry story body text".split())
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner comment comments commentlist respond "
    "reply replies disqus discussion cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter "
    "subscribe subscription share sharing social sidebar widget widgets related recommended recommendations menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer header masthead toolbar topbar login signup signin search hidden skip "
    "complementary contentinfo dialog form".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd div section article main body h1 h2 h3 h4 h5 h6".split())

#: Blocks whose points go to what holds them, and those that can be menus.
LEAF = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table div section".split())
#: What the container gets of a block's points, then the ancestors above it; higher ones get none.
SHARES = (1.0, 0.5, *(1.0 / (3 * level) for level in range(2, 12)))

PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
CLOSED = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|</{tag}\Z", re.I) for tag in RAW}
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")


def _weight(tag: str, attrs: str, in_article: bool) -> tuple[bool, float]:
    """If the element is to be dropped; else what its names add to its score."""
    if tag in DROP or tag == "header" and not in_article:
        return True, 0.0
    plus = 25.0 if tag in ("article", "main") else 0.0
    if not attrs.strip():
        return False, plus
    names: set[str] = set()
    for m in MARKS.finditer(attrs):
        names.update(WORD.findall((m[2] or m[3] or m[4] or "").lower()))
    good = bool(names & KEEP) or tag in ("article", "main", "body", "html")
    bad = names & NOT_MAIN
    if HIDDEN.search(attrs) and tag not in ("body", "html") or bad and (not good or bad & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sidebar", "menu", "footer"} and tag not in ("main", "body", "html")):
        return True, 0.0
    return False, plus + (25.0 if good and names else 0.0)


def extract_text(page: str | None) -> str:
    """The main text of one page: its blocks in page order, joined by one space."""
    if not page:
        return ""
    # a node: parent, tag, own weight, points, characters, characters in links, links; children follow their parents
    nodes: list[list] = [[-1, "#", 0.0, 0.0, 0, 0, 0]]
    stack: list[int] = [0]
    open_blocks: list[int] = []  # places in the stack
    open_tags: dict[str, list[int]] = {}  # places in the stack by name
    blocks: list[tuple[int, str]] = []
    buffer: list[str] = []
    at, dropped, linked = 0, 0, 0  # dropped: depth in the stack from which all is dropped
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                node = stack[open_blocks[-1]] if open_blocks else 0
                tag = nodes[node][1]
                blocks.append((node, text))
                nodes[node][4] += len(text)
                nodes[node][5] += min(linked, len(text))
                if tag in PARAGRAPH or node == 0:
                    points, own = 1.0 + text.count(",") + min(len(text) / 100, 3.0), nodes[node][0] if tag in LEAF else node
                    if tag == "li" or tag[:1] == "h":
                        points *= 0.25
                    for share in SHARES:
                        if own < 0:
                            break
                        nodes[own][3] += points * share
                        own = nodes[own][0]
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            open_tags[nodes[stack.pop()][1]].pop()
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()
        if dropped and len(stack) < dropped:
            dropped = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at and not dropped:
            text = page[at:end]
            if "&" in text:
                text = entities.unescape(text)
            buffer.append(text)
            if open_tags.get("a"):
                linked += len(text)

    while m := PART.search(page, at):
        text_to(m.start())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in RAW and not (m["end"] or m["end2"]):
            if tag in FOREIGN and (m["attrs"] or m["attrs2"] or "").endswith("/"):
                continue
            closed = None if tag in unclosed else CLOSED[tag].search(page, at)
            if closed:
                at = closed.end()
            else:
                unclosed.add(tag)
                at = len(page) if tag in NO_MARKUP else at
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                flush()
            places = open_tags.get(tag)
            if places and (tag in BLOCK or not open_blocks or places[-1] > open_blocks[-1]):
                pop_to(places[-1])
            continue
        if tag in BLOCK:
            flush()
            closes = {"p"} if tag not in ("li", "td", "th", "tr", "dt", "dd") else {"p", tag} if tag != "tr" else {"p", "td", "th", "tr"}
            if open_blocks and nodes[stack[open_blocks[-1]]][1] in closes:
                pop_to(open_blocks[-1])
        if tag == "br":
            if not dropped:
                buffer.append(" ")
            continue
        if tag in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        drop, weight = (False, 0.0) if dropped else _weight(tag, attrs, bool(open_tags.get("article")))
        nodes.append([stack[-1], tag, weight, 0.0, 0, 0, int(tag == "a" and not dropped)])
        open_tags.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append(len(nodes) - 1)
        if drop and not dropped:
            dropped = len(stack)
            if tag not in BLOCK and buffer:
                buffer.append(" ")
    text_to(len(page))
    flush()
    if not blocks:
        return ""
    for parent, _, _, _, size, inside, links in reversed(nodes[1:]):
        above = nodes[parent]
        above[4] += size
        above[5] += inside
        above[6] += links
    scores = {i: (points + weight) * (1.0 - inside / size) if size else 0.0 for i, (_, _, weight, points, size, inside, _) in enumerate(nodes) if points > 0}
    if not scores:
        return " ".join(t for _, t in blocks)
    best = max(scores, key=lambda i: (scores[i], -i))
    floor = max(10.0, 0.2 * scores[best])
    # for each node: if it or what holds it is kept, and if it is in a menu, from the top down
    kept, menu = [False] * len(nodes), [False] * len(nodes)
    for i, (parent, tag, _, _, size, inside, links) in enumerate(nodes):
        beside = i > 0 and parent == nodes[best][0] and (scores.get(i, 0.0) >= floor or tag in ("p", "h1", "h2") and size > 0 and inside < 0.25 * size)
        kept[i] = i == best or beside or i > 0 and kept[parent]
        menu[i] = i > 0 and (menu[parent] or tag in LISTS and links >= 3 and inside > 0.66 * size)
    return " ".join(text for node, text in blocks if kept[node] and not menu[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    bounded_batches(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            text = [extract_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
