"""The main text of web pages by tree scoring.

A page is read as a tree of blocks whose texts are runs between block boundaries. Every run of some length gives
points for its length and its commas to the block that holds it, and less to each block around that. A block's
score is discounted by the share of its text that is in links. The best block is the article; siblings that
score well, and plain paragraphs and headings beside it, are kept with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content isn't markup, and those without an end tag.
_RAW = "script|style|noscript|template|iframe|textarea|xmp|noembed|noframes|title"
_REPLACED = frozenset("svg object canvas audio video".split())
_TOKEN = re.compile(
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))"
    rf"|<(?i:({_RAW}))(?=[\s/>])((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>(?s:.*?)(?:</(?i:\1)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound frame".split())
#: Elements that end a run of text; all others are part of it.
_BLOCKS = frozenset("html head body article section main div p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset legend figure figcaption address details summary dialog center menu dir hgroup search select option optgroup button hr".split())
_DROPPED = frozenset("head nav footer aside form dialog menu dir search select button fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: What a block's names tell: always something else; something else unless a name also tells content; content.
_OTHER = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion comment comments commentlist disqus respond replies reply cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations outbrain taboola skip login".split())
_MAYBE = frozenset("sidebar aside menu nav navbar navigation menubar toolbar header masthead footer notice notices notification alert widget widgets tags rail teaser sitemap copyright".split())
_CONTENT = frozenset("article content main body entry post story text page".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote li dd td th dt figcaption caption h1 h2 h3 h4 h5 h6 legend summary".split())
_START = {"div": 5, "article": 10, "main": 5, "pre": 3, "blockquote": 3, "td": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5} | dict.fromkeys(_HEADINGS, -5)
#: An open element of the first kind ends where one of the second kind begins, unless one of the third lies between.
_ENDS = {"li": (("li",), frozenset("ul ol menu dir".split())), "dt": (("dt", "dd"), frozenset(["dl"])), "dd": (("dt", "dd"), frozenset(["dl"])), "tr": (("tr",), frozenset(["table"])), "td": (("td", "th"), frozenset(["tr", "table"])), "th": (("td", "th"), frozenset(["tr", "table"])), "option": (("option",), frozenset(["select"]))}
_KEEPS_P = frozenset("option optgroup select button".split())
#: A name with one of these tells of a state, not of what a block is. Blocks that an end tag of another kind doesn't reach through.
_STATES = frozenset("no has with without not is open closed category tag type format status".split())
_SCOPES, _TABLE = frozenset("td th caption table".split()), frozenset("table thead tbody tfoot tr td th caption".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Least length of a run that gives points, and how many blocks around it share them.
LEAST, REACH = 25, 5


class _Block:
    """An element that ends runs of text."""

    __slots__ = ("tag", "parent", "role", "runs", "children", "points", "length", "linked", "links")

    def __init__(self, tag: str, parent: _Block | None, role: int):
        self.tag, self.parent, self.role = tag, parent, role
        #: Texts and blocks in page order.
        self.runs: list[str | _Block] = []
        self.children: list[_Block] = []
        self.points, self.length, self.linked, self.links = 0.0, 0, 0, 0

    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0

    def score(self) -> float:
        return (self.points + _START.get(self.tag, 0)) * (1 - self.density())


def _role(tag: str, attributes: str) -> int:
    """0 plain, 1 something else by its names, 2 something else by its element or role, 3 hidden."""
    role = 2 if tag in _DROPPED else 0
    if not attributes or attributes.isspace():
        return role
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 3
    if found.get("role", "").lower() in _ROLES:
        return 2
    if role or tag in ("body", "html"):
        return role
    names = unescape(found.get("class", "") + " " + found.get("id", "")).split()
    parts = [p for n in names if not (p := {w.lower() for w in _WORDS.findall(n)}) & _STATES]
    if tag in ("article", "main"):
        return int(any(p & {"comment", "comments"} for p in parts))
    other = any(p & _OTHER for p in parts) or (any(p & _MAYBE for p in parts) and not any(p and p <= _CONTENT for p in parts))
    return int(other)


def _tree(html: str) -> _Block:
    """The blocks of a page with their runs; scripts, comments and the like are gone."""
    root = _Block("html", None, 0)
    top, stack, open_ = root, [root], {"html": 1}
    #: Depth of the stack where the open link, and each open hidden element, began.
    link, hidden = 0, []
    pieces, linked, count = [], 0, 0

    def ended() -> None:
        nonlocal pieces, linked, count
        if pieces:
            text = " ".join(unescape("".join(pieces)).split()) if len(pieces) > 1 or pieces[0].strip() else ""
            if text:
                top.runs.append(text)
                top.length += len(text)
                top.linked += min(linked, len(text))
                top.links += count
            pieces, linked, count = [], 0, 0

    def pop(at: int) -> None:
        nonlocal top, link
        ended()
        for b in stack[at:]:
            open_[b.tag] -= 1
        del stack[at:]
        top = stack[-1]
        link = 0 if link > at else link
        while hidden and hidden[-1][1] > at:
            hidden.pop()

    def close(tags: tuple[str, ...], until: frozenset[str]) -> None:
        if any(open_.get(t) for t in tags):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in tags:
                    return pop(at)
                if stack[at].tag in until:
                    return None
        return None

    last = 0
    for m in _TOKEN.finditer(html):
        if m.start() > last and not hidden:
            pieces.append(html[last : m.start()])
            if link:
                linked += m.start() - last
        last = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3]:
            if tag in _BLOCKS:
                if open_.get(tag) and tag != "html":
                    close((tag,), frozenset() if tag in _TABLE else _SCOPES)
                elif tag == "p":
                    ended()
            elif tag == "a":
                link = 0
            elif hidden and hidden[-1][0] == tag:
                hidden.pop()
        elif tag in _BLOCKS:
            ended()
            if tag == "html" or tag == "hr":
                continue
            if tag not in _KEEPS_P and open_.get("p"):
                close(("p",), frozenset(["button", "table", "td", "th", "caption"]))
            if tag in _ENDS:
                close(*_ENDS[tag])
            if tag in _HEADINGS and top.tag in _HEADINGS:
                pop(len(stack) - 1)
            if tag == "body":
                close(("head",), frozenset())
            role = _role(tag, m[5])
            if tag == "header" and not role:
                role = 2
            block = _Block(tag, top, role)
            if tag == "article" and open_.get("article"):
                block.role = max(block.role, 2)  # an article in an article is a reader's comment
            top.runs.append(block)
            top.children.append(block)
            stack.append(block)
            open_[tag] = open_.get(tag, 0) + 1
            top = block
        elif tag == "br":
            pieces.append(" ")
        elif tag not in _VOID and not m[5].rstrip().endswith("/"):
            if tag == "a" and "href" in m[5].lower():
                link, count = len(stack), count + 1
            if tag in _REPLACED or (hidden and tag == hidden[-1][0]) or (not hidden and m[5] and _role(tag, m[5])):
                hidden.append((tag, len(stack)))
    if len(html) > last and not hidden:
        pieces.append(html[last:])
        if link:
            linked += len(html) - last
    pop(1)
    return root


def _pruned(root: _Block, dropped: frozenset[int]) -> list[_Block]:
    """The blocks that are left without those of the given roles; headings of an article's own header stay."""
    left, queue = [], [(root, False, False)]
    while queue:
        b, inside, header = queue.pop()
        inside |= b.tag == "article"
        if b.role in dropped and not (b.tag == "header" and b.role == 2 and inside):
            b.role = -1
            continue
        header = (header or b.tag == "header" and 2 in dropped) and b.tag not in _HEADINGS
        if header:
            b.runs = [x for x in b.runs if isinstance(x, _Block)]
            b.length = b.linked = b.links = 0
        left.append(b)
        queue += [(c, inside, header) for c in reversed(b.children)]
    return left


def _scored(blocks: list[_Block]) -> None:
    """Points of the runs to the blocks around them, and sums of lengths and links."""
    for b in blocks:
        for text in b.runs:
            if isinstance(text, str) and len(text) >= LEAST:
                points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
                around, share = b.parent if b.tag in _PARAGRAPHS and b.parent else b, 1.0
                for level in range(REACH):
                    if around is None:
                        break
                    around.points += points * share
                    around, share = around.parent, 1 / (level + 2)
    for b in reversed(blocks):
        if b.parent is not None:
            b.parent.length += b.length
            b.parent.linked += b.linked
            b.parent.links += b.links


def _menu(b: _Block) -> bool:
    """Whether a list or group of blocks inside the article is nearly all links."""
    return b.tag in ("ul", "ol", "div", "section", "table", "dl") and b.links > 1 and b.density() > 0.8


def _texts(b: _Block) -> list[str]:
    """The runs of a block in page order."""
    out: list[str] = []
    queue: list[str | _Block] = [b]
    while queue:
        x = queue.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.role != -1 and (x is b or not _menu(x)):
            queue += reversed(x.runs)
    return out


def _kept_beside(best: _Block) -> list[_Block]:
    """The best block among its siblings that belong to it."""
    if best.parent is None or best.tag in ("article", "body", "html"):
        return [best]
    least = max(10.0, 0.2 * best.score())

    def belongs(b: _Block) -> bool:
        if b is best:
            return True
        if b.role == -1 or not b.length or _menu(b):
            return False
        return b.score() >= least or (b.tag in _PARAGRAPHS and b.density() < 0.33)

    return [b for b in best.parent.children if belongs(b)]


def main_text(html: str) -> str:
    """The main text of one page, its blocks joined by one space; '' without any."""
    for dropped in (frozenset((1, 2, 3)), frozenset((2, 3)), frozenset((3,))):
        root = _tree(html)
        blocks = _pruned(root, dropped)
        _scored(blocks)
        # Of equal scores the outer block, which comes first, wins.
        best = max((b for b in blocks if b.points > 0), key=_Block.score, default=None)
        if best is None:
            best = next((b for tag in ("article", "main") for b in blocks if b.tag == tag and b.length), root)
        around: _Block | None = best
        while around is not None and around.tag != "article":
            around = around.parent
        chosen = [around] if around is not None else _kept_beside(best)
        text = " ".join(t for b in chosen for t in _texts(b))
        if text:
            return text
    return ""


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points).

    White space (every character that Unicode counts as such, references to it too) inside a block becomes one space, and so does a line
    break; blocks are joined by one space. Null html is empty, and a page without text has ''. Ids and urls may
    be null or repeat; each row is read for itself and there are no ties. Very long pages are read whole; an
    empty table gives no rows; other columns, whatever their names, are not looked at.

    What counts as something other than the article: elements for menus, page headers, footers, asides, forms
    and buttons, hidden ones, and blocks whose class or id names adverts, comments, notices and the like. Only
    where nothing is left without them are they looked at after all. An article inside an article is a comment.
    The header of an article leaves its headings. Lists and groups that are nearly all links are menus.
    """
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), pages[html_col].alias("__html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    out = rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
