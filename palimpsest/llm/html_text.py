"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Paragraphs pass points for length and commas to the
elements above them, less the further up; an element's points are discounted by its link density.
The best container is kept (the whole article, if it is in one), with the siblings that score well
or are paragraphs and headings themselves. Menus, page headers and footers, sidebars, notices,
adverts, forms, scripts and reader comments are taken out by element, by link density, by a
comment section's heading, and by class where nothing in the name speaks for text. A name that may
belong to an article too takes nothing out that holds the page's title or most of its text, and no
name empties a page; a heading such as `Comments` needs bylines or repeated items behind it.

Reading a page takes time in proportion to its length, however broken it is: elements know the range
of those below them, so what is in what is asked without climbing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches

#: A tag without attribute values: the frequent case. Possessive, so a failure costs no more than what it has passed.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"'=]*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"[>=]")
_ATTR = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)")

# Element names. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li dd dt td th blockquote figcaption caption summary address".split())
DROPPED = frozenset("head nav footer aside form button select noscript template svg menu dialog object video audio canvas fieldset search".split())
#: Elements that no class or id takes out.
SPARED = frozenset("html body main".split())
#: Elements that hold an article's own header.
OF_TEXT = frozenset("article main section".split())
#: Elements that have one end, that of another of their kind, and what they end beside it: places in the row that each open element keeps.
ITEMS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
NO_ITEMS = (-1,) * 6
#: Elements in which open items of the outside are not looked for.
BOUNDS = frozenset("ul ol dl table div select menu section article main aside td th".split())
# Parts of a class, an id or a role. A name marks what is not the article if it has one of OUT and no part
# beside these and PLAIN ones; with one of VETO it marks a page's layout. Fixed values.
OUT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr "
    "comment comments commentlist disqus respond reply replies opinion opinions reaction reactions talkback guestbook thread threads discussion kommentar kommentare commentaire commentaires comentario comentarios "
    "share sharing social newsletter subscribe subscription signup login popup popover modal overlay breadcrumb breadcrumbs pagination pager tagcloud navigation contentinfo complementary "
    "searchbox searchform notice notices notification notifications alert alerts paywall skyscraper feedback nav navbar menu menus masthead footer foot sidebar sidebars related recommended "
    "recommendations toolbar aside".split()
)
HEAD = frozenset("header".split())
PLAIN = frozenset(
    "site page top bottom left right main primary secondary tertiary box bar list lists block wrap wrapper container section area widget widgets button buttons link links icon icons inner outer "
    "item items post posts article articles content entry story sticky fixed mobile desktop global user users reader readers visitor email message panel module form body text title head "
    "header region group row column col unit slot zone placement google gpt dfp leaderboard inline small large medium show hide open closed active js wp id the of and on in to for info tools meta".split()
)
#: Of OUT, names that articles bear as well.
SOFT = frozenset(
    "sponsor sponsored sponsors promo promos promotion banner reply opinion opinions reaction reactions newsletter subscription notice notices notification notifications alert alerts "
    "feedback related recommended recommendations thread threads discussion".split()
)
VETO = frozenset("has with without no layout".split())
TEXTS = frozenset("article entry post story content text body title".split())
#: A heading that alone says that readers' comments follow, and one that may.
COMMENTS_HEADING = re.compile(
    r"(?:\d+|one|no) (?:(?:reader|readers|user|visitor|latest|all|recent|post) )?(?:comments?|opinions|responses?|replies|reactions|thoughts?|kommentare?|commentaires?|comentarios?)(?: (?:to|on|so far)\b.*)?"
    r"|(?:(?:reader|readers|user|visitor|latest|all|recent|post) )?(?:comments?|opinions|responses?|replies|reactions|kommentare?|commentaires?|comentarios?) ?(?:\(\d+\)|: ?\d+)"
    r"|(?:readers?|user|visitor|latest|recent) (?:comments?|opinions|responses|reactions)|(?:leave|post|add|write) an? (?:reply|comment)|join the (?:discussion|conversation)|what do you think\?",
    re.I,
)
MAYBE_COMMENTS = re.compile(r"(?:(?:all|post) )?(?:comments?|opinions|responses|replies|reactions|discussion|kommentare?|commentaires?|comentarios?) ?:?", re.I)
#: What stands beside a comment: who wrote, when, and a way to answer.
BYLINE = re.compile(r".{0,60}\b(?:says|said|wrote|writes|schrieb|a écrit|dijo|escribió)\b ?:?|.*\b(?:ago|reply|antworten|répondre|responder)\b ?[·.|]?|.{0,60}\d{1,2}[:.h]\d{2}.{0,20}|.{0,40}\b\d{4}-\d{2}-\d{2}\b.{0,20}|.{0,40}\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b.{0,20}", re.I)
#: A heading over links that lead away from an article.
MORE_HEADING = re.compile(r"(?:you (?:may|might)|related|recommended|popular|trending|latest|most read|read (?:more|next|also)|more\b|share|follow|tags?\b|topics|categories|filed|archives|navigation|menu|previous|next|mehr|weitere|lire aussi|à lire|más|relacionad).*", re.I)
#: A section of comments that shows no byline has shorter blocks than this on average.
SHORT_COMMENT = 120

#: Blocks of fewer characters give no points. Levels above a paragraph that get points.
LEAST_CHARS, LEVELS = 25, 6
#: Lists of links: the share of linked characters from which on they are one, and links at least.
MENU_DENSITY, MENU_LINKS = 0.75, 3


class Node:
    """A block element; inline ones belong to the block around them. index and end: its range in the order of the page."""

    __slots__ = ("blocks", "end", "first", "h1", "index", "kept", "links", "marks", "n_links", "named", "out", "own_links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, index: int, named: int) -> None:
        self.tag, self.parent, self.index, self.end, self.named = tag, parent, index, index + 1, named
        self.points, self.size, self.links, self.n_links, self.own_links, self.blocks, self.h1, self.marks = 0.0, 0, 0, 0, 0, 0, 0, 0
        self.out = self.kept = False
        self.first = -1  # the first block of text in it

    def holds(self, other: Node) -> bool:
        return self.index <= other.index < self.end


def named_out(name: str, within_text: bool = False) -> int:
    """Whether a class, id or role marks what is not the article: 0 no, 1 by a name that articles bear too, 2 yes."""
    parts = {x.lower() for x in _PARTS.findall(name)}
    found = parts & OUT
    if not found:
        return 2 * (not within_text and bool(parts & HEAD) and not parts & (TEXTS | VETO) and parts <= HEAD | PLAIN)
    if parts & VETO or not all(x in OUT or x in PLAIN or x.isdigit() or len(x) < 3 for x in parts):
        return 0
    return 1 if found <= SOFT else 2


def unwanted(tag: str, attrs: str, within_text: bool) -> tuple[bool, int]:
    """Whether an element goes whatever it holds, and what its names say."""
    if tag in DROPPED or tag == "header" and not within_text:
        return True, 0
    if not attrs or tag in SPARED:
        return False, 0
    held = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower() or "hidden" in attrs and _HIDDEN.search(_ATTR.sub(" ", attrs)):
        return True, 0
    return False, max((named_out(name, within_text) for key in ("class", "id", "role") for name in held.get(key, "").split()), default=0)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind `text`, `start` or `end`. Comments, declarations and raw elements are left out.

    Every step goes forward, and what is searched for in vain is not searched for again.
    """
    at, n = 0, len(html)
    missing: set[str] = set()  # quotes that stand nowhere behind

    def end_of_tag(at: int) -> int:
        """Place of the > that ends the tag, quoted values left out; -1: none."""
        while (m := _STOP.search(html, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = m.end()
            while at < n and html[at].isspace():
                at += 1
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote not in missing:
                close = html.find(quote, at + 1)
                if close < 0:
                    missing.add(quote)  # no value: the tag ends at the next >
                else:
                    at = close + 1
        return -1

    while at < n:
        less = html.find("<", at)
        if less < 0:
            yield "text", html[at:], ""
            return
        if less > at:
            yield "text", html[at:less], ""
        at = less
        sign = html[at + 1 : at + 2]
        if (m := _PLAIN.match(html, at)) is not None:
            end, name, attrs, at = m[1], m[2].lower(), m[3], m.end()
        elif sign.isascii() and sign.isalpha() or sign == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
            end = "/" if sign == "/" else ""
            m = _NAME.match(html, at + 1 + len(end))
            close = end_of_tag(m.end())
            if close < 0:
                return  # a tag that never ends: nothing more
            name, attrs, at = m[0].lower(), html[m.end() : close], close + 1
        elif sign in ("!", "?") or sign == "/":
            mark = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            close = html.find(mark, at + 2)
            if close < 0:
                return
            at = close + len(mark)
            continue
        else:
            yield "text", "<", ""
            at += 1
            continue
        if end:
            yield "end", name, ""
            continue
        yield "start", name, attrs
        if name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if m is None:
                return
            at = m.start()


def blocks_of(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Block elements, parents first; blocks of text in page order: element, text, characters within links.

    What goes by its element, or as a named part within a line, has no text here.
    """
    root = Node("html", None, 0, 0)
    nodes, out = [root], []
    # Open elements: name, block, whether it is out, open items around it.
    stack: list[tuple[str, Node, bool, tuple[int, ...]]] = [("html", root, False, NO_ITEMS)]
    open_: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(x for x, _ in held).split())
            if text:
                out.append((stack[-1][1], text, sum(len(" ".join(x.split())) for x, linked in held if linked)))
            held.clear()

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            if stack[-1][0] in BLOCKS:
                flush()
            open_[stack.pop()[0]] -= 1

    for kind, name, attrs in tokens(html):
        if kind == "text":
            if not stack[-1][2]:
                held.append((unescape(name), open_["a"] > 0))
        elif kind == "end":
            if open_[name]:
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                close(at)
            elif name == "p" or name == "br":
                flush() if name == "p" else held.append((" ", False))
        elif name == "br":
            if not stack[-1][2]:
                held.append((" ", False))
        else:
            block = name in BLOCKS
            items = stack[-1][3]
            if block and items[0] >= 0:  # a block ends an open paragraph
                close(items[0])
                items = stack[-1][3]
            if name in ITEMS and name != "p" and items[ITEMS[name]] >= 0:
                close(items[ITEMS[name]])
                items = stack[-1][3]
            if block:
                flush()
            if name in VOID or attrs.endswith("/") and not block and name != "a":
                continue
            node, was_out = stack[-1][1], stack[-1][2]
            if name == "a":
                node.own_links += not was_out
            gone, named = unwanted(name, attrs, open_["article"] + open_["main"] + open_["section"] > 0)
            gone |= was_out or named > 0 and not block
            if block:
                node.blocks += 1
                node = Node(name, node, len(nodes), named)
                nodes.append(node)
            if name in BOUNDS:
                items = NO_ITEMS
            elif block and name != "p":
                items = (-1, *items[1:])
            if name in ITEMS:
                k = ITEMS[name]
                items = (*items[:k], len(stack), *items[k + 1 :])
            stack.append((name, node, gone, items))
            open_[name] += 1
    flush()
    return nodes, out


def top_of(node: Node, tag: str) -> Node | None:
    """The highest element of that name that the node is in."""
    found = None
    while node is not None:
        found = node if node.tag == tag else found
        node = node.parent
    return found


def without_named(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks that no name takes out, all if none were left; nodes get their ranges, sizes and what is out.

    A name that articles bear too takes nothing out that holds the page's only title, or, on a page
    that marks no article and has no title elsewhere, most of the text.
    """
    for node, text, _ in blocks:
        node.size += len(text)
    for n in nodes:
        n.h1, n.marks = int(n.tag == "h1" and n.size > 0), 0
    for n in reversed(nodes):  # children first
        n.marks += (n.tag in ("h1", "article", "main")) and n.size > 0 and not n.named
        if (p := n.parent) is not None:
            p.size, p.h1, p.marks, p.end = p.size + n.size, p.h1 + n.h1, p.marks + n.marks, max(p.end, n.end)
    root, marked = nodes[0], set()  # marked: what stands within an article
    for n in nodes:  # parents first
        p = n.parent
        if p is not None and (p.index in marked or p.tag in ("article", "main")):
            marked.add(n.index)
        spared = n.named == 1 and (n.h1 and n.h1 == root.h1 or root.marks == n.marks and 2 * n.size >= root.size and n.index not in marked)
        n.out = p is not None and p.out or n.named > 0 and not spared
    left = [b for b in blocks if not b[0].out]
    if not left:
        left = blocks
        for n in nodes:
            n.out = False
    for n in nodes:
        n.size, n.n_links = 0, 0 if n.out else n.own_links
    return left


def of_comments(blocks: list[tuple[Node, str, int]], at: int, top: Node) -> int:
    """Where the section that the heading at a place begins ends, if it holds readers' comments; else the heading's own place."""
    heading, text, _ = blocks[at]
    stop = at + 1
    while stop < len(blocks) and top.holds(blocks[stop][0]) and not (blocks[stop][0].tag in HEADINGS and blocks[stop][0].tag <= heading.tag):
        stop += 1
    if COMMENTS_HEADING.fullmatch(text):
        return stop
    section = blocks[at + 1 : stop]
    if not section:
        return at
    if any(BYLINE.fullmatch(x[:200]) for _, x, _ in section):
        return stop
    # Items of one kind, each with parts of its own; or short remarks that end the text.
    items = Counter(n.parent for n, _, _ in section if n.parent is not None and n.parent is not top and n.parent.parent is top)
    last = stop == len(blocks) or not top.holds(blocks[stop][0])
    if len(items) > 1 and len({n.tag for n in items}) == 1 and max(items.values()) > 1:
        return stop
    return stop if last and sum(len(x) for _, x, _ in section) < SHORT_COMMENT * len(section) else at


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty if there is none."""
    nodes, every = blocks_of(html or "")
    if not every:
        return ""
    blocks = without_named(nodes, every)
    for at, (node, text, linked) in enumerate(blocks):
        node.size += len(text)
        node.links += linked
        if node.first < 0:
            node.first = at
        if len(text) < LEAST_CHARS:
            continue
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        # A block without blocks in it is a paragraph, whatever its name.
        n = node.parent if node.parent is not None and (node.tag in PARAGRAPHS or not node.blocks) else node
        for level in range(LEVELS):
            if n is None:
                break
            n.points += points if level == 0 else points / (2 if level == 1 else 3 * level)
            n = n.parent
    for node in reversed(nodes):  # children first
        if (p := node.parent) is not None:
            p.size += node.size
            p.links += node.links
            p.n_links += node.n_links
            if node.first >= 0 and (p.first < 0 or node.first < p.first):
                p.first = node.first
    score = lambda n: n.points * (1 - n.links / max(1, n.size))
    best = max(nodes, key=score)  # the first of equals
    if not score(best):
        # Nothing but short blocks: what the page marks as its article, or all that is left.
        best = next((n for tag in ("article", "main", "body") for n in nodes if n.tag == tag and n.size), nodes[0])
    whole = top_of(best, "article") or top_of(best, "main")  # an article is whole
    best = whole or best
    best.kept = True
    for n in nodes if whole is None and best.parent is not None else ():
        if n.parent is best.parent and n is not best and not n.out and n.size:
            density = n.links / n.size
            if score(n) >= max(10, 0.2 * score(best)) or n.tag in PARAGRAPHS and n.tag != "li" and density < 0.25:
                n.kept = True
    gone: set[int] = set()
    for n in nodes:  # parents first
        if n.parent is not None:
            if n.parent.index in gone or n is not best and n.n_links >= MENU_LINKS and n.tag not in ("p", "li") and n.links >= MENU_DENSITY * n.size and not introduced(blocks, n, whole):
                gone.add(n.index)
            n.kept |= n.parent.kept
    left = [b for b in blocks if b[0].kept and b[0].index not in gone]
    out: list[str] = []
    at = 0
    while at < len(left):
        node, text, _ = left[at]
        if out and node.tag in HEADINGS and (COMMENTS_HEADING.fullmatch(text) or MAYBE_COMMENTS.fullmatch(text)) and (stop := of_comments(left, at, node.parent)) > at:
            at = stop
            continue
        out.append(text)
        at += 1
    return "\n".join(out)


def introduced(blocks: list[tuple[Node, str, int]], n: Node, whole: Node | None) -> bool:
    """Whether links in an article are a list of its own, such as its sources: a heading or a line with a colon beside it says what they are."""
    if whole is None or not whole.holds(n) or n.first < 1:
        return False
    before, text, _ = blocks[n.first - 1]
    if before.parent is not n.parent:
        return False
    return (before.tag in HEADINGS or text.endswith(":")) and not MORE_HEADING.fullmatch(text)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text (empty if there is none) and n_chars (its code points); columns of these
    names are replaced.

    Null and empty html have an empty text. Broken markup is read as far as it goes: open
    elements end with the page, stray ends are passed over, a tag without an end ends the page.
    Pages are read where they are, one at a time, without a shuffle; repeated rows are read each.
    """
    kept = small_batches(pages).drop("text", "n_chars")

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    # So declared, it is not run once more for every use of its result.
    out = kept.withColumn("text", F.pandas_udf(texts, "string").asNondeterministic()(F.coalesce(html_col, F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))
