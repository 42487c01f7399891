r"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text (a block ends where a block-level element starts or ends).  A
linear classifier over a block's place and shape (enclosing block-level elements, class and id names,
link density, length, punctuation) gives what it costs to call it boilerplate or content: these are its
capacities to the source and the sink.  Blocks that follow each other, and blocks with a near common
ancestor, are tied by smoothness edges.  The minimum cut (max-flow) labels all blocks of the page at
once; the content blocks' text is the result.  The classifier's weights are fitted (``pagemodel.fit``).

What is never of an article, wherever it stands, has a certain terminal: elements of OUTSIDE, forms, adverts, readers'
comments, hidden parts.  Links don't count against a block that more of the article follows: a list of links between its
paragraphs is its own, one behind them all is a menu.

Inline elements never decide for their block: text in an inline element that is an advert, a share
button or hidden is a node of its own in the graph, tied to its block.

A class or id name speaks for boilerplate only if all of its words do or are words of layout:
``cookie-notice``, ``share-box`` and ``commentlist`` do, ``copyright-law`` doesn't.  Words of adverts and comments speak whatever is
beside them (``google-ad``, ``blog-comments``), but for names about them (``has-comments``).  Within an article an id, which can
be a heading's anchor, must be one of the plain ones (FIRM).

White space inside a block becomes one space; blocks are trimmed and joined in page order by one
space; character references are decoded; ``<br>`` is white space.

Defined results: null or blank html gives an empty text; text outside any element is a block of its
own; unclosed or stray tags end where HTML's implied end tags would end them; on a page where no block is labelled content
the text is that of all blocks that nothing speaks against (a bare paragraph is an article); ties of the cut go to boilerplate; pages are read whole, in time that grows
with their length; repeated rows get equal results; an empty table gives an empty table; further
columns aren't looked at.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re

from pyspark.sql import DataFrame

from .common import map_rows

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset(("script", "style", "title", "textarea", "noframes", "xmp"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
#: An element that starts ends an open one of these, within the nearest listed container.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements whose text is not of the article.
OUTSIDE = frozenset("nav footer aside noscript template dialog iframe svg head select button object canvas audio video datalist map".split())
#: Words of class and id names (split at case changes and at all but letters) that speak for boilerplate.
NEGATIVE = frozenset("ad ads adv advert adverts advertisement advertisements advertising advertorial adbox adsense adsbygoogle adslot sponsor sponsors sponsored sponsorship promo promos promoted promotion promotions banner banners cookie cookies consent gdpr ccpa notice notices alert alerts popup popups modal overlay newsletter newsletters subscribe subscription signup social share shares sharing sidebar sidebars side widget widgets menu menus submenu nav navbar navigation navigator breadcrumb breadcrumbs toolbar footer header masthead topbar login search pagination pager skip hidden legal disclaimer copyright teaser teasers outbrain taboola comment comments reply replies respond disqus responses discussion reactions feedback related recommended recommendation recommendations".split())
#: Those of sections that hold other articles or readers' texts.
FOREIGN = frozenset("comment comments reply replies respond disqus responses discussion reactions feedback related recommended recommendation recommendations".split())
#: Words that name a place or a container and say nothing by themselves.
LAYOUT = frozenset("all and also area bar bars block blocks body bottom box boxes button buttons buttons by card cards center code col column container content count entry form global group head holder icon icons id img image in info inner item items js label language layer left like link links list lists main me media message meta middle more most mobile module new news of on our outer page pages panel policy popular post posts primary read region right row section secondary settings single site slot slots small stories story sticky strip tab tabs text the this thread title to toggle tools top unit up us user users view warning web website wide wrap wrapper you your zone".split())
#: A name with one of these words tells adverts or readers' comments whatever its other words are, but for those that only speak about them.
FIRST = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox adsense adsbygoogle adslot comment comments commenter commenters disqus".split())
ABOUT = frozenset("no non not has have with without count counter number open closed enabled disabled allowed allow off hide free blocker".split())
#: Of the NEGATIVE words those that also count as an id within an article.
FIRM = frozenset("ad ads adv advert advertisement adsense adbox adslot sponsored promo cookie cookies consent newsletter subscribe signup social share sharing sidebar footer widget widgets nav navbar breadcrumbs login comment comments reply replies respond disqus related recommended outbrain taboola".split())
#: What inline elements can be besides text of their block.
INLINE_BAD = frozenset("ad ads adv advert advertisement adbox adslot sponsored promo promoted share shares sharing social hidden skip popup".split())
POSITIVE = frozenset("article content main post entry story text body prose".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: The classifier's weights, over features() in this order; found by pagemodel.fit().
WEIGHTS = {"bias": -0.82, "article": 3.74, "outside": -6.64, "negative": -6.21, "positive": 5.55, "header": -2.81, "form": -3.26, "h1": 1.09, "heading": 0.99, "p": -0.57, "item": 0.16, "links": -4.98, "length": 1.16, "sentence": -0.21}
ADJACENT, SIBLING, COUSIN = 0.5, 0.4, 0.15
#: Capacity that no ties outweigh.
CERTAIN = 1e6


class Block:
    """Text of a block and where it stands: flags of its enclosing block-level elements, parent and grandparent.

    parts: (raw text, is it in an inline element that is no text of the block); leads: whether plain text of the same article follows.
    """

    __slots__ = ("grand", "leads", "linked", "parent", "parts", "state", "tag", "text")

    def __init__(self, tag: str, state: tuple, parent: int, grand: int):
        self.tag, self.state, self.parent, self.grand, self.parts, self.linked, self.text, self.leads = tag, state, parent, grand, [], 0, "", False


@functools.lru_cache(1 << 16)
def _parts(word: str) -> tuple[str, ...]:
    """A word, or the two that it is run together from, one of NEGATIVE and one of LAYOUT (``commentlist``)."""
    if word not in NEGATIVE and word not in LAYOUT:
        for i in range(2, len(word) - 1):
            a, b = word[:i], word[i:]
            if a in NEGATIVE and b in LAYOUT or a in LAYOUT and b in NEGATIVE:
                return a, b
    return (word,)


def _names(value: str) -> list[frozenset[str]]:
    """The words of each name of a class or id attribute; digits and single letters aren't words."""
    return [frozenset(p for w in _WORDS.findall(name) if len(w) > 1 for p in _parts(w.lower())) for name in value.split()]


def _speaks(names: list[frozenset[str]], words: frozenset[str]) -> bool:
    """Whether a name has one of the words and beside NEGATIVE ones only words of layout."""
    return any(not n.isdisjoint(words) and all(w in NEGATIVE or w in LAYOUT for w in n) for n in names)


def _tells(names: list[frozenset[str]]) -> bool:
    """Whether a class name has a word of FIRST and none of ABOUT."""
    return any(not n.isdisjoint(FIRST) and n.isdisjoint(ABOUT) for n in names)


def _attributes(attrs: str) -> dict[str, str]:
    low = attrs.lower()
    if not any(k in low for k in ("class", "id", "role", "hid", "none")):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


def _unseen(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))


def _state(before: tuple, tag: str, attrs: str) -> tuple:
    """(article, outside, negative, positive, header, form) inside a block-level element."""
    article, outside, negative, positive, header, form = before
    found = _attributes(attrs) if attrs else {}
    classes, ids, role = _names(found.get("class", "")), _names(found.get("id", "")), found.get("role", "").lower()
    if article and tag in _HEADINGS:
        ids = []  # anchors
    whole = tag in ("html", "body")
    if found and _unseen(found) or not whole and (_tells(classes) or _speaks(classes, FOREIGN) or _speaks(ids, FOREIGN & FIRM if article else FOREIGN)):
        outside = True
    bad = _speaks(classes, NEGATIVE) or _speaks(ids, FIRM if article else NEGATIVE) or role in _ROLES
    if tag in ("article", "main") and not bad:
        # a page's wrappers say little about its article, but comments hold articles too
        return (True, outside, negative and article, positive, False, False)
    if tag in OUTSIDE:
        outside = True
    elif tag == "header":
        header = True
    elif tag in ("form", "fieldset"):
        form = True
    return (article or role == "main", outside, negative or bad and not whole, positive or any(not n.isdisjoint(POSITIVE) for n in classes + ids), header, form)


def _aside(tag: str, attrs: str) -> bool:
    """Whether an inline element is no text of its block."""
    if tag in OUTSIDE:
        return True
    found = _attributes(attrs) if attrs else {}
    return bool(found) and (_unseen(found) or _speaks(_names(found.get("class", "")), INLINE_BAD))


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in page order."""
    found: list[Block] = []
    # name, number, state, whether text is put aside; where each name is open; links open at each depth
    stack: list[tuple[str, int, tuple, bool]] = [("", 0, (False,) * 6, False)]
    opened: dict[str, list[int]] = {}
    flow = [0]  # depths of the open elements that aren't inline
    now: Block | None = None
    ids = at = 0

    def put(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw.strip():
                return
            depth = len(flow) - 1
            up = lambda k: stack[flow[max(0, depth - k)]]
            now = Block(up(0)[0], up(0)[2], up(1)[1], up(2)[1])
            found.append(now)
        text, aside = _html.unescape(raw) if "&" in raw else raw, stack[-1][3]
        now.parts.append((text, aside))
        if not aside and opened.get("a"):
            now.linked += len(text)

    def close(name: str, within: tuple[str, ...]) -> None:
        i = opened[name][-1] if opened.get(name) else 0
        if i and all(not opened.get(w) or opened[w][-1] < i for w in within):
            while len(stack) > i:
                opened[stack.pop()[0]].pop()
                if flow[-1] == len(stack):
                    flow.pop()

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                put(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, ending, attrs = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if name == "br":
            put(" ")
            continue
        if name not in INLINE:
            now = None
        if ending:
            close(name, ("table",) if name not in ("table", "div", "body", "html", "article", "main", "section") else ())
            continue
        if name in ENDS_P:
            close("p", ("button", "table", "td", "li", "article", "section", "div"))
        if name in IMPLIED:
            one, within = IMPLIED[name]
            close(name, within)
            if one != name:
                close(one, within)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            continue
        ids += 1
        _, _, state, aside = stack[-1]
        opened.setdefault(name, []).append(len(stack))
        if name in INLINE:
            stack.append((name, ids, state, aside or _aside(name, attrs)))
        else:
            flow.append(len(stack))
            within = (*state[:2], True, *state[3:]) if aside else state
            stack.append((name, ids, _state(within, name, attrs), False))
    found = [b for b in found if any(t.strip() for t, _ in b.parts)]
    running = False
    for b in reversed(found):
        b.leads = running and b.state[0]
        plain = not any(b.state[1:]) and 2 * b.linked < sum(len(t) for t, _ in b.parts)
        running = b.state[0] and (running or plain)
    return found


def nodes(found: list[Block]) -> list[tuple[int, bool, str]]:
    """(block, put aside, text) of the graph's nodes: a block's own text, and what inline elements put aside."""
    out = []
    for i, b in enumerate(found):
        for aside in sorted({a for _, a in b.parts}):
            text = " ".join("".join(t for t, a in b.parts if a == aside).split())
            if text:
                out.append((i, aside, text))
    return out


def features(b: Block, aside: bool, text: str) -> dict[str, float]:
    article, outside, negative, positive, header, form = b.state
    n = len(text)
    return {
        "bias": 1,
        "article": article,
        "outside": outside or aside,
        "negative": negative,
        "positive": positive,
        "header": header and b.tag != "h1" or (header and not article),
        "form": form,
        "h1": b.tag == "h1",
        "heading": b.tag in ("h2", "h3", "h4", "h5", "h6"),
        "p": b.tag in ("p", "blockquote", "pre"),
        "item": b.tag in ("li", "td", "th", "dt"),
        "links": 0 if b.leads and not (outside or aside or negative or form) else min(1.0, b.linked / n),
        "length": min(3.0, math.log1p(n / 40)),
        "sentence": text[-1] in ".!?:;\"'”»…" or n > 120,
    }


def score(b: Block, aside: bool, text: str) -> float:
    """Log-odds that a node is content; what the contract leaves out wherever it stands (OUTSIDE, forms, adverts, comments) is certain."""
    if aside or b.state[1] or b.state[5]:
        return -CERTAIN
    return sum(WEIGHTS[k] * v for k, v in features(b, aside, text).items())


def edges(found: list[Block], made: list[tuple[int, bool, str]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and to the last block with the same parent or grandparent.

    Blocks of different states aren't tied; what is put aside is tied to its block only.
    """
    out, last, before = [], {}, None
    for k, (i, aside, _) in enumerate(made):
        b = found[i]
        if aside:
            if k and made[k - 1][0] == i:
                out.append((k - 1, k, ADJACENT))
            continue
        if before is not None and found[made[before][0]].state == b.state:
            out.append((before, k, ADJACENT))
        before = k
        for key, weight in ((("p", b.parent), SIBLING), (("g", b.grand), COUSIN)):
            j = last.get(key)
            if j is not None and found[made[j][0]].state == b.state:
                out.append((j, k, weight))
            last[key] = k
    return out


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's (content's) side of a minimum cut; ties go to the sink's.

    What a node could send straight from source to sink is sent first.  A node with more capacity to
    one terminal than all its ties have is on that side whatever its neighbours are: it is settled, its
    ties become terminal capacities of its neighbours, and so on.  What is left goes through max-flow.
    """
    excess = [max(-CERTAIN, min(CERTAIN, s)) for s in scores]  # softplus(s) - softplus(-s) is s
    near: list[list[tuple[int, float]]] = [[] for _ in scores]
    for a, b, w in ties:
        near[a].append((b, w))
        near[b].append((a, w))
    tied = [sum(w for _, w in n) for n in near]
    side: list[bool | None] = [None] * len(scores)
    todo = [v for v in range(len(scores)) if abs(excess[v]) > tied[v]]
    while todo:
        v = todo.pop()
        if side[v] is not None:
            continue
        side[v] = excess[v] > 0
        for u, w in near[v]:
            if side[u] is None:
                excess[u] += w if side[v] else -w
                tied[u] -= w
                if abs(excess[u]) > tied[u] + 1e-9:
                    todo.append(u)
    left = [v for v, s in enumerate(side) if s is None]
    if left:
        for v, s in zip(left, _max_flow(left, excess, [t for t in ties if side[t[0]] is None and side[t[1]] is None]), strict=True):
            side[v] = s
    return side


def _max_flow(left: list[int], supply: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm over the nodes of left: levels from all nodes with excess, then blocking flows."""
    number, excess, tiny = {v: i for i, v in enumerate(left)}, [supply[v] for v in left], 1e-9
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in left]
    for a, b, w in ties:
        out[number[a]].append(len(to))
        out[number[b]].append(len(to) + 1)
        to += [number[b], number[a]]
        room += [w, w]
    while True:
        sources = [v for v, e in enumerate(excess) if e > tiny]
        level, reached, ring = dict.fromkeys(sources, 0), False, sources
        while ring and not reached:
            beyond = []
            for v in ring:
                for e in out[v]:
                    if room[e] > tiny and to[e] not in level:
                        level[to[e]] = level[v] + 1
                        reached |= excess[to[e]] < -tiny
                        beyond.append(to[e])
            ring = beyond
        if not reached:
            return [v in level for v in range(len(left))]
        following = {}
        for start in sources:
            path, v = [], start
            while excess[start] > tiny:
                if excess[v] < -tiny:
                    sent = min(excess[start], -excess[v], *(room[e] for e in path))
                    for e in path:
                        room[e] -= sent
                        room[e ^ 1] += sent
                    excess[start] -= sent
                    excess[v] += sent
                    path, v = [], start
                    continue
                k = following.get(v, 0)
                while k < len(out[v]) and not (room[out[v][k]] > tiny and level.get(to[out[v][k]], -1) == level[v] + 1):
                    k += 1
                following[v] = k
                if k < len(out[v]):
                    path.append(out[v][k])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    following[v] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    made = nodes(found)
    kept = {(i, aside) for (i, aside, _), k in zip(made, min_cut([score(found[i], aside, text) for i, aside, text in made], edges(found, made)), strict=True) if k}
    if not kept:  # no block stands out: the article is what nothing speaks against
        kept = {(i, aside) for i, aside, text in made if not (aside or any(found[i].state[1:3]) or found[i].state[5]) and (not found[i].state[4] or found[i].tag == "h1") and 2 * found[i].linked <= len(text)}
    texts = (" ".join("".join(t for t, a in b.parts if (i, a) in kept).split()) for i, b in enumerate(found))
    return " ".join(t for t in texts if t)


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row per input row: the columns of keep, text and n_chars (code points)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars bigint"

    def rows(batch: list[dict]) -> list[dict]:
        return [{c: r[c] for c in keep} | {"text": (t := main_text(r[page])), "n_chars": len(t)} for r in batch]

    return map_rows(df.select(*dict.fromkeys((*keep, page))), rows, schema)
