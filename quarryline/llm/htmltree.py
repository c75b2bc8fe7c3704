"""Pages as trees of blocks: a tolerant parser, and the numbers that a block's features are made of.

A node is a block element, or an inline element that is hidden or whose names (class, id, role) hint at something else than
main text; other inline elements are part of the node around them. The text of a page is a list of segments in page order, each of one node.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\b(?:class|id|role|aria|hidden|style|itemprop)\b", re.I)

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
SKIPPED = frozenset("svg math template object select button canvas audio video datalist applet".split())
CELLS = frozenset("table caption td th".split())
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl menu dir".split())
BLOCKS = (
    frozenset("html body p div article section main nav header footer aside form fieldset legend blockquote pre figure figcaption address center".split())
    | frozenset("li dd dt details summary dialog hgroup search frameset noframes hr".split())
    | TABLE | HEADINGS | LISTS
)
ENDS_P = BLOCKS - TABLE - {"html", "body", "li", "dd", "dt", "legend", "figcaption"} | {"table", "li", "dd", "dt"}
#: What an element's start ends, and where the search for it ends.
ENDS = {
    "li": (frozenset(["li"]), LISTS), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}

#: Groups of elements, each a feature.
GROUPS = (
    "p", "heading", "article main", "section", "div center", "list", "li dd dt", "table thead tbody tfoot tr caption colgroup", "td th", "nav search", "header hgroup",
    "footer address", "aside dialog", "form fieldset legend label", "blockquote pre figure figcaption details summary", "inline", "html body",
)
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()} | {t: 1 for t in HEADINGS} | {t: 5 for t in LISTS}
INLINE = GROUPS.index("inline")

# Words in names (class, id, role) by what they hint at; a word that ends in * also starts longer ones.
HINTS = {
    "nav": "nav* menu* breadcrumb* pager pagination toc topbar tabs skip navbox catlinks menue menú navegacion",
    "header": "header* masthead banner* logo branding kopf* entete cabecera topnav",
    "footer": "footer* foot bottom copyright legal colophon contentinfo fuss* pied pie imprint impressum",
    "side": "side* aside rail left right widget* col2 complementary seitenleiste barre lateral",
    "ad": "ad ads adv advert* adsense adslot adunit sponsor* promo* banner* outbrain taboola dfp gpt werbung anzeige publicite pub publicidad anuncio* commercial",
    "notice": "notice* cookie* consent gdpr alert* warning popup modal overlay paywall toast disclaimer message hinweis* aviso* avis privacy",
    "comment": "comment* reply replies respond discuss* disqus discourse reader kommentar* commentaire* comentario* responses feedback reviews",
    "social": "share* sharing social follow* facebook twitter like likes addthis",
    "related": "related* recommend* more readmore popular trending similar latest next prev teaser* recent archive* tag tags tagcloud mehr suggest*",
    "form": "form* search* login signin signup subscribe newsletter register email contact suche buscar recherche",
    "hidden": "hidden hide invisible sr screen visuallyhidden offscreen none print",
    "article": "article* post entry story blog artikel articulo hentry articlebody",
    "content": "content* main text body page inhalt contenido contenu prose copy richtext mainbody read",
}
HINT_NAMES = tuple(HINTS)
_WHOLE = [frozenset(w for w in v.split() if w[-1] != "*") | frozenset(w[:-1] for w in v.split() if w[-1] == "*") for v in HINTS.values()]
_STARTS = [tuple(w[:-1] for w in v.split() if w[-1] == "*" and len(w) > 4) for v in HINTS.values()]
HIDDEN = 1 << HINT_NAMES.index("hidden")
FOR = sum(1 << HINT_NAMES.index(n) for n in ("article", "content"))
AGAINST = (1 << len(HINT_NAMES)) - 1 - FOR
_NAME_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
# Words that notices and page ends hold.
SAYS = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|advertisement|sponsored|subscribe|newsletter|sign up|log in|privacy policy|terms of", re.I)


@lru_cache(1 << 14)
def hints(attributes: str) -> int:
    """A bit for each kind of hint in an element's attributes."""
    out, names = 0, []
    for m in _ATTR.finditer(attributes):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k in ("class", "id", "role", "itemprop", "aria-label"):
            names.append(v)
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            out |= HIDDEN
    for w in {x.lower() for n in names for x in _NAME_PART.findall(n)} | {x for n in names for x in re.split(r"[\s_-]+", n.lower())}:
        for i, (whole, starts) in enumerate(zip(_WHOLE, _STARTS, strict=True)):
            if w in whole or starts and w.startswith(starts):
                out |= 1 << i
    return out


class Tree:
    """A page. For each node: parent, depth, group, hints, words, words in links, stops, form inputs and tell-tale
    phrases of its own text. segments: node, text, and whether a block begins or ends before it."""

    def __init__(self, html: str | None) -> None:
        self.parent, self.depth, self.group, self.hint = [-1], [0], [INLINE + 1], [0]
        self.words, self.linked, self.stops, self.inputs, self.says = [0], [0], [0], [0], [0]
        self.marks: list[int | None] = [None]
        self.segments: list[tuple[int, str, bool]] = []
        self.names = [""]
        if html:
            self._read(html)

    def _node(self, tag: str, attributes: str, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.group.append(GROUP.get(tag, INLINE))
        self.hint.append(hints(attributes) if attributes.strip() else 0)
        for x in (self.words, self.linked, self.stops, self.inputs, self.says):
            x.append(0)
        self.marks.append(None)
        self.names.append(tag)
        return len(self.parent) - 1

    def _text(self, text: str, node: int, link: bool, apart: bool) -> None:
        if "&" in text:
            text = unescape(text)
        n = len(text.split())
        self.segments.append((node, text, apart))
        if n:
            self.words[node] += n
            self.linked[node] += n * link
            self.stops[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!") + text.count("。") + text.count("،")
            self.says[node] += n < 60 and SAYS.search(text) is not None

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements, each with the node that its text belongs to
        opened: dict[str, int] = {}
        endless: set[str] = set()  # elements whose contents would be skipped, but that end nowhere from here on
        links, apart, at, start, end = 0, True, 0, 0, len(html)

        def close(k: int) -> None:
            nonlocal links
            for t, _ in stack[k:]:
                opened[t] -= 1
                links -= t == "a"
            del stack[k:]

        def above(tags: frozenset, until: frozenset) -> int:
            """The place of the last open element of tags, or -1."""
            if any(opened.get(t) for t in tags):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in tags:
                        return k
                    if stack[k][0] in until:
                        return -1
            return -1

        while start < end:
            at = html.find("<", at)
            if at < 0:
                at = end
            nxt = html[at + 1 : at + 2]
            if at < end and not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
                at += 1  # a sign that opens nothing is text
                continue
            if at > start:
                self._text(html[start:at], stack[-1][1] if stack else 0, links > 0, apart)
                apart = False
            if at >= end:
                break
            m = _TAG.match(html, at) if nxt not in ("!", "?") else None
            if m is None:
                if html.startswith("<!--", at):
                    close_at = html.find("-->", at + 2)
                    at = close_at + 3 if close_at >= 0 else end
                else:
                    close_at = html.find(">", at)
                    at = close_at + 1 if close_at >= 0 else end
                start = at
                continue
            at = start = m.end()
            tag, attributes = m[2].lower(), m[3]
            block = tag in BLOCKS
            apart = apart or block or tag == "br"
            if m[1]:
                if opened.get(tag) and tag not in ("html", "body"):
                    k = above(frozenset([tag]), frozenset() if tag in TABLE else CELLS)
                    if k >= 0 and (block or not any(t in BLOCKS for t, _ in stack[k + 1 :])):
                        close(k)
                    elif k >= 0:  # an inline element that ends within a block that began in it
                        opened[tag] -= 1
                        links -= tag == "a"
                        del stack[k]
                continue
            node = stack[-1][1] if stack else 0
            if tag in RAW or tag in SKIPPED:
                pattern = re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I)
                deep, found = 1, None
                ends = tag not in endless and (tag in RAW or not attributes.rstrip().endswith("/"))
                for x in pattern.finditer(html, at) if ends else ():
                    deep += -1 if x[1] else tag in SKIPPED
                    if not deep:
                        found = x.start()
                        break
                if found is None:
                    if ends:
                        endless.add(tag)
                    at = start = end if tag in ("script", "style") else at  # one that is not ended hides the rest
                    continue
                close_at = html.find(">", found)
                at = start = close_at + 1 if close_at >= 0 else end
                apart = apart or tag in ("iframe", "object", "video")
                self.inputs[node] += tag in ("select", "button", "textarea")
                continue
            if tag in VOID:
                self.inputs[node] += tag == "input" and "hidden" not in attributes
                continue
            if tag in ENDS_P and opened.get("p") and (k := above(frozenset(["p"]), CELLS)) >= 0:
                close(k)
            if tag in ENDS and (k := above(*ENDS[tag])) >= 0:
                close(k)
            if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            if tag in ("html", "body") and opened.get(tag):
                continue
            node = stack[-1][1] if stack else 0
            if block or attributes and _NAMED.search(attributes) and hints(attributes) & AGAINST:
                node = self._node(tag, attributes, node)
            if attributes and (mark := re.search(r"\bdata-main=\"(\d)\"", attributes)):
                self.marks[node] = int(mark[1])
            link = tag == "a" and "href" in attributes
            stack.append((tag if link or tag != "a" else "a-name", node))
            opened[stack[-1][0]] = opened.get(stack[-1][0], 0) + 1
            links += link

    def text(self, keep) -> str:
        """The segments of the nodes to keep; a space where a block begins or ends, and for any white space."""
        out: list[str] = []
        space = False
        for node, text, apart in self.segments:
            space = space or apart
            if keep[node]:
                if space:
                    out.append(" ")
                out.append(text)
                space = False
        return " ".join("".join(out).split())
