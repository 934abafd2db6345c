"""A page as a sequence of leaf blocks: runs of text that no block-level tag interrupts, with the tags around them."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

#: Tags that do not break a block (fixed values: HTML's phrasing content, and MathML's elements).
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
#: Tags whose content is never text of the page (fixed values); those of the second line stand inside a block.
HIDDEN = set("head title option".split())
HIDDEN_INLINE = set("script style noscript template svg iframe object canvas audio video select textarea button annotation annotation-xml".split())
HIDDEN |= HIDDEN_INLINE
INLINE |= HIDDEN_INLINE
#: Tags without an end tag (fixed values: HTML's void elements).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag of the key closes when one of the values begins (fixed values, from HTML's optional end tags).
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Tags that may stand in a head; any other ends it (fixed values: HTML's metadata content).
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: Tags that end a hidden element whose own end tag is missing (fixed values: HTML's flow content that breaks a block).
FLOW = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
TOKEN = re.compile(r"[a-z]+")


#: Tags that shape text inside the container that it belongs to (fixed values); table cells may be containers of a layout.
SHAPES = set("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption ul ol menu li dl dt dd".split())
CELLS = set("table caption colgroup thead tbody tfoot tr td th".split())
#: A tag of training pages that carries a mark and is otherwise not there.
TRANSPARENT = "x-marked"
#: What hides an element besides its tag.
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Element:
    """An element and, through its parent, all around it. What blocks ask of their surroundings is kept here once, so that
    a block deep in a page costs no more than one near its root."""

    __slots__ = ("tag", "names", "mark", "parent", "hidden", "linked", "own", "around", "home", "outer")

    def __init__(self, tag: str, names: tuple[str, ...], mark: str | None, parent: Element | None, hidden: bool):
        self.tag, self.names, self.parent, self.hidden = tag, names, parent, hidden
        self.mark = mark if mark is not None or parent is None else parent.mark
        self.linked = tag == "a" or (parent is not None and parent.linked)
        #: The nearest tag that breaks a block; the tags and names around a block, as features.
        around, new = parent.around if parent else frozenset(), {f"in {tag}", *(f"name {x}" for x in names)}
        if tag == TRANSPARENT and parent is not None:
            self.own, self.around, self.home, self.outer = parent.own, around, parent.home, parent.outer
            return
        self.own = tag if tag not in INLINE or parent is None else parent.own
        self.around = around if new <= around else around | new
        #: The nearest container of its text, with table cells as containers and without.
        self.home = parent.home if parent is not None and (tag in SHAPES or tag in INLINE) else self
        self.outer = parent.outer if parent is not None and (tag in SHAPES or tag in INLINE or tag in CELLS) else self


class Block:
    """text: white space already as one space. inside: its innermost element, None for text outside of all."""

    __slots__ = ("text", "inside", "linked")

    def __init__(self, text: str, inside: Element | None, linked: int):
        self.text, self.inside, self.linked = text, inside, linked

    @property
    def mark(self) -> str | None:
        return self.inside.mark if self.inside else None


class Blocks(HTMLParser):
    """Collects leaf blocks. `mark_by` names an attribute whose innermost value a block carries as its label.

    `unclosed` receives the numbers (in page order) of start tags of hidden elements whose own end tag is missing. A second
    pass that is given them as `endless` ends these elements where a tag of FLOW starts; others hide all up to their end tag.
    """

    def __init__(self, mark_by: str | None = None, endless: set[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.mark_by, self.stack, self.parts, self.linked, self.found, self.hidden = mark_by, [], [], 0, [], 0
        self.endless, self.unclosed, self.numbers, self.n_hidden = endless, set(), [], 0
        self.open: Counter[str] = Counter()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append(Block(text, self.stack[-1] if self.stack else None, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, to: int, ended: bool = False) -> None:
        """Leave the elements from place `to` on; `ended` if the first of them has its end tag here."""
        n = sum(e.hidden for e in self.stack[to:])
        for e in self.stack[to:]:
            self.open[e.tag] -= 1
        if n:
            if not (ended and self.stack[to].hidden):
                self.unclosed.update(self.numbers[-n:])
            self.hidden -= n
            del self.numbers[-n:]
        del self.stack[to:]

    def end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.pop(len(self.stack) - 1, ended=True)

    def end_endless(self) -> None:
        """End the outermost endless element, unless an element that has its end tag stands inside it."""
        inner = 0
        while inner < len(self.numbers) and self.numbers[-1 - inner] in self.endless:
            inner += 1
        if inner:
            self.pop([i for i, e in enumerate(self.stack) if e.hidden][-inner])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            if tag in FLOW and self.hidden:
                self.end_endless()
            self.end_head()
        if tag == "br" and not self.hidden:
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE and not self.hidden:
                self.flush()
            return
        if tag not in INLINE:
            if not self.hidden:
                self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                e = self.stack[i]
                if e.tag == "p" or tag in CLOSED_BY.get(e.tag, ()):
                    self.pop(i)
                    break
                if e.tag not in INLINE or e.hidden:
                    break
            while self.stack and self.stack[-1].tag in INLINE and self.stack[-1].tag != "a" and not self.stack[-1].hidden:
                self.pop(len(self.stack) - 1)  # left open before a block: it ends with the block it stood in
        named = dict(attrs)
        names = tuple(TOKEN.findall(f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}".lower()))
        hidden = tag in HIDDEN or "hidden" in named or bool(NOT_SHOWN.search(named.get("style") or ""))
        self.stack.append(Element(tag, names, named.get(self.mark_by) if self.mark_by else None, self.stack[-1] if self.stack else None, hidden))
        self.open[tag] += 1
        if hidden:
            self.numbers.append(self.n_hidden)
            self.hidden += 1
            self.n_hidden += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and not self.hidden:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.pop(i, ended=True)
                return
            if tag in INLINE and tag not in HIDDEN and self.stack[i].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden and data.strip():
            self.end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.stack and self.stack[-1].linked:
                self.linked += len(data)


def leaf_blocks(html: str | None, mark_by: str | None = None) -> list[Block]:
    endless: set[int] = set()
    for _ in range(2):
        parser = Blocks(mark_by, endless)
        parser.feed(html or "")
        parser.close()
        parser.flush()
        parser.pop(0)
        if not parser.unclosed:
            break
        endless = parser.unclosed
    return parser.found
