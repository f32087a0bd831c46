"""Cutting HTML into the leaf blocks of its DOM, each with its ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics object noscript canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page: code, drawings, other pages and what a form holds.
RAW = "script|style|template|svg|iframe|textarea|select"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: An attribute and its value; all are read, so that values and longer names aren't taken for names.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")
_NAMED = frozenset("class id role aria-label style".split())
#: Elements that a start tag ends when they are open: li ends li, and so on.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote figure".split())


@dataclass(eq=False, slots=True)
class Node:
    """An open element that isn't inline. Blocks share the chain of their ancestors, so a page takes memory in proportion to its length."""

    tag: str
    #: Words of its class, id and role attributes.
    names: tuple[str, ...]
    parent: Node | None
    hidden: bool
    #: For what a reader derives from the chain.
    state: object = None


@dataclass
class Block:
    text: str
    node: Node | None
    link_chars: int = 0

    @property
    def chain(self) -> list[Node]:
        """Ancestors from the root."""
        out, node = [], self.node
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(n.tag for n in self.chain)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(x for n in self.chain for x in n.names)

    @property
    def hidden(self) -> bool:
        return self.node is not None and self.node.hidden


@dataclass(slots=True)
class _Open:
    tag: str
    node: Node | None
    hidden: bool = False


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    names: list[str] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(raw):
        key = (m[1] or "").lower()
        if key == "hidden":
            hidden = True
            continue
        if key not in _NAMED:
            continue
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            names += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(names), hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: runs of text between starts and ends of block elements. Hidden inline elements give no text."""
    out: list[Block] = []
    stack: list[_Open] = []
    nodes: list[Node] = []
    how_many: Counter[str] = Counter()
    parts: list[str] = []
    linked = veiled = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, nodes[-1] if nodes else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if not veiled:
            parts.append(piece)
            if how_many["a"]:
                linked += len(piece.strip())

    def close(at: int) -> None:
        nonlocal veiled
        if any(o.node is not None for o in stack[at:]):
            flush()
        for o in stack[at:]:
            how_many[o.tag] -= 1
            veiled -= o.hidden
            if o.node is not None:
                nodes.pop()
        del stack[at:]

    def last(names: frozenset[str] | set[str], stop: frozenset[str] = frozenset()) -> int:
        if not any(how_many[t] for t in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in stop:
                return -1
        return -1

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            text(page[end : m.start()])
        end = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and parts:
                parts.append(" ")
            continue
        if m[2]:
            if (k := last({tag}, _SCOPE - {tag} if tag in INLINE or tag == "p" else frozenset())) >= 0:
                close(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a" and (k := last({"a"}, _SCOPE)) >= 0:
                close(k)
        else:
            flush()
            if (k := last(_ENDS.get(tag, set()) | {"p"}, _SCOPE - _ENDS.get(tag, set()))) >= 0:
                close(k)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            names, hidden = _attributes(m[4]) if m[4].strip() else ((), False)
            how_many[tag] += 1
            if tag in INLINE:
                stack.append(_Open(tag, None, hidden))
                veiled += hidden
            else:
                parent = nodes[-1] if nodes else None
                nodes.append(Node(tag, names, parent, hidden or parent is not None and parent.hidden))
                stack.append(_Open(tag, nodes[-1]))
    if end < len(page):
        text(page[end:])
    flush()
    return out
