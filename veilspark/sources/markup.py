"""One pass over the tags of a page: elements with what they enclose and what encloses them.

The tags of a page are read once, in order, with a stack of the open ones; an element's
inner text is the run of text pieces between its start and its end. So a button keeps the
text of what is nested in it, a select looks at its own options only, and a field knows the
label around it, whatever else is open or never closed.

* An end tag closes everything that is still open inside its element; one without a start
  is ignored, and so are tags that only format text.
* A new option, list item, paragraph, cell or row ends the one before it; a link, button or
  select cannot hold another of its kind, so the earlier one ends.
* What is never closed ends with what encloses it, at the latest with the page.
* Comments, scripts and styles are skipped; the content of a textarea or title is text.
"""

from __future__ import annotations

import html.entities
import re
from collections import defaultdict

VOID = frozenset("area base br col embed hr img input link meta param source track wbr canvas".split())
FORMATTING = frozenset("b big code em font i mark nobr s small strike strong sub sup tt u".split())
ENDS_SIBLING = frozenset("option optgroup li p td th tr dt dd".split())
NOT_NESTED = frozenset("a button select".split())
RAW_TEXT = frozenset("textarea title".split())
CONTROL_ROLES = frozenset("button checkbox combobox".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:script|style)(?=[\s/>])(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>.*?(?:</(?:script|style)\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][\w:-]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+|[^>]*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_REFERENCE = re.compile(r"&(?:#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _referred(m: re.Match) -> str:
    number, name = m.groups()
    if name:
        return html.entities.html5.get(name + ";", m[0])
    code = int(number[1:], 16) if number[0] in "xX" else int(number)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def unescaped(text: str) -> str:
    """Text with named and numeric character references replaced."""
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def flat(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts, one without a value has ''."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescaped(m[2] or m[3] or m[4] or ""))
    return found


class _Node:
    __slots__ = ("name", "attrs", "begin", "text", "label", "chosen", "first")

    def __init__(self, name, attrs, begin):
        self.name, self.attrs, self.begin, self.text = name, attrs, begin, None
        self.label = self.chosen = self.first = None


def _wanted(name: str, attrs: dict[str, str]) -> bool:
    """Elements an agent can see or use: controls, links, images, labels, and ARIA controls."""
    return (
        name in ("input", "img", "canvas", "select", "textarea", "button", "label") or (name == "a" and "href" in attrs)
        or attrs.get("role", "").lower() in CONTROL_ROLES or attrs.get("contenteditable", "").lower() == "true"
    )


class _Page:
    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.open: list[_Node] = []
        self.named: defaultdict[str, list[_Node]] = defaultdict(list)  # the open ones of each name
        self.rows: list[_Node] = []
        self._read(source)
        while self.open:
            self._pop()

    def _pop(self) -> None:
        node = self.open.pop()
        self.named[node.name].pop()
        if node.text is None and (node.name == "option" or _wanted(node.name, node.attrs)):
            node.text = "".join(self.pieces[node.begin:])

    def _close(self, name: str) -> None:
        if self.named[name]:
            while self.open[-1].name != name:
                self._pop()
            self._pop()

    def _start(self, name: str, attrs: dict[str, str]) -> _Node:
        if name in NOT_NESTED:
            self._close(name)
        elif name in ENDS_SIBLING and self.open and self.open[-1].name == name:
            self._pop()
        node = _Node(name, attrs, len(self.pieces))
        if self.named["label"]:
            node.label = self.named["label"][-1]
        if name == "option" and self.named["select"]:
            owner = self.named["select"][-1]
            owner.first = owner.first or node
            if owner.chosen is None and "selected" in attrs:
                owner.chosen = node
        if _wanted(name, attrs):
            self.rows.append(node)
        return node

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1  # no tag ends beyond it
        if not last:
            last = len(source) if "<!--" in source else 0
        while m := _TAG.search(source, at, max(last, at)):
            if m.start() > at:
                self.pieces.append(unescaped(source[at: m.start()]))
            at, (slash, name, rest) = m.end(), m.groups()
            if name is None or name.lower() in FORMATTING:
                if name is None:
                    self.pieces.append(" ")
                continue
            name = name.lower()
            if slash:
                self._close(name)
                continue
            node = self._start(name, attributes(rest))
            if name in RAW_TEXT:
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                stop = end.start() if end else len(source)
                node.text = unescaped(source[at:stop])
                at = end.end() if end else stop
            elif name not in VOID:
                self.open.append(node)
                self.named[name].append(node)
        if at < len(source):
            self.pieces.append(unescaped(source[at:]))


def _labels(rows: list[_Node]) -> list[tuple[str | None, str | None]]:
    """(text of the first label associated with it, text of the label around it) of each row."""
    owner: dict[str, _Node] = {}
    for node in rows:
        if "id" in node.attrs:
            owner.setdefault(node.attrs["id"], node)
    first: dict[int, _Node] = {}
    for label in rows:  # in document order
        if label.name == "label" and label.attrs.get("for") in owner:
            first.setdefault(id(owner[label.attrs["for"]]), label)
    place = {id(node): i for i, node in enumerate(rows)}
    out = []
    for node in rows:
        candidates = [x for x in (first.get(id(node)), node.label if node.label and "for" not in node.label.attrs else None) if x]
        own = min(candidates, key=lambda x: place[id(x)], default=None)
        out.append((flat(own.text) if own else None, flat(node.label.text) if node.label else None))
    return out


def _value(node: _Node) -> str | None:
    kind = node.attrs.get("type", "").lower()
    if node.name == "input":
        return None if kind == "file" else node.attrs.get("value", "")
    if node.name == "textarea":
        return node.text
    option = (node.chosen or node.first) if node.name == "select" else None
    return None if option is None else option.attrs["value"] if "value" in option.attrs else flat(option.text)


def elements(source: str) -> list[dict]:
    """The elements of a page in document order: tag, attrs, inner (text), value, associated and enclosing label."""
    rows = _Page(source).rows
    return [
        {"tag": node.name, "attrs": node.attrs, "inner": flat(node.text or ""), "value": _value(node), "associated": a, "enclosing": e}
        for node, (a, e) in zip(rows, _labels(rows), strict=True)
    ]
