"""A forgiving HTML tree: elements in page order with parents, attributes and text pieces."""

from __future__ import annotations

import html

import regex

_TOKEN = regex.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes)\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    regex.S | regex.I,
)
_ATTR = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: A start tag of the key closes these open elements on the way up to its scope.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
_SCOPE = frozenset("html body table td th ul ol dl div section article aside main nav header footer form figure blockquote".split())
_NO_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "legend", "summary"}


class Tree:
    """Parallel lists over the elements: tag, parent (-1 for the root), attributes; texts as
    (element, place, text), where ``breaks`` marks places at which a block begins or ends."""

    __slots__ = ("tag", "parent", "attrs", "texts", "breaks")

    def __init__(self, page: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.texts: list[tuple[int, int, str]] = []
        self.breaks: set[int] = set()
        self._parse(page)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1

    def _parse(self, page: str) -> None:
        stack, at, place = [0], 0, 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.texts.append((stack[-1], place, page[at : m.start()]))
            at = m.end()
            if m["raw"]:
                self._open(m["raw"].lower(), m["rawattrs"], stack[-1])
                continue
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if tag in BLOCK:
                place += 1
                self.breaks.add(place)
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            closes = CLOSES.get(tag, ("p",) if tag in _NO_P else ())
            for k in range(len(stack) - 1, 0, -1) if closes else ():
                name = self.tag[stack[k]]
                if name in closes:
                    del stack[k:]
                    if tag != "tbody":
                        break
                elif name in _SCOPE and not (tag in ("tr", "tbody") and name in ("td", "th")):
                    break
            node = self._open(tag, m["attrs"], stack[-1])
            if tag == "br":
                self.texts.append((stack[-1], place, "\n"))
            if tag not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append(node)
        if at < len(page):
            self.texts.append((stack[-1], place, page[at:]))

    def attributes(self, node: int) -> dict[str, str]:
        return {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTR.findall(self.attrs[node])} if self.attrs[node] else {}


def clean(pieces: list[str]) -> str:
    """Character references decoded, white space turned into single spaces, trimmed."""
    return " ".join(html.unescape("".join(pieces)).split())
