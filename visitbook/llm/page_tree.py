"""Pages as trees of blocks: a forgiving reading of HTML, for pages of any size and any faults."""

from __future__ import annotations

import html
import re

# HTML's elements by how they are read.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
# Not shown, or controls; what they hold is no text of the page.
UNSEEN = frozenset("audio button canvas datalist head map object option select svg template video".split())
# Their contents are not markup.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
# An element that another of its kind ends, unless the second is inside one of these.
ENDED_BY_NEXT = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
    "th": ("tr", "table"), "option": ("select", "datalist"),
}
PAIRED = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)(?:>|\Z)""",
    re.DOTALL | re.VERBOSE,
)
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none", re.IGNORECASE)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """Nodes in page order: the root, elements that make blocks, and texts (tag `#text`).

    parents, tags, names (words of class, id, role and itemprop), texts (None for elements),
    links (share of a text's characters inside links), attributes as written.
    """

    def __init__(self, source: str):
        self.parents, self.tags = [-1], ["#root"]
        self.names: list[list[str]] = [[]]
        self.texts: list[str | None] = [None]
        self.links, self.attributes = [0.0], [""]
        self._open = [0]  # nodes from the root to the current one
        self._count: dict[str, int] = {}
        self._unseen: list[int] = []  # depths at which unseen elements opened
        self._run: list[str] = []
        self._linked, self._link_depth = 0, -1
        self._read(source)
        self._flush()

    def _add(self, tag: str, names: list[str], text: str | None, link: float, attributes: str) -> int:
        self.parents.append(self._open[-1])
        self.tags.append(tag)
        self.names.append(names)
        self.texts.append(text)
        self.links.append(link)
        self.attributes.append(attributes)
        return len(self.tags) - 1

    def _flush(self) -> None:
        """The run of text since the last block boundary becomes a node."""
        text = " ".join("".join(self._run).split()) if self._run else ""
        if text:
            self._add("#text", [], text, min(1.0, self._linked / len(text)), "")
        self._run, self._linked = [], 0

    def _push(self, tag: str, attributes: str) -> None:
        self._flush()
        words = [w.lower() for value in NAMES.findall(attributes) for w in WORD.findall(value)] if attributes else []
        self._open.append(self._add(tag, words, None, 0.0, attributes))
        self._count[tag] = self._count.get(tag, 0) + 1
        if tag in UNSEEN or (attributes and HIDDEN.search(attributes)):
            self._unseen.append(len(self._open))

    def _pop(self) -> str:
        self._flush()
        if self._unseen and self._unseen[-1] == len(self._open):
            self._unseen.pop()
        tag = self.tags[self._open.pop()]
        self._count[tag] -= 1
        if self._link_depth > len(self._open):
            self._link_depth = -1
        return tag

    def _pop_to(self, tag: str) -> None:
        while self._count.get(tag, 0) and self._pop() != tag:
            pass

    def _text(self, text: str) -> None:
        if self._unseen or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        self._run.append(text)
        if self._link_depth >= 0:
            self._linked += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if self._count.get("head", 0) and tag not in IN_HEAD and tag != "head":
            self._pop_to("head")
        if tag == "br":
            self._text(" ")
        elif tag == "hr":
            self._pop_to("p")
            self._flush()
        elif tag == "a":
            self._link_depth = len(self._open)
        elif tag in BLOCK or tag in UNSEEN:
            if tag in BLOCK:
                self._pop_to("p")
            around = ENDED_BY_NEXT.get(tag)
            if around:
                self._end_previous(tag, around)
            if tag not in ("html", "body", "head") or not self._count.get(tag, 0):
                self._push(tag, attributes)

    def _end_previous(self, tag: str, around: tuple[str, ...]) -> None:
        """Close an open element of the same kind that lies directly in the same list or table."""
        same = (tag, PAIRED.get(tag, tag))
        if not any(self._count.get(t, 0) for t in same):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            open_tag = self.tags[self._open[depth]]
            if open_tag in around:
                return
            if open_tag in same:
                while len(self._open) > depth:
                    self._pop()
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link_depth = -1
        elif tag in ("html", "body"):
            self._flush()
        elif tag in BLOCK or tag in UNSEEN:
            self._pop_to(tag)

    def _read(self, source: str) -> None:
        at = 0
        while found := TAG.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            if not found["name"]:
                continue
            tag = found["name"].lower()
            if found["end"]:
                self._end(tag)
            elif tag in RAW:
                close = RAW_ENDS[tag].search(source, at)
                at = close.start() if close else len(source)
            else:
                self._start(tag, found["rest"])
        self._text(source[at:])
