"""A small forgiving HTML tree: tags, signatures and text, enough to align pages and read blocks."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*+\Z")
#: Elements nested deeper become children of the one at this depth, as browsers do; no text is lost.
DEEPEST = 200
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag ends, and the tags that it doesn't look past.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_FAR = frozenset("table td th article section main body html div aside nav header footer form blockquote li dd".split())


class Node:
    """marks: class, id and role in page order; names: class and role alone."""

    __slots__ = ("tag", "marks", "names", "children")

    def __init__(self, tag: str, marks: str = "", names: str = ""):
        self.tag, self.marks, self.names, self.children = tag, marks, names, []

    @property
    def signature(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def _marks(attributes: str) -> tuple[str, str]:
    if "=" not in attributes:
        return "", ""
    found = [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attributes)]
    return tuple(re.sub(r"\d+", "", " ".join(some)).strip().lower() for some in ([v for _, v in found], [v for name, v in found if name != "id"]))


def parse(page: str) -> Node:
    """The tree of a page; text is kept as it stands, with its character references."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(_UNFINISHED.sub("", page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in _FAR:
                    break
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _FAR:
                    break
        if tag in _ENDS:
            ended, past = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    if tag != "tr" or not any(n.tag in ended for n in stack):
                        break
                elif stack[i].tag in past:
                    break
        node = Node(tag, *_marks(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def clean(text: str) -> str:
    """Character references decoded, white space turned into single spaces, trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())
