"""Main text of web pages by wrapper induction.

Pages of one host come from a few templates. All pages of each host are parsed and grouped by their structure: the skeletons
of the distinct pages are counted, and by falling count one that is like none before it leads a kind. The tree of every page is
aligned with that of its kind's leading page by simple tree matching (runs of like siblings folded into one repeated node with
all its members). A matched node's text is constant if at least LEAST_SHARE of the kind's distinct pages, and two, have it there; every
other one is a varying slot. A wrapper is the path of the container that the slots choose, with the template's texts:

* The container starts as the whole page and goes down to a child that holds at least MOST of the text of varying
  slots (text of links and of marked parts aside), as long as what varies beside the child is no content: no running
  text such as headings, paragraphs, lists or tables, no part with a varying first-level heading, and no part with
  PART of the text or more.
* The slots beside the container on the aligned pages are outside.
* Paths that fewer than OFTEN of a kind's pages have, or where fewer vary, decide neither; what is there is kept.
* A block (path and text) is template if at least LEAST_SHARE of the distinct pages that a wrapper reads have it, and
  LEAST_PAGES at least. This is counted over all pages, not a sample.

Every page is read through the wrapper of its host whose container it has and whose structure is most like its own:
all blocks in page order but those of outside slots, template texts and parts that tags or class names mark as
adverts, menus, forms or comments; so a block where the aligned pages had none is kept. A page that no wrapper of its
host fits is read by its one article or main element, or whole without marked parts.

Template texts are left out of a page, but for headings: one that recurs in the flow of articles is content, and is left out only
with a part below the container whose texts, running ones among them, are all template. A page whose title (its
first-level headings) and other headings are all template is one of many near copies and is read with its template texts, as these are its content.

No host's pages meet in one task: they are aligned row by row and counted by slot. Only the skeletons of a host, one page for each, stream
past its leaders in one. Leading pages and wrappers are broadcast if they are under BROADCAST bytes together, and joined on the host otherwise.

Defined cases: a null or empty page, or one without text, gives an empty text; a null url is a host of
its own; repeated rows give the same text again; text outside any tag counts as a block; a page that is
cut off is read as far as it goes; a page alone on its host has no wrapper; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.plans.lineage import small

from .cluster import cut, small_batches
from .html_tree import BLOCKS, RAW, Node, clean, parse

BROADCAST, LEAST_PAGES, LEAST_SHARE, OFTEN = 8 << 20, 3, 0.5, 0.1
MOST, PART, LIKE = 0.6, 0.05, 0.5
_SKIPPED = RAW | frozenset("nav footer aside form button select option head svg canvas object audio video dialog menu".split())
#: Names of parts that are not content. A class, role or id counts if it is one of these as a whole, or joined by hyphens from these and _FRAME alone.
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements adbox sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer foot header masthead topbar share sharing social related recommended comment comments commentlist respond replies reply disqus discussion search login skip pagination pager tags toolbar hidden contentinfo complementary".split()
)
_FRAME = frozenset("site global bar box links list posts area".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ANCHORS = frozenset(("article", "main"))
#: Elements that may hold a page's content as a whole; the others of BLOCKS are running text or parts.
_HOLDERS = frozenset("html body div article main section center table tbody tr td fieldset header".split())
_RUNNING = _HEADINGS | frozenset("p ul ol dl pre blockquote table figure details address".split())


def _named(names: str, inside: bool) -> bool:
    """Whether a class, role or id names a part that is not content; an article's own header is content."""
    for name in names.split():
        parts = [p for p in re.split("[-_]+", name) if p]
        if any(p in _BOILERPLATE for p in parts) and all(p in _BOILERPLATE or p in _FRAME for p in parts) and not (inside and parts == ["header"]):
            return True
    return False


def _skipped(node: Node, inside: bool) -> bool:
    if node.tag in _SKIPPED or node.tag == "header" and not inside:
        return True
    if not node.marks or node.tag in _HEADINGS or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return any(re.split("[-_]+", name)[0] in ("comment", "comments") for name in node.marks.split())
    return _named(node.names if node.tag == "section" else node.marks, inside)


def blocks(node: Node, path: tuple[str, ...] = (), inside: bool = False, marks: bool = True, container: tuple[str, ...] = ()):
    """(path, text, characters of links) of the blocks below a node in page order. Without marks nothing is left out
    but scripts and the like. The nodes that lead to the container are never marked."""
    held: list[str] = []
    linked = [0]
    inside = inside or node.tag in _ANCHORS

    def flush(where):
        text, links = clean("".join(held)), linked[0]
        held.clear()
        linked[0] = 0
        if text:
            yield where, text, links

    def walk(n: Node, where: tuple[str, ...], within: bool, link: bool):
        for child in n.children:
            if isinstance(child, str):
                held.append(child)
                if link:
                    linked[0] += len(child.strip())
                continue
            if child.tag in ("br", "wbr"):
                held.append(" ")
                continue
            below = where + (child.signature,)
            leads = container[: len(below)] == below
            if _skipped(child, within) and not leads if marks else child.tag in RAW:
                if child.tag in BLOCKS:
                    yield from flush(where)
                continue
            if child.tag in BLOCKS:
                yield from flush(where)
                yield from walk(child, below, within or child.tag in _ANCHORS or leads and below == container, link)
                yield from flush(below)
            else:
                yield from walk(child, where, within, link or child.tag == "a")

    yield from walk(node, path, inside, False)
    yield from flush(path)


class Slot:
    """A node of a folded tree: all members of a run of like siblings, and the runs below them."""

    __slots__ = ("signature", "nodes", "below")

    def __init__(self, signature: str, nodes: list[Node]):
        self.signature, self.nodes = signature, nodes
        self.below: list[Slot] = []
        for node in nodes:
            runs: list[Slot] = []
            for child in node.children:
                if isinstance(child, Node) and child.tag not in RAW:
                    if runs and runs[-1].signature == child.signature:
                        runs[-1].nodes.append(child)
                    else:
                        runs.append(_bare(child))
            self.below = _merged(self.below, runs)
        self.below = [Slot(s.signature, s.nodes) for s in self.below]


def _bare(node: Node) -> Slot:
    slot = Slot.__new__(Slot)
    slot.signature, slot.nodes, slot.below = node.signature, [node], []
    return slot


def _pairs(left: list[Slot], right: list[Slot], weight) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairs of equal signatures in the same order in both lists, and their weight.

    Only pairs of equal signatures are looked at, so lists of unlike children cost their length. `heaviest[j]`, a tree of
    prefix maxima, is the last pair of the heaviest chain so far that ends before place j of the right list.
    """
    places: dict[str, list[int]] = {}
    for j, slot in enumerate(right):
        places.setdefault(slot.signature, []).append(j)
    heaviest: list[tuple[int, tuple | None]] = [(0, None)] * (len(right) + 1)
    for i, slot in enumerate(left):
        for j in reversed(places.get(slot.signature, ())):  # so no pair builds on another of the same left place
            best, k = (0, None), j
            while k:
                if heaviest[k][0] > best[0]:
                    best = heaviest[k]
                k -= k & -k
            chain = (best[0] + weight(slot, right[j]), (i, j, best[1]))
            k = j + 1
            while k <= len(right):
                if chain[0] > heaviest[k][0]:
                    heaviest[k] = chain
                k += k & -k
    best, k = (0, None), len(right)
    while k:
        if heaviest[k][0] > best[0]:
            best = heaviest[k]
        k -= k & -k
    found, at = [], best[1]
    while at is not None:
        found.append(at[:2])
        at = at[2]
    return best[0], found[::-1]


def _merged(old: list[Slot], new: list[Slot]) -> list[Slot]:
    """Two lists of runs as one, in an order that both have; matched runs hold the members of both."""
    out, at = [], 0
    pairs = dict((j, i) for i, j in _pairs(old, new, lambda x, y: 1)[1])
    for j, run in enumerate(new):
        if j in pairs:
            out += old[at : pairs[j]]
            at = pairs[j] + 1
            run.nodes = old[pairs[j]].nodes + run.nodes
        out.append(run)
    return out + old[at:]


def align(a: Slot, b: Slot, known: dict | None = None) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching of two folded trees: the number of matched nodes, roots included, and the pairs."""
    if a.signature != b.signature:
        return 0, []
    known = {} if known is None else known

    def weight(x: Slot, y: Slot) -> int:
        if (id(x), id(y)) not in known:
            known[id(x), id(y)] = align(x, y, known)
        return known[id(x), id(y)][0]

    score, pairs = _pairs(a.below, b.below, weight)
    return 1 + score, [(a, b), *(p for i, j in pairs for p in known[id(a.below[i]), id(b.below[j])][1])]


def own_blocks(node: Node, marks: bool):
    """(text, characters of links) of a node's own blocks, those of `blocks` with an empty path, without going into other blocks."""
    held: list[str] = []
    linked, out = 0, []
    inside = node.tag in _ANCHORS
    todo: list = [(c, False) for c in reversed(node.children)]
    todo.insert(0, (None, False))  # the end
    while todo:
        child, link = todo.pop()
        if isinstance(child, str):
            held.append(child)
            linked += len(child.strip()) if link else 0
        elif child is not None and child.tag in ("br", "wbr"):
            held.append(" ")
        elif child is None or child.tag in BLOCKS:
            text = clean("".join(held))
            if text:
                out.append((text, linked))
            held, linked = [], 0
        elif not (_skipped(child, inside) if marks else child.tag in RAW):
            todo += [(c, link or child.tag == "a") for c in reversed(child.children)]
    return out


def _own_texts(slot: Slot) -> tuple[str, ...]:
    return tuple(text for n in slot.nodes for text, _ in own_blocks(n, False))


def _size(slot: Slot) -> int:
    return 1 + sum(map(_size, slot.below))


def constants(trees: list[Slot]) -> list[set[int]]:
    """For each of the aligned trees the ids of the slots that are constant: matched on all pages with the same text."""
    first, matched = trees[0], {}
    for k, other in enumerate(trees[1:]):
        for a, b in align(first, other)[1]:
            matched.setdefault(id(a), [a]).append(b)
    out: list[set[int]] = [set() for _ in trees]
    for slots in matched.values():
        if len(slots) == len(trees) and len({_own_texts(s) for s in slots}) == 1:
            for found, slot in zip(out, slots):
                found.add(id(slot))
    return out


def visited(tree: Slot, marks: bool) -> list[tuple[Slot, tuple[str, ...], int]]:
    """(slot, path, characters of its own blocks but those of links) of the blocks of a folded tree, without what is below marked parts."""
    out: list[tuple[Slot, tuple[str, ...], int]] = []

    def walk(slot: Slot, path: tuple[str, ...], within: bool):
        out.append((slot, path, sum(max(0, len(t) - links) for n in slot.nodes for t, links in own_blocks(n, marks))))
        within = within or slot.nodes[0].tag in _ANCHORS
        for below in slot.below:
            if below.nodes[0].tag in BLOCKS:
                under = path + (below.signature,)
                if marks and _skipped(below.nodes[0], within):
                    out.append((below, under, 0))
                else:
                    walk(below, under, within)

    walk(tree, (), False)
    return out


def rolled(own: list[tuple[tuple[str, ...], float]]) -> dict[tuple[str, ...], float]:
    """What is at and below each path, from what is at each."""
    out: dict[tuple[str, ...], float] = {}
    for path, w in own:
        out.setdefault(path, 0)
        for n in range(len(path) + 1) if w else ():
            out[path[:n]] = out.get(path[:n], 0) + w
    return out


def _weights(tree: Slot, constant: set[int], marks: bool) -> dict[tuple[str, ...], int]:
    """Characters, links and marked parts aside, of the varying slots at and below each path of a page."""
    return rolled([(path, 0 if id(slot) in constant else w) for slot, path, w in visited(tree, marks)])


def chosen_container(weights: list[dict], marks: bool) -> tuple[tuple[str, ...], list[tuple[str, ...]]]:
    """The container that the varying slots of aligned pages choose, and the outside slots; see above."""
    total: dict[tuple[str, ...], float] = {}
    for weight in weights:
        for path, w in weight.items():
            total[path] = total.get(path, 0) + w / max(1, weight[()]) / len(weights)
    return descended(total, marks)


def descended(total: dict[tuple[str, ...], float], marks: bool = True) -> tuple[tuple[str, ...], list[tuple[str, ...]]]:
    """The container and the outside slots, from the share of varying text at and below each path."""
    titles = [p for p, w in total.items() if w and p[-1:] and p[-1].split(".")[0] == "h1"]
    here, outside = (), []
    while True:
        below = [p for p in total if len(p) == len(here) + 1 and p[:-1] == here]
        child = max(below, key=lambda p: (total[p], p), default=None)
        if child is None or not total[child] or child[-1].split(".")[0] not in _HOLDERS or total[child] < MOST * total[here]:
            return here, outside
        beside = [p for p in below if p != child]
        loose = total[here] - sum(total[p] for p in below)
        held = [p for p in beside if total[p]]
        if loose > 1e-9 or any(p[-1].split(".")[0] in _RUNNING or marks and total[p] >= PART * total[here] or any(t[: len(p)] == p for t in titles) for p in held):
            return here, outside
        here, outside = child, outside + beside


def _anchors(node: Node, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    out = []
    for c in node.children:
        if isinstance(c, Node) and not _skipped(c, False):
            out += [path + (c.signature,)] if c.tag in _ANCHORS else _anchors(c, path + (c.signature,))
    return out


def skeleton(root: Node) -> frozenset[str]:
    """Paths of the upper levels of a page, which tell its template from others."""
    out = set()

    def walk(n: Node, path: str, depth: int):
        for c in n.children:
            if isinstance(c, Node) and c.tag in BLOCKS:
                out.add(f"{path}/{c.signature}")
                if depth > 1:
                    walk(c, f"{path}/{c.signature}", depth - 1)

    walk(root, "", 4)
    return frozenset(out)


def _alike(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / max(1, len(a | b))


def induce(pages: list[str], marks: bool = True) -> list[dict]:
    """The wrappers of a few pages of a host in memory, one for each group of like pages, their templates still empty."""
    groups: list[list[tuple[frozenset[str], Slot]]] = []
    for page in dict.fromkeys(pages):
        root = parse(page)
        shape, tree = skeleton(root), Slot("#root", [root])
        for group in groups:
            size = max(_size(tree), _size(group[0][1]))
            if _alike(shape, group[0][0]) >= LIKE or 2 * align(group[0][1], tree)[0] >= size:
                group.append((shape, tree))
                break
        else:
            groups.append([(shape, tree)])
    out = []
    for group in groups:
        if len(group) < 2:  # nothing to align it with
            continue
        trees = [tree for _, tree in group]
        container, outside = chosen_container([_weights(tree, fixed, marks) for tree, fixed in zip(trees, constants(trees))], marks)
        out.append({"container": list(container), "outside": [list(p) for p in outside], "skeleton": sorted(group[0][0])})
    return out


def find(root: Node, path) -> list[Node]:
    """The nodes at a path of signatures, in page order."""
    level = [root]
    for signature in path:
        level = [c for n in level for c in n.children if isinstance(c, Node) and c.signature == signature]
    return level


def content(page: str | None, wrappers: list[dict] | None, marks: bool = True) -> tuple[int, list[tuple[tuple[str, ...], str]]]:
    """The number of the wrapper that fits the page, or -1, and (path, text) of the blocks of the page's container."""
    if not page:
        return -1, []
    root = parse(page)
    which, container, outside = -1, (), frozenset()
    if wrappers:
        shape = skeleton(root)
        fits = [(_alike(shape, w["shape"]), -i) for i, w in enumerate(wrappers) if find(root, w["container"])]
        if fits and max(fits)[0] > 0:
            which = -max(fits)[1]
            container, outside = wrappers[which]["path"], wrappers[which]["beside"]
    nodes, path = [root], ()
    if which < 0 and marks and len(anchors := _anchors(root)) == 1:
        nodes, path = find(root, anchors[0]), anchors[0]
    found = [(p, text) for node in nodes for p, text, _ in blocks(node, path, marks=marks, container=container)]
    return which, [(p, text) for p, text in found if not outside or not any(p[:n] in outside for n in range(1, len(container) + 1))]


def print_of(path: tuple[str, ...], text: str) -> int:
    """64 bits that stand for a block."""
    return int.from_bytes(hashlib.blake2b(("\n".join(path) + "\n\n" + text).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _heading(path: tuple[str, ...]) -> str:
    """The tag of a block that is a heading, else nothing."""
    tag = path[-1].split(".")[0] if path else ""
    return tag if tag in _HEADINGS else ""


def left_out(found: list[tuple[tuple[str, ...], str]], common: list[bool], container: tuple[str, ...]) -> list[bool]:
    """Which blocks of a page are left out, given those that are template; see above."""
    titles = [c for (path, _), c in zip(found, common) if _heading(path) == "h1"]
    if titles and all(titles) and all(c for (path, _), c in zip(found, common) if _heading(path)):
        return [False] * len(found)
    if not any(c and _heading(path) for (path, _), c in zip(found, common)):
        return common
    varies, runs = set(), set()
    for (path, _), c in zip(found, common):
        for n in range(len(container) + 1, len(path) + 1):
            if not c:
                varies.add(path[:n])
            elif not _heading(path):
                runs.add(path[:n])
    gone = runs - varies
    return [c and (not _heading(path) or any(path[:n] in gone for n in range(len(container) + 1, len(path)))) for (path, _), c in zip(found, common)]


def main_text(page: str | None, wrappers: list[dict] | None, marks: bool = True) -> str:
    """Blocks of the page's content, one on each line."""
    which, found = content(page, wrappers, marks)
    template = wrappers[which]["prints"] if which >= 0 else frozenset()
    if template:
        gone = left_out(found, [print_of(*block) in template for block in found], wrappers[which]["path"])
        found = [block for block, g in zip(found, gone) if not g]
    return "\n".join(text for _, text in found)


def host_of(url):
    """The host of a url, in lower case; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _printed(pages: DataFrame) -> DataFrame:
    """host, print (of the html) and html of the pages that have any."""
    html = F.col("html").cast("string")
    return pages.where(F.length(html) > 0).select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("print"), html.alias("html"))


def _joined(pages: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Pages with their host's wrapper; wrappers are broadcast if they are counted to be small."""
    bytes_ = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    return pages.join(F.broadcast(known) if bytes_ <= BROADCAST else known, "host", how)


def leaders(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON, a list of skeleton and page) of the kinds of pages of every host.

    The skeletons of all distinct pages are counted. By falling count, a skeleton that is like none before it leads a kind, and its
    page of the smallest print is what the others are aligned with. Sorted rows stream past the leaders of one host.
    """

    def shapes(batches):
        for batch in batches:
            prints = [print_of(tuple(sorted(skeleton(parse(page)))), "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["host", "print", "shape"])

    counted = _printed(pages).mapInArrow(shapes, "host string, print long, shape long").distinct().groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("print").alias("print"))
    counted = cut(counted)
    first = _printed(pages).join(small(counted), ["host", "print"]).dropDuplicates(["host", "print"])
    first = first.repartition("host").sortWithinPartitions("host", F.desc("n"), "shape").select("host", "html")

    def lead(batches):
        host, found = None, []
        for batch in batches:
            out: tuple[list, list] = [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != host:
                    host, found = name, []
                shape = skeleton(parse(page))
                if not any(_alike(shape, other) >= LIKE for other in found):
                    found.append(shape)
                    out[0].append(name)
                    out[1].append(json.dumps({"number": len(found), "skeleton": sorted(shape), "page": page}))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in out], ["host", "kind"])

    kinds = first.mapInArrow(lead, "host string, kind string")
    return kinds.groupBy("host").agg(F.concat(F.lit("["), F.array_join(F.collect_list("kind"), ", "), F.lit("]")).alias("wrapper"))


class Kind:
    """A kind of pages: the skeleton and the folded tree of its leading page, with the number of each slot."""

    def __init__(self, number: int, shape: list[str], page: str):
        self.number, self.shape, self.tree = number, frozenset(shape), Slot("#root", [parse(page)])
        self.numbers = {id(slot): i for i, (slot, _, _) in enumerate(visited(self.tree, True))}

    def rows(self, root: Node) -> list[tuple[int, str, int, int]]:
        """(number of the slot or -1, path, print of its texts, millionths of the page's text) of the slots of a page aligned with the leading one."""
        tree = Slot("#root", [root])
        numbers = {id(b): self.numbers.get(id(a), -1) for a, b in align(self.tree, tree)[1]}
        found = visited(tree, True)
        whole = max(1, sum(w for _, _, w in found))
        out, loose = [], {}
        for slot, path, w in found:
            number = numbers.get(id(slot), -1)
            if number < 0:
                loose[path] = loose.get(path, 0) + w
            else:
                out.append((number, "\n".join(path), print_of((), "\n".join(_own_texts(slot))) if w else 0, w * 10**6 // whole))
        return out + [(-1, "\n".join(path), 0, w * 10**6 // whole) for path, w in loose.items()]


def container_of(paths: list[str], have: list[int], vary: list[int], own: list[int], pages: int) -> tuple[tuple[str, ...], list[tuple[str, ...]]]:
    """The container and the outside slots of a kind, from the counts of all its pages."""
    often = OFTEN * pages
    named = [tuple(p.split("\n")) if p else () for p in paths]
    return descended(rolled([(p, w / 1e6 / pages if v >= often else 0) for p, h, v, w in zip(named, have, vary, own) if h >= often]))


def containers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON), its template still empty, of every host with two distinct pages of a kind, from all its pages."""
    kinds = cut(leaders(pages))

    def kernel(batches):
        read: dict[str, list[Kind]] = {}
        for batch in batches:
            for start in range(0, len(batch), 100):
                part = batch.slice(start, 100)
                at, number, out = [], [], []
                for i, (page, wrapper) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if wrapper not in read:
                        if len(read) >= 1000:
                            read.clear()
                        read[wrapper] = [Kind(k["number"], k["skeleton"], k["page"]) for k in json.loads(wrapper)]
                    root = parse(page)
                    shape = skeleton(root)
                    kind = max(read[wrapper], key=lambda k: (_alike(shape, k.shape), -k.number))
                    rows = kind.rows(root)
                    at += [i] * len(rows)
                    number += [kind.number] * len(rows)
                    out += rows
                at = pa.array(at, pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()), *columns], ["site", "print", "kind", "slot", "path", "texts", "share"])

    rows = _joined(_printed(pages), kinds, "inner").select(F.xxhash64("host").alias("site"), "print", "html", "wrapper")
    rows = cut(rows.mapInArrow(kernel, "site long, print long, kind int, slot int, path string, texts long, share long").repartition("site", "print").distinct())
    totals = rows.where("slot = 0").groupBy("site", "kind").agg(F.count("*").alias("pages")).where("pages > 1")
    texts = rows.where("slot >= 0").groupBy("site", "kind", "slot", "texts").agg(F.count("*").alias("n"))
    constant = texts.join(totals, ["site", "kind"]).where((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * F.col("pages"))).select("site", "kind", "slot", "texts", F.lit(True).alias("constant"))
    own = F.sum(F.when(F.col("constant"), 0).otherwise(F.col("share")))
    held = rows.join(small(cut(constant)), ["site", "kind", "slot", "texts"], "left").groupBy("site", "print", "kind", "path").agg(own.alias("own"))
    held = held.groupBy("site", "kind", "path").agg(F.count("*").alias("have"), F.sum(F.when(F.col("own") > 0, 1).otherwise(0)).alias("vary"), F.sum("own").alias("own"))
    held = held.join(totals, ["site", "kind"]).where(F.col("have") >= OFTEN * F.col("pages"))
    held = held.groupBy("site", "kind", "pages").agg(F.collect_list(F.struct("path", "have", "vary", "own")).alias("slots"))

    @F.udf("string")
    def chosen(slots, of, shape):
        container, outside = container_of(*map(list, zip(*sorted(slots))), of)
        return json.dumps({"container": container, "outside": outside, "skeleton": shape})

    listed = F.explode(F.from_json("wrapper", "array<struct<number: int, skeleton: array<string>>>")).alias("k")
    led = kinds.select("host", F.xxhash64("host").alias("site"), listed).select("host", "site", F.col("k.number").alias("kind"), F.col("k.skeleton").alias("skeleton"))
    each = held.join(led, ["site", "kind"]).select("host", "kind", chosen("slots", "pages", "skeleton").alias("wrapper"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("kind", "wrapper"))), lambda k: k["wrapper"])
    return each.groupBy("host").agg(F.concat(F.lit("["), F.array_join(in_order, ", "), F.lit("]")).alias("wrapper"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON, a list) of every host with pages to align; all is counted over all pages."""
    bare = cut(containers(pages))

    def kernel(batches):
        read: dict[str, list] = {}
        for batch in batches:
            for start in range(0, len(batch), 100):
                part = batch.slice(start, 100)
                at, numbers, prints = [], [], []
                for i, (page, wrapper) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    which, found = content(page, _read(read, wrapper))
                    if which >= 0:
                        each = {print_of(*block) for block in found} | {0}  # 0 stands for the page
                        at += [i] * len(each)
                        numbers += [which] * len(each)
                        prints += each
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(prints, pa.int64())], ["site", "print", "which", "block"])

    rows = _joined(_printed(pages), bare, "inner").select(F.xxhash64("host").alias("site"), "print", "html", "wrapper")
    seen = rows.mapInArrow(kernel, "site long, print long, which int, block long").distinct().groupBy("site", "which", "block").agg(F.count("*").alias("n"))
    held = cut(seen.where((F.col("n") >= LEAST_PAGES) | (F.col("block") == 0)))
    totals = held.where("block = 0").select("site", "which", F.col("n").alias("pages"))
    common = held.where("block <> 0").join(totals, ["site", "which"]).where(F.col("n") >= LEAST_SHARE * F.col("pages"))
    common = common.groupBy("site").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("which").cast("bigint"), F.col("block"))))).alias("template"))
    whole = F.concat(F.lit('{"wrappers": '), F.col("wrapper"), F.lit(', "template": '), F.coalesce("template", F.lit("[]")), F.lit("}"))
    return bare.withColumn("site", F.xxhash64("host")).join(common, "site", "left").select("host", whole.alias("wrapper"))


def ready(wrapper: str) -> list[dict]:
    """Wrappers from their JSON, with what reading needs."""
    found = json.loads(wrapper)
    listed = found["wrappers"] if isinstance(found, dict) else found
    template = found["template"] if isinstance(found, dict) else []
    return [w | {"path": tuple(w["container"]), "beside": frozenset(map(tuple, w["outside"])), "shape": frozenset(w["skeleton"]), "prints": frozenset(block for which, block in template if which == i)} for i, w in enumerate(listed)]


def _read(read: dict[str, list], wrapper: str | None) -> list[dict] | None:
    """A host's wrappers, made ready once for many pages."""
    if wrapper is not None and wrapper not in read:
        if len(read) >= 1000:
            read.clear()
        read[wrapper] = ready(wrapper)
    return read.get(wrapper)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    small_batches(pages.sparkSession)
    known = cut(wrappers(pages))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    rows = _joined(rows, known, "left").select("page_id", "url", "html", "wrapper")

    def kernel(batches):
        read: dict[str, list] = {}
        for batch in batches:
            for start in range(0, len(batch), 100):
                part = batch.slice(start, 100)
                texts = []
                for page, wrapper in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    texts.append(main_text(page, _read(read, wrapper)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The contract's texts of the whole pages table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLES: dict = {}
