"""HTML extraction with union-free wrappers, inferred per host.

A page is a stream of tokens: tags with their class and id, and texts. Pages of one host are aligned one after the other: where
streams agree the wrapper keeps the token; a run of like tokens, or of the same few tokens, becomes a repeated group; a token
that one side lacks becomes an optional group; texts become slots. Groups nest, so a wrapper is a regular expression without unions over
tokens, held as a tree: each node has a label, a kind (one, optional, repeated, or both) and an ordered list of nodes.

1. Each page is folded to its own wrapper. Equal ones of a host are one row before anything is shuffled. All pages count.
2. Wrappers of a host are aligned in two steps (by salt, then by host), one after the other as they stream by, so that a host
   with a third of all pages has no large group. Levels are aligned by their longest common run of labels, or, where two levels
   have over 250,000 pairs of nodes, by a run that takes the first places that fit: it covers both as well. A host whose pages
   give more than 4,096 nodes, as many templates or ever new names do, gets a wrapper that tells nodes by their tags alone.
3. Each page is read against its host's wrapper: every tag and text goes to the node that covers it, a repeated group
   again, an optional one or none. A text slot sums its characters, its links' characters and the smallest and largest hash
   of its texts: a slot with one text on all pages is a fixed part.
4. The wrapper's main part is found: what is marked as article or main, unless it holds less than a tenth of the text of
   slots that vary and are not mostly links; else the deepest group that holds nearly all of that text. Menus, headers,
   footers, sidebars, notices, adverts, forms and comments are told by their tags, classes and ids; these never leave out
   html, body, an article, what holds the main part, or nearly all of the text.
5. Each page is read against the wrapper again, and the texts of its main part are given out, block by block. A page
   without its host's main part is read against its own wrapper.

A block is the text between block-level tags. Character references are decoded, white space becomes one space, blocks are
trimmed, empty ones left out, and the rest joined by a line feed in page order.

Edge cases: null or empty html gives an empty text; pages with a null or unparsable URL form one host; pages whose tags never
close, or end early, are closed at the end; repeated rows each get their row; empty tables give empty results; extra columns
are ignored, but for those named in `keep`.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Generator, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.llm.shared import cut, partitions, table

#: A tag's quotes may hold ">". Each step is possessive: a match takes time in proportion to its length.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
#: For the rest of a page with a tag whose quotes never close.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_TAG = re.compile(r"</?[A-Za-z]")
_CLASS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: They tell what else a page has, not what the element is.
_STATES = re.compile(r"(?<![a-z0-9])(?:has|with|without|no)[-_]+[a-z0-9_-]+", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are not markup, or nothing in them is shown.
_RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A tag that begins closes these, if one of them is open inside the nearest of the others.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_OUT_TAGS = frozenset("head nav aside footer form button select menu dialog".split()) | _RAW
#: Parts of class, id and role names that mark what is not the article.
_OUT_NAMES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar aside footer"
    " breadcrumb breadcrumbs comment comments discussion disqus replies respond cookie cookies consent notice notices banner"
    " popup modal newsletter subscribe signup share sharing social related recommended toolbar login search pagination pager widget".split()
)
#: No list of words leaves these out.
_KEPT_TAGS = frozenset("root html body article main".split())
_HEADERS, _OWN_HEADERS = frozenset(["header", "masthead"]), frozenset("article entry post content story title".split())
#: Hosts whose wrappers a task holds at once.
_KNOWN = 1000
#: Nodes that may repeat together as a group; pairs of nodes for which the longest common run is sought; nodes of a wrapper
#: beyond which names go; tests of nodes of one label a page.
_GROUP, _CELLS, _MOST, _TRIED = 8, 250_000, 4096, 20_000
_BODY, _PLAIN = "articlebody", "root-plain"


def _names(attributes: str) -> list[str]:
    out = []
    for _, a, b, c in _CLASS.findall(attributes):
        out += re.split(r"[^a-z0-9]+", _STATES.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c)).lower())
    return sorted({re.sub(r"\d+", "#", x) for x in out if x})


def _is_out(tag: str, names: list[str]) -> bool:
    """A hint; the host's wrapper may say otherwise."""
    if tag in _KEPT_TAGS:
        return False
    return _is_listed(tag, names)


def _is_listed(tag: str, names: list[str]) -> bool:
    if tag in _OUT_TAGS or not _OUT_NAMES.isdisjoint(names):
        return True
    # A header that is named after the article is a part of it.
    return not _HEADERS.isdisjoint(names) and _OWN_HEADERS.isdisjoint(names)


class Node:
    __slots__ = ("label", "tag", "items", "out")

    def __init__(self, tag: str, attributes: str = ""):
        names = _names(attributes) if attributes else []
        if _ROLE.search(attributes):
            names = sorted({*names, _BODY})
        self.tag, self.items = tag, []
        self.label = f"{tag}.{'.'.join(names)}" if names else tag
        self.out = _is_out(tag, names)


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text before, tag); in time in proportion to the page, whatever it leaves open."""
    at, last, token = 0, page.rfind(">"), _TOKEN
    while True:
        begin = page.find("<", at)
        while begin >= 0:
            m = token.match(page, begin)
            if m is None and token is _TOKEN and begin < last and _TAG.match(page, begin):
                # No ">" outside of quotes follows: from here on quotes count for nothing.
                token = _LOOSE
                m = token.match(page, begin)
            if m or begin > last:
                break
            begin = page.find("<", begin + 1)
        else:
            m = None
        if not m:
            yield page[at:], None
            return
        yield page[at:begin], m
        at = m.end()
        if (m[2] or "").lower() in _RAW and not m[1]:
            end = re.compile(f"</{re.escape(m[2])}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)


def parse(page: str) -> Node:
    """The tree of block-level tags; items are nodes, texts (str) and, around links, the marks True and False."""
    root = Node("root")
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def nearest(tags: set) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set, upto: set) -> None:
        if (k := nearest(tags)) > nearest(upto):
            cut_to(k)

    for text, m in _tokens(page):
        if text:
            stack[-1].items.append(text)
        if m is None or not m[2]:
            continue
        tag, ending, attributes = m[2].lower(), m[1], m[3] or ""
        if tag in _RAW and not ending:
            stack[-1].items.append(" ")
        elif tag == "a":
            stack[-1].items.append(not ending)
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                stack[-1].items.append(" ")
        elif tag not in _BLOCK and tag not in _OUT_TAGS:
            # Other tags are nodes if their names are on the list, and those of their kind inside them, so that ends find their own.
            if ending:
                if stack[-1].tag == tag:
                    cut_to(len(stack) - 1)
            elif (stack[-1].tag == tag or not _OUT_NAMES.isdisjoint(_names(attributes))) and tag not in _VOID:
                node = Node(tag, attributes)
                stack[-1].items.append(node)
                push(node)
        elif ending:
            if places.get(tag):
                cut_to(places[tag][-1])
        else:
            if tag in _BLOCK:
                close({"p"}, {"td", "th", "li", "table", "button", "div", "section", "article"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            node = Node(tag, attributes)
            stack[-1].items.append(node)
            if tag not in _VOID:
                push(node)
    return root


# --- wrappers: [label, optional, repeated, [children]]; a text slot is the label "#", and a group of several nodes that repeats
# together the label "(a b)" of their labels ------------------------------------------------------------------------------


def wrapper_of(root: Node) -> list:
    """A page's own wrapper: runs of like nodes folded into repeated groups."""
    done: dict[int, list] = {}
    stack = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack += [(x, False) for x in node.items if isinstance(x, Node)]
            continue
        children: list = []
        for x in node.items:
            if isinstance(x, str):
                if x.strip() and not (children and children[-1][0] == "#"):
                    children.append(["#", 0, 0, []])
            elif isinstance(x, Node):
                children.append(done.pop(id(x)))
        done[id(node)] = [node.label, 0, 0, _run(_folded(children))]
    return done[id(root)]


def _run(steps: Generator) -> list:
    """The result of steps that yield the steps whose results they need: trees may be deeper than Python's stack."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _folded(children: list) -> Generator:
    """Runs of one label, and then runs of the same few labels, as repeated groups."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            merged = yield _aligned(out[-1], c)
            merged[2] = int(c[0] != "#")
            out[-1] = merged
        else:
            out.append(c)
    labels, folded, i = [c[0] for c in out], [], 0
    while i < len(out):
        n = next((n for n in range(2, _GROUP + 1) if labels[i : i + n] == labels[i + n : i + 2 * n]), 0)
        if not n or any(x[0] == "(" for x in labels[i : i + n]):
            folded.append(out[i])
            i += 1
            continue
        group = _group(out[i : i + n])
        i += n
        while labels[i : i + n] == [c[0] for c in group[3]]:
            group = yield _aligned(group, _group(out[i : i + n]))
            i += n
        group[2] = 1
        folded.append(group)
    return folded


def _group(nodes: list) -> list:
    return [f"({' '.join(c[0] for c in nodes)})", 0, 0, nodes]


def _grouped(x: list, groups: dict[str, list]) -> list:
    """x, with what runs like one of the groups as one."""
    out, i = [], 0
    while i < len(x):
        for labels in groups.values():
            if [c[0] for c in x[i : i + len(labels)]] == labels:
                out.append(_group(x[i : i + len(labels)]))
                i += len(labels)
                break
        else:
            out.append(x[i])
            i += 1
    return out


def aligned(a: list, b: list) -> list:
    """The wrapper of what a and b, of one label, both cover. Levels are aligned by their longest common run of labels."""
    return _run(_aligned(a, b))


def _aligned(a: list, b: list) -> Generator:
    children = (yield _aligned_lists(a[3], b[3])) if a[3] or b[3] else []
    return [a[0], a[1] | b[1], a[2] | b[2], children]


def _matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places in x and y of a common run of labels: the longest one, or, where a table of all pairs would be too large, what
    the first places that fit give."""
    n, m, head, tail = len(x), len(y), 0, 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    while tail < min(n, m) - head and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    out = [(k, k) for k in range(head)]
    x, y = x[head : n - tail], y[head : m - tail]
    if len(x) * len(y) <= _CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        at: dict[str, list[int]] = {}
        for i, label in enumerate(x):
            at.setdefault(label, []).append(i)
        i = 0
        for j, label in enumerate(y):
            known = at.get(label, [])
            k = bisect_left(known, i)
            if k < len(known):
                out.append((head + known[k], head + j))
                i = known[k] + 1
    return out + [(n - k, m - k) for k in range(tail, 0, -1)]


def _aligned_lists(x: list, y: list) -> Generator:
    groups = {c[0]: [d[0] for d in c[3]] for c in [*x, *y] if c[0][0] == "("}
    if groups:
        # What one side has as a repeated group the other may have once.
        x, y = (yield _folded(_grouped(x, groups))), (yield _folded(_grouped(y, groups)))
    pairs = _matched([c[0] for c in x], [c[0] for c in y])
    out, i, j = [], 0, 0
    for a, b in [*pairs, (len(x), len(y))]:
        out += [[c[0], 1, c[2], c[3]] for c in [*x[i:a], *y[j:b]]]
        if a < len(x):
            out.append((yield _aligned(x[a], y[b])))
        i, j = a + 1, b + 1
    return out if len(pairs) == len(x) == len(y) else (yield _folded(out))


def _size(wrapper: list) -> int:
    n, stack = 0, [wrapper]
    while stack:
        n += 1
        stack += stack.pop()[3]
    return n


def plain(wrapper: list) -> list:
    """A wrapper whose nodes are told by their tags alone, not by names; the root's label says so."""

    def relabelled(node: list) -> Generator:
        children = []
        for c in node[3]:
            inner = yield relabelled(c)
            # A group's labels may now be those of others: its nodes stand for themselves, as often as need be.
            children += [[d[0], 1, 1, d[3]] for d in inner[3]] if c[0][0] == "(" else [inner]
        label = node[0].split(".")
        return [".".join(label[:1] + [x for x in label[1:] if x == _BODY]), node[1], node[2], (yield _folded(children))]

    out = _run(relabelled(wrapper))
    out[0] = _PLAIN
    return out


def merged(a: list, b: list) -> list:
    """The wrapper of two of one host. Beyond `_MOST` nodes, as pages of many templates or names may give, names go."""
    if a[0] != b[0]:
        a, b = (w if w[0] == _PLAIN else plain(w) for w in (a, b))
    out = aligned(a, b)
    return out if out[0] == _PLAIN or _size(out) <= _MOST else plain(out)


def flat(wrapper: list) -> str:
    """A wrapper as JSON: its nodes in order, each as depth, label, optional, repeated."""
    out, stack = [], [(wrapper, 0)]
    while stack:
        (label, optional, repeated, children), depth = stack.pop()
        out.append([depth, label, optional, repeated])
        stack += [(c, depth + 1) for c in reversed(children)]
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> list:
    above: list = []
    for depth, label, optional, repeated in json.loads(text):
        node = [label, optional, repeated, []]
        if depth:
            above[depth - 1][3].append(node)
        above[depth:] = [node]
    return above[0]


class Reading:
    """A wrapper whose nodes are numbered in order; verdict: of each node, none, MAIN or OUT; marked: whether tags name the main part."""

    def __init__(self, text: str, verdict: list[int] | None = None, marked: bool = False):
        nodes, above = json.loads(text), []
        self.labels, self.repeated = [x[1] for x in nodes], [x[3] for x in nodes]
        self.parent, self.children = [-1] * len(nodes), [[] for _ in nodes]
        self.verdict, self.marked = verdict or [0] * len(nodes), marked
        for k, (depth, *_) in enumerate(nodes):
            above[depth:] = [k]
            if depth:
                self.parent[k] = above[depth - 1]
                self.children[above[depth - 1]].append(k)

        self.plain = self.labels[0] == _PLAIN
        #: Of each node, by label, the places of its children: number of the child, and of the node in it if it is a group.
        self.places: list[dict[str, list[tuple[int, int, int]]]] = [{} for _ in nodes]
        for k, children in enumerate(self.children):
            for j, c in enumerate(children):
                for i, node in enumerate(self.children[c] if self.labels[c][0] == "(" else [c]):
                    self.places[k].setdefault(self.labels[node], []).append((j, i, node))
        self.start()

    def start(self) -> None:
        """Before each page: forgets what of the one before was tried."""
        self.tried: dict[tuple[int, int], bool] = {}

    def label(self, x: Node | str) -> str:
        if isinstance(x, str):
            return "#"
        return x.label if not self.plain else f"{x.tag}.{_BODY}" if _BODY in x.label.split(".") else x.tag

    def _places(self, k: int, at: tuple[int, int], label: str) -> list[tuple[int, int, int]]:
        """Where a token may be, from `at` on: a repeated group again, an optional one passed over."""
        found = self.places[k].get(label, ()) if k >= 0 else ()
        if not found or found[0] >= at:
            return found
        # A group of several goes on, or begins anew; then come later ones.
        same = [x for x in found if x[0] == at[0]]
        return [x for x in same if x[1] >= at[1]] + [x for x in same if x[1] < at[1]] + [x for x in found if x[0] > at[0]]

    def next(self, k: int, at: tuple[int, int], x: Node | str) -> tuple[int, tuple[int, int]]:
        """The child of k that covers a token, from `at` on, and its place; -1 and `at` if none does. Of several of its label,
        the first that covers all of it is taken, else the first."""
        found = self._places(k, at, self.label(x))
        if not found:
            return -1, at
        chosen = found[0]
        if len(found) > 1 and not isinstance(x, str):
            chosen = next((f for f in found if _run(self._covers(x, f[2]))), chosen)
        return chosen[2], chosen[:2]

    def _covers(self, x: Node, k: int) -> Generator:
        """Whether all of a node can be read in k. What is left of the tests after `_TRIED` says yes: a choice among likes only."""
        key = (id(x), k)
        if key not in self.tried:
            if len(self.tried) >= _TRIED:
                return True
            self.tried[key] = True
            at = (0, 0)
            for y in x.items:
                if isinstance(y, bool) or (isinstance(y, str) and not y.strip()):
                    continue
                for j, i, c in self._places(k, at, self.label(y)):
                    if isinstance(y, str) or (yield self._covers(y, c)):
                        at = (j, i)
                        break
                else:
                    self.tried[key] = False
                    break
        return self.tried[key]


MAIN, OUT = 1, 2


def slots_of(root: Node, wrapper: Reading) -> dict[int, tuple[int, int, int]]:
    """By text slot of the wrapper: characters, characters in links, a hash of the texts."""
    out: dict[int, list] = {}
    wrapper.start()
    stack = [(root, 0)]
    while stack:
        node, k = stack.pop()
        link, at = False, (0, 0)
        for x in node.items:
            if isinstance(x, bool):
                link = x
                continue
            text = isinstance(x, str)
            if text and not x.strip():
                continue
            number, at = wrapper.next(k, at, x)
            if not text:
                stack.append((x, number))
            elif number >= 0:
                slot = out.setdefault(number, [0, 0, 0])
                slot[0] += len(x)
                slot[1] += len(x) * link
                slot[2] = zlib.crc32(x.encode("utf-8", "surrogatepass"), slot[2])
    return {k: tuple(v) for k, v in out.items()}


def _is_marked(tag: str, names: list[str]) -> bool:
    return tag in ("article", "main") or "articlebody" in "".join(names)


def _above(wrapper: Reading, k: int) -> set[int]:
    """k and what it is in."""
    out = set()
    while k >= 0:
        out.add(k)
        k = wrapper.parent[k]
    return out


def decide(wrapper: Reading, slots: dict[int, tuple[int, int, int, bool]]) -> None:
    """Finds the wrapper's main part, and what is none of it. slots: by text slot, pages, characters, characters in links,
    whether all pages agree.

    The text of slots that vary and are not mostly links is weighed (where none does, of all slots). The main part is what
    is marked as article or main, if that holds a tenth of it; else the deepest group that holds nine tenths. Elements on the
    lists of tags and words are left out, but never html, body, an article or main element, what holds the main part, or what
    holds nine tenths of the text."""
    n, parent = len(wrapper.labels), wrapper.parent
    parts = [["()"] if x[0] == "(" else x.split(".") for x in wrapper.labels]
    marked = [_is_marked(t, names) for t, *names in parts]
    under = [False] * n  # a marked node
    for k in range(1, n):
        under[k] = under[parent[k]] or marked[parent[k]]
    listed = [not marked[k] and (_is_out(t, names) or (t == "header" and not under[k])) for k, (t, *names) in enumerate(parts)]
    weight, some = [0] * n, [0] * n
    for k, (pages, chars, links, fixed) in slots.items():
        some[k] = chars
        weight[k] = chars if 2 * links <= chars and not (fixed and pages > 2) else 0
    if not any(weight):
        weight = list(some)

    def summed(values: list[int], left_out: list[bool]) -> list[int]:
        out = [0 if x else v for v, x in zip(values, left_out, strict=True)]
        for k in range(n - 1, 0, -1):
            out[parent[k]] += out[k]
        return out

    every = summed(weight, [False] * n)
    # What may hold the main part: with a heading, a marked element or a listed one in it; of listed tags, a form only.
    holds = summed([int(x or y or bool(re.fullmatch("h[1-6]", t[0]))) for x, y, t in zip(marked, listed, parts, strict=True)], [False] * n)
    holder = [listed[k] and holds[k] > 1 and (t == "form" or t not in _OUT_TAGS) for k, (t, *_) in enumerate(parts)]
    while True:
        out = list(listed)
        for k in range(1, n):
            out[k] = out[k] or out[parent[k]]
        seen, chars = summed(weight, out), summed(some, out)
        main = [k for k in range(n) if marked[k] and not under[k] and not out[k] and chars[k]]
        if main:
            break
        # Elements on the lists that hold nearly all text, or a marked one with more text than all the rest, are kept.
        kept = {k for k in range(n) if holder[k] and listed[k] and every[0] and every[k] >= 0.9 * every[0] and not out[parent[k]]}
        for k in range(n):
            if not kept and marked[k] and not under[k] and every[k] > seen[0]:
                above = _above(wrapper, k)
                # Repeated ones are comments or teasers.
                if not any(wrapper.repeated[x] for x in above):
                    kept = {x for x in above if listed[x]}
        if not kept:
            break
        listed = [x and k not in kept for k, x in enumerate(listed)]
    # A marked element with a name on the lists is one of several: a teaser, if another holds more.
    named = {k for k in main if _is_listed(parts[k][0], parts[k][1:])}
    most = max((seen[k] for k in main if k not in named), default=0)
    teasers = {k for k in named if seen[k] < most}
    main = [k for k in main if k not in teasers]
    listed = [x or k in teasers for k, x in enumerate(listed)]
    wrapper.marked = bool(main) and 10 * sum(seen[k] for k in main) >= seen[0]
    if not wrapper.marked:
        top = 0
        while seen[0]:
            best = max((k for k in wrapper.children[top] if wrapper.labels[k] != "#"), key=seen.__getitem__, default=None)
            # A repeated group is a list of blocks: its parent is the article.
            if best is None or seen[best] < 0.9 * seen[0] or wrapper.repeated[best] or parts[best][0] in ("p", "li", "td", "pre", "blockquote"):
                break
            top = best
        main = [top]
        above = _above(wrapper, top)
        listed = [x or (parts[k][0] == "header" and k not in above) for k, x in enumerate(listed)]
    wrapper.verdict = [OUT * x for x in listed]
    for k in main:
        wrapper.verdict[k] = MAIN


def text_of(root: Node, wrapper: Reading) -> str | None:
    """The blocks of the main part of a page that is read against the wrapper; None if the page has no such part."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        block = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if block:
            blocks.append(block)

    verdict = wrapper.verdict
    wrapper.start()
    # A plain wrapper knows no names: those of a token itself count, unless it holds the main part.
    holds = set().union(*[_above(wrapper, k) for k, v in enumerate(verdict) if v == MAIN]) if wrapper.plain else set()
    found = verdict[0] == MAIN
    stack: list = [[root, 0, (0, 0), found, iter(root.items)]]
    while stack:
        top = stack[-1]
        node, k, _, inside, rest = top
        for x in rest:
            if isinstance(x, Node):
                below, top[2] = wrapper.next(k, top[2], x)
                says = verdict[below] if below >= 0 else OUT * x.out
                if wrapper.plain and x.out and below not in holds:
                    says = OUT
                if inside and x.tag in _BLOCK:
                    flush()
                if says == OUT:
                    continue
                found = found or says == MAIN
                stack.append([x, below, (0, 0), inside or says == MAIN, iter(x.items)])
                break
            if isinstance(x, str):
                if inside:
                    held.append(x)
                if x.strip():
                    _, top[2] = wrapper.next(k, top[2], x)
        else:
            stack.pop()
            if inside and node.tag in _BLOCK or (inside and not (stack and stack[-1][3])):
                flush()
    flush()
    return "\n".join(blocks) if found else None


def extract(page: str | None, wrapper: Reading | None) -> str:
    """wrapper: of the page's host, decided."""
    if not page:
        return ""
    root = parse(page)
    text = None if wrapper is None else text_of(root, wrapper)
    if text is None or not (text or wrapper.marked):
        # A page without the main part of its host stands for itself.
        own = Reading(flat(wrapper_of(root)))
        decide(own, {k: (1, c, link, False) for k, (c, link, _) in slots_of(root, own).items()})
        text = text_of(root, own)
    return text or ""


# --- Spark --------------------------------------------------------------------------------------------------------------


def _host(url_col: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _folds(pages: DataFrame) -> DataFrame:
    """(host, wrapper): pages' own wrappers, once a batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = {(host, flat(wrapper_of(parse(page or "")))): None for host, page in zip(*[c.to_pylist() for c in batch.columns], strict=True)}
            if wrappers:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*wrappers, strict=True)], names=["host", "wrapper"])

    return pages.mapInArrow(step, "host string, wrapper string")


def _read(pages: DataFrame) -> DataFrame:
    """Of each batch of (host, html, wrapper): (host, slot, pages, chars, links, low, high)."""
    names = ["host", "slot", "pages", "chars", "links", "low", "high"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reading] = {}
        for batch in batches:
            slots: dict = {}
            for host, page, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not page:
                    continue
                if text not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[text] = Reading(text)
                for k, (c, link, h) in slots_of(parse(page), known[text]).items():
                    old = slots.get((host, k), (0, 0, 0, h, h))
                    slots[host, k] = (old[0] + 1, old[1] + c, old[2] + link, min(old[3], h), max(old[4], h))
            if slots:
                rows = [(*key, *v) for key, v in slots.items()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 6, strict=True)], names=names)

    return pages.mapInArrow(step, "host string, slot long, pages long, chars long, links long, low long, high long")


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, marked, verdict): each host's wrapper as JSON, whether tags name its main part, its nodes' verdicts."""
    pages = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    salts = max(32, partitions(pages.sparkSession))
    own = _folds(pages).distinct().withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: one wrapper is held at a time, and grows by those of its group."""
        last, wrapper = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([flat(wrapper)], pa.string())], names=["host", "wrapper"])
        for batch in batches:
            for host, salt, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is not None and last != (host, salt):
                    yield done()
                    wrapper = None
                last, wrapper = (host, salt), unflat(text) if wrapper is None else merged(wrapper, unflat(text))
        if last is not None:
            yield done()

    kind = "host string, wrapper string"
    parts = own.select("host", "salt", "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(step, kind)
    parts = parts.withColumn("salt", F.lit(0)).select("host", "salt", "wrapper")  # at most `salts` rows a host
    whole = cut(parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(step, kind), "wrappers")
    slots = _read(pages.join(whole, "host").select("host", "html", "wrapper"))
    slots = slots.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], (F.min("low") == F.max("high")).alias("fixed"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "links", "fixed")).alias("slots"))

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            readings = [Reading(text) for text in pdf["wrapper"]]
            for reading, found in zip(readings, pdf["slots"], strict=True):
                decide(reading, {s["slot"]: (s["pages"], s["chars"], s["links"], s["fixed"]) for s in ([] if found is None else found)})
            yield pdf[["host", "wrapper"]].assign(marked=[x.marked for x in readings], verdict=[bytes(x.verdict) for x in readings])

    return cut(whole.join(slots, "host", "left").mapInPandas(decided, "host string, wrapper string, marked boolean, verdict binary"), "decided")


def extract_main(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    wrappers = infer_wrappers(pages, url_col=url_col, html_col=html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", _host("url")).join(wrappers, "host", "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Reading] = {}
        for batch in batches:
            texts = []
            for page, *key in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                key = tuple(key)
                if page and key[0] is not None and key not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[key] = Reading(key[0], list(key[2]), key[1])
                texts.append(extract(page, known.get(key)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.select("page_id", "url", "html", "wrapper", "marked", "verdict").mapInArrow(step, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
