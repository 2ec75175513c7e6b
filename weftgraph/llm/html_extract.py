"""Main-text extraction by union-free wrappers inferred for each host.

A page is a stream of block tags and texts, read into a tree; inline tags are
transparent. Its union-free expression has no alternatives: siblings and runs of
siblings that repeat fold into repeated groups. Expressions of a host are aligned:
children are matched in order by longest common subsequence, what only one side
has becomes optional, what both have is united, and texts become slots. A slot
keeps on how many pages it stands, how much text and link text it held, and which
texts all of these pages share, the template's; the rest are what differs.

The wrapper decides which slots hold articles: those in the outermost elements
marked as article or main, else those in the lowest element that holds all text
which is neither a template's nor a menu's. A page is read through the wrapper:
its expression is aligned with it, and a text stays if the slot it falls into is
chosen and doesn't count it as template.

Pages of one expression are added up by slot before anything is aligned. Different
expressions of a host are aligned in sorted order, first within buckets by their
hash, then one bucket's with the next, so a wrapper is the same for any
partitioning; a task holds one expression at a time, whatever the host's size.

Nothing recurses over the depth of a page, and every token is read once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ensure_checkpoint_dir

_REST = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
#: Always matches; what isn't closed goes on to the page's end.
TOKEN = re.compile(
    r"(?P<text>[^<]++)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>" + _REST + r")(?:>|\Z)"
    r"|<!--(?P<comment>)"
    r"|<[!?/](?P<other>)"
    r"|(?P<sign><)",
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Elements whose content is no text: up to their end, else the page's; the others only if they have an end.
RAW = frozenset("script style title textarea iframe noscript template".split())
SKIPPED = frozenset("svg object canvas".split())
BLOCK = frozenset(
    "html head body article main section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary fieldset button select option dialog menu search hr center".split()
)
VOID = frozenset("br hr img input meta link base area col embed source track wbr".split())
HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements an opening tag ends if no other block than p is opened within.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
NOT_TEXT = frozenset("head nav header footer aside form button select menu dialog search".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of classes and ids that mark what isn't the article.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar pagination pager comment comments disqus respond replies related recommended "
    "share sharing social newsletter subscribe subscription signup login search skip copyright".split()
)
#: Words that may stand beside these in a name, as in comment-list; other ones make it another name, as in no-comments.
BESIDE = frozenset(
    "list lists item items box boxes area areas wrapper wrap container block section inner outer holder slot unit bar link links icon icons button buttons form panel region zone "
    "site top bottom left right main primary secondary global mobile desktop fixed sticky posts articles stories".split()
)
WORD = re.compile(r"[a-z]+")
PARTS = re.compile(r"[-_]+")
#: Buckets of a host's expressions, and the host's share of all pages over which its pages are dealt out.
BUCKETS, SHARE = 4096, 1024
#: Wrappers of so many bytes together go to all workers; more meet their pages by a sort.
SMALL_BYTES = 16_000_000
#: Bytes of expressions that a worker holds before it hands them on or forgets them.
HELD_BYTES = 32_000_000
#: Pages of a host from which on, and the share of differing text over which, shared texts count as template.
MIN_PAGES, MIN_DIFFERING = 3, 1 / 4


@lru_cache(10_000)
def _is_boilerplate(name: str) -> bool:
    """Does a class or an id, of words joined by - or _, name what isn't the article."""
    words = {w for w in PARTS.split(name) if w}
    return not words.isdisjoint(NOT_TEXT_WORDS) and words <= NOT_TEXT_WORDS | BESIDE


class Node:
    __slots__ = ("key", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        boilerplate, content, name = tag in NOT_TEXT, tag in ("article", "main"), ""
        if attrs:
            for k, v in ATTRIBUTE.findall(attrs):
                words = WORD.findall(v.lower())
                if k.lower() in ("class", "id"):
                    boilerplate |= not content and tag not in ("html", "body") and any(map(_is_boilerplate, v.lower().strip("\"'").split()))
                    name = name or "".join(words[:1])
                elif k.lower() == "role":
                    boilerplate |= not NOT_TEXT_ROLES.isdisjoint(words)
                    content |= "main" in words or "article" in words
                else:
                    content |= "articlebody" in words
        self.key = tag + ("!" if boilerplate else "@" if content else "") + ("." + name if name else "")


class Text:
    __slots__ = ("linked", "parts", "slot", "words")

    def __init__(self):
        self.parts, self.linked = [], 0


def parse(page: str) -> Node:
    """The tree of blocks and texts."""
    root = Node("#root")
    stack, opened, linked, text = [root], {}, 0, None
    no_end: set[str] = set()
    token, at, size = TOKEN.match, 0, len(page)
    while at < size:
        m = token(page, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "text" or kind == "sign":
            s = m[kind]
            if text is None:
                if s.isspace():
                    continue
                text = Text()
                stack[-1].kids.append(text)
            text.parts.append(s)
            if linked:
                text.linked += len(s)
            continue
        if kind == "comment":
            # an end may overlap the opening sign, as in <!-->
            close = page.find("-->", at - 2)
            at = size if close < 0 else max(at, close + 3)
            continue
        if kind == "other":
            close = page.find(">", at)
            at = size if close < 0 else close + 1
            continue
        tag, ending = m["tag"].lower(), m["end"]
        if not ending and (tag in RAW or tag in SKIPPED) and tag not in no_end:
            close = _closing(tag).search(page, at)
            if close is not None:
                at = close.end()
                continue
            if tag in RAW:
                break
            no_end.add(tag)
        if tag not in BLOCK:
            if tag == "a":
                linked = 0 if ending else 1
            elif tag == "br" and text is not None:
                text.parts.append(" ")
            continue
        text, linked = None, 0
        if ending:
            if opened.get(tag):
                while True:
                    gone = stack.pop().tag
                    opened[gone] -= 1
                    if gone == tag:
                        break
            continue
        if stack[-1].tag == "head" and tag not in HEAD or stack[-1].tag == "p":
            opened[stack.pop().tag] -= 1
        ends = ENDS.get(tag)
        if ends:
            k = last = len(stack)
            while k > 1:
                k -= 1
                t = stack[k].tag
                if t in ends:
                    last = k
                    if tag != "tr":
                        break
                elif t != "p":
                    break
            for gone in stack[last:]:
                opened[gone.tag] -= 1
            del stack[last:]
        if tag in VOID:
            continue
        node = Node(tag, m["attrs"])
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


_closings: dict[str, re.Pattern] = {}


def _closing(tag: str) -> re.Pattern:
    if tag not in _closings:
        _closings[tag] = re.compile(rf"</{tag}\s*>", re.I)
    return _closings[tag]


class Expr:
    """A part of an expression. key: # of a text slot, () of a group, else the element's.

    shape: what must be equal for expressions to match: the key, for a group those
    within. times: 1, ?, + or *. A slot has pages, chars, linked and shared (hash of
    each text that all its pages share, and the characters of it that aren't
    linked); texts are the page's own. sources: what is to be united, until settle().
    """

    __slots__ = ("chars", "key", "kids", "linked", "pages", "shape", "shared", "sources", "texts", "times", "within")

    def __init__(self, key: str, times: str = "1", kids: list | None = None, shape: str | None = None):
        self.key, self.times, self.kids, self.sources = key, times, kids if kids is not None else [], None
        self.shape = shape or (key if key != "()" else f"({' '.join(k.shape for k in self.kids)})")

    def optional(self) -> Expr:
        if self.times in "?*":
            return self
        e = _copy(self)
        e.times = "?" if self.times == "1" else "*"
        return e


def _copy(e: Expr) -> Expr:
    new = Expr(e.key, e.times, e.kids, e.shape)
    new.sources = e.sources
    if e.sources is not None:
        new.within = e.within
    elif e.key == "#":
        new.pages, new.chars, new.linked, new.shared, new.texts = e.pages, e.chars, e.linked, e.shared, e.texts
    return new


def _times(parts: list[Expr]) -> str:
    return "1?+*"[any(e.times in "?*" for e in parts) + 2 * any(e.times in "+*" for e in parts)]


def _pending(sources: list[Expr], within: bool, times: str) -> Expr:
    """All sources, of one shape, as one; within: they stand on the same pages."""
    first = sources[0]
    e = Expr(first.key, times, None, first.shape)
    e.sources, e.within = [], within
    for s in sources:
        if s.sources is not None and s.within == within:
            e.sources += s.sources
        else:
            e.sources.append(s)
    return e


def _settle(e: Expr) -> None:
    """Gives a pending expression its own values; its children may be pending then.

    Sources that are pending themselves stand on different pages and have settled
    sources, so this calls itself once at most.
    """
    sources, within, e.sources = e.sources, e.within, None
    for s in sources:
        if s.sources is not None:
            _settle(s)
    if e.key == "#":
        _add_up(e, sources, within)
        return
    alike: dict[tuple, list[list[Expr]]] = {}
    for s in sources:
        alike.setdefault(tuple(k.shape for k in s.kids), []).append(s.kids)
    kids: list[Expr] | None = None
    for lists in alike.values():
        own = lists[0] if len(lists) == 1 else [_pending(list(c), within, _times(c)) for c in zip(*lists, strict=True)]
        kids = own if kids is None else align(kids, own, within)
    e.kids = kids or []


def _add_up(e: Expr, slots: list[Expr], within: bool) -> None:
    e.chars, e.linked = sum(s.chars for s in slots), sum(s.linked for s in slots)
    e.texts = [t for s in slots for t in s.texts]
    if within:
        # a slot that stands on all pages says what all pages share; else pages is a lower bound, and shared never counts
        e.pages = max(s.pages for s in slots)
        e.shared = {h: n for s in slots if s.pages == e.pages for h, n in s.shared.items()}
    else:
        e.pages = sum(s.pages for s in slots)
        common = set.intersection(*(set(s.shared) for s in slots))
        e.shared = {h: min(s.shared[h] for s in slots) for h in common}


def unite(sources: list[Expr], within: bool = False) -> Expr:
    """All as one expression; they must have one shape."""
    whole = _pending(sources, within, _times(sources))
    todo = [whole]
    while todo:
        e = todo.pop()
        if e.sources is not None:
            _settle(e)
            todo += e.kids
    return whole


def merge(a: Expr, b: Expr) -> Expr:
    """Expressions of different pages as one."""
    return unite([a, b])


def _matched(p: list[str], q: list[str], masks: dict[str, int]) -> np.ndarray:
    """Length of the longest common subsequence of p and each prefix of q, by bits of long integers."""
    full = (1 << len(q)) - 1
    v = full
    for x in p:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _masks(q: list[str]) -> dict[str, int]:
    places: dict[str, list[int]] = {}
    for k, x in enumerate(q):
        places.setdefault(x, []).append(k)
    out = {}
    for x, at in places.items():
        bits = np.zeros(len(q), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def common_subsequence(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, ascending; p is halved until a part has one match, so memory is linear."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and p[a] == q[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and p[b - 1] == q[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            at = next((k for k in range(c, d) if q[k] == p[a]), None)
            if at is not None:
                pairs.append((a, at))
            continue
        mid, part = (a + b) // 2, q[c:d]
        before = _matched(p[a:mid], part, _masks(part))
        part = part[::-1]
        after = _matched(p[mid:b][::-1], part, _masks(part))
        k = c + int(np.argmax(before + after[::-1]))
        todo += [(a, mid, c, k), (mid, b, k, d)]
    return sorted(pairs)


def align(a: list[Expr], b: list[Expr], within: bool = False) -> list[Expr]:
    """Both lists in order, matching ones pending as one, the others optional."""
    out: list[Expr] = []
    i = j = 0
    for x, y in [*common_subsequence([e.shape for e in a], [e.shape for e in b]), (len(a), len(b))]:
        for e in (*(e.optional() for e in a[i:x]), *(e.optional() for e in b[j:y])):
            _put(out, e)
        if x < len(a):
            _put(out, _pending([a[x], b[y]], within, _times([a[x], b[y]])))
        i, j = x + 1, y + 1
    return out


def _put(out: list[Expr], e: Expr) -> None:
    """e behind the others; if the last has its shape, as alignment can leave them side by side, both as one."""
    if out and out[-1].shape == e.shape:
        out[-1] = _pending([out[-1], e], True, "*" if out[-1].times in "?*" and e.times in "?*" else "+")
    else:
        out.append(e)


def fold(kids: list[Expr]) -> list[Expr]:
    """Neighbours that repeat as one of multiplicity +; then runs that repeat, from one to the next of its first shape, as a group, until none is left."""
    out: list[Expr] = []
    i = 0
    while i < len(kids):
        j = i + 1
        while j < len(kids) and kids[j].shape == kids[i].shape:
            j += 1
        out.append(kids[i] if j == i + 1 else _united(kids[i:j], "+"))
        i = j
    while True:
        shapes, done, i = [k.shape for k in out], [], 0
        nearest: dict[str, int] = {}
        following = [0] * len(out)
        for k in range(len(out) - 1, -1, -1):
            following[k] = nearest.get(shapes[k], 0)
            nearest[shapes[k]] = k
        while i < len(out):
            j, n = i, following[i] - i
            while n > 1 and j + 2 * n <= len(out) and shapes[j + 1] == shapes[j + n + 1] and shapes[j + n : j + 2 * n] == shapes[i : i + n]:
                j += n
            if j == i:
                done.append(out[i])
                i += 1
                continue
            body = []
            for c in range(n):
                column = out[i + c : j + n : n]
                body.append(_united(column, _times(column)))
            done.append(Expr("()", "+", body))
            i = j + n
        if len(done) == len(out):
            return out
        out = done


def _united(parts: list[Expr], times: str) -> Expr:
    e = unite(parts, True)
    e.times = times
    return e


def expression(root: Node) -> Expr:
    """A page's expression. Texts without characters don't count."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    made: dict[int, Expr] = {}
    for node in reversed(order):
        kids = []
        for k in node.kids:
            if isinstance(k, Node):
                kids.append(made.pop(id(k)))
                continue
            k.words = " ".join(unescape("".join(k.parts)).split())
            if k.words:
                e, n = Expr("#"), len(k.words)
                linked = min(k.linked, n)
                e.pages, e.chars, e.linked, e.texts = 1, n, linked, [k]
                e.shared = {xxhash.xxh64_intdigest(k.words) - (1 << 63): n - linked}
                kids.append(e)
        made[id(node)] = Expr(node.key, kids=fold(kids))
    return made[id(root)]


def preorder(e: Expr) -> list[Expr]:
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def written(e: Expr) -> str:
    """The expression as text: # is a slot, = one that holds the same text on all its pages."""
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        times = "" if x.times == "1" else x.times
        if x.key == "#":
            out.append(("=" if len(x.shared) == 1 and sum(x.shared.values()) * x.pages == x.chars - x.linked else "#") + times)
        elif x.kids or x.key == "()":
            out.append("(" if x.key == "()" else x.key + "(")
            todo.append(")" + times)
            for n, k in enumerate(reversed(x.kids)):
                todo += [" ", k] if n else [k]
        else:
            out.append(x.key + times)
    return "".join(out)


def packed(e: Expr) -> tuple[str, np.ndarray]:
    """The expression without its slots' values; these: pages, chars, linked, number of shared texts, then their hashes and characters."""
    parts, values = [], []
    for x in preorder(e):
        parts.append(f"{x.key},{x.times},{len(x.kids)}")
        if x.key == "#":
            values += [x.pages, x.chars, x.linked, len(x.shared)]
            for h in sorted(x.shared):
                values += [h, x.shared[h]]
    return " ".join(parts), np.array(values, np.int64)


def unpacked(text: str, values: np.ndarray) -> Expr:
    nodes, at, v = [], 0, values.tolist()
    for part in text.split(" "):
        key, times, n = part.split(",")
        e = Expr(key, times, None, "")
        nodes.append((e, int(n)))
        if key == "#":
            e.pages, e.chars, e.linked, m = v[at : at + 4]
            e.shared, e.texts = dict(zip(v[at + 4 : at + 4 + 2 * m : 2], v[at + 5 : at + 5 + 2 * m : 2], strict=True)), []
            at += 4 + 2 * m
    # from the last one on, the children of a node are the last that have no parent
    free: list[Expr] = []
    for e, n in reversed(nodes):
        e.kids = free[: -n - 1 : -1] if n else []
        del free[len(free) - n :]
        e.shape = e.key if e.key != "()" else f"({' '.join(k.shape for k in e.kids)})"
        free.append(e)
    return free[0]


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of the slots of two expressions, alike but for these, on different pages."""
    out: list[int] = []
    p, q, i, j = a.tolist(), b.tolist(), 0, 0
    while i < len(p):
        m, n = p[i + 3], q[j + 3]
        x, y = (dict(zip(v[k + 4 : k + 4 + 2 * c : 2], v[k + 5 : k + 5 + 2 * c : 2], strict=True)) for v, k, c in ((p, i, m), (q, j, n)))
        both = sorted(x.keys() & y.keys())
        out += [p[i] + q[j], p[i + 1] + q[j + 1], p[i + 2] + q[j + 2], len(both)]
        for h in both:
            out += [h, min(x[h], y[h])]
        i, j = i + 4 + 2 * m, j + 4 + 2 * n
    return np.array(out, np.int64)


def _children(e: Expr) -> list[Expr]:
    """Children, with those of groups in the groups' place."""
    out, todo = [], list(reversed(e.kids))
    while todo:
        k = todo.pop()
        if k.key == "()":
            todo += reversed(k.kids)
        else:
            out.append(k)
    return out


def _tag(e: Expr) -> str:
    return re.split(r"[!@.]", e.key, maxsplit=1)[0]


class Wrapper:
    """An expression and which of its slots hold articles.

    regions: elements in which articles stand. chosen: their slots, each with the
    hashes of texts that are template.
    """

    def __init__(self, whole: Expr, pages: int):
        self.whole = whole
        self.kids: dict[int, list[Expr]] = {}
        order, todo = [], [whole]
        while todo:
            e = todo.pop()
            order.append(e)
            self.kids[id(e)] = _children(e)
            todo += reversed(self.kids[id(e)])
        self.order = order
        self._exempt()
        self.template: dict[int, dict[int, int]] = {}
        self.regions = self._marked() or self._unmarked(pages)
        self.chosen = {id(e): frozenset(self.template.get(id(e), ())) for r in self.regions for e in self._within([r]) if e.key == "#"}
        self.region_ids = {id(e) for e in self.regions}

    def _boilerplate(self, e: Expr) -> bool:
        return "!" in e.key and id(e) not in self.exempt

    def _within(self, todo: list[Expr]) -> Iterator[Expr]:
        """These and all below that isn't boilerplate."""
        todo = list(reversed(todo))
        while todo:
            e = todo.pop()
            if not self._boilerplate(e):
                yield e
                todo += reversed(self.kids[id(e)])

    def _sums(self, own: Callable[[Expr], tuple]) -> dict[int, tuple]:
        """own() of each part, added up with that of all below."""
        sums: dict[int, tuple] = {}
        for e in reversed(self.order):
            sums[id(e)] = tuple(map(sum, zip(own(e), *(sums[id(k)] for k in self.kids[id(e)]), strict=True)))
        return sums

    def _exempt(self) -> None:
        """Boilerplate that holds the article isn't any: all marks, or, of what has blocks, most of the text that isn't linked."""
        plain: dict[int, int] = {}
        marked: dict[int, int] = {}
        free: dict[int, int] = {}
        inside: dict[int, bool] = {id(self.whole): False}
        for e in self.order:
            for k in self.kids[id(e)]:
                inside[id(k)] = inside[id(e)] or "!" in k.key
        for e in reversed(self.order):
            kids = [id(k) for k in self.kids[id(e)]]
            n = e.chars - e.linked if e.key == "#" else sum(plain[k] for k in kids)
            plain[id(e)] = n
            marked[id(e)] = n if "@" in e.key else sum(marked[k] for k in kids)
            free[id(e)] = (0 if inside[id(e)] else n) if "@" in e.key else sum(free[k] for k in kids)
        whole, marks = plain[id(self.whole)], marked[id(self.whole)]
        self.exempt: set[int] = set()
        if free[id(self.whole)]:
            return
        for e in self.order:
            if "!" in e.key and _tag(e) != "head":
                blocks = any(k.key != "#" for k in self.kids[id(e)])
                if 2 * marked[id(e)] > marks if marks else blocks and 2 * plain[id(e)] > whole and (_tag(e) not in NOT_TEXT or _tag(e) == "form"):
                    self.exempt.add(id(e))

    def _marked(self) -> list[Expr]:
        """The outermost marked elements with text that isn't boilerplate."""
        out, todo = [], [self.whole]
        while todo:
            e = todo.pop()
            if self._boilerplate(e):
                continue
            if "@" not in e.key:
                todo += reversed(self.kids[id(e)])
            elif any(x.key == "#" and x.chars for x in self._within([e])):
                out.append(e)
        return out

    def _unmarked(self, pages: int) -> list[Expr]:
        """The lowest element that holds all text of articles; its like among its siblings, if these hold some as well."""
        slots = [e for e in self._within([self.whole]) if e.key == "#"]
        if pages >= MIN_PAGES:
            shared = {id(e): e.shared for e in slots if e.pages == pages and e.shared}
            plain = sum(e.chars - e.linked for e in slots)
            differing = plain - pages * sum(sum(x.values()) for x in shared.values())
            if differing > 0 and differing >= MIN_DIFFERING * plain:
                self.template = shared
        free = {id(e) for e in slots if e.chars - e.linked > pages * sum(self.template.get(id(e), {}).values())}
        reached = {id(e) for e in self._within([self.whole])}
        holds = self._sums(lambda e: (id(e) in free,))
        at = self.whole
        while True:
            some = [k for k in self.kids[id(at)] if id(k) in reached and holds[id(k)][0]]
            if len({k.key for k in some}) != 1 or some[0].key == "#":
                return [at]
            if len(some) > 1:
                return [k for k in self.kids[id(at)] if k.key == some[0].key and id(k) in reached]
            at = some[0]

    def places(self, page: Expr) -> tuple[bool, list[frozenset | None]]:
        """Has the page a region; for each slot of its expression in order: None if it isn't chosen, else the template texts."""
        found = False
        slots: dict[int, frozenset | None] = {}
        todo = [(page, self.whole)]
        while todo:
            e, w = todo.pop()
            if e.key == "#":
                slots[id(e)] = self.chosen.get(id(w))
                continue
            found |= id(w) in self.region_ids
            own, held = _children(e), self.kids.get(id(w), [])
            at = dict(common_subsequence([k.key for k in own], [k.key for k in held]))
            least: dict[str, Expr] = {}
            for k in held:
                least.setdefault(k.key, k)
            for i, k in enumerate(own):
                # one that the order leaves out falls to the first of its key
                other = held[at[i]] if i in at else least.get(k.key)
                if other is not None:
                    todo.append((k, other))
        return found, [slots.get(id(e)) for e in preorder(page) if e.key == "#"]


def decide(e: Expr, pages: int) -> Wrapper:
    return Wrapper(e, pages)


@dataclass
class Page:
    """A page's expression, in parts, and its texts in order, each with the number of its slot."""

    whole: Expr
    text: str
    values: np.ndarray
    texts: list[Text]


def read_page(html: str | None) -> Page:
    tree = parse(html or "")
    whole = expression(tree)
    text, values = packed(whole)
    n, number = 0, {}
    for e in preorder(whole):
        if e.key == "#":
            for t in e.texts:
                number[id(t)] = n
            n += 1
    texts, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += reversed(x.kids)
        elif id(x) in number:
            x.slot = number[id(x)]
            texts.append(x)
    return Page(whole, text, values, texts)


def main_text(html: str | None, wrapper: Wrapper | None, known: dict | None = None) -> str:
    """Blocks of the article, joined by two line ends. A page without any region of the wrapper, or without a wrapper, is one by itself.

    known: places of earlier pages' expressions in this wrapper.
    """
    if not html:
        return ""
    page = read_page(html)
    found, slots = False, []
    if wrapper is not None:
        at = None if known is None else known.get(page.text)
        if at is None:
            at = wrapper.places(page.whole)
            if known is not None:
                known[page.text] = at
        found, slots = at
    if not found:
        slots = Wrapper(page.whole, 1).places(page.whole)[1]
    blocks = []
    for t in page.texts:
        template = slots[t.slot]
        if template is not None and not (template and xxhash.xxh64_intdigest(t.words) - (1 << 63) in template):
            blocks.append(t.words)
    return "\n\n".join(blocks)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1), F.lit("")))


KINDS = "host string, n_pages long, expression string, slots binary"
_COLUMNS = (pa.string(), pa.int64(), pa.string(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _COLUMNS, strict=True)], ["host", "n_pages", "expression", "slots"])


def _aligned(rows: DataFrame, by: str) -> DataFrame:
    """One expression for each host and value of by: those of the rows, equal ones added up, then aligned in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, whole, text, values = None, 0, None, None, None

        def take() -> None:
            nonlocal whole
            if text is not None:
                e = unpacked(text, values)
                whole = e if whole is None else merge(whole, e)

        for batch in batches:
            done = []
            for host, n, t, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(raw, np.int64)
                if (host, part) != group:
                    take()
                    if group is not None:
                        done.append((group[0], total, *_bytes(whole)))
                    group, total, whole, text, values = (host, part), n, None, t, v
                    continue
                total += n
                if t == text:
                    values = added(values, v)
                else:
                    take()
                    text, values = t, v
            if done:
                yield _batch(done)
        take()
        if group is not None:
            yield _batch([(group[0], total, *_bytes(whole))])

    # rows of one expression stand together, and their sums don't depend on their order
    dealt = rows.withColumn("part", F.expr(by)).repartition("host", "part").sortWithinPartitions("host", "part", "expression")
    return dealt.select("host", "n_pages", "expression", "slots", "part").mapInArrow(run, KINDS)


def _bytes(e: Expr) -> tuple[str, bytes]:
    text, values = packed(e)
    return text, values.tobytes()


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, n_pages, expression, slots (the values of its slots). Pages without a host have no wrapper."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[int, np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(h, n, t, v.tobytes()) for (h, t), (n, v) in held.items()]
            held.clear()
            return _batch(rows)

        for batch in batches:
            for part in chunks(batch):
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text, values = packed(expression(parse(html or "")))
                    n, before = held.get((host, text), (0, None))
                    if before is None:
                        size += len(text) + values.nbytes
                    held[host, text] = n + 1, values if before is None else added(before, values)
                if size > HELD_BYTES:
                    size = 0
                    yield out()
        if held:
            yield out()

    rows = pages.select(host_of(F.col(url_col)).alias("host"), html_col).filter("host <> ''").mapInArrow(infer, KINDS)
    return _aligned(_aligned(rows, f"pmod(xxhash64(expression), {BUCKETS})"), "0")


class _Wrappers:
    """Wrappers by host, made when they are met and forgotten when they are many."""

    def __init__(self):
        self.held, self.size = {}, 0

    def text(self, html: str | None, host: str, row: tuple | None) -> str:
        """row: expression, slots and number of pages."""
        if self.size > HELD_BYTES:
            self.held, self.size = {}, 0
        if host not in self.held:
            self.held[host] = (None if row is None else Wrapper(unpacked(row[0], np.frombuffer(row[1], np.int64)), row[2])), {}
            # a part of an expression takes some hundred bytes
            self.size += 20 * len(row[0]) if row else 100
        wrapper, known = self.held[host]
        n = len(known)
        out = main_text(html, wrapper, known)
        if len(known) > n:
            self.size += 2 * len(next(reversed(known)))
        return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id (as given), url, text. Null or empty html, and pages without an article, give empty text.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    and reader comments are left out; character references are decoded, white
    space within a block becomes one space. Among marks the outermost wins; of
    equal pages each counts. A page may be of any length and depth. A null or
    repeated page_id, or a url without a host, is a row like any other; pages
    without a host are read by themselves. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    held = wrappers(pages, url_col, html_col).checkpoint()
    size, total = held.agg(F.sum(F.length("expression") + F.octet_length("slots")), F.sum("n_pages")).first()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    result = f"page_id {kind}, url string, text string"

    if (size or 0) <= SMALL_BYTES:
        shared = spark.sparkContext.broadcast({r.host: (r.expression, bytes(r.slots), r.n_pages) for r in held.collect()})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, every = _Wrappers(), shared.value
            for batch in batches:
                for part in chunks(batch, 3):
                    texts = [known.text(html, host, every.get(host)) for host, html in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return rows.mapInArrow(read, result)

    # pages follow their host's wrapper in a sort; fewer than SHARE hosts have over a share of all pages, and are dealt out
    hot = held.filter(F.col("n_pages") * SHARE > total).select("host", F.expr(f"cast(n_pages * {SHARE} div {total} + 1 as int)").alias("parts"))
    rows = rows.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))))
    first = held.join(F.broadcast(hot), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
    # of pages without a host none has a wrapper, so they may stand anywhere
    apart = F.when(F.col("host") == "", F.xxhash64("page_id", "html")).otherwise(F.col("part"))
    none = F.lit(None)
    both = rows.select("page_id", "url", "host", "html", apart.alias("part"), none.cast("string").alias("expression"), none.cast("binary").alias("slots"), none.cast("long").alias("n_pages"), F.lit(1).alias("after"))
    both = both.unionByName(first.select(none.cast(kind).alias("page_id"), none.cast("string").alias("url"), "host", none.cast("string").alias("html"), "part", "expression", "slots", "n_pages", F.lit(0).alias("after")))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, row = _Wrappers(), None, None
        for batch in batches:
            for part in chunks(batch, 3):
                texts, keep = [], []
                for i, (host, html, e, slots, n, after) in enumerate(zip(*(part.column(k).to_pylist() for k in (2, 3, 5, 6, 7, 8)), strict=True)):
                    if host != last:
                        last, row = host, None
                    if not after:
                        row = e, slots, n
                    else:
                        keep.append(i)
                        texts.append(known.text(html, host, row))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.repartition("host", "part").sortWithinPartitions("host", "part", "after").mapInArrow(follow, result)
