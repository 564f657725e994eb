"""Main text of web pages, by union-free regular-expression inference of page wrappers.

A page is parsed once, into a stream of block tokens (a text block's containers) with their
texts. Runs that repeat become iterators; the streams of one host are aligned two at a time,
and what one of them lacks becomes optional, until one union-free expression, the host's
wrapper, matches all. Each page's stream is then matched to it, which gives every block its
text slot. What a slot holds over the host's pages decides: a slot with one text is template,
a slot of links a menu, all else data; of the data slots, those under the container that holds
most of the text are the article. An article or main element, where a page has one, bounds the
text. Elements and class words that name what is no article text (menus, forms, adverts,
comments, ...) are left out where the name says nothing else; a name that says more (has-sidebar,
share-price) only makes its slot go if the wrapper finds it template or links.

Pages of one host first shrink to their distinct streams (pre-aggregated), which are aligned
in salted groups of bounded size, level by level; a host with a third of all pages is never
gathered. After the parse all is joins and counts over hashes of texts."""

from __future__ import annotations

import html
import json
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Shelf, arrow_rows

#: A tag ends before the next "<"; a quote that does not close before it is a stray character.
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|</?[a-zA-Z][^<>]*+>|<[!?][^<>]*+>")
#: A tag with "<" inside a quoted value.
_QUOTED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_MAYBE = re.compile(r"<[a-zA-Z][a-zA-Z0-9-]*+[^<>]*[\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"class\s*=\s*(?:\"\s*([^\"]*)\"|'\s*([^']*)'|([^\s\"'>]+))", re.I)
# Elements, and the words in class, id and role that mark what is no article text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th".split())
DROPPED = frozenset("aside dialog footer form menu nav".split())
CONTENT = frozenset("article main".split())
#: Elements whose contents are no markup, up to their end tag or the page's end; and elements without text to read.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
MUTED = frozenset("head noscript template svg select button object".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Marks of what is no article even if it holds an article element; the other marks may name a layout around the article.
APART = frozenset("ad ads adbox adslot advert adverts advertisement advertising comment comments disqus promo promoted promotion recommended related replies reply respond sponsor sponsored widget".split())
#: Words that leave a mark what it is: "comment-list" is comments, "comment-free" may be anything.
FRAME = frozenset(
    "area bar block bottom box button buttons container content count field footer group head header icon icons inner item items label large layout left line link links list main middle module outer page panel post posts primary right row secondary section site slot small text title top unit wrap wrapper".split()
)
#: Words that say as much inside an article element; there "section", "content", "title" may be its own parts.
INNER_FRAME = FRAME - frozenset("content head header main page post posts primary section text title".split())
#: A slot is template if this part of its distinct pages, two at least, hold one text there; it is a
#: list of links if this part of its characters is linked; the article's container holds this part of the text.
TEMPLATE_PART, TEMPLATE_PAGES, LINK_PART, REGION_PART = 0.8, 2, 0.6, 0.7
#: Distinct streams aligned in one group.
GROUP = 64
#: Runs of up to this product of lengths are aligned by difflib, longer ones by ranks of their parts: the same blocks.
SHORT = 40_000


def _names(tag: str, attributes: str, marks: frozenset, frame: frozenset = FRAME | MARKS) -> tuple[bool, bool]:
    """(a name is a mark and nothing else, a name holds a mark among other words)."""
    sure = perhaps = False
    if tag in ("html", "body", "main"):
        return sure, perhaps
    if tag == "article":
        marks = marks & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "promo", "related"}
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = {w for w in re.split(r"[^a-z]+", name) if w}
            if words & marks:
                if words <= marks | frame:
                    sure = True
                else:
                    perhaps = True
    return sure, perhaps


class Page:
    """A page's text blocks in page order: tokens (the last four containers with the letters of their first
    class; .x marked, .y perhaps),
    texts, states (0 marked as no article text, 1 not decided, 2 inside an article or main
    element), linked characters, innermost elements; and each element's parent (-1: none)."""

    def __init__(self, page: str):
        self.tokens: list[str] = []
        self.texts: list[str] = []
        self.states: list[int] = []
        self.linked: list[int] = []
        self.inside: list[int] = []
        self.parents: list[int] = []
        # Open elements: (tag, state inside, last four names, number); states -1 marked as a layout, 3 an article in one,
        # 4 marked inside an article, which has these blocks where it has no others.
        self._stack: list[tuple[str, int, tuple, int]] = []
        self._open: dict[str, int] = {}
        self._parts: list[str] = []
        self._links = self._muted = self._raised = 0
        self._in_link = False
        self._read(page)
        final = {-1: 0, 3: 0 if 2 in self.states else 2, 4: 0 if {2, 3} & {*self.states} else 2}
        self.states = [final.get(s, s) for s in self.states]

    def _close(self) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split())
        if text:
            _, state, names, number = self._stack[-1] if self._stack else ("", 1, (), -1)
            self.tokens.append("/".join(names) or "#")
            self.texts.append(text)
            self.states.append(state)
            self.linked.append(min(len(text), self._links))
            self.inside.append(number)
        self._parts.clear()
        self._links = 0

    def _text(self, text: str) -> None:
        if text and not self._muted:
            self._parts.append(text)
            if self._in_link:
                self._links += len(text)

    def _push(self, tag: str, state: int, names: tuple) -> None:
        self.parents.append(self._stack[-1][3] if self._stack else -1)
        self._stack.append((tag, state, names, len(self.parents) - 1))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._muted += tag in MUTED
        self._raised += state <= 0 and tag not in ("nav", "header")

    def _pop(self) -> str:
        tag, state, _, _ = self._stack.pop()
        self._open[tag] -= 1
        self._muted -= tag in MUTED
        self._raised -= state <= 0 and tag not in ("nav", "header")
        return tag

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            while self._pop() != tag:
                pass

    def _read(self, page: str) -> None:
        at, whole = 0, True
        while m := _TOKEN.search(page, at):
            if whole and (stray := page.find("<", at, m.start())) >= 0 and (perhaps := _MAYBE.search(page, stray, m.start())):
                quoted = _QUOTED.match(page, perhaps.start())
                # One that runs to the page's end in vain tells that quotes do not close here.
                whole = quoted is not None
                m = quoted or m
            self._text(page[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                stop = page.find("-->", at)
                at = len(page) if stop < 0 else stop + 3
                continue
            tag = (m[2] or "").lower() if m.lastindex else ""
            if tag in RAW and not m[1]:
                found = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(page, at)
                at = found.end() if found else len(page)
                self._text(" ")
            elif tag == "a":
                self._in_link = not m[1]
            elif tag in SPACES:
                self._text(" ")
            elif tag in MUTED:
                self._text(" ")
                if m[1]:
                    self._end(tag)
                elif not m[3].endswith("/"):
                    top = self._stack[-1] if self._stack else ("", 1, (), -1)
                    self._push(tag, top[1], top[2])
            elif tag in BLOCKS:
                self._block(tag, bool(m[1]), m[3] or "")
        self._text(page[at:])
        self._close()

    def _block(self, tag: str, ends: bool, attributes: str) -> None:
        if self._open.get("head") and not ends:
            self._end("head")
        if self._muted:
            top = self._stack[-1]
            if not ends:
                self._push(tag, top[1], top[2])
            elif self._open.get(tag):
                k = len(self._stack) - 1
                while self._stack[k][0] != tag and self._stack[k][0] not in MUTED:
                    k -= 1
                if self._stack[k][0] != tag:  # it ends what the muted element stands in
                    self._close()
                self._end(tag)
            return
        self._close()
        if ends:
            self._end(tag)
            return
        stack = self._stack
        while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop()
        if tag in ("li", "dt", "dd", "tr") and stack and stack[-1][0] == tag:
            self._pop()
        if tag == "hr":
            return
        state, names = (stack[-1][1], stack[-1][2]) if stack else (1, ())
        sure, perhaps = _names(tag, attributes, MARKS)
        if sure and state in (2, 3) and tag not in CONTENT:
            # Inside an article a name that may be one of its own parts leaves it to the slot.
            sure, perhaps = _names(tag, attributes, MARKS, INNER_FRAME)[0], True
        if state == 3 and tag in CONTENT and not sure:
            pass
        elif tag in CONTENT and not sure and state != 4 and (state > 0 or not self._raised):
            state = 2
        elif tag in CONTENT and not sure and state == -1:
            state = 3
        elif state == 4 or sure and state in (2, 3) and tag not in DROPPED | CONTENT and not _names(tag, attributes, APART, INNER_FRAME)[0]:
            state = 4 if tag not in DROPPED else 0
        elif sure or tag in DROPPED or (tag == "header" and state not in (2, 3)):
            # Inside what is dropped for good, or inside an article, nothing is a layout.
            layout = state in (-1, 1) and (tag == "form" or tag not in DROPPED) and tag not in CONTENT and not _names(tag, attributes, APART)[0]
            state = -1 if layout else 0
        if tag not in ("html", "body"):
            named = _CLASS.search(attributes)
            named = re.sub(r"[^a-z]+", "", (named[1] or named[2] or named[3] or "").lower().split(" ")[0]) if named else ""
            names = (*names, tag + (".x" if sure else ".y" if perhaps else "") + (f"#{named}" if named else ""))[-4:]
        self._push(tag, state, names)


def blocks(page: str) -> list[tuple[str, str, int, float]]:
    """[(token, text, state, share of link text)] of a page's text blocks in page order."""
    p = Page(page)
    return [(k, t, s, n / len(t)) for k, t, s, n in zip(p.tokens, p.texts, p.states, p.linked, strict=True)]


# ---- wrappers: lists of [token or list of items, repeated, optional] ----------
# A page's own items further hold their block numbers, and the elements around the last block.

def _core(item) -> str:
    return item[0] if isinstance(item[0], str) else json.dumps([_core(i) for i in item[0]])


def _fold(items: list) -> list:
    """Turns runs that repeat into iterators, from single items to groups of six."""
    for size in range(1, 7):
        out, at, core = [], 0, [_core(i) for i in items]
        while at < len(items):
            group, cores, end = items[at : at + size], core[at : at + size], at + size
            while len(group) == size and core[end : end + size] == cores and (size > 1 or _kin(group[0], items[end])):
                group = [_joined(a, b) for a, b in zip(group, items[end : end + size], strict=True)]
                end += size
            if end > at + size:
                out.append([group[0][0], True, *group[0][2:]] if size == 1 else [group, True, False])
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _kin(a, b) -> bool:
    """Whether two items with one token can be one run: blocks that stand in one element or in neighbours."""
    return len(a) < 5 or len(b) < 5 or a[4][0] == b[4][0] or a[4][1] == b[4][1]


def _joined(a, b) -> list:
    if isinstance(a[0], str):
        for numbers in b[3:4]:
            a[3].extend(numbers)
        return [a[0], a[1] or b[1], a[2] or b[2], *a[3:4], *b[4:]]
    return [[_joined(x, y) for x, y in zip(a[0], b[0], strict=True)], a[1] or b[1], a[2] or b[2]]


def _with_groups(items: list, groups: list) -> list:
    """Single occurrences of another stream's repeated groups become groups, so that they align."""
    own, seen = [_core(i) for i in items], set()
    for group in groups:
        cores = tuple(_core(i) for i in group[0])
        # What a group turned into groups holds no more of it.
        if cores in seen or seen.add(cores) or not all(c in own for c in cores):
            continue
        out, keys, at, size = [], [], 0, len(cores)
        first, rest, whole = cores[0], list(cores), json.dumps(list(cores))
        while at < len(items):
            if own[at] == first and own[at : at + size] == rest:
                out.append([items[at : at + size], False, False])
                keys.append(whole)
                at += size
            else:
                out.append(items[at])
                keys.append(own[at])
                at += 1
        items, own = out, keys
    return items


def _groups_of(items: list) -> list:
    return [i for i in items if not isinstance(i[0], str)]


def _ranks(items: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... items: a number for the run of that many that begins at each place, equal for equal runs."""
    levels, size = [items], 1
    while 2 * size <= len(items):
        last = levels[-1]
        levels.append(np.unique(last[:-size] * (int(last.max()) + 1) + last[size:], return_inverse=True)[1].astype(np.int64))
        size *= 2
    return levels


def _longest(levels: list[np.ndarray], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """The longest run that lies in [a0, a1) and in [b0, b1), as (place, place, length): of several the
    first in the former, then the first in the latter. Its length is found by halving."""
    def shared(n):
        if n == 0:
            return a0, b0
        k = n.bit_length() - 1
        more, width = n - (1 << k), int(levels[k].max()) + 1
        one, two = (levels[k][x : y - n + 1] * width + levels[k][x + more : y - n + 1 + more] for x, y in ((a0, a1), (b0, b1)))
        both = np.isin(one, two)
        at = int(both.argmax())
        return (a0 + at, b0 + int((two == one[at]).argmax())) if both[at] else None

    low, high = 0, min(a1 - a0, b1 - b0)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return *shared(low), low


def matching_blocks(one: list[str], two: list[str]) -> list[tuple[int, int, int]]:
    """The blocks of SequenceMatcher(None, one, two, autojunk=False): the longest run that both share, then
    the same to its left and to its right. On long sequences of few tokens that class compares all pairs of
    places for each block; here a block of a long part costs a few sorts."""
    codes: dict[str, int] = {}
    numbers = np.array([codes.setdefault(t, len(codes)) for t in (*one, *two)], np.int64)
    levels, shift = [], len(one)
    todo, found = [(0, len(one), 0, len(two))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if (a1 - a0) * (b1 - b0) <= SHORT:
            own = SequenceMatcher(None, one[a0:a1], two[b0:b1], autojunk=False).get_matching_blocks()
            found += [(a0 + i, b0 + j, n) for i, j, n in own if n]
            continue
        levels = levels or _ranks(numbers)
        i, j, n = _longest(levels, a0, a1, shift + b0, shift + b1)
        if n:
            j -= shift
            found.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def align(one: list, two: list) -> list:
    """The union-free expression of both: equal items join, others become optional."""
    one, two = _with_groups(one, _groups_of(two)), _with_groups(two, _groups_of(one))
    out, at, to = [], 0, 0
    for i, j, n in (*matching_blocks([_core(i) for i in one], [_core(i) for i in two]), (len(one), len(two), 0)):
        out += [[x[0], x[1], True] for x in one[at:i] + two[to:j]]
        at, to = i + n, j + n
        out += [_joined(a, b) for a, b in zip(one[i:at], two[j:to], strict=True)]
    return _fold(out)


def expression(items: list) -> str:
    """A wrapper as text: (...)+ repeats, (...)? may lack."""
    return " ".join(
        (i[0] if isinstance(i[0], str) else f"({expression(i[0])})") + ("+" if i[1] else "") + ("?" if i[2] else "") for i in items
    )


def _leaves(items: list):
    for item in items:
        if isinstance(item[0], str):
            yield item
        else:
            yield from _leaves(item[0])


def _plain(items: list) -> list:
    return [[i[0] if isinstance(i[0], str) else _plain(i[0]), i[1], i[2]] for i in items]


def _numbered(page: Page) -> list:
    def around(number):
        above = page.parents[number] if number >= 0 else -1
        return above, page.parents[above] if above >= 0 else -2

    return _fold([[f"{t}:{s}", False, False, [k], around(n)] for k, (t, s, n) in enumerate(zip(page.tokens, page.states, page.inside, strict=True))])


def stream(page_blocks: list) -> list:
    return _fold([[f"{b[0]}:{b[2]}", False, False] for b in page_blocks])


def slots_of(items: list, wrapper: list) -> list[str]:
    """For each leaf of a page's stream, in order, the slot of the host's wrapper that it matches."""
    by_token: dict[str, str] = {}

    def place(wrapper_items, prefix):
        for k, item in enumerate(wrapper_items):
            if isinstance(item[0], str):
                by_token.setdefault(item[0], f"{prefix}{k}")
            else:
                place(item[0], f"{prefix}{k}.")

    place(wrapper, "")
    leaves = list(_leaves(items))
    found: dict[int, str] = {}

    def pair(item, other, slot):
        if isinstance(item[0], str):
            found[id(item)] = slot
        else:
            for k, (x, y) in enumerate(zip(item[0], other[0], strict=True)):
                pair(x, y, f"{slot}.{k}")

    mine = _with_groups(items, _groups_of(wrapper))
    for i, j, n in matching_blocks([_core(i) for i in mine], [_core(i) for i in wrapper]):
        for k in range(n):
            pair(mine[i + k], wrapper[j + k], str(j + k))
    return [found.get(id(leaf)) or by_token.get(leaf[0], f"?{leaf[0]}") for leaf in leaves]


def kept_leaves(items: list, slots: list[str], stats: dict, inside: list[int], parents: list[int]) -> tuple[list[bool], bool]:
    """(which leaves of a stream are article text, whether template texts in them go). stats: slot ->
    (distinct pages, characters, linked characters, characters of template texts); inside: each
    leaf's innermost element."""
    leaves = list(_leaves(items))
    tokens, states = zip(*(leaf[0].rsplit(":", 1) for leaf in leaves), strict=True) if leaves else ((), ())
    of = [stats.get(s, (1, 1, 0, 0)) for s in slots]
    mass = [n / max(1, pages) for pages, n, _, _ in of]
    same = [fixed / max(1, pages) for pages, _, _, fixed in of]
    menu = [linked >= LINK_PART * n for _, n, linked, _ in of]
    own = range(len(leaves))
    if "2" in states:
        use = {k for k in own if states[k] == "2" and not (".y" in tokens[k] and (same[k] >= TEMPLATE_PART * mass[k] or menu[k]))}
        # Where most of an article is the same on its pages, these are copies of one page.
        return [k in use for k in own], 2 * sum(same[k] for k in use) <= sum(mass[k] for k in use)
    use = [k for k in own if states[k] == "1" and not menu[k]]
    own_text = [mass[k] - same[k] for k in own]
    fresh = any(own_text[k] > 0 for k in use)
    if fresh:
        use = [k for k in use if own_text[k] > 0]
    held: dict[int, float] = {}
    for k in use:
        at = parents[inside[k]] if inside[k] >= 0 else -1
        held[at] = held.get(at, 0.0) + (own_text[k] if fresh else mass[k])
    for number in range(len(parents) - 1, -1, -1):  # a parent's number is less than its children's
        if number in held:
            held[parents[number]] = held.get(parents[number], 0.0) + held[number]
    enough = REGION_PART * held.get(-1, 0.0)
    region = max((number for number, n in held.items() if n >= enough), default=-1)

    def below(number: int) -> bool:
        while number > region:
            number = parents[number]
        return number == region

    within = {k for k in use if below(inside[k])}
    first = min(within, default=0)
    titles = {k for k in use if k < first and tokens[k].rsplit("/", 1)[-1][:2] in ("h1", "h2")}
    return [k in within or k in titles for k in own], fresh


# ---- Spark ----------------------------------------------------------------------

def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


PARSED = (
    "host string, page long, stream string, nest string, leaf array<int>, marks array<long>, texts array<string>, "
    "held array<struct<leaf:int,mark:long,size:long,links:long,first:int>>"
)
_HELD = pa.struct([("leaf", pa.int32()), ("mark", pa.int64()), ("size", pa.int64()), ("links", pa.int64()), ("first", pa.int32())])


def _parsed(batches):
    """(id, url, host, html) -> (id, url, PARSED): blocks with the leaf of the page's stream that each
    belongs to; held: each distinct text of a leaf once, `first` 1 at a leaf's first."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), *map(pa.list_, (pa.int32(), pa.int64(), pa.string(), _HELD)))
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p = Page(page or "")
            items = _numbered(p)
            leaf, inside = [0] * len(p.texts), []
            for k, item in enumerate(_leaves(items)):
                inside.append(p.inside[item[3][0]])
                for number in item[3]:
                    leaf[number] = k
            # Elements without text below them count for nothing.
            used: set[int] = set()
            for number in inside:
                while number >= 0 and number not in used:
                    used.add(number)
                    number = p.parents[number]
            new = {old: k for k, old in enumerate(sorted(used))} | {-1: -1}
            nest = json.dumps([[new[n] for n in inside], [new[p.parents[n]] for n in sorted(used)]])
            marks = [hash_text(t) for t in p.texts]
            held: dict[tuple[int, int], dict] = {}
            for k, mark, text, links in zip(leaf, marks, p.texts, p.linked, strict=True):
                own = held.setdefault((k, mark), {"leaf": k, "mark": mark, "size": 0, "links": 0, "first": 0})
                own["size"] += len(text)
                own["links"] += links
            for own in {h["leaf"]: h for h in reversed(held.values())}.values():
                own["first"] = 1
            rows.append((host, hash_text(page or ""), json.dumps(_plain(items)), nest, leaf, marks, p.texts, list(held.values())))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        names = ["page_id", "url", "host", "page", "stream", "nest", "leaf", "marks", "texts", "held"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def _merge(table: pa.Table) -> pa.Table:
    items = None
    for text in sorted(table["items"].to_pylist()):
        more = json.loads(text)
        items = more if items is None else align(items, more)
    return pa.table({"host": [table["host"][0].as_py()], "items": [json.dumps(items)]}, pa.schema([("host", pa.string()), ("items", pa.string())]))


def infer_wrappers(streams: DataFrame, shelf: Shelf) -> DataFrame:
    """(host, items) of distinct streams -> (host, items): one wrapper, as JSON, for each host."""
    level = shelf.put(streams, "streams0")
    for k in range(1, 20):
        sizes = level.groupBy("host").count()
        most = sizes.agg(F.max("count")).first()[0] or 1
        if most == 1:
            break
        groups = F.ceil(F.col("count") / GROUP)
        dealt = level.join(sizes, "host").select("host", "items", F.pmod(F.xxhash64("items"), groups).alias("salt"))
        level = shelf.put(dealt.groupBy("host", "salt").applyInArrow(_merge, "host string, items string").distinct(), f"streams{k}")
        shelf.drop(f"streams{k - 1}")
    return level


def _matched(batches):
    """(host, stream, nest, items) -> (host, stream, nest, slots)."""
    for batch in batches:
        wrappers = {w: json.loads(w) for w in set(batch.column("items").to_pylist())}
        slots = [slots_of(json.loads(s), wrappers[w]) for s, w in zip(batch.column("stream").to_pylist(), batch.column("items").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("host", "stream", "nest")), pa.array(slots, pa.list_(pa.string()))], ["host", "stream", "nest", "slots"])


DECIDED = "host string, stream string, kept array<boolean>, template array<struct<leaf:int,mark:long>>"


def _decided(batches):
    """(host, stream, nest, slots, stats) -> DECIDED: for each leaf whether it is article text, and its texts that are template."""
    pair = pa.list_(pa.struct([("leaf", pa.int32()), ("mark", pa.int64())]))
    for batch in batches:
        kept, template = [], []
        for row in batch.select(["stream", "nest", "slots", "stats"]).to_pylist():
            stats = {s["slot"]: (s["pages"], s["size"], s["linked"], s["fixed"]) for s in row["stats"] or ()}
            marks = {s["slot"]: s["marks"] for s in row["stats"] or ()}
            leaves, without = kept_leaves(json.loads(row["stream"]), row["slots"], stats, *json.loads(row["nest"]))
            kept.append(leaves)
            template.append([{"leaf": k, "mark": m} for k, s in enumerate(row["slots"]) if without and leaves[k] for m in marks.get(s, ())])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("stream"), pa.array(kept, pa.list_(pa.bool_())), pa.array(template, pair)], ["host", "stream", "kept", "template"])


def _small(table: DataFrame, weight) -> DataFrame:
    """The table as a side to broadcast, if its rows and `weight` (array elements) are few."""
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS // 10 and total <= 20 * BROADCAST_ROWS else table


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Blocks come in page order, joined by a newline; references are decoded, white space
    inside a block is one space. Null and empty pages, and pages without article text: an
    empty text. Scripts, styles and comments that do not end run to the page's end. A null url
    counts as a host of its own kind. Equal pages count once in what slots hold. Repeated rows
    are each returned; other columns are not read; an empty table gives no rows."""
    spark = pages.sparkSession
    arrow_rows(spark, 200)
    shelf = Shelf(spark, "html", "zstd")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    kinds = [f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in (("page_id", id_col), ("url", url_col))]
    parsed = shelf.put(rows.mapInArrow(_parsed, ", ".join([*kinds, PARSED])), "parsed")
    streams = shelf.put(parsed.groupBy("host", "stream").agg(F.min("nest").alias("nest")), "distinct")
    wrappers = infer_wrappers(streams.select("host", F.col("stream").alias("items")), shelf)
    matched = shelf.put(streams.join(wrappers, "host").mapInArrow(_matched, "host string, stream string, nest string, slots array<string>"), "matched")
    slots = _small(matched.select("host", F.xxhash64("stream").alias("of"), "slots"), F.size("slots"))
    # What each slot holds, over distinct pages: a page counts once for each text of a slot.
    once = parsed.groupBy("host", "page").agg(F.first(F.struct(F.xxhash64("stream").alias("of"), "held")).alias("b")).select("host", "b.of", F.explode("b.held").alias("h"))
    each = once.join(slots, ["host", "of"]).select("host", F.get("slots", F.col("h.leaf")).alias("slot"), "h.mark", "h.size", "h.links", "h.first")
    texts = shelf.put(each.groupBy("host", "slot", "mark").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("size", "links", "first")]), "slot_texts")
    held = shelf.put(texts.groupBy("host", "slot").agg(F.sum("first").alias("pages"), F.sum("size").alias("size"), F.sum("links").alias("linked")), "slots")
    fixed = texts.filter(F.col("n") >= TEMPLATE_PAGES).join(held.select("host", "slot", "pages"), ["host", "slot"]).filter(F.col("n") >= TEMPLATE_PART * F.col("pages"))
    # At most 1 / TEMPLATE_PART texts for each block that a page has in the slot.
    fixed = fixed.groupBy("host", "slot").agg(F.sum("size").alias("fixed"), F.collect_list("mark").alias("marks"))
    stats = held.join(fixed, ["host", "slot"], "left").select("host", F.struct("slot", "pages", "size", "linked", F.coalesce("fixed", F.lit(0)).alias("fixed"), F.coalesce("marks", F.array().cast("array<long>")).alias("marks")).alias("s"))
    stats = shelf.put(stats.groupBy("host").agg(F.collect_list("s").alias("stats")), "stats")
    decided = shelf.put(matched.join(stats, "host", "left").mapInArrow(_decided, DECIDED), "decided")
    out = parsed.join(_small(decided, F.size("kept") + F.size("template")), ["host", "stream"])
    shown = F.filter("texts", lambda t, k: F.get("kept", F.get("leaf", k)) & ~F.array_contains("template", F.struct(F.get("leaf", k).alias("leaf"), F.get("marks", k).alias("mark"))))
    return out.select("page_id", "url", F.array_join(shown, "\n").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
