"""Main text of web pages by wrappers inferred from pages of one host.

A wrapper is a union-free regular expression over a page's block elements and texts. Each page gives one of its own: adjacent
elements that align with each other become a repeated group. Wrappers of one host are aligned child by child: what matches is
merged, equal texts stay constant, different ones become a slot, an element that one side lacks becomes optional, an element or a run
of elements that a side repeats becomes a repeated group. The merge is done inside every task over all its pages, then over the distinct wrappers of a host, so every
page takes part and no task holds the pages of a host.

From a host's wrapper follows where its article stands (its root, for which an article or main element is evidence), where more of
its prose stands, and which texts are template: those that every one of several different pages holds at an aligned place, in the
root as well as around it. Each page is then read with that rule. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are no part of an article wherever they stand. Inside the root a class names such a block only as
a whole, on a container, and where the wrapper holds the block in several pages.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, ship, table

TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|"|')*+)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead tr ul head button".split()
)
#: Elements that are never part of an article.
APART = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "object", "canvas", "audio", "video", "fieldset", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
#: Words of a class or id that name something beside the article.
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbox adbox banner promo promotion sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "comment comments reply replies respond discussion disqus widget toolbar pager pagination skip copyright disclaimer".split()
)
#: Words that make a compound class of WORDS the name of a component.
NOUNS = set("area articles bar block box btn button buttons container count form icon icons inner item items link links list post posts slot tools unit wrap wrapper".split())
#: Elements that a class or id can name as a block beside the article, in it as well.
CONTAINERS = {"article", "center", "details", "dl", "div", "figure", "header", "ol", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text is prose, and those that prose is read through.
PROSE = {"p", "pre", "blockquote"}
BLOCKS = PROSE | HEADINGS | {"ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption"}
#: Mean characters of a text of prose, and the share of the root's text from which other prose is article text as well.
LONG, SHARE = 60, 0.25
#: An element that starts ends an open one of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "nav", "aside", "footer", "header", "form"}


def attributes(rest: str) -> dict[str, str]:
    return {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(rest)} if rest.strip(" /\t\r\n") else {}


def words(named: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", named)]


def beside(name: str, a: dict[str, str], inside: bool) -> str:
    """The mark of an element that is not part of an article, or ""; `inside` an article a header is its own.

    "!" is so by its kind; "!c" is a container with a class that names a component as a whole; "!i" has a part of a class or id in WORDS.
    """
    if name in APART or (name == "header" and not inside):
        return "!"
    if not a:
        return ""
    if "hidden" in a or a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return "!"
    if name in ("body", "html") or name in HEADINGS:
        return ""
    parts = [words(c) for c in a.get("class", "").split()]
    if name in CONTAINERS and any(not WORDS.isdisjoint(x) and set(x) <= WORDS | NOUNS for x in parts):
        return "!c"
    if name in CONTAINERS:
        parts.append(words(a.get("id", "")))
    return "!i" if any(not WORDS.isdisjoint(x) for x in parts) else ""


def events(page: str):
    """("open", label, mark, name of the block) | ("close",) | ("text", str) of block elements and their texts; text of a block is parted by its inner blocks.

    Character references are decoded, runs of white space are one space, ends are trimmed. Elements that are left open are closed
    where HTML closes them.
    """
    stack: list[tuple[str, str, bool]] = []  # name, mark, in an article
    held: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        return [("text", text)] if text else []

    def pop(to: int):
        out = flush()
        while len(stack) > to:
            stack.pop()
            out.append(("close",))
        return out

    at, raw = 0, None
    while at <= len(page):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m and raw == "title":
                pass
            at = m.end() if m else len(page) + 1
            raw = None
            continue
        m = TAG.search(page, at)
        held.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name == "p" or name in BLOCK:
                where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if where is not None and not (name in ("li", "p", "td", "tr", "dd", "dt") and any(x[0] in FENCES for x in stack[where + 1 :])):
                    yield from pop(where)
                else:
                    yield from flush()
            continue
        if name in RAW:
            raw = name
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCK and name not in APART:
            continue
        if name in VOID:
            yield from flush()
            continue
        if name in BLOCK and any(x[0] == "p" for x in stack[-1:]):
            yield from pop(len(stack) - 1)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(name, ()):
                yield from pop(k)
                break
            if stack[k][0] in FENCES:
                break
        if name == "body":
            while any(x[0] == "head" for x in stack):
                yield from pop(next(k for k, x in enumerate(stack) if x[0] == "head"))
        yield from flush()
        a = attributes(m["rest"])
        inside = bool(stack) and stack[-1][2]
        off = beside(name, a, inside)
        stack.append((name, off, inside or (name in ("article", "main") and not off)))
        label = name + "".join(sorted("." + c for c in a.get("class", "").split()))
        yield ("open", label, off, label + "#" + re.sub(r"\d+", "0", a.get("id", "")) + off if off else label)
        if m["rest"].rstrip().endswith("/") and name not in BLOCK:
            yield from pop(len(stack) - 1)
    yield from pop(0)


# ---------------------------------------------------------------- wrappers
# [label, quantifier, children, least, greatest hash of a page with it] and ["#", quantifier, text hash or None, characters, times, hashes of texts that every page holds here]

QUANTIFIERS = ("", "?", "+", "*")


def either(a: str, b: str, repeated: bool = False, optional: bool = False) -> str:
    more = repeated or a in ("+", "*") or b in ("+", "*")
    less = optional or a in ("?", "*") or b in ("?", "*")
    return ("*" if less else "+") if more else ("?" if less else "")


def whole(call):
    """Runs a function written as a generator that yields its calls, on a stack of its own: pages may nest to any depth."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def merged(a: list, b: list) -> list:
    """The wrapper of what either matches; both have one label."""
    return whole(_merged(a, b))


def _merged(a: list, b: list, repeated: bool = False, same: bool = False):
    """What is repeated, or `same`, stands in the same pages, which hold the texts of both."""
    same = same or repeated
    q = either(a[1], b[1], repeated)
    if a[0] == "#":
        every = set(a[5]) | set(b[5]) if same else set(a[5]) & set(b[5])
        return ["#", q, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], sorted(every)]
    return [a[0], q, (yield _aligned(a[2], b[2], same)), min(a[3], b[3]), max(a[4], b[4])]


def _lacking(w: list):
    """A wrapper that some page lacks: none of its texts is in every page."""
    if w[0] == "#":
        return [*w[:5], []]
    children = []
    for x in w[2]:
        children.append((yield _lacking(x)))
    return [w[0], w[1], children, w[3], w[4]]


#: Cells of the table that finds a longest common subsequence; longer lists are cut at labels that both hold once, and where there are none, matched greedily.
CELLS = 1 << 20


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs, which rise in the first place, that rises in the second as well."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of labels (see CELLS)."""
    lo, out = 0, []
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        out.append((lo, lo))
        lo += 1
    n, m = len(a), len(b)
    tail = []
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        tail.append((n, m))
    tail.reverse()
    if (n - lo) * (m - lo) <= CELLS:
        size = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
        for i in range(n - 1, lo - 1, -1):
            row, below = size[i - lo], size[i - lo + 1]
            for j in range(m - 1, lo - 1, -1):
                row[j - lo] = below[j - lo + 1] + 1 if a[i] == b[j] else max(below[j - lo], row[j - lo + 1])
        i = j = lo
        while i < n and j < m:
            if a[i] == b[j] and size[i - lo][j - lo] == size[i - lo + 1][j - lo + 1] + 1:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif size[i - lo + 1][j - lo] >= size[i - lo][j - lo + 1]:
                i += 1
            else:
                j += 1
        return out + tail
    once = {x for x, k in Counter(a[lo:n]).items() if k == 1} & {x for x, k in Counter(b[lo:m]).items() if k == 1}
    if once:
        where = {x: j for j, x in enumerate(b[lo:m], lo) if x in once}
        i = j = lo
        for x, y in [*rising([(k, where[a[k]]) for k in range(lo, n) if a[k] in once]), (n, m)]:
            out += [(i + u, j + v) for u, v in matches(a[i:x], b[j:y])]
            if x < n:
                out.append((x, y))
            i, j = x + 1, y + 1
        return out + tail
    places: dict[str, list[int]] = {}
    for j in range(m - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    at = lo
    for i in range(lo, n):
        own = places.get(a[i], [])
        while own and own[-1] < at:
            own.pop()
        if own and own[-1] - at <= n - i:
            out.append((i, own[-1]))
            at = own.pop() + 1
    return out + tail


def _aligned(a: list, b: list, same: bool = False):
    """Children of two wrappers: a longest common subsequence by label is merged, the rest becomes optional."""
    a, b = as_groups(a, b), as_groups(b, a)
    out: list = []
    if [x[0] for x in a] == [x[0] for x in b]:
        for x, y in zip(a, b, strict=True):
            out.append((yield _merged(x, y, same=same)))
        return out
    i = j = 0
    for x, y in [*matches([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        for alone in (*a[i:x], *b[j:y]):
            kept = alone if same else (yield _lacking(alone))
            out.append([alone[0], either(alone[1], "", optional=True), *kept[2:]])
        if x < len(a):
            out.append((yield _merged(a[x], b[y], same=same)))
        i, j = x + 1, y + 1
    return (yield _squared(out))


#: Labels in a repeated group of several elements, at most.
PERIOD = 8


def group_label(labels: list[str]) -> str:
    return "(" + " ".join(labels) + ")"


def as_groups(a: list, b: list) -> list:
    """Children of `a` with its runs of the labels of a group of `b` made such groups, so that one occurrence meets a repetition."""
    for label in sorted({x[0] for x in b if x[0][0] == "("} - {x[0] for x in a}):
        parts = label[1:-1].split(" ")
        out, i = [], 0
        while i < len(a):
            if [x[0] for x in a[i : i + len(parts)]] == parts:
                own = a[i : i + len(parts)]
                out.append([label, "", own, min((x[3] for x in own if x[0] != "#"), default=0), max((x[4] for x in own if x[0] != "#"), default=0)])
                i += len(parts)
            else:
                out.append(a[i])
                i += 1
        a = out
    return a


def _folded(run: list):
    """One wrapper of adjacent elements of one label, in rounds of neighbours."""
    while len(run) > 1:
        left = []
        for k in range(0, len(run) - 1, 2):
            left.append((yield _merged(run[k], run[k + 1], repeated=True)))
        run = left + run[len(left) * 2 :]
    return run[0]


def _squared(children: list):
    """Adjacent children of one label become a repeated group, and so do runs of up to PERIOD elements that follow themselves."""
    out: list = []
    i = 0
    while i < len(children):
        j = i + 1
        while j < len(children) and children[j][0] == children[i][0]:
            j += 1
        out.append((yield _folded(children[i:j])))
        i = j
    labels = [x[0] for x in out]
    done: list = []
    i = 0
    while i < len(out):
        period = next((k for k in range(2, min(PERIOD, (len(out) - i) // 2) + 1) if labels[i] == labels[i + k] and labels[i : i + k] == labels[i + k : i + 2 * k]), 0)
        if not period or any(x[0] in "(#" for x in labels[i : i + period]):
            done.append(out[i])
            i += 1
            continue
        at = i + period
        while labels[at : at + period] == labels[i : i + period]:
            at += period
        held = []
        for k in range(period):
            own = out[i + k : at : period]
            one = yield _folded(own)
            held.append([one[0], "*" if "*" in {x[1] for x in own} else "+" if "+" in {x[1] for x in own} else "?" if "?" in {x[1] for x in own} else "", *one[2:]])
        done.append([group_label(labels[i : i + period]), "+", held, min(x[3] for x in held), max(x[4] for x in held)])
        i = at
    return done


def wrapper_of(page: str) -> list:
    """The wrapper of a single page."""
    found = list(events(page))
    own = zlib.crc32("\n".join(e[1] for e in found if e[0] == "text").encode())
    root: list = ["", "", [], own, own]
    stack = [root]
    for e in found:
        if e[0] == "open":
            stack.append([e[3], "", [], own, own])
        elif e[0] == "text":
            key = zlib.crc32(e[1].encode())
            stack[-1][2].append(["#", "", key, len(e[1]), 1, [key]])
        else:
            done = stack.pop()
            done[2] = whole(_squared(done[2]))
            stack[-1][2].append(done)
    root[2] = whole(_squared(root[2]))
    return root


def flat(w: list) -> str:
    """A wrapper as JSON without nesting: nodes from the top, each with its depth."""
    out, stack = [], [(0, w)]
    while stack:
        depth, x = stack.pop()
        out.append([depth, *x] if x[0] == "#" else [depth, x[0], x[1], x[3], x[4]])
        if x[0] != "#":
            stack.extend((depth + 1, y) for y in reversed(x[2]))
    return json.dumps(out)


def unflat(text: str) -> list:
    path: list[list] = []
    for depth, *x in json.loads(text):
        node = x if x[0] == "#" else [x[0], x[1], [], x[2], x[3]]
        del path[depth:]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def canonical(w: list) -> list:
    """The wrapper without counts of characters, which would make all wrappers distinct; texts keep their mean length by powers of two."""

    def go(w: list):
        if w[0] == "#":
            mean = w[3] // max(1, w[4])
            return ["#", w[1], w[2], 1 << max(0, mean.bit_length() - 1), 1, w[5]]
        children = []
        for x in w[2]:
            children.append((yield go(x)))
        return [w[0], w[1], children, w[3], w[4]]

    return whole(go(w))


def rule_of(w: list) -> dict:
    """How the pages of a host are read.

    several: the wrapper is of different pages. root: the element the article stands in, an article element or else a main element
    unless other prose is by far longer, else the element whose direct texts are the longest. more: other elements with direct texts
    of prose. fixed: hashes of the texts that every page holds at an aligned place. blocks: blocks beside the article that different
    pages hold.
    """
    several = w[3] != w[4]
    fixed: set[int] = set()
    blocks: set[str] = set()
    direct: dict[str, list[int]] = {}  # characters of direct texts, of prose among them, and of direct texts outside article and main
    whole_of = {"article": 0, "main": 0}
    known: dict[tuple[int, bool], tuple[int, int]] = {}

    def size(x: list) -> int:
        """Characters of a text; a constant one of different pages is template."""
        return 0 if several and x[2] is not None and x[5] else x[3] // max(1, x[4])

    def texts(node: list, prose: bool):
        """Characters of the texts of a block, and of those that are prose; read once per block."""
        if (id(node), prose) in known:
            return known[id(node), prose]
        own = long = 0
        for x in node[2]:
            times = 4 if x[1] in ("+", "*") else 1
            if x[0] == "#":
                n = size(x)
                own, long = own + n * times, long + (n * times if prose and n >= LONG else 0)
            elif x[0][0] == "(" or (x[0].split(".")[0] in BLOCKS and not x[0].endswith(("!", "!c", "!i"))):
                a, b = yield texts(x, prose if x[0][0] == "(" else x[0].split(".")[0] in PROSE)
                own, long = own + a * times, long + b * times
        known[id(node), prose] = own, long
        return own, long

    def visit(node: list, within: tuple[str, ...], apart: bool, many: int):
        label = node[0]
        name = label.split(".")[0]
        if label[:1] == "(":
            for x in node[2]:
                yield visit(x, within, apart, many * (4 if x[1] in ("+", "*") else 1))
            return
        if label.endswith(("!", "!c", "!i")):
            apart = True
            if node[3] != node[4]:
                blocks.add(label)
        if not apart and label and name not in BLOCKS:
            own, long = (n * many for n in (yield texts(node, True)))
            for kind in ("article", "main"):
                if name == kind or kind in within:
                    whole_of[kind] += own
            if name in whole_of and name not in within:
                within = (*within, name)
            at = direct.setdefault(label, [0, 0, 0, 0])
            for k, n in enumerate((own, long, 0 if "article" in within else long, 0 if "main" in within else long)):
                at[k] += n
        for x in node[2]:
            if x[0] == "#":
                if several and not apart:
                    fixed.update(x[5])
            else:
                yield visit(x, within, apart, min(many * (4 if x[1] in ("+", "*") else 1), 1 << 40))

    whole(visit(w, (), False, 1))
    names = {x.split(".")[0] for x in direct}
    best = max(direct, key=lambda x: (direct[x][0] if x != "html" else -1, x), default="")
    root, most, outside = best if direct and direct[best][0] else "", direct[best][0] if direct else 0, 1
    for k, kind in ((2, "article"), (3, "main")):
        other = max((x[k] for x in direct.values()), default=0)
        if kind in names and whole_of[kind] >= SHARE * other:
            root, most, outside = kind, whole_of[kind], k
            break
    more = sorted(x for x, n in direct.items() if root and x != root and n[outside] and n[outside] >= SHARE * most)
    return {"several": several, "root": root, "more": more, "fixed": sorted(fixed), "blocks": sorted(blocks)}


def extract(page: str, rule: dict) -> str:
    """The article of a page: its blocks in order, parted by an empty line.

    A page without the wrapper's root is read from its own article, main or, failing these, its body. Where most of a page is in
    every page, the pages are versions of one article and nothing is template.
    """
    found = list(events(page))
    labels = {e[1].split(".")[0] for e in found if e[0] == "open" and not e[2]} | {e[1] for e in found if e[0] == "open" and not e[2]}
    root, more = rule.get("root", ""), set(rule.get("more", ()))
    if root not in labels:
        root = next((x for x in ("article", "main") if x in labels), "")
    proper = root not in ("", "body", "html")
    blocks = set(rule.get("blocks", ())) if rule.get("several") else None
    fixed = set(rule.get("fixed", ()))
    out, depth, off, on, near = [], 0, [], [], []
    for e in found:
        if e[0] == "open":
            depth += 1
            named = blocks is None or e[3] in blocks or (proper and not on)
            if e[2] == "!" or (e[2] == "!c" and named) or (e[2] == "!i" and named and not (proper and on)):
                off.append(depth)
            if not root or root in (e[1], e[1].split(".")[0]):
                on.append(depth)
            # prose beside the root is read through blocks of text only
            near.append(e[1] in more or bool(near and near[-1] and e[1].split(".")[0] in BLOCKS))
        elif e[0] == "close":
            if off and off[-1] == depth:
                off.pop()
            if on and on[-1] == depth:
                on.pop()
            near.pop()
            depth -= 1
        elif not off and (on or not root or (near and near[-1])):
            out.append((e[1], zlib.crc32(e[1].encode()) in fixed))
    kept = [x for x, same in out if not same]
    if 2 * len(kept) < len(out) and 2 * sum(map(len, kept)) < sum(len(x) for x, _ in out):
        kept = [x for x, _ in out]
    return "\n\n".join(kept)


# ---------------------------------------------------------------- Spark


def host(url: Column) -> Column:
    """The host of a URL in lower case; null or odd URLs share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, rule (JSON) of every host, from all its pages."""
    ship(pages.sparkSession)

    def fold(rows):
        held: dict[str, list] = {}
        for name, w in rows:
            if not w[2]:
                continue  # a page without elements and texts
            held[name] = merged(held[name], w) if name in held else w
        return held

    def inside(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        for whole in batches:
            for batch in chunks(whole):
                rows = ((h, wrapper_of(x or "")) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                held = fold([*held.items(), *fold(rows).items()])
        names = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([flat(canonical(held[k])) for k in names], pa.string())], names=["host", "w"])

    def across(key, group):
        import pandas as pd

        out = None
        for w in sorted(group["w"]):
            out = unflat(w) if out is None else merged(out, unflat(w))
        return pd.DataFrame({"host": [key[0]], "w": [flat(canonical(out))]})

    def rules(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(rule_of(unflat(w))) for w in batch.column(1).to_pylist()], pa.string())], names=["host", "rule"])

    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(inside, "host string, w string").distinct()
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(32))).groupBy("host", "salt").applyInPandas(across, "host string, w string").distinct()
    return salted.groupBy("host").applyInPandas(across, "host string, w string").mapInArrow(rules, "host string, rule string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html is empty and gives an empty text; repeated rows give repeated results; an empty table gives an empty result."""
    spark = pages.sparkSession
    ship(spark)
    rules = materialize(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(rules, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches):
        import pyarrow as pa

        parsed: dict[str, dict] = {}
        for whole in batches:
            for batch in chunks(whole):
                out = []
                for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if rule not in parsed:
                        if len(parsed) > 10_000:
                            parsed.clear()
                        parsed[rule] = json.loads(rule) if rule else {}
                    out.append(extract(page or "", parsed[rule]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
