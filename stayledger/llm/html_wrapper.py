"""Main text of web pages by union-free regular-expression inference.

A page is read as a token stream of tags and texts, balanced into nested groups.  A wrapper
is a union-free regular expression over such streams: a tag's content is a sequence of
tags and text slots, each of them there once, optional (?), repeated (+) or both (*).  A
page alone is a wrapper in which neighbours of one tag have become a repeated group.
Two wrappers of a host are aligned: what matches is merged, a tag only one of them has
becomes optional, neighbours of one tag on one side become repeated, and texts that differ
become slots.  Merging goes on iteratively: inside a task page by page, then over the
tasks' wrappers of a host in salted shares, then over the shares, so that a task only
ever holds one wrapper of each of its hosts.

Pages of a host are told apart by layout: those with text in an `article` or `main`, and the
others by the path of the group with most words; each layout has its wrapper.  The wrapper
tells where the main text is: the `article` or `main` group, else the group whose slots vary
most, with siblings that vary alike.  A page is then matched with its layout's wrapper, and
the slots inside that group are its text; if there is none, the page's own best group is.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut

#: HTML's own sets of elements (fixed values of the format).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
#: Raw elements that reach to the end of the page if nothing ends them; of the others, only the tag is left out then.
ENDLESS = frozenset("script style textarea title".split())
#: What a head may hold; anything else ends it, with or without its end tag.
HEAD = frozenset("base basefont bgsound link meta head html".split()) | RAW
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hgroup hr main menu nav ol p pre search section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                "option": ("option",), "thead": ("thead", "tbody"), "tbody": ("thead", "tbody"), "tfoot": ("tbody", "thead")}

#: Elements that never hold main text, and words of class names, ids and roles that say so.
ASIDE = frozenset("head nav header footer aside form button select option input dialog menu".split())
ASIDE_NAME = (r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|menu|nav\w*|"
              r"breadcrumbs?|sidebar|side|header|footer|comments?|disqus|repl(?:y|ies)|share|social|related|widget|login|search|copyright)")
#: Parts a whole token may have besides.
PLAIN = (r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|list|bar|box|block|container|wrapper|section|area|inner|buttons?|links?|form|"
         r"slot|unit|space|zone|tools?|toolbar|items?|thread|holder|outer|icons?|count)")
ASIDE_NAMES = re.compile(rf"(?:{PLAIN}[_-])*{ASIDE_NAME}(?:[_-](?:{ASIDE_NAME}|{PLAIN}))*", re.I)
#: Words that say so as any part of a class name, unless the name tells a state ("has-comments").
ASIDE_PART = re.compile(r"comments?(?:list|form|area|box|body|thread|section|wrap|item)?|disqus\w*|advert\w*|ads(?:by\w+|ense)|ad(?:slot|box|unit)s?|"
                        r"sponsor(?:ed|s|ship)?|promos?|newsletters?|subscribe|breadcrumbs?|shar(?:e|ing)(?:bar|box|links|tools)?|social|cookies?|consent|popup|modal|sidebar", re.I)
STATES = frozenset("has no with without is show hide not".split())
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: Elements that names say nothing about.
NAMELESS = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|([^<]+|<)", re.S)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: White space of a text: that of HTML, and the fixed space.
SPACE = re.compile(r"[\s ]+")

#: Elements nested deeper than this are read as part of the one at this depth, each with its own
#: end and break; asides, articles and mains stay apart at any depth.
DEEPEST = 60


def page_tree(html: str) -> list:
    """['#root', items]: an item is a text, or [label, items, is_block].  The label is the tag
    name, marked with "!" if tag, class, id or role say that it is no main text.
    Names do not count on NAMELESS elements, on what holds the page's only articles, nor on
    what holds the page's whole text."""
    root: list = ["#root", [], True]
    stack, names = [root], ["#root"]
    at = 0
    while True:
        found = TOKEN.search(html, at)
        if not found:
            break
        at = found.end()
        close, name, attributes, text = found.groups()
        if text is not None:
            if names[-1] == "head" and text.split():
                _close(stack, names, "head", ())
            stack[-1][1].append(text)
        elif name:
            name = name.lower()
            if names[-1] == "head" and name not in HEAD:
                _close(stack, names, "head", ())
            if name in RAW:
                if not attributes.endswith("/"):
                    end = RAW_ENDS[name].search(html, at)
                    at = end.end() if end else len(html) if name in ENDLESS else at
                continue
            if name in CLOSES_P and "p" in names:
                _close(stack, names, "p", ("table", "td", "th", "button", "object"))
            for other in SELF_CLOSING.get(name, ()):
                _close(stack, names, other, ("ul", "ol", "dl", "table", "select"))
            aside = name in ASIDE or name not in NAMELESS and _named_aside(attributes)
            node = [name + "!" * aside, [], name not in INLINE]
            stack[-1][1].append(node)
            if name not in VOID and not attributes.endswith("/"):
                above = stack[-1][0]
                apart = aside and not above.endswith("!") or name in MAIN and not above.endswith("!") and above not in MAIN
                stack.append(node if len(stack) < DEEPEST or apart else stack[-1])
                names.append(name)
        elif close:
            _close(stack, names, close.lower(), ())
    if "!" in "".join(x[0] for x in _nodes(root, True)):
        _lift(root)
    return root


RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _named_aside(attributes: str) -> bool:
    """Whether a class, id or role is an aside's name as a whole, or a class in one of its parts."""
    for kind, *values in NAMES.findall(attributes):
        for token in "".join(values).split():
            if ASIDE_NAMES.fullmatch(token):
                return True
            if kind.lower() == "class":
                parts = PARTS.split(token)
                if any(map(ASIDE_PART.fullmatch, parts)) and STATES.isdisjoint(x.lower() for x in parts):
                    return True
    return False


def _nodes(top: list, asides: bool) -> Iterator[list]:
    """The elements below `top`, with or without those in and of asides."""
    for x in top[1]:
        if not isinstance(x, str) and (asides or not x[0].endswith("!")):
            yield x
            yield from _nodes(x, asides)


def _words(node: list, asides: bool = False) -> bool:
    """Whether there is a word in it; outside asides, if not told else."""
    return any(isinstance(y, str) and y.split() for x in (node, *_nodes(node, asides)) for y in x[1])


def _lift(root: list) -> None:
    """Take back marks by name that leave the page without its articles or without a text."""
    if not any(x[0] in MAIN and _words(x) for x in _nodes(root, False)):
        _holders(root)
    while not _words(root):
        outer = [x for y in (root, *_nodes(root, False)) for x in y[1] if not isinstance(x, str) and _by_name(x) and _words(x, True)]
        if not outer:
            break
        for x in outer:
            x[0] = x[0][:-1]


def _by_name(node: list) -> bool:
    return node[0].endswith("!") and node[0][:-1] not in ASIDE


def _holders(node: list) -> bool:
    """Whether it is or holds an article or main with a text; marks by name above one are taken back."""
    found = node[0] in MAIN and _words(node)
    for x in node[1]:
        if not isinstance(x, str) and (_by_name(x) or not x[0].endswith("!")) and _holders(x):
            found = True
    if found and _by_name(node):
        node[0] = node[0][:-1]
    return found


def _close(stack: list, names: list, name: str, barrier: tuple) -> None:
    for i in range(len(names) - 1, 0, -1):
        if names[i] == name:
            if stack[i] is stack[i - 1] and any(n not in INLINE for n in names[i:]):
                stack[i][1].append(["div", [], True])  # where a block ends that is not a node
            del stack[i:], names[i:]
            return
        if names[i] in barrier:
            return


# Wrappers: ["#", 1 or 0 (varies), hash of a constant text, words] for a slot; [label, quantifier, items] for a group.

def wrapper_of(node: list) -> list:
    """The wrapper of one page's group: neighbours of one label are merged into a repeated one."""
    items: list = []
    for x in node[1]:
        if isinstance(x, str):
            words = x.split()
            if not words:
                continue
            made = ["#", 0, xxhash.xxh3_64_intdigest(" ".join(words)), len(words)]
        else:
            if x[0] in VOID:
                continue
            made = wrapper_of(x)
        if items and items[-1][0] == made[0]:
            items[-1] = _merged(items[-1], made)
            if made[0] != "#":
                items[-1][1] = _quantifier(items[-1][1], "+")
        else:
            items.append(made)
    return [node[0], "", items]


def _quantifier(a: str, b: str) -> str:
    both = set(a + b)
    optional, repeated = bool(both & set("?*")), bool(both & set("+*"))
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _merged(a: list, b: list) -> list:
    """One expression for what either side of a match stands for."""
    if a[0] == "#":
        return ["#", int(a[1] or b[1] or a[2] != b[2]), a[2], a[3] + b[3]]
    return [a[0], _quantifier(a[1], b[1]), aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Align two contents by their longest common run of labels; the rest becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merged(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            made = _merged(a[i], b[j])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            made, i = _optional(a[i]), i + 1
        else:
            made, j = _optional(b[j]), j + 1
        if out and out[-1][0] == made[0]:  # the mismatch was a repetition
            joined = _merged(out[-1], made)
            if joined[0] != "#":
                joined[1] = _quantifier(joined[1], "+")
            out[-1] = joined
        else:
            out.append(made)
    return out


def _optional(x: list) -> list:
    return x if x[0] == "#" else [x[0], _quantifier(x[1], "?"), x[2]]


def main_paths(wrapper: list) -> list[str]:
    """Paths (labels joined by "/") of the groups that hold the main text: every outermost
    article or main with a text; else the group outside asides whose own blocks' slots vary
    most, and its siblings with at least a quarter of that."""
    named: list[str] = []
    weigh: list[tuple[int, int, str]] = []

    def visit(x: list, path: str) -> tuple[int, int]:
        """(varying words, words) of all slots inside."""
        if x[0].endswith("!"):
            return 0, 0
        varying = words = 0
        direct = [0, 0]
        for y in x[2]:
            if y[0] == "#":
                v, w = y[3] * y[1], y[3]
            else:
                v, w = visit(y, f"{path}/{y[0]}")
            varying, words = varying + v, words + w
            if y[0] == "#" or not any(z[0] not in ("#", *INLINE) for z in y[2]):
                direct = [direct[0] + v, direct[1] + w]
        if x[0] in MAIN and words:
            named.append(path)
        if x[0] not in INLINE and x[0] != "p":
            weigh.append((direct[0], direct[1], path))
        return varying, words

    visit(wrapper, wrapper[0])
    if named:
        return [p for p in named if not any(p.startswith(q + "/") for q in named)]
    best = max(weigh, key=lambda x: (x[0], x[1]), default=None)
    if not best or not best[1]:
        return []
    by, parent = 0 if best[0] else 1, best[2].rpartition("/")[0]
    return list(dict.fromkeys([best[2], *(x[2] for x in weigh if parent and x[2].rpartition("/")[0] == parent and 4 * x[by] >= best[by])]))


def layout_of(paths: list[str]) -> str:
    """What pages of a host are told apart by, from a page's own main paths."""
    return "main" if any(p.rpartition("/")[2] in MAIN for p in paths) else paths[0] if paths else ""


def main_text(html: str, paths: list[str]) -> str:
    """Blocks of the groups at `paths`, in page order, with an empty line between them."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip(" ")
        if text:
            blocks.append(text)
        run.clear()

    def visit(node: list, path: str, inside: bool) -> None:
        inside = inside or path in paths
        for x in node[1]:
            if isinstance(x, str):
                if inside:
                    run.append(x)
            elif not x[0].endswith("!"):
                if x[2]:
                    flush()
                elif x[0] in ("br", "wbr", "img"):
                    run.append(" " * (inside and x[0] != "wbr"))
                visit(x, f"{path}/{x[0]}", inside)
                if x[2]:
                    flush()

    visit(page_tree(html), "#root", False)
    flush()
    return "\n\n".join(blocks)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


#: Wrappers a task holds before it passes them on.
HELD_HOSTS = 2_000


def site_of(host: str, paths: list[str]) -> str:
    """Host and layout in one; a host has no space."""
    return f"{host} {layout_of(paths)}"


def wrappers(pages: DataFrame, shares: int = 32) -> DataFrame:
    """(host, wrapper as JSON) inferred from all pages (host, html); a host comes with its layout."""

    def one(host: str, text: str | None) -> tuple[str, list]:
        w = wrapper_of(page_tree(text or ""))
        return site_of(host, main_paths(w)), w

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _folded((one(h, t) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _folded(((h, json.loads(w)) for b in batches for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    schema = "host string, wrapper string"
    partial = cut(pages.select("host", "html").mapInArrow(read, schema), "partial")
    share = F.pmod(F.xxhash64("wrapper"), F.lit(shares))
    shared = partial.withColumn("share", share).repartition("host", "share").sortWithinPartitions("host", "wrapper").select("host", "wrapper")
    return shared.mapInArrow(fold, schema).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(fold, schema)


def _folded(wrapped: Iterator[tuple[str, list]]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for host, w in wrapped:
        held[host] = _merged(held[host], w) if host in held else w
        if len(held) > HELD_HOSTS:  # all but the host that may go on
            last = held.pop(host)
            yield _packed(held)
            held = {host: last}
    yield _packed(held)


def _packed(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                                      ["host", "wrapper"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): one row per page, from its whole html.

    Null html is empty and has an empty text; pages without a host in their url (or
    without url) count as one host; repeated rows stay; an empty table gives an empty table;
    other columns are not read."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [main_paths(json.loads(w)) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.list_(pa.string()))], ["host", "paths"])

    found = cut(wrappers(rows).mapInArrow(locate, "host string, paths array<string>").groupBy("host").agg(
        F.array_distinct(F.flatten(F.collect_list("paths"))).alias("paths")), "paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", p or []) or main_text(h or "", own or [])
                     for h, p, own in zip(*(b.column(c).to_pylist() for c in ("html", "paths", "own")))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [key, url, "text", "n_chars"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [main_paths(wrapper_of(page_tree(h or ""))) for h in b.column("html").to_pylist()]
            sites = [site_of(h, p) for h, p in zip(b.column("host").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "url", "html")), pa.array(sites, pa.string()), pa.array(own, pa.list_(pa.string()))],
                                             ["key", "url", "html", "host", "own"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"key {kind}, url string, html string, host string, own array<string>")
    joined = placed.join(found, "host", "left").select("key", "url", "html", "paths", "own")
    return joined.mapInArrow(read, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
