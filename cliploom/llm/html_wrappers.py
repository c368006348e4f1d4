"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of tokens: block elements with their classes, and text slots (markup inside a block is dropped).
A wrapper starts as the stream of one page and is aligned with one page after the other. Siblings that repeat, alone or
as a sequence, become a repeated group; what only one side has becomes an optional group, so no alternatives arise;
texts that differ leave a slot. Wrappers align with wrappers in the same way. Each task folds the pages of a host that
it meets into one wrapper, and these are merged over salted groups first, so a host with a third of all pages gives each
merging task no more rows than there are tasks, whatever the number of pages.

The wrapper then tells which of its slots are main text, and only texts in its slots come out. Its slots of plain text that
vary over pages have a mass, their characters on all pages. The main block is found by going down from the root into the
part that holds most of the mass, as long as one does and is no block of text or repeated item. Names of elements and
classes are hints beside it: menus, footers, forms and blocks that their class calls sidebar, notice, advert or comments
have no mass, and an article, main or content block is the main block if it holds half of the mass or more. In the main
block, what the wrapper shows to be the host's own goes: texts that are fixed over pages (more than two), and repeated
groups of links alone that all these pages have. A page of which nothing else is left keeps these texts (copies of one
page are no boilerplate). Where no part holds most of the mass, main text is in all slots that vary and are not mostly
links. A page is matched with its host's wrapper, and the texts of these slots are its blocks. Wrappers go to all tasks
only if they are small (checked); otherwise they are joined by host and salt.

Null and empty pages have an empty text. A page that lacks the main block is read like a page of a host without one. Very
long and very deep pages are read whole. Null urls, and urls without a host, share one wrapper. Repeated rows are pages
each; page_id may be null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")

# Names of HTML elements and of classes.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
FENCES = frozenset("ul ol dl table body html article div section".split())
APART = frozenset("head nav footer aside form dialog menu object canvas audio video figure".split()) - {"figure"}
APART_CLASSES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies "
    "respond cookie cookies consent notice notices alert newsletter subscribe signup login share sharing social related popup modal overlay widget toolbar pagination pager "
    "copyright disclaimer search complementary contentinfo dialog".split()
)
OUTSIDE = frozenset(["header", "footer", "masthead"])  # apart, unless inside the main container
CONTENT_CLASSES = frozenset("articlebody entry content post story article main".split())
#: Words that say only how a block is laid out; a compound class means what the word before them says.
LAYOUT = frozenset(
    "active area articles bar block body bottom box button buttons card cards closed column container content desktop form group holder icons inner item items left link links list message "
    "mobile open outer panel posts primary region right secondary section slot sticky stories strip top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A form that holds one of these, or the main container, is the frame of a page.
FRAMES = frozenset("h1 header footer nav".split())


def label_of(name: str, attributes: str) -> str:
    """Name and classes (words of a class joined by -, classes by a point); numbers in classes differ by page and are dropped."""
    if not attributes or attributes.isspace():
        return name
    found = []
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            found.append("hidden")
        elif key != "aria-hidden":
            found += filter(None, ("-".join(WORDS.findall(c)) for c in value.split()))
    return f"{name}.{'.'.join(found)}" if found else name


class Element:
    """A block: its label and, in order, blocks and texts; a text is (string, whether most of it is links)."""

    __slots__ = ("items", "label", "name")

    def __init__(self, label: str, name: str):
        self.label, self.name, self.items = label, name, []


def parse(page: str | None) -> Element:
    root = Element("", "")
    stack = [root]
    names: Counter[str] = Counter()  # of the open blocks, so that an end tag without one costs no walk
    text: list[str] = []
    linked = plain = 0
    links = 0

    def end_block() -> None:
        nonlocal linked, plain
        if text:
            joined = BLANK.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                stack[-1].items.append((joined, linked > plain))
            text.clear()
        linked = plain = 0

    def close(depth: int) -> None:
        names.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    for match in TOKEN.finditer(page or ""):
        _, slash, name, attributes, slash2, name2, attributes2, data = match.groups()
        if data is not None:
            text.append(data)
            if links:
                linked += len(data.strip())
            else:
                plain += len(data.strip())
            continue
        name = (name or name2 or "").lower()
        if not name:
            continue
        closing = bool(slash or slash2)
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            continue
        end_block()
        links = 0
        if closing:
            if names[name] > 0:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name == name))
            continue
        if name in CLOSE_P and stack[-1].name == "p":
            close(len(stack) - 1)
        if name in CLOSES and any(names[n] > 0 for n in CLOSES[name]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in CLOSES[name]:
                    close(depth)
                    break
                if stack[depth].name in FENCES:
                    break
        if name in VOID:
            continue
        element = Element(label_of(name, attributes or attributes2 or ""), name)
        if names["form"] and (name in FRAMES or container(element.label) > 1):
            for around in stack:
                if around.name == "form":  # the frame of a page, no form of it
                    around.label = "div" + around.label.removeprefix("form")
        stack[-1].items.append(element)
        stack.append(element)
        names[name] += 1
    end_block()
    return root


# A wrapper is a list of parts; a part is [label, kind, pages, chars, text, parts]. Kinds: "1" once, "?" optional,
# "+" repeated, "*" both. Labels "#" and "#a" are text slots, plain and of links; "(...)" is a group of siblings. The text
# of a slot is a hash, that of a container the set of hashes of all texts in it, with the labels around them, that its pages
# share (wherever alignment puts them: an element that is single on one page may be in a repeated group on another).
LABEL, KIND, PAGES, CHARS, TEXT, PARTS = range(6)


def kind_of(optional: bool, repeated: bool) -> str:
    return "1?+*"[optional + 2 * repeated]


def also(part: list, optional: bool = False, repeated: bool = False) -> list:
    part[KIND] = kind_of(optional or part[KIND] in "?*", repeated or part[KIND] in "+*")
    return part


def hashed(text: str, path: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), path)


def stream(element: Element) -> list:
    """Parts of an element's items; repeats are folded. Depth has no bound here or below: open work is in lists."""
    top: list = []
    lists, todo = [top], [(element, top, 0, {})]
    while todo:
        at, parts, path, held = todo.pop()  # path: hash of the labels around; held: the outermost container of each level
        for item in at.items:
            if isinstance(item, Element):
                sure = container(item.label)
                new = [item.label, "1", 1, 0, set() if sure else 0, []]
                parts.append(new)
                lists.append(new[PARTS])
                todo.append((item, new[PARTS], hashed(item.label, path), dict.fromkeys(range(1, sure + 1), new[TEXT]) | held if sure else held))
            else:
                parts.append(["#a" if item[1] else "#", "1", 1, len(item[0]), hashed(item[0]) or 1, []])
                for texts in held.values():
                    texts.add(hashed(item[0], path))
    for parts in reversed(lists):  # what is inside comes later in lists
        parts[:] = folded(parts)
    return top


def folded(parts: list) -> list:
    """Neighbours with one label become a repeated part; then sequences of two to four that repeat, a repeated group."""
    out: list = []
    for part in parts:
        if out and out[-1][LABEL] == part[LABEL]:
            out[-1] = also(merged(out[-1], part, same_page=True), repeated=True)
        else:
            out.append(part)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(out):
            labels = [p[LABEL] for p in out[i : i + size]]
            times = 1
            while [p[LABEL] for p in out[i + times * size : i + (times + 1) * size]] == labels:
                times += 1
            if times > 1:
                group = out[i : i + size]
                for t in range(1, times):
                    group = [merged(a, b, same_page=True) for a, b in zip(group, out[i + t * size : i + (t + 1) * size], strict=True)]
                out[i : i + times * size] = [[f"({' '.join(labels)})", "+", 1, 0, 0, group]]
            i += 1
    return out


def merged(a: list, b: list, same_page: bool = False) -> list:
    """Two parts with one label. A text that differs leaves the slot without one (0)."""
    todo: list = []
    out = _merge(a, b, same_page, todo)
    _align(todo, same_page)
    return out


def aligned(a: list, b: list, same_page: bool = False) -> list:
    """Parts of two streams: common ones in order (a longest common subsequence of labels) are merged, others optional."""
    out: list = []
    _align([(a, b, out)], same_page)
    return out


def _merge(a: list, b: list, same_page: bool, todo: list) -> list:
    """Two parts with one label; their own parts are left to do."""
    if isinstance(a[TEXT], set):
        if same_page:
            a[TEXT] |= b[TEXT]
        text = a[TEXT] if same_page else a[TEXT] & b[TEXT]
    else:
        text = a[TEXT] if a[TEXT] == b[TEXT] else 0
    out = [
        a[LABEL],
        kind_of(a[KIND] in "?*" or b[KIND] in "?*", a[KIND] in "+*" or b[KIND] in "+*"),
        max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES],
        a[CHARS] + b[CHARS],
        text,
        [],
    ]
    todo.append((a[PARTS], b[PARTS], out[PARTS]))
    return out


def _align(todo: list, same_page: bool) -> None:
    while todo:
        a, b, out = todo.pop()
        left, right = [p[LABEL] for p in a], [p[LABEL] for p in b]
        if left == right:
            out += [_merge(x, y, same_page, todo) for x, y in zip(a, b, strict=True)]
            continue
        most = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i in range(len(left) - 1, -1, -1):
            for j in range(len(right) - 1, -1, -1):
                most[i][j] = most[i + 1][j + 1] + 1 if left[i] == right[j] else max(most[i + 1][j], most[i][j + 1])
        i = j = 0
        while i < len(left) or j < len(right):
            if i < len(left) and j < len(right) and left[i] == right[j]:
                out.append(_merge(a[i], b[j], same_page, todo))
                i, j = i + 1, j + 1
            elif j == len(right) or (i < len(left) and most[i + 1][j] >= most[i][j + 1]):
                out.append(also(a[i], optional=True))
                i += 1
            else:
                out.append(also(b[j], optional=True))
                j += 1


def dumped(wrapper: list) -> str:
    """A wrapper as JSON: its parts in order, each behind its depth."""
    rows, todo = [], [(0, p) for p in reversed(wrapper)]
    while todo:
        depth, part = todo.pop()
        rows.append([depth, *part[:PARTS]])
        todo += [(depth + 1, p) for p in reversed(part[PARTS])]
    return json.dumps(rows, separators=(",", ":"), default=sorted)


def loaded(text: str) -> list:
    wrapper: list = []
    lists = [wrapper]
    for depth, *part in json.loads(text):
        part.append([])
        if isinstance(part[TEXT], list):
            part[TEXT] = set(part[TEXT])
        lists[depth].append(part)
        lists[depth + 1 :] = [part[PARTS]]
    return wrapper


def meaning(css_class: str) -> str:
    """The word that a compound class is about: its last one that is not about layout (promotion-date is a date, ad-slot an ad)."""
    words = css_class.split("-")
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return words[-1]


@lru_cache(4096)
def is_apart(label: str, inside: bool) -> bool:
    name, *classes = label.split(".")
    words = {meaning(c) for c in classes}
    return name in APART or bool(words & APART_CLASSES) or "hidden" in words or (not inside and (name in OUTSIDE or bool(words & OUTSIDE)))


@lru_cache(4096)
def container(label: str) -> int:
    """How surely a block holds the main text: 3 article, 2 main, 1 by its class, 0 not."""
    name, *classes = label.split(".")
    words = {w for c in classes for w in c.split("-")}
    return 3 if name == "article" else 2 if name == "main" or "main" in words else 1 if name in ("div", "section", "td") and words & CONTENT_CLASSES else 0


def varying(part: list) -> bool:
    """Whether a slot's text is more than one text that several pages share."""
    return not (part[TEXT] and part[PAGES] > 2)


def main_block(parts: list) -> tuple[int, list | None]:
    """Where a wrapper has its main text: in blocks that container() rates so high, or (0 and) in this part, if any."""
    seen: list[tuple[list, int, bool, bool]] = []  # part, place of the part around it, whether either is apart, in a container
    todo = [(p, -1, False, False) for p in parts]
    inner: dict[int, list[int]] = {-1: []}
    while todo:
        part, around, apart, held = todo.pop()
        group = part[LABEL][:1] == "("
        apart = apart or (not group and is_apart(part[LABEL], held))
        held = held or (not group and container(part[LABEL]) > 0)
        todo += [(p, len(seen), apart, held) for p in part[PARTS]]
        inner[around].append(len(seen))
        inner[len(seen)] = []
        seen.append((part, around, apart, held))
    mass = [part[CHARS] if part[LABEL] == "#" and not apart and varying(part) else 0 for part, _, apart, _ in seen]
    text = [part[LABEL] in ("#", "#a") for part, _, _, _ in seen]
    level = 0
    for i in range(len(seen) - 1, -1, -1):
        part, around, apart, _ = seen[i]
        if text[i] and not apart:
            level = max(level, container(part[LABEL]))
        if around >= 0:
            mass[around] += mass[i]
            text[around] = text[around] or text[i]
    total = sum(mass[i] for i in inner[-1])
    if level:
        held, todo = 0, list(inner[-1])
        while todo:
            i = todo.pop()
            if container(seen[i][0][LABEL]) >= level:
                held += mass[i]
            else:
                todo += inner[i]
        if 2 * held >= total:
            return level, None
    at = -1
    while inner[at]:
        best = max(inner[at], key=lambda i: mass[i])
        part = seen[best][0]
        most = MOST * mass[best] >= LEAST * (total if at < 0 else mass[at]) > 0
        if not most or part[KIND] in "+*" or part[LABEL] in ("#", "#a") or any(p[LABEL] == "#" for p in part[PARTS]):
            break
        at = best
    return 0, seen[at][0] if at >= 0 else None


#: A part with at least LEAST / MOST of the mass of the part around it holds most of it.
MOST, LEAST = 5, 3


def links_alone(part: list) -> bool:
    todo, found = [part], False
    while todo:
        at = todo.pop()
        if at[LABEL] == "#":
            return False
        found = found or at[LABEL] == "#a"
        todo += at[PARTS]
    return found


def slots(parts: list, around: list | None = None) -> Iterator[tuple[list, list | None]]:
    """Parts but for groups, whose parts are given; each with the repeated part or group that it is or is in."""
    for part in parts:
        repeated = around or (part if part[KIND] in "+*" else None)
        if part[LABEL][:1] == "(":
            yield from slots(part[PARTS], repeated)
        else:
            yield part, repeated


def texts_of(root: Element, wrapper: list, level: int, main: list | None) -> list[str]:
    """Texts of the slots of main text, in page order; level and main are those of main_block()."""
    out: list[tuple[str, bool, bool]] = []  # text, whether it is the host's own, whether it is a heading outside groups of links
    # A frame: items, their places in the wrapper, place reached, hash of labels, container's place, in a group of links, in a heading.
    todo: list[tuple] = [(iter(root.items), list(slots(wrapper)), [0], 0, None, False, False)]
    nowhere = ["", "1", 0, 0, 0, []]
    while todo:
        items, places, at, path, inside, links, heading = todo[-1]
        item = next(items, None)
        if item is None:
            todo.pop()
            continue
        label = item.label if isinstance(item, Element) else "#a" if item[1] else "#"
        # The next part of that label; a repeated one, or one of a repeated group, comes again.
        found = next((i for i in [*range(at[0], len(places)), *range(at[0])] if places[i][0][LABEL] == label), None)
        place, repeated = places[found] if found is not None else (nowhere, None)
        at[0] = found if found is not None else at[0]
        if inside and repeated and not links:
            links = repeated[KIND] == "+" and repeated[PAGES] == inside[PAGES] > 2 and links_alone(repeated)
        if isinstance(item, Element):
            if not is_apart(label, inside is not None):
                within = inside or (place if place is main or (level > 0 and container(label) >= level) else None)
                todo.append((iter(item.items), list(slots(place[PARTS])), [0], hashed(label, path), within, links, heading or item.name in HEADINGS))
        elif found is None:
            continue  # no slot of the wrapper
        elif inside:
            known = inside[TEXT]
            shared = inside[PAGES] > 2 and hashed(item[0], path) in known if isinstance(known, set) else not varying(place)
            out.append((item[0], shared or links, heading and not links))
        elif level == 0 and main is None and not item[1] and varying(place):
            out.append((item[0], False, heading))
    own: list[str] = []
    below = False  # whether the text below a heading is the page's own
    for text, shared, heading in reversed(out):
        if not shared or (heading and below):
            own.append(text)
        below = below if heading and shared else not shared
    return own[::-1] or [text for text, _, _ in out]


def extract(page: str | None, wrapper: list, level: int, main: list | None) -> str:
    root = parse(page)
    found = texts_of(root, wrapper, level, main)
    if not found and (level or main):
        found = texts_of(root, wrapper, 0, None)
    return "\n".join(found)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
WRAPPERS = "host string, salt int, wrapper string"
SALTS = 16


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: one for each host; pages has host and html."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}

        def told() -> pa.RecordBatch:
            rows = [(host, dumped(w)) for host, w in known.items()]
            salts = [zlib.crc32(w.encode()) % SALTS for _, w in rows]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.string()), pa.array(salts, pa.int32()), pa.array([w for _, w in rows], pa.string())],
                names=["host", "salt", "wrapper"],
            )
            known.clear()
            return batch

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                host, parts = host.as_py(), stream(parse(page.as_py()))
                known[host] = aligned(known[host], parts) if host in known else parts
                if len(known) > 2000:
                    yield told()
        yield told()

    def merge(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        found = sorted(group["wrapper"])
        total = loaded(found[0])
        for other in found[1:]:
            total = aligned(total, loaded(other))
        return pd.DataFrame({"host": [key[0]], "salt": [0], "wrapper": [dumped(total)]})

    parts = pages.select("host", "html").mapInArrow(fold, WRAPPERS)
    return parts.groupBy("host", "salt").applyInPandas(merge, WRAPPERS).groupBy("host").applyInPandas(merge, WRAPPERS).select("host", "wrapper")


def extract_pages(pages: DataFrame, *, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    told = checkpointed(wrappers(rows))
    size = told.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(told), "host", "left")
    else:
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list, int, list | None]] = {}
        for batch in batches:
            texts = []
            for host, page, wrapper in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                host = host.as_py()
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    parts = loaded(wrapper.as_py() or "[]")
                    known[host] = (parts, *main_block(parts))
                texts.append(extract(page.as_py(), *known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "host", "html", "wrapper").mapInArrow(read, "page_id long, url string, text string, n_chars long")
