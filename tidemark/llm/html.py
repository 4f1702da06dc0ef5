"""Main-text extraction by wrappers: union-free regular expressions inferred from same-host pages.

A page's token stream is read into nested block elements (inline elements are
transparent); a text between them is a leaf.  The pages of a host are aligned
one after another with the wrapper so far.  Where the streams agree, elements
meet place by place; at a mismatch, siblings of one kind in a row fold into a
repeated group, elements that only one side has become optional groups, and
texts that differ become slots.  Siblings in no common order become a repeated
group of optional elements.

Extraction matches a page with its host's wrapper.  The wrapper names the
element that holds the main text: an article or main element with a third of
the slot text, else the smallest block that holds nearly all of it.  Of that
element's texts, slots are written; a text that is the same on at least
``CONSTANT`` different pages belongs to the template and is dropped, unless it
is a heading, or such texts are over a quarter of the element (then the pages are
copies, and it is their text).  Menus, headers, footers, sidebars, notices,
adverts, forms and comments are dropped by what they are: by tag, or by a name
that says so.  Names that may also mean something else (``WEAK``) need
evidence besides: constant text, mostly links, or a mere label.

Scale: all pages of a host make its wrapper.  Each task aligns its own pages,
so only wrappers are shuffled; those of a hot host are merged in two steps.
Wrappers are broadcast while all together have at most ``BROADCAST_BYTES``;
beyond, they meet their pages in a shuffle, hosts being split into parts of
about ``PART`` pages.

Defined results: null html is empty; pages without a url, or with one that has
no host, share a wrapper; a page without its host's main element falls back
to its own article, main or body; what is not closed ends with its parent;
elements nested deeper than ``DEPTH`` are read as siblings; repeated rows come
back once each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

CONSTANT, DEPTH, CELLS, KINDS, HELD, MERGERS, PART, BROADCAST_BYTES = 4, 150, 250_000, 500, 1_000, 32, 5_000, 16 << 20

# Elements by what they are, and names that mark parts that are no main text.
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|title|xmp"
NO_TEXT = set("head nav header footer aside form button select menu dialog canvas audio video map".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html head body div article section main nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address fieldset details summary menu dialog hgroup center button select canvas audio video map".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that an opening tag ends if they are open innermost.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
    "thead": {"caption"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Class, id and role names of hidden parts, menus, headers, footers, sidebars, notices, adverts, forms and comments; the last and the first part of a name may say it too.
SURE = set(
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary notice notices cookie cookies ad ads advert adverts advertisement "
    "advertising hidden sponsor sponsored form comment comments commentlist respond disqus newsletter".split()
)
LAST = {"menu", "nav", "navbar", "navigation", "footer", "sidebar", "notice", "notices", "ad", "ads", "advert", "adverts", "comment", "comments", "form", "breadcrumbs"}
FIRST = {"ad", "ads", "advert", "advertisement", "cookie", "cookies", "comment", "comments", "sponsored", "sponsor", "newsletter", "breadcrumb", "breadcrumbs", "sidebar", "disqus"}
#: Names that need evidence.
WEAK = set("share sharing social related search login signup subscribe subscription widget widgets toolbar promo promoted popup modal banner skip reply pagination consent tracking tags meta".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z|[^<]+|<",
    re.S | re.I,
)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/]|$|=)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_DIGITS = re.compile(r"[0-9]+")


def streams(page: str | None) -> Iterator[tuple[str, str, str]]:
    """Tokens of a page: ("open", tag, key), ("close", tag, "") and ("text", text, ""); a key is a tag with its class, id and role names, digits as 0."""
    page, at = page or "", 0
    missing: set[str] = set()  # raw elements that are not closed any more
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m["raw"]:
            tag = m["raw"].lower()
            close = None if m[0].endswith("/>") or tag in missing else _CLOSE[tag].search(page, at)
            if close:
                at = close.end()
            elif not m[0].endswith("/>"):
                missing.add(tag)
                at = len(page) if tag in ("script", "style") else at
        elif tag := m["tag"] or m["tag2"]:
            tag = tag.lower()
            if m["end"] or m["end2"]:
                yield "close", tag, ""
            else:
                names = " ".join(sorted({_DIGITS.sub("0", n.lower()) for x in _NAMES.finditer(m["rest"]) for n in (x[1] or x[2] or x[3] or "").split()})) if m["rest"] else ""
                if m["rest"] and _HIDDEN.search(m["rest"]):
                    names = f"hidden {names}".strip()
                yield "open", tag, f"{tag} {names}" if names else tag
        elif m[0][0] != "<" or m[0] == "<":
            yield "text", m[0], ""


@lru_cache(100_000)
def boilerplate(key: str) -> int:
    """2: an element of this key is no main text; 1: it is none if there is evidence; 0: it may be."""
    tag, _, names = key.partition(" ")
    if tag in NO_TEXT:
        return 2
    if tag in ("html", "body", "main", "page", ""):
        return 0
    found = 0
    for name in names.split():
        parts = re.split(r"[-_]+", name)
        if len(parts) == 1 and name in SURE or len(parts) > 1 and (parts[-1] in LAST or parts[0] in FIRST):
            if tag != "article" or parts[0] in ("comment", "comments", "reply") or parts[-1] in ("comment", "comments"):
                return 2
        elif tag != "article" and WEAK.intersection(parts):
            found = 1
    return found


class Element:
    """A part of a page or of a wrapper; without a key, a text."""

    __slots__ = ("chars", "hash", "key", "links", "loose", "main", "optional", "parts", "repeated", "seen", "text", "wrapper")

    def __init__(self, key: str, seen: tuple[int, ...] = (), text: str = "", links: int = 0):
        self.key, self.parts, self.text, self.seen = key, [], text, seen
        self.hash = xxhash.xxh64_intdigest(text.encode()) or 1 if text else 0  # 0: a slot
        self.chars, self.links = len(text), links
        self.optional = self.repeated = self.loose = self.main = False
        self.wrapper: Element | None = None

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]

    def __getstate__(self) -> tuple:
        return self.key, self.parts, self.hash, self.seen, self.chars, self.links, self.optional, self.repeated, self.loose, self.main

    def __setstate__(self, state: tuple) -> None:
        self.key, self.parts, self.hash, self.seen, self.chars, self.links, self.optional, self.repeated, self.loose, self.main = state
        self.text, self.wrapper = "", None


def tree(page: str | None) -> Element:
    """A page's elements and texts; white space inside a text is one space."""
    own = (xxhash.xxh64_intdigest((page or "").encode()),)
    root = Element("page", own)
    stack, deeper = [root], 0
    text: list[str] = []
    links, linked = 0, False

    def flush() -> None:
        nonlocal links
        if text and (whole := " ".join(entities.unescape("".join(text)).split())):
            stack[-1].parts.append(Element("", own, whole, min(links, len(whole))))
        text.clear()
        links = 0

    for kind, value, key in streams(page):
        if kind == "text":
            text.append(value)
            if linked:
                links += len(value)
        elif value in EMPTY:
            if value in ("br", "hr"):
                text.append(" ")
        elif value == "a":
            linked = kind == "open"
        elif value not in BLOCKS:
            pass
        elif kind == "open":
            flush()
            while stack[-1].tag in ENDS.get(value, ()) or stack[-1].tag == "p":
                stack.pop()
            if len(stack) > DEPTH:
                stack.pop()
                deeper += 1
            element = Element(key, own)
            stack[-1].parts.append(element)
            stack.append(element)
        elif deeper and stack[-1].tag == value:
            flush()
            deeper -= 1
        elif any(e.tag == value for e in stack[1:]):
            flush()
            linked = False
            while stack.pop().tag != value:
                pass
    flush()
    return root


def _keys(parts: list[Element]) -> list[str]:
    return [p.key for p in parts]


def folded(parts: list[Element]) -> list[Element]:
    """Siblings of one kind in a row as one repeated group."""
    out: list[Element] = []
    for part in parts:
        if out and out[-1].key == part.key:
            out[-1] = aligned(out[-1], part)
            out[-1].repeated = True
        else:
            out.append(part)
    return out


def optional(part: Element) -> Element:
    part.optional = True
    return part


def aligned(a: Element, b: Element) -> Element:
    """The wrapper of two wrappers of one kind, made of their parts: mismatches become slots, optional and repeated groups."""
    out = Element(a.key, a.seen if a.seen == b.seen else tuple(sorted({*a.seen, *b.seen})[:CONSTANT]))
    out.optional, out.repeated, out.loose = a.optional or b.optional, a.repeated or b.repeated, a.loose or b.loose
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    if not a.key:
        out.hash = a.hash if a.hash == b.hash else 0
    elif out.loose:
        out.parts = gathered(a.parts + b.parts)
    elif _keys(a.parts) == _keys(b.parts):
        out.parts = [aligned(x, y) for x, y in zip(a.parts, b.parts, strict=True)]
    else:
        x, y = folded(a.parts), folded(b.parts)
        head = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p.key != q.key), min(len(x), len(y)))
        tail = next((i for i, (p, q) in enumerate(zip(x[head:][::-1], y[head:][::-1], strict=False)) if p.key != q.key), min(len(x), len(y)) - head)
        left, right = x[head : len(x) - tail], y[head : len(y) - tail]
        if (len(left) + 1) * (len(right) + 1) > CELLS:
            out.loose, out.parts = True, gathered(x + y)
        else:
            ends = [aligned(p, q) for p, q in zip(x[:head], y[:head], strict=True)], [aligned(p, q) for p, q in zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
            out.parts = folded([*ends[0], *matched(left, right), *ends[1]])
        if len(out.parts) > KINDS:
            out.loose, out.parts = True, gathered(out.parts)
    return out


def matched(x: list[Element], y: list[Element]) -> list[Element]:
    """Two lists of siblings as one, along a longest common subsequence of their kinds; others are optional."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i].key == y[j].key else max(below[j], row[j + 1])
    out: list[Element] = []
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].key == y[j].key:
            out.append(aligned(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(x[i]))
            i += 1
        else:
            out.append(optional(y[j]))
            j += 1
    return out


def gathered(parts: list[Element]) -> list[Element]:
    """One element of each kind; if there are too many kinds, of each tag."""
    kinds = {p.key for p in parts}
    by: dict[str, Element] = {}
    for part in parts:
        if len(kinds) > KINDS:
            part.key = part.tag
        if part.key in by:
            by[part.key] = aligned(by[part.key], part)
            by[part.key].repeated = True
        else:
            by[part.key] = optional(part)
    return list(by.values())


def infer(pages: list[str | None]) -> Element | None:
    """The wrapper of pages of one host."""
    wrapper = None
    for page in dict.fromkeys(pages):
        wrapper = tree(page) if wrapper is None else aligned(wrapper, tree(page))
    return wrapper


def expression(wrapper: Element) -> str:
    """A wrapper as a regular expression over tokens, for people: slots are #TEXT, other texts the hash of what they say."""
    inner = " ".join(expression(p) for p in wrapper.parts)
    whole = f"<{wrapper.key}> {f'( {inner} )*' if wrapper.loose else inner} </{wrapper.tag}>" if wrapper.key else f"{wrapper.hash:016x}" if wrapper.hash else "#TEXT"
    mark = ("+" if wrapper.repeated else "") + ("?" if wrapper.optional else "")
    return f"( {whole} ){mark}" if mark else whole


def _evidence(element: Element) -> bool:
    """Whether a weak name is right: the element's text is mostly links, the template's, or a mere label."""
    chars, links, constant, label = 0, 0, True, ""
    todo = [element]
    while todo:
        e = todo.pop()
        todo += e.parts
        if not e.key:
            chars, links, label = chars + e.chars, links + e.links, label + e.text
            constant = constant and _constant(e)
    return 2 * links >= chars or constant or chars <= 80 and not re.search(r"[.!?。]", label)


def _constant(leaf: Element) -> bool:
    own = leaf.wrapper or leaf
    return own.hash != 0 and len(own.seen) >= CONSTANT


def slot_text(element: Element, single: bool) -> int:
    """Characters in slots (of a single page: in all texts) outside of boilerplate and link lists."""
    if not element.key:
        return element.chars - element.links if single or not element.hash else 0
    return 0 if boilerplate(element.key) == 2 else sum(slot_text(p, single) for p in element.parts)


def main_element(wrapper: Element) -> Element | None:
    """The element that holds the main text; None if nothing tells."""
    single = not slot_text(wrapper, False)
    total = slot_text(wrapper, single)

    def found(element: Element, tag: str) -> Iterator[Element]:
        for p in element.parts:
            if p.key and boilerplate(p.key) < 2:
                if p.tag == tag or tag == "main" and "main" in p.key.split()[1:]:
                    yield p
                yield from found(p, tag)

    for tag in ("article", "main"):
        best = max(found(wrapper, tag), key=lambda e: slot_text(e, single), default=None)
        if best is not None and 3 * slot_text(best, single) >= total:
            return best
    at = wrapper
    while True:
        inner = [p for p in at.parts if p.tag in ("html", "body", "div", "section", "table", "tbody", "tr", "td") and boilerplate(p.key) < 2 and not p.repeated]
        best = max(inner, key=lambda e: slot_text(e, single), default=None)
        if best is None or not total or slot_text(best, single) < 0.9 * total:
            return at if at.key != "page" else None
        at = best


def placed(element: Element, wrapper: Element) -> None:
    """Matches a page's element with the wrapper's: every part that has a place there is told it."""
    element.wrapper = wrapper
    if _keys(element.parts) == _keys(wrapper.parts) and not wrapper.loose:
        places = wrapper.parts
    else:
        by: dict[str, list[int]] = defaultdict(list)
        for i, p in enumerate(wrapper.parts):
            by[p.key].append(i)
        places, at = [], 0
        for part in element.parts:
            own = by.get(part.key) or wrapper.loose and by.get(part.tag)
            if not own:
                places.append(None)
                continue
            k = bisect_left(own, at)
            i = own[k] if k < len(own) else own[-1]
            places.append(wrapper.parts[i])
            at = i if wrapper.parts[i].repeated else i + 1
    for part, place in zip(element.parts, places, strict=True):
        if place is not None:
            placed(part, place)


def extract(page: str | None, wrapper: Element | None = None) -> str:
    """The main text of a page, as its host's wrapper tells, or, without one, the page alone."""
    root = tree(page)
    if wrapper is None:
        wrapper = tree(page)
        found = main_element(wrapper)
        if found is not None:
            found.main = True
    placed(root, wrapper)

    def regions(element: Element, wanted: object) -> Iterator[Element]:
        for p in element.parts:
            if p.key:
                if wanted(p):
                    yield p
                elif boilerplate(p.key) < 2:
                    yield from regions(p, wanted)

    tests = [lambda p: p.wrapper is not None and p.wrapper.main, *[lambda p, t=t: p.tag == t and boilerplate(p.key) < 2 for t in ("article", "main", "body")]]
    inside = next((r for t in tests if (r := list(regions(root, t)))), [root])
    texts: list[tuple[str, bool]] = []  # and whether the template has it

    def read(element: Element, heading: bool) -> None:
        for p in element.parts:
            if not p.key:
                texts.append((p.text, not heading and _constant(p)))
            elif (bad := boilerplate(p.key)) == 0 or bad == 1 and not _evidence(p):
                read(p, heading or p.tag in HEADINGS)

    for region in inside:
        read(region, False)
    constant = sum(len(t) for t, c in texts if c)
    drop = 4 * constant <= sum(len(t) for t, _ in texts)
    return " ".join(t for t, c in texts if not (c and drop))


def host(url: Column) -> Column:
    """A url's host: after the first "://" up to a slash, question mark or hash sign, A to Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _rows(rows: list[tuple[str, int, Element]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _, _ in rows], pa.string()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([pickle.dumps(w) for _, _, w in rows], pa.binary())],
        names=["host", "n", "wrapper"],
    )


def _aligning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a part of the pages; a task holds those of about HELD hosts at a time."""
    held: dict[str, tuple[int, Element]] = {}
    size = 0
    for batch in batches:
        for own, page in zip(batch.column(0), batch.column(1), strict=True):
            name, new = own.as_py(), tree(page.as_py())
            n, wrapper = held.get(name, (0, None))
            size += wrapper is None
            held[name] = n + 1, new if wrapper is None else aligned(wrapper, new)
        if size > HELD:
            yield _rows([(h, n, w) for h, (n, w) in held.items()])
            held, size = {}, 0
    if held:
        yield _rows([(h, n, w) for h, (n, w) in held.items()])


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host; rows (host, n, wrapper) come sorted by host."""
    now: tuple[str, int, Element] | None = None
    for batch in batches:
        rows = []
        for name, n, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = pickle.loads(wrapper.as_py())
            if now is None or now[0] != name:
                if now:
                    rows.append(now)
                now = name, n, own
            else:
                now = name, now[1] + n, aligned(now[2], own)
        if rows:
            yield _rows(rows)
    if now:
        yield _rows([now])


def _naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers with their main elements marked."""
    for batch in batches:
        rows = []
        for name, n, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = pickle.loads(wrapper.as_py())
            found = main_element(own)
            if found is not None:
                found.main = True
            rows.append((name, n, own))
        yield _rows(rows)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n, wrapper): what the n pages of each host tell."""
    kind = "host string, n long, wrapper binary"
    part = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_aligning, kind)
    part = staged(part.withColumns({"merger": F.pmod(F.spark_partition_id(), F.lit(MERGERS)), "h": F.xxhash64("wrapper")}))
    part = part.repartition("host", "merger").sortWithinPartitions("host", "merger", "h").select("host", "n", "wrapper").mapInArrow(_merging, kind)
    part = part.withColumn("h", F.xxhash64("wrapper")).repartition("host").sortWithinPartitions("host", "h").select("host", "n", "wrapper")
    return part.mapInArrow(_merging, kind).mapInArrow(_naming, kind)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    found = staged(wrappers(pages))
    own = pages.select(host(F.col("url")).alias("host"), "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"

    def batch_of(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in found.select("host", "wrapper").toLocalIterator()})

        def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrapper = lru_cache(256)(lambda name: pickle.loads(known.value[name]))
            for batch in batches:
                yield batch_of(batch.column(1), batch.column(2), [extract(h.as_py(), wrapper(n.as_py())) for n, h in zip(batch.column(0), batch.column(3), strict=True)])

        return own.mapInArrow(by_host, out)

    # Wrappers go before the pages of each part of their host.
    parts = F.ceil(F.col("n") / PART).cast("long")
    split = found.select("host", parts.alias("k")).where("k > 1")
    dealt = own.join(split, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("k", F.lit(1)))).select("host", "part", F.lit(1).alias("kind"), "page_id", "url", "html", F.lit(None).cast("binary").alias("wrapper"))
    first = found.select("host", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "wrapper")
    both = dealt.unionAll(first).repartition("host", "part").sortWithinPartitions("host", "part", "kind").select("kind", "page_id", "url", "html", "wrapper")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = None
        for batch in batches:
            at, texts = [], []
            for i, first_ in enumerate(batch.column(0).to_pylist()):
                if first_ == 0:
                    wrapper = pickle.loads(batch.column(4)[i].as_py())
                else:
                    at.append(i)
                    texts.append(extract(batch.column(3)[i].as_py(), wrapper))
            where = pa.array(at, pa.int64())
            yield batch_of(batch.column(1).take(where), batch.column(2).take(where), texts)

    return both.mapInArrow(in_order, out)
