"""Main text of web pages: templates deduced from equivalence classes of tokens over the pages of a host.

A page's tokens are its elements, each named by its path of tags with ids and classes, and its text blocks, named by path
and text. The tokens of a host that occur equally often in the same pages (one occurrence vector) are an equivalence
class; vectors are compared by sums of hashes over pages, so no host's pages are brought together. A class is valid with
support by enough pages and at least two element tokens. Elements of valid classes nest by their paths into the host's template:
each bounds a slot, which holds the texts that lie in it and in no template element further in. Texts in a valid class are the
template's own words. A slot with no other texts on any page is fixed.

The template's main element is found from the root down: the template element that holds most of the text on the host's pages, and in it
the one that holds most of that, as long as one does. It is extracted with all slots in it but the fixed ones; where most of its text is
the template's, the host repeats one article and they are the article. All outside of it - menus, notices, adverts, footers - is left out
whatever its tags and classes are called. Names only break ties: slots inside the main element that are called menus, adverts or
comments are left out, and among elements none of which holds most, an article or main element is the main one.

Hosts without such an element, or without support, are extracted by names alone: all of article or main elements, else all texts that are not
in elements called menus and the like, not all links, not in fixed slots and not the template's words.

A template is some lists of hashes of at most the tokens of some pages; pages of a hot host are dealt over salted parts of
it. A null or empty page, and one without main text, has an empty text; a null address has no host and no template. An empty table has no rows. A page of any
length is read whole, by itself. Rows are handled one by one, repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import kept, slices

#: Pages that support a class, and the share of the host's pages; pages of a host for one part of its salted template.
LEAST_PAGES, LEAST_SHARE, PAGES_A_PART = 4, 0.3, 500
#: An element holds most of the text with more than this share of it.
MOST = 0.5
#: A template's lists, in the order `extracted` takes them.
LISTS = ("words", "elements", "fixed", "main")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

RAW = frozenset("script style textarea noscript template iframe noembed noframes xmp title svg math canvas object select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
#: Elements whose start ends an open one of these names, up to a boundary.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES_P = BLOCKS - frozenset("body html head li td th tr tbody thead tfoot caption dd dt summary legend".split()) | {"p"}
_BOUNDARY = frozenset("ul ol dl table menu article section div body aside nav main form fieldset td th".split())
LEFT_OUT_TAGS = frozenset("head nav footer aside form menu dialog button input label fieldset".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
LEFT_OUT_NAMES = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr "
                           "notice notices alert popup modal overlay newsletter subscribe subscription signup ad ads advert adverts advertisement advertising sponsor "
                           "sponsored promo promotion banner share sharing social related recommended recommendations comment comments reply replies respond disqus "
                           "login search pagination pager copyright legal disclaimer toolbar skip".split())
_MAIN = frozenset(("article", "main"))


@dataclass
class Element:
    name: str
    path: int
    left_out: bool
    main: bool
    link: bool


@dataclass
class Page:
    """Elements' path hashes in page order; blocks as (path, text, in the main part by name, all links, left out by name); the path above each
    path, and which elements are left out, or the main part, by their own names."""

    elements: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    above: dict = field(default_factory=dict)
    out: set = field(default_factory=set)
    named_main: set = field(default_factory=set)


def named(value: str) -> set[str]:
    return set(_WORD.findall(_CAMEL.sub(" ", value).lower()))


_seen: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """What names an element in paths, whether it is left out, whether it is the main part."""
    if (found := _seen.get((tag, attributes))) is None:
        values = {}
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        names = named(values.get("class", "") + " " + values.get("id", ""))
        role = values.get("role", "").lower().strip()
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I)
        main = tag in _MAIN or role in ("main", "article")
        out = tag in LEFT_OUT_TAGS or role in LEFT_OUT_ROLES or bool(hidden) or (not main and tag not in ("body", "html") and bool(names & LEFT_OUT_NAMES))
        key = " ".join([tag, *sorted(w for w in names if not w.isdigit())])
        found = key, out, main
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[tag, attributes] = found
    return found


_paths: dict[tuple[int, str], int] = {}


def below(path: int, key: str) -> int:
    """The hash of a path one element longer."""
    if (found := _paths.get((path, key))) is None:
        if len(_paths) > 200_000:
            _paths.clear()
        found = _paths[path, key] = stable(f"{path}>{key}")
    return found


def stable(text: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def parsed(html: str) -> Page:
    page, stack, text, linked, at = Page(), [Element("", 1, False, False, False)], [], True, 0

    def close_block():
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                top = stack[-1]
                page.blocks.append((top.path, words, top.main, linked, top.left_out))
            text.clear()
        linked = True

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(unescape(piece) if "&" in piece else piece)
            if linked and not stack[-1].link and not piece.isspace():
                linked = False

    def pop_to(depth: int):
        if any(e.name in BLOCKS for e in stack[depth:]):
            close_block()
        del stack[depth:]

    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == tag:
                    pop_to(depth)
                    break
                if tag not in BLOCKS and stack[depth].name in BLOCKS:
                    break  # an inline end tag does not end a block
            else:
                if tag == "p":
                    close_block()
            continue
        if tag == "br":
            text.append(" ")
            continue
        ends = _ENDS.get(tag)
        if ends or tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth].name
                if (ends and name in ends) or (name == "p" and tag in _CLOSES_P):
                    pop_to(depth)
                    if not ends or name in ends:
                        break
                elif name in _BOUNDARY:
                    break
        if tag in BLOCKS:
            close_block()
        parent = stack[-1]
        key, out, main = described(tag, m[3])
        if tag == "header" and not parent.main:
            out = True
        path = below(parent.path, key)
        page.elements.append(path)
        page.above[path] = parent.path
        if out:
            page.out.add(path)
        elif main:
            page.named_main.add(path)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(Element(tag, path, parent.left_out or out, (parent.main or main) and not out, parent.link or tag == "a"))
    pop_to(1)
    close_block()
    return page


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def text_token(path: int, words: str) -> int:
    return stable(f"{path}|{words}")


def candidates(page: Page) -> list:
    """Blocks that the tag rules leave: those of article or main elements, else those that are not all links."""
    inside = [b for b in page.blocks if not b[4]]
    return [b for b in inside if b[2]] or [b for b in inside if not b[3]]


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, element: whether it is one, above: the path it is in, pages, low, high: sums of hashes of page and count, chars, main).

    `chars` counts texts: in an element with all it holds, of a text itself, in token 0 of the page. `main` counts pages that have the element as
    an article or main element by name.
    """
    def function(batches):
        for batch in batches:
            total: dict[tuple[str, int, bool, int], list[int]] = {}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
                html, host = html.as_py() or "", host_of(url)
                if not host:
                    continue
                page, counts, chars = parsed(html), {(0, True, 0): 1}, {}
                for path in page.elements:
                    name = path, True, page.above[path]
                    counts[name] = counts.get(name, 0) + 1
                for path, words, *_ in page.blocks:
                    name = text_token(path, words), False, path
                    counts[name] = counts.get(name, 0) + 1
                for path, words, *_ in page.blocks:
                    names, at = [(text_token(path, words), False, path), (0, True, 0)], path
                    while at in page.above:
                        names.append((at, True, page.above[at]))
                        at = page.above[at]
                    for name in names:
                        chars[name] = chars.get(name, 0) + len(words)
                own = stable(html)
                for name, n in counts.items():
                    mark = hash((own, n)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
                    mark ^= mark >> 29
                    entry = total.setdefault((host, *name), [0, 0, 0, 0, 0])
                    entry[0] += 1
                    entry[1] += mark & 0x7FFFFFFF
                    entry[2] += mark >> 33
                    entry[3] += chars.get(name, 0)
                    entry[4] += name[1] and name[0] in page.named_main
            if total:
                host, token, element, above = zip(*total)
                columns = [pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(element, pa.bool_()), pa.array(above, pa.int64()),
                           *(pa.array(numbers, pa.int64()) for numbers in zip(*total.values()))]
                yield pa.RecordBatch.from_arrays(columns, ["host", "token", "element", "above", "pages", "low", "high", "chars", "main"])
    found = pages.select("url", "html").mapInArrow(function, "host string, token long, element boolean, above long, pages long, low long, high long, chars long, main long")
    return found.groupBy("host", "token", "element", "above").agg(*[F.sum(c).alias(c) for c in ("pages", "low", "high", "chars", "main")])


def slot_of(path: int, above: dict, elements) -> int:
    """The innermost element of the template that holds a path, itself included; 0 where there is none."""
    while path not in elements:
        if path not in above:
            return 0
        path = above[path]
    return path


def nested(rows: list[dict]) -> tuple[list, list, list, list]:
    """A host's template, of its tokens with support: elements, fixed slots, words, and the main element if there is one."""
    classes: dict[tuple, list[dict]] = {}
    for row in rows:
        if row["token"]:
            classes.setdefault((row["pages"], row["low"], row["high"]), []).append(row)
    valid = [row for own in classes.values() if sum(r["element"] for r in own) >= 2 for row in own]
    elements = {r["token"] for r in valid if r["element"]}
    words = [r for r in valid if not r["element"]]
    # what holds a token stands on all of the token's pages, so paths have no gaps
    above = {r["token"]: r["above"] for r in rows if r["element"] and r["token"]}
    every = next(r["chars"] for r in rows if not r["token"])
    held = {r["token"]: r["chars"] for r in valid if r["element"]}
    children: dict[int, list[int]] = {}
    inner = dict.fromkeys([*held, 0], 0)  # in template elements further in
    for element, chars in held.items():
        parent = slot_of(above[element], above, elements)
        inner[parent] += chars
        children.setdefault(parent, []).append(element)
    own = {element: chars - inner[element] for element, chars in held.items()} | {0: every - inner[0]}
    filled = dict.fromkeys(own, 0)
    for row in words:
        filled[slot_of(row["above"], above, elements)] += row["chars"]
    fixed = {slot for slot in held if own[slot] and own[slot] == filled[slot]}
    called = {r["token"] for r in valid if r["element"] and 2 * r["main"] > r["pages"]}
    main, total = 0, every
    while total and (inside := children.get(main)):
        largest = max(inside, key=lambda e: (held[e], e))
        if held[largest] <= MOST * total:
            called_main = [e for e in inside if e in called]
            if len(called_main) == 1:
                main = called_main[0]
            break
        main, total = largest, held[largest]
    if main:
        varied, open_ = 0, [main]
        while open_:
            slot = open_.pop()
            varied += own[slot] - filled[slot]
            open_ += children.get(slot, [])
        if varied <= MOST * held[main]:
            fixed = set()  # the article itself, on every page
    return sorted(elements), sorted(fixed), sorted(r["token"] for r in words if r["chars"]), [main] if main else []


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, elements: paths of the template, fixed: those that bound fixed slots, words: its text tokens, main: the path of the main element)."""
    every = tokens(pages).where(F.col("pages") >= LEAST_PAGES)
    every = kept(every)  # what occurs in some pages at least: small
    size = every.where("element and token = 0").select("host", F.col("pages").alias("all_pages"))
    supported = every.join(size, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))  # of a host, no more than the tokens of some pages

    def function(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        elements, fixed, words, main = nested(rows)
        return pa.table({"host": [rows[0]["host"]], "pages": [rows[0]["all_pages"]], **{name: pa.array([found], pa.list_(pa.int64()))
                                                                                      for name, found in (("elements", elements), ("fixed", fixed), ("words", words), ("main", main))}})
    return supported.groupBy("host").applyInArrow(function, "host string, pages long, elements array<long>, fixed array<long>, words array<long>, main array<long>")


def inside(page: Page, path: int, main: int) -> bool | None:
    """Whether a path lies in the main element; None: in an element there that is left out by its name."""
    out = None
    while path != main:
        if path not in page.above:
            return False
        if path in page.out:
            out = path
        path = page.above[path]
    return None if out else True


def extracted(page: Page, words: set, elements: set = frozenset(), fixed: set = frozenset(), main: set = frozenset()) -> str:
    """The template's main element without fixed slots; without one, all of article or main elements, else what slots hold beside the template's words."""
    for path in main:
        if path in page.above:
            # outside of an article by name, what is all links is no text
            return "\n".join(b[1] for b in page.blocks if inside(page, b[0], path) and (b[2] or not b[3]) and slot_of(b[0], page.above, elements) not in fixed)
    return "\n".join(b[1] for b in candidates(page)
                     if b[2] or not words or (slot_of(b[0], page.above, elements) not in fixed and text_token(b[0], b[1]) not in words))


def main_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    def function(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                out = [extracted(parsed(html.as_py()), *(set(lists or ()) for lists in own)) if html.is_valid else ""
                       for html, *own in zip(part.column("html"), *(part.column(name).to_pylist() for name in LISTS))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])
    hosts = templates(pages).where((F.size("words") > 0) | (F.size("main") > 0)).withColumn("parts", F.ceil(F.col("pages") / PAGES_A_PART).cast("int"))
    hosts = kept(hosts)
    if hosts.isEmpty():
        rows = pages.select(F.col("page_id").cast("long"), "url", "html", *[F.lit(None).cast("array<long>").alias(name) for name in LISTS])
    else:
        parts = hosts.select("host", *LISTS, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        # a host's pages are dealt by page over the parts; a page of a host with fewer parts goes to part modulo their number
        host = F.lower(F.regexp_extract("url", r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
        rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.coalesce(host, F.lit("")).alias("host"))
        rows = rows.join(hosts.select("host", "parts"), "host", "left")
        rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts").cast("long")).cast("int"), F.lit(-1)))
        rows = rows.join(parts.select("host", "part", *LISTS), ["host", "part"], "left").select("page_id", "url", "html", *LISTS)
    return rows.mapInArrow(function, "page_id long, url string, text string, n_chars long")
