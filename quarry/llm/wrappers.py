"""Main-text extraction with inferred page wrappers (union-free expressions).

Pages of one host come from a number of templates. A page's token stream is
read into elements (a signature is the tag with its class, id and role); its
*template* is its host and its skeleton, the signature paths of its elements
down to ``SKELETON_DEPTH`` outside of furniture. For each template a wrapper is
inferred by aligning the streams of all its pages one after another:

* equal runs of siblings become one *repeated* group, merged inside,
* siblings that one side lacks become *optional* groups (longest common
  subsequence of signatures),
* texts that differ become *slots*; texts that never differ stay constants.

The wrapper tells which group holds the article - the smallest that holds all
text of the template's own article and main elements, else the smallest that
holds all of the slots' text outside of links and page furniture - and each page
of the template is cut along it.

Every page takes part. A task folds its pages into partial wrappers (it hands
them on when it holds ``HELD_WRAPPERS``), partial wrappers of a template are
merged by aligning them with each other, first in ``MERGE_SHARES`` shares, so a
host with a third of all pages is a few partial wrappers a task. Constants are
kept as hashes. A template of one page tells no constants from slots: its
wrapper is that page's own.

Main text leaves out menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments. Character references are decoded, white
space inside a block becomes one space, blocks are joined by a blank line.
Defined cases: null html is empty, a page without main text has the empty text,
null urls share one host, repeated pages are pages, an empty table gives no
rows, other columns pass.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks as B, jobs

SKELETON_DEPTH = 4
HELD_WRAPPERS, MERGE_SHARES = 1024, 32
BROADCAST_CHARS = 32 << 20
MAX_DEPTH = 200  # what is nested deeper hangs on the element at that depth

# HTML element names and words of class names by their role.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())  # text up to the end tag
HOLDERS = frozenset("noscript template object svg select".split())  # elements inside, none of them main text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot
    th thead tr ul""".split())
# Elements that frame a page (headings, paragraphs, tables and lists are content).
FRAME = frozenset("html body div section main article center td".split())
FURNITURE = frozenset("nav footer aside form menu dialog button head header".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment
    comments commentlist consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notification pager pagination paywall popup promo promotion related respond search share sharing sidebar signup skip social
    sponsor sponsored subscribe toolbar topbar widget widgets""".split())
# Names beside these words that only say where a box stands ("ad-box", "site-header").
PLACE_WORDS = frozenset("""area bar block bottom box buttons container content fixed global icons inner item left link links list
    main outer page panel primary right secondary section site slot sticky top unit wrap wrapper""".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS, MAIN_WORDS = ("article", "main"), frozenset("article-body articlebody article-content entry-content post-content main-content".split())
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "option", "optgroup"}
ENDS_SELECT = BLOCKS - {"option", "optgroup", "hr"}
SIBLING_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
                "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9-]+")


class Element:
    """An element of a page: signature, tag, attributes and children (elements
    and decoded texts). ``closed`` is false if its end tag is missing."""
    __slots__ = ("sig", "tag", "attrs", "kids", "closed")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.closed = tag, attrs, [], True
        self.sig = " ".join([tag, *(f"{k}={attrs[k]}" for k in ("class", "id", "role") if attrs.get(k))])


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(raw)}


def parse(source: str | None) -> Element:
    """Elements of a page. Unclosed paragraphs, list items and cells end where
    the next begins; an end tag closes up to its element; scripts, styles and
    comments leave nothing. An unclosed script ends where its parent does, an
    unclosed select where a block begins; other unclosed elements hold page text
    (``is_dropped``)."""
    source = source or ""
    root = Element("#page", {})
    stack, at, n = [root], 0, len(source)
    endless: set[str] = set()  # elements without an end tag from here on

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append(html.unescape(source[at:upto]))

    look = 0
    while True:
        start = source.find("<", look)
        if start < 0:
            break
        m = _TOKEN.match(source, start) or _LOOSE.match(source, start)
        if m is None:
            look = start + 1
            continue
        text(start)
        at = look = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not any(e.tag == "p" for e in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    stack[depth].closed = True
                    del stack[depth:]
                    break
                if name not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if name in ENDS_SELECT:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "select":
                    del stack[depth:]
                    break
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if name in SIBLING_ENDS:
            ends, bounds = SIBLING_ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in bounds:
                    break
                if stack[depth].tag in ends:
                    del stack[depth:]
                    if name != "tr":
                        break
        el = Element(name, _attributes(m[3]))
        stack[-1].kids.append(el)
        end = None
        if name in RAW and name not in endless:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if end is None:
                endless.add(name)
        if end:
            at = look = end.end()
        elif name in ("script", "style"):
            end = re.compile(rf"</{re.escape(stack[-1].tag)}\s*>", re.I).search(source, at)
            at = look = end.start() if end else n
        elif name not in VOID and not (m[3] or "").endswith("/") and len(stack) < MAX_DEPTH:
            el.closed = name == "select" or name not in RAW | HOLDERS
            stack.append(el)
    text(n)
    return root


def is_dropped(el: Element) -> bool:
    """Scripts, styles, selections and the like. Without an end tag the element
    isn't known to hold what follows, so that stays."""
    return el.closed and (el.tag in RAW or el.tag in HOLDERS)


def is_furniture(el: Element, within: bool = False) -> bool:
    """Menus, headers, notices, adverts and the like, by name alone. A name
    counts if it is furniture as a whole: 'ad-box' is, 'ad-hoc' isn't. ``within``
    an article, header elements and names belong to it."""
    if is_dropped(el) or el.tag in FURNITURE and not (within and el.tag == "header") or el.attrs.get("role") in FURNITURE_ROLES:
        return True
    if "hidden" in el.attrs or el.attrs.get("aria-hidden") == "true" or "display:none" in el.attrs.get("style", "").replace(" ", ""):
        return True
    names = f"{el.attrs.get('class', '')} {el.attrs.get('id', '')}"
    if names == " " or el.tag in ("body", "html", *MAIN_TAGS):
        return False
    return any(_furniture_name(w, within) for w in _WORD.findall(names.replace("_", "-")))


def _furniture_name(name: str, within: bool) -> bool:
    parts = [p for p in name.split("-") if p]
    named = [p for p in parts if p in FURNITURE_WORDS and not (within and p == "header")]
    return bool(named) and all(p in named or p in PLACE_WORDS for p in parts)


def is_main(el: Element) -> bool:
    return (el.tag in MAIN_TAGS or el.attrs.get("role") == "main" or el.attrs.get("itemprop") == "articlebody"
            or any(w in MAIN_WORDS for w in el.attrs.get("class", "").replace("_", "-").split()))


class Group:
    """A node of a wrapper: a signature with its inner expression. ``text`` is
    a hash of the constant text directly inside (None once it differed: a slot)."""
    __slots__ = ("sig", "main", "furniture", "link", "repeated", "optional", "text", "slot_chars", "kids")

    def __init__(self, sig: str):
        self.sig, self.main, self.furniture, self.link = sig, False, False, False
        self.repeated = self.optional = False
        self.text: str | None = None
        self.slot_chars, self.kids = 0, []


def _fold(el: Element, within: bool = False) -> Group:
    """The expression of one page's element: runs of siblings of one signature
    become a repeated group."""
    g = Group(el.sig)
    g.main, g.furniture, g.link = is_main(el), is_furniture(el, within), el.tag == "a"
    within = within or g.main and not g.furniture
    words = " ".join(" ".join(k.split()) for k in el.kids if isinstance(k, str)).strip()
    g.text, g.slot_chars = hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if words else "", len(words)
    for kid in el.kids:
        if isinstance(kid, Element) and not is_dropped(kid):
            one = _fold(kid, within)
            if g.kids and g.kids[-1].sig == one.sig:
                g.kids[-1] = _align(g.kids[-1], one)
                g.kids[-1].repeated = True
            else:
                g.kids.append(one)
    return g


def _align(a: Group, b: Group) -> Group:
    """The union-free expression that covers both."""
    out = Group(a.sig)
    out.main, out.furniture, out.link = a.main, a.furniture, a.link
    out.repeated, out.optional = a.repeated or b.repeated, a.optional or b.optional
    out.text = a.text if a.text == b.text else None
    out.slot_chars = a.slot_chars + b.slot_chars
    x, y = a.kids, b.kids
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].sig == y[j].sig else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].sig == y[j].sig:
            kid, i, j = _align(x[i], y[j]), i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            kid, i = x[i], i + 1
            kid.optional = True
        else:
            kid, j = y[j], j + 1
            kid.optional = True
        if out.kids and out.kids[-1].sig == kid.sig:
            kid = _align(out.kids[-1], kid)
            kid.repeated = True
            out.kids[-1] = kid
        else:
            out.kids.append(kid)
    return out


def pack(g: Group) -> list:
    """A wrapper as nested lists."""
    flags = sum(1 << i for i, x in enumerate((g.main, g.furniture, g.link, g.repeated, g.optional)) if x)
    return [g.sig, flags, g.text, g.slot_chars, [pack(k) for k in g.kids]]


def unpack(row: list) -> Group:
    g = Group(row[0])
    g.main, g.furniture, g.link, g.repeated, g.optional = (bool(row[1] >> i & 1) for i in range(5))
    g.text, g.slot_chars, g.kids = row[2], row[3], [unpack(k) for k in row[4]]
    return g


def skeleton(page: Element) -> str:
    """The page's template within its host: a hash of its different signature
    paths near the root, without furniture and what lies in an article."""
    paths = set()

    def walk(e: Element, path: str, depth: int) -> None:
        for kid in e.kids:
            if isinstance(kid, Element) and not is_furniture(kid) and kid.tag in FRAME:
                here = f"{path}>{kid.sig}"
                paths.add(here)
                if depth < SKELETON_DEPTH and not is_main(kid):
                    walk(kid, here, depth + 1)

    walk(page, "", 1)
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def infer(pages: list[str | None]) -> Group:
    """Align the pages of one template into a wrapper."""
    out = _fold(parse(pages[0]))
    for page in pages[1:]:
        out = _align(out, _fold(parse(page)))
    return out


def _slot_text(g: Group, several: bool) -> int:
    """Characters in text slots outside of links and furniture."""
    if g.furniture or g.link:
        return 0
    own = g.slot_chars if g.text is None or not several else 0
    return own + sum(_slot_text(k, several) for k in g.kids)


def main_path(wrapper: Group, pages: int) -> list[str]:
    """Signatures from the page down to the group that holds the article."""
    found: list[tuple[int, int, list[str]]] = []

    def seek(g: Group, path: list[str]) -> None:
        if g.furniture:
            return
        if g.main:
            found.append((_slot_text(g, False), -len(path), path))
        for kid in g.kids:
            seek(kid, [*path, kid.sig])

    seek(wrapper, [])
    found = [f for f in found if f[0]]
    if found:
        shared = found[0][2]
        for _, _, path in found[1:]:
            same = next((i for i, (x, y) in enumerate(zip(shared, path)) if x != y), min(len(shared), len(path)))
            shared = shared[:same]
        most = max(found)[0]
        whole = [f for f in found if f[0] == most]
        held = sum(f[0] for f in found if not any(o is not f and f[2][:len(o[2])] == o[2] for o in found))  # by the outermost
        return max(whole, key=lambda f: len(f[2]))[2] if most == held else shared
    path, at = [], wrapper
    total = _slot_text(wrapper, pages > 1)
    while total:
        nxt = max(at.kids, key=lambda k: _slot_text(k, pages > 1), default=None)
        if nxt is None or nxt.repeated or _slot_text(nxt, pages > 1) < total:
            break
        path, at = [*path, nxt.sig], nxt
    return path


def _along(el: Element, path: list[str]) -> list[Element]:
    """The outermost elements of the page at the path."""
    level = [el]
    for sig in path:
        level = [k for e in level for k in e.kids if isinstance(k, Element) and k.sig == sig]
    return level


def blocks_of(el: Element) -> list[str]:
    """Texts of the blocks inside an element, without furniture."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join("".join(line).split())
        if words:
            out.append(words)
        line.clear()

    def walk(e: Element, within: bool) -> None:
        within = within or is_main(e)
        for kid in e.kids:
            if isinstance(kid, str):
                line.append(kid)
            elif kid.tag == "br":
                line.append(" ")
            elif not is_furniture(kid, within):
                block = kid.tag in BLOCKS
                if block:
                    flush()
                walk(kid, within)
                if block:
                    flush()

    walk(el, False)
    flush()
    return out


def extract(source: str | None, path: list[str] | None) -> str:
    """Main text of a page along the path of its template's wrapper."""
    return _cut(parse(source), path)


def _cut(page: Element, path: list[str] | None) -> str:
    spots = _along(page, path) if path else []
    if not spots:
        own = main_path(_fold(page), 1)
        spots = _along(page, own)
    return "\n\n".join(b for e in spots for b in blocks_of(e))


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, n_pages, path): the wrapper of every template, by the
    path of its main group as JSON."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.release()
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(source.as_py())
                key = host, skeleton(page)
                one = _fold(page)
                if key in held:
                    held[key] = [_align(held[key][0], one), held[key][1] + 1]
                else:
                    held[key] = [one, 1]
                if len(held) >= HELD_WRAPPERS:
                    yield partial(held)
                    held = {}
        yield partial(held)

    def partial(held) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                pa.array([n for _, n in held.values()], pa.int64()), pa.array([json.dumps(pack(g)) for g, _ in held.values()], pa.string())],
                               names=["host", "template", "n_pages", "wrapper"])

    def merged(tab: pa.Table) -> tuple[Group, int]:
        rows = sorted(zip(tab["wrapper"].to_pylist(), tab["n_pages"].to_pylist()))
        out = unpack(json.loads(rows[0][0]))
        for w, _ in rows[1:]:
            out = _align(out, unpack(json.loads(w)))
        return out, sum(n for _, n in rows)

    def share(tab: pa.Table) -> pa.Table:
        g, n = merged(tab)
        return pa.table({"host": [tab["host"][0].as_py()], "template": [tab["template"][0].as_py()], "n_pages": pa.array([n], pa.int64()), "wrapper": [json.dumps(pack(g))]})

    def finish(tab: pa.Table) -> pa.Table:
        g, n = merged(tab)
        return pa.table({"host": [tab["host"][0].as_py()], "template": [tab["template"][0].as_py()], "n_pages": pa.array([n], pa.int64()),
                         "path": [json.dumps(main_path(g, n))]})

    kind = "host string, template string, n_pages long, wrapper string"
    parts = jobs.table(pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(fold, kind), "partial")
    some = (parts.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_SHARES)))
            .groupBy("host", "template", "share").applyInArrow(share, kind))
    return some.groupBy("host", "template").applyInArrow(finish, "host string, template string, n_pages long, path string")


def main_text(pages: DataFrame) -> DataFrame:
    """The pages' columns without html, plus text (the main text)."""
    spark = pages.sparkSession
    jobs.prepare(spark)
    # (A template of one page is cut by its own path anyway.)
    fitted = jobs.table(wrappers(pages.select("url", "html")).where("n_pages > 1"), "wrappers")
    size = fitted.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 96), F.lit(0))).collect()[0][0]
    known = None
    if size <= BROADCAST_CHARS:
        rows = fitted.select("host", "template", "path").toArrow().to_pylist()
        known = spark.sparkContext.broadcast({(r["host"], r["template"]): json.loads(r["path"]) for r in rows})
    keep = [f for f in pages.schema if f.name not in ("html", "text")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    names = [f.name for f in keep]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.release()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield batch.slice(lo, 256)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = []
            for source, host in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()):
                page = parse(source)
                texts.append(_cut(page, known.value.get((host, skeleton(page)))))
            yield pa.record_batch([*part.columns[:len(keep)], pa.array(texts, pa.string())], names=[*names, "text"])

    def name_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [skeleton(parse(source)) for source in part.column(len(keep)).to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(found, pa.string())], names=[*names, "html", "__host", "__template"])

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [extract(source, json.loads(path) if path is not None else None)
                     for source, path in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist())]
            yield pa.record_batch([*part.columns[:len(keep)], pa.array(texts, pa.string())], names=[*names, "text"])

    rows = pages.select(*names, "html", _host(F.col("url")).alias("__host"))
    if known is not None:
        return rows.mapInArrow(cut, schema + "text string")
    named = rows.mapInArrow(name_template, schema + "html string, __host string, __template string")
    paths = fitted.select(F.col("host").alias("__h"), F.col("template").alias("__t"), F.col("path").alias("__path"))
    joined = named.join(paths, (F.col("__host") == F.col("__h")) & (F.col("__template") == F.col("__t")), "left")
    return joined.select(*names, "html", "__path").mapInArrow(cut_joined, schema + "text string")
