"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its tags (with their path and class) and its text blocks.  Tokens of one host
whose occurrence vectors over the host's pages are equal form an equivalence class; a vector is kept
as a fingerprint that partial sums can build (the exclusive or of a hash of page and count), so even
a host with a third of all pages never meets in one task.  Classes that are frequent, ordered and
properly nested, as each page of the host is asked, make the host's template.  A text is frequent among the pages that have its element,
so each layout of a host has its own classes.  What a page has outside its template are slots; the main
text is the slots of its article (or of its main element; or, where a page has neither, of its body),
without regions that menus, notices, adverts, forms, comments and the like fill.  An article without
any slot keeps its text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.common import Tables

#: A text belongs to a template if this share of the host's pages with its element has it, and so many pages at least.
LEAST_SHARE, LEAST_PAGES = 0.5, 3
#: A layout counts if this share of its host's pages has it, which bounds a host's classes.
LEAST_LAYOUT = 0.01
#: Templates of all hosts are broadcast up to this size and joined by host beyond it, where the pages of a
#: host are spread over so many keys and its template is repeated for each of them.
BROADCAST_BYTES, KEYS_A_HOST = 16 << 20, 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("head nav header footer aside form script style noscript template menu dialog button select textarea iframe svg math canvas audio video object title search noembed noframes input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside rail notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe signup login ad ads advert adverts advertisement adsense sponsor sponsored promo promotion comment comments disqus respond reply replies share sharing social related recommended widget pagination pager toolbar skip".split()
)
#: Words that a class or id may have beside those of NAMES; any other word gives it another meaning.
NEUTRAL = frozenset("area bar block bottom box container fixed global inner item items left list main outer primary right secondary site slot sticky text top unit wrap wrapper".split())
_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    path: int
    left_out: bool
    article: bool
    main: bool
    block_at: int = 0  # depth of the innermost block that is this element or around it
    closed: bool = False  # ended while elements inside it go on


@dataclass
class Page:
    tags: list[tuple[int, int]] = field(default_factory=list)  # path (as a hash) of each start tag, place
    blocks: list[tuple[int, str, Element, int]] = field(default_factory=list)  # path, text, region, place


class _Open:
    """The open elements of a page; every step takes constant time, spread over the elements, at any depth."""

    def __init__(self):
        self.stack = [Element("", 0, False, False, False)]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each tag, innermost last

    def innermost(self, tag: str) -> int:
        """Depth of the innermost open element of a tag (0: none)."""
        return (self.depths.get(tag) or [0])[-1]

    def add(self, own: Element) -> None:
        own.block_at = len(self.stack) if own.tag in BLOCK else self.stack[-1].block_at
        self.depths.setdefault(own.tag, []).append(len(self.stack))
        self.stack.append(own)

    def cut(self, depth: int) -> None:
        """Ends the element at a depth and all inside it, and those around it that had ended before."""
        while len(self.stack) > max(depth, 1) or self.stack[-1].closed:
            if not (e := self.stack.pop()).closed:
                self.depths[e.tag].pop()

    def end(self, depth: int) -> None:
        """Ends the innermost element of its tag; what is inside goes on."""
        self.stack[depth].closed = True
        self.depths[self.stack[depth].tag].pop()
        self.cut(len(self.stack))

    def ended_by(self, ended: set[str]) -> int:
        """Depth of the outermost of the innermost blocks that are all of some tags (0: none)."""
        first, at = 0, self.stack[-1].block_at
        while at and self.stack[at].tag in ended:
            first, at = at, self.stack[at - 1].block_at
        return first


class _Markup:
    """Finds the comments and tags of a source one after the other, in linear time."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.broken = -1  # before here quotes are not followed: one of them is never closed

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next one; comments have no name."""
        source = self.source
        while m := _OPEN.search(source, at):
            start = at = m.start()
            at += 1
            if m[0] == "<!--":
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                continue
            if m[0] in ("<!", "<?"):
                return start, source.find(">", start) + 1, "", "", ""
            named = _NAME.match(source, start)
            end = named.end()
            if start >= self.broken:
                end = _REST.match(source, end).end()
                if source[end : end + 1] != ">":
                    self.broken = end
            if start < self.broken:
                end = source.find(">", named.end())
                if end < 0:
                    continue
            return start, end + 1, named[1], named[2].lower(), source[named.end() : end]
        return None


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 14)
def _below(path: int, tag: str, name: str) -> int:
    return _key(f"{path}/{tag}.{name}")


def block_token(path: int, text: str) -> int:
    return _key(f"{path}\n{text}")


@lru_cache(1 << 14)
def _telling(token: str) -> bool:
    """Whether a whole class or id names a part of the layout: no word of it means anything else."""
    words = {w.lower() for w in _WORD.findall(token)}
    return bool(words & NAMES) and words <= NAMES | NEUTRAL


@lru_cache(1 << 14)
def _left_out(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element opens a region that is never main text, and its class for the path."""
    if not attributes or attributes.isspace():
        return tag in LEFT_OUT, ""
    found = {m[1].lower(): entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    out = tag in LEFT_OUT or found.get("role", "").strip().lower() in ROLES
    if not out and tag not in ("html", "body", "article", "main"):
        out = any(_telling(token) for token in names.split())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        out = True
    return out, found.get("class", "").strip()


def read(source: str) -> Page:
    """Tags and text blocks of a page, in order.  Unclosed and crossed tags are tolerated."""
    page, opened = Page(), _Open()
    stack = opened.stack
    held: list[str] = []
    place = 0

    def flush() -> None:
        nonlocal place
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            place += 1
            page.blocks.append((stack[-1].path, text, stack[-1], place))

    at, n, markup = 0, len(source), _Markup(source)
    while at < n:
        m = markup.find(at)
        if m is None:
            held.append(source[at:])
            break
        held.append(source[at : m[0]])
        _, at, slash, tag, attributes = m
        if not tag:
            continue
        if slash:
            if depth := opened.innermost(tag):
                if stack[-1].block_at >= depth or stack[-1].left_out != stack[depth - 1].left_out:
                    flush()
                    opened.cut(depth)
                else:
                    opened.end(depth)
            continue
        if tag == "br":
            held.append(" ")
            continue
        out, name = _left_out(tag, attributes)
        above = stack[-1]
        if tag in BLOCK or out != above.left_out:
            flush()
            if tag in BLOCK:  # a block ends open paragraphs, an item the item before it
                ended = {"p"} if tag not in ("li", "dt", "dd", "option", "tr", "td", "th") else {"p", tag}
                if first := opened.ended_by(ended):
                    opened.cut(first)
        above = stack[-1]
        path = _below(above.path, tag, name)
        place += 1
        page.tags.append((path, place))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        own = Element(tag, path, above.left_out or out, above.article or tag == "article", above.main or tag == "main")
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(source, at)
            end = close.start() if close and close.start() < markup.last else n
            if not own.left_out:
                held.append(source[at:end])
            at = source.find(">", end) + 1 if end < n else n
            continue
        opened.add(own)
    flush()
    return page


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) -> (host, token, is_text, element, page, count)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            out: list[tuple] = []
            for host, page_key, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page = read(source or "")
                counts = Counter([*((p, False, p) for p, _ in page.tags), *((block_token(p, t), True, p) for p, t, _, _ in page.blocks)])
                out += [(host, token, text, element, page_key, c) for (token, text, element), c in counts.items()]
            if out:
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "token", "is_text", "element", "page", "n"])


def structure(sequence: list[tuple[int, int]]) -> tuple[dict[int, tuple[int, ...] | None], set[tuple[int, int]]]:
    """What one page says about its classes, from its (class, token) occurrences in order.

    A class's tokens occur equally often, so its occurrences are cut into tuples of all its tokens.
    First: the order of each class's tokens, or None if two tuples differ.  Second: the pairs of
    classes with tuples that cross, neither lying in one gap of the other nor outside it.
    """
    widths: dict[int, set[int]] = {}
    for c, token in sequence:
        widths.setdefault(c, set()).add(token)
    held: dict[int, list[int]] = {c: [] for c in widths}
    orders: dict[int, tuple[int, ...] | None] = {}
    crossing: set[tuple[int, int]] = set()
    stack: list[int] = []
    for c, token in sequence:
        own = held[c]
        if not own:
            stack.append(c)
        elif stack[-1] != c:  # tuples that began since are still open
            crossing |= {(min(c, x), max(c, x)) for x in stack[stack.index(c) + 1 :]}
        own.append(token)
        if len(own) == len(widths[c]):
            order = tuple(own)
            orders[c] = order if orders.get(c, order) == order and len(set(order)) == len(order) else None
            own.clear()
            stack.remove(c)
    return orders | {c: None for c, own in held.items() if own}, crossing


#: Sequences of classes, and hosts, that a task remembers, so that pages of one layout are looked at once.
_REMEMBERED, _REMEMBERED_HOSTS = 1 << 14, 64


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, classes of tokens) -> (host, a, b, order): orders of class a (0: none), and crossing pairs."""
    seen: set[int] = set()
    hosts: dict[str, dict[int, int]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            out: set[tuple] = set()
            for i, (host, source) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if host not in hosts:
                    if len(hosts) >= _REMEMBERED_HOSTS:
                        hosts.clear()
                    hosts[host] = {t["token"]: t["cls"] for t in part.column(2)[i].as_py()}
                known = hosts[host]
                page = read(source or "")
                places = [(k, p) for p, k in page.tags if p in known]
                places += [(k, x) for p, t, _, k in page.blocks if (x := block_token(p, t)) in known]
                sequence = [(known[t], t) for _, t in sorted(places)]
                mark = hash((host, tuple(t for _, t in sequence)))
                if mark in seen:
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen.add(mark)
                orders, crossing = structure(sequence)
                out |= {(host, c, None, _key(repr(o)) if o else 0) for c, o in orders.items()}
                out |= {(host, a, b, None) for a, b in crossing}
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "a", "b", "ordered"])


def nested(classes: list[dict], pages: int = 0, crossing: set[tuple[int, int]] | None = None, unordered: frozenset[int] = frozenset()) -> list[dict]:
    """The classes that are ordered and lie whole inside, or whole outside, each class taken before.

    Classes of more pages come first.  With ``crossing`` (pairs of ``cls``) and ``unordered``, what
    the pages themselves say decides.  Without, mean places (``first``, ``last``) do: these are means
    over a class's own pages, so a class of less than half of the ``pages`` is compared with those of
    the same pages only, by their fingerprint ``own``.
    """
    kept: list[dict] = []
    for c in sorted(classes, key=lambda c: (-c["support"], -len(c["tokens"]), c["tokens"])):
        if crossing is not None:
            fits = c["cls"] not in unordered and all((min(c["cls"], k["cls"]), max(c["cls"], k["cls"])) not in crossing for k in kept)
        else:
            fits = all((2 * c["support"] < pages and c["own"] != k["own"]) or c["last"] < k["first"] or c["first"] > k["last"] or (k["first"] <= c["first"] and c["last"] <= k["last"]) for k in kept)
        if fits:
            kept.append(c)
    return kept


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens of frequent classes, unordered classes, crossing pairs) -> (host, text tokens of the template, number of classes)."""
    for batch in batches:
        hosts, texts, sizes = [], [], []
        for host, tokens, unordered, crossing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            classes: dict[int, dict] = {}
            for t in tokens:
                c = classes.setdefault(t["cls"], {"cls": t["cls"], "support": t["support"], "tokens": [], "texts": []})
                c["tokens"].append(t["token"])
                if t["is_text"]:
                    c["texts"].append(t["token"])
            for c in classes.values():
                c["tokens"].sort()
            valid = nested(list(classes.values()), crossing={(x["a"], x["b"]) for x in crossing or ()}, unordered=frozenset(unordered or ()))
            hosts.append(host)
            texts.append(sorted(x for c in valid for x in c["texts"]))
            sizes.append(len(valid))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["host", "template", "n_classes"])


def host_of(url):
    """Lower-case host of a URL column; null or other text gives an empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def with_host(pages: DataFrame, hosts: DataFrame, size: int, how: str) -> DataFrame:
    """``pages`` with the one row of their host out of ``hosts``, which take ``size`` bytes."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(hosts), "host", how)
    keyed = pages.withColumn("_key", F.pmod(F.xxhash64("html"), F.lit(KEYS_A_HOST)))
    return keyed.join(hosts.withColumn("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(KEYS_A_HOST - 1).cast("long")))), ["host", "_key"], how).drop("_key")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, n_classes): hashed text blocks of each host's template.

    All pages count.  Equal pages (same url and html) count once, so copies make no template.  A
    host's frequent tokens are at most ``1 / LEAST_LAYOUT`` times the tokens of its mean page, so its
    template is a bounded list however many pages the host has.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))
    tables = Tables(pages.sparkSession)
    seen = tables.write("seen", bare.mapInArrow(_tokens, "host string, token long, is_text boolean, element long, page long, n int").groupBy("host", "token", "is_text", "element", "page").agg(F.max("n").alias("n")))
    size = bare.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    vectors = seen.groupBy("host", "token", "is_text", "element").agg(F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    often = vectors.where(F.col("support") >= LEAST_PAGES)
    often = tables.write("often", often.join(tables.write("size", size), "host").where(F.col("support") >= LEAST_LAYOUT * F.col("pages")))
    with_element = often.where("not is_text").select("host", "element", F.col("support").alias("_with"))
    often = often.join(with_element, ["host", "element"], "left").where(F.col("support") >= LEAST_SHARE * F.coalesce("_with", "pages"))
    often = often.withColumn("cls", F.xxhash64("support", "vector")).select("host", "token", "is_text", "support", "cls")
    lists = tables.write("lists", often.groupBy("host").agg(F.collect_list(F.struct("token", "is_text", "support", "cls")).alias("tokens")))
    listed = lists.select("host", F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), t["cls"].alias("cls"))).alias("tokens"))
    size = listed.agg(F.sum(F.size("tokens").cast("long") * 16 + 64)).first()[0] or 0
    # Pages of a host with candidates are read once more: do they keep the order and the nesting?
    said = with_host(bare.select("host", "html"), listed, size, "inner")
    said = tables.write("said", said.mapInArrow(_structures, "host string, a long, b long, ordered long").distinct())
    unordered = said.where("b is null").groupBy("host", "a").agg(F.count("*").alias("orders"), F.min(F.col("ordered") != 0).alias("kept")).where("orders > 1 or not kept").groupBy("host").agg(F.collect_list("a").alias("unordered"))
    crossing = said.where("b is not null").groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("crossing"))
    out = lists.join(unordered, "host", "left").join(crossing, "host", "left").select("host", "tokens", "unordered", "crossing")
    out = tables.write("templates", out.mapInArrow(_deduce, "host string, template array<long>, n_classes int"))
    tables.remove("seen", "often", "size", "lists", "said")
    return out


def main_text(source: str, template: frozenset[int] | set[int]) -> str:
    """The page's main text: one line for each block that is a slot.

    An article (or main element) that is all template is no frame around slots, so its blocks stay.
    """
    page = read(source)
    inside = [b for b in page.blocks if not b[2].left_out]
    slots = [b for b in inside if block_token(b[0], b[1]) not in template] if template else inside
    for kind in ("article", "main"):
        if own := [b for b in inside if getattr(b[2], kind)]:
            return "\n".join(b[1] for b in [b for b in slots if getattr(b[2], kind)] or own)
    return "\n".join(b[1] for b in slots)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = [main_text(h or "", frozenset(t or ())) for h, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, the main text and its number of code points.

    Null or empty html, and pages without main text, give an empty text.  Very long pages are read whole,
    in linear time.  Repeated rows are extracted each, and as one page for the template; classes of equal
    support are taken in the order of their tokens.  Null ids and urls stay (null urls are one host); an
    empty table gives no rows; further columns are not read.
    """
    found = templates(pages).where("size(template) > 0")
    size = found.agg(F.sum(F.size("template").cast("long") * 8 + 64)).first()[0] or 0
    found = found.select("host", "template")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = pages.select("page_id", "url", html.alias("html"), host_of(F.col("url")).alias("host"))
    joined = with_host(bare, found, size, "left")
    kinds = [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extract, T.StructType(kinds))
