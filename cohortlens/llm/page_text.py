"""Main text of web pages by template deduction: tokens that occur alike across a host's pages are its template."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, stored, text_or_empty

#: Comments, marks, elements whose content is no text, and tags. What the page's end cuts goes to the end, so every character is looked at a bounded number of times.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|noscript|template|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_CUE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:[\s>=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[^a-z]+")
#: Fixed values from HTML: elements without content, elements inside a line, and elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav header footer aside form button select option fieldset head dialog menu object canvas audio video script style".split())
#: Words of class, id or role names that mark what is not the article, words that say nothing beside them, and words that mark the article.
ASIDE_CUES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login search widget toolbar pagination pager complementary contentinfo".split())
NEUTRAL = frozenset("area bar block bottom box btn button buttons col column container count desktop first form global group heading icon icons inner item items label last left links list mobile module more outer page panel policy post posts primary reader readers right row secondary section sections site slot small sticky sub tags text thread title top unit user users wrap wrapper".split())
MAIN_CUES = frozenset("main content article story".split())
#: Elements that hold a line or paragraph, never the whole article.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address".split())
#: An open element of these ends where another of its group starts, as HTML has it.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table div section article main nav aside footer header form body".split())


def _label(name: str, tag: str) -> tuple[str, bool]:
    """(the element with its class, id and role names, digits as one sign; whether it is beside the article).

    A name of cue and neutral words only, with a cue, says so, unless another name of the element marks the article: `cookie-notice` does, `share-price` doesn't.
    """
    names = sorted({w for m in _CUE.finditer(tag) for w in (m[1] or m[2] or m[3] or "").lower().split()})
    words = [[x for x in _PARTS.split(w) if x] for w in names]
    cued = any(x and not ASIDE_CUES.isdisjoint(x) and all(y in ASIDE_CUES or y in NEUTRAL for y in x) for x in words)
    main = name in ("html", "body", "article", "main") or any(not MAIN_CUES.isdisjoint(x) for x in words)
    label = name + "".join("." + re.sub(r"\d+", "0", w) for w in names)
    return label, name in ASIDE or bool(_HIDDEN.search(tag)) or cued and not main


def _hash(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class _Open:
    """The open elements. Lists of where each name, each element that isn't inside a line, and each that holds others is open make every look-up a constant one."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # element, and its place (that of the element round it for those inside a line)
        self.named: dict[str, list[int]] = {}
        self.outside: list[int] = []
        self.holds: list[int] = []

    def lists(self, name: str) -> Iterator[list[int]]:
        yield self.named.setdefault(name, [])
        if name not in INLINE:
            yield self.outside
        if name in _HOLDS:
            yield self.holds

    def push(self, name: str, place: int) -> None:
        for some in self.lists(name):
            some.append(len(self.stack))
        self.stack.append((name, place))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            for some in self.lists(self.stack.pop()[0]):
                some.pop()

    def last(self, name: str) -> int:
        return self.named[name][-1] if self.named.get(name) else -1

    def place(self) -> int:
        return self.stack[-1][1] if self.stack else -1


def blocks(page: str) -> tuple[list[tuple[int, int, str, bool, int]], list[tuple[int, str]], list[tuple[bool, int]]]:
    """The page's places, its blocks of text, and both in the order in which they start.

    A place is (place above it or -1, hash of its path of labels, element, beside the article or not, how many elements are there); places come after those
    above them. A block is (place or -1, text) in page order. The order has (is a place, number of the place or block). Character references are decoded, and white space is one space. Scripts, styles,
    titles and HTML comments hold no text. Missing end tags are supplied, and those without a start are ignored. A tag that the page's end cuts holds no text. Time grows with the page's length, whatever its tags.
    """
    found: dict[int, int] = {}
    places: list[list] = []
    out: list[tuple[int, str]] = []
    order: list[tuple[bool, int]] = []
    open_ = _Open()
    piece: list[str] = []
    labels: dict[str, tuple[str, bool]] = {}  # of the page's tags
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            order.append((False, len(out)))
            out.append((open_.place(), text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if m[1] or tag[1] in "!?":
            if m[1]:
                flush()
            continue
        if tag[-1] != ">":  # the page's end cuts it
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            start = open_.last(name)
            if start >= 0:
                if name not in INLINE or open_.outside and open_.outside[-1] > start:
                    flush()
                open_.cut(start)
            elif name not in INLINE:
                flush()
            continue
        if tag not in labels:
            labels[tag] = _label(name, tag)
        label, beside = labels[tag]
        if name not in INLINE or beside:
            flush()
        if name in VOID or tag.endswith("/>"):
            continue
        held = open_.holds[-1] if open_.holds else -1
        ends = [some[bisect_right(some, held)] for some in map(open_.named.get, _CLOSES.get(name, ())) if some and some[-1] > held]
        if ends:
            open_.cut(min(ends))
        above = open_.place()
        if name in INLINE and not beside:
            open_.push(name, above)
            continue
        path = _hash((places[above][1].to_bytes(8, "little", signed=True) if above >= 0 else b"") + label.encode("utf-8", "surrogatepass"))
        if path not in found:
            found[path] = len(places)
            order.append((True, len(places)))
            places.append([above, path, name, beside, 0])
        places[found[path]][4] += 1
        open_.push(name, found[path])
    if at < len(page):
        piece.append(page[at:])
    flush()
    return [tuple(x) for x in places], out, order


def main_blocks(places: list[tuple[int, int, str, bool]], found: list[tuple[int, int]], mass: dict[int, int], fixed: set[int]) -> list[int]:
    """Which blocks (place, token) of a page are its main text, by its template: the ``mass`` of each place in it, which is the text in its slots that differs between pages, and the ``fixed`` texts.

    A place is (place above it, its hash, element, beside). What an element beside the article holds is left out. Each other block is in the slot of the nearest place of the template round it. From the page
    on down, the main region is the place of the template with most of the differing text of those below, as long as it holds four fifths of it and the lines beside it on the way down are at most a twentieth of the whole, or
    as it is an article or main element; it ends at an article, and never is one line. Slots in the region are the text, without the template's own texts.
    """
    slot, out_of = [], []  # of each place: the nearest place of the template from it upwards, and whether it is in one that is beside
    for k, (above, token, _, beside) in enumerate(places):
        slot.append(k if token in mass else slot[above] if above >= 0 else -1)
        out_of.append(beside or (above >= 0 and out_of[above]))
    region = [mass.get(x[1], 0) for x in places]
    lines = region.copy()  # of each place of the template: what differs in its own slot and in those of the lines in it
    below: dict[int, list[int]] = {}
    for k in reversed(range(len(places))):  # places come after those above them
        above, _, element, _ = places[k]
        if slot[k] == k and not out_of[k]:
            up = slot[above] if above >= 0 else -1
            if up >= 0:
                region[up] += region[k]
                lines[up] += region[k] if element in TEXT_LEVEL else 0
            if element not in TEXT_LEVEL:
                below.setdefault(up, []).append(k)
    main, names, lost = -1, ("article", "main"), 0
    while below.get(main) and not (main >= 0 and places[main][2] == "article"):
        some = below[main]
        best = max(some, key=lambda k: (region[k], places[k][2] in names, -k))
        whole = region[main] if main >= 0 else sum(region[k] for k in some)
        lost += lines[main] if main >= 0 else 0
        if places[best][2] not in names and (region[best] < 0.8 * whole or 20 * lost > sum(region[k] for k in below[-1])):
            break
        main = best
    inside = [False] * len(places)
    for k, (above, *_) in enumerate(places):
        inside[k] = k == main or main < 0 or (above >= 0 and inside[above])
    return [j for j, (k, token) in enumerate(found) if token not in fixed and (inside[k] and not out_of[k] if k >= 0 else main < 0)]


#: Bytes of templates that are sent to every executor; larger tables are joined by shuffling the pages.
_BROADCAST = 32 << 20


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Of a page: its places, its blocks, and its distinct tokens (places and texts at their places) in the order of their first occurrence.
BLOCKS = (
    "page_id long, url string, host string, layout long, page long, above array<int>, path array<long>, element array<string>, beside array<boolean>, place array<int>, block array<long>, text array<string>, "
    "token array<long>, is_place array<boolean>, parent array<long>, times array<int>, chars array<int>"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    types = [pa.list_(_KINDS[k[6:-1]]) if k.startswith("array") else _KINDS[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _parsed(page_id: int | None, url: str | None, page: str) -> tuple:
    places, found, order = blocks(page)
    beside, depth, shape = [], [], set()
    for above, path, element, own, _ in places:
        beside.append(own or (above >= 0 and beside[above]))
        depth.append(depth[above] + 1 if above >= 0 else 1)
        if depth[-1] <= 3 and element not in TEXT_LEVEL:
            shape.add(path)
    up = [places[k][1] if k >= 0 else 0 for k, _ in found]  # 0: no place
    block = [_hash(f"{p}\n{text}".encode("utf-8", "surrogatepass")) for p, (_, text) in zip(up, found, strict=True)]
    content = xxhash.xxh64()
    for t, (k, _) in zip(block, found, strict=True):
        if k < 0 or not beside[k]:
            content.update(t.to_bytes(8, "little", signed=True))
    often = Counter(block)
    tokens = {}
    for is_place, k in order:
        if is_place:
            above, path, _, _, times = places[k]
            tokens[path] = (True, places[above][1] if above >= 0 else 0, times, 0)
        else:
            tokens.setdefault(block[k], (False, up[k], often[block[k]], len(found[k][1])))
    above, path, element, own, _ = map(list, zip(*places, strict=True)) if places else ([],) * 5
    is_place, parent, times, chars = map(list, zip(*tokens.values(), strict=True)) if tokens else ([],) * 4
    layout = _hash(b"".join(p.to_bytes(8, "little", signed=True) for p in sorted(shape)))
    return (page_id, url, _host(url), layout, content.intdigest() - (1 << 63), above, path, element, own, [k for k, _ in found], block, [t for _, t in found], list(tokens), is_place, parent, times, chars)


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``BLOCKS`` of every page; ``page`` is a hash of the blocks not beside the article, ``layout`` one of the containers in its three upper levels."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (some for whole in parts for some in byte_slices(whole, "html", 1 << 20)):
            yield _batch([_parsed(*x) for x in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True)], BLOCKS)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(parse, BLOCKS)


def split_classes(token: list[int], parent: list[int], vector: list[int]) -> list[int]:
    """Each token's class: those of equal vector whose nearest place round them that has another vector is the same one, so that a class lies in one slot of the class above it. 0 for tokens that are alone."""
    kind = dict(zip(token, vector, strict=True))
    up = dict(zip(token, parent, strict=True))
    outer: dict[int, int] = {}
    for t in token:
        chain = []
        while t not in outer:
            chain.append(t)
            above = up[t]
            if kind.get(above) != kind[t]:
                outer[t] = above
            else:
                t = above
        for c in chain:
            outer[c] = outer[t]
    key = [_hash(kind[t].to_bytes(8, "little", signed=True) + outer[t].to_bytes(8, "little", signed=True)) or 1 for t in token]
    size = Counter(key)
    return [k if size[k] >= 2 else 0 for k in key]


def templates(found: DataFrame, text_share: float = 0.9, place_share: float = 0.05, least_pages: int = 3, order_share: float = 0.9) -> DataFrame:
    """(host, layout, paths, masses, fixed): the template of each host, or, where layout isn't null, of the pages of one layout on hosts of fewer than ``least_pages`` distinct pages.

    Tokens are places and texts at their places. A token's occurrence vector over the distinct pages is kept as sums (pages, occurrences, and hashes of page and count), so that tokens with
    equal vectors meet without any vector being gathered. Frequent are places on ``place_share`` of the pages and on ``least_pages`` of them, and texts on ``text_share`` of the pages and one more. A class is the
    frequent tokens of equal vector in one slot of the class above (:func:`split_classes`). It is valid if it has two tokens or more, which start in one order on ``order_share`` of its pages. The valid
    classes, nested by their places, are the template. A place's mass is the characters of the distinct texts in its slots: what all pages say counts once, what differs counts for each. At most a page's tokens over the shares are gathered for a template.
    """
    arrays = ("token", "is_place", "parent", "times", "chars")
    # copies of a page have equal blocks but for those beside: one of them, always the same, stands for all
    once = found.where("size(token) > 0").groupBy("host", "page").agg(F.min_by(F.struct("layout", *arrays), F.xxhash64("layout", *arrays)).alias("t")).select("host", "page", "t.*")
    small = once.groupBy("host").agg(F.count("*").alias("n")).select("host", (F.col("n") < least_pages).alias("small"))
    once = stored(once.join(small, "host").select(F.when(~F.col("small"), F.col("host")).alias("host"), F.when(F.col("small"), F.col("layout")).alias("layout"), "page", *arrays).withColumn("h", F.xxhash64("host", "layout")), "pages")
    sizes = once.groupBy("h").agg(F.count("*").alias("pages"), F.min("host").alias("host"), F.min("layout").alias("layout"))
    tokens = once.select("h", "page", F.explode(F.arrays_zip("token", "is_place", "parent", "times")).alias("t")).select("h", "page", "t.*")
    vectors = tokens.groupBy("h", "token", "is_place", "parent").agg(F.count("*").alias("on"), F.sum("times").alias("times"), F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).alias("sign"))
    often = F.col("is_place") & (F.col("on") >= F.greatest(F.lit(least_pages), place_share * F.col("pages"))) | ~F.col("is_place") & (F.col("on") >= text_share * (F.col("pages") + 1))
    frequent = vectors.join(sizes.select("h", "pages"), "h").where(often).select("h", "token", "is_place", "parent", F.xxhash64("on", "times", "sign").alias("vector"))
    gathered = frequent.groupBy("h").agg(F.collect_list(F.struct("token", "is_place", "parent", "vector")).alias("t")).select("h", *(F.col(f"t.{n}").alias(f"t_{n}") for n in ("token", "is_place", "parent", "vector")))

    def classes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(h, t, is_place, split_classes(t, parent, vector)) for h, t, is_place, parent, vector in zip(*(part.column(n).to_pylist() for n in ("h", "t_token", "t_is_place", "t_parent", "t_vector")), strict=True)]
            if rows:
                yield _batch(rows, "h long, t_token array<long>, t_is_place array<boolean>, t_class array<long>")

    def orders(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(at, 256) for whole in parts for at in range(0, whole.num_rows, 256)):
            rows = []
            for h, token, t, c in zip(*(part.column(n).to_pylist() for n in ("h", "token", "t_token", "t_class")), strict=True):
                of, seen = dict(zip(t, c, strict=True)), {}
                for x in token:
                    if of.get(x):
                        seen.setdefault(of[x], []).append(x)
                rows += [(h, k, _hash(b"".join(x.to_bytes(8, "little", signed=True) for x in some))) for k, some in seen.items()]
            if rows:
                yield _batch(rows, "h long, class long, order long")

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(at, 256) for whole in parts for at in range(0, whole.num_rows, 256)):
            rows = []
            for h, token, is_place, parent, chars, paths in zip(*(part.column(n).to_pylist() for n in ("h", *arrays[:3], "chars", "paths")), strict=True):
                mine, slot = set(paths), {0: 0}
                for x, p, up, n in zip(token, is_place, parent, chars, strict=True):  # places come after those above them
                    slot[x] = x if p and x in mine else slot[up]
                    if not p and slot[x]:
                        rows.append((h, slot[x], x, n))
            if rows:
                yield _batch(rows, "h long, slot long, token long, n int")

    nested = stored(gathered.mapInArrow(classes, "h long, t_token array<long>, t_is_place array<boolean>, t_class array<long>"), "classes")
    ordered = once.select("h", "token").join(nested, "h").mapInArrow(orders, "h long, class long, order long").groupBy("h", "class", "order").count()
    valid = ordered.groupBy("h", "class").agg(F.max("count").alias("most"), F.sum("count").alias("all")).where(F.col("most") >= order_share * F.col("all")).select("h", "class")
    flat = nested.select("h", F.explode(F.arrays_zip("t_token", "t_is_place", "t_class")).alias("t")).select("h", F.col("t.t_token").alias("token"), F.col("t.t_is_place").alias("is_place"), F.col("t.t_class").alias("class"))
    kept = stored(flat.join(valid, ["h", "class"]).groupBy("h").agg(F.collect_list(F.when(F.col("is_place"), F.col("token"))).alias("paths"), F.collect_list(F.when(~F.col("is_place"), F.col("token"))).alias("fixed")), "kept")
    differing = once.select("h", "token", "is_place", "parent", "chars").join(kept.select("h", "paths"), "h").mapInArrow(slots, "h long, slot long, token long, n int")
    mass = differing.groupBy("h", "slot", "token").agg(F.max("n").alias("n")).groupBy("h", "slot").agg(F.sum("n").alias("n")).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("n"))
    masses = F.transform("paths", lambda p: F.coalesce(F.try_element_at("n", p), F.lit(0).cast("long")))
    return kept.join(mass, "h", "left").join(sizes, "h").select("host", "layout", "paths", masses.alias("masses"), "fixed")


def own_template(places: list[tuple[int, int, str, bool]], found: list[tuple[int, int]], text: list[str]) -> dict[int, int]:
    """The mass of every place of a page that has no template: the characters of its own text."""
    mass = {x[1]: 0 for x in places}
    for (k, _), t in zip(found, text, strict=True):
        if k >= 0:
            mass[places[k][1]] += len(t)
    return mass


def extract_main_text(pages: DataFrame, text_share: float = 0.9, place_share: float = 0.05, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's page_id, url, text and n_chars.

    The template of a page's host, or on hosts with few pages of its layout (see :func:`templates`), nests by containment and cuts the page into slots; the main region is the place of the
    template whose slots differ most between pages (see :func:`main_blocks`), and what these slots hold is the page's text. Elements whose names say that they are beside the article are left out. A page with nothing
    of a template goes by its own places.

    Null html is empty, a page without url belongs to the host ''; repeated rows are each returned; no rows give no rows.
    """
    require(pages, id_col, url_col, html_col)
    found = stored(parsed_pages(pages, id_col, url_col, html_col), "blocks")
    template = stored(templates(found, text_share, place_share), "templates")
    held = template.agg(F.sum(40 + F.coalesce(F.length("host"), F.lit(0)) + 16 * F.size("paths") + 8 * F.size("fixed"))).first()[0] or 0
    known = found.select("page_id", "url", "host", "layout", "above", "path", "element", "beside", "place", "block", "text")
    for of in ("host", "layout"):
        some = template.where(F.col(of).isNotNull()).select(of, *(F.col(n).alias(f"{of}_{n}") for n in ("paths", "masses", "fixed")))
        known = known.join(F.broadcast(some) if held <= _BROADCAST else some, of, "left")
    known = known.select("*", *(F.coalesce(f"host_{n}", f"layout_{n}").alias(n) for n in ("paths", "masses", "fixed")))

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("above", "path", "element", "beside", "place", "block", "text", "paths", "masses", "fixed")
        for part in (whole.slice(at, 256) for whole in parts for at in range(0, whole.num_rows, 256)):
            keys, held, out = list(zip(part.column("host").to_pylist(), part.column("layout").to_pylist(), strict=True)), {}, []
            for k, key in enumerate(keys):
                above, path, element, beside, place, token, text, *_ = (part.column(n)[k].as_py() for n in names[:7])
                if key not in held:
                    paths, masses, fixed = (part.column(n)[k].as_py() or [] for n in names[7:])
                    held[key] = dict(zip(paths, masses, strict=True)), set(fixed)
                places, some = list(zip(above, path, element, beside, strict=True)), list(zip(place, token, strict=True))
                mass, fixed = held[key]
                if not any(p in mass and e not in ("html", "head", "body") for p, e in zip(path, element, strict=True)):
                    mass = own_template(places, some, text)
                out.append(" ".join([text[j] for j in main_blocks(places, some, mass, fixed)]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return known.select("page_id", "url", "host", "layout", "above", "path", "element", "beside", "place", "block", "text", "paths", "masses", "fixed").mapInArrow(texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
