"""Main-text extraction by equivalence-class template deduction.

Tokens are the places that block elements open at (the way to them through block elements, each with class, id and role),
because a tag plays another part wherever it stands. A token's occurrence vector counts it on every page of a host. Vectors
aren't gathered: each (page, count) gives a hash, and the hashes of a host's pages are combined by exclusive or,
so tokens with equal vectors have equal sums and form an equivalence class. A class is valid if its tokens occur
once on each of its pages, and on at least one page in ``SHARE`` of the host's; a valid class whose places lie
within those of other valid classes nests in them, and all that do are the host's template. The places of template tokens are its
slots. Rarer places are no part of it, so what is gathered of a host is bounded by ``SHARE`` times the places of a page.

Slots are told apart by what pages put into them: text that differs between pages and isn't a link's fills a slot, text that is the same on all
doesn't. The main slot is the smallest one that holds the pages' main heading and at least half of what fills them; without headings that stand on most pages,
the smallest one that holds all of it.
Within it, slots of links and slots of the same text on all pages go. Names of elements and classes come second: places named as menus,
notices and so on are left out, and where places named as articles hold half of what fills the main slot, they stand for it. From each
page the text below main slots is extracted; a page that has none of its template's main slots is read as a host of its own.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base
from quern.llm._text import mix

#: Template bytes that are broadcast at most; beyond, templates are joined by host.
BROADCAST_BYTES = 4_000_000
SHARE = 20
#: Pages of a host from which on a slot with the same text on all of them goes.
SAME = 10
_KNOWN = 100_000

# Element names of HTML and the words by which places name their part.
_RAW = ("script", "style", "template", "noscript", "textarea", "svg", "math", "iframe", "object", "canvas", "select", "head")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NO_PARAGRAPH = _BLOCK - {"br", "button", "caption", "legend", "option", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog search button".split())
_BOILER_WORDS = frozenset(
    "nav navigation navbar menu breadcrumb breadcrumbs header masthead topbar banner footer sidebar aside widget ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal overlay comment comments disqus replies reply respond share sharing social related recommended toolbar login search pagination pager copyright skip hidden".split()
)
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN_ROLES = frozenset({"main", "article"})

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|<!--|<[!?][^>]*+>")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"(?<![0-9a-z])[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _place(name: str, raw: str) -> tuple[str, int]:
    """(name with class, id and role, part): part 1 for main text, -1 for none, 0 if the place doesn't say."""
    if not raw.strip():
        return name, 1 if name in ("article", "main") else -1 if name in _BOILER_TAGS else 0
    marks, part, hidden = [], 0, False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or "")
        if key in ("class", "id", "role"):
            marks.append(f"{key}={' '.join(value.split())}")
            words = {w for w in _PART.findall(_HUMP.sub(" ", value).lower())}
            if key == "role":
                part = -1 if words & _BOILER_ROLES else 1 if words & _MAIN_ROLES and not part else part
            elif words & _BOILER_WORDS:
                part = -1
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    if hidden or name in _BOILER_TAGS or (part < 0 and name not in ("html", "body")):
        part = -1
    elif name in ("article", "main"):
        part = 1
    elif name in ("html", "body"):
        part = 0
    return f"{name}[{'|'.join(marks)}]" if marks else name, part


_children: dict[tuple[int, str], int] = {}


def _child(path: int, name: str) -> int:
    """The number of the place ``name`` within the place ``path``, the same everywhere; the page's is 0."""
    got = _children.get((path, name))
    if got is None:
        if len(_children) >= _KNOWN:
            _children.clear()
        got = int.from_bytes(hashlib.blake2b(path.to_bytes(8, "little") + name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        _children[path, name] = got
    return got


def walk(text: str) -> Iterator[tuple[str, int, int, int, str]]:
    """Events of a page: ("open", path, path around it, part, name) where a block element opens, ("text", path, whether in a link, part, data), ("break", path, 0, part, "").

    A path is that of block elements; text in other elements belongs to the block element around these. A place's part
    is that of its outermost place that isn't for main text, else 1 within main text. Scripts, styles, comments and the like
    give nothing. Unclosed and misnested elements are closed as browsers do in the simple cases.
    """
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # (name, path, part)
    names: Counter = Counter()  # of open elements
    at, n = 0, len(text)
    known: dict[tuple[str, str], tuple[str, int]] = {}
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            yield "text", stack[-1][1], int(names["a"] > 0), stack[-1][2], text[at:]
            return
        if m.start() > at:
            yield "text", stack[-1][1], int(names["a"] > 0), stack[-1][2], text[at : m.start()]
        at = m.end()
        if m.group(2) is None:
            if m.group() == "<!--":
                end = text.find("-->", m.start() + 2)
                at = n if end < 0 else max(end + 3, at)
            continue
        close, name, raw = m.group(1), m.group(2).lower(), m.group(3)
        block = name in _BLOCK
        if close:
            if names[name]:
                while True:
                    gone = stack.pop()[0]
                    names[gone] -= 1
                    if gone == name:
                        break
            if block:
                yield "break", stack[-1][1], 0, stack[-1][2], ""
            continue
        if name in _RAW:
            end = _END[name].search(text, at)
            at = at if end is None and name == "head" else n if end is None else end.end()
            continue
        if name in _NO_PARAGRAPH and names["p"]:
            depth = len(stack) - 1
            while stack[depth][0] not in ("p", "button", "td", "th", "caption", "article", "section", "div", "body", "li", ""):
                depth -= 1
            if stack[depth][0] == "p":
                for gone, _, _ in stack[depth:]:
                    names[gone] -= 1
                del stack[depth:]
        if name in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1][0] == name:
            names[stack.pop()[0]] -= 1
        if (name, raw) not in known:
            known[name, raw] = _place(name, raw)
        own, part = known[name, raw]
        _, above, state = stack[-1]
        if block:
            yield "break", above, 0, state, ""
        path = _child(above, own) if block else above
        state = -1 if state < 0 or part < 0 else max(state, part)
        if block:
            yield "open", path, above, state, name
        if name not in _VOID:
            stack.append((name, path, state))
            names[name] += 1


def main_text(text: str, slots: Iterable[int]) -> str:
    """The text below ``slots`` (those below zero are left out: the place ``-1 - slot``) without places for other things; white space as single spaces."""
    out: list[str] = []
    slots = frozenset(slots)
    inside: dict[int, bool] = {0: 0 in slots}
    for kind, path, above, part, data in walk(text):
        if kind == "open":
            inside[path] = path in slots or inside[above] and -1 - path not in slots
        if part >= 0 and inside[path]:
            out.append(html.unescape(data) if kind == "text" else " ")
    return " ".join("".join(out).split())


#: Of a place: the one around it, its depth, part and heading level, how often it opens, the lengths of its own text outside and within links, and a hash of both.
Place = tuple[int, int, int, int, int, int, int, int]


def tokens_of(text: str) -> dict[int, Place]:
    """The places of a page."""
    found: dict[int, list[int]] = {0: [0, 0, 0, 0, 1, 0, 0, 0]}
    for kind, path, above, part, data in walk(text):
        if kind == "open":
            x = found.get(path)
            if x is None:
                level = int(data[1]) if len(data) == 2 and data[0] == "h" and data[1].isdigit() else 0
                found[path] = [above, found[above][1] + 1, part, level, 1, 0, 0, 0]
            else:
                x[4] += 1
        elif kind == "text" and (data := " ".join(data.split())):
            x = found[path]
            if part >= 0 or x[2] < 0:
                x[6 if above else 5] += len(data)
                x[7] = (x[7] * 1000003 + int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")) & ((1 << 63) - 1)
    return {k: tuple(x) for k, x in found.items()}


def deduce(places: list[dict]) -> list[int]:
    """A host's main slots from its places: path, above, depth, part, level, pages, opens, vector, chars, linked, least, most.

    ``least`` and ``most`` are those of the places' text hashes: equal where all pages have the same text. Slots that go within main ones
    are returned as ``-1 - path``.
    """
    by = {p["path"]: p for p in places}
    total = by[0]["pages"] if 0 in by else 0
    classes: dict[int, list[dict]] = {}
    for p in places:
        classes.setdefault(p["vector"], []).append(p)
    good = [c for c in classes.values() if all(p["opens"] == p["pages"] and SHARE * p["pages"] >= total for p in c)]
    valid = {p["path"] for c in good for p in c}
    template = {0}
    for p in sorted(places, key=lambda p: p["depth"]):
        if p["path"] in valid and p["above"] in template:
            template.add(p["path"])
    below, linked, same, heads = Counter(), Counter(), Counter(), Counter()  # what fills each place: text that differs, text of links, text that doesn't differ, main headings
    alike = lambda p: p["least"] == p["most"] and total > 1
    level = min((p["level"] for p in places if p["level"] and p["path"] in template and p["part"] >= 0 and 2 * p["pages"] > total), default=0)
    for p in sorted(places, key=lambda p: -p["depth"]):
        path, above = p["path"], p["above"]
        if p["part"] >= 0:
            (same if alike(p) else below)[path] += p["chars"]
            linked[path] += p["linked"]
            if level and p["level"] == level and path in template:
                heads[path] += 1
        if path:
            for count in (below, linked, same, heads):
                count[above] += count[path]
    filled = {path: n for path, n in below.items() if n and path in template}
    if not filled:
        return [0]
    needed = below[0] / 2 if heads[0] else max(filled.values())
    held = [s for s, n in filled.items() if n >= needed and by[s]["part"] >= 0 and bool(heads[s]) == bool(heads[0])]
    main = max(held, key=lambda s: (by[s]["depth"], filled[s], s), default=0)
    named = [s for s in filled if by[s]["part"] > 0 and by[by[s]["above"]]["part"] <= 0]
    slots = sorted(named) if named and 2 * sum(filled[s] for s in named) >= filled.get(main, 0) else [main]
    gone = []
    if total > 1:
        for p in places:
            path = p["path"]
            around, n = path, below[path] + linked[path] + same[path]
            while around and around not in slots:
                around = by[around]["above"]
            if path in slots or around not in slots or path not in template or p["level"] or heads[path] or not n:
                continue
            if 2 * linked[path] > n or total >= SAME and 2 * p["pages"] > total and same[path] == n:
                gone.append(-1 - path)
    return [*slots, *sorted(gone)]


def _alone(text: str) -> list[int]:
    """The main slots of a page that stands for itself."""
    return deduce([{"path": k, "above": a, "depth": d, "part": p, "level": level, "pages": 1, "opens": n, "vector": n, "chars": chars, "linked": links, "least": h, "most": h} for k, (a, d, p, level, n, chars, links, h) in tokens_of(text).items()])


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PLACES = "host string, path long, above long, depth int, part int, level int, pages long, opens long, vector long, chars long, linked long, least long, most long"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots): the main slots of each host's template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        kinds = [pa.string(), *[pa.int64()] * 2, *[pa.int32()] * 3, *[pa.int64()] * 7]
        names = [c.split()[0] for c in _PLACES.split(", ")]

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("row", "host", "html")]
            for row, host, text in zip(*[batch.column(i) for i in at], strict=True):
                row, host = row.as_py(), host.as_py()
                places = tokens_of(text.as_py() or "")
                hashes = mix(np.array([row + 1], np.uint64)) ^ mix(np.array([p[4] for p in places.values()], np.uint64))
                hashes = mix(hashes).view(np.int64).tolist()
                for (path, (above, depth, part, level, n, chars, links, text_hash)), h in zip(places.items(), hashes, strict=True):
                    x = held.get((host, path))
                    if x is None:
                        held[host, path] = [above, depth, part, level, 1, n, h, chars, links, text_hash, text_hash]
                    else:
                        x[4:] = x[4] + 1, x[5] + n, x[6] ^ h, x[7] + chars, x[8] + links, min(x[9], text_hash), max(x[10], text_hash)
                if len(held) > 50_000:
                    yield out()
        if held:
            yield out()

    summed = _with_host(pages).mapInArrow(run, _PLACES).groupBy("host", "path").agg(
        F.max("above").alias("above"), F.max("depth").alias("depth"), F.max("part").alias("part"), F.max("level").alias("level"), F.sum("pages").alias("pages"), F.sum("opens").alias("opens"),
        F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    summed = _base.keep(summed, "places")  # read twice, so that pages aren't
    total = summed.where("path = 0").select("host", F.col("pages").alias("total"))
    common = summed.join(total, "host").where(F.lit(SHARE) * F.col("pages") >= F.col("total")).drop("total")
    gathered = common.groupBy("host").agg(F.collect_list(F.struct("path", "above", "depth", "part", "level", "pages", "opens", "vector", "chars", "linked", "least", "most")).alias("places"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([deduce(p) for p in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["host", "slots"])

    return _base.map_rows(gathered, lambda: step, "host string, slots array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; a null url has a host of its own with all others like it. Repeated
    rows are pages of their own, and other columns aren't kept, whatever their names. Nothing is cut, whatever a page's length;
    memory grows with a page's places, not with their depth.
    """
    found = _base.keep(templates(pages), "templates")
    size = found.agg(F.sum(F.length("host") + 8 * F.size("slots"))).first()[0] or 0
    rows = _with_host(pages).drop("row")
    placed = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [batch.schema.get_field_index(c) for c in ("html", "slots")]
        texts = []
        for page, slots in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
            page = page or ""
            texts.append(main_text(page, slots or ()) or main_text(page, _alone(page)))
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return _base.map_rows(placed, lambda: step, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_base.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
