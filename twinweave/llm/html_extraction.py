"""Main text of web pages by union-free wrappers inferred per host."""

from __future__ import annotations

import bisect
import functools
import html as entities
import json
import re
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.runtime import drop_table, materialise, materialise_at, small_batches

#: Wrappers up to this many hosts are broadcast; more are joined.
HOST_BOUND = 20_000
#: Partial wrappers of a host that one task aligns; more meet in rounds.
FAN = 64
#: Local summaries a task holds before it sends them on.
LOCAL_KEYS = 20_000
#: A text is the template's if so many distinct pages of the host have it at a container, outside and
#: inside a marked main region, and they are this share of the pages that have the container.
SAME_PAGES = 3
SAME_MARKED = 5
SAME_SHARE = 0.9
#: A container with this share of a page's weight holds all of the content.
HOLDS = 0.8
#: What a character in a marked main region weighs.
MARKED = 8
#: Containers named in a signature: the outermost and the innermost ones.
NAMED = 32

_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "object", "noframes")
_NEVER = frozenset("nav footer aside form button select option label input dialog menu canvas audio video head".split()) | frozenset(_RAW)
_MAIN = frozenset("article main".split())
# Class and id names are evidence only if all their words are among these, one of them in the first set:
# "site-footer" is, "has-sidebar", "share-enabled" and "related-work" aren't.
_OUTER = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related recommended respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
_PLAIN = frozenset("area article articles bar block bottom box button buttons buttons container content form group inner item items left link links list main page panel post posts primary reader readers right row secondary section site slot stories top unit user users wrap wrapper".split())
_MAIN_NAMES = frozenset("article articlebody maincontent postcontent entrycontent storybody".split())
_CONTAINERS = frozenset("html body div section center details dl fieldset table tbody tr td".split())
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:\-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _outer(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in _OUTER for w in words) and all(w in _OUTER or w in _PLAIN for w in words)


@functools.lru_cache(100_000)
def _named(tag: str, attributes: str) -> tuple[str, str, str]:
    """(signature, kind, kind inside a main region) of an open tag; a kind is 'out', 'main' or ''.

    A signature ends in * if the tag opens a main region. Names don't take out the
    page or a main region; ids inside one are anchors.
    """
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes)]
    words = {w for key, value in found if key in ("class", "id") for w in re.split(r"[^a-z0-9]+", value) if w}
    whole = {re.sub(r"[^a-z0-9]", "", w) for key, value in found if key in ("class", "id", "itemprop") for w in value.split()}
    roles = {w for key, value in found if key == "role" for w in value.split()}
    marked = tag in _MAIN or bool(whole & _MAIN_NAMES) or "main" in roles
    signature = tag + "".join(f".{w}" for w in sorted(words)[:4] if not w.isdigit())
    never = tag in _NEVER or bool(roles & _ROLES_OUT) or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))
    by_class = any(_outer(w) for key, value in found if key == "class" for w in value.split())
    by_id = any(_outer(w) for key, value in found if key == "id" for w in value.split())
    if tag in ("html", "body") or tag in _MAIN and not (whole & {"comment", "comments"}):
        by_class = by_id = False
    kind = "out" if never or by_class or by_id else "main" if marked else ""
    inside = "out" if never or by_class or by_id and tag not in _ANCHORED else "main" if marked else ""
    return signature + "*" * (kind == "main"), kind, inside


_ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd a span".split())


def blocks_of(page: str) -> list[tuple[str, str, str]]:
    """(signature, kind, text) of a page's blocks in order; kind as in _named, from all open tags.

    A signature is the path of the containers around the block. Unclosed tags,
    stray ends and a cut-off end of the page are taken as they come; nesting is not
    bounded. Text in an inline tag of kind 'out' is in no block.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str, str]] = []  # tag, signature, kind
    tags: dict[str, int] = defaultdict(int)  # how many are open, of a tag, of a kind, of inline tags of kind out
    path: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                kind = "out" if tags["kind out"] or tags["header"] and not tags["kind main"] else "main" if tags["kind main"] else ""
                out.append((">".join(path if len(path) <= 2 * NAMED else path[:NAMED] + path[-NAMED:]), kind, text))

    def push(entry):
        stack.append(entry)
        tags[entry[0]] += 1
        tags[f"kind {entry[2]}"] += 1
        if entry[0] in _BLOCK:
            path.append(entry[1])
        elif entry[2] == "out":
            tags["inline out"] += 1

    def pop():
        entry = stack.pop()
        tags[entry[0]] -= 1
        tags[f"kind {entry[2]}"] -= 1
        if entry[0] in _BLOCK:
            path.pop()
        elif entry[2] == "out":
            tags["inline out"] -= 1
        return entry[0]

    def hold(text):
        if not tags["inline out"]:
            held.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<":
                hold("<")
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in _RAW:
            # Raw text: nothing inside is markup; its text is never shown as content.
            close = _closing(tag).search(page, at)
            if tag in ("svg", "select", "object", "template", "noscript", "iframe") and not close:
                continue
            at = close.end() if close else end
            continue
        if tag == "br":
            hold(" ")
        elif tag in _VOID:
            if tag in _BLOCK:
                flush()
        elif closing:
            if tags[tag]:
                if tag in _BLOCK:
                    flush()
                while stack and pop() != tag:
                    pass
        else:
            if tag in _BLOCK:
                flush()
                if tags["head"] and tag != "head":  # content ends an unclosed head
                    i = max(i for i, s in enumerate(stack) if s[0] == "head")
                    below = stack[i + 1 :]
                    while len(stack) > i:
                        pop()
                    for entry in below:
                        push(entry)
                if tags["p"] and any(s[0] == "p" for s in stack[-6:]):  # a block ends an open paragraph and what is open in it
                    i = max(i for i, s in enumerate(stack) if s[0] == "p")
                    if not any(s[0] in _BLOCK for s in stack[i + 1 :]):
                        while len(stack) > i:
                            pop()
                ends = _CLOSES.get(tag)
                if ends:
                    for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                        if stack[i][0] in ends:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "select"):
                            break
            if not m[3].endswith("/"):
                signature, kind, inside = _named(tag, m[3])
                push((tag, signature, inside if tags["kind main"] else kind))
    flush()
    return out


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


# A wrapper is a list of items [signature, kind, optional, repeated, pages, chars, text hash or None].
# The hash is kept while every page has the same text there: a constant. Without it the item is a text slot.


def structure(blocks: list[tuple[str, str, str]]) -> list[list]:
    """A page's own wrapper: neighbours of one signature are a repeated group."""
    out: list[list] = []
    for signature, kind, text in blocks:
        if out and out[-1][0] == signature and out[-1][1] == kind:
            out[-1][3], out[-1][5], out[-1][6] = 1, out[-1][5] + len(text), None
        else:
            out.append([signature, kind, 0, 0, 1, len(text), zlib.crc32(text.encode())])
    return _folded(out)


def _folded(items: list[list]) -> list[list]:
    """Repeated runs of two or three items (a b a b) become one group of repeated items."""
    for width in (2, 3):
        i, out = 0, []
        while i < len(items):
            key = [x[:2] for x in items[i : i + width]]
            j = i + width
            while len(key) == width and [x[:2] for x in items[j : j + width]] == key:
                j += width
            if j > i + width:
                for k in range(width):
                    same = items[i + k : j : width]
                    out.append([*key[k], max(x[2] for x in same), 1, same[0][4], sum(x[5] for x in same), None])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, least places first among equals."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    places: dict = defaultdict(list)
    for j in range(len(b) - last - 1, first - 1, -1):
        places[b[j]].append(j)
    tails: list[int] = []  # least end in b of a common subsequence of each length
    ends: list[tuple] = []  # and the chain that it ends
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):  # from the last place on, so that one a takes one b
            k = bisect.bisect_left(tails, j)
            link = (i, j, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            elif j < tails[k]:
                tails[k], ends[k] = j, link
    middle, link = [], ends[-1] if ends else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [*((i, i) for i in range(first)), *reversed(middle), *((len(a) - k, len(b) - k) for k in range(last, 0, -1))]


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for both: shared items in order, the rest optional; differing texts make slots."""
    out: list[list] = []
    i = j = 0
    for k, l in [*_common([tuple(x[:2]) for x in a], [tuple(x[:2]) for x in b]), (len(a), len(b))]:
        out += [[x[0], x[1], 1, *x[3:]] for x in (*a[i:k], *b[j:l])]
        if k < len(a):
            x, y = a[k], b[l]
            out.append([*x[:2], max(x[2], y[2]), max(x[3], y[3]), x[4] + y[4], x[5] + y[5], x[6] if x[6] == y[6] else None])
        i, j = k + 1, l + 1
    merged: list[list] = []
    for x in out:  # a mismatch that repeats its neighbour is a repeated group
        if merged and merged[-1][:2] == x[:2]:
            y = merged[-1]
            merged[-1] = [*x[:2], min(x[2], y[2]), 1, max(x[4], y[4]), x[5] + y[5], x[6] if x[6] == y[6] else None]
        else:
            merged.append(x)
    return merged


def content(wrapper: list[list], same: frozenset[int] = frozenset()) -> list[tuple[str, float]]:
    """What each slot that isn't out weighs: its characters on a page that has it, on average, MARKED times in a main region.

    Items whose one text is the template's are no slots.
    """
    chars: dict[str, int] = defaultdict(int)
    pages: dict[str, int] = defaultdict(int)
    for signature, kind, _, _, seen, size, text in wrapper:
        if kind != "out" and not (text is not None and _place(signature, kind, text) in same):
            chars[signature] += size * (MARKED if kind == "main" else 1)
            pages[signature] = max(pages[signature], seen)
    return [(s, chars[s] / pages[s]) for s in sorted(chars)]


def region(slots: dict[str, float]) -> str:
    """The innermost container that holds the content of a page with slots of these weights.

    From the root on, a container inside the last one is taken while it holds
    HOLDS of its weight, that of containers inside it included; so sections beside
    each other stay together. Inside a main region only main regions are taken.
    """
    at, inside = "", slots
    while True:
        sums: dict[str, float] = defaultdict(float)
        for s, size in inside.items():
            tag = s[len(at) :].lstrip(">").split(">", 1)[0]
            if tag.endswith("*") or not at.endswith("*") and tag.split(".", 1)[0] in _CONTAINERS:
                sums[f"{at}>{tag}" if at else tag] += size
        top = max(sorted(sums), key=lambda c: sums[c], default=None)
        if top is None or sums[top] < HOLDS * sum(inside.values()):
            return at
        at, inside = top, {s: size for s, size in inside.items() if _within(s, top)}


def _within(signature: str, container: str) -> bool:
    return not container or signature == container or signature.startswith(f"{container}>")


def _structures(batches):
    """Per task, each host's distinct structures, aligned slot by slot."""
    held: dict[tuple[str, str], list] = {}

    def flush():
        rows = [(h, zlib.crc32(k.encode()), json.dumps(v)) for (h, k), v in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "salt", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = structure(blocks_of(page or ""))
            if own:
                key = (host or "", json.dumps([x[:2] for x in own]))
                held[key] = align(held[key], own) if key in held else own
                if len(held) > LOCAL_KEYS:
                    yield flush()
                    held = {}
    if held:
        yield flush()


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper from a host's partial ones, the most frequent structure first."""
    alike: dict[str, list] = {}
    for w in map(json.loads, sorted(rows.wrapper)):  # those of one structure first, so that it doesn't matter which task met them
        key = json.dumps([x[:2] for x in w])
        alike[key] = align(alike[key], w) if key in alike else w
    wrappers = sorted(alike.values(), key=lambda w: (-max(x[4] for x in w), -len(w), json.dumps(w)))
    found = wrappers[0]
    for w in wrappers[1:]:
        found = align(found, w)
    return pd.DataFrame({"host": [rows.host.iloc[0]], "salt": [int(rows.salt.min())], "wrapper": [json.dumps(found)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of all pages (host, html).

    Every page takes part. Tasks first reduce their pages to distinct structures,
    so a hot host sends as many rows as it has structures per task; equal ones meet,
    then about FAN of a host at a time, in rounds, until each host has one.
    """
    ddl = "host string, salt long, wrapper string"
    partial, path = materialise_at(pages.select("host", "html").mapInArrow(_structures, ddl), "html-partial")
    rounds = 0
    while True:
        counts = partial.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= FAN:
            break
        parts = F.ceil(F.col("n") / FAN).cast("long")
        group = F.pmod(F.xxhash64(F.lit(rounds), "salt"), parts)
        grouped = partial.join(counts, "host").withColumn("part", group).groupBy("host", "part").applyInPandas(_aligned, ddl)
        following, following_path = materialise_at(grouped, "html-partial")
        drop_table(pages.sparkSession, path)
        partial, path, rounds = following, following_path, rounds + 1
    return partial.groupBy("host").applyInPandas(_aligned, ddl).select("host", "wrapper")


def place_of(signature: str, kind: str, text: str) -> int:
    """Hash of a block's container, whether it is marked (bit 32), and its text."""
    return _place(signature, kind, zlib.crc32(text.encode()))


def _place(signature: str, kind: str, text: int) -> int:
    return (zlib.crc32(signature.encode()) >> 2) << 33 | (kind == "main") << 32 | text


def _places(batches):
    """host, place and page text of all blocks that may be content."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks = [b for b in blocks_of(page or "") if b[1] != "out"]
            places = {place_of(*b) for b in blocks}
            out[0].extend([host or ""] * len(places))
            out[1].extend(places)
            out[2].extend([zlib.crc32("\n".join(b[2] for b in blocks).encode())] * len(places))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "place", "page"])


def template_texts(pages: DataFrame) -> DataFrame:
    """host and the sorted places of the texts that its template repeats at one container.

    Pages alike in what may be content count once. The rows shuffled are three
    numbers and a host per block; equal ones meet in their task first.
    """
    found = materialise(pages.select("host", "html").mapInArrow(_places, "host string, place long, page long"), "html-places")
    texts = found.distinct().groupBy("host", "place").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.shiftright("place", 32) % 2 == 1, SAME_MARKED).otherwise(SAME_PAGES))
    around = found.select("host", F.shiftright("place", 32).alias("item"), "page").distinct().groupBy("host", "item").agg(F.count("*").alias("of"))
    same = texts.withColumn("item", F.shiftright("place", 32)).join(around, ["host", "item"]).where(F.col("n") >= SAME_SHARE * F.col("of"))
    return same.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("same"))


def main_text(page: str, slots: dict[str, float] | frozenset[str], same: frozenset[int] = frozenset()) -> str:
    """A page's content blocks: those in the region that its slots' weights in the wrapper show, without the template's texts.

    A page or a main region that holds nothing else keeps them. Slots that the wrapper doesn't know
    weigh what the page itself has there. Where marked main regions and others lie
    beside each other in the region, the marked ones are meant.
    """
    blocks = [b for b in blocks_of(page) if b[1] != "out"]
    own = [b for b in blocks if place_of(*b) not in same]
    if not any(b[1] == "main" for b in own):
        own = [b for b in blocks if b[1] == "main" or place_of(*b) not in same] or blocks
    sizes: dict[str, float] = defaultdict(float)
    for s, kind, t in own:
        sizes[s] += len(t) * (MARKED if kind == "main" else 1)
    at = region({s: slots[s] if s in slots else size for s, size in sizes.items()})
    found = [(kind, t) for s, kind, t in own if _within(s, at)]
    marked = any(kind == "main" for kind, _ in found)
    return "\n\n".join(t for kind, t in found if kind == "main" or not marked)


@functools.lru_cache(10_000)
def _slots(wrapper: str | None, places: tuple[int, ...]) -> dict[str, float]:
    return dict(content(json.loads(wrapper), _same(places))) if wrapper else {}


@functools.lru_cache(10_000)
def _same(places: tuple[int, ...]) -> frozenset[int]:
    return frozenset(places)


def _extracted(wrappers):
    def run(batches):
        for batch in batches:
            ids, urls, hosts, pages = (batch.column(i) for i in range(4))
            found = [wrappers.value.get(h or "", (None, None)) for h in hosts.to_pylist()] if wrappers else list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            texts = [main_text(p or "", _slots(w, tuple(same or ())), _same(tuple(same or ()))) for p, (w, same) in zip(pages.to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of the main text of every page.

    Blocks are joined in page order by two line feeds, white space inside a block
    is one space, character references are decoded. A null or empty html, and a
    page without content, gives an empty text; a null URL counts as one host.
    Repeated rows give equal texts; an empty table gives no rows; other columns
    are not read.

    Wrappers are union-free expressions over blocks: items in order, optional or
    repeated, each a constant or a text slot, inferred by aligning the block
    streams of a host's pages. They decide on every page: each of its slots weighs
    its average characters in the wrapper (MARKED times in a main region that the
    markup names), and the innermost container that holds nearly all weight (HOLDS)
    is the content. Pages of other templates or with containers of their own so have
    their own region. Texts that nearly all of a host's distinct pages with a
    container repeat there (SAME_PAGES, SAME_MARKED, SAME_SHARE) are the template's
    and no content, also in a main region or a repeated group. Tags, roles and names
    of menus, notices, adverts and the like are out wherever they stand. The result
    doesn't depend on how rows are dealt.
    """
    from twinweave.llm.url_filter import host_of

    small_batches(pages.sparkSession)
    url = F.col(url_col).cast("string")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = materialise(infer_wrappers(given).join(template_texts(given), "host", "left"), "html-wrappers")
    schema = "page_id long, url string, text string, n_chars long"
    n, size = wrappers.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper") + 8 * F.coalesce(F.size("same"), F.lit(0))), F.lit(0))).first()
    if n <= HOST_BOUND and size < 64 << 20:
        known = pages.sparkSession.sparkContext.broadcast({r.host: (r.wrapper, tuple(r.same or ())) for r in wrappers.collect()})
        return given.mapInArrow(_extracted(known), schema)
    return given.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper", "same").mapInArrow(_extracted(None), schema)
