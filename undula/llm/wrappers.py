"""Main-text extraction by union-free regular expressions inferred per host.

A page is a stream of block tags and text slots. Adjacent repeats in a stream become repeated groups, `( ... )+`; then
the streams of one host are aligned, one distinct stream at a time: what all have stays, what only some have becomes optional,
and texts that differ are slots. The result, the host's wrapper, is a flat expression without unions that says for each part on
how many pages it is; optional parts, brackets among them, are those that aren't on all.

Slots carry sums over all pages of the host: blocks, characters, characters inside links, whether the text was ever different, and
how often tags or names speak for an article or against it. The wrapper's main container is the deepest one, outside of groups, that
holds most of the host's text outside of links. A slot is main text by the sum of its evidence: inside the main container or not, its
share of the host's text, the length of its blocks, links, text that is the same on all pages while others differ, and, as a prior,
tags and names. A page is extracted by aligning it with its host's wrapper; text without a slot is judged by what is around it.

Only sums and sets of streams leave the tasks that read pages, and streams merge by the bits of their hashes, so a wrapper doesn't
depend on how pages are dealt, and no task gets more than a bounded number of streams of one host.

Defined results: null html is empty and has empty text; a null or odd url belongs to the host ''; repeated rows count and
return as often; unclosed and stray tags close as far as they match, and nothing but an unclosed script or style swallows what
follows it; an empty table gives no rows; further columns aren't looked at. Page ids are cast to long.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.lineage import cut
from undula.llm.common import map_batches, ship, table

#: Tags and names. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
HIDDEN = frozenset("template noscript iframe textarea svg canvas video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th tr tbody table ul ol dl".split())
CHROME_TAGS = frozenset("head nav footer aside form menu dialog button fieldset select".split())
ARTICLE_TAGS = frozenset("article main".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment "
    "comments commentlist disqus replies respond widget widgets pagination pager toolbar skip copyright".split()
)
OUTER_CHROME_NAMES = frozenset("header masthead banner topbar alert".split())
ARTICLE_ROLES = frozenset("main article".split())
CHROME_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = frozenset("li dd dt tr td th option".split())
CONTROLS = frozenset("select option optgroup button label".split())

#: Open elements that are kept; deeper inline tags are not followed, as browsers do.
DEPTH = 512
#: Keys of a repeated part, at most; keys of a wrapper, at most: beyond, the parts on the fewest pages go.
LONGEST, WRAPPER_KEYS = 256, 4000
#: Streams of a host that one task aligns, about, and wrappers that one merge takes.
STREAMS, FAN_IN = 64, 16

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)([^<>"']*+(?:(?<==)(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+)>""")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_QUOTE = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-zA-Z]+")


class Scanner:
    """Tags and texts of a source, in time linear in its length: what isn't found once isn't looked for again."""

    def __init__(self, source: str):
        self.source, self.lost = source, set()

    def find(self, what: str, at: int) -> int:
        if what in self.lost:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.lost.add(what)
        return found

    def behind(self, name: str, at: int) -> int:
        """The place behind the next closing tag of the name, or -1."""
        key = f"</{name}"
        if key in self.lost:
            return -1
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.source, at)
        if not m:
            self.lost.add(key)
            return -1
        return m.end()

    def _tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes count behind an equals sign, if they are closed."""
        while m := _QUOTE.search(self.source, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            k = m.start() - 1
            while self.source[k].isspace():
                k -= 1
            if self.source[k] == "=" and (close := self.find(m[0], at)) >= 0:
                at = close + 1
        return -1

    def __iter__(self) -> Iterator[tuple[str | None, bool, str]]:
        """(None, False, text) or (name, whether it closes, attributes)."""
        source, at, n = self.source, 0, len(self.source)
        self.at = 0
        while at < n:
            to = self.find("<", at)
            if to != at:
                yield None, False, source[at : to if to >= 0 else n]
                at = self.at = to if to >= 0 else n
                continue
            if m := _TAG.match(source, at):
                self.at = m.end()
                yield m[2].lower(), bool(m[1]), m[3]
            elif source.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = end + 3 if end >= 0 else self.find(">", at) + 1
                self.at = end or n
            elif source.startswith("<![CDATA[", at):
                end = self.find("]]>", at)
                self.at = end + 3 if end >= 0 else at + 9
            elif source.startswith(("<!", "<?"), at):
                self.at = self.find(">", at) + 1 or n
            elif (m := _OPEN.match(source, at)) and self.find(">", at) >= 0 and (end := self._tag_end(m.end())) >= 0:
                self.at = end + 1
                yield m[2].lower(), bool(m[1]), source[m.end() : end]
            else:
                self.at = at + 1
                yield None, False, "<"
            at = self.at  # the reader may have moved on


class Page:
    """A parsed page: `stream`, its keys; `texts`, for each text block its place in the stream, what it says, its characters in links, and
    whether tags or names speak against it (chrome) or for it (article)."""

    __slots__ = ("stream", "texts")

    def __init__(self, source: str):
        self.stream: list[str] = []
        self.texts: list[list] = []
        stack: list[tuple[str, bool, bool, int]] = []  # name, chrome, article, links
        open_: Counter = Counter()
        pieces: list[str] = []
        state = (False, False, 0)
        block_state = state
        linked = 0
        scanner = Scanner(source)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.texts.append([len(self.stream), text, min(linked, len(text)), block_state[0], block_state[1]])
                    self.stream.append("#")
            linked = 0

        def close(i: int) -> None:
            """Closes what is open from there on, as if each had its end tag."""
            for name, *_ in reversed(stack[i:]):
                open_[name] -= 1
                if name not in INLINE:
                    self.stream.append(f"</{name}")
            del stack[i:]

        for name, closes, said in scanner:
            if name is None:
                if not pieces:
                    block_state = state
                pieces.append(said)
                if state[2]:
                    linked += len(said)
                continue
            block = name not in INLINE
            if block:
                flush()
            elif name == "br" and pieces:
                pieces.append(" ")
            if closes:
                if open_[name]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                elif block:
                    self.stream.append(f"</{name}")
            else:
                if (name in CODE or name in HIDDEN) and not said.endswith("/"):
                    end = scanner.behind(name, scanner.at)
                    scanner.at = end if end >= 0 else len(source) if name in CODE else scanner.at
                    continue
                names, role = self._names(said)
                if block:
                    if name in CLOSES_P or name in SAME_CLOSES:
                        self._close_open(stack, close, name)
                    self.stream.append(f"<{name}{'.' + '.'.join(sorted(names)) if names else ''}")
                if name not in VOID and not said.endswith("/") and (block or len(stack) < DEPTH):
                    _, chrome, article, links = stack[-1] if stack else ("", False, False, 0)
                    against = name in CHROME_TAGS or role in CHROME_ROLES or bool(CHROME_NAMES & names) or name == "title" and not article
                    against = against or not article and (name == "header" or bool(OUTER_CHROME_NAMES & names))
                    chrome, article = chrome or against, (article or name in ARTICLE_TAGS or role in ARTICLE_ROLES) and not against
                    stack.append((name, chrome, article, links + (name == "a")))
                    open_[name] += 1
            state = stack[-1][1:] if stack else (False, False, 0)
        flush()
        close(0)
        self._collapse()

    @staticmethod
    def _names(attributes: str) -> tuple[frozenset[str], str]:
        if "=" not in attributes:
            return frozenset(), ""
        names, role = set(), ""
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                role = value
            else:
                names.update(_NAME.findall(value))
        return frozenset(names), role

    @staticmethod
    def _close_open(stack: list, close, name: str) -> None:
        """What a start tag closes: controls and an open p before a block, a neighbour of the same kind in lists and tables."""
        if name in CLOSES_P:
            while stack and stack[-1][0] in CONTROLS:
                close(len(stack) - 1)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == ("p" if name in CLOSES_P else name):
                close(i)
                return
            if stack[i][0] not in INLINE and not (name in SAME_CLOSES and stack[i][0] == "p"):
                return

    def _collapse(self, longest: int = LONGEST) -> None:
        """Adjacent repeats become repeated groups; texts move to the place of the first."""
        keys = self.stream
        place = np.arange(len(keys))  # of each key that was there at first
        size = 0
        while (size := size + 1) <= min(longest, len(keys) // 2):
            numbers: dict[str, int] = {}
            codes = np.fromiter((numbers.setdefault(k, len(numbers)) for k in keys), dtype=np.int64, count=len(keys)) if size == 1 or changed else codes
            changed = False
            # Where a run of keys equals the one behind it: as many equal pairs at that distance as the run is long.
            equal = np.concatenate(([0], np.cumsum(codes[:-size] == codes[size:])))
            again = set(np.flatnonzero(equal[size:] - equal[:-size] == size).tolist())
            if not again:
                continue
            out: list[str] = []
            moved = np.zeros(len(keys), dtype=np.int64)
            i, n = 0, len(keys)
            while i < n:
                # Brackets stay balanced inside a group.
                if i in again and _balanced(keys[i : i + size]):
                    body = keys[i : i + size]
                    start = len(out) + 1
                    out += ["(", *body, ")+"]
                    changed = True
                    while keys[i : i + size] == body:
                        moved[i : i + size] = range(start, start + size)
                        i += size
                else:
                    moved[i] = len(out)
                    out.append(keys[i])
                    i += 1
            if changed:
                keys, place = out, moved[place]
        for t in self.texts:
            t[0] = int(place[t[0]])
        self.stream = keys

    def slots(self) -> dict[int, list[int]]:
        """The sums of each place that has text."""
        own: dict[int, list[int]] = {}
        for place, text, links, chrome, article in self.texts:
            c = crc32(text.encode("utf-8", "surrogatepass"))
            own[place] = add_slots(own.get(place), [1, 1, len(text), links, c, c, int(chrome), int(article)])
        for s in own.values():
            s[0] = 1
        return own


def _balanced(keys: list[str]) -> bool:
    depth = 0
    for k in keys:
        depth += (k == "(") - (k == ")+")
        if depth < 0:
            return False
    return depth == 0


# A wrapper is {"pages": n, "parts": [[key, pages, slot], ...]}; a slot, at "#" only, is SLOT: sums but for the two checksums.
SLOT = ("pages", "blocks", "chars", "links", "low", "high", "chrome", "article")


def wrapper_of(stream: list[str], slots: dict[int, list], pages: int = 1) -> dict:
    return {"pages": pages, "parts": [[k, pages, slots.get(i)] for i, k in enumerate(stream)]}


def add_slots(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    return [*(x + y for x, y in zip(a[:4], b[:4], strict=True)), min(a[4], b[4]), max(a[5], b[5]), a[6] + b[6], a[7] + b[7]]


def align(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()


def generalise(a: dict, b: dict) -> dict:
    """The wrapper of all that a or b matches: shared parts once, parts of one alone on its pages only."""
    x, y, out = a["parts"], b["parts"], []
    i = j = 0
    for at_a, at_b, n in align([p[0] for p in x], [p[0] for p in y]):
        out += x[i:at_a] + y[j:at_b]
        out += [[p[0], p[1] + q[1], add_slots(p[2], q[2])] for p, q in zip(x[at_a : at_a + n], y[at_b : at_b + n], strict=True)]
        i, j = at_a + n, at_b + n
    if len(out) > WRAPPER_KEYS:
        least = sorted((p[1] for p in out), reverse=True)[WRAPPER_KEYS]
        out = [p for p in out if p[1] > least] or out[:WRAPPER_KEYS]
    return {"pages": a["pages"] + b["pages"], "parts": out}


def as_expression(wrapper: dict) -> str:
    """The wrapper to be read: optional parts have a question mark."""
    return " ".join(k + "?" * (n < wrapper["pages"]) for k, n, _ in wrapper["parts"])


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host(F.col("url").cast("string")).alias("host"))


def _streams(pages: DataFrame) -> DataFrame:
    """host, stream (keys by line), pages, slots (place and SLOT): every distinct stream of a host, once, with the sums of all its pages."""
    sums = ", ".join(f"{c} long" for c in SLOT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[list, dict[int, list]]] = {}

        def flush() -> pa.RecordBatch:
            made = [(host, stream, -1, *([n[0]] + [0] * 7)) for (host, stream), (n, _) in seen.items()]
            made += [(host, stream, place, *s) for (host, stream), (_, own) in seen.items() for place, s in own.items()]
            cols = list(zip(*made, strict=True))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["host", "stream", "place", *SLOT])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                n, own = seen.setdefault((host, "\n".join(page.stream)), ([0], {}))
                n[0] += 1
                for place, s in page.slots().items():
                    own[place] = add_slots(own.get(place), s)
                if len(seen) >= 2000:
                    yield flush()
        if seen:
            yield flush()

    each = map_batches(_source(pages), ["host", "html"], f"host string, stream string, place long, {sums}", rows)
    totals = [F.min(c).alias(c) if c == "low" else F.max(c).alias(c) if c == "high" else F.sum(c).alias(c) for c in SLOT]
    by_place = each.groupBy("host", "stream", "place").agg(*totals)
    slot = F.when(F.col("place") >= 0, F.struct("place", *SLOT))
    return by_place.groupBy("host", "stream").agg(F.max(F.when(F.col("place") < 0, F.col("pages"))).alias("pages"), F.collect_list(slot).alias("slots"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one for each host, from all of its pages. Written to the shared folder."""
    streams = cut(_streams(pages).withColumn("bits", F.shiftrightunsigned(F.xxhash64("stream"), 1)), "streams")
    most = streams.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = 1
    while groups * STREAMS < most:
        groups *= FAN_IN

    def first(t: pa.Table) -> pa.Table:
        made = sorted(zip(*(t.column(c).to_pylist() for c in ("pages", "stream", "slots")), strict=True), key=lambda r: (-r[0], r[1]))
        out = None
        for n, stream, slots in made:
            one = wrapper_of(stream.split("\n") if stream else [], {s["place"]: [s[c] for c in SLOT] for s in slots}, n)
            out = one if out is None else generalise(out, one)
        return _row(t, out)

    def merge(t: pa.Table) -> pa.Table:
        out = None
        for w in sorted(map(json.loads, t.column("wrapper").to_pylist()), key=lambda w: (-w["pages"], json.dumps(w))):
            out = w if out is None else generalise(out, w)
        return _row(t, out)

    def _row(t: pa.Table, wrapper: dict) -> pa.Table:
        return pa.table({"host": t.column("host").slice(0, 1), "at": t.column("at").slice(0, 1), "wrapper": pa.array([json.dumps(wrapper, separators=(",", ":"))])})

    ship(pages.sparkSession)
    schema = "host string, at long, wrapper string"
    made = streams.withColumn("at", F.pmod("bits", F.lit(groups))).groupBy("host", "at").applyInArrow(first, schema)
    while groups > 1:
        groups //= FAN_IN
        made = cut(made, "wrappers").withColumn("at", F.floor(F.col("at") / FAN_IN).cast("long")).groupBy("host", "at").applyInArrow(merge, schema)
    return cut(made.select("host", "wrapper"), "wrappers")


def _closed(keys: list[str]) -> list[tuple[int, int]]:
    """For each start tag of a wrapper its place and that of its end; alignment may leave one without, which ends with what is around it."""
    out, stack = [], []
    for i, k in enumerate(keys):
        if k.startswith("</"):
            name = k[2:]
            if any(keys[j][1:].split(".")[0] == name for j in stack):
                while True:
                    j = stack.pop()
                    out.append((j, i))
                    if keys[j][1:].split(".")[0] == name:
                        break
        elif k.startswith("<") and k[1:].split(".")[0] not in VOID:
            stack.append(i)
    return out + [(j, len(keys)) for j in stack]


class Extractor:
    """A wrapper, ready for its pages."""

    def __init__(self, wrapper: dict, least_pages: int = 5):
        parts = wrapper["parts"]
        self.keys = [p[0] for p in parts]
        slots = {i: dict(zip(SLOT, p[2], strict=True)) for i, p in enumerate(parts) if p[2]}
        constant = {i for i, s in slots.items() if s["pages"] >= least_pages and 2 * s["pages"] >= wrapper["pages"] and s["low"] == s["high"]}
        if len(constant) == len(slots):  # copies of one page say nothing about its parts
            constant = set()
        mass = {i: (s["chars"] - s["links"]) * (0.1 if i in constant or 2 * s["chrome"] > s["blocks"] else 3.0 if 2 * s["article"] > s["blocks"] else 1.0) for i, s in slots.items()}
        total = sum(mass.values()) or 1.0
        self.main = self._container(mass, total)
        self.kept: dict[int, bool] = {}
        self.inside: dict[int, bool] = {}
        for i, s in slots.items():
            self.inside[i] = self.main[0] < i < self.main[1]
            share = mass[i] / total
            score = 3 * s["article"] / s["blocks"] - 4 * s["chrome"] / s["blocks"] - 4 * s["links"] / s["chars"] + (2 + 1.5 * share if self.inside[i] else -2)
            self.kept[i] = score + _by_length(s["chars"] / s["blocks"]) - 4 * (i in constant and share < 0.2) > 0
        self.known: dict[tuple[str, ...], dict[int, int]] = {}

    def _container(self, mass: dict[int, float], total: float, most: float = 0.6) -> tuple[int, int]:
        """The ends of the deepest container outside of groups, other than a text block, that holds most of the text."""
        depth, grouped = 0, []
        for k in self.keys:
            depth += k == "("
            grouped.append(depth > 0)
            depth -= k == ")+"
        best = (-1, len(self.keys))
        for a, b in _closed(self.keys):
            if not grouped[a] and self.keys[a][1:].split(".")[0] not in TEXT_TAGS | CHROME_TAGS and b - a < best[1] - best[0] and sum(m for i, m in mass.items() if a < i < b) >= most * total:
                best = (a, b)
        return best

    def places(self, stream: list[str]) -> dict[int, int]:
        """For each place of a page's stream its place in the wrapper."""
        key = tuple(stream)
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = {b + k: a + k for a, b, n in align(self.keys, stream) for k in range(n)}
        return self.known[key]

    def text(self, page: Page) -> str:
        at = self.places(page.stream)
        slots = [at.get(t[0], -1) for t in page.texts]
        inside = [self.inside.get(s) for s in slots]
        out = []
        for k, ((_, text, links, chrome, article), slot) in enumerate(zip(page.texts, slots, strict=True)):
            if slot in self.kept:
                if self.kept[slot] and not (chrome and not article and 2 * links > len(text)):
                    out.append(text)
                continue
            # No page before had text here: as its neighbours, and by its own evidence.
            around = [next((x for x in some if x is not None), None) for some in (reversed(inside[:k]), inside[k + 1 :])]
            near = 2 if article or around == [True, True] else -2 if around == [False, False] else 0
            if 3 * article - 4 * chrome - 4 * links / len(text) + near + _by_length(len(text)) > 0:
                out.append(text)
        return "\n\n".join(out)


def _by_length(chars: float) -> float:
    return max(-1.0, min(1.0, math.log2(max(chars, 1) / 30) / 2))


def extract(pages: DataFrame, wrappers: DataFrame | None = None, broadcast_chars: int = 32_000_000) -> DataFrame:
    """page_id, url, text: the main text of each page. Wrappers are broadcast up to that size, beyond it joined by host. A page of a host
    without a wrapper is its own."""
    spark = pages.sparkSession
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    source = _source(pages)
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    shared = None
    if size <= broadcast_chars:
        shared = spark.sparkContext.broadcast({r[0]: r[1] for r in wrappers.collect()})
        source = source.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        source = source.join(wrappers, "host", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Extractor | None] = {}
        for batch in batches:
            texts = []
            for host, source, own in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if host not in ready:
                    if len(ready) > 2000:
                        ready.clear()
                    w = own if shared is None else shared.value.get(host)
                    ready[host] = Extractor(json.loads(w)) if w else None
                page = Page(source)
                texts.append((ready[host] or Extractor(wrapper_of(page.stream, page.slots()))).text(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(source, ["page_id", "url", "host", "html", "wrapper"], "page_id long, url string, text string", rows)


def op3_html(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
