"""Main text of web pages: markup proposes the main part, host suffix runs take boilerplate out of it.

A page becomes blocks in page order. Blocks inside menus, headers, footers, sidebars, forms, adverts,
notices, comments and the like are dropped, as the markup says. The others are candidates: those inside
article or main where a page has such blocks, else all. The candidates of a page are a token stream of
its host, and every page's stream, with article or without, is held against the others of the host:
suffixes of all streams that agree on their first DEPTH tokens (prefix doubling) form a run; overlapping ones
join to maximal runs, each at least DEPTH tokens long. A run is boilerplate if it stands in most stories of its
host, and in FEWEST of them at least: a passage that some stories share is text of each of them. A candidate goes
if boilerplate covers all its tokens.

Pages of one host are one story if their candidates are equal or nearly so: they agree in ALIKE or more
of SKETCH least hashes of their GRAM-token names (two pages that share five eighths of all their names
mostly do), in one of the pairs of them by which they meet. Chains of such pages are one story too.
A copy or a reprint under another address so counts once and stays whole; a host whose pages without
article differ in less than that keeps its boilerplate, for it cannot be told from copies.

Runs are grouped by (host, name) in Spark, and their stories counted. To move few rows, the first pass groups only anchors: the
least of the GRAM-token names within each DEPTH-token prefix, which equal prefixes share. Only
prefixes with a repeated anchor are grouped in the second pass, so nothing that repeats is lost. Of a
run's anchors only the first and last story moves, of a prefix each story once.

Defined cases: null html is empty and gives an empty text; null urls form a host of their own; pages
that repeat a page_id are extracted each, and count as one story; an empty table gives
no rows; other columns are ignored; pages are parsed whole; what dropped blocks say is no evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship
from tidewright.llm.components import connected_components

DEPTH = 12
FEWEST = 3
GRAM = 5
SKETCH = 16
ALIKE = 10
_TURNS = np.random.default_rng(61).integers(1, 1 << 63, (2, SKETCH, 1), dtype=np.uint64) | np.uint64(1)
BROADCAST_ROWS = 1_000_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
# Elements by role.
_SILENT = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "select", "button", "textarea", "canvas", "math", "audio", "video", "title"}
_RAW = {"script", "style", "textarea", "title"}
_IN_HEAD = {"meta", "link", "title", "style", "script", "base", "noscript", "template"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog"}
_MAIN = {"article", "main"}
_NESTING = {"div", "section", "header", "ul", "ol", "dl", "table", "figure", "fieldset", "details", "blockquote", "body", "span"} | _SILENT | _BOILERPLATE | _MAIN
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp",
           "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_LEAVES = {"p", "li", "td", "th", "tr", "dd", "dt", "a", "label", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "summary", "address"}
_MUTED = {"a*", "label*"}
_ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_ROLES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|nav\w*|menus?|breadcrumbs?"
    r"|sidebar|side-bar|widget|footer|masthead|comments?|comment-list|disqus|replies|reader-comments|share|sharing|social|related|recommended|pagination|toolbar|search"
    r"|navigation|complementary|contentinfo|dialog|form)(?=$|[\s_-])",
    re.I,
)
_WITHOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|with|without|no)[_-]\S*", re.I)  # says what a wrapper has, not what it is
KEEP, DROP, OPEN = 1, 0, 2
_WEAK = 3


def _self_closed(attributes: str) -> bool:
    """A slash ends the tag, and not an unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = (attributes[:-1].split() or [""])[-1]
    return "=" not in last or last[-1] in "\"'"


@lru_cache(maxsize=1 << 15)
def _inside(name: str, attributes: str, state: tuple[bool, bool, bool, bool]) -> tuple[bool, bool, bool, bool]:
    """(boilerplate, boilerplate by words or form, by a whole word, main) within an element opened under `state`.

    Words of an outer wrapper and forms do not reach into an article or main, unless that is part of
    another and the whole class, id or role is such a word (comments under an article).
    """
    bad, soft, firm, main = state
    roles = _WITHOUT.sub(" ", " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(attributes)))
    whole = any(_ROLES.fullmatch(r) for r in roles.split())
    if name != "body":
        bad |= bool(_HIDDEN.search(attributes))
    if name in _MAIN:
        return bad or whole, soft and firm and main, firm and main, True
    bad |= (name in _BOILERPLATE and name != "form") or (name == "header" and not main)
    return bad, soft or name == "form" or (name != "body" and bool(_ROLES.search(roles))), firm or (name != "body" and whole), main


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, KEEP | DROP | OPEN) of each non-blank block: inside the main part, boilerplate by markup, or neither.

    Blocks that only words or a form call boilerplate are open where the page has no other text.
    """
    html = html or ""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = []  # name, state outside it
    opened: Counter[str] = Counter()  # names on the stack
    silent = 0  # elements on the stack without text of their own
    state = (False, False, False, False)
    now = OPEN

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, now))

    def push(name: str) -> None:
        nonlocal silent
        stack.append((name, state))
        opened[name] += 1
        silent += name in _SILENT or name in _MUTED

    def pop() -> str:
        nonlocal state, silent
        name, state = stack.pop()
        opened[name] -= 1
        silent -= name in _SILENT or name in _MUTED
        return name

    at = 0
    while True:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        name, closing = (m[2].lower(), bool(m[1])) if m and m[2] else ("", False)
        if stack and stack[-1][0] == "head" and piece.strip():
            pop()  # text ends a head without a closing tag
        if not silent:
            held.append(piece)
        if not m:
            break
        at = m.end()
        if not name:
            continue
        if not closing and opened["head"] and (name == "body" or (stack[-1][0] == "head" and name not in _IN_HEAD)):
            while pop() != "head":  # so does the first element of the body
                pass
        if name not in _INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if name in _NESTING:
            if closing:
                if opened[name]:
                    while pop() != name:
                        pass
                    if name in _INLINE:
                        flush()
            elif not _self_closed(m[3]):
                if stack and stack[-1][0] == "p" and name not in _INLINE:
                    pop()  # a block ends a paragraph without a closing tag
                within = _inside(name, m[3], state)
                if name != "span" or within[:2] != state[:2]:
                    if name in _INLINE:
                        flush()
                    push(name)
                    state = within
                    if name in _RAW and (end := re.compile(rf"</{name}\s*>", re.I).search(html, at)):
                        at = end.start()
        elif name in _LEAVES:
            # Only leaves whose words make them boilerplate are on the stack; a link or label of such a word is muted in its line.
            inline = name in _INLINE
            top = stack[-1][0] if stack else ""
            if closing:
                if top == (f"{name}*" if inline else name):
                    pop()
            else:
                if not inline and (top == "p" or name in _ENDED_BY.get(top, ())):
                    pop()
                if m[3] and not _self_closed(m[3]):
                    within = _inside(name, m[3], state)
                    if inline and (within[2] and not state[2] or within[0] and not state[0]):
                        push(f"{name}*")
                    elif not inline and within[:2] != state[:2]:
                        push(name)
                        state = within
        bad, soft, _, main = state
        now = DROP if bad else _WEAK if soft else KEEP if main else OPEN
    flush()
    weak = DROP if any(s in (KEEP, OPEN) for _, s in out) else OPEN
    return [(text, weak if s == _WEAK else s) for text, s in out]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, for n places; kept between calls."""
    global _KEPT_POWERS
    if len(_KEPT_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        base = 0xD1B54A32D192ED03
        _KEPT_POWERS = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    return _KEPT_POWERS[0][:n], _KEPT_POWERS[1][:n]


_KEPT_POWERS = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _mixed(names: np.ndarray) -> np.ndarray:
    names = (names ^ (names >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return names ^ (names >> np.uint64(32))


def token_names(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit name of every token, the stream it is in); streams are not empty and hold single spaces between tokens."""
    data = np.frombuffer("\n".join(streams).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up)))
    names = _mixed((sums[ends] - sums[starts]) * down[np.minimum(starts, len(data) - 1)] + (ends - starts).astype(np.uint64))
    return names, np.concatenate(([0], np.cumsum(data[gaps] == 10)))


def window_names(names: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A name of the first `depth` tokens of each suffix that has as many, by prefix doubling."""
    span = 1
    while span < depth:
        step = min(span, depth - span)
        if len(names) <= step:
            return np.empty(0, np.uint64)
        left, right = names[: len(names) - step], names[step:]
        names = _mixed((left * np.uint64(0x9E3779B97F4A7C15)) ^ ((right << np.uint64(31)) | (right >> np.uint64(33))))
        span += step
    return names


def suffix_runs(pages: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first pages, last pages) of the runs of the suffix order by equal prefixes."""
    order = np.lexsort((pages, names))
    names, pages = names[order], pages[order]
    starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, int)
    ends = np.append(starts[1:], len(names)) - 1 if len(names) else starts
    return names[starts], pages[starts], pages[ends]


SPAN = DEPTH - GRAM + 1


def _whole(owner: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes have `depth` tokens within their stream."""
    return owner[depth - 1 :] == owner[: len(owner) - depth + 1] if len(owner) >= depth else np.empty(0, bool)


def _host_names(hosts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(h, 1) for h in hosts), np.uint64, len(hosts))


def anchor_names(pages: list[list[str]], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, name) of the anchors of some pages, in order of pages.

    An anchor is a GRAM-token name that is the least within some DEPTH-token prefix.
    """
    tokens, owner = token_names([" ".join(texts) for texts in pages])
    names = window_names(tokens, GRAM)
    at = np.empty(0, np.int64)
    if len(names) >= SPAN:
        view = np.lib.stride_tricks.sliding_window_view
        least = np.where(_whole(owner, DEPTH), view(names, SPAN).min(axis=1), np.uint64(0))
        pad = np.zeros(SPAN - 1, np.uint64)
        at = np.flatnonzero(view(np.concatenate((pad, least, pad)), SPAN).max(axis=1) == names)
    page = owner[at]
    place = at - np.searchsorted(owner, page)
    return page, place, (names[at] ^ _host_names(hosts)[page]).view(np.int64) if len(at) else at


def prefix_names(pages: list[list[str]], hosts: list[str], places: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, name) of the DEPTH-token prefixes with an anchor among the page's places."""
    tokens, owner = token_names([" ".join(texts) for texts in pages])
    names = window_names(tokens, GRAM)
    first = np.searchsorted(owner, np.arange(len(pages)))
    wanted = np.array([first[n] + p for n, ps in enumerate(places) for p in ps], np.int64)
    at = np.empty(0, np.int64)
    if len(names) >= SPAN:
        known = np.zeros(len(names), bool)
        known[wanted] = True
        view = np.lib.stride_tricks.sliding_window_view
        windows = view(names, SPAN)
        at = np.flatnonzero((view(known, SPAN) & (windows == windows.min(axis=1)[:, None])).any(axis=1) & _whole(owner, DEPTH))
    page = owner[at]
    named = (window_names(tokens, DEPTH)[at] ^ _host_names(hosts)[page]).view(np.int64) if len(at) else at
    return page, at - first[page] if len(at) else at, named


def sketches(pages: list[list[str]], hosts: list[str]) -> list[tuple[int, list[int]]]:
    """(hash of the host and all tokens, least hashes of the GRAM-token names) of each page; pages of fewer tokens differ if their texts do."""
    streams = [" ".join(texts) for texts in pages]
    content = np.fromiter((xxhash.xxh64_intdigest(f"{h}\n{s}") for h, s in zip(hosts, streams, strict=True)), np.uint64, len(pages))
    some = [n for n, s in enumerate(streams) if s]
    tokens, owner = token_names([streams[n] for n in some])
    names, whole = window_names(tokens, GRAM), _whole(owner, GRAM)
    names, page = names[whole], np.array(some, np.int64)[owner[: len(whole)][whole]]
    few = np.setdiff1d(np.arange(len(pages)), page)
    page = np.concatenate((page, few))
    order = np.argsort(page, kind="stable")
    names, page = np.concatenate((names, content[few]))[order], page[order]
    starts = np.searchsorted(page, np.arange(len(pages)))
    least = np.empty((SKETCH, len(pages)), np.int32)
    for i, (a, b) in enumerate(_TURNS[:, :, 0].T):
        mixed = (names ^ (names >> np.uint64(32))) * a
        least[i] = (np.minimum.reduceat((mixed ^ (mixed >> np.uint64(29))) * b, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return list(zip((content - np.uint64(1 << 63)).view(np.int64).tolist(), least.T.tolist(), strict=True))


def _parse(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        pages, hosts = [], []
        for _, _, url, html in batch:
            found = blocks(html)
            wanted = KEEP if any(state == KEEP for _, state in found) else OPEN
            host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
            hosts.append(host[1].lower() if host else "")
            pages.append([text for text, state in found if state == wanted])
        known = sketches(pages, hosts) if batch else []
        yield [(row, page_id, url, h, t, *k) for (row, page_id, url, _), h, t, k in zip(batch, hosts, pages, known, strict=True)]


def _record(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for _, x in columns], [name for name, _ in columns])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a batch's anchors."""
    for batch in batches:
        host, story, texts = (c.to_pylist() for c in batch.columns)
        page, _, names = anchor_names(texts, host)
        name, low, high = suffix_runs(np.array(story, np.int64)[page], names)
        yield _record(("name", name), ("low", low), ("high", high))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, host, texts = (c.to_pylist() for c in batch.columns)
        page, places, names = anchor_names(texts, host)
        yield _record(("row", np.array(row, np.int64)[page]), ("at", places), ("name", names))


def _prefixes(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        if not batch:
            continue
        row, host, story, texts, places = zip(*batch, strict=True)
        page, at, names = prefix_names(list(texts), list(host), list(places))
        edges = np.searchsorted(page, np.arange(1, len(row)))
        yield list(zip(row, host, story, (x.tolist() for x in np.split(at, edges)), (x.tolist() for x in np.split(names, edges)), strict=True))


def _assemble(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = []
        for page_id, url, texts, covered in batch:
            if covered:
                sizes = [text.count(" ") + 1 for text in texts]
                ends = np.cumsum(sizes)
                hit = np.zeros(int(ends[-1]), bool)
                for at in covered:
                    hit[at : at + DEPTH] = True
                texts = [text for text, end, size in zip(texts, ends, sizes, strict=True) if not hit[end - size : end].all()]
            text = "\n".join(texts)
            rows.append((page_id, url, text, len(text)))
        yield rows


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A join side of so many rows: broadcast up to BROADCAST_ROWS, joined by a shuffle beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _repeats(names: DataFrame, tag: str) -> DataFrame:
    """The names of runs that span distinct stories."""
    spans = names.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = materialize(spans.where("low <> high").select("name"), tag, "zstd")
    return _few(found, found.count())


def _common(prefixes: DataFrame, streams: DataFrame, tag: str) -> DataFrame:
    """The names of prefixes that stand in most stories of their host, and in FEWEST at least."""
    hosts = streams.select("host", "story").distinct().groupBy("host").agg(F.count("*").alias("stories"))
    seen = prefixes.select("name", "host", "story").distinct().groupBy("name", "host").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)
    found = materialize(seen.join(_few(hosts, hosts.count()), "host").where(2 * F.col("n") > F.col("stories")).select("name").distinct(), tag, "zstd")
    return _few(found, found.count())


def _per_row(places: DataFrame, names: DataFrame, tag: str) -> DataFrame:
    """(row, places): the places of each row whose name is among `names`."""
    found = places.join(names, "name", "left_semi").groupBy("row").agg(F.collect_list("at").alias("places"))
    found = materialize(found, tag, "zstd")
    return _few(found, found.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0])


def _meet(places: DataFrame, key: str) -> DataFrame:
    """(content, low, sketch) of rows that share the key with a smaller content, the least of which is low."""
    low = places.groupBy(key).agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select(key, "low")
    low = materialize(low, "html-meetings", "zstd")
    return places.join(_few(low, low.count()), key).where("content <> low").select("content", "low", "sketch").distinct()


def stories(streams: DataFrame) -> DataFrame:
    """(content, story) of contents that are one story with others: near copies within a host, and rows of one page_id."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 2), F.lit(2)), lambda i: F.xxhash64("host", i, F.get("sketch", i), F.get("sketch", i + 1)))
    near = materialize(_meet(streams.select("content", "sketch", F.explode(pairs).alias("pair")), "pair"), "html-near", "zstd")
    firsts = near.select(F.col("low").alias("content")).distinct()
    others = streams.join(_few(firsts, firsts.count()), "content", "left_semi").groupBy(F.col("content").alias("low")).agg(F.first("sketch").alias("other"))
    alike = F.aggregate(F.zip_with("sketch", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    same = _meet(streams.where("page_id is not null"), "page_id").select("content", "low")
    edges = near.join(others, "low").where(alike >= ALIKE).select("content", "low").unionByName(same)
    found = connected_components(edges.select(F.col("content").alias("a"), F.col("low").alias("b")))
    return found.select(F.col("node").alias("content"), F.col("component").alias("story"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    ship(spark)
    arrow_rows(spark, 256)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    schema = "row long, page_id long, url string, host string, texts array<string>, content long, sketch array<int>"
    parsed = materialize(map_rows(rows, schema, _parse), "html-blocks", "zstd")
    streams = parsed.where(F.size("texts") > 0)
    known = materialize(stories(streams), "html-stories", "zstd")
    streams = streams.join(_few(known, known.count()), "content", "left").withColumn("story", F.coalesce("story", "content"))
    runs = streams.select("host", "story", "texts").mapInArrow(_runs, "name long, low long, high long")
    places = streams.select("row", "host", "texts").mapInArrow(_places, "row long, at long, name long")
    anchored = _per_row(places, _repeats(runs, "html-anchors"), "html-anchored")
    prefixes = map_rows(streams.join(anchored, "row").select("row", "host", "story", "texts", "places"), "row long, host string, story long, at array<long>, names array<long>", _prefixes)
    prefixes = materialize(prefixes, "html-prefixes", "zstd")
    found = prefixes.select("row", "host", "story", F.explode(F.arrays_zip("at", "names")).alias("x")).select("row", "host", "story", "x.at", F.col("x.names").alias("name"))
    repeated = _common(found, streams, "html-repeats")
    covered = _per_row(found.select("row", "at", "name"), repeated, "html-covered")
    out = parsed.join(covered, "row", "left").select("page_id", "url", "texts", "places")
    return map_rows(out, "page_id long, url string, text string, n_chars long", _assemble)
