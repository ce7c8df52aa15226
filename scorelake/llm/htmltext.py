"""HTML main-text extraction with boilerplate found by suffix arrays over each host's pages.

Pages become blocks of text in page order, each with the region that it stands
in: the article or main element, a region that the markup names as another (menus,
headers, footers, sidebars, notices, adverts, forms, comments), or none. Scripts,
styles and the like are no text. All blocks outside the main region go to the
host's suffix array: the token streams of its pages are concatenated and sorted as
suffixes, and runs of tokens that recur on a distinct page of the host are
boilerplate. Where a page has a main region, that region's blocks are the text, and
the array says how much of the rest is boilerplate; on other pages the unique
runs of blocks in no named region are the text. The array never judges inside a main
region, since articles may share passages. A host with too many pages for one task
gets the same result by a join: hashes of its windows of the shortest run that stand
on two of its pages are found over all its pages, and what these windows cover goes.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batch_of, store
from .urlrules import host_of

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_OUT = frozenset("nav header footer aside form script style noscript template head iframe noembed noframes xmp svg math object canvas select button textarea title dialog menu audio video".split())
#: Elements whose content is never shown as text.
_HIDDEN = frozenset("script style noscript template head iframe noembed noframes xmp svg math object canvas select button textarea title menu audio video dialog".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "legend"}
#: Words of class and id names, and ARIA roles, that mark other regions.
_OUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsor sponsored promo promotion popup modal breadcrumb breadcrumbs share social related comment comments reply replies disqus newsletter subscribe signup login widget pagination pager skip".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


def _is_out(tag: str, attributes: str) -> bool:
    if tag in _OUT:
        return True
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "").lower()
        if name in ("class", "id") and tag not in ("body", "html", "main", "article") and not _OUT_WORDS.isdisjoint(_WORD.findall(value)):
            return True
        if name == "role" and value in _OUT_ROLES or name in ("hidden", "aria-hidden") and value in ("", "true", "hidden"):
            return True
    return False


def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or "role" in attributes and re.search(r"\brole\s*=\s*[\"']?(main|article)\b", attributes) is not None


#: Where a block stands: in the main region, in no named region, in another named region.
MAIN, OPEN, OTHER = 0, 1, 2


def blocks(page: str | None) -> tuple[bool, list[tuple[int, str]]]:
    """Whether a page has a main region, and its blocks: (MAIN, OPEN or OTHER, text).

    Tags that are not closed end with their parents; a ``<`` that begins no tag is
    text; character references are decoded as in HTML, once.
    """
    text = page or ""
    out: list[tuple[int, str]] = []
    has_main = False
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, hidden, other, main
    parts: list[str] = []
    aside: list[str] = []  # text of another region within the block that is open
    hidden = off = main = 0

    def add(text: str) -> None:
        if not hidden:
            (aside if off else parts).append(text)

    def flush(other: bool = False) -> None:
        held = aside if other else parts
        whole = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if whole:
            out.append((OTHER if other else MAIN if main else OPEN, whole))

    def pop() -> None:
        nonlocal hidden, off, main
        tag, was_hidden, was_other, was_main = stack.pop()
        if tag in _BLOCK and not off:
            flush()
        if tag in _BLOCK or off == was_other:
            flush(True)
        hidden -= was_hidden
        off -= was_other
        main -= was_main

    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add(entities.unescape(text[at:lt]))
        if lt == n:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), lt):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(text, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in _BLOCK:
                flush(off > 0)
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag == "li" or tag in ("dd", "dt", "option", "tr", "td", "th"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if stack and stack[-1][0] in same:
                pop()
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            flush(off > 0)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        is_out, is_hidden = _is_out(tag, m[3]), tag in _HIDDEN
        if is_out and not off and tag in _BLOCK:
            flush()
        is_main = not is_out and not off and _is_main(tag, m[3])
        has_main |= is_main
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(text, at)
            if not is_hidden:
                add(entities.unescape(text[at : end.start() if end else n]))
            close = text.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        stack.append((tag, is_hidden, is_out, is_main))
        hidden += is_hidden
        off += is_out
        main += is_main
    while stack:
        pop()
    flush()
    flush(True)
    return has_main, out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The suffixes of a token stream in order, by doubling of ranks."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        rank = new
        if rank[order[-1]] == n - 1:
            break
        step *= 2
        if step >= n:
            break
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Tokens that each suffix shares with the one before it in order (Kasai's walk)."""
    n = len(tokens)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    values, where, sorted_at = tokens.tolist(), place.tolist(), order.tolist()
    h = 0
    for i in range(n):
        k = where[i]
        if not k:
            h = 0
            continue
        j = sorted_at[k - 1]
        while i + h < n and j + h < n and values[i + h] == values[j + h]:
            h += 1
        out[k] = h
        h = max(0, h - 1)
    return out


def repeated_tokens(streams: list[np.ndarray], pages: list[int], least: int) -> list[np.ndarray]:
    """For each block's stream, the tokens in runs of ``least`` or more that occur on another page too."""
    lengths = [len(s) for s in streams]
    ends = np.cumsum([n + 1 for n in lengths])
    whole = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    page = np.empty(len(whole), np.int64)
    for i, (s, end) in enumerate(zip(streams, ends.tolist(), strict=True)):
        whole[end - len(s) - 1 : end - 1] = s
        whole[end - 1] = -1 - i  # a token of its own: no run passes a block's end
        page[end - len(s) - 1 : end] = pages[i]
    covered = np.zeros(len(whole) + 1, np.int64)
    if len(whole):
        order = suffix_array(whole)
        shared = common_prefixes(whole, order)
        # the longest run shared with a suffix of another page: walk groups of suffixes that share ``least`` tokens
        owner = page[order]
        heads = np.flatnonzero(shared < least)
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist(), strict=True):
            if hi - lo > 1 and (owner[lo:hi] != owner[lo]).any():
                covered[order[lo:hi]] += 1
                np.add.at(covered, np.minimum(order[lo:hi] + least, len(whole)), -1)
    marks = np.cumsum(covered[:-1]) > 0
    return [marks[end - n - 1 : end - 1] for n, end in zip(lengths, ends.tolist(), strict=True)]


#: Hosts at most that are compared by a join, as their names are broadcast.
_BROADCAST_HOSTS = 100_000
_KEPT = "row bigint, block int, text string, gone bigint"


def _unique_runs(group: pd.DataFrame, least: int) -> pd.DataFrame:
    """The needed blocks of a host without the token runs that other pages have too, and how many tokens each block lost."""
    rows = group.sort_values(["row", "block"], kind="stable")
    words = [t.split(" ") for t in rows["text"]]
    codes, _ = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    cuts = np.cumsum([0, *map(len, words)])
    streams = [codes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    gone = np.concatenate(repeated_tokens(streams, pd.factorize(rows["row"])[0].tolist(), least)) if streams else np.zeros(0, bool)
    needed = rows["needed"].tolist()
    texts = [" ".join(w for w, g in zip(ws, gone[cuts[i] : cuts[i + 1]], strict=True) if not g) if needed[i] else "" for i, ws in enumerate(words)]
    lost = [int(gone[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame({"row": rows["row"].to_numpy(), "block": rows["block"].to_numpy(), "text": texts, "gone": lost})


def _kept_of_large(pages: DataFrame, least: int) -> DataFrame:
    """``pages(host, row, rest)`` to (row, block, text, gone) as from ``_unique_runs``, with no task that needs a whole host.

    A run of ``least`` tokens or more recurs just where each of its windows of
    ``least`` tokens does. Windows are known by 128 bits within their host.
    """
    words = pages.select("host", "row", F.posexplode("rest").alias("block", "text")).select("host", "row", "block", F.split("text", " ").alias("w")).where(F.size("w") >= least)
    windows = words.select("host", "row", "block", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - least + 1), lambda i: F.array_join(F.slice("w", i, F.lit(least)), " "))).alias("at", "window"))
    hashed = windows.select("host", "row", (F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("at")).alias("place"), F.xxhash64("window").alias("h"), F.xxhash64(F.lit(1), "window").alias("g"))
    seeds = hashed.groupBy("host", "h", "g").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("host", "h", "g")
    places = hashed.join(seeds.hint("merge"), ["host", "h", "g"], "left_semi").groupBy("row").agg(F.collect_list("place").alias("places"))  # a merge join: Spark splits a window that stands on every page
    schema = pa.schema([("row", pa.int64()), ("block", pa.int32()), ("text", pa.string()), ("gone", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str, int]] = []
            for row, rest, needed, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                starts: dict[int, list[int]] = {}
                for place in found or ():
                    starts.setdefault(place >> 32, []).append(place & 0xFFFFFFFF)
                for block, text in enumerate(rest):
                    lost = 0
                    if block in starts:
                        ws = text.split(" ")
                        gone = bytearray(len(ws))
                        for at in starts[block]:
                            gone[at : at + least] = b"\x01" * least
                        lost = sum(gone)
                        text = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
                    out.append((row, block, text if needed else "", lost))
            yield batch_of(schema, *([x[i] for x in out] for i in range(4)))

    return pages.select("row", "rest", "needed").join(places, "row", "left").mapInArrow(cut, _KEPT)


def main_text(pages: DataFrame, least_tokens: int = 6, share_pages: int = 2000) -> DataFrame:
    """``pages(page_id, url, html)`` to (page_id, url, text, n_chars, n_boilerplate), one row a row.

    n_boilerplate counts the words outside the main region that stand in runs which
    another page of the host has too. Null and empty pages have an empty text.
    Rows with equal or null page_ids are separate pages, so two copies of
    a page make each other's menus boilerplate. Other columns are ignored.
    ``least_tokens`` is the shortest run that counts. A host with more than
    ``share_pages`` pages (more where over ``_BROADCAST_HOSTS`` hosts could have so many)
    is compared by a join and no suffix array, with the same result.
    """
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"), F.monotonically_increasing_id().alias("row"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("packed", pa.binary()), ("rest", pa.list_(pa.string())), ("open", pa.list_(pa.int32())), ("row", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes | None] = []
            rest: list[list[str]] = []
            free: list[list[int]] = []
            for value in batch.column(2):
                has_main, found = blocks(value.as_py())
                outer = [(k, t) for k, t in found if k != MAIN]
                free.append([] if has_main else [i for i, (k, _) in enumerate(outer) if k == OPEN])
                packed.append(None if free[-1] else zlib.compress(" ".join(t for k, t in found if k == MAIN).encode("utf-8", "replace")))
                rest.append([t for _, t in outer])
            yield batch_of(schema, batch.column(0), batch.column(1), packed, rest, free, batch.column(3))

    # texts travel compressed from here to the end; rows get their number once, in the stored table
    parsed = store(own.mapInArrow(parse, "page_id bigint, url string, packed binary, rest array<string>, open array<int>, row bigint"), "pages", compression="zstd")
    outside = parsed.where(F.size("rest") > 0).select("row", "rest", (F.size("open") > 0).alias("needed"), host_of(F.col("url")).alias("host"))
    most = max(share_pages, parsed.count() // _BROADCAST_HOSTS)
    large = outside.groupBy("host").count().where(F.col("count") > most).select("host", F.lit(True).alias("large"))  # _BROADCAST_HOSTS rows at most
    dealt = outside.join(F.broadcast(large), "host", "left")
    small = dealt.where("large is null").select("host", "row", "needed", F.posexplode("rest").alias("block", "text"))
    kept = small.groupBy("host").applyInPandas(lambda g: _unique_runs(g, least_tokens), _KEPT)
    kept = kept.union(_kept_of_large(dealt.where("large"), least_tokens))
    runs = kept.groupBy("row").agg(F.sum("gone").alias("gone"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("block", "text")))).alias("b"))
    whole = parsed.drop("rest").join(runs, "row", "left")
    unique = F.array_join(F.transform(F.filter("b", lambda x: F.array_contains("open", x["block"])), lambda x: x["text"]), " ")
    joined = whole.select("page_id", "url", F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_boilerplate"), "packed", unique.alias("found"))
    final = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("n_boilerplate", pa.int64()), ("text", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [zlib.decompress(p.as_buffer()).decode() if p.is_valid else f.as_py() or "" for p, f in zip(batch.column(3), batch.column(4), strict=True)]
            yield batch_of(final, *(batch.column(i) for i in range(3)), texts)

    out = joined.mapInArrow(unpack, "page_id bigint, url string, n_boilerplate bigint, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_boilerplate")
