"""The main text of web pages: by markup where it tells, else by a host suffix array.

Where a page marks its article (``article`` or ``main``), the markup decides.  Pages without
such a mark are told from their neighbours: the blocks of all pages of a host, marked ones
among them, are laid end to end as one stream of tokens, whose suffix array shows every long run of
tokens that distinct pages share.  Covered tokens are boilerplate; what stays are the unique runs.  Of a host too
large for one task the windows of ``LEAST_SHARED`` tokens are compared in Spark instead, which
finds the same runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import batched, per_run, stored

#: Tokens that a run shared by distinct pages of a host must have.
LEAST_SHARED = 8
#: Bytes of blocks of one host that are searched in one task; those of larger hosts are dealt
#: out by window.
BYTES_TOGETHER = 4_000_000
HOST = r"^(?:[a-zA-Z][^:/]*:)?//([^/?#]*)"

# Fixed values of the markup language: what never holds an article's text, ...
NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav aside "
    "footer form button select textarea dialog menu".split()
)
# ... what is raw up to its end tag, and never text of the page, ...
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
# ... and what begins a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
# Boilerplate that an article inside does not end, as long as it is closed.
CLOSED = frozenset("aside nav footer form".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Only of these do classes, ids and roles tell boilerplate; headings, articles and what stands
# in a line of text have ids and classes of their subject.
CONTAINERS = frozenset("center details div dl figure header li ol p section table td ul".split())
#: Classes, roles and ids that mark boilerplate, as whole names.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments complementary consent contentinfo cookie cookies disqus footer masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related share sharing sidebar social sponsor sponsored subscribe".split()
)
# In these, compound names like ``ad-slot`` tell too, by their first or last part; ...
COMPOUNDED = frozenset("div header li ol section ul".split())
# ... parts that also stand in the names of whole layouts, by the last part only; ...
OF_LAYOUTS = frozenset("banner footer menu nav navbar navigation sidebar".split())
# ... and never in names of what there is or is not: ``no-sidebar``.
STATES = frozenset("has have hide is no not show with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(
    r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE
)


def _names(attributes: str, ids: bool) -> set[str]:
    return {
        name
        for kind, *value in _NAMED.findall(attributes)
        if ids or kind.lower() != "id"
        for name in "".join(value).lower().split()
    }


def _is_comment(attributes: str) -> bool:
    """Whether an article is a reader's comment, by part of a class or role: ``comment-body``."""
    parts = {part for name in _names(attributes, ids=False) for part in re.split("[-_]", name)}
    return not parts.isdisjoint(("comment", "comments"))


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    """By a class or role of a container; by its id, or of a paragraph, outside articles.

    Inside, an id is a place to link to, named for what is written there.
    """
    if name not in CONTAINERS or (name == "p" and in_article):
        return False
    names = _names(attributes, ids=not in_article)
    if not BOILERPLATE.isdisjoint(names):
        return True
    return name in COMPOUNDED and any(map(_compound_tells, names))


def _compound_tells(name: str) -> bool:
    first, *others = [part for part in re.split("[-_]+", name) if part] or [""]
    if not others or first in STATES:
        return False
    return others[-1] in BOILERPLATE or (first in BOILERPLATE and first not in OF_LAYOUTS)


def blocks(html: str) -> tuple[list[str], list[str]]:
    """Blocks inside ``article`` elements, or ``main`` if it holds more, and all others.

    In page order.
    Both without what markup shows to be boilerplate.  Character references are decoded once,
    white space in a block becomes one blank.  A line break is white space; unclosed and
    stray tags do not matter, and an article that begins inside boilerplate ends it, unless it is
    a reader's comment or a teaser in a sidebar, menu, footer or form that is closed.
    """
    found: list[tuple[str, str]] = []  # container and text
    text: list[str] = []
    inside = {"article": 0, "main": 0}
    skipped, depth, at = "", 0, 0

    def close() -> None:
        if text:
            if whole := " ".join(unescape("".join(text)).split()):
                where = "article" if inside["article"] else "main" if inside["main"] else ""
                found.append((where, whole))
            text.clear()

    search = _TOKEN.search
    while True:
        match = search(html, at)
        if not skipped and (before := html[at : match.start() if match else len(html)]):
            text.append(before)
        if match is None:
            break
        at = match.end()
        name = match[2] or match[5]
        if name is None:  # comment, doctype
            continue
        name, ends = name.lower(), bool(match[1] or match[4])
        attributes = (match[3] if match[2] else match[6]) or ""
        if not ends and name in RAW:  # not text of the page, whatever it looks like
            stop = re.compile(rf"</{name}[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if skipped:
            opens_article = not ends and name in inside and not _is_comment(attributes)
            if opens_article and skipped in CLOSED:
                # A teaser in a sidebar, unless that is never closed.
                opens_article = re.compile(rf"</{skipped}\b", re.IGNORECASE).search(html, at) is None
            if opens_article or (name == "body" and skipped == "head"):
                skipped = ""
            else:
                if name == skipped:
                    depth += -1 if ends else not attributes.endswith("/")
                    if depth <= 0:
                        skipped = ""
                continue
        if name == "br":
            text.append(" ")
        elif name in BLOCKS or name in NEVER:
            close()
        if name in VOID:
            continue
        if not ends and (
            name in NEVER
            or (name == "header" and not inside["article"])
            or (attributes and _is_boilerplate(name, attributes, any(inside.values())))
        ):
            if not attributes.endswith("/"):
                skipped, depth = name, 1
        elif name in inside:
            inside[name] = max(0, inside[name] + (-1 if ends else 1))
    close()
    # Articles that say less than the rest of main are teasers in it.
    size = {c: sum(len(t) for where, t in found if where == c) for c in inside}
    for container in sorted(inside, key=size.get, reverse=True):
        if any(where == container for where, _ in found):
            return (
                [t for where, t in found if where == container],
                [t for where, t in found if where != container],
            )
    return [], [t for _, t in found]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array order of a stream by the first ``depth`` tokens, as ranks.

    Prefix doubling: equal ranks, equal beginnings.  Past the end stands what equals nothing.
    """
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        step = min(length, depth - length)
        following = np.full(len(rank), -1, np.int64)
        if step < len(rank):
            following[:-step] = rank[step:]
        pairs = rank * (len(rank) + 1) + following + 1
        rank, length = np.unique(pairs, return_inverse=True)[1].astype(np.int64), length + step
    return rank


def covered(streams: list[list[str]], least: int = LEAST_SHARED) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of ``least`` or more that another page has."""
    names: dict[str, int] = {}
    numbers, page_of, first = [], [], []
    for page, tokens in enumerate(streams):
        first.append(len(numbers))
        numbers += [names.setdefault(token, len(names)) for token in tokens]
        page_of += [page] * len(tokens)
        numbers.append(-1 - page)  # ends differ, so no run crosses them
        page_of.append(page)
    rank = suffix_ranks(np.array(numbers, np.int64), least)
    page = np.array(page_of)
    lowest = np.full(rank.max() + 1, len(streams))
    highest = np.full(rank.max() + 1, -1)
    np.minimum.at(lowest, rank, page)
    np.maximum.at(highest, rank, page)
    shared = np.flatnonzero((lowest < highest)[rank])
    change = np.zeros(len(rank) + least + 1, np.int64)
    np.add.at(change, shared, 1)
    np.add.at(change, shared + least, -1)
    inside = np.cumsum(change)[: len(rank)] > 0
    return [inside[begin : begin + len(tokens)] for begin, tokens in zip(first, streams)]


def _stream(page: Sequence[str]) -> list[str]:
    """The tokens of a page (as blocks), each block with a line break at its end."""
    return [word for block in page for word in (*block.split(" "), "\n")]


def _kept(stream: list[str], is_shared: np.ndarray) -> str:
    kept, block = [], []
    for word, shared in zip(stream, is_shared.tolist()):
        if word == "\n":
            if block:
                kept.append(" ".join(block))
            block = []
        elif not shared:
            block.append(word)
    return "\n\n".join(kept)


def windows(stream: list[str], least: int = LEAST_SHARED) -> np.ndarray:
    """A hash of 64 bits of every ``least`` tokens in a row, by where they begin."""
    number = len(stream) - least + 1
    if number <= 0:
        return np.zeros(0, np.int64)
    tokens = pd.util.hash_array(np.array(stream, dtype=object))
    found = np.zeros(number, np.uint64)
    for k in range(least):
        found = (found ^ tokens[k : k + number]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found.view(np.int64)


def unique_text(pages: list[list[str]]) -> list[str]:
    """The pages of one host (as blocks) without the runs that distinct pages share.

    Pages of equal blocks are one page here, not each other's boilerplate.
    """
    texts: dict[tuple[str, ...], str] = dict.fromkeys(map(tuple, pages), "")
    streams = [_stream(page) for page in texts]
    for page, stream, is_shared in zip(list(texts), streams, covered(streams)):
        texts[page] = _kept(stream, is_shared)
    return [texts[tuple(page)] for page in pages]


_TEXT = "page_id {id}, url string, text string"


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pages in which an article is found."""
    for frame in frames:
        texts = ["\n\n".join(blocks(html)[0]) for html in frame["html"]]
        yield frame[["page_id", "url"]].assign(text=texts)[list(map(bool, texts))]


def _parsed(marked: bool):
    """The blocks of the pages in which no article is found, or of those in which one is."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [blocks(html) for html in frame["html"]]
            yield frame[["page_id", "url", "host"]].assign(
                blocks=["\n".join(article + others) for article, others in found], marked=marked
            )[[bool(article) == marked for article, _ in found]]

    return task


def _unmarked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def host(run: dict) -> list[tuple]:
        texts = unique_text([page.split("\n") if page else [] for page in run["blocks"]])
        found = zip(run["page_id"], run["url"], texts, run["marked"])
        return [(page, url, text) for page, url, text, marked in found if not marked]

    for frame in batched(per_run(frames, ["group"], host), ["page_id", "url", "text"], 500):
        yield frame


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for host, page, text in zip(frame["host_id"], frame["page"], frame["blocks"]):
            found = np.unique(windows(_stream(text.split("\n") if text else [])))
            yield pd.DataFrame({"host_id": host, "page": page, "window": found})


def _without(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for text, shared in zip(frame["blocks"], frame["shared"]):
            stream = _stream(text.split("\n") if text else [])
            is_shared = np.zeros(len(stream), bool)
            if shared is not None:
                begins = np.flatnonzero(np.isin(windows(stream), shared))
                for k in range(LEAST_SHARED):
                    is_shared[begins + k] = True
            texts.append(_kept(stream, is_shared))
        yield frame[["page_id", "url"]].assign(text=texts)


def _by_windows(pages: DataFrame, schema: str) -> DataFrame:
    """What ``unique_text`` makes of whole hosts, for hosts of any size.

    A row of three numbers for each window of a page.  Which windows distinct pages of a host
    have is added up before it is shuffled; reporting them back is a join between two shuffles,
    of which adaptive execution cuts up what a window on most pages makes hot.
    """
    pages = pages.select(
        "page_id",
        "url",
        "blocks",
        "marked",
        F.xxhash64("host").alias("host_id"),
        F.xxhash64("host", "blocks").alias("page"),
    )
    found = stored(
        pages.select("host_id", "page", "blocks").mapInPandas(
            _windows, "host_id long, page long, window long"
        ),
        "page_windows",
    )
    on_several = stored(
        found.groupBy("host_id", "window")
        .agg(F.min("page").alias("lowest"), F.max("page").alias("highest"))
        .where("lowest < highest")
        .select("host_id", "window"),
        "shared_windows",
    )
    shared = (
        found.join(on_several, ["host_id", "window"], "left_semi")
        .groupBy("page")
        .agg(F.collect_set("window").alias("shared"))
    )
    return (
        pages.where("NOT marked")
        .join(shared, "page", "left")
        .select("page_id", "url", "blocks", "shared")
        .mapInPandas(_without, schema)
    )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html, or one without text, gives an empty text.  Rows that repeat are
    each extracted.  A null url is a host of its own.  An empty table gives an empty
    result; other columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(
        "page_id", F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")
    )
    # Only parsing tells whether a page marks an article, so each is parsed for either way.
    marked = rows.mapInPandas(_marked, _TEXT.format(id=kind))
    others = rows.withColumn(
        "host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    )
    kinds = f"page_id {kind}, url string, host string, blocks string, marked boolean"
    unmarked = stored(others.mapInPandas(_parsed(False), kinds), "page_blocks")
    # Their hosts' other pages show what is shared, too.
    asking = unmarked.select("host").distinct()
    beside = others.join(asking, "host", "left_semi").select(others.columns)
    parsed = unmarked.unionByName(
        stored(beside.mapInPandas(_parsed(True), kinds), "marked_blocks")
    )
    large = (
        parsed.groupBy("host")
        .agg(F.sum(F.octet_length("blocks") + 1).alias("bytes"))
        .where(F.col("bytes") > BYTES_TOGETHER)
        .select("host")
    )
    told = (
        parsed.join(large, "host", "left_anti")
        .select("page_id", "url", "blocks", "marked", F.xxhash64("host").alias("group"))
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInPandas(_unmarked, _TEXT.format(id=kind))
    )
    dealt = _by_windows(parsed.join(large, "host", "left_semi"), _TEXT.format(id=kind))
    return (
        marked.unionByName(told)
        .unionByName(dealt)
        .withColumn("n_chars", F.length("text").cast("long"))
    )
