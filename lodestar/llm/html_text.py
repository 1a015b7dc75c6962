"""Main text of web pages, with a suffix array for each host.

A page is read tag by tag into blocks, each with a mark: what stands in an article or main element, what stands in an
element that is named like one, what stands elsewhere, links alone, and what belongs to menus, headers, footers, sidebars,
notices, adverts, forms or reader comments by its element, class, id or role.  Scripts and styles are no text.

The token streams of a host's pages, menus and footers included, are concatenated, with no run over a page's end, and
their suffixes are ordered by prefix doubling up to ``Rules.run`` tokens.  Neighbours in that order with equal prefixes
are long substrings that pages repeat, and every token learns how many distinct pages of the host share a run that covers
it.  That judges every block that a text may have; the marks say how much of the host has to share a run for it to be
boilerplate (``Rules.need``): little in what stands anywhere, most of the host inside an article.  A block that is
covered throughout goes, inside other blocks stretches as long as a run, and unique runs stay.  Only where nothing
repeats do the marks alone decide: menus and the like always go, and of what is left the best mark that the page has is
its text.

A host's pages needn't be in one place, however many they are.  Each task makes suffix arrays of its pages of a host and
names the runs that have the needed share of these (``frequent``); a run that has it of the host has it in one of the
parts.  Then all pages are searched for what was named, and the host's distinct pages with each run are counted
(``held_by``).  So counts are exact, and neither they nor the texts depend on how pages are dealt to tasks.

Near-equal pages count as one, so that copies don't make each other boilerplate: those that keys of minima of their runs
beyond the host's template link, directly or by others (``near_equal``).  A page of which nothing would be left keeps its
text.

Defined results: a null or empty page has an empty text; a page without a host, or without url, belongs to the host "";
unfinished tags at the end are markup; rows that repeat a page have its text each; an empty table gives an empty
result; extra columns of the input are not read, and columns may have any names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._shared import coded_words, cut, fresh_path, named, small_batches
from .near_copies import _ODD, SEED, _mixed, minima

ARTICLE, NAMED, OPEN, LINKS, DROP = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Rules:
    #: Tokens that a repeated substring has at least, a block's end being a token too.
    run: int = 8
    #: By mark, of those that a text may have: the distinct pages that share a run, and their share of the host's, from
    #: which it is boilerplate.
    need: tuple[tuple[int, float], ...] = ((8, 0.5), (5, 0.2), (3, 0.05))
    #: Signs of pages whose suffix arrays are made at a time, about; no result depends on it.
    chars: int = 1 << 22


# Names of elements, and words of class, id and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math".split())
DROPPED = frozenset("nav header footer aside form button select option optgroup datalist dialog menu fieldset legend label object canvas audio video map applet head output progress meter".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody tfoot thead tr ul".split()
)
#: A start tag that ends an open element of the same set, unless one of the others lies between.
CLOSES = {"p": ({"p"}, {"table", "td", "th"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "head", "li", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "option"}
BAD = frozenset(
    "nav navbar navigation menu menubar submenu footer sidebar aside rail ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored "
    "promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin "
    "form search searchbox comment comments commentlist disqus discussion respond reply replies share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager toolbar masthead copyright legal widget widgets skip paywall complementary contentinfo dialog".split()
)
GOOD = frozenset("article content main post entry story".split())
HEADS = frozenset("header head heading topbar top".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</(?:[^a-zA-Z][^>]*>|\Z)",
    re.S,
)
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _rank(name: str, attributes: str, outer: int) -> int:
    """Rank of an element within one of rank outer."""
    if outer == DROP or name in DROPPED:
        return DROP
    words: set[str] = set()
    if attributes:
        if _HIDDEN.search(attributes):
            return DROP
        for _, *values in _NAME.findall(attributes):
            words.update(_WORDS.findall(_CAMEL.sub(" ", "".join(values)).lower()))
    good = bool(words & GOOD)
    if words & BAD or (words & HEADS and not good and name not in ("h1", "h2", "h3", "h4", "h5", "h6") and outer > NAMED):
        return DROP
    if name in ("article", "main") or "main" in words and "role" in attributes.lower():
        return ARTICLE
    return min(outer, NAMED) if good and name in ("div", "section", "td") else outer


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(mark, text) of a page's blocks in order, white space inside a block being one space; none is empty."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    parts: list[str] = []
    #: Open elements that matter, the rank of their text and that of the block around it: an advert inside a line is
    #: left out without ending the block.
    stack: list[tuple[str, int, int]] = []
    rank, block, links, linked, unlinked = OPEN, OPEN, 0, False, False

    def flush() -> None:
        nonlocal parts, linked, unlinked
        text = " ".join("".join(parts).split())
        if text:
            out.append((LINKS if block == OPEN and linked and not unlinked else block, text))
        parts, linked, unlinked = [], False, False

    def close(names: set[str], walls: set[str]) -> None:
        nonlocal rank, block
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                outer = stack[i - 1] if i else ("", OPEN, OPEN)
                if stack[i][0] in BLOCKS or outer[2] != block:
                    flush()
                del stack[i:]
                rank, block = outer[1:]
                return
            if stack[i][0] in walls:
                return

    def add(text: str) -> None:
        nonlocal linked, unlinked
        if text and (rank != DROP or block == DROP):  # an advert inside a line is no part of its block
            parts.append(html.unescape(text))
            if not text.isspace():
                linked, unlinked = linked or links > 0, unlinked or links == 0

    at, size, lower = 0, len(page), None
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        if not found[0].endswith(">"):  # the page ends within a tag
            break
        name, attributes = name.lower(), found[3] or found[6] or ""
        if found[1] or found[4]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or any(name == n for n, _, _ in stack):
                if name in BLOCKS:
                    flush()
                close({name}, set() if name in ("body", "html", "article", "main", "div", "section", "table") else {"article", "main", "table"} - {name})
            elif name in ("td", "th"):
                add(" ")
            continue
        if name in RAW:
            lower = lower if lower is not None else page.lower()
            if not attributes.endswith("/") or name not in ("svg", "math"):
                end = lower.find("</" + name, at)
                end = size if end < 0 else end
                at = page.find(">", end) + 1 or size
            add(" ")
            continue
        if name in ("br", "td", "th"):
            add(" ")
        if name == "a":
            links += 1
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        if name in ENDS_P:
            close({"p"}, {"table", "td", "th"})
        if name in BLOCKS:
            flush()
        inner = _rank(name, attributes, rank)
        if name not in VOID and (name in BLOCKS or name in ("td", "th") or inner != rank):
            if inner != rank and inner != DROP and name not in BLOCKS:
                flush()
            rank, block = inner, block if inner == DROP and name not in BLOCKS else inner
            stack.append((name, rank, block))
    flush()
    return out


def suffix_groups(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first tokens, at least depth of them, equal prefixes having equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < depth:
        step = min(length, depth - length)
        later = np.zeros(len(rank), np.int64)
        later[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return rank


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run that begins at each token, as far as one fits."""
    out = np.zeros(max(0, len(tokens) - run + 1), np.uint64)
    for j in range(run):
        out = out * _ODD + tokens[j : j + len(out)]
    return _mixed(out).view(np.int64)


def repeated(pages: list[np.ndarray], owner: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, distinct owners) of the runs of pages of one host, ascending, by the suffix array of their tokens."""
    whole = np.concatenate(pages)
    fits = np.array([max(0, len(p) - run + 1) for p in pages])
    first = np.cumsum([0, *[len(p) for p in pages[:-1]]])
    starts = np.arange(fits.sum()) + np.repeat(first - np.cumsum(fits) + fits, fits)  # no run goes over a page's end
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, own = suffix_groups(whole.view(np.int64), run)[starts], np.repeat(owner, fits)
    order = np.lexsort((own, rank))  # the suffix array, as deep as runs are long
    ranked, own = rank[order], own[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    counts = np.add.reduceat(new | np.append(True, own[1:] != own[:-1]), np.flatnonzero(new), dtype=np.int64)
    hashes = run_hashes(whole, run)[starts[order[new]]]
    by_hash = np.argsort(hashes)
    return hashes[by_hash], counts[by_hash]


def looked_up(runs: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each run among ascending known ones, 0 if it isn't known."""
    if not len(known):
        return np.zeros(len(runs), np.int64)
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return np.where(known[at] == runs, counts[at], 0)


def covering(found: np.ndarray, size: int, run: int) -> np.ndarray:
    """For each of so many tokens the largest count of a run that covers it."""
    most = np.zeros(size, np.int64)
    for k in range(run if len(found) else 0):
        np.maximum(most[k : k + len(found)], found, out=most[k : k + len(found)])
    return most


#: Pages are near-equal if they agree in all of ROWS minima of a band of BANDS, taken over their own runs, which are those
#: beyond the host's template.  At a similarity of 0.9 of these sets that holds for 99 %, at 0.8 for half, at 0.6 for 0.7 %.
ROWS, BANDS = 16, 24
#: The share of a host's distinct pages, if they are more than two, that hold each run of its template.
TEMPLATE = 0.9


def band_keys(own: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of sets of runs, a row each; those of empty ones are alike."""
    keys = np.zeros((len(own), BANDS), np.uint64)
    some = [i for i, s in enumerate(own) if len(s)]
    if some:
        found = minima([own[i].view(np.uint64) for i in some], 0, ROWS * BANDS).reshape(BANDS, ROWS, -1)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
        for k in range(ROWS):
            key = _mixed(key * _ODD + found[:, k])
        keys[some] = key.T
    return keys


def shared_by(streams: list[list[int]], run: int = Rules.run) -> tuple[list[np.ndarray], int]:
    """(for each token of each page the largest number of distinct pages that share a run which covers it, the number of
    distinct pages) of a host that is in one place.  Near-equal pages are one; a token that no run covers has 0."""
    if not streams:
        return [], 0
    pages = [_mixed(np.array(s, np.int64).view(np.uint64) + np.uint64(1)) for s in streams]
    root = np.arange(len(pages))
    held, counts = repeated(pages, root, run)
    template = held[counts >= TEMPLATE * len(pages)] if len(pages) > 2 else held[:0]
    runs = [run_hashes(p, run) for p in pages]
    holder: dict[int, int] = {}
    for i, keys in enumerate(band_keys([np.setdiff1d(r, template) for r in runs]).tolist()):
        for key in keys:
            a, b = root[i], root[holder.setdefault(key, i)]
            root[root == max(a, b)] = min(a, b)
    held, counts = repeated(pages, root, run)
    return [covering(looked_up(r, held, counts), len(p), run) for r, p in zip(runs, pages)], len(set(root.tolist()))


def long_stretches(mask: np.ndarray, least: int) -> np.ndarray:
    """The stretches of a mask that are at least so long."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    out = np.zeros(len(mask), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= least
    return out


def chosen(blocks: list[tuple[int, str]], shared: np.ndarray, n: int, rules: Rules) -> tuple[str, int, int]:
    """(text, tokens left out as repeated, tokens left out by marks alone) of a page, from the number of its host's n
    distinct pages that share each token."""
    best = min((r for r, _ in blocks), default=DROP)
    kept, removed, marked, at = [], 0, 0, 0
    for rank, text in blocks:
        size = text.count(" ") + 1
        own = shared[at : at + size]
        at += size + 1
        if rank >= LINKS:
            marked += size
            continue
        least, share = rules.need[rank]
        mask = own >= max(least, share * n)
        if mask.any() and not mask.all():
            mask = long_stretches(mask, rules.run)
        removed += int(mask.sum())
        if rank != best:
            marked += int((~mask).sum())
        elif mask.any():
            words = [w for w, gone in zip(text.split(" "), mask) if not gone]
            kept += [" ".join(words)] * bool(words)
        else:
            kept.append(text)
    if not kept and best < LINKS:  # what is all that a page says isn't boilerplate
        kept = [text for rank, text in blocks if rank == best]
        removed -= sum(t.count(" ") + 1 for t in kept)
    return "\n".join(kept), removed, marked


def main_texts(pages: list[str | None], rules: Rules = Rules()) -> list[tuple[str, int, int]]:
    """What ``chosen`` gives for the pages of a host that is in one place."""
    parsed = [blocks_of(p) for p in pages]
    known: dict[str, int] = {"\n": 0}
    distinct: dict[tuple[int, ...], int] = {}
    places = []
    for blocks in parsed:
        stream: list[int] = []
        for _, text in blocks:
            stream += [known.setdefault(w, len(known)) for w in text.split(" ")]
            stream.append(0)
        places.append(distinct.setdefault(tuple(stream), len(distinct)))
    found, n = shared_by([list(s) for s in distinct], rules.run)
    return [chosen(blocks, found[place], n, rules) for blocks, place in zip(parsed, places)]


#: The token at a block's end; it counts as white space, so it is no part of a word.
END = " \u2029 "


def tokens_of(texts: pa.Array) -> list[np.ndarray]:
    """The tokens' hashes of pages given as their blocks, a line each."""
    ended = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", END), END, "")
    offsets, codes, words = coded_words(pc.if_else(pc.equal(texts, ""), "", ended))
    of_word = np.array([xxhash.xxh64_intdigest(w or "", SEED) for w in words.to_pylist()], np.uint64)
    line = of_word[codes] if len(codes) else np.zeros(0, np.uint64)
    return [line[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def lists_of(column: pa.Array, hosts: np.ndarray) -> dict[int, np.ndarray]:
    """By host the list that a column has for it."""
    found, first = np.unique(hosts, return_index=True)
    none = np.zeros(0, np.int64)
    return {h: column[i].values.to_numpy() if column[i].is_valid else none for h, i in zip(found.tolist(), first.tolist())}


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, host, node, marks, blocks) of every row: a hash of the host, one of the host and all tokens, and the
    blocks with a mark each."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(named(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), F.xxhash64(host).alias("host"), named(html_col).cast("string").alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"]]).add("host", "long").add("node", "long").add("marks", "binary").add("blocks", "string")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(p) for p in batch.column(3).to_pylist()]
            texts = ["\n".join(t for _, t in blocks) for blocks in found]
            nodes = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), h & (1 << 64) - 1) for t, h in zip(texts, batch.column(2).to_pylist())]
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([bytes(r for r, _ in blocks) for blocks in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, pa.array(texts, pa.string())], schema.names)

    path = fresh_path(spark, "blocks")
    rows.mapInArrow(parsed, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Runs that a task keeps at most until it names them as candidates.
KEPT = 1 << 21


def frequent(pages: DataFrame, rules: Rules) -> DataFrame:
    """(host, runs): of every host at least the runs that bar distinct pages hold, and that is no less than this share of
    its n distinct pages.  Pages are (host, blocks, class, weight, n, bar, share), weights of a class adding up to 1.

    What has a share of a host's pages has it in one of their parts, so each part names the runs that have it there.  A
    part is what a task reads, in pieces of about ``Rules.chars`` signs; a run that has fallen below the share is
    forgotten, and if it comes again it is taken to have had the share before.  A part also says how often a run that it
    doesn't name may be there at most; a run stays if that, over the other parts, and what is known of it reach the bar.
    """

    names = ["host", "run", "most"]

    def named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}  # by host: runs, owners counted, owners that may have been forgotten, weight of the pages
        piece: list[tuple] = []

        def counted() -> None:
            by_host: dict[int, list] = {}
            for host, *row in piece:
                by_host.setdefault(host, []).append(row)
            piece.clear()
            for host, rows in by_host.items():
                tokens, classes, weights, _, _, shares = zip(*rows)
                share = shares[0]
                shown: dict[int, int] = {}
                owner = np.array([i if c is None else shown.setdefault(c, i) for i, c in enumerate(classes)])
                new, count = repeated(list(tokens), owner, rules.run)
                runs, counts, missed, weight = kept.get(host, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0])[:4]
                every, place = np.unique(np.concatenate([runs, new]), return_inverse=True)
                before = np.full(len(every), share * weight)
                before[place[: len(runs)]] = missed
                counts = np.bincount(place, np.concatenate([counts, count]), len(every))
                weight += sum(weights)
                stay = counts + before >= share * weight - 1e-6
                kept[host] = [every[stay], counts[stay], before[stay], weight, share]

        def candidates() -> Iterator[pa.RecordBatch]:
            for host, (runs, counts, missed, weight, share) in kept.items():
                unnamed = max(0, math.ceil(share * weight - 1e-6) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([None], pa.int64()), pa.array([float(unnamed)])], names)
                for a in range(0, len(runs), 1 << 16):
                    at = slice(a, a + (1 << 16))
                    more = counts[at] + missed[at] - unnamed
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(more), host)), pa.array(runs[at]), pa.array(more)], names)
            kept.clear()

        size = 0
        for batch in batches:
            for host, tokens, *row in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1)), *[c.to_pylist() for c in batch.columns[2:]]):
                piece.append((host, tokens, *row))
            size += batch.column(1).nbytes
            if size >= rules.chars:
                counted()
                size = 0
                if sum(len(k[0]) for k in kept.values()) > KEPT:
                    yield from candidates()
        counted()
        yield from candidates()

    rows = pages.where("bar <= n").select("host", "blocks", "class", "weight", F.col("n").cast("double").alias("n"), "bar", "share")
    most = cut(rows.mapInArrow(named_runs, "host long, run long, most double").groupBy("host", "run").agg(F.sum("most").alias("most")), "most")
    bars = most.where("run is null").select("host", F.col("most").alias("unnamed")).join(pages.groupBy("host").agg(F.first("bar").alias("bar")), "host")
    found = most.where("run is not null").join(cut(bars, "bars"), "host").where("most + unnamed >= bar - 1e-6")
    found = found.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    return cut(found, "candidates")


def held_by(pages: DataFrame, candidates: DataFrame, rules: Rules) -> DataFrame:
    """(host, run, held): the number of distinct pages that hold each candidate.  Pages are (host, blocks, class)."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: dict[int, list[np.ndarray]] = {}
        several: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for key, found in [*single.items(), *several.items()]:
                runs, n = np.unique(np.concatenate(found), return_counts=True)
                host, one = key if isinstance(key, tuple) else (key, None)
                made = [pa.array([host] * len(runs), pa.int64()), pa.array(runs), pa.array([one] * len(runs), pa.int64()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(made, ["host", "run", "class", "n"])
            single.clear()
            several.clear()

        for batch in batches:
            hosts = batch.column(0).to_numpy()
            known = lists_of(batch.column(3), hosts)
            for host, tokens, one in zip(hosts.tolist(), tokens_of(batch.column(1)), batch.column(2).to_pylist()):
                runs = run_hashes(tokens, rules.run)
                runs = np.unique(runs[looked_up(runs, known[host], np.ones(len(known[host]), np.int64)) > 0])
                if len(runs):
                    size += len(runs)
                    single.setdefault(host, []).append(runs) if one is None else several.setdefault((host, one), []).append(runs)
            if size > KEPT:
                yield from rows()
                size = 0
        yield from rows()

    rows = pages.join(candidates, "host").select("host", "blocks", "class", "runs").mapInArrow(held, "host long, run long, class long, n long")
    each = rows.groupBy("host", "run", "class").agg(F.sum("n").alias("n"))
    return each.groupBy("host", "run").agg(F.sum(F.when(F.col("class").isNull(), F.col("n")).otherwise(1)).alias("held"))


def near_equal(pages: DataFrame, templates: DataFrame, rules: Rules) -> DataFrame | None:
    """(node, root) of the pages that are near-equal to others.  Pages are (host, node, blocks), templates (host, runs)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0).to_numpy()
            known = lists_of(batch.column(3), hosts)
            own = [np.setdiff1d(run_hashes(t, rules.run), known[h]) for t, h in zip(tokens_of(batch.column(2)), hosts.tolist())]
            keys = _mixed(band_keys(own) ^ hosts.view(np.uint64)[:, None]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    rows = pages.join(templates, "host", "left").select("host", "node", "blocks", "runs")
    entries = cut(rows.mapInArrow(keyed, "node long, keys array<long>"), "keys").select(F.explode("keys").alias("key"), "node")
    first = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    edges = cut(entries.join(cut(first.select("key", "first"), "first"), "key").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a < b").distinct(), "edges")
    return None if edges.isEmpty() else simhash.components(edges)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """(id_col, url_col, text, n_chars, n_repeated, n_marked) of every row; the last two count the tokens that were left
    out because other pages of the host repeat them, and by marks alone."""
    rows = parsed_pages(pages, id_col, url_col, html_col)
    nodes = cut(rows.groupBy("host", "node").agg(F.count("*").alias("rows")), "nodes")

    def searched(marked: DataFrame, share: float) -> DataFrame:
        """The pages in which runs are named.  All but 1 - share of a host's pages hold a run of its template, so all but as
        many of any of them do: a fifth of the pages by hash, where these are enough, name all of these runs."""
        if share < TEMPLATE:
            return marked.withColumn("share", F.lit(share))
        few = F.pmod("class", F.lit(5)) == 0
        marked = marked.withColumn("class", F.coalesce("class", "node"))
        sizes = cut(marked.groupBy("host").agg(F.countDistinct(F.when(few, F.col("class"))).alias("some"), F.first("n").alias("all")), "sizes")
        enough = F.col("some") >= 1.6 * (1 - share) * F.col("all")
        sizes = sizes.where(enough).select("host", "some")
        marked = marked.join(sizes, "host", "left").where(F.col("some").isNull() | few)
        lacking = F.col("n") - F.col("bar")
        share_of = F.when(F.col("some").isNull(), F.lit(share)).otherwise(1 - lacking / F.col("some"))
        bar = F.when(F.col("some").isNull(), F.col("bar")).otherwise(F.col("some") - lacking)
        return marked.select("host", "blocks", "class", "weight", F.coalesce("some", "n").alias("n"), bar.alias("bar"), share_of.alias("share"))

    def counts(classes: DataFrame, bar: Callable[[Column], Column], share: float) -> DataFrame:
        """(host, n, run, held) of the runs that bar(n) of a host's n distinct pages hold, pages of a class being one;
        classes are (host, node, class, rows)."""
        hosts = cut(classes.groupBy("host").agg(F.countDistinct("class").alias("n")), "hosts")
        size = classes.groupBy("class").agg(F.sum("rows").alias("size")).where("size > 1")
        several = cut(classes.join(size, "class").select("node", "class", (1 / F.col("size")).alias("weight")), "several")
        marked = rows.select("host", "node", "blocks").join(several, "node", "left").join(hosts.withColumn("bar", bar(F.col("n"))), "host")
        marked = marked.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        found = held_by(marked, frequent(searched(marked, share), rules), rules).join(hosts, "host").where(F.col("held") >= bar(F.col("n")))
        told = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("run", "held"))).alias("found"))
        return cut(hosts.join(told, "host", "left").select("host", "n", F.col("found.run").alias("runs"), F.col("found.held").alias("held")), "counts")

    # Equal pages are one; the runs of nearly all pages are the host's template.
    template = counts(nodes.withColumn("class", F.col("node")), lambda n: F.when(n > 2, TEMPLATE * n).otherwise(n + 1.0), TEMPLATE)
    roots = near_equal(rows, template.select("host", "runs"), rules)
    classes = nodes.withColumn("class", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = lambda n: F.least(*[F.greatest(F.lit(float(most)), F.lit(share) * n) for most, share in rules.need])
    known = counts(classes.select("host", "node", "class", "rows"), least, min(share for _, share in rules.need))
    schema = T.StructType([rows.schema["id"], rows.schema["url"]])
    schema = schema.add("text", "string").add("n_chars", "long").add("n_repeated", "long").add("n_marked", "long")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(2).to_numpy()
            runs, held = (lists_of(batch.column(k), hosts) for k in (6, 7))
            found = []
            for host, tokens, marks, text, n in zip(hosts.tolist(), tokens_of(batch.column(4)), *[batch.column(k).to_pylist() for k in (3, 4, 5)]):
                shared = covering(looked_up(run_hashes(tokens, rules.run), runs[host], held[host]), len(tokens), rules.run)
                found.append(chosen(list(zip(marks, text.split("\n"))), shared, n, rules))
            made = [pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64())]
            made += [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema.names)

    out = rows.join(known, "host").select("id", "url", "host", "marks", "blocks", "n", "runs", "held").mapInArrow(extracted, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), *schema.names[2:])
