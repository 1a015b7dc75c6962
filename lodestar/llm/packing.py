"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised, closed by a separator and, where longer than a sequence, cut into pieces.  Only the histogram of
piece lengths (one count for each length up to the sequence's) comes to the driver.  There the configuration linear
program -- a configuration is a multiset of lengths that fits a sequence, every length needs its count -- is solved by
multiplicative weights: a length's price falls exponentially with the share of its count that is covered, a knapsack
dynamic program finds the dearest configurations at these prices, and amounts of them add up to a fractional solution.
That is rounded to whole numbers; what the rounding leaves over is solved and rounded again, and best fit on the
histogram packs the last few hundredths only.

The packing is a table of runs: the pieces of one length, from a rank on, go to consecutive sequences at one offset.  Its
size depends on the number of lengths alone, so it is broadcast.  Pieces are ranked within their length by hash bucket,
one for each ``RANKED`` pieces, so that a length that a third of all pieces share is never ordered in one task.

Defined results: a null text is an empty one, and that is a piece of one separator; repeated rows are packed each for
itself; an empty table gives an empty result; of the input only the id and the text are read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Merges
from ._shared import coded_words, cut, small_batches

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length that are ordered together, about.
RANKED = 1 << 14

# The steps of a tokenizer file whose ids can be made chunk by chunk.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PATTERN = {"Regex": _CONTRACTIONS + "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": _PATTERN, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Chunks of these characters are their own composed form and are lower-cased sign by sign; none has a contraction or
#: the beginning of a special token in it.
PLAIN = "^[!-&(-~À-ÖØ-öø-ÿ]+$"
#: 0 for letters, 1 for digits, 2 for other signs, of bytes of PLAIN chunks.
KINDS = np.array([1 if 48 <= b <= 57 else 0 if 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], np.uint8)


class Tokens:
    """Token ids of texts, as the tokenizer file gives them.

    A tokenizer that drops white space and never joins over it gives a text the ids of its chunks, one after another, so
    the ids of a batch are made once for each distinct chunk.  Where the file has the steps below, chunks of plain signs
    and Latin letters are split and merged with numpy, all at once; every other chunk, and every other tokenizer, takes
    the library's way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        steps = [made.get("normalizer"), made.get("pre_tokenizer"), made.get("post_processor"), model["type"]]
        options = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")]
        plain = not any(t["content"].split() != [t["content"]] or "<|" not in t["content"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        same = json.dumps(steps, sort_keys=True) == json.dumps([NORMALIZER, PRE_TOKENIZER, None, "BPE"], sort_keys=True)
        self.by_chunk = same and plain and not any(options) and len(model["vocab"]) < 1 << 16
        if self.by_chunk:
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each)."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))
        plain = plain.to_numpy(zero_copy_only=False)
        few = pa.array(plain)
        lower = pc.utf8_lower(chunks.filter(few))
        ends = lower.cast(pa.binary())
        bounds = np.frombuffer(ends.buffers()[1], np.int32)[ends.offset : ends.offset + len(ends) + 1].astype(np.int64)
        data = np.frombuffer(ends.buffers()[2] or b"", np.uint8)[bounds[0] if len(bounds) else 0 : bounds[-1] if len(bounds) else 0]
        bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
        # A word begins where a chunk does, where the kind of sign changes, and at every digit.
        kind = KINDS[data]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        new[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(new)
        ids, n = self.merges.apply(data, starts)
        words = np.searchsorted(starts, bounds)
        upto = np.concatenate(([0], np.cumsum(n)))
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain] = np.diff(upto[words])
        others = np.flatnonzero(~plain)
        if not len(others):
            return ids, sizes
        made = {int(i): self._library(chunks[int(i)].as_py()) for i in others}
        sizes[others] = [len(x) for x in made.values()]
        out = np.empty(int(sizes.sum()), np.int32)
        out[np.repeat(plain, sizes)] = ids
        out[np.repeat(~plain, sizes)] = np.concatenate(list(made.values()))
        return out, sizes

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, ids of all of them, each text's closed by the separator)."""
        if not self.by_chunk:
            made = [np.append(self._library(t or ""), SEPARATOR) for t in texts.to_pylist()]
            return np.cumsum([0, *map(len, made)]), np.concatenate([np.zeros(0, "<u4"), *made]).astype("<u4")
        offsets, codes, chunks = coded_words(texts)
        ids, sizes = self._chunks(chunks)
        ids, sizes = np.append(ids, SEPARATOR).astype("<u4"), np.append(sizes, 1)
        places = np.cumsum(sizes) - sizes
        # The last code stands for the separator and comes after the words of each text.
        codes = np.insert(codes.astype(np.int64), offsets[1:], len(sizes) - 1)
        n = sizes[codes]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(n) else 0) + np.repeat(places[codes] - upto + n, n)
        return np.concatenate(([0], upto))[offsets + np.arange(len(offsets))], ids[at]


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of every piece, with the ids themselves too if keep_ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("_text"))
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = Tokens(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            bounds, flat = tokens.of(batch.column(1))
            for doc, begin, end in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                for k, a in enumerate(range(0, end - begin, capacity)):
                    part = flat[begin + a : min(end, begin + a + capacity)]
                    out.append((doc, k, a, len(part), zlib.crc32(part.tobytes()), *[part] * keep_ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    kinds = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return rows.mapInArrow(cut_up, kinds)


@dataclass
class Packing:
    """Configurations (lengths, times used) in order, a lower bound of the number of sequences, and how many of these are
    full pieces alone and how many come from the program; best fit made the others."""

    configurations: list[tuple[tuple[int, ...], int]]
    bound: float
    full: int = 0
    programmed: int = 0

    @property
    def sequences(self) -> int:
        return sum(k for _, k in self.configurations)

    def runs(self) -> np.ndarray:
        """Columns (length, first rank, first sequence, offset), ordered by length and rank."""
        used: Counter = Counter()
        out, sequence = [], 0
        for lengths, k in self.configurations:
            offset = 0
            for length in lengths:
                out.append((length, used[length], sequence, offset))
                used[length] += k
                offset += length
            sequence += k
        table = np.array(sorted(out), np.int64).reshape(-1, 4)
        return table


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: bins with the same content are one group with a count."""
    room: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                group = room[r].pop()
                if not room[r]:
                    del room[r]
                k = min(left, group[1])
                if k < group[1]:
                    room.setdefault(r, []).append([group[0], group[1] - k])
                room.setdefault(r - length, []).append([(*group[0], length), k])
                left -= k
            else:
                each = capacity // length
                if left >= each:
                    room.setdefault(capacity - each * length, []).append([(length,) * each, left // each])
                if left % each:
                    room.setdefault(capacity - left % each * length, []).append([(length,) * (left % each), 1])
                left = 0
    return [(tuple(lengths), k) for groups in room.values() for lengths, k in groups]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest content of every capacity from 0 on.  Lengths ascend; any may be taken any number of times."""
    value = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        found = (value[c - lengths[: upto[c]]] + prices[: upto[c]]).max()
        value[c] = max(found, value[c - 1])
    return value


@dataclass(frozen=True)
class Solver:
    #: The share of all tokens that a fractional solution may leave open, and the rounds it gets at most.
    gap: float = 0.01
    rounds: int = 200
    #: How much a length's price follows the share of its count that is open.
    rate: float = 0.3
    #: The first tolerance (the share by which a configuration may be cheaper than the dearest), what it grows by when a
    #: round hardly gets on, and the last one.
    tolerance: float = 0.005
    growth: float = 1.2
    most: float = 0.02
    #: Times that what a rounding leaves is solved again, and the share of tokens that is small enough for best fit.
    passes: int = 16
    rest: float = 0.04


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, solver: Solver = Solver(), step: float = 0.5) -> tuple[Counter, float]:
    """(amounts of configurations by the places of their lengths, lower bound): a solution of the configuration program.

    Each round prices the lengths, those with a larger open share dearer by an exponential weight, and takes the dearest
    contents of all capacities by the knapsack program.  From the longest open length on, every length is completed to
    the dearest configuration whose lengths no other one of the round has; those within the tolerance are used for
    ``step`` of what their scarcest length has open.  It ends where no configuration within the last tolerance gets on;
    what is open then is for the next pass.
    """
    open_, whole = demand.astype(float), float((lengths * demand).sum())
    used, bound, tolerance = Counter(), whole / capacity, solver.tolerance
    for _ in range(solver.rounds):
        at = np.flatnonzero(open_)
        if not len(at) or tolerance > solver.most or float((lengths * open_).sum()) <= solver.gap * whole:
            break
        own, share = lengths[at], open_[at] / demand[at]
        prices = own * np.exp(solver.rate * (share - share.max()))
        value = knapsack(own, prices, capacity)
        if len(at) == len(lengths):  # prices of all lengths, divided by the dearest content, are a dual solution
            bound = max(bound, float((prices * demand).sum()) / value[capacity])
        fresh, free, moved = np.ones(len(at), bool), prices.copy(), 0.0
        for first in range(len(at) - 1, -1, -1):
            if not fresh[first]:
                continue
            content, room, worth = [first], capacity - int(own[first]), prices[first]
            free[first], fresh[first] = -np.inf, False
            while room >= own[0]:
                n = int(np.searchsorted(own, room, side="right"))
                found = free[:n] + value[room - own[:n]]
                k = int(found.argmax())
                if found[k] == -np.inf:
                    break
                content.append(k)
                room, worth, free[k] = room - int(own[k]), worth + prices[k], -np.inf
            if worth < value[capacity] * (1 - tolerance):
                free[content[1:]] = prices[content[1:]]
                continue
            fresh[content] = False
            places = at[content]
            least = float(open_[places].min())
            amount = least * step if least * step > 0.05 * float(demand[places].min()) else least
            used[tuple(places.tolist())] += amount
            open_[places] -= amount
            moved += amount
        open_[open_ < 1e-9] = 0
        if moved < 0.03 * float((lengths * open_).sum()) / capacity:
            tolerance *= solver.growth
    return used, bound


def solve(counts: dict[int, int], capacity: int = CAPACITY, solver: Solver = Solver()) -> Packing:
    """Packing of a histogram: the configuration program is solved over the whole of it and rounded at random, to whole
    numbers that no length's count forbids; what that leaves over is a smaller program of the same kind, solved again,
    and best fit packs the last few hundredths."""
    counts = {int(a): int(n) for a, n in counts.items() if n > 0}
    alone = [((capacity,), counts[capacity])] if capacity in counts else []
    lengths = np.array(sorted(a for a in counts if a < capacity), np.int64)
    left = np.array([counts[int(a)] for a in lengths], np.int64)
    whole, bound = int((lengths * left).sum()), 0.0
    solved: Counter = Counter()
    for turn in range(solver.passes):
        keep = np.flatnonzero(left)
        if not len(keep) or (turn and int((lengths * left).sum()) < solver.rest * whole):
            break
        amounts, least = fractional(lengths[keep], left[keep], capacity, solver, 0.5 if turn == 0 else 1.0)
        bound = bound if turn else least
        ordered = sorted(amounts.items(), key=lambda x: (-x[1], x[0]))
        up, took = np.random.default_rng(turn).random(len(ordered)), 0
        for (places, amount), u in zip(ordered, up.tolist()):
            at = keep[list(places)]
            k = min(int(amount + u), int(left[at].min()))
            if k > 0:
                left[at] -= k
                solved[tuple(sorted(lengths[at].tolist(), reverse=True))] += k
                took += k
        if not took:
            break
    made = sorted(solved.items(), reverse=True)
    rest = best_fit({int(a): int(n) for a, n in zip(lengths, left) if n}, capacity)
    n = sum(k for _, k in alone)
    return Packing(alone + made + rest, n + bound, n, sum(k for _, k in made))


def assign(parts: DataFrame, packing: Packing, id_col: str = "doc_id") -> DataFrame:
    """parts with sequence_id and offset.  parts has a length for each row and was counted for the packing."""
    runs, counts = packing.runs(), Counter()
    for lengths, k in packing.configurations:
        for length in lengths:
            counts[length] += k
    buckets = F.lit([1 + counts[length] // RANKED for length in range(1 + max(counts, default=0))])
    shared = parts.sparkSession.sparkContext.broadcast(runs)
    rows = parts.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.element_at(buckets, (F.col("length") + 1).cast("int"))))
    per = rows.groupBy(F.col("length").alias("_l"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_l", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(per, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_l", "_b", "_before", "_bucket")
    at, rank = ranked.columns.index("length"), ranked.columns.index("_rank")
    names = [*(c for c in ranked.columns if c != "_rank"), "sequence_id", "offset"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            ranks = batch.column(rank).to_numpy(zero_copy_only=False)
            found = np.searchsorted(keys, (batch.column(at).to_numpy(zero_copy_only=False) << 48) | ranks, "right") - 1
            run = table[found]
            columns = [c for i, c in enumerate(batch.columns) if i != rank]
            columns += [pa.array(run[:, 2] + ranks - run[:, 1]), pa.array(run[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [f for f in ranked.schema if f.name != "_rank"]
    schema = type(ranked.schema)(kinds).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(placed, schema)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of every row with their places: (id_col, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    parts = cut(pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids), "pieces")
    counts = parts.groupBy("length").count().toArrow()  # a row for each length up to the capacity
    packing = solve(dict(zip(counts["length"].to_pylist(), counts["count"].to_pylist())), capacity)
    return assign(parts, packing, id_col)
