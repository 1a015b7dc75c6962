"""Quality rules by repetition coverage.

Each text is one row of numpy work: words become ids, n-grams of several lengths become rolling hashes over those ids,
and the characters inside n-grams and lines that the text repeats are measured as shares of its word characters.

Defined results: a null text is an empty one; a text without words fails the base rules and has coverage 0; repeated
rows are each judged for themselves; an empty table gives an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import named, small_batches

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8
#: An odd multiplier for the rolling hash, and those of the mixer that spreads word ids over 64 bits.
ROLL = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the repetition coverage; a text above a limit is rejected."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: Words of an n-gram, and the largest share of word characters inside duplicated n-grams of that length.
    ngrams: tuple[tuple[int, float], ...] = ((3, 0.60), (5, 0.40), (8, 0.30), (12, 0.25))
    #: The largest share of word characters inside lines that the text has before.
    max_line_share: float = 0.30
    #: The largest share of symbols among word characters.
    max_symbol_share: float = 0.05


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(ROLL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of n values: a polynomial in an odd number, modulo 2**64."""
    out = np.zeros(len(values) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(ROLL)
        out += values[i : len(values) - n + 1 + i]
    return out


def duplicated(values: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n that the text has twice or more, the first one included."""
    if len(values) < n:
        return np.zeros(len(values), bool)
    hashes = window_hashes(values, n)
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    twice = np.unique(twice)
    again = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
    edge = np.zeros(len(values) + 1, np.int64)
    edge[: len(hashes)] += again
    edge[n : n + len(hashes)] -= again
    return np.cumsum(edge[:-1]) > 0


def word_sizes(words: list[bytes], plain: bool) -> np.ndarray:
    """Code points of every word; plain if all are ASCII."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if plain or not words:
        return sizes
    line = np.frombuffer(b" ".join(words), np.uint8)
    more = np.cumsum(np.append(0, (line & 0xC0) == 0x80))  # bytes that continue a code point
    ends = np.cumsum(sizes + 1) - 1
    return sizes - (more[ends] - more[ends - sizes])


def measure(text: str | None, rules: Rules = Rules()) -> dict:
    """Counts, coverage and verdicts of one whole text."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS))}
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(line.translate(None, SPACE).decode("utf-8"))
        elif not line.isspace() and line:
            seen.add(line)
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, i) for i, w in enumerate(words)), np.int64, n)
    values = _mixed(ids)
    sizes = word_sizes(words, len(data) == len(text))
    again = {k: duplicated(values, k) for k in {BASE_WINDOW, *(k for k, _ in rules.ngrams)}}
    out |= {"n_dup_lines": n_dup_lines, "n_repeat_words": int(again[BASE_WINDOW].sum())}
    whole = max(1, int(sizes.sum()))
    shares = [float(sizes[again[k]].sum()) / whole for k, _ in rules.ngrams]
    out |= {"dup_ngram_shares": shares, "dup_line_share": dup_line_chars / max(1, word_chars)}
    failed = n < rules.min_words or 100 * out["n_repeat_words"] > rules.max_repeat_percent * n
    clean = (
        all(share <= most for share, (_, most) in zip(shares, rules.ngrams))
        and out["dup_line_share"] <= rules.max_line_share
        and out["n_symbols"] <= rules.max_symbol_share * word_chars
    )
    return out | {"base_failed": failed, "kept": not failed and clean}


MEASURED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("dup_ngram_shares", T.ArrayType(T.DoubleType())),
        T.StructField("dup_line_share", T.DoubleType()),
    ]
)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id_col and the measures and verdicts of every row."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.float64()), pa.float64()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t, rules) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[c] for x in found], kind) for c, kind in zip(MEASURED.names, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], *MEASURED.names])

    rows = docs.select(named(id_col), named(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(measured, T.StructType([rows.schema[id_col], *MEASURED.fields]))


def keep_clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, in one pass."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(t, rules)["kept"] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
