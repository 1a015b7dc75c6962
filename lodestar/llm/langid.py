"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text is made a suffix automaton, which accepts exactly the sample's
substrings.  Cross parsing cuts a document, from left to right, into the longest matches with the sample; the number of
phrases times the bits that name a place in the sample, per letter, estimates the cross entropy, and the language that
needs the fewest bits wins.

All documents of a batch are parsed in lock step with numpy: each text is cut into segments of SEGMENT letters, every
segment starts at the automaton's root, and one gather moves all segments of the batch by one letter.  Where no
transition exists the phrase ends, and the table already holds where the next one stands after the same letter.  Then the
seams are mended: a segment is parsed again from the state in which the one before it truly ends, until it is in the
state that it had at that letter before, from where on nothing differs; so the phrases are those of the whole text.

Only the fit is bounded (``Settings``), by a number of whole labelled rows; every row's whole text is parsed.  Defined
results: null texts and those without a letter are ``und`` with score 0; so is everything when nothing is labelled;
repeated rows are each predicted alike, and as one row learned from; an empty table gives an empty result; labels are
read for learning only; columns may have any names.  Every language keeps its own most frequent letters whatever other
scripts there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import crc_of_id, cut, id_crc, named, small_batches

UNKNOWN = "und"
#: Letters that are parsed in one go; a phrase also ends at the end of a segment, in every language alike.
SEGMENT = 256
#: Segments that move together, so that a batch of very long texts needs no more memory than others.
TOGETHER = 1 << 14
#: Parts of a language's labelled rows that are ordered each for itself.
PARTS = 64


@dataclass(frozen=True)
class Settings:
    #: Labelled rows of a language that are drawn, at most, and of all languages together.
    rows: int = 64
    all_rows: int = 16_384
    #: Rows of no more characters than this are drawn from; where a language has none, its shortest.  Of the rows drawn, whole
    #: ones are learned from while the letters of a language are no more than this; one that doesn't fit is left out.
    letters: int = 40_000
    #: Letters of all languages together.  An automaton has two states a letter at most, and a state ``own + shared + 3``
    #: entries of 4 bytes in a worker's tables: 325 MB at these bounds, however many languages there are.
    all_letters: int = 320_000
    #: Letters with a class of their own in a language's table, its most frequent ones; all others of its sample share
    #: ``shared`` classes by their code point there.
    own: int = 60
    shared: int = 64


def build_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, state 0 being the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves


@dataclass
class Model:
    """Per language the automaton as triples (state, class, next), and the class that each letter of all has there.

    A letter's number is 0 for what is no letter, 1 for letters that no sample has, then its place among ``letters``, and the
    last stands for padding; each language's classes are its own, in the same order: those of its letters, those that rare
    ones share, and padding.
    """

    languages: list[str]
    letters: list[str]
    alphabets: list[np.ndarray]
    triples: list[np.ndarray]
    states: list[int]
    bits: list[float]
    tables: list[np.ndarray] = field(default_factory=list, repr=False)
    numbers: np.ndarray | None = field(default=None, repr=False)

    @property
    def padding(self) -> int:
        return len(self.letters) + 2

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": [], "numbers": None}

    def unfold(self) -> None:
        """Dense tables: the next state times width, and the top bit where a phrase ended before this letter."""
        if self.numbers is not None:
            return
        self.numbers = letter_numbers(self.letters)
        for alphabet, triples, n in zip(self.alphabets, self.triples, self.states):
            k = int(alphabet[-1]) + 1
            dense = np.full((n + 1, k), -1, np.int64)
            dense[triples[:, 0], triples[:, 1]] = triples[:, 2]
            # A letter that the sample lacks is a phrase of its own: it leads to one more state that every letter ends.
            begin = np.where(dense[0] >= 0, dense[0], n) * k
            full = np.where(dense >= 0, dense * k, begin | (1 << 31)).astype(np.uint32)
            full[0] = begin
            full[:, k - 1] = np.arange(n + 1, dtype=np.uint32) * k
            self.tables.append(full.ravel())


def letter_numbers(letters: list[str]) -> np.ndarray:
    """Number of every code point: 0 unless a letter, 1 for a letter that isn't among these."""
    out = np.zeros(0x110000, np.uint16 if len(letters) < 65_000 else np.uint32)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    out[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    return out


def alphabet_of(letters: list[str], seen: Counter, settings: Settings) -> np.ndarray:
    """Class of every letter's number in the table of a language in whose sample these letters are seen so often."""
    own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: settings.own]]
    shared = settings.shared if len(seen) > len(own) else 0
    classes = {c: len(own) + 2 + ord(c) % settings.shared for c in seen} | {c: i + 2 for i, c in enumerate(own)}
    said = [classes.get(c, 1) for c in letters]
    return np.array([0, 1, *said, len(own) + shared + 2], np.int64)


def encode(text: str | None, numbers: np.ndarray) -> np.ndarray:
    """Numbers of a lower-cased text's letters, what is no letter being one separator each time."""
    if not text:
        return np.zeros(0, numbers.dtype)
    found = numbers[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep]


def _parsed(full: np.ndarray, steps: np.ndarray, first: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """(phrases that end in each segment, the state after the last segment) of segments in columns.

    first tells the segments that begin a text; another one goes on from the state in which the one before it ends, and
    the first column from entry unless it begins a text.
    """
    low, n = np.uint32((1 << 31) - 1), steps.shape[1]
    states, ended = np.empty(steps.shape, np.uint32), np.empty(steps.shape, np.uint16)
    state, count = np.zeros(n, np.uint32), np.zeros(n, np.uint16)
    for t, column in enumerate(steps):
        found = full[state + column]
        count += (found >> np.uint32(31)).astype(np.uint16)
        state = found & low
        states[t], ended[t] = state, count
    begun = np.zeros(n, np.uint32)  # the states that segments were last parsed from
    while True:
        before = np.append(np.uint32(entry), states[-1, :-1])
        before[first] = 0
        at = np.flatnonzero(before != begun)
        if not len(at):
            return ended[-1].astype(np.int64), int(states[-1, -1])
        begun[at] = before[at]
        state, count = before[at], np.zeros(len(at), np.uint16)
        for t in range(len(steps)):
            found = full[state + steps[t, at]]
            count = count + (found >> np.uint32(31)).astype(np.uint16)
            state = found & low
            on = state != states[t, at]
            if not on.all():  # from here on all is as it was, but for the count
                met = ~on
                ended[t:, at[met]] += count[met] - ended[t, at[met]]
                at, state, count = at[on], state[on], count[on]
                if not len(at):
                    break
            states[t, at], ended[t, at] = state, count


def phrases(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text by language, its letters and separators); 0 letters if it has no letter at all."""
    model.unfold()
    coded = [encode(t, model.numbers) for t in texts]
    sizes = np.array([len(c) if c.any() else 0 for c in coded], np.int64)
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    opens = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    grid = np.full((len(owner), SEGMENT), model.padding, model.numbers.dtype)
    flat, at = grid.reshape(-1), 0
    for c, n, p in zip(coded, sizes, parts):
        flat[at : at + n] = c[:n]
        at += int(p) * SEGMENT
    entries = [0] * len(model.tables)
    for a in range(0, len(owner), TOGETHER):
        steps = np.ascontiguousarray(grid[a : a + TOGETHER].T)
        for j, full in enumerate(model.tables):
            found, entries[j] = _parsed(full, model.alphabets[j].astype(np.uint32)[steps], opens[a : a + TOGETHER], entries[j])
            counts[:, j] += np.bincount(owner[a : a + TOGETHER], found, len(texts)).astype(np.int64)
    return counts + (sizes > 0)[:, None], sizes


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The winning language of each text, and the share of its force among all of them."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    counts, sizes = phrases(model, texts)
    cost = counts * np.array(model.bits) / np.maximum(1, sizes)[:, None]
    best = cost.argmin(1)
    force = (cost.min(1, keepdims=True) / np.maximum(cost, 1e-12)) ** 8
    scores = np.where(sizes > 0, 1 / np.maximum(1.0, force.sum(1)), 0.0)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)], scores


def whole_rows(texts: list[str], most: int) -> list[str]:
    """The texts in order, without those that go beyond so many letters together; the shortest if that leaves none."""
    out, left = [], most
    for t in texts:
        if len(t) <= left:
            out.append(t)
            left -= len(t)
    return out or sorted(texts, key=lambda t: (len(t), t))[:1]


def learn(samples: dict[str, list[str]], settings: Settings = Settings()) -> Model:
    """Model of sample texts by language."""
    languages = sorted(samples)
    most = min(settings.letters, settings.all_letters // max(1, len(languages)))
    kept = {lang: whole_rows(samples[lang], most) for lang in languages}
    seen = {lang: Counter(c for t in kept[lang] for c in t.lower() if c.isalpha()) for lang in languages}
    letters = sorted({c for s in seen.values() for c in s})
    numbers = letter_numbers(letters)
    model = Model([], letters, [], [], [], [])
    for lang in languages:
        alphabet = alphabet_of(letters, seen[lang], settings)
        codes = [c for t in kept[lang] for c in [0, *alphabet[encode(t, numbers)].tolist()]]
        if not any(codes):
            continue
        moves = build_automaton(codes)
        model.languages.append(lang)
        model.alphabets.append(alphabet)
        model.triples.append(np.array([(s, c, n) for s, m in enumerate(moves) for c, n in m.items()], np.int64))
        model.states.append(len(moves))
        model.bits.append(float(np.log2(len(codes) + 1)))
    return model


def learnable(id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """Whether a row may be learned from: its id's crc32 isn't in the held-out fold."""
    return id_crc(id_col) % folds != held_out


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    settings: Settings = Settings(), usable: Column | None = None,
) -> Model:
    """Model of at most ``rows`` labelled rows of each language, those with the smallest hash of id and text among those of no
    more than ``letters`` characters, or its shortest; rows that agree in both are one."""
    known = docs.where(learnable(id_col) if usable is None else usable)
    known = known.where(named(lang_col).isNotNull() & named(text_col).isNotNull())
    text = named(text_col).cast("string")
    known = known.select(named(lang_col).cast("string").alias("lang"), F.xxhash64(named(id_col), text).alias("h"), text.alias("text"))
    sized = cut(known.groupBy("lang", "h").agg(F.min(F.length("text")).alias("size")), "labelled")
    n = sized.agg(F.count_distinct("lang")).first()[0]
    if n > settings.all_rows:
        raise ValueError(f"{n} labels are more than the {settings.all_rows} rows that are learned from")
    most = max(1, min(settings.rows, settings.all_rows // max(1, n)))
    # The smallest hashes of a language are among the smallest of each of its parts, so that no task orders a language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(PARTS))).orderBy("h")
    hashes = sized.where(F.col("size") <= settings.letters)
    few = hashes.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most)
    few = few.select("lang", "h")
    shortest = sized.groupBy("lang").agg(F.min(F.struct("size", "h"))["h"].alias("h")).join(few, "lang", "left_anti")
    few = few.unionByName(shortest)
    chosen = F.broadcast(few.select(F.col("lang").alias("l"), F.col("h").alias("g")))  # all_rows rows at most
    found = known.join(chosen, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g")), "left_semi")
    # Each text comes once, however often its row does; the driver gets all_rows texts at most, all short but where a
    # language has none.
    rows = found.groupBy("lang", "h").agg(F.min("text").alias("text")).toArrow().to_pylist()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return learn(samples, settings)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1
) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(named(id_col), named(text_col).cast("string").alias("_text"))
    names = [id_col, "held_out", "lang_pred", "score"]

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = predict(shared.value, batch.column(1).to_pylist())
            held = [crc_of_id(i) % folds == held_out for i in batch.column(0).to_pylist()]
            columns = [pa.array(held, pa.bool_()), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kinds = [T.BooleanType(), T.StringType(), T.DoubleType()]
    return rows.mapInArrow(identified, T.StructType([rows.schema[id_col], *map(T.StructField, names[1:], kinds)]))
