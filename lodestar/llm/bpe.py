"""Byte-pair merges of many words at once with numpy.

The words of a batch lie in one flat array of symbols.  In each round every word merges its leftmost pair of lowest
rank, which is the order in which a merge queue takes them; the ranks of pairs are kept, and only those next to a merge
are looked up anew, in an open-addressing table.  Words without a pair left leave the array.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(np.iinfo(np.int32).max)
SLOTS = 18


def visible_bytes() -> list[str]:
    """The character that stands for each byte: itself where visible in Latin-1, else those from 256 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Merges of a byte-level model whose words end in a suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        signs = visible_bytes()
        self.inner = np.array([vocabulary[c] for c in signs], np.int32)
        self.final = np.array([vocabulary[c + suffix] for c in signs], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.keys = np.zeros(1 << SLOTS, np.uint32)
        self.ranks = np.full(1 << SLOTS, NONE, np.int32)
        self.made = made
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # the first of those that want a free slot gets it
            free = self.ranks[slot] == NONE
            first = np.unique(slot[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.keys[slot[taken]], self.ranks[slot[taken]] = keys[left[taken]], left[taken]
            rest = np.setdiff1d(np.arange(len(left)), taken)
            left, slot = left[rest], (slot[rest] + 1) & ((1 << SLOTS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it is never merged."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        slot = self._slot(keys)
        out = self.ranks[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out != NONE))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << SLOTS) - 1)
            out[wrong] = self.ranks[slot[wrong]]
            wrong = wrong[(self.keys[slot[wrong]] != keys[wrong]) & (out[wrong] != NONE)]
        return out

    def apply(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) of the bytes of words that begin at starts."""
        n = len(starts)
        sizes = np.diff(np.append(starts, len(data)))
        last = np.append(starts[1:], len(data)) - 1
        symbols = self.inner[data]
        symbols[last] = self.final[data[last]]
        ranks = np.full(len(data), NONE, np.int32)
        inside = np.ones(len(data), bool)
        inside[last] = False
        at = np.flatnonzero(inside)
        ranks[at] = self.rank(symbols[at], symbols[at + 1])
        words, done_words, done_sizes, done_ids = np.arange(n), [], [], []
        while len(words):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != NONE
            if not going.all():
                mask = np.repeat(~going, sizes)
                done_words.append(words[~going])
                done_sizes.append(sizes[~going])
                done_ids.append(symbols[mask])
                symbols, ranks, words, sizes, lowest = symbols[~mask], ranks[~mask], words[going], sizes[going], lowest[going]
                if not len(words):
                    break
                starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(words)), sizes)
            best = np.flatnonzero(ranks == lowest[owner])
            best = best[np.append(True, owner[best[1:]] != owner[best[:-1]])]
            symbols[best] = self.made[lowest]
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            ranks[best] = ranks[best + 1]  # marks the end of a word, or is set below
            symbols, ranks, sizes = symbols[keep], ranks[keep], sizes - 1
            best -= np.arange(len(best))  # one symbol went for each merge before
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            after = best[best < ends]
            ranks[ends] = NONE
            ranks[after] = self.rank(symbols[after], symbols[after + 1])
            before = best[best > starts] - 1
            ranks[before] = self.rank(symbols[before], symbols[before + 1])
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words, sizes, ids = np.concatenate(done_words), np.concatenate(done_sizes), np.concatenate(done_ids)
        order = np.argsort(words)
        places = np.cumsum(sizes) - sizes
        out = sizes[order]
        upto = np.cumsum(out)
        return ids[np.arange(upto[-1]) + np.repeat(places[order] - upto + out, out)], out
