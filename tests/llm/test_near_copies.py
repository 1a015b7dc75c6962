"""Near copies on whole shingle sets, against all pairs."""

import random

import numpy as np
import pyarrow as pa

from lodestar.llm import near_copies, simhash


def brute(rows):
    """The ids that stay: the smallest of each group, pairs compared in full."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (len(a & b) >= 0.8 * len(a | b)) if a or b else True:
                root[find(i)] = find(j)
    members = {}
    for i, (key, _) in enumerate(rows):
        members.setdefault(find(i), []).append(key)
    return sorted((min((k is None, k or 0) for k in m) for m in members.values()), key=str)


def test_copies_beyond_two_bits(spark):
    random.seed(5)
    rows, far = [], 0
    for k in range(30):
        w = [f"w{random.randrange(400)}" for _ in range(120)]
        rows.append((10 * k, " ".join(w)))
        for j in range(1, 8):
            v = list(w)
            for _ in range(j):
                v[random.randrange(len(v))] = f"n{k}x{j}"
            rows.append((10 * k + j, " ".join(v)))
            far += (simhash.fingerprint(rows[-1 - j][1]) ^ simhash.fingerprint(rows[-1][1])).bit_count() > 2
    assert far > 100
    rows += [(None, rows[8][1]), (None, "alone without an id"), (5000, rows[3][1].upper()), (5001, "a b"), (5002, "a  B"), (5003, None), (5004, ""), (7, "same id, other text here"), (7, "same id, again other text")]
    rows = [(i, t, 1) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = near_copies.keep_one(docs.repartition(5))
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()), key=str)
    assert found == brute([r[:2] for r in rows])
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_hot_key_whole(spark, monkeypatch):
    """Texts around 0.8 that share many keys, in blocks of a few texts and with the last round's pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    random.seed(6)
    base, rows = [f"b{i}" for i in range(100)], []
    for k in range(60):
        v = list(base)
        for _ in range(1 + k % 5):
            v[random.randrange(100)] = f"n{k}"
        rows.append((k, " ".join(v)))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((False, r["doc_id"]) for r in got.collect()), key=str) == brute(rows)


def test_pipeline_stage(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w30", "other")), (3, "not a copy")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.STAGES[2][1](spark, docs, "").collect()) == [1, 3]


def test_shingles():
    (k1, _, a), (k2, _, b), (_, _, c) = near_copies.shingles(pa.array([" A b c d e  f", "a B c d e f ", None]))
    assert k1 == k2 and a.tolist() == b.tolist() and len(a) == 2 and not len(c)


def test_sketches():
    random.seed(7)
    sets = [np.unique(np.array([random.getrandbits(64) for _ in range(50)], np.uint64)) for _ in range(3)]
    found = near_copies.minima(sets, 0, 100)
    wide = near_copies.sketches(found)
    for i in range(3):
        for j in range(3):
            assert near_copies.apart(wide[i], wide[j]) == sum(int(a) % 16 != int(b) % 16 for a, b in zip(found[:, i], found[:, j]))
    assert near_copies.most_apart(1024) < 0.25 * 1024
