"""Target encoding, secret scans and ranked search, against brute force and SQL."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import lexical_rank, queries, secret_scan, target_rates


@pytest.fixture(scope="module")
def shop():
    con = duckdb.connect()
    for t in "documents benchmark sales sale_lines items vendors clients".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_target_rates", "op12_secret_scan", "op13_lexical_rank"])
def test_sql(spark, shop, name):
    assert same_rows(queries.queries()[name](spark, DATA), shop.sql(queries.oracle_sql()[name]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9) | st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 300), max_size=30))
def test_rank_index(values, positions):
    index = target_rates.RankIndex(np.array(values, np.int64))
    at = np.array([min(p, len(values)) for p in positions] + [0, len(values)])
    assert index.rank(at).tolist() == [sum(values[:p]) for p in at]


@pytest.mark.parametrize("partitions,block", [(1, 7), (3, 11), (9, 1 << 17)])
def test_history(spark, partitions, block):
    """Hot keys and instants that go over ranges and blocks, null keys' codes, null folds and times, repeated rows."""
    random.seed(partitions)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        at = None if random.random() < 0.02 else day + datetime.timedelta(seconds=random.choice([0, 0, 0, 5, random.randrange(50)]))
        rows.append((i, random.choice([0, 1]), random.choice([7, 7, 7, -1, i % 5]), at, random.choice([0, 1, 2, 3, 4, None]), random.choice([1, 1, 3, 1000]), random.choice([0, 1])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "part long, code int, key long, at timestamp_ntz, fold int, n long, upto long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = target_rates.history(df, ["part", "upto"], "at", "fold", "n", "upto", "code", "key", block_rows=block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    timed = [r for r in rows if r[3] is not None]
    want = []
    for part, code, key, at, fold, n, s in timed:
        past = [r for r in timed if r[1:3] == (code, key) and r[3] < at and r[4] != fold]
        want.append((part, s, code, key, sum(r[5] for r in past), sum(r[6] for r in past)))
    assert sorted((r.part, r.upto, r.code, r.key, r.past_n, r.past_s) for r in got) == sorted(want)


def test_shop_rates_of_odd_rows(spark):
    """Sales without a time or in two rows, lines without a sale, null ids, unknown ids, columns that clash, empty tables."""
    t = datetime.datetime
    lines = [(1, 5, 1, "returned"), (1, 5, 1, "kept"), (2, None, None, None), (3, 5, 1, "kept"), (9, 5, 1, "kept"), (None, 5, 1, "kept"), (4, 6, 2, "returned")]
    lines = spark.createDataFrame([(*r, 1, 2) for r in lines], "sale_id long, item_id long, vendor_id long, flag string, n long, row long")
    sales = [(1, 8, t(2024, 1, 1)), (2, None, t(2024, 1, 2)), (3, 8, t(2024, 1, 3)), (3, 8, t(2024, 1, 9)), (4, 77, None), (5, 8, t(2024, 1, 1))]
    sales = spark.createDataFrame([(*r, 3) for r in sales], "sale_id long, client_id long, sold_at timestamp_ntz, value int")
    items = spark.createDataFrame([(5, "b", 1), (5, "a", 1), (None, "c", 1)], "item_id long, kind string, sale_id int")
    vendors = spark.createDataFrame([(1, None)], "vendor_id long, nation_id int")
    clients = spark.createDataFrame([(8, "x")], "client_id long, segment string")
    got = {r.sale_id: r for r in target_rates.shop_rates(lines, sales, items, vendors, clients).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].n_lines, got[1].n_returned, got[1].item_n, got[1].item_rate) == (2, 1, 0, 500_000)
    assert (got[2].item_id, got[2].vendor_id, got[2].n_lines) == (-1, None, 1)
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    past = [(i, n, s) for i, n, s in ((1, 2, 1), (2, 1, 0)) if fold(i) != fold(3)]
    rate = lambda n, s, p: p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)
    whole = rate(sum(n for _, n, _ in past), sum(s for _, _, s in past), 500_000)
    own = [(n, s) for i, n, s in past if i == 1]
    n, s = sum(n for n, _ in own), sum(s for _, s in own)
    shared = rate(n, s, whole)
    assert (got[3].item_n, got[3].item_rate, got[3].client_rate) == (n, rate(n, s, shared), rate(n, s, shared))
    everyone = rate(sum(n for _, n, _ in past), sum(s for _, _, s in past), whole)  # null nations and unknown vendors are one
    assert got[3].vendor_rate == rate(n, s, everyone)
    none = target_rates.shop_rates(lines.limit(0), sales, items, vendors, clients)
    assert none.count() == 0 and "client_rate" in none.columns


BITS = ["password", "passwd", "secret", "token", "api_key", "APIKEY", " ", "=", ":", "'", '"', "abc", "é", "한", "AKIA", "A", "K", "0", "f", "9a", "-", "_", "gh", "ghp_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "\n", "deadbeef", "SECRE", "TOKEN", "t", "0123456789ABCDEF", "."]
#: Where the last repeat of a kind starts: after the match of this, at the match's start.
HEADS = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "access": "AKIA", "hex": "", "github": "gh[pousr]_", "slack": "xox[abeoprs]-"}


def brute_spans(text):
    out = []
    for place, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text):
            head = HEADS.get(rule.kind)
            if head is None or len(m[0]) - len(re.match(head, m[0])[0]) >= rule.least:
                out.append((m.start(), m.end(), place))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=60).map("".join), max_size=8))
def test_spans(texts):
    found = list(secret_scan._spans(secret_scan.compiled(secret_scan.RULES), pa.array(texts, pa.string())))
    assert found == [brute_spans(t) for t in texts]


def test_spans_over_blocks_and_lanes(monkeypatch):
    """Matches that cross lanes and blocks, among them a run longer than either."""
    monkeypatch.setattr(secret_scan, "BLOCK", 300)
    monkeypatch.setattr(secret_scan, "LANE", 16)
    monkeypatch.setattr(secret_scan, "LEAD", 4)
    random.seed(4)
    texts = ["".join(random.choice(BITS) for _ in range(400)) for _ in range(6)] + ["a1" * 900, "", "token=" + "x" * 1000 + " é", None]
    found = list(secret_scan._spans(secret_scan.compiled(secret_scan.RULES), pa.array(texts, pa.string())))
    assert found == [brute_spans(t or "") for t in texts]


def test_refused_rules():
    for pattern in ("a*", "ab|a(bc)+d", r"\bx", "a(?=b)"):
        with pytest.raises(ValueError):
            secret_scan.Automaton((secret_scan.Rule("x", pattern),))


def test_machine_is_minimal():
    nexts, outs = secret_scan._machine(secret_scan.Rule("x", "[ab]+", 2), [ord("a"), ord("b"), ord("-")])
    assert len(nexts) == 3  # none, one and more of them
    automaton = secret_scan.Automaton((secret_scan.Rule("x", "[ab]+"), secret_scan.Rule("y", "[ba]+")))
    assert len(automaton.nexts) // automaton.width == 2


def test_scan_of_odd_rows(spark):
    secret = "token: 'abcdef'"
    docs = spark.createDataFrame([(1, None, 1), (None, secret, 2), (1, secret, 3), (1, secret, 3), (2, "", 4), (3, "AKIA" + "B" * 16 + " é " + "ab" * 12, 5)], "doc_id long, text string, spans int")
    got = secret_scan.report(docs).collect()
    assert len(got) == 6 and sum(r.n_assign for r in got) == 3
    assert {r.base_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    last = next(r for r in got if r.doc_id == 3)
    assert last.spans == "access:0:20,hex:23:47" and last.base_sha256 == hashlib.sha256(last.spans.encode()).hexdigest()
    clean = secret_scan.redact(docs).collect()
    assert [r.text for r in clean if r.doc_id == 3] == ["<access> é <hex>"] and [r.text for r in clean if r.spans == 1] == [None]
    assert secret_scan.report(docs.limit(0)).count() == 0


def brute_rank(docs, items, best=10):
    cut_up = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    counted = [(i, Counter(cut_up(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    count, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut_up(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms,entries", [(1 << 16, 1 << 21), (20, 7)])
def test_ranked_search(spark, terms, entries):
    """Odd rows, ties, blocks of items and of entries."""
    random.seed(terms)
    words = ["the", "The", "é", "x1", "rain", "sea", "한글", "b", "c", "d"]
    text = lambda k: random.choice([" ", "\n", "-", "_"]).join(random.choice(words) for _ in range(k))
    docs = [(i, text(random.choice([1, 3, 30]))) for i in range(120)] + [(None, "rain sea"), (7, "rain sea"), (7, "rain sea"), (500, None), (501, ""), (502, "..."), (None, "rain sea")]
    items = [(i, text(4)) for i in range(12)] + [(None, "rain"), (50, None), (51, "nowhere"), (3, "sea")]
    given = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    limits = lexical_rank.Settings(block_terms=terms, block_entries=entries, parts=2)
    got = lexical_rank.rank(given, asked, settings=limits).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str) == brute_rank(docs, items)
    assert lexical_rank.rank(given.limit(0), asked).count() == 0 and lexical_rank.rank(given, asked.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 2**34), st.integers(0, 9)), max_size=200))
def test_radix_sums(entries):
    items, docs, impacts = (np.array([e[k] for e in entries], np.int64) for k in range(3))
    want = defaultdict(int)
    for i, d, s in entries:
        want[i, d] += s
    assert [(i, d, s) for i, d, s in zip(*(x.tolist() for x in lexical_rank.summed(items, docs, impacts)))] == [(i, d, s) for (i, d), s in sorted(want.items())]
