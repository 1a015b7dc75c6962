"""Operators on single texts, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import _shared, html_text, langid, packing, quality_model, quality_rules, simhash, sketch
from lodestar.llm.queries import tokenizer_path

SPACES = " \t\n\x0b\x0c\r"
TEXTS = st.text(alphabet="ab \n\t\x0b\x0c\r  é#|.", max_size=200)


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACES:
            out, now = ([*out, now], "") if now else (out, "")
        else:
            now += c
    return [*out, now] if now else out


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, ties, repeated rows, very long texts, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \n\t"), (None, "x y"), (None, None), (5, long), (6, long + " tail"), (7, "one"), (8, "  é z")]
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 3 else "s", 0, "x", 1, 2, 3.0) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, size long, _b long, score double")


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words(text):
    assert [w.decode() for w in _shared.words_of(text)] == words(text)
    offsets, codes, distinct = _shared.coded_words(pa.array([text, None, text]))
    assert [distinct[int(c)].as_py() for c in codes] == words(text) * 2 and offsets.tolist() == [0, len(words(text)), len(words(text)), 2 * len(words(text))]


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want


@given(st.lists(st.sampled_from("abcdefgh"), max_size=120), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_rules_base(letters, lines):
    text = " ".join(letters)
    text = text.replace("a b", "a\nb") if lines else text
    m = quality_rules.measure(text)
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    rows = [x for x in text.split("\n") if words(x)]
    assert m["n_words"] == len(w) and m["n_repeat_words"] == len(again) and m["word_chars"] == sum(map(len, w))
    assert m["n_dup_lines"] == len(rows) - len(set(rows))
    assert m["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (m["base_failed"] and m["kept"])


@given(st.lists(st.sampled_from(["да", "нет", "é", "ascii", "中文字", "x\u0301"]), max_size=90), st.integers(2, 9))
@settings(max_examples=100, deadline=None)
def test_rules_shares(letters, width):
    """Shares and verdict by brute force in characters, beyond ASCII too."""
    text = "\n".join(" ".join(letters[i : i + width]) for i in range(0, len(letters), width))
    rules = quality_rules.Rules()
    m, w = quality_rules.measure(text), words(text)
    shares = []
    for n, _ in rules.ngrams:
        windows = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        again = {j for i in range(len(w) - n + 1) if windows[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        shares.append(sum(len(w[j]) for j in again) / max(1, sum(map(len, w))))
    assert m["dup_ngram_shares"] == pytest.approx(shares)
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += sum(map(len, words(line))) if line in seen else 0
        seen.add(line)
    assert m["dup_line_share"] == pytest.approx(lines / max(1, m["word_chars"]))
    fine = all(s <= most for s, (_, most) in zip(m["dup_ngram_shares"], rules.ngrams)) and m["dup_line_share"] <= 0.3
    assert m["kept"] == (not m["base_failed"] and fine)


def test_rules_verdicts():
    clean = "The quick brown fox jumps over a lazy dog while seven wizards vex the bold knights of autumn near quiet lakes under stars."
    assert quality_rules.measure(clean)["kept"]
    assert not quality_rules.measure(clean.replace(" ", " ## "))["kept"]
    assert not quality_rules.measure("\n".join([clean] * 2))["kept"]
    assert quality_rules.measure("a # * | < é")["n_symbols"] == 4


def test_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), packing.Tokens(tokenizer_path())
    assert own.by_chunk
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["foo<|endoftext|>bar IT'S don't 12345 x² nb \x1c\x1d ÀÉß ŒŒ ﬁ İst ΣΑΣ 中文 é ́x", "", "\n", "<<|startoftext|> a<|b", "a''s'll'RE!!", "☃" * 50, "z" * 3000]
    bounds, ids = own.of(pa.array(texts))
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t


def test_other_tokenizers_take_the_whole_way():
    own = packing.Tokens(tokenizer_path("byte_bpe_50k.json"))
    bounds, ids = own.of(pa.array(["a b", None]))
    assert not own.by_chunk and ids[-1] == 0 and bounds[1] < bounds[2]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=80, deadline=None)
def test_packing_solution(counts):
    found = packing.solve(counts, 64)
    used = Counter()
    for lengths, k in found.configurations:
        assert sum(lengths) <= 64 and k > 0
        for x in lengths:
            used[x] += k
    assert used == Counter(counts) and found.sequences >= found.bound - 1e-6


def test_packing_program_packs_most():
    """The program, not best fit, makes nearly all sequences, and few more than any packing needs."""
    random.seed(4)
    counts = Counter(min(2048, int(random.lognormvariate(5.6, 1.2)) + 1) for _ in range(20_000))
    found = packing.solve(counts)
    short = found.sequences - found.full
    assert found.full == counts[2048] and found.programmed >= 0.9 * short
    assert found.sequences <= 1.01 * found.bound + 1
    volume = sum(a * n for a, n in counts.items()) / 2048
    assert found.bound >= volume - 1e-6


def test_packing_fractional_solution():
    """Amounts never ask for more than there is and waste next to nothing; with what is open they meet the bound."""
    random.seed(9)
    counts = Counter(random.randint(1, 400) for _ in range(30_000))
    lengths = np.array(sorted(counts))
    demand = np.array([counts[int(a)] for a in lengths])
    amounts, bound = packing.fractional(lengths, demand, 1024)
    covered = np.zeros(len(lengths))
    for places, amount in amounts.items():
        assert lengths[list(places)].sum() <= 1024 and amount > 0
        np.add.at(covered, list(places), amount)
    assert (covered <= demand + 1e-6).all()
    open_ = float((lengths * (demand - covered)).sum()) / 1024
    assert bound - 1e-6 <= sum(amounts.values()) + open_ <= 1.01 * bound and open_ < 0.8 * bound


def parsed(train, text):
    """Phrases by cross parsing: longest matches from left to right; an unknown letter is a phrase of its own."""
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train:
            n += 1
        want, at = want + 1, at + n
    return want


@pytest.mark.parametrize("size", [1, 200, 256, 257, 5000, 20_000])
def test_cross_parsing(size):
    """Phrases of short and long texts, over the seams of segments and of groups of segments."""
    random.seed(size)
    train = "".join(random.choices("abc", k=600))
    # Long matches go over seams: pieces of the sample among noise.
    text = ""
    while len(text) < size:
        a = random.randrange(600)
        text += train[a : a + random.randrange(1, 400)] + random.choice("abcd")
    text = text[:size]
    model = langid.learn({"x": [train]})
    assert langid.phrases(model, [text])[0][0, 0] == parsed(train, text)


def test_cross_parsing_of_many(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 8)
    monkeypatch.setattr(langid, "TOGETHER", 5)
    random.seed(3)
    train = {k: "".join(random.choices(k, k=300)) for k in ("abca", "bcdd")}
    texts = ["".join(random.choices("abcd", k=random.randrange(90))) for _ in range(60)] + ["abca" * 40]
    model = langid.learn({k: [t] for k, t in train.items()})
    counts, sizes = langid.phrases(model, texts)
    for t, c, n in zip(texts, counts, sizes):
        assert n == len(t) and c.tolist() == [parsed(train[k], t) for k in model.languages]


def test_langid_sample(spark):
    """However many rows lack an id or repeat one, a bounded number of whole rows is learned from, alike every time."""
    rows = [(None if i % 2 else i, f"text number {i} of words " * (1 + i % 3), "en" if i % 5 else "de") for i in range(3000)] + [(6, "same", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    learn = langid.learn
    try:
        langid.learn = lambda samples, settings: seen.append(samples) or learn(samples, settings)
        langid.fit(docs)
        langid.fit(docs.repartition(7))
    finally:
        langid.learn = learn
    assert seen[0] == seen[1] and {k: len(v) for k, v in seen[0].items()} == {"de": 64, "en": 64}
    texts = {r[1] for r in rows}
    assert all(t in texts for v in seen[0].values() for t in v)
    assert langid.whole_rows(["a" * 9, "b" * 3, "c" * 2], 5) == ["bbb", "cc"] and langid.whole_rows(["aaa", "bb"], 1) == ["bb"]


def test_langid_scripts():
    """Letters beyond the most frequent ones still tell languages apart."""
    random.seed(11)
    one, two = [chr(0x4E00 + i) for i in range(500)], [chr(0x5E00 + i * 3) for i in range(500)]
    model = langid.learn({"x": ["".join(random.choices(one, k=3000))], "y": ["".join(random.choices(two, k=3000))], "z": ["plain latin words " * 100]})
    # Texts of pairs that the samples have.
    found, _ = langid.predict(model, ["".join(random.choices(one, k=200)), "".join(random.choices(two, k=200)), "latin words"])
    assert found == ["x", "y", "z"] and all(a[-1] < 127 for a in model.alphabets)


def test_langid_keeps_every_language_its_letters():
    """Six scripts of 300 letters: each language's 60 most frequent letters have classes of their own, whatever the others."""
    random.seed(6)
    starts = {"ru": 0x400, "hi": 0x904, "zh": 0x4E00, "yi": 0xA000, "ko": 0xAC00, "ka": 0x10A0}
    scripts = {k: [c for c in map(chr, range(a, a + 900)) if c.isalpha() and c.lower() == c][:300] for k, a in starts.items()}
    text = lambda k, n: "".join(random.choices(scripts[k], [1 / (i + 1) for i in range(len(scripts[k]))], k=n))
    samples = {k: [text(k, 400) for _ in range(20)] for k in scripts}
    model = langid.learn(samples)
    for k, alphabet in zip(model.languages, model.alphabets):
        counted = sorted(Counter("".join(samples[k])).items(), key=lambda x: (-x[1], x[0]))[:60]
        own = {c: alphabet[model.letters.index(c) + 2] for c, _ in counted}
        assert len(set(own.values())) == len(own) and max(own.values()) <= 61
    asked = [(k, text(k, 30)) for k in scripts for _ in range(20)]
    assert langid.predict(model, [t for _, t in asked])[0] == [k for k, _ in asked]
    # Two languages of one script are told apart as well beside other scripts as alone.
    pair = {"k1": "".join(scripts["ko"][:150]), "k2": "".join(scripts["ko"][100:250])}
    words = {k: ["".join(random.choices(letters, k=3)) for _ in range(200)] for k, letters in pair.items()}
    say = lambda k, n: " ".join(random.choices(words[k], k=n))
    two = {k: [say(k, 400)] for k in pair}
    asked = [(k, say(k, 5)) for k in pair for _ in range(100)]
    right = lambda m: sum(g == k for g, (k, _) in zip(langid.predict(m, [t for _, t in asked])[0], asked))
    assert right(langid.learn(two | {k: v for k, v in samples.items() if k != "ko"})) >= right(langid.learn(two)) >= 195


def test_langid(spark, odd_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and len(held) > 30
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    odd = langid.identify(odd_docs, langid.fit(odd_docs)).toPandas()
    assert len(odd) == 11 and (odd[odd.doc_id.isin([2, 3, 4])].lang_pred == "und").all() and odd.score.between(0, 1).all()
    assert langid.identify(odd_docs.limit(0), langid.fit(odd_docs.limit(0))).count() == 0


def test_quality_model(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.fit(docs, labels)
    got = quality_model.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality_model.score(docs, model).where("predicted = 1").count()
    odd = quality_model.score(odd_docs, model).toPandas()
    assert len(odd) == 11 and odd.score.between(0, 1).all()
    nothing = quality_model.fit(docs, labels.limit(0))
    assert quality_model.score(odd_docs, nothing).where("score = 0.5").count() == 11


def test_votes_are_the_nearest_neighbours():
    """Scores by brute force: all cosines, the nearest ones' similarities, classes weighted by how frequent they are."""
    rng = np.random.default_rng(3)
    settings_ = quality_model.Settings(bins=64, dimensions=12, neighbours=7)
    counts, labels = rng.poisson(0.4, (90, 64)).astype(np.float32), (np.arange(90) % 3 == 0).astype(np.int64)
    counts[labels == 1, :10] += 2
    model = quality_model.fit_counts(counts, labels, settings_)
    fresh = rng.poisson(0.5, (40, 64)).astype(np.float32)
    got, share = model.scores(fresh), labels.mean()
    for row, score in zip(fresh, got):
        at = (np.sqrt(row / max(1.0, row.sum())) * model.weights) @ model.axes
        at = at / max(1e-9, np.linalg.norm(at))
        near = sorted(((float(at @ v), int(l)) for v, l in zip(model.vectors, labels)), reverse=True)[:7]
        force = [(max(0.0, c) ** 4 + 1e-9, l) for c, l in near]
        good, bad = sum(f for f, l in force if l) / share, sum(f for f, l in force if not l) / (1 - share)
        assert score == pytest.approx(good / (good + bad), abs=1e-4)


def test_conflicting_labels(spark):
    """Ids with two labels, and all but one text of an id, aren't learned from; fits agree whatever the order of rows."""
    text = lambda c, n: " ".join(f"{c}{i % 7}" for i in range(n))
    docs = [(i, text("ab"[i % 2], 30 + i)) for i in range(40)] + [(4, "other text"), (4, None), (None, "x")]
    labels = [(i, i % 2) for i in range(40)] + [(6, 1), (8, 0), (None, 1), (10, None)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = (quality_model.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 5))
    assert (one.vectors == two.vectors).all() and (one.labels == two.labels).all()
    assert len(one.labels) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40) if i != 6)


def test_rules_operator(odd_docs):
    got = quality_rules.judge(odd_docs).toPandas()
    assert len(got) == 11 and got[got.doc_id == 2].n_words.item() == 0
    assert quality_rules.keep_clean(odd_docs).columns == odd_docs.columns
    assert quality_rules.judge(odd_docs.limit(0)).count() == 0


def test_html_blocks():
    page = (
        '<html><body><div id="top-nav"><a href=1>Home</a></div><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><article><h1>T &amp; more</h1>'
        '<p>One<br>line&nbsp;two.<p>Para <i>two</i>, <span class="ad">buy</span>end.<ul><li>a<li>b</ul><script>x="</p>"</script><aside>side</aside>'
        '<section class="comments"><p>nice</p></section><form>Go</form></article><footer>(c)</footer>'
    )
    assert html_text.main_texts([page])[0][0] == "T & more\nOne line two.\nPara two, end.\na\nb"
    assert [t for t, _, _ in html_text.main_texts([None, "", "<p>plain", "a < b & c &lt; d <b"])] == ["", "", "plain", "a < b & c < d"]
    # Without an article the host's repeated runs go and unique ones stay.
    menu, foot = "<div>Home News Sports About Contact Help Terms Privacy Jobs</div>", "<div>All rights reserved by the owner of this site since 1999</div>"
    body = ["Whales sing slowly at night while the tide is low", "Prices of grain rose again in March, and fell in April", "My neighbour paints fences, gates and now and then a boat"]
    assert [t for t, _, _ in html_text.main_texts([f"{menu}<div>{b}</div>{foot}" for b in body])] == body


def test_suffix_groups():
    random.seed(2)
    tokens = np.array(random.choices(range(3), k=200))
    rank = html_text.suffix_groups(tokens, 5)
    key = [tuple(tokens[i : i + 5]) for i in range(len(tokens))]
    for i in range(0, 200, 7):
        assert [rank[i] == rank[j] for j in range(200)] == [key[i] == key[j] for j in range(200)]


def test_html_operator(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (9001, "no url", ""), (9002, "http://h/", "<p>x")], pages.schema)
    got = html_text.extract(pages.unionByName(odd)).toPandas()
    assert len(got) == pages.count() + 3 and (got.text.str.len() == got.n_chars).all() and got[got.page_id == 9002].text.item() == "x"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_sketches(spark, odd_docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sketch.edited_neighbours(docs).collect()}

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    off = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, said in ((text, edited, got[i]["near_edited"]), (text, after, got[i]["near_next"])):
            x, y = shingles(a), shingles(b)
            off.append(abs(said - (len(x & y) / len(x | y) if x | y else 1.0)))
    assert np.mean(off) < 0.03 and max(off) < 0.2
    odd = sketch.edited_neighbours(odd_docs).toPandas()
    assert len(odd) == 11 and odd[odd.doc_id == 1].fingerprint.nunique() == 1
    assert sketch.edited_neighbours(odd_docs.limit(0)).count() == 0


def test_sketch_merges(spark):
    from pyspark.sql import functions as F

    rows = [("g", " ".join(f"w{i}" for i in range(a, a + 900))) for a in (0, 450, 900)] + [("e", "")]
    df = spark.createDataFrame(rows, "g string, text string").withColumn("s", sketch.sketch(F.col("text")))
    merged = {r["g"]: r["s"] for r in sketch.merge_groups(df, ["g"], "s").collect()}
    whole = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1800)),)], "text string").select(sketch.sketch(F.col("text")).alias("s")).first()["s"]
    assert merged["g"] == whole and merged["e"] == []
    n = df.where("g = 'g'").select(sketch.distinct_shingles(F.col("s")).alias("n")).first()["n"]
    assert abs(n - 896) < 250
    pair = spark.createDataFrame([(rows[0][1], rows[0][1] + " " + rows[2][1])], "a string, b string")
    assert pair.select(sketch.containment(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("c")).first()["c"] > 0.8
