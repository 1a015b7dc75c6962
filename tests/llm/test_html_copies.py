"""What pages of a host repeat, against brute force, and that copies keep their text."""

import random

import numpy as np
import pytest

from lodestar.llm import html_text

MENU = "<div>Home News Sports About Contact Help Terms Privacy Jobs</div>"


def brute(streams, run):
    """For each token the most pages that share a run covering it."""
    having = {}
    for i, s in enumerate(streams):
        for a in range(len(s) - run + 1):
            having.setdefault(tuple(s[a : a + run]), set()).add(i)
    out = []
    for s in streams:
        most = [0] * len(s)
        for a in range(len(s) - run + 1):
            for j in range(a, a + run):
                most[j] = max(most[j], len(having[tuple(s[a : a + run])]))
        out.append(most)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_shared_runs(seed):
    """Against all substrings, on pages that share passages but aren't near-equal."""
    random.seed(seed)
    passages = [[random.randrange(1, 9) for _ in range(random.randrange(3, 14))] for _ in range(5)]
    streams = []
    for _ in range(12):
        s = []
        for _ in range(random.randrange(0, 4)):
            s += [random.randrange(10, 10_000) for _ in range(60)] + random.choice(passages)
        streams.append(s)
    run = random.randrange(2, 7)
    found, n = html_text.shared_by(streams, run)
    assert [f.tolist() for f in found] == brute(streams, run)
    assert n == len(streams) - max(0, sum(not s for s in streams) - 1)


def test_near_equal_pages_are_one():
    random.seed(1)
    text = [random.randrange(5000) for _ in range(400)]
    near = [text[:k] + [9999] + text[k + 1 :] for k in (50, 200, 350)]
    found, n = html_text.shared_by([text, *near, [random.randrange(5000) for _ in range(300)]], 8)
    assert n == 2 and max(int(f.max()) for f in found) == 1


def test_coverage_judges_marked_and_unmarked_blocks():
    """A notice that most pages of the host have goes even inside their articles; a passage that few share stays."""
    random.seed(2)
    notice, quote = "Sign up for our free weekly letter and never miss a story", "four score and seven years ago our fathers brought forth"
    pages, want = [], []
    for i in range(20):
        own = " ".join(f"w{random.randrange(9999)}" for _ in range(30))
        said = [own, quote] if i in (3, 4, 5) else [own]
        pages.append("<article>" + "".join(f"<p>{t}</p>" for t in [*said, notice]) + "</article>")
        want.append("\n".join(said))
    got = html_text.main_texts(pages)
    assert [t for t, _, _ in got] == want and all(n == len(notice.split()) for _, n, _ in got)
    # Without marks three pages that share a passage are enough, and unique runs around it stay.
    plain = [f"<div>alpha{i} beta{i} {quote} omega{i}</div>" + "<p>" + " ".join(f"x{random.randrange(99999)}" for _ in range(60)) + "</p>" for i in range(4)]
    assert all(t.startswith(f"alpha{i} beta{i} omega{i}\n") for i, (t, _, _) in enumerate(html_text.main_texts(plain)))
    assert quote in html_text.main_texts(plain[:2])[0][0]


def test_marks_decide_where_nothing_repeats():
    page = "<nav><a href=1>Home</a></nav><p>One line.</p><footer>All rights reserved</footer>"
    assert html_text.main_texts([page]) == [("One line.", 0, 4)]


def test_copies_keep_their_article():
    articles = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    page, *others = [f"{MENU}<div>{a}</div>" for a in articles]
    got = html_text.main_texts([page, page])
    assert [t for t, _, _ in got] == ["Home News Sports About Contact Help Terms Privacy Jobs\n" + articles[0]] * 2
    # With different pages, the menu is known and the copies don't hide each other's article.
    assert [t for t, _, _ in html_text.main_texts([page, page, page, *others])] == [articles[0]] * 3 + articles[1:]


def test_whole_text_stays():
    story = " ".join(f"w{i}" for i in range(20))
    pages = [f"<div>{story}</div>", *[f"<div>{story}</div><div>{' '.join(f'{c}{i}' for i in range(90))}</div>" for c in "abc"]]
    assert html_text.main_texts(pages)[0][0] == story


def test_copies_under_other_urls(spark):
    html = "<p>" + " ".join(f"w{i}" for i in range(30)) + "</p>"
    rows = [(1, "http://h/a", html, 1), (2, "http://h/b", html, 1), (2, "http://h/b", html, 1), (3, "http://h/c", "<p>" + "long " * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _html int")
    assert sorted(r["n_chars"] for r in html_text.extract(pages).collect()) == [len(html) - 7] * 3 + [5 * 300_000 - 1]


def test_suffix_groups_of_long_runs():
    tokens = np.array([1, 2, 3, 4] * 50)
    rank = html_text.suffix_groups(tokens, 12)
    assert rank[0] == rank[4] and len(set(rank[:100].tolist())) == 4


@pytest.mark.parametrize("shared,own", [(7, 150), (60, 120), (90, 130), (60, 26), (140, 30), (300, 200), (300, 20)])
def test_templates_of_every_share(shared, own):
    """Pages of one template with different articles are all distinct, whatever its share; near copies among them are one."""
    rng = random.Random(shared * own)
    word = lambda: f"w{rng.randrange(10**6)}"
    menu = [word() for _ in range(shared)]
    articles = [[word() for _ in range(own)] for _ in range(17)]
    copies = [list(articles[0]) for _ in range(3)]
    for c in copies:
        c[own // 2] = word()
    streams = [menu + a for a in [*articles, *copies]]
    known = {}
    coded = [[known.setdefault(w, len(known) + 1) for w in s] for s in streams]
    counts, distinct = html_text.shared_by(coded, 7)
    # The copies differ in one word, so in 7 runs of an article's.
    alike = own - 6 - 7 >= 0.8 * (own - 6 + 7)
    assert distinct == (17 if alike else 20)
    for c in counts:
        assert set(c[:shared]) == {distinct}
    for c in counts[1:17]:
        assert set(c[shared + 6 :]) <= {1}
    notice = [word() for _ in range(11)]
    known = {}
    streams = [menu + a + (notice if i < 8 else []) for i, a in enumerate(articles)]
    counts, _ = html_text.shared_by([[known.setdefault(w, len(known) + 1) for w in s] for s in streams], 7)
    assert all(set(c[-11:]) == {8} for c in counts[:8])


def test_runs_are_counted_over_the_whole_host(spark):
    """On a host of 200 unmarked pages ten with a run are enough and nine aren't, wherever these pages are; near copies
    are one page; the pages may be dealt to tasks in any way."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    often, seldom = [words(10) for _ in range(12)], [words(10) for _ in range(12)]
    said = [[words(60)] for _ in range(190)]
    for notices, k in ((often, 10), (seldom, 9)):
        for notice in notices:
            for i in rng.sample(range(190), k):
                said[i].append(notice)
    copied = words(300)
    copies = [[copied.replace(copied.split(" ")[i * 20], f"x{i}")] for i in range(1, 12)]
    pages = ["".join(f"<div>{t}</div>" for t in [*blocks]) for blocks in [*said, *copies]]
    want = ["\n".join(t for t in blocks if t not in often) for blocks in [*said, *copies]]
    rows = [(i, f"http://{h}/{i}", p) for h in ("a", "b") for i, p in enumerate(pages)] + [(i, "http://small/", pages[0]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts, chars in ((1, 1 << 22), (7, 10_000)):
        got = html_text.extract(df.repartition(parts), rules=html_text.Rules(chars=chars)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["text"] == ("\n".join(said[0]) if r["url"] == "http://small/" else want[r["page_id"]])
    assert [t for t, _, _ in html_text.main_texts(pages)] == want
