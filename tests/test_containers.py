"""Containers of lines and chains of groups, against brute force."""

import random

from lodestar.operators import lexical, recall
from lodestar.service import Workspace


def test_containers(spark):
    rng = random.Random(8)
    ranges = [(f"p{rng.randrange(3)}", i, a, a + rng.choice([0, 3, 40, 300, 5000, 2 * 10**9 - 10**4]), rng.randrange(2)) for i in range(150) for a in [rng.choice([1, 16, 17, 256, rng.randrange(1, 9000)])]]
    ranges += [("p0", 900, 30, 20, 5)]  # no range at all
    hits = [(f"p{rng.randrange(4)}", rng.choice([1, 15, 16, 255, 256, 4096, rng.randrange(1, 10_000)])) for _ in range(200)]
    r = spark.createDataFrame(ranges, "path string, id long, start_line long, end_line long, specificity int")
    found = spark.createDataFrame(hits, "path string, line int")
    got = {(x.path, x.line): (x.span, x.container) for x in lexical.containers(found, r).collect()}
    for path, line in set(hits):
        inside = [(b - a, -s, i) for p, i, a, b, s in ranges if p == path and a <= line <= b]
        span, _, best = min(inside, default=(None, None, None))
        assert got[path, line] == (span, best)
    assert len(got) == len(set(hits))


def test_nodes_meet_once(spark):
    """A range of lines is covered once, by few nodes."""
    from pyspark.sql import functions as F

    rows = [(a, a + n) for a in (1, 15, 16, 255, 257, 4095) for n in (0, 1, 14, 15, 16, 300, 70_000)]
    made = spark.createDataFrame(rows, "a long, b long").withColumn("n", lexical._nodes(F.col("a"), F.col("b"))).collect()
    for r in made:
        lines = [x for n in r.n for x in range(n.node * 16**n.level, (n.node + 1) * 16**n.level)]
        assert sorted(lines) == list(range(r.a, r.b + 1)) and len(r.n) <= 30 * 5


def test_chains(spark):
    """A, B, A has no major, a long chain its end, and what hangs on a missing group none."""
    links = [("a", "b"), ("b", "a"), ("hang", "a"), ("gone", "nowhere"), ("root", None), ("self", "self"), ("s", "self")] + [(f"c{i}", f"c{i - 1}" if i else "root") for i in range(40)]
    got = dict(map(tuple, recall.majors(spark.createDataFrame(links, "id string, group string")).collect()))
    assert got == {"root": "root", "self": "self", "s": "self"} | {f"c{i}": "root" for i in range(40)}
    assert recall.majors(spark.createDataFrame([], "id string, group string")).count() == 0


def test_enriched_lines(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("import x\n\n\nclass A:\n    def m(self):\n        return needle\n\n    b = needle\n")
    (root / "b.md").write_text("needle\n# Head\nneedle\n")
    (root / "c.txt").write_text("needle\n")
    space = Workspace(spark, str(root), str(tmp_path / "index"), no_ignore=True)
    space.index()
    (root / "d.txt").write_text("needle, not indexed\n")
    found = space.lines("rg needle", enrich=True)
    got = {(r.path, r.line): (r.symbol_name or r.heading, r.container_start, r.container_end) for r in found.collect()}
    assert got == {("a.py", 6): ("m", 5, 6), ("a.py", 8): ("A", 4, 8), ("b.md", 1): (None, None, None), ("b.md", 3): ("Head", 2, 4), ("c.txt", 1): (None, None, None), ("d.txt", 1): (None, None, None)}
    assert space.enrichment(found).first().asDict() == {"lines": 6, "files": 4, "enriched_lines": 3, "enriched_files": 2}
