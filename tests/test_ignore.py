"""Ignore rules as a table, against a rule by rule judgement of every path."""

import random
import re

from lodestar.sources import files


def brute(paths, sources):
    def verdict(entry, folder):
        out = False
        for home, content in sorted(sources, key=lambda s: (s[0].count("/") + bool(s[0]), s[0])):
            if not home or entry.startswith(home + "/"):
                for regex, negated, only_folders, _ in files.ignore_rules(home, content):
                    if (folder or not only_folders) and re.match(regex, entry):
                        out = not negated
        return out

    def gone(path):
        parts = path.split("/")
        return verdict(path, False) or any(verdict("/".join(parts[:n]), True) for n in range(1, len(parts)))

    return {p for p in paths if gone(p)}


def test_ignored(spark):
    rng = random.Random(3)
    names = ["a", "b.txt", "c.min.js", "build", "keep.md", ".env", "x.log", "log", "d"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)})
    lines = ["*.log", "build/", "/a", "!keep.md", "*.min.*", "a/b.txt", "**/d/*.md", "!/build/keep.md", "# note", "", "x.*", ".env", "[ab]", "log/", "!x.log", "c.min.js", "/", "*.js"]
    sources = [(home, "\n".join(rng.choice(lines) for _ in range(n))) for home, n in (("", 6), ("a", 4), ("build", 3), ("a/build", 3), ("d/a", 4))]
    for seed in range(3):
        rng.seed(seed)
        sources = [(home, "\r\n".join(rng.choice(lines) for _ in range(6))) for home, _ in sources]
        rules = files.rule_table(spark.createDataFrame(sources, "folder string, content string"))
        got = [r.path for r in files.ignored(spark.createDataFrame([(p,) for p in [*paths, *paths[:9]]], "path string"), rules).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(paths, sources)


def test_many_rules(spark):
    """Rules aren't gathered, and those of names are found by equality."""
    content = "\n".join(f"name{i}.txt" for i in range(50_000)) + "\n!name7.txt\n*.tmp\n"
    rules = files.rule_table(spark.createDataFrame([("", content)], "folder string, content string"))
    paths = [f"d/name{i}.txt" for i in range(0, 60_000, 10)] + ["name7.txt", "x.tmp"]
    gone = {r.path for r in files.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert gone == {p for p in paths if p != "name7.txt"} - {f"d/name{i}.txt" for i in range(50_000, 60_000, 10)}
    assert rules.where("name IS NULL").count() == 0
