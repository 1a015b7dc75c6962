import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import chunking, embed, fusion, index
from lodestar.sources import files as S


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("*.rs", "a/b.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**/*.rs", "src/b.rs", True), ("src/**/*.rs", "src/x/y/b.rs", True), ("src/**", "src", True),
        ("src/**", "src/a/b", True), ("src/**", "srcs", False), ("?.txt", "d/a.txt", True), ("[!a].txt", "a.txt", False), ("{a,b{c,d}}.md", "bd.md", True), ("{a,b{c,d}}.md", "b.md", False),
        ("a/b?.c", "a/b/.c", False),
    ],
)
def test_glob(glob, path, want):
    assert bool(re.search(X.glob_regex(glob), path)) is want


def test_line_regex():
    assert X.line_regex(["a.b"], fixed=True) == r"(?:a\.b)"
    assert X.line_regex(["ab"], smart_case=True).startswith("(?iu)") and not X.line_regex(["aB"], smart_case=True).startswith("(?iu)")
    with pytest.raises(ValueError):
        X.line_regex(["(?=a)"])
    with pytest.raises(ValueError):
        X.line_regex([])


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 80), st.integers(0, 10))
@settings(max_examples=60, deadline=None)
def test_text_chunks_cover(text, size, overlap):
    chunks = list(chunking.text_chunks(text, size, overlap))
    assert all(len(c) <= size for _, _, c in chunks)
    covered = {n for a, b, _ in chunks for n in range(a, b + 1)}
    assert {n for n, line in enumerate(text.split("\n"), 1) if line.strip()} <= covered


def test_markdown():
    text = "intro\n# A\ntext\n```\n# no heading\n```\nB\n=\nmore\n## C\nx"
    got = [(s["heading"], s["level"], s["scope"]) for s in chunking.markdown_sections(text)]
    assert got == [(None, None, ""), ("A", 1, ""), ("B", 1, ""), ("C", 2, "B")]
    big = list(chunking.markdown_chunks("# A\n" + "word " * 40 + "\n\n" + "more " * 40, 150, 20))
    assert big[0]["group"] == big[0]["index"] == 0 and all(c["group"] == 0 for c in big) and len(big) > 2


def test_code():
    py = list(chunking.code_chunks('class A:\n    """doc"""\n    async def f(self, x):\n        return g(x)\n', "python"))
    assert [(c["symbol_type"], c["symbol_name"], c["scope"]) for c in py] == [("class", "A", ""), ("method", "f", "A")] and py[0]["doc"] == "doc"
    rs = list(chunking.code_chunks("/// adds\npub fn add(a: i32) -> i32 {\n  a + 1\n}\nmod m {\n  fn inner() {}\n}\n", "rust"))
    assert [(c["symbol_name"], c["scope"], c["start"], c["end"]) for c in rs] == [("add", "", 2, 4), ("m", "", 5, 7), ("inner", "m", 6, 6)] and rs[0]["doc"] == "adds"
    vue = list(chunking.code_chunks("<template/>\n<script lang=\"ts\">\nfunction f() {\n}\n</script>", "vue"))
    assert (vue[0]["symbol_name"], vue[0]["start"]) == ("f", 3)


def test_embeddings(spark):
    v = embed.stub_vector("hello")
    assert len(v) == 64 and (v == embed.stub_vector("hello")).all()
    table = embed.StaticTable(np.eye(3, dtype=np.float32), lambda t: [ord(c) - 97 for c in t])
    assert not table("").any() and np.allclose(table("ab"), [2**-0.5, 2**-0.5, 0])
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r["v"] is None for r in embed.embed(df, "t", embed.stub_vector, 64, "v").collect()] == [False, True]


@given(st.integers(0, 500), st.none() | st.integers(1, 200))
def test_group_limit(groups, asked):
    """What is asked for holds; few groups have the same limit, many share what all of them may have, rounded up."""
    got = fusion.group_limit(asked, groups)
    if asked is not None:
        assert got == asked
    elif groups <= 3:
        assert got == fusion.PER_GROUP
    else:
        assert got >= 1 and got * groups >= fusion.ALL_GROUPS and (got - 1) * groups < fusion.ALL_GROUPS


def test_scan(spark, tmp_path):
    for name, text in {"a.txt": "hello world\n", "src/b.rs": "fn b() {}\n", "src/.hidden": "x", "node_modules/x.js": "x", ".git/HEAD": "x", "inner/.git/HEAD": "x", "inner/c.txt": "c",
                       "skip.log": "x", ".gitignore": "*.log\n", "empty.md": "", "bin.dat": "a\0b", "pic.zip": "zz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r["relative_path"]: r["reason"] for r in S.scan(spark, str(tmp_path), "ws").collect()}
    assert found == {"a.txt": None, "src/b.rs": None, "empty.md": "empty", "bin.dat": "binary", "pic.zip": "unsupported"}
    assert {r["relative_path"] for r in S.scan(spark, str(tmp_path), "ws", globs=["*.rs"], max_depth=2).collect()} == {"src/b.rs"}


def test_snapshots(spark, tmp_path):
    store = index.Snapshots(spark, str(tmp_path / "ix"))
    with pytest.raises(ValueError):
        store.read("files")
    store.write({"model": "stub"}, files=spark.range(3))
    store.write({"model": "stub"}, files=spark.range(5))
    assert store.read("files").count() == 5
    with pytest.raises(ValueError):
        store.write({"model": "other"}, files=spark.range(1))
    assert store.drop() and not store.drop()


def test_mark_failed(spark):
    files = spark.createDataFrame([("a", 1, 1, "h", None, 3), ("b", 1, 1, "h", None, 2)], "file_id string, size_bytes long, last_modified long, content_hash string, error string, entity_count long")
    failed = spark.createDataFrame([("a", "bad", 2, 1)], "file_id string, failure string, size_bytes long, last_modified long")
    got = {r["file_id"]: (r["content_hash"], r["error"], r["entity_count"]) for r in index.mark_failed(files, failed).collect()}
    assert got == {"a": (None, "bad", 0), "b": ("h", None, 2)}


def test_streamed_changes(spark, tmp_path):
    from lodestar.streaming import changes

    rows = [(1, "2024-01-01 00:00:00", "a", "created"), (2, "2024-01-01 00:00:01", "a", "deleted"), (3, "2024-01-01 00:00:02", "b", "changed")]
    df = spark.createDataFrame(rows, "event_id long, t string, path string, kind string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "path", "kind")
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    apply = lambda batch, _: seen.update({r["path"]: r["kind"] for r in changes.coalesce_changes(batch, ["path"]).collect()})
    changes.apply_changes(stream, apply, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == {"a": "deleted", "b": "changed"}


def test_scalar_functions(spark):
    row = spark.sql("SELECT 'a\\\\b//c/' AS p, ' x \n y ' AS w, '😀 needle' AS u").select(
        X.normal_path(F.col("p")), X.one_line(F.col("w")), X.utf16_length(F.substring("u", 1, 2)), X.fit_chars(F.lit("abcdefgh"), 6)
    ).first()
    assert list(row) == ["a/b/c", "x y", 3, "abc..."]
