"""The query code_entities on whole texts, against the chunker on each document."""

import duckdb
from conftest import same_rows

from lodestar.operators import chunking
from lodestar.plans import catalogue


def test_code_entities_whole_text(spark, tmp_path):
    texts = {1: "short \"text\"\nof two lines", 2: "\n".join(f"line {i} of a long text \\ here" for i in range(900)), 3: "word " * 3_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in texts.items():
        body = t.replace('"', " ").replace("\\", " ")
        source = f'class C{i}:\n    def m{i}(self):\n        """{body}"""\n        return 1\n'
        found = list(chunking.code_chunks(source, "python"))
        assert max(c["end"] for c in found) == 4 + t.count("\n")
        want += [(str(i), c["index"], c.get("group"), c.get("symbol_type"), c.get("symbol_name"), c.get("scope"), c["start"], c["end"]) for c in found]
    got = [tuple(r) for r in catalogue.queries()["code_entities"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(r[7] for r in got if r[0] == "2") == 903


def test_sources_too_deep_for_the_parser(spark, tmp_path):
    """A text that fills the parser's stack is cut like plain text, as one that doesn't parse, and no row is lost."""
    texts = {7: "la le " * 3_000, 14: "not " * 20_000 + "x", 28: "x" + ".y" * 50_000, 35: "one line\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(catalogue.queries()["entity_offsets"](spark, str(tmp_path)), duck.execute(catalogue.oracle_sql()["entity_offsets"]))
    for text in texts.values():
        assert chunking.python_symbols(text) is None or text == texts[35]
        assert [(c["start"], c["end"], c["content"]) for c in chunking.code_chunks(text, "python")] == list(chunking.text_chunks(text))


def test_definitions_among_deep_nodes():
    """Long sums and chains of elif nest deeper than calls may; the definitions of such a source are found, in order."""
    chain = "    if a:\n        pass\n" + "    elif a:\n        pass\n" * 1_500
    source = "x = " + " + ".join(["a"] * 1_500) + "\nclass K:\n  def f(self):\n" + chain + "    else:\n        def g(): pass\ndef h(): pass\n"
    last = source.count("\n")
    assert [(s["symbol_type"], s["symbol_name"], s["scope"], s["start"], s["end"]) for s in chunking.python_symbols(source)] == [
        ("class", "K", "", 2, last - 1), ("method", "f", "K", 3, last - 1), ("function", "g", "K::f", last - 1, last - 1), ("function", "h", "", last, last),
    ]
