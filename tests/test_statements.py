"""Statements against programs that are put together from known ones, windows against brute force, offsets of all chunkers."""

import random
import re

import pytest

from lodestar.operators import chunking
from lodestar.operators.statements import statements, windows

LINES = {
    "c": ["x = 1;", 'call("};{", \'}\');', "// a; comment }\n  y++;", "/* {\n */ z();", "if (a) { b(); } else { c(); }", "do { x; } while (y);", "for (;;) {\n    w();\n  }", "switch (x) { case 1: break; }", "int a[] = {1, 2};"],
    "javascript": ["const a = 1", "let f = () => {\n    g()\n  }", "x\n    .y()\n    .z()", "call(\n    1,\n    2)", "const s = `}\n${a}`", "if (a) {\n    b()\n  }\n  else {\n    c()\n  }", "a = b +\n    c", "try { x() } catch (e) { y() }", "m = {\n    k: 1,\n  }"],
    "rust": ["let x: &'a str = \"}\";", "let c = '{';", "if a { b() } else { c() }", "match x { A => 1, B => { 2 } }", "v.iter()\n    .map(|x| { x })\n    .sum();"],
    "go": ["x := 1", "if a {\n    b()\n  } else {\n    c()\n  }", "s := `}`", "f(\n    1,\n  )", "for i := 0; i < 3; i++ {\n    g(i)\n  }"],
    "python": ["x = 1", "if a:\n        b()\n    else:\n        c()", 'y = """\n    text: {\n    """', "z = [1,\n    2]", "# note\n    w = 'it''s: #'", "@deco\n    class K:\n        pass", "v = f(a,\n  b)", "u = 1 + \\\n    2", "try:\n        a\n    except E:\n        b\n    finally:\n        c"],
}


@pytest.mark.parametrize("language", sorted(LINES))
def test_statements(language):
    """Every statement of a program is one span, the head with the first and the end with the last."""
    rng = random.Random(language)
    for _ in range(60):
        own = [rng.choice(LINES[language]) for _ in range(rng.randrange(1, 9))]
        head, end = {"python": ("def f(a,\n        b):\n", ""), "go": ("func f(a int) int {\n", "\n}"), "javascript": ("function f(a) {\n", "\n}"), "rust": ("fn f<'a>(a: &'a str) -> u8 {\n", "\n}"), "c": ("int f(int a) {\n", "\n}")}[language]
        text = head + "\n".join("    " + s if language == "python" else "  " + s for s in own) + end
        got = [text[a:b] for a, b in statements(text, language)]
        want = [s.strip() for s in own]
        want[0], want[-1] = head + ("    " if language == "python" else "  ") + want[0], want[-1] + end if len(want) > 1 else want[-1]
        if len(own) == 1:
            want = [text]
        tidy = lambda x: [" ".join(p.split()) for p in x]
        assert tidy(got) == tidy(want), text


def test_a_comment_goes_with_what_it_stands_before():
    text = "def f():\n    a = 1\n    # about b\n    b = 2\n"
    spans = statements(text, "python")
    assert [text[a:b] for a, b in spans] == ["def f():\n    a = 1", "# about b\n    b = 2\n"]


@pytest.mark.parametrize("seed", range(20))
def test_windows(seed):
    """No statement that fits is cut, none is lost, runs fit, and what is carried over fits and is no more than the overlap."""
    rng = random.Random(seed)
    at, spans = 0, []
    for _ in range(rng.randrange(1, 40)):
        size = rng.choice([3, 10, 20, 70])
        spans.append((at, at + size))
        at += size + 1
    size, overlap = 50, rng.choice([0, 12, 30])
    got = list(windows("x" * at, spans, size, overlap))
    starts, ends = {a for a, _ in spans}, {b for _, b in spans}
    covered = set()
    for a, b, whole in got:
        assert a in starts and b in ends and (b - a <= size) == whole
        covered |= {s for s in spans if a <= s[0] and s[1] <= b}
    assert covered == set(spans)
    for (_, b, _), (a, _, _) in zip(got, got[1:]):
        assert b - a <= overlap
    for (a, b, whole), (c, d, _) in zip(got, got[1:]):  # a run ends because what follows doesn't fit
        following = next(s for s in spans if s[0] > b)
        assert not whole or following[1] - a > size
    if all(b - a <= size for a, b in spans) and not overlap:
        n, k = 0, 0
        while k < len(spans):  # brute force: fill each run as far as it goes
            first = spans[k][0]
            while k < len(spans) and spans[k][1] - first <= size:
                k += 1
            n += 1
        assert len(got) == n


SOURCES = {
    "python": ("code", "import os\n\n\nclass Größe:\n    \"\"\"한글\"\"\"\n\n    def m(self):\n" + "".join(f"        é{i} = call{i}('x{i}')\n" for i in range(60)) + "\n\ndef g():\n    return 1\n"),
    "c": ("code", "static int\nf(int a)\n{\n" + "".join(f'  g{i}("é{i}");\n' for i in range(60)) + "}\n"),
    "markdown": ("text", "\n\nvorher é\n# A\n" + "wörter\n\n" * 80 + "## B 한\n- x\n"),
    "text": ("text", "é" * 700 + "\n" + "line of words\n" * 50),
    "vue": ("code", "<template>é</template>\n<script>\nfunction f() {\n" + "".join(f"  g{i}()\n" for i in range(60)) + "}\n</script>"),
}


def test_offsets(spark):
    """The bytes and characters of every entity are its content."""
    rows = [(k, kind, k, text) for k, (kind, text) in SOURCES.items()] + [("none", "text", "text", None), ("empty", "text", "text", "")]
    df = spark.createDataFrame([("file-" + f, k, f, t) for f, k, _, t in rows], "file_id string, kind string, format string, text string")
    df = df.selectExpr("file_id", "kind", "substring(file_id, 6) AS format", "text")
    got = chunking.entities(df, 300, 40).collect()
    texts = {"file-" + f: t for f, _, _, t in rows}
    assert {r.file_id for r in got} == {"file-" + k for k in SOURCES}
    for r in got:
        if r.group != r["index"]:
            text = texts[r.file_id]
            assert text[r.start_char : r.end_char] == r.content == text.encode()[r.start_byte : r.end_byte].decode()
            assert text.count("\n", 0, r.start_char) + 1 == r.start_line or r.file_id == "file-markdown"
    for k in ("python", "c", "vue"):
        mine = [r for r in got if r.file_id == "file-" + k and r.group is not None and r.group != r["index"]]
        assert len(mine) > 1 and all(len(r.content) <= 300 for r in mine)
        ends = {"python": r"[)\"]$", "c": r"[;}]\n?$", "vue": r"[)}]\n?$"}[k]
        assert all(re.search(ends, r.content.rstrip()) for r in mine)  # windows end with statements
    head = next(r for r in got if r.file_id == "file-python" and r.symbol_name == "Größe")
    assert head.content.startswith("class Größe:") and len(head.content) <= 300


def test_outline():
    big = "\n".join(f"  void m{i}() {{ n{i}(); }}" for i in range(50))
    found = list(chunking.code_chunks("class A {\n" + big + "\n}", "java", 900, 0))
    head = found[0]["content"]
    assert head.startswith("class A {\n\nmembers:\n- void m0()") and len(head) <= 900
    body = "void f() {\n" + "\n".join(f"  call{i}(x);" for i in range(90)) + "\n}"
    head = next(iter(chunking.code_chunks(body, "c", 600, 0)))["content"]
    assert head.startswith("void f() {\n\ncalls: call0, call1") and head.count("call") <= 26
