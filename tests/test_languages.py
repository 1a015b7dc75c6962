"""Definitions of languages without a parser: functions, methods and what only looks like them."""

import pytest

from lodestar.operators import chunking

CASES = {
    "c": (
        "static int add(int a, int b)\n{\n  if (a) { return b; }\n  foo(a);\n  return a + b;\n}\nint declared(int x);\nvoid *get(void) {\n  for (;;) { }\n}\nstruct point {\n int x;\n};\n",
        [("function", "add", "", 1, 6), ("function", "get", "", 8, 10), ("class", "point", "", 11, 13)],
    ),
    "cpp": (
        "namespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x) {}\n  virtual ~A() {}\n  int get() const { return x_; }\n  void declared();\n};\n}\nint A::size(const std::vector<int>& v) {\n  while (true) { }\n}\n"
        "template <typename T> T most(T a, T b) {\n  return a;\n}\n",
        [("module", "n", "", 1, 9), ("class", "A", "n", 2, 8), ("method", "A", "n::A", 4, 4), ("method", "~A", "n::A", 5, 5), ("method", "get", "n::A", 6, 6), ("method", "size", "A", 10, 12), ("function", "most", "", 13, 15)],
    ),
    "java": (
        'public class Foo {\n  private int x;\n  public Foo(int x) {\n    this.x = x;\n  }\n  @Override\n  public String toString() {\n    if (x > 1) {\n      return "a{";\n    }\n    return null;\n  }\n  static <T> List<T> of(T a) { return null; }\n  abstract void none();\n}\n',
        [("class", "Foo", "", 1, 15), ("method", "Foo", "Foo", 3, 5), ("method", "toString", "Foo", 7, 12), ("method", "of", "Foo", 13, 13)],
    ),
    "csharp": (
        "namespace N {\n public class P {\n  public async Task<int> Run(string a)\n  {\n    return 1;\n  }\n  public int Two() => 2;\n  int f;\n }\n}\n",
        [("module", "N", "", 1, 10), ("class", "P", "N", 2, 9), ("method", "Run", "N::P", 3, 6), ("method", "Two", "N::P", 7, 7)],
    ),
    "javascript": (
        "export const add = (a, b) => a + b;\nconst go = async (x) => {\n  return x;\n};\nfunction top() {\n  const inner = () => 1;\n}\nexport default class K {\n  constructor(a) {\n    this.a = a;\n  }\n  async load(x, { y }) {\n    if (x) { y(); }\n  }\n}\n",
        [("function", "add", "", 1, 1), ("function", "go", "", 2, 4), ("function", "top", "", 5, 7), ("class", "K", "", 8, 15), ("method", "constructor", "K", 9, 11), ("method", "load", "K", 12, 14)],
    ),
    "typescript": (
        "interface I { a: string }\nexport class S<T> {\n  private run(a: number): Promise<void> {\n  }\n}\nexport const f = (a: number): number => {\n return a;\n}\n",
        [("interface", "I", "", 1, 1), ("class", "S", "", 2, 5), ("method", "run", "S", 3, 4), ("function", "f", "", 6, 8)],
    ),
    "go": (
        "func Add(a int) int {\n return a\n}\nfunc (s *Store) Get(k string) string {\n return k\n}\ntype T struct {\n}\n",
        [("function", "Add", "", 1, 3), ("method", "Get", "Store", 4, 6), ("type", "T", "", 7, 8)],
    ),
    "rust": ("impl Foo {\n    pub fn new() -> Self {\n    }\n}\nfn main() {\n}\n", [("class", "Foo", "", 1, 4), ("method", "new", "Foo", 2, 3), ("function", "main", "", 5, 6)]),
}


@pytest.mark.parametrize("language", CASES)
def test_definitions(language):
    text, want = CASES[language]
    found = chunking.brace_symbols(text, language)
    assert [(s["symbol_type"], s["symbol_name"], s["scope"], s["start"], s["end"]) for s in found] == want


def test_modifiers_and_comments():
    found = chunking.brace_symbols("/** Adds.\n * Both. */\npublic class A {\n  /* { */\n  public static int add(int a) { // {\n    return a;\n  }\n}\n", "java")
    assert [s["modifiers"] for s in found] == [["public"], ["public", "static"]] and found[0]["end"] == 8
    assert found[0]["doc"].startswith("Adds.")


def test_c_functions_whose_type_stands_above():
    source = "/* Counts. */\nstatic const char *\nname(void)\n{\n  return 0;\n}\n\nint\nmain(int argc, char **argv)\n{\n  if (argc)\n    run(argv);\n  return 0;\n}\nint x;\nvoid g(void) { h(); }\n"
    found = chunking.brace_symbols(source, "c")
    assert [(f["symbol_name"], f["start"], f["end"], f["symbol_type"]) for f in found] == [("name", 2, 6, "function"), ("main", 8, 14, "function"), ("g", 16, 16, "function")]
    assert found[0]["signature"] == "static const char * name(void)" and found[0]["modifiers"] == ["static", "const"] and found[0]["doc"]
