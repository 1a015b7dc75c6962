"""Cutting texts into chunks: plain text by lines, Markdown by sections, code by definitions.

Where a chunk begins depends on where the one before ended, so chunks are made by Python generators within Arrow batches;
each row's text is cut for itself and nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .statements import statements, windows

SIZE, OVERLAP = 3600, 540
#: Rows of texts that are cut together.
FEW = 128
# What a cut after a sign is worth.
SIGNS = {**dict.fromkeys(".!?", 4), **dict.fromkeys(",;:", 3), **dict.fromkeys(" \t", 2), **dict.fromkeys("-/\\", 1)}
PLAIN_CHARS, DENSE_CHARS, DENSE_SHARE, DENSE_WINDOW = 1.85, 1.0, 0.3, 16384


def split_long(line: str, size: int) -> list[str]:
    """A line in parts of at most size characters, each cut in its last 30 % behind the best sign, the later of equals."""
    out = []
    while len(line) > size:
        low = max(1, size - int(size * 0.3))
        cut = max(range(low, size + 1), key=lambda i: (SIGNS.get(line[i - 1], 0), i))
        out.append(line[:cut])
        line = line[cut:]
    return [*out, line]


def _parts(text: str, size: int) -> list[tuple[int, int, int]]:
    """(line, start, end) of a text's lines, and of the parts of those that are longer than size; line ends are in none."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n"), 1):
        begun = at
        for part in split_long(line, size) if len(line) > size else [line]:
            out.append((n, begun, begun + len(part)))
            begun += len(part)
        at += len(line) + 1
    return out


def text_windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    """Windows of whole lines: first and last line, the text's characters from ``from`` up to ``to``, and these as content.
    The next window repeats the trailing lines that hold at least ``overlap`` characters, but always gets on; blank windows
    are left out."""
    lines = _parts(text, size)
    at = 0
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and (end == at or used + lines[end][2] - lines[end][1] + 1 <= size):
            used += lines[end][2] - lines[end][1] + 1
            end += 1
        first, last = lines[at][1], lines[end - 1][2]
        if text[first:last].strip():
            yield {"start": lines[at][0], "end": lines[end - 1][0], "content": text[first:last], "from": first, "to": last}
        if end >= len(lines):
            return
        back, held = end, 0
        while back > at + 1 and held < overlap:
            back -= 1
            held += lines[back][2] - lines[back][1] + 1
        at = max(at + 1, back if overlap else end)


def text_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content) of the windows of a text."""
    return ((w["start"], w["end"], w["content"]) for w in text_windows(text, size, overlap))


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def markdown_sections(text: str) -> list[dict]:
    """Sections by heading, aware of fences: heading, level, scope (the headings above), lines and content.  What stands
    before the first heading is a section without heading."""
    lines = text.split("\n")
    heads: list[tuple[int, int, int, str]] = []  # line, lines of the heading, level, title
    fence = None
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if mark:
            fence = mark[1]
            continue
        atx = _ATX.match(line)
        if atx:
            heads.append((i, 1, len(atx[1]), (atx[2] or "").strip()))
        elif i and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line) and lines[i - 1].strip() and not _ATX.match(lines[i - 1]) and not re.match(r"\s*([-*+>|]|\d+\.)", lines[i - 1]):
            if not heads or heads[-1][0] != i - 1:
                heads.append((i - 1, 2, 1 if "=" in line else 2, lines[i - 1].strip()))
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    bounds = [h[0] for h in heads] + [len(lines)]
    if any(line.strip() for line in lines[: bounds[0]]):
        out.append({"heading": None, "level": None, "scope": "", "start": 1, "end": bounds[0]} | _stripped(lines, 0, bounds[0], 0))
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines]))).tolist()
    for (line, _, level, title), end in zip(heads, bounds[1:]):
        stack = [s for s in stack if s[0] < level]
        out.append({"heading": title, "level": level, "scope": " > ".join(t for _, t in stack), "start": line + 1, "end": end} | _stripped(lines, line, end, begin[line]))
        stack.append((level, title))
    return out


def _stripped(lines: list[str], first: int, last: int, begin: int) -> dict:
    """Some lines as content, without the line ends around them, and where it stands."""
    whole = "\n".join(lines[first:last])
    content = whole.strip("\n")
    begin += len(whole) - len(whole.lstrip("\n")) if content else 0
    return {"content": content, "from": begin, "to": begin + len(content)}


#: What a break before a line of Markdown is worth.
_BREAKS = {"heading": 100, "blank": 60, "item": 35, "quote": 25, "other": 10}


def _worth(line: str, before: str) -> int:
    """What a break before a line of Markdown is worth."""
    if _ATX.match(line):
        return _BREAKS["heading"]
    if not before.strip():
        return _BREAKS["blank"]
    if re.match(r"\s*([-*+]|\d+\.)\s", line):
        return _BREAKS["item"]
    return _BREAKS["quote"] if line.lstrip().startswith(">") else _BREAKS["other"]


def section_windows(content: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """A section in windows (start, end), each ended at the best break of its last half; overlap stops before it is
    exceeded."""
    parts = _parts(content, size)
    lines = [content[a:b] for _, a, b in parts]
    out, at = [], 0
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and (end == at or used + len(lines[end]) + 1 <= size):
            used += len(lines[end]) + 1
            end += 1
        if end < len(lines):
            low = at + max(1, (end - at) // 2)
            end = max(range(low, end + 1), key=lambda i: (_worth(lines[i], lines[i - 1]) + (10 if i > 1 and not lines[i - 1].strip() and not lines[i - 2].strip() else 0), i)) if low < end else end
        out.append((parts[at][1], parts[end - 1][2]))
        back, held = end, 0
        while end < len(lines) and back - 1 > at and held + len(lines[back - 1]) + 1 <= min(overlap, size // 2):
            back -= 1
            held += len(lines[back]) + 1
        at = back if back > at else end
    return [(a, b) for a, b in out if content[a:b].strip()]


def markdown_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    """Sections, and of a section with several windows an outline (the major member of its group) and the windows."""
    n = 0
    for s in markdown_sections(text):
        windows = section_windows(s["content"], size, overlap)
        if len(windows) <= 1:
            yield s | {"index": n, "group": None}
            n += 1
            continue
        head = n
        texts = [s["content"][a:b] for a, b in windows]
        outline = "\n".join(x for x in [s["heading"] or "", *(w.strip().split("\n")[0][:160] for w in texts)] if x)
        yield s | {"index": n, "group": head, "content": outline, "made": True}
        for w, (a, b) in zip(texts, windows):
            n += 1
            yield s | {"index": n, "group": head, "content": w, "from": s["from"] + a, "to": s["from"] + b}
        n += 1


# How definitions begin in languages without a parser here, and what they define.
DEFINITIONS = {
    "rust": r"(?P<mods>(?:pub(?:\([^)]*\))?|async|unsafe|const|extern(?: \"[^\"]*\")?)\s+)*(?P<kind>fn|struct|enum|trait|mod|union|type|impl)\s+(?P<name>[\w:<>' ]+)",
    "go": r"(?P<kind>func|type)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)",
    "java": r"(?P<mods>(?:public|private|protected|static|final|abstract)\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)",
    "csharp": r"(?P<mods>(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?P<kind>class|interface|enum|struct|record|namespace)\s+(?P<name>[\w.]+)",
    "javascript": r"(?P<mods>(?:export|default|async)\s+)*(?P<kind>function|class)\s*\*?\s*(?P<name>\w+)",
    "typescript": r"(?P<mods>(?:export|default|async|abstract|declare)\s+)*(?P<kind>function|class|interface|enum|namespace|type)\s+(?P<name>\w+)",
    "c": r"(?P<mods>(?:static|inline|extern)\s+)*(?P<kind>struct|enum|union)\s+(?P<name>\w+)\s*\{",
    "cpp": r"(?P<mods>(?:static|inline|extern|virtual)\s+)*(?P<kind>class|struct|enum|namespace|union)\s+(?:class\s+)?(?P<name>\w+)",
    "vb": r"(?P<mods>(?:Public|Private|Protected|Friend|Shared)\s+)*(?P<kind>Class|Module|Sub|Function|Structure|Interface|Enum)\s+(?P<name>\w+)",
}
DEFINITIONS |= {"jsx": DEFINITIONS["javascript"], "tsx": DEFINITIONS["typescript"]}
# How functions and methods begin there, and words that never name one.
_TAIL = r"\s*\((?:[^;{}()]|\([^;{}()]*\))*(?:\)[^;{}=]*\{.*|\)[^;{}=]*)?$"
_TYPED = r"(?:@\w+(?:\([^)]*\))?\s+)*(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|async|override|virtual|sealed|partial|extern|unsafe|new)\s+)*)(?:<[^>]+>\s+)?(?P<ret>[\w.]+(?:<[^()]*>)?(?:\[\])*\??\s+)?(?P<name>\w+)(?:<[^()]*>)?"
FUNCTIONS = {
    "c": r"(?P<mods>(?:(?:static|inline|extern|const|unsigned|signed|struct|enum)\s+)*)(?P<ret>[A-Za-z_]\w*[\s*]+)(?P<name>[A-Za-z_]\w*)" + _TAIL,
    "cpp": r"(?:template\s*<[^>]*>\s*)?(?P<mods>(?:(?:static|inline|extern|virtual|constexpr|explicit|friend|const|unsigned)\s+)*)(?P<ret>[A-Za-z_][\w:<>,]*(?:\s*[*&]+\s*|\s+))?(?P<name>(?:\w+::)*~?[A-Za-z_]\w*)" + _TAIL,
    "java": _TYPED + _TAIL,
    "csharp": _TYPED + r"\s*\((?:[^;{}()]|\([^;{}()]*\))*(?:\)[^;{}=]*(?:\{.*|=>.*)?)?$",
    "javascript": r"(?P<mods>(?:export|default)\s+)*(?P<ret>const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^;]*\)\s*(?::[^=]+)?=>|\w+\s*=>).*$",
}
FUNCTIONS["typescript"] = FUNCTIONS["jsx"] = FUNCTIONS["tsx"] = FUNCTIONS["javascript"]
#: Methods of a class where functions have words of their own.
METHODS = dict.fromkeys(
    ("javascript", "typescript", "jsx", "tsx"),
    r"(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+|\*\s*)*)(?P<name>#?\w+)(?:<[^>]*>)?\s*\((?:[^;{}()]|\([^;{}()]*\)|\{[^}]*\})*\)\s*(?::\s*[^{;]+)?\{.*$",
)
CONTROL = frozenset("if for while switch return else do sizeof catch new throw case using lock foreach synchronized await yield typeof delete goto defined function super this assert try var let const".split())
SYMBOLS = {
    "function": "function", "fn": "function", "func": "function", "sub": "function", "class": "class", "struct": "class", "union": "class", "record": "class",
    "structure": "class", "enum": "enum", "interface": "interface", "trait": "interface", "module": "module", "mod": "module", "namespace": "module", "type": "type", "impl": "class",
}


def python_symbols(text: str) -> list[dict] | None:
    """Definitions of a Python source by its own parser; None if it isn't one, or is nested too deep for the parser."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser says so when its own stack is full
        return None
    lines, out = text.split("\n"), []
    ahead: list[tuple[ast.AST, ast.AST, list[str]]] = []  # a stack of our own, as chains of elif and sums nest deep

    def below(node: ast.AST, scope: list[str]) -> None:
        ahead.extend((child, node, scope) for child in reversed(list(ast.iter_child_nodes(node))))

    below(tree, [])
    while ahead:
        child, node, scope = ahead.pop()
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            cls = isinstance(child, ast.ClassDef)
            kind = "class" if cls else "method" if isinstance(node, ast.ClassDef) else "function"
            signature = " ".join(" ".join(lines[child.lineno - 1 : child.body[0].lineno - (child.body[0].lineno > child.lineno)]).split()).rstrip(":")
            mods = ["async"] if isinstance(child, ast.AsyncFunctionDef) else []
            out.append({"symbol_type": kind, "symbol_name": child.name, "scope": "::".join(scope), "signature": signature, "doc": ast.get_docstring(child),
                        "modifiers": mods, "start": start, "end": child.end_lineno or start, "content": "\n".join(lines[start - 1 : child.end_lineno])})
            below(child, [*scope, child.name])
        else:
            below(child, scope)
    return out


def brace_symbols(text: str, language: str) -> list[dict] | None:
    """Definitions of a language with braces, by how they begin and where their braces close.  A heuristic, not a parser."""
    pattern = DEFINITIONS.get(language)
    if not pattern:
        return None
    begin, lines, out = re.compile(r"^\s*" + pattern), text.split("\n"), []
    others = {k: re.compile(r"^\s*" + v[language]) for k, v in (("function", FUNCTIONS), ("method", METHODS)) if language in v}
    open_: list[tuple[str, int, str]] = []  # name, last line and kind of the definitions around
    for i, line in enumerate(lines):
        open_ = [o for o in open_ if o[1] >= i]
        found, inside = begin.match(line), open_[-1][2] if open_ else ""
        kind = SYMBOLS[found["kind"].lower()] if found else ""
        if not found and inside not in ("function", "method"):
            for kind, other in others.items():
                found = other.match(line) if kind == "function" or inside == "class" else None
                if found and not {found["name"], *(found.groupdict().get("ret") or "").split()[:1]} & (CONTROL - {"const", "let", "var"}):
                    break
                found = None
        first = i
        if language in ("c", "cpp") and i and inside not in ("function", "method") and (not found or not found.groupdict().get("ret") and not found.groupdict().get("kind")):
            # The type may stand on the line above.
            above = re.match(r"[A-Za-z_][\w\s*&:<>,]*$", lines[i - 1].rstrip())
            joined = others["function"].match(f"{lines[i - 1].rstrip()} {line.strip()}") if above and re.match(r"[A-Za-z_*&]", line) else None
            if joined and joined.groupdict().get("ret") and joined["name"] in line and not {joined["name"], joined["ret"].split()[0]} & CONTROL:
                found, kind, first = joined, "function", i - 1
        if not found:
            continue
        end, body = _end_of(lines, i, language, found.groupdict().get("kind"))
        arrow = "=>" in line
        if not found.groupdict().get("kind") and not body and not arrow:
            continue  # a declaration, or a call
        docs, k = [], first - 1
        while k >= 0 and re.match(r"\s*(///?|\*|/\*|'|#\[|@\w)", lines[k]):
            docs.append(re.sub(r"^\s*(///?!?|/\*\*?|\*/?|')\s?|\*/\s*$", "", lines[k]))
            k -= 1
        name = found["name"].split("<")[0].strip()
        around = [n for n, _, _ in open_]
        owner = re.match(r"\s*func\s+\(\s*\w*\s*\*?\s*(\w+)", line) if language == "go" else None
        if owner:
            kind, around = "method", [owner[1]]
        elif "::" in name and kind == "function":
            *owners, name = name.split("::")
            kind, around = "method", [*around, *owners]
        kind = "method" if kind == "function" and open_ and inside not in ("module", "") else kind
        signature = re.sub(r"\s*[{;]\s*$", "", " ".join(" ".join(lines[first : i + 1]).split()))
        before = line[: found.start("kind")] if found.groupdict().get("kind") else found.groupdict().get("mods") or ""
        mods = [m for m in re.findall(r"\w+", before) if m.lower() in ("pub", "public", "private", "protected", "internal", "static", "async", "const", "abstract", "export", "virtual", "inline", "final", "override")]
        out.append({"symbol_type": kind, "symbol_name": name, "scope": "::".join(around), "signature": signature, "doc": "\n".join(reversed(docs)) or None,
                    "modifiers": mods, "start": first + 1, "end": end + 1, "content": "\n".join(lines[first : end + 1])})
        open_.append((name, end, kind))
    return out


def _end_of(lines: list[str], start: int, language: str, kind: str | None) -> tuple[int, bool]:
    """(last line of what begins at a line, whether it has a body): where its braces close, or its statement ends."""
    depth, seen, end, commented = 0, False, start, False
    for j in range(start, len(lines)):
        plain = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|`(?:\\.|[^`\\])*`|/\*.*?\*/|//.*", "", lines[j])
        if commented:
            commented, plain = "*/" not in plain, plain.partition("*/")[2]
        if "/*" in plain:
            commented, plain = True, plain.partition("/*")[0]
        depth += plain.count("{") - plain.count("}")
        seen = seen or "{" in plain
        end = j
        if seen and depth <= 0 or not seen and plain.rstrip().endswith(";"):
            break
        if language == "vb" and j > start and re.match(rf"\s*End\s+{kind}\b", lines[j], re.I):
            return j, True
        if not seen and j > start and not plain.strip():
            break
    return end, seen


def script_blocks(text: str) -> list[tuple[int, str, str]]:
    """(first line, language, code) of the script elements of a component file."""
    out = []
    for m in re.finditer(r"<script\b([^>]*)>\n?(.*?)</script>", text, re.S | re.I):
        lang = re.search(r"lang\s*=\s*[\"']?(\w+)", m[1])
        language = {"ts": "typescript", "tsx": "tsx", "jsx": "jsx"}.get(lang[1].lower() if lang else "", "javascript")
        out.append((text.count("\n", 0, m.start(2)) + 1, language, m[2]))
    return out


# An outline's header in lines and characters, its members and calls, and the characters of a member.
HEADER_LINES, HEADER_CHARS, MEMBERS, CALLS, MEMBER_CHARS = 24, 1200, 32, 24, 180


def outline(symbol: dict, found: list[dict], size: int) -> str:
    """What stands for a definition that is too long: its head up to its block, then its members or what it calls."""
    lines = symbol["content"].split("\n")
    head = lines[: next((i + 1 for i, line in enumerate(lines[:HEADER_LINES]) if "{" in line), HEADER_LINES)]
    header = "\n".join(line.removesuffix("\r") for line in head).strip()
    out = [header[:HEADER_CHARS].rstrip() + "\n..." if len(header) > HEADER_CHARS else header or symbol["symbol_name"]]
    if symbol["symbol_type"] in ("class", "interface", "module"):
        members = [x for x in found if x is not symbol and x["scope"].split("::")[-1] == symbol["symbol_name"] and symbol["start"] <= x["start"] <= symbol["end"]][:MEMBERS]
        out += ["", "members:", *("- " + (x["signature"] or x["symbol_name"])[:MEMBER_CHARS] for x in members)] if members else []
    else:
        body = symbol["content"].removeprefix(lines[0])
        calls = [c for c in dict.fromkeys(re.findall(r"\b([A-Za-z_]\w*)\s*\(", body)) if c not in CONTROL][:CALLS]
        out += ["", "calls: " + ", ".join(calls)] if calls else []
    whole = "\n".join(out).strip()
    return whole if len(whole) <= size else "." * size if size <= 3 else whole[: size - 3].rstrip() + "..."


def code_chunks(text: str, language: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    """Definitions of a source, those beyond the size as an outline with windows of whole statements; a statement beyond the
    size is cut by lines, and these by characters.  A source without any definition is cut like plain text."""
    tongue = language
    if language in ("vue", "svelte"):
        found = [s | {"start": s["start"] + at - 1, "end": s["end"] + at - 1} for at, lang, code in script_blocks(text) for s in brace_symbols(code, lang) or []]
        tongue = "typescript"
    else:
        found = python_symbols(text) if language == "python" else brace_symbols(text, language)
    if not found:
        yield from (w | {"group": None, "index": i} for i, w in enumerate(text_windows(text, size, overlap)))
        return
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in text.split("\n")]))).tolist()
    n = 0
    for s in found:
        at = begin[s["start"] - 1]
        if text[at : at + len(s["content"])] != s["content"]:  # a script that doesn't begin with a line
            at = max(0, text.find(s["content"], at))
        s |= {"from": at, "to": at + len(s["content"])}
        if len(s["content"]) <= size:
            yield s | {"index": n, "group": None}
            n += 1
            continue
        yield s | {"index": n, "group": n, "content": outline(s, found, size), "made": True}
        head, body = n, s["content"]
        line = lambda p: s["start"] + body.count("\n", 0, p)  # noqa: E731, B023
        for a, b, whole in windows(body, statements(body, tongue), size, overlap):
            for w in [{"from": 0, "to": b - a}] if whole else text_windows(body[a:b], size, overlap):
                n += 1
                first, last = a + w["from"], a + w["to"]
                yield s | {"index": n, "group": head, "start": line(first), "end": line(max(first, last - 1)), "content": body[first:last], "from": at + first, "to": at + last}
        n += 1


ENTITY = "file_id string, index int, group int, start_line int, end_line int, heading string, level int, scope string, symbol_type string, symbol_name string, signature string, doc string, modifiers string, content string, start_char int, end_char int, start_byte int, end_byte int, failure string"


def byte_offsets(text: str) -> np.ndarray | None:
    """Bytes in UTF-8 before each character and behind the last; None where all are one byte."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000).astype(np.int64))))


def places(chunk: dict, offsets: np.ndarray | None) -> list[int | None]:
    """A chunk's first and last character and byte; nulls for what has no place."""
    if "from" not in chunk:
        return [None] * 4
    ends = [chunk["from"], chunk["to"]]
    return ends + (ends if offsets is None else [int(offsets[e]) for e in ends])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of FEW rows, so that what is made of long texts goes out before the next ones are cut."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            yield batch.slice(at, FEW)


def entities(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, images: bool = False) -> DataFrame:
    """Chunks of files (file_id, kind, format, text) by what they are; ENTITY is their schema.

    Offsets count the text's characters and its bytes in UTF-8; the content is what stands between them, but for an outline,
    which is made for what stands there.
    With a column budget, a file's chunks have no more characters than it says.  An image is one entity without text if the model takes images, and none otherwise.  A file that can't be cut is one
    row with the reason in failure and nothing else, so that it doesn't stop the others.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ENTITY)

    def cut(kind: str | None, format_: str | None, text: str, budget: int | None) -> list[dict]:
        most = size if budget is None else max(1, min(size, budget))
        back = min(overlap, most * overlap // size)
        if kind == "image":
            return [{"index": 0, "start": 0, "end": 0, "symbol_type": "image", "content": ""}] * images
        found: list[dict] = []
        if format_ == "markdown":
            found = list(markdown_chunks(text, most, back))
        elif kind == "code":
            found = list(code_chunks(text, format_, most, back))
        return found or [w | {"index": i} for i, w in enumerate(text_windows(text, most, back))]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = []
            for file_id, kind, format_, text, budget in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    found = cut(kind, format_, text or "", budget)
                except (ValueError, RecursionError, MemoryError, LookupError) as error:
                    rows.append([file_id, *[None] * 17, f"{type(error).__name__}: {error}"[:500]])
                    continue
                bytes_ = byte_offsets(text or "") if found else None
                for f in found:
                    said = [f.get(k) for k in ("heading", "level", "scope", "symbol_type", "symbol_name", "signature", "doc")]
                    rows.append([file_id, f["index"], f.get("group"), f["start"], f["end"], *said, " ".join(f.get("modifiers") or []) or None, f["content"], *places(f, bytes_), None])
            if rows:
                kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.int32(), *[pa.string()] * 7, *[pa.int32()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    budget = F.col("budget").cast("long") if "budget" in files.columns else F.lit(None).cast("long").alias("budget")
    return files.select("file_id", "kind", "format", "text", budget).mapInArrow(made, schema)


def chunk_texts(docs: DataFrame, cut: Callable[[str], list[list]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that cut makes of each text, with its id."""
    from pyspark.sql.types import StructType

    rows = docs.select(id_col, text_col)
    whole = StructType([rows.schema[id_col], *StructType.fromDDL(schema)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = [[i, *row] for i, t in zip(*[c.to_pylist() for c in batch.columns]) for row in cut(t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], whole.names).cast(_arrow(whole))

    return rows.mapInArrow(made, whole)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def dense_window(text: str) -> bool:
    """Whether any window of DENSE_WINDOW characters of a text at least so long is dense."""
    signs, place = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    odd = np.array([not (c.isalpha() or c in " \t\n\x0b\f\r") for c in map(chr, signs.tolist())], bool)[place]
    upto = np.concatenate(([0], np.cumsum(odd)))
    return bool((upto[DENSE_WINDOW:] - upto[:-DENSE_WINDOW]).max() >= DENSE_SHARE * DENSE_WINDOW)


def _dense_windows(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else dense_window(t) for t in texts.to_pylist()], pa.bool_())


def token_dense(text: Column) -> Column:
    """Whether 30 % or more of a text, or of any window of one longer than a window, are neither letters nor spaces: such
    text has more tokens."""
    size = F.char_length(text)
    odd = F.char_length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    long = F.arrow_udf(_dense_windows, BooleanType())(F.when(size > DENSE_WINDOW, text))
    return F.when(size > DENSE_WINDOW, long).otherwise((size > 0) & (odd >= DENSE_SHARE * size))


def chunk_budget(text: Column, tokens: int) -> Column:
    """Characters that a chunk of a text may have for a model's token limit."""
    return F.floor(tokens * F.when(token_dense(text), DENSE_CHARS).otherwise(PLAIN_CHARS)).cast("long")


def vector_text(header: Column, content: Column, budget: int) -> Column:
    """What is embedded: a header of a quarter of the budget at most, and the content."""
    most = max(3, budget // 4)
    short = F.when(F.char_length(header) > most, F.concat(F.substring(header, 1, most - 3), F.lit("..."))).otherwise(header)
    return F.substring(F.when(F.coalesce(F.char_length(header), F.lit(0)) == 0, content).otherwise(F.concat(short, F.lit("\n"), content)), 1, budget)
