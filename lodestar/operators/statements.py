"""Statements of a source, by a lexer of brackets, quotes and comments in one pass, and windows of whole statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Languages whose statements end with their line unless it goes on, those by indentation, and those whose # is no comment.
BY_LINE = frozenset("javascript typescript jsx tsx go swift kotlin scala".split())
BY_INDENT = frozenset(["python"])
HASH = frozenset("python ruby bash php".split())
#: What goes on with the block before it, and what a line that goes on begins or ends with.
_AFTER_BLOCK = re.compile(r"\s*(?:(?:else|catch|finally)\b|[;,.?:)\]=&|])")
_GOES_ON = re.compile(r"\s*(?:(?:else|catch|finally)\b|(?!//|/\*|\+\+|--|<-)[,.?:)\]=&|+*/%<>-])")
_OPEN_END = re.compile(r"(?<!\+)\+$|(?<!-)-$|[,.(\[{=*/%&|<>?:!~^]$|\b(?:return|new|in|of)$")


def _skipped(text: str, at: int, language: str) -> int:
    """Where a comment or a quoted string that starts here ends; ``at`` if none does."""
    two, one = text[at : at + 2], text[at]
    if two == "//" and language not in BY_INDENT or one == "#" and language in HASH or one == "'" and language == "vb":
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if two == "/*":
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    if text[at : at + 3] in ('"""', "'''") and language in ("python", "scala", "kotlin", "java", "csharp", "swift"):
        end = text.find(text[at : at + 3], at + 3)
        return len(text) if end < 0 else end + 3
    if one in "\"'`":
        if one == "'" and language == "rust" and not re.match(r"'(?:\\.[^']*|[^'\\])'", text[at:at + 12]):
            return at  # a lifetime
        if one == "`" and language not in BY_LINE:
            return at
        k = at + 1
        while k < len(text) and text[k] != one:
            if text[k] == "\n" and one != "`":
                return at + 1  # a quote that its line doesn't close is a sign like others
            k += 2 if text[k] == "\\" and not (one == "`" and language == "go") else 1
        return min(len(text), k + 1)
    return at


def statements(text: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of the statements in the body of a definition, in characters.

    They follow one another without a gap but white space: what stands before a statement, such as a comment, belongs to it,
    the definition's head to the first one and its end to the last.  A text without a body is one statement.
    """
    cuts = _indented(text) if language in BY_INDENT else _braced(text, language)
    out, at = [], 0
    for cut in [*cuts, len(text)]:
        piece = text[at:cut]
        if piece.strip():
            start = at + len(piece) - len(piece.lstrip()) if out else at
            out.append((start, at + len(piece.rstrip()) if cut < len(text) else cut))
            at = cut
    if len(out) > 1 and re.fullmatch(r"[\s})\];,]*", text[out[-1][0] : out[-1][1]]):
        out[-2:] = [(out[-2][0], out[-1][1])]  # the end of the body
    return out


def _braced(text: str, language: str) -> Iterator[int]:
    """Ends of statements right inside the first block."""
    stack: list[str] = []
    at, body, some, doing = 0, False, False, False
    while at < len(text):
        after = _skipped(text, at, language)
        if after > at:
            some = some or text[at] in "\"'`"
            at = after
            continue
        c = text[at]
        at += 1
        some = some or not c.isspace()
        ends = False
        if c in "([{":
            if stack == ["{"]:
                doing = re.search(r"\bdo\s*$", text[max(0, at - 20) : at - 1]) is not None
            stack.append(c)
            if not body and stack == ["{"]:
                body, some = True, False
        elif c in ")]}":
            if stack:
                stack.pop()
            if body and not stack:
                return
            if c == "}" and body and stack == ["{"]:
                ends = not _AFTER_BLOCK.match(text, at) and not (doing and re.match(r"\s*while\b", text[at : at + 200]))
                ends = ends and (language not in BY_LINE or _line_ends(text, at, block=True))
        elif body and stack == ["{"]:
            # A loop's head has semicolons without brackets around it in Go, where lines end statements.
            ends = c == ";" and language != "go" or c == "\n" and language in BY_LINE and some and _line_ends(text, at)
        if ends:
            yield at
            some = False


def _line_ends(text: str, at: int, block: bool = False) -> bool:
    """Whether a statement ends with the line before this place, or the block: neither it nor what follows goes on."""
    if block:
        return not _GOES_ON.match(text, at)
    last = text[text.rfind("\n", 0, at - 1) + 1 : at - 1].partition("//")[0].rstrip()
    return bool(last) and not _OPEN_END.search(last) and not _GOES_ON.match(text, at)


def _indented(text: str) -> Iterator[int]:
    """Starts of the second and later statements of an indented block: lines as far in as its first, outside brackets.  What
    is said about a statement before it, and its decorators, begin it."""
    depth, at, indent, head = 0, 0, None, True
    start_of_line, before, decorated = True, None, True
    while at < len(text):
        if start_of_line and depth == 0:
            line = text[at : (text.find("\n", at) + 1 or len(text) + 1) - 1]
            bare = line.strip()
            far = len(line) - len(line.lstrip())
            if bare.startswith("#"):
                before = at if before is None and far == indent else before
            elif bare:
                if not head and indent is None:
                    indent, decorated = far, bare.startswith("@")
                elif indent is not None and far == indent and not re.match(r"(?:else|elif|except|finally)\b", bare):
                    if not decorated:
                        yield at if before is None else before
                    decorated = bare.startswith("@")
                before = None
        start_of_line = False
        after = _skipped(text, at, "python")
        if after > at:
            at = after
            continue
        c = text[at]
        at += 1
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "\n":
            start_of_line = not text.endswith("\\\n", 0, at)
        elif c == ":" and depth == 0 and head and re.match(r"[ \t]*(?:#[^\n]*)?\n", text[at : at + 400]):
            head = False


def windows(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of runs of whole statements of no more than size characters; a longer statement is a run of its
    own that isn't whole.  The next run carries the last statements that hold ``overlap`` characters, as far as they fit."""
    at = 0
    while at < len(spans):
        start, end = spans[at]
        if end - start > size:
            yield start, end, False
            at += 1
            continue
        last = at
        while last + 1 < len(spans) and spans[last + 1][1] - start <= size:
            last += 1
        yield start, spans[last][1], True
        if last + 1 == len(spans):
            return
        back, until = last + 1, spans[last + 1][1]
        fits = spans[last + 1][1] - spans[last + 1][0] <= size
        while fits and back - 1 > at and spans[last][1] - spans[back - 1][0] <= max(overlap, 0) and until - spans[back - 1][0] <= size:
            back -= 1
        at = back
