"""Values that people type: sizes, times and line-search commands."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field
from datetime import datetime, timezone, tzinfo
from fractions import Fraction

_SIZE = re.compile(r"(\d*)(?:\.(\d*))?\s*([^\W\d_]*)")
_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3}


def byte_size(value: str) -> int:
    """Bytes of ``512``, ``1.5m`` or ``10 KB``; units are powers of 1024 and parts of a byte are cut off."""
    found = _SIZE.fullmatch(value.strip())
    if not found or not (found[1] or found[2]) or found[3].lower() not in _UNITS:
        raise ValueError(f"not a size: {value!r}")
    return int(Fraction(f"{found[1] or 0}.{found[2] or 0}") * 1024 ** _UNITS[found[3].lower()])


def modified_time(value: str, zone: tzinfo | None = None) -> int:
    """Milliseconds since 1970 of a number of them, a date, or a date and time; without an offset it is in zone, by
    default the local one."""
    text = value.strip()
    if re.fullmatch(r"[0-9]+", text):
        return int(text)
    if not re.fullmatch(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?", text):
        raise ValueError(f"not a time: {value!r}")
    moment = datetime.fromisoformat(text.upper())
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=zone) if zone else moment.astimezone()
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1000 + since.microseconds // 1000


@dataclass
class LineSearch:
    """A line search as options of ``functions.text.line_regex`` and of the search itself."""

    patterns: list[str] = field(default_factory=list)
    #: Files of patterns, a line each, that the search reads.
    pattern_files: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    options: dict[str, bool] = field(default_factory=dict)
    globs: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    before: int = 0
    after: int = 0
    max_count: int | None = None
    limit: int | None = None
    hidden: bool = False
    no_ignore: bool = False


_SWITCHES = {"-i": "ignore_case", "--ignore-case": "ignore_case", "-w": "word", "--word-regexp": "word", "-F": "fixed", "--fixed-strings": "fixed",
             "-S": "smart_case", "--smart-case": "smart_case", "-x": "whole_line", "--line-regexp": "whole_line"}
_TAKES = {"-e": "e", "--regexp": "e", "-g": "g", "--glob": "g", "-t": "t", "--type": "t", "-A": "A", "--after-context": "A", "-B": "B",
          "--before-context": "B", "-C": "C", "--context": "C", "-m": "m", "--max-count": "m", "-f": "f", "--file": "f"}
_IGNORED = {"-n", "--line-number", "-H", "--with-filename", "--no-heading", "--heading", "--color=never"}


def line_search(command: str) -> LineSearch:
    """A line-search command as typed, perhaps with ``| head -n N`` behind it.  Anything that a shell would expand,
    redirect or chain is refused, and so are options that aren't known."""
    lexer = shlex.shlex(command, posix=True, punctuation_chars="|;&<>()")
    lexer.whitespace_split, lexer.commenters = True, ""
    if re.search(r"[$`]", re.sub(r"'[^']*'|\\.", "", command)):
        raise ValueError("expansions can't be used")
    words = list(lexer)
    out = LineSearch()
    if "|" in words:
        at = words.index("|")
        tail, words = words[at + 1 :], words[:at]
        found = re.fullmatch(r"head(?: (?:-n ?|-)(\d+))?", " ".join(tail))
        if not found:
            raise ValueError("only head may follow")
        out.limit = int(found[1] or 10)
    if any(re.fullmatch(r"[|;&<>()]+", w) for w in words):
        raise ValueError("commands can't be chained or redirected")
    words = words[1:] if words and words[0] in ("rg", "grep") else words
    free, rest, given = [], iter(_apart(words)), False
    for word in rest:
        if word == "--":
            free += list(rest)
        elif word in _SWITCHES:
            out.options[_SWITCHES[word]] = True
        elif word == "--hidden":
            out.hidden = True
        elif word == "--no-ignore":
            out.no_ignore = True
        elif word in _TAKES:
            value = next(rest, None)
            if value is None:
                raise ValueError(f"{word} needs a value")
            kind = _TAKES[word]
            if kind == "e":
                out.patterns.append(value)
                given = True
            elif kind == "f":
                out.pattern_files.append(value)
                given = True
            elif kind in "gt":
                (out.globs if kind == "g" else out.types).append(value)
            elif kind == "m":
                out.max_count = int(value)
            else:
                out.before = int(value) if kind in "BC" else out.before
                out.after = int(value) if kind in "AC" else out.after
        elif word in _IGNORED:
            pass
        elif word.startswith("-") and len(word) > 1:
            raise ValueError(f"unknown option {word}")
        else:
            free.append(word)
    if not given:
        if not free:
            raise ValueError("there is no pattern")
        out.patterns.append(free.pop(0))
    out.paths = free
    return out


def _apart(words: list[str]) -> list[str]:
    """Words with joined options apart: ``-iA2`` is ``-i -A 2`` and ``--glob=x`` is ``--glob x``."""
    out: list[str] = []
    for n, word in enumerate(words):
        if word == "--":
            return out + words[n:]
        name, equals, value = word.partition("=")
        if out and out[-1] in _TAKES and (len(out) < 2 or out[-2] not in _TAKES):
            out.append(word)
        elif equals and name in _TAKES and name.startswith("--"):
            out += [name, value]
        elif re.match(r"-[A-Za-z]{1}.", word) and not word.startswith("--"):
            at = 1
            while at < len(word):
                out.append("-" + word[at])
                at += 1
                if out[-1] in _TAKES and at < len(word):
                    out.append(word[at:])
                    break
        else:
            out.append(word)
    return out
