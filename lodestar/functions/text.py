"""Column functions on text and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the full-text index: letters, digits and underscores, lower-cased.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query in order of appearance."""
    return list(dict.fromkeys(re.findall(r"[^\W]+", query.lower())))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fit_chars(text: Column, most: int) -> Column:
    """text, or its beginning with an ellipsis, in at most ``most`` characters."""
    cut = F.concat(F.rtrim(F.substring(text, 1, max(0, most - 3))), F.lit("..."))
    return F.when(F.char_length(text) > most, cut).otherwise(text)


def valid_utf8(data: Column) -> Column:
    """Bytes as text, malformed sequences replaced."""
    return F.make_valid_utf8(data.cast("string"))


def hash_id(*parts: Column | str) -> Column:
    """SHA-256 in hex of parts that are joined by a zero character."""
    return F.sha2(F.concat_ws("\0", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def normal_path(path: Column) -> Column:
    """Forward slashes, none repeated, none at the end."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.when(clean == "/", clean).otherwise(F.regexp_replace(clean, "/$", ""))


def normal_pattern(pattern: str) -> str:
    clean = re.sub("/+", "/", pattern.strip().replace("\\", "/"))
    return clean.removeprefix("./")


def _braces(glob: str) -> list[str]:
    """The alternatives of nested braces; an unbalanced brace stands for itself."""
    open_ = glob.find("{")
    if open_ < 0:
        return [glob]
    depth, starts, parts = 0, open_ + 1, []
    for i in range(open_, len(glob)):
        c = glob[i]
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 1 or depth == 0:
            parts.append(glob[starts:i])
            starts = i + 1
        if depth == 0:
            return [glob[:open_] + p + rest for p in parts for rest in _braces(glob[i + 1 :])] if not any("{" in p for p in parts) else [
                x for p in parts for x in _braces(glob[:open_] + p + glob[i + 1 :])
            ]
    return [glob]


def glob_regex(glob: str) -> str:
    """A regular expression, for whole paths, of a glob: ``*`` and ``?`` stay in a path's part, ``**`` doesn't.

    A glob without a slash is for the last part of a path; one that ends in ``/**`` also takes the folder itself.
    """
    glob = normal_pattern(glob)
    ends = []
    for one in _braces(glob):
        at, out = 0, ""
        tail = ""
        if one.endswith("/**"):
            one, tail = one[:-3], "(?:/.*)?"
        while at < len(one):
            c = one[at]
            if one.startswith("**/", at):
                out, at = out + "(?:.*/)?", at + 3
            elif one.startswith("**", at):
                out, at = out + ".*", at + 2
            elif c == "*":
                out, at = out + "[^/]*", at + 1
            elif c == "?":
                out, at = out + "[^/]", at + 1
            elif c == "[" and (end := one.find("]", at + 2)) > 0:
                body = one[at + 1 : end]
                body = "^" + body[1:] if body[0] in "!^" else body
                out, at = out + "[" + body.replace("\\", r"\\") + "]", end + 1
            else:
                out, at = out + re.escape(c), at + 1
        ends.append(out + tail)
    whole = "(?:" + "|".join(ends) + ")"
    return f"^(?:.*/)?{whole}$" if "/" not in glob else "^" + whole.replace("(?:/", "(?:/", 1) + "$"


def matches_path(path: Column, pattern: str) -> Column:
    """Whether a path is what a pattern names: a glob's match, or the named path itself or what is below it."""
    pattern = normal_pattern(pattern)
    if not pattern:
        return F.lit(False)
    if any(c in pattern for c in "*?[{"):
        return path.rlike(glob_regex(pattern))
    pattern = pattern.rstrip("/")
    return (path == pattern) | path.startswith(pattern + "/")


def matches_ordered(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """The last glob that matches decides, ``!`` being a negation; without a match, whether there is no positive one."""
    verdict = F.lit(not any(not g.startswith("!") for g in globs))
    for glob in globs:
        found = path.rlike(("(?i)" if ignore_case else "") + glob_regex(glob.lstrip("!")))
        verdict = F.when(found, F.lit(not glob.startswith("!"))).otherwise(verdict)
    return verdict


def line_regex(
    patterns: list[str], fixed: bool = False, word: bool = False, whole_line: bool = False, ignore_case: bool = False, smart_case: bool = False
) -> str:
    """One regular expression for lines from several patterns, as options say.  Lookaround and back references, which
    other engines lack, are refused."""
    if not patterns or len(patterns) > 1000 or any(len(p.encode()) > 4096 for p in patterns) or sum(len(p.encode()) for p in patterns) > 65536:
        raise ValueError("between 1 and 1000 patterns, of 4096 bytes each and 65536 in all")
    if not fixed and any(re.search(r"\(\?<?[=!]|\\[1-9]", p) for p in patterns):
        raise ValueError("lookaround and back references can't be used")
    body = "|".join(re.escape(p) if fixed else p for p in patterns)
    body = f"(?:{body})"
    body = rf"\b{body}\b" if word else body
    body = f"^{body}$" if whole_line else body
    insensitive = ignore_case or smart_case and not any(c.isupper() for p in patterns for c in p)
    return ("(?iu)" if insensitive else "") + body
