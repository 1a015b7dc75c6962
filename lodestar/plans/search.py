"""A hybrid search as a plan: its routes, filters and limits, checked before anything runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import formats

LIMIT = 7
# Words that never name a symbol, and kinds that a symbol may have.
KEYWORDS = frozenset("class struct enum interface function method type const let var namespace where find explain".split())
# Short names of file types, and the formats they stand for.
ALIASES = {
    "sh": "bash", "shell": "bash", "zsh": "bash", "cjs": "javascript", "mjs": "javascript", "js": "javascript jsx", "jsx": "jsx", "cc": "cpp", "cp": "cpp",
    "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "h": "cpp", "md": "markdown", "mdx": "markdown", "py": "python", "pyi": "python", "rb": "ruby",
    "rs": "rust", "txt": "text", "ts": "typescript tsx", "tsx": "tsx", "yml": "yaml",
}


class PlanError(ValueError):
    """What is wrong with a plan, with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Route:
    mode: str  # fts or vector
    query: str
    id: str = ""


@dataclass(frozen=True)
class SearchPlan:
    routes: Sequence[Route] = ()
    limit: int = LIMIT
    tracked: str | None = None
    prefer_symbol: bool = False
    symbol_types: Sequence[str] = ()
    symbols: Sequence[str] = ()
    include_paths: Sequence[str] = ()
    exclude_paths: Sequence[str] = ()
    globs: Sequence[str] = ()
    insensitive_globs: Sequence[str] = ()
    file_types: Sequence[str] = ()
    excluded_file_types: Sequence[str] = ()
    modified_after: int | None = None
    modified_before: int | None = None


def hybrid(query: str, **options) -> SearchPlan:
    """A plan of a full-text and a vector route for one query."""
    return SearchPlan(routes=[Route("fts", query), Route("vector", query)], **options)


def resolve(plan: SearchPlan) -> SearchPlan:
    """The plan with trimmed values and named routes: fts, fts-2, vector and so on.  A PlanError says what is wrong."""
    if not plan.routes:
        raise PlanError("EMPTY_ROUTES", "a plan needs a route")
    routes: list[Route] = []
    for route in plan.routes:
        if route.mode not in ("fts", "vector"):
            raise PlanError("ROUTE_MODE", f"unknown mode {route.mode!r}")
        if not route.query.strip():
            raise PlanError("EMPTY_ROUTE_QUERY", "a route needs a query")
        n = 1 + sum(r.mode == route.mode for r in routes)
        routes.append(Route(route.mode, route.query.strip(), route.mode if n == 1 else f"{route.mode}-{n}"))
    if plan.limit < 0:
        raise PlanError("LIMIT", "a limit can't be negative")
    for name in ("modified_after", "modified_before"):
        if (getattr(plan, name) or 0) < 0:
            raise PlanError("MODIFIED_TIME", f"{name} can't be negative")
    if plan.modified_after is not None and plan.modified_before is not None and plan.modified_after > plan.modified_before:
        raise PlanError("MODIFIED_TIME_RANGE", "modified_after is later than modified_before")
    clean: dict = {"routes": routes}
    for name in ("include_paths", "exclude_paths", "globs", "insensitive_globs", "file_types", "excluded_file_types", "symbol_types", "symbols"):
        values = [v.strip() for v in getattr(plan, name)]
        if not all(values):
            raise PlanError("FILTER", f"{name} has an empty value")
        clean[name] = [X.normal_pattern(v) for v in values] if name.endswith("paths") else values
    known = formats() | set(ALIASES) | {"all"}
    for name in ("file_types", "excluded_file_types"):
        for value in clean[name]:
            if value.lower() not in known:
                raise PlanError("FILE_TYPE", f"unknown file type {value!r}")
    return replace(plan, **clean)


def symbol_names(query: str) -> list[str]:
    """Names of symbols that a query may mean; an owner stays before ``::`` if it is written like a type."""
    names = set()
    for token in re.findall(r"[A-Za-z0-9_~:]+", query):
        parts = [p for p in token.split("::") if p] or [token]
        if token.lower() in KEYWORDS or not re.fullmatch(r"[A-Za-z_~][A-Za-z0-9_~]*", parts[-1]):
            continue
        owned = len(parts) > 1 and re.match(r"[A-Z_~]", parts[-2])
        names.add("::".join(parts[-2:]) if owned else parts[-1])
    return sorted(names)


def meant(symbol: Column, scope: Column, names: Sequence[str]) -> Column:
    """Whether a symbol is one of the names, by itself or behind the last part of its scope."""
    if not names:
        return F.lit(False)
    owner = F.regexp_extract(scope, r"([^.:]+)$", 1)
    return F.coalesce(symbol.isin(list(names)) | F.concat_ws("::", owner, symbol).isin(list(names)), F.lit(False))


def file_filter(plan: SearchPlan, path: Column, modified: Column, format_: Column) -> Column:
    """The plan's filters of files as one condition; what it doesn't name passes."""
    keep: Column = F.lit(True)
    if plan.include_paths:
        keep = keep & _any([X.matches_path(path, p) for p in plan.include_paths])
    if plan.exclude_paths:
        keep = keep & ~_any([X.matches_path(path, p) for p in plan.exclude_paths])
    if plan.globs:
        keep = keep & X.matches_ordered(path, list(plan.globs))
    if plan.insensitive_globs:
        keep = keep & X.matches_ordered(path, list(plan.insensitive_globs), ignore_case=True)
    if plan.file_types and "all" not in plan.file_types:
        keep = keep & _type(plan.file_types, format_)
    if plan.excluded_file_types:
        keep = keep & ~_type(plan.excluded_file_types, format_)
    if plan.modified_after is not None:
        keep = keep & (modified >= plan.modified_after)
    if plan.modified_before is not None:
        keep = keep & (modified <= plan.modified_before)
    return keep


def _any(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def _type(names: Sequence[str], format_: Column) -> Column:
    known = [f for n in names for f in ALIASES.get(n.lower(), n.lower()).split()]
    return F.coalesce(format_.isin(known), F.lit(False))
