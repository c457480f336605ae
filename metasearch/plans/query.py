"""The search language: words and quoted phrases, and ext:, kind:, fs:, size:, under: filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

from metasearch.functions.labels import fs_label


class Sort(Enum):
    RELEVANCE = "relevance"
    NAME = "name"
    PATH = "path"
    SIZE = "size"
    MTIME = "mtime"


#: Spellings of the kinds. Others are ignored.
KINDS = {"file": "File", "f": "File", "dir": "Dir", "d": "Dir", "folder": "Dir", "link": "Symlink", "symlink": "Symlink", "l": "Symlink"}
UNITS = {"k": 10, "m": 20, "g": 30, "t": 40}
DEFAULT_LIMIT = 1000
#: Bounds of requests.
MAX_RESULTS, MAX_TERMS, MAX_ROOTS, MAX_TEXT_BYTES = 10_000, 32, 32, 32 << 10
LARGEST = (1 << 64) - 1


@dataclass(frozen=True)
class Query:
    """What to look for. Empty tuples and None don't restrict; ``limit`` 0 returns all."""

    terms: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    filesystems: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None
    under: str | None = None
    scope_roots: tuple[str, ...] = ()
    scope_case_sensitive: bool = False
    sort: Sort = field(default=Sort.RELEVANCE)
    limit: int = DEFAULT_LIMIT

    def within(self, roots: list[str], case_sensitive: bool) -> Query:
        return replace(self, scope_roots=tuple(roots), scope_case_sensitive=case_sensitive)


def tokenize(text: str) -> list[str]:
    """Words between white space; quotes go, and white space between two (or to the end) doesn't separate."""
    found, word, quoted = [], "", False
    for part in re.split(r'(")', text):
        if part == '"':
            quoted = not quoted
        elif quoted:
            word += part
        else:
            first, *rest = re.split(r"\s+", part)
            word += first
            for nxt in rest:
                if word:
                    found.append(word)
                word = nxt
    return found + [word] * bool(word)


def parse_size(text: str) -> int | None:
    """A whole number with an optional unit k, m, g or t (binary); None if it is none, or passes 64 bits."""
    m = re.fullmatch(r"\+?([0-9]+)([kKmMgGtT]?)", text.strip())
    if not m:
        return None
    n = int(m[1]) << UNITS.get(m[2].lower(), 0)
    return n if n <= LARGEST else None


def parse(text: str) -> Query:
    """The query that a text asks for. Unknown kinds and sizes that are no numbers are no filter."""
    terms, exts, kinds, filesystems = [], [], [], []
    bounds: dict[str, int | None] = {"min_size": None, "max_size": None}
    under = None
    for token in tokenize(text):
        key, colon, rest = token.partition(":")
        values = [v for v in rest.split(",") if v]
        if not colon or key not in ("ext", "kind", "fs", "size", "under"):
            terms.append(token.lower())
        elif key == "ext":
            exts += [v.lstrip(".").lower() for v in values]
        elif key == "kind":
            kinds += [KINDS[v] for v in values if v in KINDS]
        elif key == "fs":
            filesystems += [fs_label(v) for v in values]
        elif key == "under":
            under = rest.lower()
        elif ".." in rest:
            low, _, high = rest.partition("..")
            bounds = {"min_size": parse_size(low), "max_size": parse_size(high)}
        elif rest.startswith("<"):
            bounds["max_size"] = parse_size(rest[1:])
        else:
            bounds["min_size"] = parse_size(rest.removeprefix(">"))
    return Query(tuple(terms), tuple(exts), tuple(kinds), tuple(filesystems), under=under, **bounds)


def absolute(path: str) -> bool:
    return re.match(r"/|[A-Za-z]:[/\\]|\\\\", path) is not None


def validate(query: Query) -> Query:
    """The query, if it is within the bounds of a request."""
    if not 1 <= query.limit <= MAX_RESULTS:
        raise ValueError(f"the limit must be from 1 to {MAX_RESULTS}")
    if len(query.terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    if len(query.scope_roots) > MAX_ROOTS or not all(map(absolute, query.scope_roots)):
        raise ValueError(f"scopes must be absolute, {MAX_ROOTS} at most")
    if sum(len(x.encode()) for x in (*query.terms, *query.exts, *query.scope_roots, query.under or "")) > MAX_TEXT_BYTES:
        raise ValueError(f"the query's text passes {MAX_TEXT_BYTES} bytes")
    return query
