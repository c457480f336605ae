"""From a query to columns: predicate, score and order. Everything stays declarative, so Catalyst pushes and prunes."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metasearch.functions import paths
from metasearch.plans.query import Query, Sort
from metasearch.schema import KEY

#: What a term scores. A name that starts with it, a name that has it, a name of its length, nearness to the start, a path that has it.
STARTS, INSIDE, WHOLE, NEAR, IN_PATH = 1 << 20, 1 << 12, 1 << 24, 256, 1 << 6
TOP = (1 << 32) - 1
#: The largest size that a BIGINT holds.
MAX_BIGINT = (1 << 63) - 1


def joined(columns: list[Column], by: Callable[[Column, Column], Column]) -> Column:
    """All columns joined in pairs of pairs: the expression stays shallow however many there are."""
    while len(columns) > 1:
        columns = [by(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def every(conditions: list[Column]) -> Column:
    return joined(conditions, operator.and_)


def some(conditions: list[Column]) -> Column:
    return joined(conditions, operator.or_)


def scope(path: Column | str, roots: tuple[str, ...] | list[str], case_sensitive: bool) -> Column:
    """In one of the roots; no root means everywhere."""
    return some([paths.under(path, r) if case_sensitive else paths.under_ci(path, r) for r in roots]) if roots else F.lit(True)


def filters(query: Query, keyed: bool = False) -> Column:
    """The cheap conditions, cheapest first. Paths that aren't safe never pass.

    ``keyed``: the rows have path_key; ``under:`` then is a prefix of a stored, sorted column, which the scan skips by.
    """
    path, size = F.col("path"), F.col("size")
    found = []
    if query.kinds:
        found.append(F.col("kind").isin(*query.kinds))
    if query.filesystems:
        found.append(F.col("fs").isin(*query.filesystems))
    if query.min_size is not None:
        found.append(size >= query.min_size if query.min_size <= MAX_BIGINT else F.lit(False))
    if query.max_size is not None and query.max_size <= MAX_BIGINT:
        found.append(size <= query.max_size)
    if query.exts:
        found.append(paths.ascii_lower(paths.extension(path)).isin(*query.exts))
    if query.under is not None:
        found.append(paths.under(KEY, paths.key(F.lit(query.under))) if keyed else paths.under_ci(path, query.under))
    if query.scope_roots:
        found.append(scope(path, query.scope_roots, query.scope_case_sensitive))
    return every([*found, paths.safe(path)])


def term_match(query: Query, keyed: bool = False) -> Column:
    """Every term is in the path; a term in the name is in the path as well.

    ``keyed``: terms without slashes are looked for in path_key, which reaches the scan; it differs from the path in slashes and case only.
    """
    low = F.lower(F.col("path"))
    found = [F.contains(F.col(KEY) if keyed and not {"/", "\\"} & set(t) else low, F.lit(t)) for t in query.terms]
    return every(found) if found else F.lit(True)


def score(query: Query) -> Column:
    """The sum over terms, capped; null if a term is missing; 0 without terms. Lengths and offsets are in bytes."""
    path, name = F.col("path"), paths.name("path")
    parts = [F.lit(0).cast("long")]
    for text in query.terms:
        term = F.lit(text)
        at = paths.find_ci(name, term)
        hit = F.when(at == 0, F.lit(STARTS)).otherwise(F.lit(INSIDE)) + F.when(F.octet_length(name) == len(text.encode()), WHOLE).otherwise(0) + (NEAR - F.least(at, F.lit(255)))
        parts.append(F.when(at.isNotNull(), hit).when(F.contains(F.lower(path), term), IN_PATH).cast("long"))
    total = joined(parts, operator.add)
    # least() skips nulls: keep a null score null
    return F.when(total.isNotNull(), F.least(total, F.lit(TOP)))


def order(sort: Sort) -> list[Column]:
    """A total order but for rows that share a path; native_id and source settle those."""
    last = [F.asc("path"), F.asc("native_id"), F.asc("source")]
    return {
        Sort.RELEVANCE: [F.desc("score"), F.desc("mtime")],
        Sort.NAME: [paths.ascii_lower(paths.name("path")).asc()],
        Sort.PATH: [],
        Sort.SIZE: [F.desc("size")],
        Sort.MTIME: [F.desc("mtime")],
    }[sort] + last
