"""What a viewer does with hits: facets, a second filter, scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.functions import paths
from metasearch.plans import compile as plan
from metasearch.plans.query import Query, absolute

FACETS = {"files": ["File", "Symlink"], "folders": ["Dir"]}


def facet(files: DataFrame, which: str) -> DataFrame:
    return files.filter(F.col("kind").isin(FACETS[which]))


def post_filter(hits: DataFrame, text: str, mode: str = "name", case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """Hits whose name, "name path" or path has the text, or matches it as a pattern. It works on hits that are already limited.

    A blank text keeps all, an invalid pattern none. The raw text counts, filters in it are text.
    """
    text = text.strip()
    if not text:
        return hits
    subject = {"name": paths.name("path"), "name_path": F.concat(paths.name("path"), F.lit(" "), F.col("path")), "path": F.col("path")}[mode]
    if regex:
        try:
            re.compile(text)
            hits.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(text)
        except Exception:  # noqa: BLE001  either dialect refuses it
            return hits.filter(F.lit(False))
        return hits.filter(subject.rlike(text if case_sensitive else f"(?iu){text}"))
    return hits.filter(F.contains(subject, F.lit(text)) if case_sensitive else F.contains(F.lower(subject), F.lit(text.lower())))


def choose_scope(chosen: str | None, roots: list[str]) -> list[str]:
    """The chosen folder if it is inside a selected root, else all selected roots."""
    def inside(path: str, root: str) -> bool:
        root = root.replace("\\", "/").rstrip("/") or "/"
        path = path.replace("\\", "/")
        return path == root or path.startswith(root if root.endswith("/") else root + "/")

    return [chosen] if chosen is not None and any(inside(chosen, r) for r in roots) else list(roots)


def in_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Rows in one of the selected roots; no root, no rows."""
    return files.filter(plan.some([paths.in_root("path", r) for r in roots]) if roots else F.lit(False))


def allowed(path: Column | str, roots: list[str], case_sensitive: bool = True) -> Column:
    """The second check of a server: a safe path, in an allowed root if there are any."""
    inside = plan.some([paths.client_under(path, r, case_sensitive) for r in roots]) if roots else F.lit(True)
    return paths.safe_posix(path) & inside


def settings_roots(roots: list[str]) -> list[str]:
    """Roots as settings keep them: normalized, absolute, sorted, each once."""
    kept = {r.replace("\\", "/").rstrip("/") or "/" for r in roots if absolute(r)}
    return sorted(kept)


def for_viewer(query: Query, text: str) -> Query:
    """A viewer shows all for a blank text, else a thousand hits."""
    from dataclasses import replace

    return replace(query, limit=1000 if text.strip() else 0)
