"""Path functions as Column expressions. All run in the JVM; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def slashes(x: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(x, "\\", "/")


def name(path: Column | str) -> Column:
    """Text after the last slash; the whole path if there is none. A backslash is no separator here."""
    return F.substring_index(col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Text after the last dot of the name, as written; empty for names that start or end with their only dot."""
    return F.regexp_extract(name(path), r"(?s)^.+\.([^.]+)\z", 1)


def find_ci(text: Column, term: Column) -> Column:
    """Byte offset of a lower-case term in the lower-cased text, null if absent."""
    low = F.lower(text)
    return F.when(F.call_function("instr", low, term) > 0, F.octet_length(F.call_function("substring_index", low, term, F.lit(1)))).cast("long")


def safe(path: Column | str) -> Column:
    """Absolute (/, X:/, X:\\ or \\\\), no NUL, no . or .. component."""
    p = col(path)
    absolute = p.startswith("/") | p.rlike(r"^[A-Za-z]:[/\\]") | p.startswith("\\\\")
    return ~F.contains(p, F.char(F.lit(0))) & absolute & ~p.rlike(r"(^|[/\\])\.{1,2}(\z|[/\\])")


def safe_posix(path: Column | str) -> Column:
    """As safe for / paths only; an interior . component is allowed, .. isn't."""
    p = col(path)
    return ~F.contains(p, F.char(F.lit(0))) & p.startswith("/") & ~p.rlike(r"(^|/)\.\.(\z|/)")


def under(path: Column | str, root: Column | str) -> Column:
    """At or below the root; the root ends where a component ends."""
    p, r = col(path), F.lit(root) if isinstance(root, str) else root
    edge = F.endswith(r, F.lit("/")) | F.endswith(r, F.lit("\\")) | F.substring(p, F.length(r) + 1, F.lit(1)).isin("/", "\\")
    return F.startswith(p, r) & ((p == r) | edge)


def under_ci(path: Column | str, root: Column | str) -> Column:
    """``under`` without regard to case or to the kind of slash."""
    r = F.lit(root) if isinstance(root, str) else root
    return under(slashes(F.lower(col(path))), slashes(F.lower(r)))


def key(path: Column | str) -> Column:
    """Lower case, one kind of slash: what is stored and sorted by, so that prefixes and terms reach the scan."""
    return slashes(F.lower(col(path)))


def portable(path: Column | str, fold: bool = False) -> Column:
    """Slashes of one kind; optionally ASCII lower case."""
    p = slashes(col(path))
    return ascii_lower(p) if fold else p


def in_root(path: Column | str, root: Column | str, fold: bool = False) -> Column:
    """Containment on portable paths; slashes at the root's end don't count, but those of / and X:/ stay."""
    p, r = portable(path, fold), portable(F.lit(root) if isinstance(root, str) else root, fold)
    bare = F.regexp_replace(r, r"/+\z", "")
    r = F.when(bare == "", F.when(r == "", r).otherwise(F.lit("/"))).when(bare.rlike(r"^[A-Za-z]:\z") & (bare != r), F.concat(bare, F.lit("/"))).otherwise(bare)
    return (p == r) | F.startswith(p, F.when(F.endswith(r, F.lit("/")), r).otherwise(F.concat(r, F.lit("/"))))


def same_path(a: Column | str, b: Column | str, fold: bool = False) -> Column:
    """Equal but for separators, slashes at the end and, if asked, ASCII case."""
    bare = lambda x: F.regexp_replace(portable(x, fold), r"/+\z", "")
    return bare(a) == bare(b)


def is_drive_root(path: Column | str) -> Column:
    return col(path).rlike(r"^[A-Za-z]:/\z")


def client_text(path: Column | str) -> Column:
    """A path as clients write it: no //?/ or //./ prefix, single slashes, none at the end of more than 3 characters."""
    p = slashes(col(path))
    p = F.when(p.startswith("//?/UNC/"), F.concat(F.lit("//"), F.substring(p, F.lit(9), F.length(p)))).when(p.startswith("//?/") | p.startswith("//./"), F.substring(p, F.lit(5), F.length(p))).otherwise(p)
    lead = F.when(p.startswith("//"), F.lit("/")).otherwise(F.lit(""))
    p = F.concat(lead, F.regexp_replace(p, "/+", "/"))
    return F.when(F.length(p) > 3, F.regexp_replace(p, r"/+\z", "")).otherwise(p)


def client_under(path: Column | str, root: Column | str, case_sensitive: bool = True) -> Column:
    p, r = client_text(path), client_text(F.lit(root) if isinstance(root, str) else root)
    if not case_sensitive:
        p, r = F.lower(p), F.lower(r)
    return (p == r) | F.startswith(p, F.when(F.endswith(r, F.lit("/")), r).otherwise(F.concat(r, F.lit("/"))))


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def normalize(path: Column | str) -> Column:
    """One kind of slash, no empty component; // of a share, a leading / and X:/ stay; nothing becomes /."""
    p = slashes(col(path))
    joined = F.array_join(components(p), "/")
    return (
        F.when(p.startswith("//"), F.concat(F.lit("//"), joined)).when(p.startswith("/"), F.concat(F.lit("/"), joined))
        .when(p.rlike("^[A-Za-z]:/") & (F.length(joined) == 2), F.concat(joined, F.lit("/"))).when(joined == "", F.lit("/")).otherwise(joined)
    )


def is_volume_root(normal: Column) -> Column:
    """A drive's root or a share's, of a normalized path."""
    return is_drive_root(normal) | (normal.startswith("//") & (F.size(components(normal)) == 2))


def parent_of(normal: Column) -> Column:
    """Parent of a normalized path; / is the parent of volume roots and of itself."""
    up = F.regexp_replace(normal, r"(?s)/[^/]*\z", "")
    return (
        F.when((normal == "/") | is_volume_root(normal) | ~F.contains(normal, F.lit("/")) | (up == ""), F.lit("/"))
        .when((F.length(up) == 2) & F.endswith(up, F.lit(":")), F.concat(up, F.lit("/"))).otherwise(up)
    )


def parent(path: Column | str) -> Column:
    return parent_of(normalize(path))


def display_name(path: Column | str) -> Column:
    """Computer for /, a volume root without slashes at the end, else the last component."""
    n = normalize(path)
    return F.when(n == "/", F.lit("Computer")).when(is_volume_root(n), F.regexp_replace(n, r"/+\z", "")).otherwise(F.substring_index(n, "/", -1))


def ancestors_of(normal: Column) -> Column:
    """All folders from / down to a normalized path, itself last; drive and share roots are single steps."""
    drive, share = normal.rlike("^[A-Za-z]:/"), normal.startswith("//")
    parts = components(normal)
    first = F.when(share, F.lit(2)).otherwise(F.lit(1))
    lead = F.when(drive, F.lit("")).when(share, F.lit("//")).otherwise(F.lit("/"))
    steps = F.transform(F.sequence(first, F.greatest(F.size(parts), first)), lambda i: F.when(drive & (i == 1), F.concat(parts[0], F.lit("/"))).otherwise(F.concat(lead, F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(F.size(parts) < first, F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), steps))


def ancestors(path: Column | str) -> Column:
    return ancestors_of(normalize(path))


def append_component(folder: Column, child: Column) -> Column:
    """folder/child, or child alone below an empty folder."""
    return F.when(folder == "", child).otherwise(F.concat(folder, F.lit("/"), child))
