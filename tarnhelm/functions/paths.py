"""Path and range predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(path: Column) -> Column:
    """Without leading slashes."""
    return F.ltrim(path, F.lit("/"))


def slashed(path: Column) -> Column:
    """With slashes where backslashes were."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def like(value: Column, pattern: Column) -> Column:
    """LIKE of the fact store: case folded, ``_`` and ``%`` of the pattern are wildcards, a backslash is itself."""
    return F.like(F.lower(value), F.replace(F.lower(pattern), F.lit("\\"), F.lit("\\\\")))


def suffix(path: Column, wanted: Column, by_segment: bool = False) -> Column:
    """``path`` ends with ``wanted``; leading slashes of both don't count. By default any characters may come before, so ``a.ts`` is a suffix of ``data.ts``; ``by_segment`` asks for whole segments."""
    path, wanted = trimmed(path), trimmed(wanted)
    if by_segment:
        return (F.lower(path) == F.lower(wanted)) | F.endswith(F.lower(path), F.concat(F.lit("/"), F.lower(wanted)))
    return like(path, F.concat(F.lit("%"), wanted))


def either_suffix(a: Column, b: Column) -> Column:
    """One ends with the other."""
    return F.endswith(a, b) | F.endswith(b, a)


def same_directory_quirk(a: Column, b: Column) -> Column:
    """Equal first n characters, n being the number of slashes: what the fact store's expression compares, which isn't the directory."""
    slashes = lambda p: F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return F.substring(a, F.lit(1), slashes(a)) == F.substring(b, F.lit(1), slashes(b))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Ranges share a line; ends are inclusive."""
    return (start <= last) & (end >= first)


def encloses(start: Column, end: Column, line: Column) -> Column:
    return (start <= line) & (line <= end)


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def is_go(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".go"))


#: Names that don't identify a class.
WEAK_CLASS_NAMES = ("get", "set", "init", "config", "handler", "main")


def weak_class_name(name: Column) -> Column:
    """Too short or too general to link by: under three characters, an ellipsis, an underscore at an end, or a stop name."""
    name = F.trim(name)
    return (F.length(name) < 3) | (name == "...") | name.startswith("_") | name.endswith("_") | F.lower(name).isin(*WEAK_CLASS_NAMES)
