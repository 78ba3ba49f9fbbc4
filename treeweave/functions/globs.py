"""Path patterns as Spark columns.

A pattern has one of four forms, tried in this order:
`*.x` (suffix), `p/*` (text prefix, longer than it), `head*tail` with one star, and a literal file or directory.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def _head(text: Column, dropped: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - dropped)


def glob_match(pattern: Column, path: Column) -> Column:
    """Match where the pattern is itself a column, such as a row of a rule table."""
    prefix = _head(pattern, 2)
    star = F.instr(pattern, "*")
    one_star = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit(""))) == 1
    return (
        F.when(pattern.startswith("*."), F.endswith(path, F.substring(pattern, 2, 1 << 30)))
        .when(pattern.endswith("/*"), F.startswith(path, prefix) & (F.length(path) > F.length(prefix)))
        .when(
            one_star,
            F.startswith(path, F.substring(pattern, F.lit(1), star - 1))
            & F.endswith(path, F.substring(pattern, star + 1, F.length(pattern))),
        )
        .otherwise((path == pattern) | F.startswith(path, F.concat(pattern, F.lit("/"))))
    )


def include_match(pattern: Column, path: Column) -> Column:
    """Include patterns: `dir/` is a text prefix, a pattern without `/` looks at the file name only."""
    folder = _head(pattern, 1)
    return (
        F.when(pattern.endswith("/"), F.startswith(path, folder) & (F.length(path) > F.length(folder)))
        .when(~pattern.contains("/"), glob_match(pattern, file_name(path)))
        .otherwise(glob_match(pattern, path))
    )


def any_glob(patterns: Column, path: Column) -> Column:
    return F.exists(patterns, lambda p: glob_match(p, path))


def any_include(patterns: Column, path: Column) -> Column:
    return F.exists(patterns, lambda p: include_match(p, path))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def first_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def matches_any(patterns: Iterable[str], path: Column) -> Column:
    """One boolean column for a known rule list.

    Rules of like shape become one test each: a set lookup of the last extension, one of the first component, and one
    anchored alternation of all prefixes. Nothing is joined or shuffled. No rule matches a null path.
    """
    endings, components, prefixes, starts = set(), set(), set(), set()
    tests: list[Column] = []
    for pattern in sorted(set(patterns)):
        if pattern.startswith("*."):
            ending = pattern[2:]
            if "." in ending or "/" in ending:
                tests.append(path.endswith("." + ending))
            else:
                endings.add(ending)
        elif pattern.endswith("/*"):
            prefixes.add(pattern[:-2])
        elif pattern.count("*") == 1:
            head, tail = pattern.split("*")
            if tail:
                tests.append(path.startswith(head) & path.endswith(tail))
            else:
                starts.add(head)
        elif "/" in pattern:
            tests.append((path == pattern) | path.startswith(pattern + "/"))
        else:
            components.add(pattern)
    if endings:
        tests.append(path.contains(".") & extension(path).isin(sorted(endings)))
    if components:
        tests.append(first_component(path).isin(sorted(components)))
    if prefixes or starts:
        longer = [_quoted(p) + "." for p in sorted(prefixes)]
        tests.append(path.rlike("(?s)^(?:" + "|".join(longer + [_quoted(p) for p in sorted(starts)]) + ")"))
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def included_by_any(patterns: Iterable[str], path: Column) -> Column:
    """Known include list: true for every path if the list is empty."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(True)
    tests = []
    for pattern in patterns:
        if pattern.endswith("/"):
            tests.append((F.length(path) > len(pattern) - 1) & path.startswith(pattern[:-1]))
        elif "/" in pattern:
            tests.append(matches_any([pattern], path))
        else:
            tests.append(matches_any([pattern], file_name(path)))
    return reduce(or_, tests)
