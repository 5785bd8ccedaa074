"""Exclude patterns in the manner of ignore files, compiled to one expression over relative paths."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str | None:
    """Regular expression over a relative path for a pattern; null for blanks and comments.

    A pattern with a slash before its end is anchored at the root, others match at
    any depth; a trailing slash means directories; what lies below a match matches.
    """
    p = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not p or p.startswith("#"):
        return None
    p = p.removeprefix("\\")
    directory = p.endswith("/")
    p = p.strip("/") if not p.startswith("/") else "/" + p.strip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            inner = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if directory else "(?:/|$)")


def rules(patterns: list[str]) -> list[tuple[bool, str]]:
    """(excludes, expression) of each pattern; a leading exclamation mark takes back."""
    out = []
    for p in patterns:
        negated = p.startswith("!")
        if regex := to_regex(p[1:] if negated else p):
            out.append((not negated, regex))
    return out


def compile_patterns(patterns: list[str]) -> Callable[[Column], Column]:
    """Whether a relative path is excluded: the last pattern that matches decides.

    What an excluded directory holds cannot be taken back. Paths outside the root
    (empty or beginning with ``..``) are never excluded.
    """
    compiled = rules(patterns)

    def matches(path: Column) -> Column:
        excluded = F.lit(False)
        for i, (excludes, regex) in enumerate(compiled):
            hit = path.rlike(regex)
            if excludes:
                excluded = excluded | hit
            else:
                parent = F.regexp_replace(path, "/?[^/]*$", "/")
                above = F.lit(False)
                for e, r in compiled[:i]:
                    if e:
                        above = above | ((parent != "/") & parent.rlike(r))
                excluded = excluded & (~hit | above)
        return excluded & (path != "") & ~F.startswith(path, F.lit(".."))

    return matches


def excluded(path: str, patterns: list[str]) -> bool:
    """The same rule for one path, for walks on the driver."""
    if not path or path.startswith(".."):
        return False
    parts = path.rstrip("/").split("/")
    for k in range(1, len(parts)):
        if _last(("/".join(parts[:k])) + "/", patterns):
            return True
    return _last(path, patterns)


def _last(path: str, patterns: list[str]) -> bool:
    decision = False
    for excludes, regex in rules(patterns):
        if re.search(regex, path):
            decision = excludes
    return decision


def excluded_below(path: str, roots: list[str], patterns: list[str]) -> bool:
    """Whether a path is excluded seen from any of the roots that it lies below."""
    inside = (path.removeprefix(r.rstrip("/") + "/") for r in roots if path.startswith(r.rstrip("/") + "/"))
    return any(excluded(p, patterns) for p in inside)
