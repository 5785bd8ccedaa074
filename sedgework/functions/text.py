"""String, path and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming takes off, line ends and the byte order mark included.
BLANKS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(c: Column) -> Column:
    """Both ends freed of all Unicode white space."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+\\z", "")


def sha12(c: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a text's UTF-8."""
    return F.substring(F.sha2(c, 256), 1, 12)


def token_estimate(c: Column) -> Column:
    """A token for each four characters begun; lengths are code points."""
    return F.ceil(F.char_length(c) / 4).cast("int")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, overlaps included, ignoring case by simple lower-casing; null text has none."""
    low, t = F.lower(text), F.lower(term)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - F.char_length(t) + 1))
    found = F.size(F.filter(starts, lambda i: F.substring(low, i, F.char_length(t)) == t))
    return F.when(low.isNull() | ~F.contains(low, t), 0).otherwise(found)


def trigrams(c: Column) -> Column:
    """Number of 3-character windows; null has none."""
    return F.greatest(F.lit(0), F.coalesce(F.char_length(c), F.lit(0)) - 2)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """Extension with its dot in lower case; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]*$", "$1")


def common_directory(paths: Column) -> Column:
    """Aggregate: the deepest directory that holds all paths, from the least and the greatest of their directories.

    Null without paths or without a common directory. The least and greatest of a
    set of arrays share exactly the prefix that all share, so two partial
    aggregates are enough at any size.
    """
    parts = F.split(dirname(paths), "/")
    lo, hi = F.min(parts), F.max(parts)
    same = F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    length = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(lo).cast("long"))
    return F.nullif(F.array_join(F.slice(lo, F.lit(1), length.cast("int")), "/"), F.lit(""))
