"""Text helpers: Unicode trimming, byte-based truncation, comment stripping."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank when a string is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body, without the line feed.
BLANK_IN_LINE = r"\t\x0B\f\r \x{85}\p{Z}"


def trim(c: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def truncate_bytes(c: Column, limit: int, ellipsis: str = "…") -> Column:
    """Cut to ``limit`` bytes and mark the cut; a split character becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(c.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(c) > limit, F.concat(head, F.lit(ellipsis))).otherwise(c)


SNIPPET_BYTES = 160


def snippet(c: Column) -> Column:
    return truncate_bytes(trim(c), SNIPPET_BYTES)


def hash_if_cut(c: Column, limit: int) -> Column:
    """Hash of a whole text that ``truncate_bytes`` cuts; null for one that it leaves as it is."""
    return F.when(F.octet_length(c) > limit, F.sha2(c, 256))


def snippet_identity(c: Column) -> Column:
    return hash_if_cut(trim(c), SNIPPET_BYTES)


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(or_, [c.contains(n) for n in needles])


def starts_with_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(or_, [c.startswith(n) for n in needles])


def ends_with_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(or_, [c.endswith(n) for n in needles])


# Java's own word boundary is Unicode-aware; this one tests ASCII word characters.
ASCII_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_words(pattern: str) -> str:
    r"""Rewrite every ``\b`` into a boundary of ASCII word characters."""
    return pattern.replace(r"\b", ASCII_BOUNDARY)


def matches(c: Column, pattern: str) -> Column:
    """Regex search with ``\\n``-only line ends and ASCII word boundaries."""
    return c.rlike("(?d)" + ascii_words(pattern))


COMMENT_START = rf"^[{BLANK_IN_LINE}]*+(?://|#|\*|/\*|<!--)"
MASKED_START = rf"^[{BLANK_IN_LINE}]*+(?:\z|//|/\*|\*|<!--)"
MASKED_START_HASH = rf"^[{BLANK_IN_LINE}]*+(?:\z|//|/\*|\*|<!--|#)"

HASH_COMMENT_EXTS = (".php", ".py", ".rb")

# A complete quoted literal with backslash escapes, in any of three quotes.
_LITERAL = "|".join(rf"{q}(?:\\.|[^{q}\\])*+{q}" for q in ("'", '"', "`"))
_STRIP_SLASHES = rf"(?s)^((?:[^'\"`/]|/(?!/)|{_LITERAL})*+)//.*$"
_STRIP_HASH = rf"(?s)^((?:[^'\"`/#]|/(?!/)|{_LITERAL})*+)(?://|#).*$"
_STRIP_PHP = rf"(?s)^((?:[^'\"`/#]|/(?!/)|#(?=\[)|{_LITERAL})*+)(?://|#).*$"


def is_comment(line: Column) -> Column:
    return line.rlike(COMMENT_START)


def strip_trailing_comment(line: Column, ext: Column) -> Column:
    """Cut a trailing ``//`` (or ``#`` in PHP, Python, Ruby) comment outside quotes."""

    def cut(pattern: str) -> Column:
        return F.when(
            line.rlike(pattern), F.rtrim(F.regexp_extract(line, pattern, 1), F.lit(" \t"))
        ).otherwise(line)

    slashes, hashes = line.contains("//"), line.contains("#")
    return (
        F.when((ext == ".php") & (slashes | hashes), cut(_STRIP_PHP))
        .when(ext.isin(".py", ".rb") & (slashes | hashes), cut(_STRIP_HASH))
        .when(~ext.isin(*HASH_COMMENT_EXTS) & slashes, cut(_STRIP_SLASHES))
        .otherwise(line)
    )


def line_of(body: Column, needle: Column) -> Column:
    """1-based line of the first occurrence of ``needle``; 1 when absent."""
    head = F.substring(body, F.lit(1), F.position(needle, body) - 1)
    return F.when(F.contains(body, needle), F.size(F.split(head, "\n", -1))).otherwise(F.lit(1))
