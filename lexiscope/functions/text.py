"""Text column expressions. All native (JVM, code generated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() / str.strip() treat as
# whitespace, written as one regex class that Java and RE2 read the same way.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
WORD = "[^" + WHITESPACE_CLASS[1:] + "+"
# The same characters as a plain string, for ``translate`` (much cheaper than
# a regex with this class): every one of them becomes a space.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")


def _spaces(x: Column) -> Column:
    """Every whitespace character -> one plain space."""
    return F.translate(x, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Every run of whitespace becomes one space, then strip; null gives ''."""
    return F.trim(F.regexp_replace(_spaces(F.coalesce(_col(c), F.lit(""))), " +", " "))


def count_words(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``): map
    whitespace to spaces, strip, count the space runs between words."""
    t = F.trim(_spaces(F.coalesce(_col(c), F.lit(""))))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(" +")) + 1).cast("long")


def count_characters(c) -> Column:
    """Code points, not counting space, newline and tab."""
    return F.length(F.translate(_col(c), " \n\t", "")).cast("long")


def count_bytes(c) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(_col(c)).cast("long")


def content_for_embedding(title, text) -> Column:
    """``"{title}: {text}"``; keeps ``': '`` even for an empty title."""
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(": "),
                    F.coalesce(_col(text), F.lit("")))


def content_for_analysis(title, text) -> Column:
    """``"{title} {text}"``."""
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "),
                    F.coalesce(_col(text), F.lit("")))


def flatten_newlines(c) -> Column:
    """Newline to space (one document per line in a text file)."""
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))  # by bytes; translate goes by characters


def display_truncate(c, width: int = 40) -> Column:
    """First ``width`` characters plus ``...`` when longer."""
    x = _col(c)
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))) \
        .otherwise(x)


def truncate_tokens(tokens, n: int, end_marks: int = 0) -> Column:
    """At most ``n`` tokens: the first ones, with the last ``end_marks`` (the
    special tokens behind a text) kept inside the limit."""
    t = _col(tokens)
    if not end_marks:
        return F.slice(t, 1, n)
    kept = F.concat(F.slice(t, 1, n - end_marks), F.slice(t, -end_marks, end_marks))
    return F.when(F.size(t) <= n, t).otherwise(kept)
