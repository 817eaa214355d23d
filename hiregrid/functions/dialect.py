"""Unicode text rules shared by every expression.

Java's ``\\s \\w \\d \\b`` are ASCII-only and ``trim`` removes only blanks, while
the rules being matched are defined over Unicode text. All patterns are built
from the classes below instead.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Insides of character classes, to be put between brackets.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
BREAK = r"\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
# Everything but BREAK, the common characters first; Java matches this many times
# faster than the negated class.
NOT_BREAK = r"\x1f-\x84\x00-\t\x0e-\x1b\x86-\x{2027}\x{202a}-\x{10ffff}"
INLINE_SPACE = r"\t\x1f\p{Zs}"  # SPACE without BREAK
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

LINE_END = rf"(?:\r\n|[{BREAK}])"

# The code points of SPACE, for trimming without a regex.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def any_case(pattern: str, first: str) -> str:
    """``pattern`` in any case; ``first`` holds every character a match can begin with.

    Testing the first character against a plain class before trying the
    alternatives is what most positions of a text come down to.
    """
    return f"(?=[{first}])(?iu:{pattern})"


def whole_word(words: tuple[str, ...], first: str) -> str:
    return rf"(?=[{first}])(?<![{WORD}])(?iu:{'|'.join(words)})(?![{WORD}])"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends, in linear time."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    """True for text with nothing but white space; null stays null."""
    return ~col.rlike(rf"[^{SPACE}]")


def or_null(col: Column) -> Column:
    """``col`` with '' as null. Unlike ``nullif`` this evaluates ``col`` only once."""
    return F.get(F.array_remove(F.array(col), ""), F.lit(0))


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null where Spark's ``regexp_extract`` gives ''."""
    return or_null(F.regexp_extract(col, pattern, group))


@lru_cache(maxsize=1)
def _digit_map() -> tuple[str, str]:
    digits = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(c)) for c in digits)


def to_int(col: Column) -> Column:
    """Integer value of a digit string in any script, null if it is none."""
    other, ascii_digits = _digit_map()
    return F.translate(col, other, ascii_digits).try_cast("int")
