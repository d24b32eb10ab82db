"""Expressions on labels and ids. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean "no type", compared without case.
UNTYPED_WORDS = ["unknown", "nan", "none", "null", "<na>", "<null>"]
#: Short ids have this many digits and are completed with this prefix.
SHORT_ID_DIGITS = 9
SHORT_ID_PREFIX = "720575940"
#: White space that is cut from the ends of labels and ids.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """``c`` without surrounding white space (tabs, no-break spaces and line ends too)."""
    return F.btrim(c, F.lit(BLANKS))


_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS)


def bare_label(c: Column) -> Column:
    """``c`` without surrounding blanks, ``_L/_R/_U`` suffixes and enclosing parentheses, until none is left.

    Suffixes and closing parentheses are taken off from the right as long as an opening one at the left is left for each
    closing one. A null stays null.
    """
    head = F.regexp_extract(c, rf"^[{_BLANK}(]*+", 0)
    rest = F.substr(c, F.length(head) + 1)
    tail = F.regexp_extract(rest, rf"(?:[{_BLANK})]++|_[LRU])*+$", 0)
    # what stands right of the first closing parenthesis that has no opening one
    opened = F.length(head) - F.length(F.replace(head, F.lit("("), F.lit("")))
    gone = F.call_function("substring_index", tail, F.lit(")"), (-opened - 1).cast("int"))
    closed = F.length(gone) - F.length(F.replace(gone, F.lit(")"), F.lit("")))
    left = F.call_function("substring_index", head, F.lit("("), (closed - opened - 1).cast("int"))
    inner = strip(F.concat(left, F.substr(rest, F.lit(1), F.length(rest) - F.length(gone))))
    return F.when(c.rlike(rf"(?:_[LRU]|\))[{_BLANK}]*+$"), inner).otherwise(strip(c))


def is_untyped_bare(bare: Column) -> Column:
    """Whether a label that ``bare_label`` made means "no type"; true for null."""
    return F.coalesce((bare == "") | F.lower(bare).isin(UNTYPED_WORDS) | bare.rlike(r"^(?:[hH][bB])?[0-9]+$"), F.lit(True))


def is_untyped(c: Column) -> Column:
    """Whether a label means "no type": null, blank, a sentinel word, all digits, or ``hb`` and digits,
    looked at without side suffixes and enclosing parentheses, however many."""
    label = rf"^[{_BLANK}(]*+(?i:{'|'.join(UNTYPED_WORDS)}|(?:hb)?[0-9]++)?+(?:[{_BLANK})]++|_[LRU])*+$"
    pairs = F.length(F.replace(c, F.lit("("), F.lit(""))) == F.length(F.replace(c, F.lit(")"), F.lit("")))
    return F.when(c.isNull(), True).when(c.rlike(label), pairs).otherwise(False)


def canonical_id(c: Column) -> Column:
    """The one spelling of an id: no blanks, no integral ``.0``, no leading zeros, short ids completed.

    Null and blank ids refer to nothing and give null; only zeros give ``0``.
    """
    text = strip(c.cast("string"))
    digits = F.ltrim(F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1"), F.lit("0"))
    full = F.when((F.length(digits) == SHORT_ID_DIGITS) & digits.rlike("^[0-9]+$"), F.concat(F.lit(SHORT_ID_PREFIX), digits)).when(digits == "", F.lit("0")).otherwise(digits)
    plain = c.cast("string").rlike(rf"^[1-9](?:[0-9]{{0,{SHORT_ID_DIGITS - 2}}}|[0-9]{{{SHORT_ID_DIGITS},}})$")
    return F.when(plain, c.cast("string")).when(text != "", full)


def cell_names(c: Column) -> Column:
    """The distinct names of a comma-joined cell as an array, bare and without untyped values; empty for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), bare_label)
    return F.array_distinct(F.filter(parts, lambda x: ~is_untyped_bare(x)))


def id_order(c: Column) -> list[Column]:
    """Sort keys that order canonical ids as numbers of any length (others by length, then text)."""
    return [F.length(c), c]


def split_hemisphere(c: Column) -> tuple[Column, Column]:
    """The label without its ``_L/_R/_U`` suffix, and that suffix ('' if none)."""
    side = F.regexp_extract(c, r"(_[LRU])$", 1)
    return F.regexp_replace(c, r"_[LRU]$", ""), side
