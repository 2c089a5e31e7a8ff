"""Cells: text form, blanks, canonical equality, exact decimals and rounding, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before the JSON of a cell that is not a string (see sources.records).
MARK = "\ue000"
# The default marks of a suppressed cell.
SENTINELS = ("*", "(D)", "(S)", "")
MAX_DIGITS = 36


def named(column: str, of: str = "") -> Column:
    """The column of that very name, whatever dots or backticks are in it; of: the struct that has it."""
    return F.col((f"{of}." if of else "") + "`" + column.replace("`", "``") + "`")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | F.regexp_like(c.cast("string"), F.lit(r"^\s*$"))


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


_PLAIN = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?$"
_GROUPED = r"^[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"


def is_decimal(c: Column) -> Column:
    """Text of a number: sign, exponent and grouped thousands are allowed, leading zeros and blanks are not."""
    text = c.cast("string")
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
    return F.coalesce((F.regexp_like(text, F.lit(_PLAIN)) | F.regexp_like(text, F.lit(_GROUPED))) & (digits <= MAX_DIGITS), F.lit(False))


def decimal(c: Column, scale: int = 12) -> Column:
    """The exact number that a text stands for; null if it stands for none, or for one with more than `scale` decimal places."""
    text = c.cast("string")
    places = F.length(F.regexp_extract(text, r"\.([0-9]+)", 1)) - F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when(is_decimal(c) & (places <= scale), F.replace(text, F.lit(","), F.lit("")).try_cast(f"decimal(38,{scale})"))


def numbers_equal(a: Column, b: Column) -> Column:
    """Different texts of one number."""
    return F.coalesce(decimal(a) == decimal(b), F.lit(False))


def is_suppressed(old: Column, new: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """A present value became a sentinel; an empty or null one counts only if the old value was a number."""
    marks = [s for s in sentinels if s]
    empty = (new.isNull() | (new == "")) & is_decimal(old) if "" in sentinels else F.lit(False)
    return ~is_blank(old) & ~F.coalesce(old.isin(*sentinels), F.lit(False)) & (F.coalesce(new.isin(*marks), F.lit(False)) | empty)


def rounding_modulus(old: Column, new: Column) -> Column:
    """The power of ten to which old was rounded to give the whole number new (half away from zero); null if it wasn't. One only counts
    if old is no whole number."""
    a, b = decimal(old), decimal(new)
    whole = F.regexp_replace(F.abs(b).cast("decimal(26,0)").cast("string"), "^0+(?=.)", "")
    zeros = F.length(F.regexp_extract(whole, "(0*)$", 1))
    modulus = F.concat(F.lit("1"), F.repeat(F.lit("0"), zeros)).try_cast("decimal(26,0)")
    away = (F.abs(a) - F.abs(b)) * 2
    fits = (b != 0) & (b == F.floor(b)) & (a != b) & (F.signum(a) == F.signum(b)) & (away >= -modulus) & (away < modulus)
    return F.when(F.coalesce(fits & ((zeros > 0) | (a != F.floor(a))), F.lit(False)), modulus.try_cast("long"))


def unmarked(c: Column) -> Column:
    """A cell without the mark before its JSON."""
    return F.regexp_replace(c, f"^{MARK}", "")


def kind_of(c: Column) -> Column:
    """null, string, or by the JSON behind the mark: boolean, number, nested."""
    first = F.substring(c, 2, 1)
    marked = F.when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.isin("{", "["), "nested").otherwise("number")
    return F.when(c.isNull(), "null").when(~F.startswith(c, F.lit(MARK)), "string").otherwise(marked)


def type_of(c: Column) -> Column:
    """Kind of a cell by its text: null, boolean, number or string."""
    text = c.cast("string")
    return F.when(text.isNull(), "null").when(text.isin("true", "false"), "boolean").when(is_decimal(text), "number").otherwise("string")
