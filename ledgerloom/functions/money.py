"""Typed parsing of money, numbers, flags and names, as column expressions without Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_MONEY = ("", "-", "--", "n/a", "none")
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+"


def number_pattern(trailing_minus: bool = True) -> str:
    return rf"^(?:(?:-\s*\$?|\$?\s*-?)\s*(?:{NUMBER})" + (rf"|\$?\s*(?:{NUMBER})\s*-" if trailing_minus else "") + rf"|\(\s*\$?\s*(?:{NUMBER})\s*\))$"


def canonical_number(c: Column, trailing_minus: bool = True) -> Column:
    """One text for one number (``1,246.310`` -> ``1246.31``), null where ``c`` is not a number. Exact up to 200 decimals.

    Takes an optional ``$``, thousands commas, outer blanks, and a negative as leading (or trailing) minus or parentheses.
    """
    s = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    digits = F.concat(F.lit("0"), F.regexp_replace(s, r"[^\d.]", ""))
    plain = F.regexp_replace(digits, r"^0+(?=\d)|\.0*$|(?<=\.\d{0,200})0+$", "")
    sign = F.when(s.rlike(r"[-(]") & s.rlike("[1-9]"), F.lit("-")).otherwise(F.lit(""))
    return F.when(s.rlike(number_pattern(trailing_minus)), F.concat(sign, plain))


def money(c: Column, kind: str = "decimal(18,2)") -> Column:
    """Decimal of a typed amount; null where blank or not money (see :func:`is_money`)."""
    return canonical_number(c).try_cast(kind)


def is_money(c: Column) -> Column:
    """True where blank, ``-``, ``--``, ``n/a`` or a number; a null is blank."""
    return F.coalesce(c, F.lit("")).rlike(r"(?i)^[\s\p{Z}]*(-|--|n/a)?[\s\p{Z}]*$") | canonical_number(c).isNotNull()


def zero_if_blank(c: Column) -> Column:
    return F.coalesce(money(c), F.lit(0).cast("decimal(18,2)"))


def truthy(c: Column, default: bool = False) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s.isin("y", "yes", "true", "1"))


def whole(c: Column) -> Column:
    return c.try_cast("decimal(38,6)").try_cast("int")


def clean(c: Column) -> Column:
    """Blanks squeezed to one, outer blanks cut."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key(c: Column) -> Column:
    return F.lower(clean(c))


def alnum_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


#: Legal-form words dropped from vendor names.
LEGAL_FORMS = ("inc", "llc", "co", "corp", "ltd", "company", "incorporated", "limited")


def vendor_key(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS)), " ")


#: Words that carry no meaning in transaction descriptions.
STOP_WORDS = ("the", "and", "for", "inc", "llc", "ltd", "co", "corp", "company", "payment", "pmt", "ach", "deposit", "withdrawal", "transfer", "debit", "credit", "check", "chk", "ref", "no", "id", "to", "from", "of", "on", "trn", "des", "ppd", "ccd")


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of over two characters that are neither stop words nor all digits."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop) & ~w.rlike(r"^\d+$")))
