"""Text predicates and transformations, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SSN = r"\b\d{3}-\d{2}-\d{4}\b"

#: Descriptions that say nothing by themselves.
GENERIC = (
    "adjustment", "adjusting entry", "adj", "reclass", "reclassification", "plug", "to balance", "balance", "per client", "per discussion", "as discussed", "correction", "correcting entry", "true up", "true-up", "trueup", "misc", "miscellaneous", "see attached", "do not reverse", "dnr", "per management",
    "to agree", "to tie", "catch up", "catch-up", "cleanup", "clean up", "entry", "journal entry", "je", "monthly", "month end", "month-end", "accrual", "reverse",
)


def any_word(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of ``words`` anywhere, in any case; a null text holds none."""
    return F.coalesce(F.lower(c).rlike("|".join(map(re.escape, words))), F.lit(False))


def first_rule(c: Column, rules: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The name of the first rule one of whose words the text holds."""
    out = None
    for name, words in rules.items():
        out = F.when(any_word(c, words), name) if out is None else out.when(any_word(c, words), name)
    return out.otherwise(F.lit(default))


def generic_text(c: Column, terms: tuple[str, ...] = GENERIC) -> Column:
    """Whether a description is a generic term and no more than a short number, ``per`` somebody, or at most three characters."""
    s = F.lower(F.trim(c))
    term = "|".join(sorted(map(re.escape, terms), key=len, reverse=True))
    return F.coalesce((s != "") & (s.rlike(rf"^(?:{term})[\s\W]*\d{{0,6}}[\s\W]*$") | s.rlike(r"^per [a-z.\s]{1,18}$") | (F.length(s) <= 3)), F.lit(False))


def mask(c: Column, pattern: str = SSN) -> Column:
    return F.regexp_replace(c, pattern, "***-**-****")


def render(template: str, fields: dict[str, Column]) -> tuple[Column, Column]:
    """(text, complete): the template with its ``{name}`` fields filled; incomplete where a field is missing or null."""
    out, complete = F.lit(template), F.lit(True)
    for name in dict.fromkeys(re.findall(r"\{(\w+)\}", template)):
        value = fields[name].cast("string") if name in fields else F.lit(None).cast("string")
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("{" + name + "}")))
        complete = complete & value.isNotNull()
    return out, complete


def parsed_sum(c: Column, separator: str = ";", kind: str = "decimal(18,2)") -> Column:
    """Sum of the numbers in a delimited cell; null where it has none."""
    parts = F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x).try_cast(kind)), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)")))


def account_key(name: Column) -> Column:
    """An account's name without case, punctuation and a number at its end; ``&`` is ``and``. Null is an empty text."""
    flat = F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit("and")), r"[^a-z0-9]+", " "))
    return F.regexp_replace(flat, r" +\d+$", "")


def payer_key(name: Column) -> Column:
    """A payer's name in lower case without points and commas, blanks squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[.,]", "")), r"\s+", " "))


def number_key(number: Column) -> Column:
    """Letters and digits of a document number, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(number, F.lit(""))), "[^a-z0-9]", "")
