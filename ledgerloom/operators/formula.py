"""Arithmetic over named columns, parsed into a column expression and never evaluated as code."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


def formula(text: str, columns: dict[str, Column]) -> Column:
    """Decimal value of ``text``: + - * / and parentheses over names and numbers. A division by zero is null."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable formula at {at}: {text!r}")
        tokens.append(m.groups())
        at = m.end()
    tokens.append((None, None, None))
    place = 0

    def next_is(*signs: str) -> str | None:
        nonlocal place
        if tokens[place][2] in signs:
            place += 1
            return tokens[place - 1][2]
        return None

    def atom() -> Column:
        nonlocal place
        number, name, _ = tokens[place]
        if next_is("-"):
            return -atom()
        if next_is("+"):
            return atom()
        if next_is("("):
            inner = total()
            if not next_is(")"):
                raise ValueError(f"a parenthesis isn't closed: {text!r}")
            return inner
        place += 1
        if number is not None:
            return F.lit(Decimal(number))
        if name is not None:
            if name not in columns:
                raise ValueError(f"unknown name {name!r}")
            return columns[name]
        raise ValueError(f"something is missing: {text!r}")

    def product() -> Column:
        out = atom()
        while sign := next_is("*", "/"):
            other = atom()
            out = out * other if sign == "*" else F.try_divide(out, other)
        return out

    def total() -> Column:
        out = product()
        while sign := next_is("+", "-"):
            other = product()
            out = out + other if sign == "+" else out - other
        return out

    out = total()
    if tokens[place] != (None, None, None):
        raise ValueError(f"unreadable formula: {text!r}")
    return out
