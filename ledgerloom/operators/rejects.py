"""Loading raw delimited records with an error-recovering parser: typed rows, and located errors apart from them.

Grammar (recursive descent, one procedure a rule):

    text    := record (line-break record)*
    record  := field ("," field)*
    field   := quoted | bare
    quoted  := '"' (char | '""')* '"'       what follows must be "," or the record's end
    bare    := (not "," and not a line break)*

After broken quotes the parser looks for the next line break behind which a record starts that the feed accepts: an anchor.
An anchor is validated by parsing the record there: it has the feed's number of fields and no error of quoting. What lies
between the error and the anchor belongs to the failed record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import BLANK_MONEY, money, whole

#: The column order of the feeds and the columns that hold money.
FEEDS = {
    "entries": ("entry_id", "line_no", "effective_date", "posted_timestamp", "account", "account_name", "debit", "credit", "description", "posted_by", "approved_by", "source", "reversal_of"),
    "invoices": ("invoice_no", "vendor", "invoice_date", "po_no", "po_line", "item", "qty_billed", "unit_price", "extended_amount", "amount_paid", "requester"),
    "aging": ("customer", "invoice_no", "invoice_date", "due_date", "original_amount", "open_balance", "reported_bucket", "terms_days", "customer_type"),
}
#: In the order in which they apply.
REASONS = ("quoting", "column_count", "invalid_value")
MONEY = {"entries": ("debit", "credit"), "invoices": ("extended_amount",), "aging": ("open_balance",)}

_MONEY = re.compile(r"(?:-|--|n/a)?|-?\s*\$?\s*-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?-?|-?\s*\$?\s*-?\.\d+-?|\(\s*\$?\s*(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)\s*\)", re.I)
_BARE, _QUOTED, _BREAK = re.compile(r"[^,\r\n]*"), re.compile(r'(?:[^"]|"")*'), re.compile(r"\r\n|\n|\r")


def is_money_text(text: str) -> bool:
    s = text.strip()
    return bool(_MONEY.fullmatch(s)) and s.count("-") <= (2 if s == "--" else 1)


@dataclass
class Record:
    start: int
    fields: list[str]
    error: str | None = None  # quoting
    at: int = 0  # character of the error
    field: int = 0  # its field, from 1


class Parser:
    """Recursive descent over one text; ``width`` is the number of fields of the feed, None where unknown."""

    def __init__(self, text: str, width: int | None, open_quotes: set[int] | None = None):
        self.text, self.width, self.pos = text, width, 0
        self.open = set() if open_quotes is None else open_quotes  # places of quotes that are never closed

    def parse(self) -> Iterator[Record]:
        while True:
            yield self.record()
            if not (m := _BREAK.match(self.text, self.pos)):
                return
            self.pos = m.end()
            if self.pos == len(self.text):  # a line break that ends the text
                return

    def record(self) -> Record:
        rec = Record(self.pos, [])
        while True:
            begun = self.pos
            value, error = self.quoted() if self.text.startswith('"', self.pos) else self.bare()
            if error is not None:
                rec.error, rec.at, rec.field = "quoting", error, len(rec.fields) + 1
                self.resume(begun)
                return rec
            rec.fields.append(value)
            if not self.text.startswith(",", self.pos):
                return rec
            self.pos += 1

    def bare(self) -> tuple[str, None]:
        m = _BARE.match(self.text, self.pos)
        self.pos = m.end()
        return m[0], None

    def quoted(self) -> tuple[str, int | None]:
        opening = self.pos
        m = _QUOTED.match(self.text, opening + 1)
        self.pos = m.end()
        if self.pos >= len(self.text):
            self.open.add(opening)
            return "", opening  # never closed
        self.pos += 1
        if self.pos < len(self.text) and self.text[self.pos] not in ",\r\n":
            return "", self.pos  # text behind the closing quote
        return m[0].replace('""', '"'), None

    def resume(self, begun: int) -> None:
        """Move to the line break before the next anchor, or to the end.

        A trial reads no further than the feed's fields, and a quote known to stay open is not read again, so that a text is
        searched once however many line breaks follow its broken quote.
        """
        for m in _BREAK.finditer(self.text, begun):
            if m.end() < len(self.text):
                ahead = Parser(self.text, self.width, self.open)
                ahead.pos = m.end()
                rec = ahead.trial()
                if rec is not None and (self.width is None or len(rec.fields) == self.width):
                    self.pos = m.start()
                    return
        self.pos = len(self.text)

    def trial(self) -> Record | None:
        """A record without recovery; null where its quoting is broken or it has more fields than the feed."""
        rec = Record(self.pos, [])
        while self.width is None or len(rec.fields) < self.width:
            quote = self.text.startswith('"', self.pos)
            if quote and self.pos in self.open:
                return None
            value, error = self.quoted() if quote else self.bare()
            if error is not None:
                return None
            rec.fields.append(value)
            if not self.text.startswith(",", self.pos):
                return rec
            self.pos += 1
        return None


def read_records(text: str | None, feed: str | None) -> list[tuple[int, list[str] | None, str | None, int, int]]:
    """(start, fields, reason, field, character) of each record of a text; reason is null and fields are set for valid ones.

    Characters and fields count from 1. A record of the wrong number of fields is located at its end.
    """
    columns = FEEDS.get(feed)
    parser = Parser(text or "", len(columns) if columns else None)
    out = []
    for rec in parser.parse():
        if rec.error:
            out.append((rec.start, None, "quoting", rec.field, rec.at + 1))
        elif columns is None or len(rec.fields) != len(columns):
            out.append((rec.start, None, "column_count", len(rec.fields), parser.pos))
        else:
            bad = next((i for i, name in enumerate(columns) if name in MONEY[feed] and not is_money_text(rec.fields[i])), None)
            out.append((rec.start, rec.fields, None, 0, 0) if bad is None else (rec.start, None, "invalid_value", bad + 1, 0))
    return out


def read_record(text: str | None, feed: str | None) -> tuple[list[str] | None, str | None, int, int]:
    """(fields, reason, field, character) of a text that should hold one record: its first error by REASONS, if it has any."""
    records = read_records(text, feed)
    failed = min((r for r in records if r[2]), key=lambda r: REASONS.index(r[2]), default=None)
    return (None, *failed[2:]) if failed else (records[0][1], None, 0, 0)


PARSED = "line_id long, feed string, record int, start long, fields array<string>, reason string, field_no int, char_no int"


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row for each record of each row of ``lines`` (line_id, feed, raw_text): PARSED.

    ``record`` counts the records of a text from 1 and ``start`` is the place of its first character, from 1. After broken
    quotes parsing resumes at the next anchor, so good records behind a broken one are rows of their own and load. The reason
    is the first that applies of ``quoting``, ``column_count`` and ``invalid_value``; fields is null for failed records. A
    null text is an empty one and an unknown or null feed has no right number of fields, so both fail by ``column_count``.
    Repeated rows are parsed each for itself; further columns are ignored.
    """
    columns = ["line_id", "feed", "record", "start", "fields", "reason", "field_no", "char_no"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t, feed in zip(f["line_id"], f["raw_text"], f["feed"], strict=True):
                feed = feed if isinstance(feed, str) else None
                for k, (start, fields, reason, field, char) in enumerate(read_records(t if isinstance(t, str) else None, feed), 1):
                    out.append((i, feed, k, start + 1, fields, reason, field, char))
            yield pd.DataFrame(out, columns=columns).astype({"line_id": f["line_id"].dtype, "record": "int32", "field_no": "int32", "char_no": "int32"})

    return lines.select("line_id", "feed", "raw_text").mapInPandas(run, PARSED)


def rejected_records(lines: DataFrame) -> DataFrame:
    """(line_id, feed, record, start, reason, field_no, char_no) of each record that can't be loaded."""
    return parse_lines(lines).where("reason is not null").drop("fields")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, feed, reason, field_no, char_no) of the lines with a record that can't be loaded: the first error of the line.

    The reason is the first that applies to any of its records. One row for each row of ``lines`` that fails: its records
    stand together in one task, so that nothing is shuffled.
    """

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t, feed in zip(f["line_id"], f["raw_text"], f["feed"], strict=True):
                feed = feed if isinstance(feed, str) else None
                _, reason, field, char = read_record(t if isinstance(t, str) else None, feed)
                if reason:
                    out.append((i, feed, reason, field, char))
            yield pd.DataFrame(out, columns=["line_id", "feed", "reason", "field_no", "char_no"]).astype({"line_id": f["line_id"].dtype, "field_no": "int32", "char_no": "int32"})

    return lines.select("line_id", "feed", "raw_text").mapInPandas(first, "line_id long, feed string, reason string, field_no int, char_no int")


def load_lines(lines: DataFrame) -> DataFrame:
    """The valid records, typed: line_id, feed, record, a column for each field of the three feeds, null where the feed has none, and ``unread``.

    Money is decimal(18,2), with blank forms null; numbers of lines are int; all else is text, an empty field null. A field
    outside the money columns that a reason covers doesn't fail its record: where it is no number it is null, and ``unread``
    lists its name.
    """
    valid = parse_lines(lines).where("reason is null")
    names = list(dict.fromkeys(c for cols in FEEDS.values() for c in cols))
    amounts = {c for cols in MONEY.values() for c in cols} | {"amount_paid", "original_amount", "qty_billed", "unit_price"}
    out, unread = [F.col("line_id"), F.col("feed"), F.col("record")], []
    for name in names:
        value = F.lit(None).cast("string")
        for feed, cols in FEEDS.items():
            if name in cols:
                value = F.when(F.col("feed") == feed, F.get("fields", F.lit(cols.index(name)))).otherwise(value)
        text = value = F.when(F.trim(value) != "", value)
        if name in amounts:
            text = F.when(~F.lower(F.trim(value)).isin(*BLANK_MONEY), value)
            value = money(text, "decimal(18,6)" if name in ("qty_billed", "unit_price") else "decimal(18,2)")
        elif name in ("line_no", "po_line", "terms_days"):
            value = whole(value)
        if value is not text:
            unread.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        out.append(value.alias(name))
    return valid.select(*out, F.filter(F.array(*unread), lambda x: x.isNotNull()).alias("unread"))
