"""SQL that reads the test tables' layouts of days and stamps, for the queries beside it; written apart from the operator."""

from __future__ import annotations

#: Seconds east of Greenwich of the zone names that stamps end in.
OFFSETS = {"UTC": 0, "GMT": 0, "BST": 3600, "CET": 3600, "CEST": 7200, "IST": 19800, "JST": 32400, "AEST": 36000, "AEDT": 39600, "EST": -18000, "EDT": -14400, "PST": -28800, "PDT": -25200}

SYSTEMS = "(SELECT source, min(tz_name) AS tz, min(date_order) AS o FROM source_systems GROUP BY 1)"


def _slashed(t: str, time: str) -> str:
    """Day and month in the order ``o``; years of two or four digits."""
    flat = f"replace({t}, '.', '/')"
    read = lambda form: f"CASE WHEN o = 'DMY' THEN try_strptime({flat}, '%d/%m/{form}{time}') ELSE try_strptime({flat}, '%m/%d/{form}{time}') END"
    return f"CASE WHEN regexp_matches({t}, '^\\d+[/.]\\d+[/.]\\d{{4}}') THEN {read('%Y')} ELSE {read('%y')} END"


def day_sql(c: str) -> str:
    """The day of a text ``c`` whose source has the order ``o``; null where it can't be read."""
    t = f"trim({c})"
    like = lambda p: f"regexp_full_match({t}, '{p}')"
    return (
        f"CASE WHEN {like('\\d{5}')} THEN DATE '1899-12-30' + CAST({t} AS INTEGER) WHEN {like('\\d{8}')} THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) WHEN {like('\\d{4}-\\d\\d-\\d\\d.*')} THEN try_cast(left({t}, 10) AS DATE) WHEN {like('\\d{4}/.*')} THEN CAST(try_strptime({t}, '%Y/%m/%d') AS DATE)"
        f" WHEN {like('\\d{1,2}-[A-Za-z]{3}-\\d{4}')} THEN CAST(try_strptime({t}, '%d-%b-%Y') AS DATE) WHEN {like('[A-Za-z]{3} \\d{1,2}, \\d{4}')} THEN CAST(try_strptime({t}, '%b %d, %Y') AS DATE) WHEN {like('\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4}')} THEN CAST({_slashed(t, '')} AS DATE) END"
    )


def stamps_sql(rows: str) -> str:
    """(key columns, utc) of ``rows`` (..., raw, tz, o): the instant of each stamp, seconds whole.

    A local time that occurs twice is the first of both; a skipped one has the offset before the change.
    """
    t = "trim(raw)"
    like = lambda p: f"regexp_full_match({t}, '{p}')"
    local = (
        f"CASE WHEN {like('\\d{14}')} THEN try_strptime({t}, '%Y%m%d%H%M%S') WHEN {like('\\d{4}[-/]\\d\\d[-/]\\d\\d.*')} THEN try_strptime(replace(replace(replace(left({t}, 19), '/', '-'), 'T', ' '), '.', ':'), '%Y-%m-%d %H:%M:%S')"
        f" WHEN {like('[A-Za-z]{3}, .*')} THEN try_strptime(substr({t}, 6, 20), '%d %b %Y %H:%M:%S') WHEN {like('\\d{1,2}-[A-Za-z]{3}-.*M')} THEN try_strptime({t}, '%d-%b-%Y %I:%M %p') WHEN {like('\\d{1,2}/\\d{1,2}/\\d{2,4} .*')} THEN {_slashed(t, ' %H:%M')} END"
    )
    epoch = f"CASE WHEN {like('\\d{10}')} THEN make_timestamp(try_cast({t} AS BIGINT) * 1000000) WHEN {like('\\d{13}')} THEN date_trunc('second', make_timestamp(try_cast({t} AS BIGINT) * 1000)) END"
    names = " ".join(f"WHEN '{k}' THEN {v}" for k, v in OFFSETS.items())
    offset = f"CASE WHEN regexp_matches(z, '^[-+]') THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 3600 + CAST(right(z, 2) AS INTEGER) * 60) ELSE CASE z WHEN 'Z' THEN 0 {names} END END"
    zone = f"regexp_extract({t}, ':\\d\\d(?:\\.\\d+)?\\s*(Z|[-+]\\d\\d:?\\d\\d|[A-Z]{{3,4}})$', 1)"
    return (
        f"SELECT *, coalesce(epoch_at, CASE WHEN z <> '' THEN loc - to_seconds(off) WHEN timezone(tz, u - INTERVAL 1 HOUR) = loc THEN timezone('UTC', u - INTERVAL 1 HOUR) ELSE timezone('UTC', u) END) AS utc FROM (SELECT *, timezone(tz, loc) AS u, {offset} AS off FROM (SELECT *, {local} AS loc, {epoch} AS epoch_at, {zone} AS z FROM {rows}))"
    )


_DAYS = (("je_entries", "line_id", "effective_date"), ("invoices", "row_id", "invoice_date"), ("po_receipts", "row_id", "receipt_date"))


def _all_sql() -> str:
    days = " UNION ALL ".join(f"SELECT '{t}.{c}' AS src, {k} AS row_id, {c} AS raw, CAST({day_sql(c)} AS VARCHAR) AS norm FROM {t} LEFT JOIN {SYSTEMS} USING (source)" for t, k, c in _DAYS)
    stamps = stamps_sql(f"(SELECT line_id, posted_timestamp AS raw, tz, o FROM je_entries LEFT JOIN {SYSTEMS} USING (source))")
    return f"WITH s AS ({stamps}), a AS (SELECT 'je_entries.posted_timestamp' AS src, line_id AS row_id, raw, strftime(utc, '%Y-%m-%dT%H:%M:%SZ') AS norm FROM s UNION ALL {days})"


def found_sql() -> str:
    return _all_sql() + " SELECT src, row_id, norm FROM a WHERE norm IS NOT NULL AND norm <> raw"


def states_sql() -> str:
    return _all_sql() + " SELECT src, CASE WHEN raw IS NULL THEN 'missing' WHEN norm IS NULL THEN 'unreadable' WHEN norm = raw THEN 'as_is' ELSE 'normalised' END AS state, count(*) AS n FROM a GROUP BY 1, 2"
