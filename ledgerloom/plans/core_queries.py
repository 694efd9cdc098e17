"""Queries of the general data-preparation problems over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.diff import FILING_FIELDS, diff_copies, diff_filings, filing_key
from ledgerloom.operators.hierarchy import descendants, hierarchy, other_parents
from ledgerloom.operators.instants import TARGET, dictionary, normalise
from ledgerloom.operators.rejects import load_lines, parse_lines, rejected_lines
from ledgerloom.plans.instants_sql import SYSTEMS, found_sql, states_sql
from ledgerloom.runtime import shared_dir, table

STAMPS = (("je_entries", "line_id", "posted_timestamp", "stamp"), ("je_entries", "line_id", "effective_date", "date"), ("invoices", "row_id", "invoice_date", "date"), ("po_receipts", "row_id", "receipt_date", "date"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_filings(table(spark, sf_dir, "version_a"), table(spark, sf_dir, "version_b")).select(F.col("key").alias("field_id"), "diff")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing cells of either copy by kind of difference."""
    found = diff_filings(table(spark, sf_dir, "version_a"), table(spark, sf_dir, "version_b"))
    return found.groupBy("diff").agg(F.count("*").alias("fields"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of any kind, numbers of equal rows included, with how many rows of either copy differ."""
    a, b = table(spark, sf_dir, "version_a"), table(spark, sf_dir, "version_b")
    found = diff_copies(a, b, filing_key(F.col("field_id")), FILING_FIELDS, multiplicity=True).where("diff = 'count'")
    return found.select(F.col("key").alias("field_id"), "cells_a", "cells_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy(table(spark, sf_dir, "totals_map"), F.col("total_field_id"), F.col("component_field_id"))
    return found.select(F.col("node").alias("field_id"), F.col("root").alias("root_field_id"), "depth")


def p4_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_found with a dozen fragments at the first level, so that small tables, too, go through several."""
    links = table(spark, sf_dir, "totals_map")
    found = hierarchy(links, F.col("total_field_id"), F.col("component_field_id"), fragment=links.count() // 12 + 1)
    return found.select(F.col("node").alias("field_id"), F.col("root").alias("root_field_id"), "depth")


def p4_other_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to further totals of a component that already hangs under one."""
    return other_parents(table(spark, sf_dir, "totals_map"), F.col("total_field_id"), F.col("component_field_id"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of each field from its topmost total; null on or beneath a circle."""
    found = hierarchy(table(spark, sf_dir, "totals_map"), F.col("total_field_id"), F.col("component_field_id"), paths=True)
    return found.select(F.col("node").alias("field_id"), F.array_join("path", " > ").alias("path"), "depth")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field beneath each total, with the number of steps."""
    found = descendants(table(spark, sf_dir, "totals_map"), F.col("total_field_id"), F.col("component_field_id"))
    return found.select(F.col("ancestor").alias("field_id"), F.col("descendant").alias("below_field_id"), "distance")


def stamp_values(spark: SparkSession, sf_dir: str, only_open: bool) -> DataFrame:
    """(src, row_id, kind, raw, zone, date_order) of every stamp and date; only_open: without those already in their target form."""
    systems = table(spark, sf_dir, "source_systems").groupBy("source").agg(F.first("tz_name").alias("zone"), F.first("date_order").alias("date_order"))
    parts = []
    for name, row_id, column, kind in STAMPS:
        rows = table(spark, sf_dir, name)
        if only_open:
            rows = rows.where(F.col(column).isNotNull() & ~F.col(column).rlike(TARGET[kind]))
        parts.append(rows.select(F.lit(f"{name}.{column}").alias("src"), F.col(row_id).alias("row_id"), F.lit(kind).alias("kind"), F.col(column).alias("raw"), "source"))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionAll(part)
    return values.join(F.broadcast(systems), "source", "left").drop("source")  # source_systems has a fixed number of rows


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(stamp_values(spark, sf_dir, True)).where("norm is not null and norm != raw").select("src", "row_id", "norm")


def p6_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by column whose stamp is missing, unreadable, already in its target form or brought to it."""
    done = normalise(stamp_values(spark, sf_dir, False))
    state = F.when(F.col("raw").isNull(), "missing").when(F.col("norm").isNull(), "unreadable").when(F.col("norm") == F.col("raw"), "as_is").otherwise("normalised")
    return done.groupBy("src", state.alias("state")).agg(F.count("*").alias("n"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on one kept dictionary: the journal's texts, all texts, all texts again; how many each had to parse."""
    folder, runs, held = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", [], 0
    every = stamp_values(spark, sf_dir, False)
    for run, values in enumerate((every.where("src like 'je_entries.%'"), every, every), 1):
        dictionary(values.withColumn("zone", F.when(F.col("kind") == "stamp", F.col("zone"))), kept=folder)
        now = spark.read.parquet(folder).count()
        runs.append((run, now - held, now))
        held = now
    return spark.createDataFrame(runs, "run int, parsed long, held long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p7_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failed line with where and why it failed."""
    return rejected_lines(table(spark, sf_dir, "raw_lines"))


def planted_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of several records a text: each line of raw_lines without quotes and breaks, a line whose quote stays open, and the line again."""
    plain = F.regexp_replace(F.coalesce("raw_text", F.lit("")), '["\r\n]', " ")
    return table(spark, sf_dir, "raw_lines").select("line_id", "feed", F.concat(plain, F.lit('\n"broken,x\n'), plain).alias("raw_text"))


def p7_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a feed with planted breaks: what was lost, and what loads again behind each anchor."""
    return parse_lines(planted_feed(spark, sf_dir)).select("line_id", "record", "start", F.coalesce("reason", F.lit("loaded")).alias("outcome"), F.array_join("fields", "|").alias("fields"))


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines of the three feeds, typed."""
    return load_lines(table(spark, sf_dir, "raw_lines"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p3_copies, p4_found, p4_paths, p4_fragments, p4_other_parents, p4_descendants, p6_found, p6_unreadable, p6_kept, p7_found, p7_errors, p7_recovered, p7_loaded)}

_NUM = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+"


def _diff_sql() -> str:
    strip = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    text = lambda c: f"coalesce({strip.format(c)}, '')"
    number = f"CASE WHEN regexp_full_match({strip.format('value')}, '-?\\$?-?({_NUM})|\\(\\$?({_NUM})\\)') THEN CAST(regexp_replace({strip.format('value')}, '[^0-9.]', '', 'g') AS DECIMAL(38,9)) * CASE WHEN value LIKE '%-%' OR value LIKE '%(%' THEN -1 ELSE 1 END END"
    side = lambda t: f"SELECT DISTINCT upper({strip.format('field_id')}) AS k, {text('form')} AS form, {text('line')} AS line, {text('description')} AS description, coalesce(CAST({number} AS VARCHAR), {text('value')}) AS value, coalesce(CAST(is_carryforward AS VARCHAR), '') AS is_carryforward FROM {t}"
    parts = " UNION ALL ".join(f"SELECT a.k AS field_id, '{c}' AS diff FROM a JOIN b USING (k) GROUP BY a.k HAVING NOT (list_sort(list(DISTINCT a.{c})) = list_sort(list(DISTINCT b.{c})))" for c in ("form", "line", "description", "value", "is_carryforward"))
    return f"WITH a AS ({side('version_a')}), b AS ({side('version_b')}) SELECT DISTINCT k AS field_id, 'only_a' AS diff FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT DISTINCT k, 'only_b' FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL {parts}"


_TREE = """WITH RECURSIVE links AS (SELECT component_field_id AS c, min(total_field_id) AS p FROM totals_map WHERE component_field_id IS NOT NULL GROUP BY 1),
nodes AS (SELECT c AS n FROM links UNION SELECT total_field_id FROM totals_map),
up AS (SELECT n, n AS node, 0 AS d, [n] AS trail, false AS ring FROM nodes
  UNION ALL SELECT up.n, links.p, up.d + 1, list_append(up.trail, links.p), list_contains(up.trail, links.p) FROM up JOIN links ON links.c = up.node WHERE NOT up.ring),
tops AS (SELECT n, node, d, trail FROM up WHERE NOT ring AND node NOT IN (SELECT c FROM links)),
rings AS (SELECT n, list_min(trail[list_position(trail, node):]) AS least FROM up WHERE ring)"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",\\n\\r][^,\\n\\r]*|)'
_COUNTS = {"entries": 13, "invoices": 11, "aging": 9}
_AT = {"entries": (6, 7), "invoices": (8,), "aging": (5,)}
_MONEY = f"(?i)\\s*(?:-|--|n/a|(?:-\\s*\\$?|\\$?\\s*-?)\\s*(?:{_NUM})|\\$?\\s*(?:{_NUM})\\s*-|\\(\\s*\\$?\\s*(?:{_NUM})\\s*\\))?\\s*"


def _rejects_sql(only: bool = True, rows: str = "raw_lines") -> str:
    def value(k: int) -> str:
        return f"regexp_replace(regexp_extract(raw_text, '^(?:{_FIELD},){{{k}}}({_FIELD})', 1), '^\"|\"$', '', 'g')"

    count = " OR ".join(f"feed = '{f}' AND NOT regexp_full_match(raw_text, '{_FIELD}(?:,{_FIELD}){{{n - 1}}}')" for f, n in _COUNTS.items())
    wrong = " OR ".join(f"feed = '{f}' AND NOT regexp_full_match({value(k)}, '{_MONEY}')" for f, ks in _AT.items() for k in ks)
    reason = f"CASE WHEN NOT regexp_full_match(raw_text, '{_FIELD}(?:,{_FIELD})*') THEN 'quoting' WHEN {count} THEN 'column_count' WHEN {wrong} THEN 'invalid_value' END"
    return f"SELECT * FROM (SELECT line_id, {reason} AS reason FROM {rows}) WHERE reason IS NOT NULL" if only else f"SELECT line_id, raw_text, {reason} AS reason FROM {rows}"


_RECOVERED = f"""WITH p AS (SELECT line_id, feed, regexp_replace(coalesce(raw_text, ''), '["\\r\\n]', ' ', 'g') AS raw_text FROM raw_lines), r AS ({_rejects_sql(False, "p")})
SELECT line_id, CAST(1 AS INTEGER) AS record, 1::BIGINT AS start, coalesce(reason, 'loaded') AS outcome, CASE WHEN reason IS NULL THEN replace(raw_text, ',', '|') END AS fields FROM r
UNION ALL SELECT line_id, 2, length(raw_text) + 2, 'quoting', NULL FROM r
UNION ALL SELECT line_id, 3, length(raw_text) + 12, coalesce(reason, 'loaded'), CASE WHEN reason IS NULL THEN replace(raw_text, ',', '|') END FROM r WHERE reason IS NULL OR reason <> 'column_count'"""


_KEPT = f"""WITH v AS (SELECT DISTINCT 's' AS kind, posted_timestamp AS raw, tz, o FROM je_entries LEFT JOIN {SYSTEMS} USING (source) WHERE posted_timestamp IS NOT NULL UNION SELECT 'd', effective_date, NULL, o FROM je_entries LEFT JOIN {SYSTEMS} USING (source) WHERE effective_date IS NOT NULL),
w AS (SELECT * FROM v UNION SELECT 'd', invoice_date, NULL, o FROM invoices LEFT JOIN {SYSTEMS} USING (source) WHERE invoice_date IS NOT NULL UNION SELECT 'd', receipt_date, NULL, o FROM po_receipts LEFT JOIN {SYSTEMS} USING (source) WHERE receipt_date IS NOT NULL), a AS (SELECT (SELECT count(*) FROM v) AS x, (SELECT count(*) FROM w) AS y)
SELECT CAST(1 AS INTEGER) AS run, x AS parsed, x AS held FROM a UNION ALL SELECT 2, y - x, y FROM a UNION ALL SELECT 3, 0, y FROM a"""

SQL = {
    "p6_kept": _KEPT,
    "p6_found": found_sql(),
    "p6_unreadable": states_sql(),
    "p7_found": _rejects_sql(),
    "p7_recovered": _RECOVERED,
    "p3_found": _diff_sql(),
    "p4_found": _TREE + " SELECT n AS field_id, node AS root_field_id, CAST(d AS INTEGER) AS depth FROM tops UNION ALL SELECT n, least, -1 FROM rings",
    "p3_copies": "WITH a AS (SELECT upper(trim(field_id)) AS f, count(*) AS n FROM version_a GROUP BY 1), b AS (SELECT upper(trim(field_id)) AS f, count(*) AS n FROM version_b GROUP BY 1) SELECT f AS field_id, a.n AS cells_a, b.n AS cells_b FROM a JOIN b USING (f) WHERE a.n <> b.n",
    "p4_fragments": _TREE + " SELECT n AS field_id, node AS root_field_id, CAST(d AS INTEGER) AS depth FROM tops UNION ALL SELECT n, least, -1 FROM rings",
    "p4_other_parents": "WITH l AS (SELECT DISTINCT component_field_id AS child, total_field_id AS other FROM totals_map WHERE component_field_id IS NOT NULL AND total_field_id IS NOT NULL) SELECT child, parent, other FROM l JOIN (SELECT child, min(other) AS parent FROM l GROUP BY 1) USING (child) WHERE other <> parent",
    "p3_counts": f"SELECT diff, count(*) AS fields FROM ({_diff_sql()}) GROUP BY 1",
    "p4_paths": _TREE + " SELECT n AS field_id, array_to_string(list_reverse(trail), ' > ') AS path, CAST(d AS INTEGER) AS depth FROM tops UNION ALL SELECT n, NULL, -1 FROM rings",
    "p4_descendants": _TREE + " SELECT up.node AS field_id, up.n AS below_field_id, CAST(up.d AS INTEGER) AS distance FROM up JOIN tops USING (n) WHERE up.d > 0",
}
