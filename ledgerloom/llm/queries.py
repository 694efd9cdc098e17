"""Queries of the operators of this package over the test tables, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.duplicates import collapse, copies
from ledgerloom.llm.leakage import cleaned, leaks
from ledgerloom.llm.lookalikes import consistent, look_pairs, same_look
from ledgerloom.llm.mirror_legs import match_legs
from ledgerloom.llm.mixing import document_uses, mix
from ledgerloom.llm.names import parties, spelling_pairs
from ledgerloom.runtime import forget, stored, table

INVOICE_TEXTS = ["invoice_no", "vendor", "invoice_date", "po_no", "item", "requester", "source"]
INVOICE_NUMBERS = ["po_line", "qty_billed", "unit_price", "amount_paid"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_legs(table(spark, sf_dir, "ic_transactions")).select("leg_id_a", "leg_id_b")


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of legs with the rule that found it and its confidence."""
    return match_legs(table(spark, sf_dir, "ic_transactions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "invoices"), "row_id", INVOICE_TEXTS, INVOICE_NUMBERS, "extended_amount")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice line with the number of its copies."""
    return collapse(table(spark, sf_dir, "invoices"), "row_id", INVOICE_TEXTS, INVOICE_NUMBERS, "extended_amount")[0].select("first_row_id", "copies")


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "invoices").select("vendor").unionAll(table(spark, sf_dir, "pos").select("vendor")).unionAll(table(spark, sf_dir, "aging").select("customer"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(typed_names(spark, sf_dir), "vendor")


def p5_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its party."""
    return parties(typed_names(spark, sf_dir), "vendor")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in each document which item leaked, and how much of it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the leaked passages."""
    return cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of each source and the share of all tokens it reaches."""
    chosen, pieces, report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    report = stored(report, "report")
    forget(chosen, pieces)
    return report


def p9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: what block fills each slot of each shard."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return document_uses(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[:2])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that looks like a differing one, with the least document of its class."""
    docs = same_look(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("same_as").alias("look"))
    return docs.join(docs.groupBy("look").agg(F.min("doc_id").alias("same_as")), "look").select("doc_id", "same_as")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return consistent(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p1_found, p1_confidence, p2_found, p2_records, p5_found, p5_parties, p8_found, p8_spans, p8_cleaned, p9_mix, p9_slots, p9_documents, p10_found, p10_classes, p10_forms)}


def _copies_sql() -> str:
    text = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"
    number = lambda c: f"coalesce(CASE WHEN contains(CAST({c} AS VARCHAR), '.') THEN regexp_replace(CAST({c} AS VARCHAR), '\\.?0+$', '') ELSE CAST({c} AS VARCHAR) END, '')"
    amount = "CASE WHEN regexp_full_match(extended_amount, '[-\\s$(]*[0-9][0-9,]*(\\.[0-9]*)?[-)\\s]*') THEN (CASE WHEN regexp_matches(extended_amount, '[-(]') THEN -1 ELSE 1 END * CAST(regexp_replace(extended_amount, '[^0-9.]', '', 'g') AS DECIMAL(18,2)))::DECIMAL(18,2)::VARCHAR ELSE " + text("extended_amount") + " END"
    fields = ", ".join([text(c) for c in INVOICE_TEXTS] + [number(c) for c in INVOICE_NUMBERS])
    amount = f"CASE WHEN contains({amount}, '.') THEN regexp_replace({amount}, '\\.?0+$', '') ELSE {amount} END"
    return f"WITH c AS (SELECT row_id, list_sort([{fields}, {amount}]) AS k FROM invoices), f AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS first_row_id FROM c) SELECT first_row_id, row_id AS copy_row_id FROM f WHERE row_id <> first_row_id"


def _looks_sql(select: str) -> str:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    # Written down here once more, by code point, so that the SQL shares no table with the operator.
    alike = {"A": "0410 0391", "B": "0412 0392", "C": "0421", "E": "0415 0395", "H": "041D 0397", "I": "0406 0399", "J": "0408", "K": "041A 039A", "M": "041C 039C", "N": "039D", "O": "041E 039F", "P": "0420 03A1", "S": "0405", "T": "0422 03A4", "X": "0425 03A7", "Y": "03A5 0423", "Z": "0396",
             "a": "0430", "c": "0441", "d": "0501", "e": "0435", "h": "04BB", "i": "0456", "j": "0458", "o": "043E 03BF", "p": "0440", "q": "051B", "s": "0455", "v": "03BD", "w": "051D", "x": "0445", "y": "0443"}
    others = [(chr(int(code, 16)), latin) for latin, codes in alike.items() for code in codes.split()]
    tables = [(wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)), ("".join(a for a, _ in others), "".join(b for _, b in others))]
    form = "regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g')"
    form = f"regexp_replace({form}, '[\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    for joined, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        form = f"replace({form}, '{joined}', '{letters}')"
    for a, b in tables:
        form = f"translate({form}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"WITH f AS (SELECT doc_id, text, nfc_normalize({form}) AS form FROM documents WHERE trim(text) <> '') {select}"


def _records_sql() -> str:
    return _copies_sql().partition(" SELECT first_row_id")[0] + " SELECT first_row_id, count(*) AS copies FROM f GROUP BY 1"


_PAIRS = "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
_CLASSES = "SELECT doc_id, same_as FROM f JOIN (SELECT form, min(doc_id) AS same_as FROM f GROUP BY 1 HAVING count(DISTINCT text) > 1) USING (form)"

SQL = {"p2_found": _copies_sql(), "p2_records": _records_sql(), "p10_found": _looks_sql(_PAIRS), "p10_classes": _looks_sql(_CLASSES)}
