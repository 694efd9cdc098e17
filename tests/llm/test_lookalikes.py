import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.lookalikes import COLUMN, Decoder, consistent, look, look_pairs, plain, same_look

BASE = "Office café: Total 24 Москва"
SAME = [BASE, "Oﬃce café: Total 24 Москва", "Оffiсе café: Total 24 Москва", "Ｏffice caf​é: Ｔotal ２4 Моc­квa", "Of⁠fice café: Τοтal".replace("т", "t") + " 24 Москва"]
OTHER = ["Office cafe: Total 24 Москва", "Office café: Total 2⁴ Москва", "Office café: Total 25 Москва", "office café: Total 24 Москва", "Office café: Total 24 Москва."]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")


def test_pairs(spark):
    got = {(r.doc_id_a, r.doc_id_b) for r in look_pairs(docs(spark, SAME + OTHER + [BASE, None, None, "", "​"]), "doc_id", "text").collect()}
    group = [0, 1, 2, 3, 4, 10]
    assert got == {(a, b) for a in group for b in group if a < b} - {(0, 10)}


def test_copies_alone_and_empty_tables(spark):
    assert same_look(docs(spark, [BASE] * 50), "doc_id", "text").count() == 0
    assert look_pairs(docs(spark, []), "doc_id", "text").count() == 0


def test_forms_are_consistent_in_script(spark):
    corpus = ["the cost of peace and copper coax", "старая оценка и расход в отчёте", "cоst ореn", "рaсход oтчёт", None, ""]
    forms = {r.doc_id: r.form for r in consistent(docs(spark, corpus), "doc_id", "text").collect()}
    assert len(forms) == 6 and forms[0] == corpus[0] and forms[1] == corpus[1] and forms[2] == "cost open" and forms[3] == "расход отчёт" and forms[4] is None and forms[5] == ""


ORIGINALS = [
    "the board approved the cost of repair for every office copier in October", "please post the accrual of freight charges before the close of the period", "Счёт оплачен полностью, остаток перенесён на следующий месяц", "Расходы по проекту выше сметы, поэтому отчёт вернули главному бухгалтеру",
    "Der Betrag für Büromöbel wurde im März geprüft und gebucht", "La facture du fournisseur était déjà réglée à la fin du trimestre",
]


def test_planted_look_alikes_are_undone_by_the_path(spark):
    rng = random.Random(3)
    planted = ["".join(rng.choice(COLUMN[c])[0] if c in COLUMN and rng.random() < 0.3 else c for c in t) for t in ORIGINALS]
    assert all(p != t and plain(p) != plain(t) for p, t in zip(planted, ORIGINALS, strict=True))  # nothing but the lattice makes them equal
    forms = {r.doc_id: r.form for r in consistent(docs(spark, ORIGINALS * 3 + planted), "doc_id", "text").collect()}
    assert [forms[18 + i] for i in range(6)] == [unicodedata.normalize("NFC", t) for t in ORIGINALS]
    pairs = {(r.doc_id_a, r.doc_id_b) for r in look_pairs(docs(spark, ORIGINALS + planted), "doc_id", "text").collect()}
    assert pairs == {(i, i + 6) for i in range(6)}


def test_phonetic_letters_and_words_between_scripts():
    decode = Decoder({})
    assert decode("sɑme ɡap") == "same gap" and decode("cор") == "cop" and decode("é" + "ɑ" * 50) == "é" + "a" * 50
    assert decode("с ценой") == "с ценой" and decode("c ценой") == "с ценой"  # a lone letter follows the text's script


def test_long_text():
    assert Decoder({})("a" * 500_000) is not None and Decoder({})("é" + "о" * 200_000) == "é" + "o" * 200_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_looks_settle(text):
    decode = Decoder({})
    form = decode(text)
    assert look(look(text)) == look(text) and decode(form) == form
