"""Blocks of hand-made templates, one for each state of the classifier."""

import pytest
from wordloom.operators import layout as L


def made(spark, *texts):
    return L.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def roles(spark, text):
    return [(r.p, r.role) for r in made(spark, text).orderBy("p").collect()]


@pytest.mark.parametrize("text,want", [
    ("w terminie …. dni", [(11, 13, "blank")]),
    ("kwota .... zł i ________", [(6, 10, "blank"), (16, 24, "blank")]),
    ("k.p. i r. oraz ... koniec", []),
    ("kod ..-… tu", [(4, 8, "blank")]),
    ("......  .... dalej", [(0, 12, "blank")]),
    ("......     .... dalej", [(0, 6, "blank"), (11, 15, "blank")]),
    ("nr: .. .... ....", [(4, 16, "blank")]),
    ("[wpisz datę] i [proszę uzupełnij]", [(0, 12, "placeholder"), (15, 33, "placeholder")]),
    ("a) …", [(3, 4, "blank")]),
    ("…", [(0, 1, "blank")]),
    ("", []),
])
def test_blanks(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(L.blanks(L.F.col("t")).alias("b")).first().b
    assert [(x.start, x.end, x.kind) for x in got] == want


def test_roles_by_hand(spark):
    text = "\n".join([
        "UMOWA NAJMU", "§ 1. Przedmiot", "zawarta pomiędzy:", "………………", "(imię i nazwisko)", "zwanym dalej Najemcą", "a", "Adres: ………………", "1. Czynsz wynosi …… zł", "", "Dane osobowe:", "[dzień/miesiąc]", "(należy opisać powód zgodnie z art. 5 ustawy)",
        "(………)", "…………\t…………", "Wynajmujący\t\tNajemca",
    ])
    assert roles(spark, text) == list(enumerate(["body", "clause_heading", "field_header", "blank_line", "hint", "party_alias", "party_connector", "field", "item", "spacer", "field_header", "hint", "hint", "body", "signature_line", "body"]))
    rows = {r.p: r for r in made(spark, text).collect()}
    assert (rows[4].hint_for, rows[4].hint_kind, rows[3].hint, rows[5].alias, rows[7].field_label) == (3, "label", ["imię i nazwisko"], "Najemcą", "Adres")
    assert rows[12].hint_kind == "instruction" and rows[1].label_fmt == "paragraph" and rows[8].label == "1."


def test_captions_over_lines_and_notes_with_lists(spark):
    text = "Uzasadnienie: ………\n(dane pracodawcy, adres lub\nokreślenie firmy, numer)\nDalej ………\n(należy uzasadnić, np.:\n- brak środków\n- choroba\n1. Punkt z …… kropkami"
    assert [r for _, r in roles(spark, text)] == ["field", "hint", "hint", "body", "hint", "hint", "hint", "item"]
    rows = {r.p: r for r in made(spark, text).collect()}
    assert rows[0].hint == ["dane pracodawcy, adres lub określenie firmy, numer"] and rows[1].hint_for == 0


def test_optional_blanks_and_what_they_continue(spark):
    text = "UZASADNIENIE\nNiniejszy wniosek motywuję tym, że ……\n………………\n………………\n(nie jest obowiązkowe)\nKoniec pisma bez pól."
    assert [(r.p, r.optional) for r in made(spark, text).orderBy("p").collect()] == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False)]
    beside = made(spark, "Pełnomocnik …………… (jeżeli dotyczy)\nStrona …………… (imię)").orderBy("p").collect()
    assert [(r.optional, [c.value for c in r.inline]) for r in beside] == [(True, ["jeżeli dotyczy"]), (False, ["imię"])]


def test_alternatives(spark):
    got = {r.p: r.alternatives for r in made(spark, "najem na …… dni / …… miesięcy / czas nieoznaczony\n(dzień/miesiąc/rok) ……\na / b / c").collect()}
    assert got == {0: 3, 1: 0, 2: 0}


def test_slots_have_types_names_and_contexts(spark):
    text = "\n".join([
        "Kraków, dnia …… r.", "Imię i nazwisko: ……………", "………………", "(PESEL)", "Czynsz wynosi …… zł (słownie: ……)", "Dane najemcy:", "………………", "w [miejscowość] ………", "data ……/……/…… r.", "§ 9. Podpisy", "…………\t…………", "Wynajmujący\t\tNajemca",
    ])
    rows = [(r.p, r.k, r.type, r.id) for r in L.slots(made(spark, text)).orderBy("p", "k").collect()]
    assert rows == [
        (0, 0, "date", "p0_1"), (1, 0, "person", "imie_i_nazwisko"), (2, 0, "pesel", "pesel"), (4, 0, "text", "p4_1"), (4, 1, "amount", "p4_2"), (6, 0, "text", "dane_najemcy"), (7, 0, "place", "miejscowosc"),
        (8, 0, "date", "p8_1"), (8, 1, "date", "p8_2"), (8, 2, "date", "p8_3"), (10, 0, "signature", "p10_1"), (10, 1, "signature", "p10_2"),
    ]
    assert {r.p: r.context for r in L.slots(made(spark, text)).where("k = 0").collect()}[4] == "Czynsz wynosi ▢ zł"


def test_equal_names_are_counted_and_closings_sign(spark):
    got = [(r.id, r.type) for r in L.slots(made(spark, "Adres: ……………\nAdres: ……………\nZ poważaniem\n……………………")).orderBy("p").collect()]
    assert got == [("adres", "address"), ("adres_2", "address"), ("p3_1", "signature")]


def test_documents_stay_apart_and_empty_ones_have_a_line(spark):
    docs = spark.createDataFrame([(None, "(imię)"), (None, "………"), (5, "………"), (5, "(imię)"), (6, None), (7, "")], "doc_id long, text string")
    out = L.blocks(docs).collect()
    assert len(out) == 6 and len({r.row for r in out}) == 6 and all(r.hint_for is None and r.hint is None for r in out) and sum(r.role == "spacer" for r in out) == 2
    assert L.blocks(docs.where("doc_id = 99")).count() == 0
