"""Expectations written by hand for checks, catalogues, run summaries and modality."""

import datetime as dt
import json

from pyspark.sql import functions as F
from wordloom.operators import corpus, detect, features, legal, outcomes, reports, rewrite, structure
from wordloom.sources import readers


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_signed_modality(spark):
    texts = ["Najemca musi płacić.", "Najemca nie musi płacić.", "Najemca może wejść.", "Najemca nie może wejść.", "Nie należy płacić.", "Najemca nie tylko musi płacić.", "", None]
    got = [(r.prohibitions, r.permissions, r.obligations) for r in features.signed_modality(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(0, 0, 1), (0, 1, 0), (0, 1, 0), (1, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0)]


def test_roman_numbers_and_units(spark):
    got = spark.createDataFrame([(n,) for n in ("I", "IV", "IX", "XIV", "XL", "XC", "CXLIX")], "n string").select(structure.roman(F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [1, 4, 9, 14, 40, 90, 149]
    d = frame(spark, ["I. a\nII. b\nIV. c\nIV. d\nIII. e", "1. a\n2) b\n5. c\nzwykły wiersz"])
    assert sorted((r.doc_id, r.raw, r.expected, r.issue) for r in structure.unit_issues(d, "roman").collect()) == [(0, "III", 5, "repeat"), (0, "IV", 3, "gap"), (0, "IV", 5, "repeat")]
    assert [(r.raw, r.expected, r.issue) for r in structure.unit_issues(d, "arabic").collect()] == [("5", 3, "gap")]


def test_protected_terms_and_entries(spark):
    terms = {"art nr": True, "kwota zł": True, "k c": True, "dom w": False, "nie może": True, "piękny dom": False, "maja": True}
    got = {r.term: r.protected for r in corpus.protected(spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == terms
    rows = [("a", "word", "accepted", "", False), ("b", "x", "accepted", "", False), ("c", "word", "y", "", False), ("d", "word", "accepted", "", True), ("e", "bigram", "rejected", " ", False), ("f", "bigram", "rejected", "seen", True)]
    out = corpus.entry_problems(spark.createDataFrame(rows, "term string, kind string, status string, note string, protected boolean")).collect()
    assert {r.term: r.problem for r in out} == {"b": "unknown kind", "c": "unknown status", "d": "a protected term is accepted", "e": "rejected without a reason"}


def test_document_check(spark):
    good = "§ 1. Przedmiot umowy\nPrzedmiotem umowy jest lokal przy ulicy Polnej.\n§ 2. Czynsz\nCzynsz wynosi sto złotych za miesiąc.\n§ 3. Wypowiedzenie\nKażda strona może wypowiedzieć umowę.\n§ 4. Kary umowne\nKary umowne wynoszą po sto złotych."
    bad = "§ 2. Czynsz\nnic.\n§ 5. Coś\nWięcej słów bez żadnego znaczenia tutaj."
    got = {r.doc_id: (r.missing_required, r.missing_expected, r.empty, r.numbering, r.order, r.blocking) for r in structure.check_document(frame(spark, [good, bad])).collect()}
    assert got[0] == (0, 0, 0, 0, 0, False) and got[1][:2] == (1, 2) and got[1][3] == 1 and got[1][5]


def test_deadline_status(spark):
    rows = [(1, dt.date(2024, 1, 9)), (2, dt.date(2024, 1, 10)), (3, dt.date(2024, 1, 17)), (4, dt.date(2024, 1, 18)), (5, None)]
    out = legal.deadline_status(spark.createDataFrame(rows, "id long, last_day date"), F.lit("2024-01-10").cast("date")).orderBy("id").collect()
    assert [(r.days_left, r.status) for r in out] == [(-1, "passed"), (0, "today"), (7, "soon"), (8, "open"), (None, "unknown")]


def test_run_summaries(spark):
    columns = "status string, needs_review boolean, unresolved long, warnings long, words long, changes_applied long, findings_before long, findings_after long, signal_before double, signal_after double, model string, backend string, model_segments long, rule_segments long, model_rejections long, model_errors long, risk double, lang string"
    rows = [
        ("ok", False, 0, 0, 100, 2, 5, 1, 0.4, 0.2, "m", "model", 3, 1, 1, 0, 0.3, "en"), ("ok", True, 0, 0, 300, 0, 2, 2, 0.1, 0.1, "", "rules_fallback", 0, 2, 0, 0, 0.9, "de"), ("failed_safety", False, 0, 0, 900, 9, 9, 9, 0.9, 0.9, "x", "model", 1, 1, 1, 1, 0.5, "en"),
    ]
    o = spark.createDataFrame(rows, columns)
    f = outcomes.flow_summary(o).first()
    assert (f.items, f.ok, f.failed, f.needs_review, f.ready, f.ready_with_warnings, f.words, f.mean_signal_before, f.mean_signal_delta) == (3, 2, 1, 1, 1, 1, 400, 0.25, -0.1)
    a = outcomes.ai_use_summary(o).first()
    assert (a.models, a.documents_with_model_edits, a.model_segments, a.rule_segments, a.model_unavailable) == ("m", 1, 3, 3, 1)
    b = outcomes.benchmark_summary(o).first()
    assert (b.runs, b.ok, b.failed_safety, b.changes_applied, b.average_risk) == (3, 2, 1, 11, 0.4)
    e = outcomes.edit_rates(o, "lang", "en", "de").first()
    assert (e.edits_per_1k, e.edits_per_1k_against, e.edit_ratio) == (11.0, 0.0, 1100.0)
    none = outcomes.flow_summary(o.limit(0)).first()
    assert (none.items, none.ok, none.words, none.mean_signal_before) == (0, 0, 0, 0.0)
    s = outcomes.style_statistics(frame(spark, ["Ala ma kota. Ala!", None])).first()
    assert (s.mean_sentence_words, s.type_token_ratio, s.mean_document_words) == (2.0, 0.75, 2.0)


def test_separation(spark):
    d = frame(spark, ["Ponadto tak jest. Ponadto nie."] * 2 + ["Z jednej strony tak jest zawsze."] * 2 + ["Nic tu nie ma."])
    got = {r.rule: (r.model_rate, r.human_rate) for r in outcomes.separation(d, F.col("doc_id") < 2).collect()}
    assert got == {"drop_repetitive_transition": (400.0, 0.0)}


def test_manifest_and_markdown(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("Ala", encoding="utf-8")
    (tmp_path / "m.json").write_text(json.dumps([{"id": "2", "file": "b.txt"}, {"id": "1", "file": "a.txt"}]), encoding="utf-8")
    out = readers.manifest(spark, str(tmp_path / "m.json"), str(tmp_path / "texts")).collect()
    assert [(r.id, r.text) for r in out] == [("1", "Ala"), ("2", None)]
    text = reports.markdown(spark.createDataFrame([("a|b", 2), (None, 1)], "name string, n int"), "Review").first().text
    assert text.split("\n") == ["# Review", "", "| name | n |", "| --- | --- |", "|  | 1 |", "| a\\|b | 2 |"]


def test_slop_ngrams(spark):
    d = frame(spark, ["— Każda, strona płaci. Tak każda strona płaci.", "Ponadto najemca: płaci czynsz. Najemca płacił.", "Podsumowując zawsze tak."])
    got = sorted((r.doc_id, r.sentence_index, r.rule, r.start, r.end, r.evidence) for r in detect.slop_ngrams(d, [("opening_2", "każda strona"), ("bigram", "najemca płaci"), ("word", "podsumowując")]).collect())
    assert got == [(0, 0, "slop.opening_2.każda_strona", 2, 15, "Każda, strona"), (1, 0, "slop.bigram.najemca_płaci", 8, 22, "najemca: płaci")]


def test_style_profile_needs_five_of_a_kind(spark):
    texts = ["Umowa najmu: strony i najemca."] * 5 + ["Regulamin."]
    r = outcomes.style_profile(frame(spark, texts)).first()
    assert (r.kind, r.documents, r.excluded, r.mean_document_words, r.warned) == ("contract", 5, 1, 5.0, False)
    assert outcomes.style_profile(frame(spark, texts[:4])).count() == 0


def test_cascade(spark):
    t = spark.createDataFrame([(7, "ala ma kota i psa w domu")], "item_id long, text string")
    d = frame(spark, ["Ala ma kota i psa w domu", "Najem lokalu: najemca płaci czynsz za lokal, najem trwa.", "ala ma kota oraz rybki", "nic"])
    assert [(r.category, r.by) for r in structure.classify_cascade(d, t).orderBy("doc_id").collect()] == [("template:7", "template"), ("umowa_najmu", "signals"), ("template:7", "template_share"), ("nieokreslony", "none")]


def test_scores_by_hand(spark):
    rows = [
        ("Ala ma kota.", "Ala  ma kota.".replace("  ", " "), "cleanup:spacing", 0.1, 0.0),  # equal length and low risk: 0.1 + 0.05
        ("Ala ma psa i kota oraz rybę.", "Ala.", "split_long", 0.5, 0.1),  # bonus 0.025, risk 0.1 + 0.12, penalty 0.08 + 0.06
        ("Zob. art. 5 umowy.", "Zob. art. 6 umowy.", "legal_style:x", 0.6, 0.05),  # 0.05 gain; 0.05 + 0.015 + 0.02 + 0.18 risk
    ]
    d = spark.createDataFrame(rows, "original string, candidate string, rule string, score double, risk double")
    got = {r.rule: (round(r.gain, 4), round(r.total_risk, 4), round(r.penalty, 4), r.final) for r in rewrite.scored(d).collect()}
    assert got == {"cleanup:spacing": (0.05, 0.0, 0.0, 0.15), "split_long": (0.025, 0.22, 0.14, 0.165), "legal_style:x": (0.05, 0.265, 0.0, 0.385)}
