from pyspark.sql import functions as F

from wordloom.operators import replies as R
from wordloom.plans.fixtures import CATALOGUE


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


LETTERS = [
    "Wójt Gminy\nDECYZJA nr 3\nNa podstawie k.p.a. orzekam.\nPouczenie: Od decyzji przysługuje odwołanie w terminie 7 dni od doręczenia.",
    "Sąd Rejonowy\nWyrok zaoczny\nWzywa się. Zgodnie z k.p.c. oddala.\nPouczenie\nMożna wnieść sprzeciw w terminie dwutygodniowym.",
    "Decyzja\nDecyzja jest ostateczna. Odwołanie nie przysługuje, bo decyzja jest ostateczna.",
    "Zwykły list.", "", None,
]


def test_letter_kind(spark):
    got = {r.doc_id: r for r in R.letter_kind(frame(spark, LETTERS), CATALOGUE).collect()}
    assert (got[0].act, got[0].act_score, got[0].titled, got[0].sender, got[0].sender_score, got[0].procedure, got[0].cited) == ("decyzja", 5 + 3 + 3, True, "gmina", 6, "kpa", 1)
    assert (got[1].act, got[1].titled, got[1].sender, got[1].procedure) == ("wyrok_zaoczny", True, "sad", "kpc")
    assert all((got[i].act, got[i].sender, got[i].procedure, got[i].titled) == (None, None, None, False) for i in (3, 4, 5))


def test_offered(spark):
    got = {}
    for r in R.offered(frame(spark, LETTERS), CATALOGUE).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.reply, r.from_instruction, r.term_value, r.term_unit, r.term_source, r.conflict, r.confidence))
    assert got[0] == [("odwolanie", True, 7, "day", "instruction", True, "high"), ("wniosek_ogolny", False, None, None, "", False, "high")]
    assert got[1][0] == ("sprzeciw", True, 2, "week", "instruction", False, "high")
    assert [x[0] for x in got[2]] == ["wniosek_ogolny"] and got[2][0][-1] == "middle"
    assert all(got[i] == [("wniosek_ogolny", False, None, None, "", False, "low")] for i in (3, 4, 5))


def test_terms(spark):
    windows = ["w terminie 14 dni od", "W ciągu dwudziestu jeden dni", "w terminie 10-dniowym", "w terminie miesięcznym", "w ciągu tygodnia", "w terminie późniejszym", "w terminie 99999999999 dni", None]
    rows = spark.createDataFrame([(w,) for w in windows], "w string").select(R.term(F.col("w")).alias("t")).collect()
    assert [tuple(r.t) if r.t else None for r in rows] == [(14, "day"), (21, "day"), (10, "day"), (1, "month"), (1, "week"), None, None, None]
