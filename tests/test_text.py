import re

from wordloom.functions import patterns as P
from wordloom.operators import metrics
from wordloom.operators import text as T
from wordloom.plans import registry


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences_and_paragraphs(spark):
    d = frame(spark, ["Ala ma kota. Kot śpi!\n\n  \nIle? Tak! nie 3.5 m. Żaba.", None, "", "jedno"])
    got = [(r.doc_id, r.paragraph_index, r.sentence_index, r.text) for r in T.split_sentences(d).orderBy("doc_id", "paragraph_index", "sentence_index").collect()]
    assert got == [(0, 0, 0, "Ala ma kota."), (0, 0, 1, "Kot śpi!"), (0, 1, 0, "Ile?"), (0, 1, 1, "Tak! nie 3.5 m."), (0, 1, 2, "Żaba."), (3, 0, 0, "jedno")]


def test_spans_count_code_points(spark):
    text = "Źle 😀 ten, ten tenor Ten"
    got = spark.createDataFrame([(text,)], "t string").select(P.spans(T.F.col("t"), P.spark_pattern("<ten>")).alias("s")).first().s
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\bten\b", text, re.I)]
    assert [(s.start, s.end, s.value) for s in got] == want


def test_protect_and_restore(spark):
    texts = ["Zgodnie z art. 6 § 2 k.c. oraz § 3 i „art. 7” z 12.03.2021 za 1 500,00 zł w 2020 r.", "bez niczego", "art. 1 i art. 1", ""]
    safe, kept = T.protect(T.F.col("text"))
    rows = frame(spark, texts).select("text", safe.alias("safe"), kept.alias("kept")).select("*", T.restore(T.F.col("safe"), T.F.col("kept")).alias("back")).collect()
    assert all(r.back == r.text for r in rows)
    assert list(rows[0].kept) == ["art. 6 § 2", "§ 3", "„art. 7”", "12.03.2021", "1 500,00 zł", "2020 r"] and rows[2].safe == "__PROTECTED_0000__ i __PROTECTED_0001__"


def test_ngrams(spark):
    d = frame(spark, ["a b c a b", "a", None])
    assert {r.ngram: r.n for r in T.ngram_counts(d, 2).collect()} == {"a b": 2, "b c": 1, "c a": 1}


def test_mtld_by_hand(spark):
    """"a a" runs out at its second word (1 of 2 distinct) in both directions; a text of different words has no factor at all."""
    texts = {"a a a a": 2.0, "alfa beta gamma": 0.0, "": 0.0, "a b a": round((3 / 1 + 3 / 1) / 2, 4), "x1 a a a a 2y": 2.0}
    got = metrics.mtld(frame(spark, list(texts))).orderBy("doc_id").collect()
    # "a b a": 2 of 3 distinct is 0.667, at most 0.72, so one whole factor of three words.
    assert [r.mtld for r in got] == list(texts.values())
    word = lambda i: "abcdefgh"[(i * i + i // 3) % 8]
    w = [word(i) for i in range(300)]

    def one(w):
        n, k, begun = 0.0, 0, 0
        for k in range(1, len(w) + 1):
            if len(set(w[begun:k])) / (k - begun) <= 0.72:
                n, begun = n + 1, k
        rest = w[begun:]
        return len(w) / (n + ((1 - len(set(rest)) / len(rest)) / 0.28 if rest else 0))

    assert metrics.mtld(frame(spark, [" ".join(w), None])).orderBy("doc_id").first().mtld == round((one(w) + one(w[::-1])) / 2, 4)


def test_syllables(spark):
    words = {"umowa": 3, "działanie": 3, "zzz": 0, "iii": 1, "odpowiedzialność": 6}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", metrics.syllables(T.F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == {"umowa": 3, "działanie": 3, "zzz": 0, "iii": 1, "odpowiedzialność": 5}


def test_strip_markup_and_spacing(spark):
    assert frame(spark, ["<p>A &amp; b</p><br/>c<td>d</td>"]).select(T.strip_markup(T.F.col("text")).alias("x")).first().x == "A & b\n\nc d"
    assert frame(spark, ["a  b , c;d ...  e"]).select(T.normalize_spacing(T.F.col("text")).alias("x")).first().x == "a b, c; d ... e"


def test_calibration_returns_every_document(spark, tmp_path):
    ids = [0, 1, 2, 3, 4, 5, -3, None]
    text = "Strony zawarły umowę najmu. Najemca zapłacił czynsz w terminie. Potem oddał klucze i opuścił lokal."
    spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = registry.queries()
    assert {r.doc_id for r in run["document_diagnosis"](spark, str(tmp_path)).collect()} == set(ids)
    for name in ("calibration", "calibration_signals", "review_gate"):
        assert {r.doc_id for r in run[name](spark, str(tmp_path)).collect()} >= {0, 1, 2, 3, 4, 5, -3}, name


def test_boilerplate_lines_and_reasoning(spark):
    text = "Sygn. akt I C 1/20\nSędzia Anna K.\nsędzia\nsędziowski spór\ndnia 3 maja\nU Z A S A D N I E N I E\n12.\nIV)\n---\nza zgodność\nSąd ustalił."
    out = frame(spark, [text]).select(T.drop_boilerplate(T.F.col("text")).alias("a"), T.extract_reasoning(T.F.col("text")).alias("b")).first()
    assert out.a == "sędziowski spór\nU Z A S A D N I E N I E\nSąd ustalił." and out.b.startswith("12.")


def test_slugs_and_masks(spark):
    d = frame(spark, ["Umowa Najmu Żółtego — Domu, 2024!", "Pan Jan Kowalski ma 12,5 zł i pisze z jan@x.pl do sądu. Drugie."])
    got = [(r.s, r.m) for r in d.orderBy("doc_id").select(T.slug(T.F.col("text")).alias("s"), T.masked_excerpt(T.F.col("text")).alias("m")).collect()]
    assert got[0][0] == "umowa-najmu-zoltego-domu-2024" and got[1][1] == "[PODMIOT] ma [LICZBA] zł i pisze z [EMAIL] do sądu."
