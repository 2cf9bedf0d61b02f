"""Steps that have to stay cheap on large tables: no shuffle of what is read by itself, no work on what cannot match."""

from pyspark.sql import functions as F

from wordloom.functions.plans import dealt
from wordloom.operators import calibrate, detect, layout, nominal, outcomes, redundancy, replies, rewrite, sections
from wordloom.operators import text as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def kept_rows(monkeypatch, *modules):
    """The numbers of rows that the modules keep from now on."""
    counts, real = [], redundancy.cut

    def counted(df):
        made = real(df)
        counts.append(made.count())
        return made

    for m in modules:
        monkeypatch.setattr(m, "cut", counted)
    return counts


FORMS = [("wykonawca", "wykonawca", "subst:sg:nom:m1"), ("usuwa", "usuwać", "fin:sg:ter:imperf"), ("naprawia", "naprawiać", "fin:sg:ter:imperf")]


def test_nominal_keeps_only_sentences_with_a_phrase(spark, monkeypatch):
    text = " ".join(["Strony podpisały protokół."] * 30 + ["Należy dokonać zmiany."])
    kept = kept_rows(monkeypatch, redundancy, nominal)
    got = nominal.edits(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string"), None).collect()
    assert sorted((r.sentence_index, r.after) for r in got) == [(30, "Należy zmienić.")] * 2
    assert max(kept) == 2


def test_candidates_read_each_row_by_itself(spark):
    docs = spark.createDataFrame([(1, "Ponadto termin minął."), (1, "Ponadto dłużnik zapłacił.")], "doc_id long, text string")
    made = rewrite.candidates(docs)
    assert "Exchange" not in plan(made)
    assert made.count() == 0  # neither paragraph holds an earlier transition
    one = rewrite.candidates(docs.limit(1).withColumn("text", F.lit("Termin minął. Ponadto A. Ponadto B.")))
    assert [(r.sentence_index, r.rule) for r in one.collect()] == [(2, "ai_artifact:drop_repetitive_transition")]


def test_every_rule_of_words_passes_the_common_pattern(spark):
    texts = ["Ma istotne znaczenie.", "Albowiem tak.", "Warto zauważyć, że tak.", "Strona odgrywa istotną rolę.", "Szczególną rolę w sprawie odgrywa termin.", "Podsumowując termin minął.", "Przejawia się również w sporze."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in rewrite.candidates(docs).collect()} == set(range(len(texts)))


def test_a_round_without_edits_is_the_last_of_a_text(spark):
    docs = spark.createDataFrame([(1, "\n A.  \n\nKażdorazowo tak.  Albowiem nie. \n"), (1, "Bez zmian. "), (None, None), (2, "x")], "doc_id long, text string")
    best = rewrite.rewrite_best(docs.where("text LIKE '%Albowiem%'"))
    got = rewrite._applied(docs.where("doc_id IS NOT NULL AND text <> 'Bez zmian. '"), best)
    assert {(r.doc_id, r.text, r.edited) for r in got.collect()} == {(1, "\n A.  \n\nZawsze tak.  Ponieważ nie. \n", True), (2, "x", False)}
    assert sorted((str(r.doc_id), r.text) for r in rewrite.rewrite(docs).collect()) == [("1", "\n A.  \n\nZawsze tak.  Ponieważ nie. \n"), ("1", "Bez zmian. "), ("2", "x"), ("None", "")]


def test_the_bound_on_letters_loses_no_alike_wordings():
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 12))) for _ in range(400)] + ["umowa najmu", "umowy najmu lokalu", "x", "kara umowna", "kary umowne"]
    alike = [(a, b) for a in words for b in words if sections.alike(a, b)]
    assert alike and all(sections.may_be_alike(a, b) and sections.may_be_alike(b, a) for a, b in alike)
    assert not sections.may_be_alike("postanowienia", "wynagrodzenie stron")


def test_python_steps_keep_their_parts(spark):
    few = dealt(spark.range(100).select("id"), "id")
    few.collect()
    assert few.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_slots_read_their_blocks_once(spark):
    docs = spark.createDataFrame([(1, "§ 1. Umowa\n\n………… \t …………\nWynajmujący\t\tNajemca")], "doc_id long, text string")
    made = layout.slots(layout.blocks(docs))
    assert "Join" not in plan(made)
    assert [r.type for r in made.orderBy("k").collect()] == ["signature", "signature"]


def test_redundancy_keeps_only_sentences_with_known_words(spark, monkeypatch):
    plain = ["Strony podpisały protokół."] * 30
    texts = [" ".join([*plain, "Stary wykonawca naprawia drogę gminną.", "Wykonawca naprawia drogę.", "Wykonawca usuwa wady."]), " ".join(plain)]
    forms = spark.createDataFrame(FORMS, "form string, lemma string, tag string")
    pairs = spark.createDataFrame([], "kind string, a string, b string, strong boolean")
    kept = kept_rows(monkeypatch, redundancy)
    got = redundancy.edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forms, pairs, "strong").collect()
    assert [(r.doc_id, r.sentence_index, r.after) for r in got] == [(0, 32, "Usuwa wady.")]
    assert max(kept) == 3


def test_an_opening_is_compared_with_a_sentence_without_known_words(spark):
    forms = spark.createDataFrame(FORMS, "form string, lemma string, tag string")
    pairs = spark.createDataFrame([], "kind string, a string, b string, strong boolean")
    # "Wykonawcy" has the same stem but no readings, so only the second sentence of the first text is looked at.
    docs = spark.createDataFrame([(1, "Wykonawcy stoją. Wykonawca naprawia drogę."), (2, "Budynki stoją. Wykonawca naprawia drogę.")], "doc_id long, text string")
    got = redundancy.edits(docs, forms, pairs, "strong").collect()
    assert [(r.doc_id, r.after) for r in got] == [(1, "Naprawia drogę.")]


def test_review_reads_the_texts_once(spark, monkeypatch):
    called, real = [], detect.sentences
    monkeypatch.setattr(detect, "sentences", lambda *a: (called.append(1), real(*a))[1])
    texts = ["Ponadto tak było. Strony mają czas.\nPonadto ma istotne znaczenie.", "Zwykły tekst stron.", "Ponadto — tak.", None, "Umowa ma istotne znaczenie. Ponadto tak."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.first_family for r in calibrate.review(docs).collect()}
    assert len(called) == 1
    order = ["paragraph_index", "sentence_index", "start", "ord"]
    want = {}
    for r in detect.findings(docs).orderBy("doc_id", *order).collect():
        want.setdefault(r.doc_id, r.family)
    assert {i: f for i, f in got.items() if f} == want and got[1] is None and 3 not in got


def test_signal_equals_that_of_the_document_table(spark):
    from wordloom.operators import documents

    texts = ["Ponadto tak było. Strony mają czas.\nPonadto ma istotne znaczenie.", "Zwykły tekst stron.", None, "", "Ponadto raz. Dodatkowo dwa. Ponadto trzy. Dodatkowo cztery."]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[0]), (None, texts[4])], "doc_id long, text string")
    made = documents.document_signal(docs)
    assert "collect_set" not in plan(made)  # openings and bins are for metrics only
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(made) == rows(documents.signal(documents.document_table(docs)))


def test_style_profile_shuffles_no_texts_and_keeps_repeated_ids(spark, monkeypatch):
    contract, other = "Umowa wiąże strony. Najemca płaci.", "Zupełnie inny list."
    rows = [*((i, contract) for i in range(6)), (3, other), (90, other), (None, contract)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, real = [], outcomes.style_statistics
    monkeypatch.setattr(outcomes, "style_statistics", lambda d: (seen.append(d), real(d))[1])
    r = outcomes.style_profile(docs).first()
    assert (r.kind, r.documents, r.excluded) == ("contract", 7, 2)
    assert sorted((x.doc_id, x.text) for x in seen[0].collect()) == sorted([*rows[:6], (3, other)])
    assert "SortMergeJoin" not in plan(seen[0]) and "Exchange hashpartitioning" not in plan(seen[0])


def test_phrases_are_looked_for_as_characters_first(spark):
    cat = replies.Catalogue(acts=[replies.Kind("a", strong=("od decyzji",), weak=("org.",))], senders=[], procedures=[replies.Kind("kpa", strong=("k.p.a.",))])
    made = replies.letter_kind(spark.createDataFrame([(1, "Odwołanie od decyzji, zob. k.p.a. i k.p.a.; org. a"), (2, "org.an, xk.p.a.")], "doc_id long, text string"), cat)
    assert "Contains(" in made._jdf.queryExecution().optimizedPlan().toString() or "contains(" in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.doc_id: (r.act_score, r.procedure, r.cited) for r in made.collect()}
    assert got[1] == (4, "kpa", 2) and got[2] == (0, None, 0)
    t = spark.createDataFrame([("Proszę w terminie zapłacić, a w terminie 14 dni oddać; w ciągu tygodnia.",), ("xw terminie 3 dni",), ("W  Terminie dwudziestu jeden dni",)], "t string")
    assert [r.v and tuple(r.v) for r in t.select(replies.term(T.F.col("t")).alias("v")).collect()] == [(14, "day"), None, (21, "day")]


def test_fragments_are_known_by_their_first_characters(spark):
    assert T.PROTECT.startswith(r"(?ium)(?:(?=[")
    texts = ["„x” art. 5 ART. 7 § 3 xart. 4 12.03.2021 5 zł K) x\nſ) a) b\nK) c\n  1. d", "uſt. 3 UST. 4 pKt 5 Dz. U. 2020, poz. 1", '1 500,50 zł "a" 2020 r. 12%', ""]
    same = F.regexp_extract_all("text", F.lit(T.PROTECT), F.lit(0)) == F.regexp_extract_all("text", F.lit("(?ium)" + "|".join(T.PROTECTED)), F.lit(0))
    assert all(r.same for r in spark.createDataFrame([(x,) for x in texts], "text string").select(same.alias("same")).collect())
