"""Nominalisations against matching rule by rule, and by hand."""

import random
import re
import time

import pytest
from wordloom.operators import nominal as N

FORMS = [
    ("umowy", "umowa", "subst:sg:gen:f"), ("prawną", "prawny", "adj:sg:acc:f:pos"), ("bez", "bez", "prep:gen"), ("bez", "bez", "subst:sg:nom:m3"), ("oraz", "oraz", "conj"), ("składa", "składać", "fin:sg:ter:imperf"), ("może", "móc", "fin:sg:ter:imperf"),
    ("skorzystania", "skorzystać", "ger:sg:gen:n:perf:aff"), ("zapłaty", "zapłata", "subst:sg:gen:f"), ("przywłaszczenia", "przywłaszczyć", "ger:sg:gen:n:perf:aff"), ("przywłaszczony", "przywłaszczyć", "ppas:sg:nom:m1:perf:aff"), ("z", "z", "prep:gen"),
]


def forms(spark):
    return spark.createDataFrame(FORMS, "form string, lemma string, tag string")


def run(spark, texts, mode="standard", given=True, phrases=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = N.candidates(docs, forms(spark) if given else None, mode, phrases).collect()
    return {i: [(r.rule.split(":")[1], r.candidate) for r in sorted(rows, key=lambda r: r.gen_order) if r.doc_id == i] for i in range(len(texts))}


def rule_by_rule(text, phrases, stops):
    """Each rule's pattern over the whole text, one after the other."""
    def sub(p, text, count=0):
        def fresh(m):
            tail = re.match(r"\s+([^\W\d_]+)", m.string[m.end():])
            if tail and stops(tail[1].lower()):
                return m[0]
            return p.replacement[:1].upper() + p.replacement[1:] if m[0][0].isupper() else p.replacement
        return re.sub(r"\b" + r"\s+".join(map(re.escape, p.words.split())) + r"\b", fresh, text, count=count, flags=re.I)

    combined, out = text, []
    for p in phrases:
        combined = sub(p, combined)
    if combined != text:
        out.append(("combined", combined))
    return out + [(p.words, one) for p in phrases if (one := sub(p, text, 1)) != text]


def test_equals_matching_rule_by_rule(spark):
    r = random.Random(2)
    words = [w for p in N.RULES for w in p.words.split()] + ["umowy", "bez", "prawną", "oraz", "x", "nad", "Dokonać", "ZMIANY", "dokonać zmiany", "Podjąć  uchwałę", "1", "wydano_zezwolenie"]
    texts = [("a " + " ".join(r.choice(words) + r.choice(["", "", "", ",", "\u00a0"]) for _ in range(r.randint(2, 25)))).strip() for _ in range(400)]
    stops = lambda w: w in N.ATTACHED or w in ("umowy", "prawną")
    for mode in ("standard", "strong"):
        active = [p for p in N.RULES if mode in p.modes]
        got = run(spark, texts, mode)
        assert [got[i] for i in range(len(texts))] == [rule_by_rule(t, active, stops) for t in texts]


def test_the_trie_reads_once_however_many_rules():
    text = " ".join(f"w{i % 500} w{i % 499} dokonać zmiany" for i in range(4000))
    took = []
    for n in (80, 20_000):
        trie = N.Trie.of([N.Phrase(f"czynić{i} coś{i % 50}", "zrobić", 0.1) for i in range(n)] + N.RULES)
        best = min(timed(trie, text) for _ in range(5))
        took.append(best)
    assert took[1] < 3 * took[0]


def timed(trie, text):
    began = time.perf_counter()
    assert len(trie.find(text)) == 4000
    return time.perf_counter() - began


def test_by_hand(spark):
    got = run(spark, [
        "Należy dokonać analizy.", "Należy dokonać analizy umowy.", "Dokonano zmiany bez zwłoki, a potem dokonano wyboru.", "Zarząd ma podjąć decyzję.", "Trzeba sprawować nadzór nad spółką.",
        "Strona składa wniosek w celu skorzystania z ulgi.", "W celu skorzystania z ulgi strona składa wniosek.", "Strona składa wniosek w celu skorzystania zapłaty.", "Strona składa wniosek w celu przywłaszczenia.", "Strona składa wniosek w celu przywłaszczenia się.", "Strona składa wniosek w celu skorzystania i zysku.",
    ])
    assert got[0] == [("combined", "Należy przeanalizować."), ("dokonać analizy", "Należy przeanalizować.")]
    assert got[1] == [] and got[3] == [] and got[4] == []
    assert got[2][0] == ("combined", "Zmieniono bez zwłoki, a potem wybrano.") and len(got[2]) == 3
    assert got[5] == [("w_celu_ger", "Strona składa wniosek, aby skorzystać z ulgi.")]
    assert [got[i] for i in (6, 7, 8, 10)] == [[]] * 4 and got[9] == [("w_celu_ger", "Strona składa wniosek, aby przywłaszczyć się.")]
    assert run(spark, ["Zarząd ma podjąć decyzję."], "strong")[0][0] == ("combined", "Zarząd ma zdecydować.")
    assert run(spark, ["Należy dokonać analizy.", "Należy dokonać analizy dziś."], given=False) == {0: got[0], 1: []}


def test_edits_pass_the_gates_and_rows_stay_apart(spark):
    docs = spark.createDataFrame([(None, "Należy dokonać analizy."), (None, "Należy dokonać analizy."), (4, None), (4, "Nic tu nie ma.")], "doc_id long, text string")
    out = N.edits(docs, forms(spark)).collect()
    assert [(r.doc_id, r.after) for r in out] == [(None, "Należy przeanalizować.")] * 2


def test_a_chain_of_replacements_is_refused():
    with pytest.raises(ValueError):
        N.Trie.of([N.Phrase("dokonać zmiany", "podjąć", 0.1), N.Phrase("podjąć uchwałę", "uchwalić", 0.1)])
