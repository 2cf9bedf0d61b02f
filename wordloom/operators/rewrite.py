"""Rule candidates for sentences, ordered safety gates, and the pick of the best passing candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.plans import cut, with_rows

from . import detect, features
from . import text as T

# Replacements as (rule, pattern, replacement, score, risk).
REPLACEMENTS = [
    ("legal_ai_style:key_feature_frame", "<jedną_z_najważniejszych_cech>", "jedną z kluczowych cech", 0.50, 0.08),
    ("legal_ai_style:special_importance_frame", "<szczególne_znaczenie_ma>", "duże znaczenie ma", 0.52, 0.08),
    ("legal_ai_style:very_important_frame", "<ma_bardzo_istotne_znaczenie>", "ma bardzo duże znaczenie", 0.51, 0.08),
    ("legal_ai_style:important_frame", "<ma_istotne_znaczenie>", "ma duże znaczenie", 0.49, 0.08),
    ("legal_ai_style:important_frame_pl", "<mają_istotne_znaczenie>", "mają duże znaczenie", 0.49, 0.08),
    ("legal_ai_style:special_importance_direct", "<ma_szczególne_znaczenie>", "ma duże znaczenie", 0.49, 0.08),
    ("legal_ai_style:role_frame", "<odgrywa_istotną_rolę>", "ma duże znaczenie", 0.48, 0.08),
    ("legal_ai_style:special_role_frame", "<odgrywa_szczególną_rolę>", "ma duże znaczenie", 0.48, 0.08),
    ("legal_ai_style:important_plural_frame", "<ważne_znaczenie_mają>", "ważne są", 0.50, 0.08),
    ("legal_ai_style:important_function_frame", "<drugą_istotną_funkcją_jest>", "drugą ważną funkcją jest", 0.49, 0.08),
    ("legal_ai_style:drop_most_classic", "<najbardziej_klasyczną_postacią>", "klasyczną postacią", 0.48, 0.06),
]
# Further replacements of formal and of office style, as above.
STYLE = [
    ("legal_style:comma_after_podsumowujac", r"<Podsumowując_(?=\p{L})", "Podsumowując, ", 0.9, 0.05),
    ("legal_style:ma_granice", "<nie_jest_jednak_nieograniczone>", "ma jednak swoje granice", 0.78, 0.05),
    ("legal_style:oznacza_to", "<polega_ona_na_tym, że>", "oznacza to, że", 0.72, 0.05),
    ("legal_style:oznacza_to", "<polega_on_na_tym, że>", "oznacza to, że", 0.72, 0.05),
    ("legal_style:duze_znaczenie", "<istotne_znaczenie_ma>", "duże znaczenie ma", 0.68, 0.05),
    ("legal_style:jest_tez_wazne", "<ma_także_istotne_znaczenie>", "ma też duże znaczenie", 0.65, 0.05),
    ("legal_style:to_ono", "<To_właśnie_ono>", "To ono", 0.58, 0.05),
    ("legal_style:z_definicji", "<Już_z_tej_definicji_wynika, że>", "Z tej definicji wynika, że", 0.58, 0.05),
    ("legal_style:system_czasu", "<Zgodnie_z_obowiązującym_go_systemem_i_rozkładem_czasu_pracy>", "zgodnie z obowiązującym systemem i rozkładem czasu pracy", 0.55, 0.05),
    ("legal_style:widać_to_takze", "^<Przejawia_się_również_w>", "Widać to także w", 0.62, 0.05),
    ("legal_style:widać_takze", "<przejawia_się_również_w>", "widać także w", 0.61, 0.05),
]
OFFICE = [
    ("<na_gruncie_niniejszego>", "w tym"), ("<należy_zauważyć, że>", "warto zauważyć, że"), ("<należy_podkreślić, że>", "warto podkreślić, że"), ("<należy_zaznaczyć, że>", "warto zaznaczyć, że"),
    ("<należy_wskazać, że>", "warto wskazać, że"), ("<wziąwszy_pod_uwagę>", "biorąc pod uwagę"), ("<zważywszy_na>", "biorąc pod uwagę"), ("<w_odniesieniu_do>", "co do"), ("<w_zakresie_dotyczącym>", "w zakresie"),
    ("<w_chwili_obecnej>", "obecnie"), ("<w_konsekwencji>", "w rezultacie"), ("<mając_na_względzie>", "biorąc pod uwagę"), ("<z_uwagi_na_powyższe>", "z uwagi na to"), ("<w_związku_z_powyższym>", "w związku z tym"),
    ("<w_przedmiocie>", "w sprawie"), ("<albowiem>", "ponieważ"), ("<aczkolwiek>", "choć"), ("<jednakowoż>", "jednak"), ("<każdorazowo>", "zawsze"),
]
OFFICE_SCORE, OFFICE_RISK = 0.6, 0.1
# Roles that somebody plays (the frame with what stands in it, and the plain verb), and openings that may go.
ROLES = [("legal_style:duze_znaczenie_maja", "odgrywają", "mają"), ("legal_style:duze_znaczenie_ma", "odgrywa", "ma")]
DROPS = [
    ("ai_artifact:drop_discourse_intro", "^<(?:warto|należy)_(?:również_)?(?:wskazać|zauważyć|podkreślić|odnotować|zaznaczyć)>(?: ?, ?| )<że> +", 0.57, 0.20),
    ("ai_artifact:drop_repetitive_transition", "^<(?:ponadto|co_więcej|dodatkowo)>(?: ?, ?| )", 0.53, 0.17),
]
MAX_GROWTH, MIN_RETENTION, MIN_ANCHORS = 1.6, 0.5, 4
#: Lengths of the original from which a candidate may be too long or too short, and its least share.
LONG, FULL, MIN_SHARE = 40, 80, 0.55
DEONTIC = (features.PROHIBITION, features.PERMISSION, features.OBLIGATION)
# Words and patterns that no candidate may hold, conjunctions, connectors, and rules that resolve a double negation.
FOREIGN = "surprisingly actually basically honestly literally overall moreover".split()
BAD = ["<w_celu_jest>", "<jest_(?:przeprowadzić|wykonać|wdrożyć|zastosować|wykorzystać)>", r"\.[ ]*<(?:Ponadto|Z_kolei)_(?:za|w|na|do|od|przy|bez|pod)>", r"\.[ ]*<Przy_czym_(?:za|w|na|do|od|bez|pod)>"]
RELATIVE = "(?:który|która|które|którzy|których|którym|którego|której|któremu|którymi|którą)"
STRANDED = rf"<\p{{L}}{{3,}}[ćc]> ?, ?<{RELATIVE}>"
DOUBLED = "<(?:oraz|i|lub|albo|a_także)_(?:oraz|i|lub|albo|a_także)>"
DANGLING = [r"(?u)(?:^|[.!?]\s+)(?:Ponadto|Z kolei|Jednak|Natomiast)\s*[.!?]", r"(?iu)(?<![\p{L}\p{N}_])(?:oraz|lub|albo|a także|ponieważ|jeżeli)\s*[.!?]?$"]
RESOLVES = ["legal_style:ma_granice"]
EMOTICON = r"[:;=]['^-]?[()\[\]]+"


def _first(text: Column, spec: str, with_: str) -> Column:
    """The first hit replaced, keeping its capital letter."""
    found = F.regexp_substr(text, F.lit(P.spark_pattern(spec)))
    at = F.instr(text, found)
    fresh = F.when(F.substring(found, 1, 1) == F.upper(F.substring(found, 1, 1)), F.concat(F.upper(F.lit(with_[:1])), F.lit(with_[1:]))).otherwise(with_) if with_ else F.lit("")
    rest = F.substring(text, at + F.char_length(found), F.char_length(text))
    out = F.concat(F.substring(text, F.lit(1), at - 1), fresh, rest)
    return out if with_ else F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.char_length(rest)))


def _any_word() -> str:
    """A pattern that holds wherever a rule of words may match; it looks at word starts only, with one look-behind for all rules."""
    specs = [x[1] for x in DROPS + STYLE + REPLACEMENTS] + [x for x, _ in OFFICE]
    return P.spark_pattern("<(?:" + "|".join(x.lstrip("^")[1:] for x in specs) + ")|zczególną rolę")


#: Holds wherever spacing or a dash may be mended.
ANY_SIGN = r"—|--| {2}|[ \t][,;:!?.]|[,;:]\p{L}"


def candidates(docs: DataFrame) -> DataFrame:
    """All rule candidates of each sentence, in the rules' order (gen_order); each row of docs is read by itself."""
    opener = P.spark_pattern(DROPS[1][1])
    p = T.split_paragraphs(docs).select("doc_id", "paragraph_index", T.sentence_list(F.col("text")).alias("list"))
    # The first sentence of the paragraph that opens so, counted from 1; 0 for none. Sentences after it are `opened`.
    p = p.select("doc_id", "paragraph_index", "list", F.array_position(F.transform("list", lambda x: x.rlike(opener)), True).alias("opener"))
    s = p.select("doc_id", "paragraph_index", "opener", F.posexplode_outer("list").alias("sentence_index", "text")).where("text IS NOT NULL")
    s = s.select("doc_id", "paragraph_index", "sentence_index", "text", ((F.col("opener") > 0) & (F.col("sentence_index") >= F.col("opener"))).alias("opened"))
    t = F.col("text")
    spaced = T.normalize_spacing(t)
    signs = [("cleanup:spacing", spaced != t, spaced, 0.1, 0.0), ("cleanup:em_dash", t.rlike(r"—|--"), T.plain_dashes(t), 0.5, 0.05)]
    made = []
    for rule, spec, score, risk in DROPS:
        hit = t.rlike(P.spark_pattern(spec))
        made.append((rule, hit & F.col("opened") if "transition" in rule else hit, _first(t, spec, ""), score, risk))
    office = [("kancelaryzm", spec, fresh, OFFICE_SCORE, OFFICE_RISK) for spec, fresh in OFFICE]
    made += [(rule, t.rlike(P.spark_pattern(spec)), _first(t, spec, fresh), score, risk) for rule, spec, fresh, score, risk in STYLE + REPLACEMENTS + office]
    for rule, verb, plain in ROLES:
        frame = rf"(?u)^(.*?)(?<![{P.WORDCHAR}])([Ss])zczególną rolę(\s+[^,.]{{3,80}}?)?\s+{verb}\s+(?=[^,.])"
        fresh = F.regexp_replace(t, frame, f"$1<$2>uże znaczenie$3 {plain} ")
        made.append((rule, t.rlike(frame), F.replace(F.replace(fresh, F.lit("<S>"), F.lit("D")), F.lit("<s>"), F.lit("d")), 0.56, 0.1))
    listed = lambda rules, first: F.array(*[F.when(hit, F.struct(F.lit(i).alias("gen_order"), F.lit(rule).alias("rule"), out.alias("candidate"), F.lit(score).alias("score"), F.lit(risk).alias("risk"))) for i, (rule, hit, out, score, risk) in enumerate(rules, first)])
    # Most sentences match neither pattern; those with signs only are spared the rules of words.
    word = t.rlike(_any_word())
    each = F.when(word, F.concat(listed(signs, 0), listed(made, len(signs)))).otherwise(listed(signs, 0))
    s = s.where(t.rlike(ANY_SIGN) | word).select("doc_id", "paragraph_index", "sentence_index", F.col("text").alias("original"), F.explode_outer(F.filter(each, lambda c: c.isNotNull())).alias("c")).where("c IS NOT NULL")
    return s.select("doc_id", "paragraph_index", "sentence_index", "original", "c.gen_order", "c.rule", "c.candidate", "c.score", "c.risk")


def gates(pairs: DataFrame) -> DataFrame:
    """pairs (original, candidate) with reason: the first gate that fails in order, null if all hold."""
    o, c = F.col("original"), F.col("candidate")
    same = lambda f: f(o) == f(c)
    signs = [("(", ")"), ("[", "]"), ("„", "”"), ('"', '"')]
    times = lambda t, a: F.regexp_count(F.regexp_replace(t, EMOTICON, ""), F.lit("\\Q" + a + "\\E"))
    off = lambda t, a, b: times(t, a) % 2 if a == b else F.abs(times(t, a) - times(t, b))
    numbers = lambda t: F.regexp_extract_all(t, F.lit(features.NUMBER), 0)
    kept = F.size(F.array_intersect(features.anchors(o), features.anchors(c)))
    holds = lambda t, spec: t.rlike(P.spark_pattern(spec))
    held = lambda t: F.regexp_extract_all(t, F.lit(r"__PROTECTED_\d{4,}__"), 0)
    n, m = F.char_length(o), F.char_length(c)
    parts = lambda t: F.size(T.sentence_list(t))
    resolves = F.col("rule").isin(RESOLVES) if "rule" in pairs.columns else F.lit(False)
    checks = [
        ("non_empty", T.strip(c) != ""),
        ("no_foreign_words", ~F.lower(c).rlike("|".join(FOREIGN))),
        ("known_bad_patterns", ~F.greatest(*[holds(c, p) for p in BAD])),
        ("no_stranded_relative_clause", ~holds(c, STRANDED)),
        ("no_double_conjunctions", ~holds(c, DOUBLED)),
        ("no_dangling_connectors", ~F.greatest(*[c.rlike(p) for p in DANGLING])),
        ("balanced_punctuation", ~F.greatest(*[(off(c, a, b) > off(o, a, b)) for a, b in signs])),
        ("length_ratio", ~((n > LONG) & (m > n * MAX_GROWTH)) & ~((n > FULL) & (m < n * MIN_SHARE))),
        ("numbers_preserved", same(numbers)),
        ("placeholder_restore", F.size(F.array_except(held(c), held(o))) == 0),
        *[(k, same(lambda t, k=k: features.inventory(t, k))) for k in features.INVENTORY],
        ("deontic_modality", F.least(*[P.count(o, p) == P.count(c, p) for p in DEONTIC])),
        ("negation", resolves | (P.count(o, features.NEGATION) == P.count(c, features.NEGATION))),
        ("content_anchor_retention", (F.size(features.anchors(o)) < MIN_ANCHORS) | (kept / F.size(features.anchors(o)) >= MIN_RETENTION)),
        ("sentence_split_safety", (parts(c) <= parts(o)) | ~holds(o, "<oraz>")),
        ("protected_fragments", F.size(F.array_except(held(o), held(c))) == 0),
    ]
    return pairs.withColumn("reason", F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in checks]))


# Fixed values of the score: by a rule's family (gain, gain for each point of artifact score that goes, its cap, risk, penalty); limits of the change of length with
# gain and penalty; (risk for each, cap) of references and norms; risks of changed norms, of lost references, of any reference; weight of lost anchors; strength by mode.
FAMILIES = {"legal_style:comma_": (0.025, 0.0, 0.0, 0.0, 0.0), "cleanup:": (0.025, 0.0, 0.0, 0.0, 0.0), "split_": (0.0, 0.0, 0.0, 0.12, 0.08), "redundancy:": (0.0, 0.0, 0.0, 0.08, 0.0), "ai_artifact:": (0.0, 0.35, 0.08, 0.16, 0.0), "legal_ai_style:": (0.025, 0.25, 0.05, 0.05, 0.0)}
LOW_RISK = ("legal_style:comma_", "cleanup:")
SAME_LENGTH, OTHER_LENGTH = (0.04, 0.025), (0.18, 0.06)
REFERENCE_RISK, NORM_RISK, NOMINAL_GAIN = (0.015, 0.10), (0.025, 0.08), (0.01, 0.05)
CHANGED_NORM, LOST_REFERENCE, ANY_REFERENCE, LOST_ANCHOR = 0.25, 0.18, 0.02, 0.08
STRENGTH = {"conservative": 25, "standard": 50, "strong": 70}


def scored(pairs: DataFrame, mode: str = "standard") -> DataFrame:
    """pairs (original, candidate, rule, score, risk) with gain, total_risk, penalty, final: the rule's score plus gains, less risks and penalties, within 0 and 1.

    Terms that need a parse or a lexicon (depth, formality, passives, monotony of paragraphs) are 0.
    """
    o, c, rule = F.col("original"), F.col("candidate"), F.col("rule")
    capped = lambda n, each_cap: F.least(n * each_cap[0], F.lit(each_cap[1]))
    of = lambda k: F.coalesce(*[F.when(rule.startswith(f), v[k]) for f, v in FAMILIES.items()], F.lit(0.0))
    low = F.greatest(*[rule.startswith(f) for f in LOW_RISK])
    change = F.abs(F.char_length(c) - F.char_length(o)) / F.greatest(F.char_length(o), F.lit(1))
    went = F.greatest(F.lit(0.0), features.artifact_score(o) - features.artifact_score(c))
    nominal = F.size(F.filter(T.tokens(o), lambda w: (F.char_length(w) >= 7) & w.rlike(detect.NOMINAL)))
    references = lambda t: F.regexp_extract_all(t, F.lit(features.INVENTORY["legal_references"]), 0)
    norms = lambda t: [P.count(t, p) for p in DEONTIC]
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_except(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)
    n, changed = F.size(references(o)), F.greatest(*[a != b for a, b in zip(norms(o), norms(c))])
    gain = F.when(change <= SAME_LENGTH[0], SAME_LENGTH[1]).otherwise(0.0) + of(0) + F.least(of(2), went * of(1)) + F.when(rule.startswith("kancelaryzm"), capped(nominal, NOMINAL_GAIN)).otherwise(0.0)
    gain = gain + F.when(low, 0.0).otherwise((STRENGTH[mode] - 25) / 1000)
    risk = F.col("risk") + of(3) + capped(n, REFERENCE_RISK) + capped(sum(norms(o), F.lit(0)), NORM_RISK) + F.when(changed, CHANGED_NORM).otherwise(0.0)
    risk = risk + F.when((n > 0) & ~low, ANY_REFERENCE).otherwise(0.0) + share(references(o), references(c)) * LOST_REFERENCE
    penalty = of(4) + F.when(change >= OTHER_LENGTH[0], OTHER_LENGTH[1]).otherwise(0.0)
    final = F.col("score") + F.col("gain") - F.col("total_risk") - F.col("penalty") - share(features.anchors(o), features.anchors(c)) * LOST_ANCHOR
    d = pairs.withColumns({"gain": F.round(gain, 6), "total_risk": F.round(risk, 6), "penalty": penalty})
    return d.withColumn("final", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), final)), 4))


def rewrite_best(docs: DataFrame) -> DataFrame:
    """The best passing candidate of each sentence that has one: highest score, then the rules' order."""
    g = gates(candidates(docs)).where("reason IS NULL")
    order = W.partitionBy("doc_id", "paragraph_index", "sentence_index").orderBy(F.desc("score"), "gen_order")
    return g.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "paragraph_index", "sentence_index", "original", "candidate", "rule", "score")


def _applied(docs: DataFrame, best: DataFrame) -> DataFrame:
    """docs (doc_id, one row each; text) with the best candidates in the places of their sentences and `edited`; what stands between sentences and paragraphs stays as it was.

    Only texts that an edit changes are taken apart, each by itself.
    """
    shown = lambda p: T.strip(p) != ""
    within = best.groupBy("doc_id", "paragraph_index").agg(F.map_from_entries(F.collect_list(F.struct("sentence_index", "candidate"))).alias("m"))
    made = within.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("paragraph_index", "m"))).alias("made"))
    d = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(made, "doc_id", "left")
    has = F.col("made").isNotNull()
    d = d.withColumns({"ps": F.when(has, F.split("text", "\n+", -1)), "gaps": F.when(has, F.regexp_extract_all("text", F.lit("\n+"), 0))})
    # Blank paragraphs are not counted: the k-th shown one stands at spots[k].
    d = d.withColumn("spots", F.when(has, F.filter(F.transform("ps", lambda p, i: F.when(shown(p), i)), lambda i: i.isNotNull())))
    d = d.withColumn("made", F.when(has, F.transform_keys("made", lambda k, m: F.get("spots", k))))
    # A sentence without its edges is what the candidate stands for.
    edges = lambda raw, c: F.concat(F.regexp_extract(raw, f"^[{T.BLANK}]*", 0), c, F.regexp_extract(raw, f"[{T.BLANK}]*$", 0))
    fresh = lambda raws, m: F.transform(raws, lambda raw, j: F.when(F.map_contains_key(m, j), edges(raw, F.try_element_at(m, j))).otherwise(raw))
    zipped = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    paragraph = lambda p, m: zipped(fresh(F.split(p, T.SENTENCE_GAP, -1), m), T.sentence_gaps(p))
    ps = F.transform("ps", lambda p, i: F.when(F.map_contains_key(F.col("made"), i), paragraph(p, F.try_element_at(F.col("made"), i))).otherwise(p))
    return d.select(*[F.when(has, zipped(ps, F.col("gaps"))).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "edited"], has.alias("edited"))


def _steps(docs: DataFrame, steps: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs by number, their texts after `steps` rounds (doc_id: the row's number; id, text), and the edits."""
    rows = cut(with_rows(docs))
    now, edits = rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "text", F.lit(True).alias("edited")), []
    for step in range(1, steps + 1):
        # A text that a round left as it was has no edit in the next one either.
        best = cut(rewrite_best(now.where("edited")))
        edits.append(best.select(F.col("doc_id").alias("row"), F.lit(step).alias("step"), "paragraph_index", "sentence_index", F.col("original").alias("before"), F.col("candidate").alias("after"), "rule"))
        now = _applied(now, best)
        now = cut(now) if step < steps else now  # the next round reads it twice
    return rows, now, reduce(DataFrame.unionByName, edits)


def stepped(docs: DataFrame, steps: int = 2) -> tuple[DataFrame, DataFrame]:
    """The texts after `steps` rounds of single best edits (row, doc_id, source, text), and the edits (row, doc_id, step, paragraph_index, sentence_index, before, after, rule).

    Each row is a document of its own, whatever its doc_id; a null text is empty.
    """
    rows, now, edits = _steps(docs, steps)
    texts = rows.withColumnRenamed("text", "source").join(now.select(F.col("doc_id").alias("row"), "text"), "row")
    made = edits.join(rows.select("row", "doc_id"), "row").select("row", "doc_id", *edits.columns[1:])
    return texts, made


def rewrite(docs: DataFrame, steps: int = 2) -> DataFrame:
    """doc_id and text after `steps` rounds of single best edits, a row for each row of docs."""
    return _steps(docs, steps)[1].select(F.col("id").alias("doc_id"), "text")
