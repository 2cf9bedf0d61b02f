"""Corpus, feature, rewrite, structure, reference, deadline and report queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import alignment, changes, corpus, detect, documents, features, layout, layout_check, legal, nominal, outcomes, redundancy, references, replies, reports, rewrite, sections, structure
from wordloom.operators import text as T

from wordloom.functions.plans import cut, dealt, stored, with_rows
from wordloom.functions.plans import table as _table

from . import fixtures
from .fixtures import CATALOGUE, FRAGMENTS, seeded


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(_docs(spark, sf_dir))


def _terms(docs: DataFrame, *by: str) -> DataFrame:
    """Counts of words, by further columns."""
    w = docs.select(*by, T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select(*by, F.explode("w").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))


def _log_odds(s: SparkSession, d: str) -> DataFrame:
    """English against all other documents."""
    return corpus.log_odds(_terms(_docs(s, d).where("lang = 'en'")), _terms(_docs(s, d).where("lang <> 'en'")))


def _model_support(s: SparkSession, d: str) -> DataFrame:
    """Each source against the benchmark's texts: positive terms of at least two."""
    return corpus.log_odds(_terms(_docs(s, d), "source"), _terms(_table(s, d, "benchmark")), min_count=1, by=["source"]).where("log_odds > 0 AND count_a >= 2")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """The other languages play models, English documents human text, the benchmark the holdout."""
    mine = _docs(s, d).where("lang <> 'en'")
    models = _terms(mine.withColumn("model", F.col("lang")), "model")
    w = mine.select("doc_id", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    share = w.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("k")).crossJoin(F.broadcast(mine.agg(F.count("*").alias("t")))).select("term", (F.col("k") / F.col("t")).alias("share"))
    return corpus.candidates(models, _terms(_docs(s, d).where("lang = 'en'")), share, _terms(_table(s, d, "benchmark")))


def _auc(s: SparkSession, d: str) -> DataFrame:
    n = _docs(s, d).select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
    return corpus.auc(n.join(_table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    """Each document's first sentence against its whole text's second paragraph-less rest: what the rest keeps of it."""
    x = T.split_sentences(_seeded(s, d)).groupBy("doc_id").agg(F.min_by("text", F.struct("paragraph_index", "sentence_index")).alias("original"), F.max_by("text", F.struct("paragraph_index", "sentence_index")).alias("candidate"))
    return features.anchor_retention(x.withColumnRenamed("doc_id", "id"))


def _protection(s: SparkSession, d: str) -> DataFrame:
    x = _seeded(s, d).select("doc_id", "text", *[c.alias(n) for c, n in zip(T.protect(F.col("text")), ("safe", "kept"))])
    return x.select("doc_id", F.size("kept").alias("fragments"), (T.restore(F.col("safe"), F.col("kept")) == F.col("text")).alias("restored"), "safe")


def _gate_reasons(s: SparkSession, d: str) -> DataFrame:
    g = rewrite.gates(rewrite.candidates(_seeded(s, d)))
    return g.groupBy("rule", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def _deadlines(unit: str, value: int):
    return lambda s, d: legal.deadlines(_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("delivered")), value, unit)


def _verified(s: SparkSession, d: str) -> DataFrame:
    units = s.createDataFrame([("kc", "6"), ("kc", "415"), ("kpc", "187")], "code string, article string")
    return legal.verify(legal.statute_references(_seeded(s, d)), units)


#: Units of two codes as trees, and which acts could be read.
TREES = [("kc", '{"id": "kc", "children": [{"id": "chpt_1", "children": [{"id": "chpt_1-art_6"}, {"id": "chpt_1-art_415"}]}]}'), ("DU/2020/1740", None)]


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    units = references.tree_units(s.createDataFrame(TREES, "act string, tree string"))
    acts = s.createDataFrame([("kc", True), ("DU/2020/1740", False)], "act string, available boolean")
    return references.verdicts(references.statutes(_seeded(s, d)), units, acts)


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of a run, here made from the documents' numbers and sizes."""
    i, n = F.coalesce("doc_id", F.lit(0)), F.coalesce("n_chars", F.lit(0))
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    return _docs(s, d).select(
        "doc_id", "lang", pick(STATUSES, F.floor(n / 7)).alias("status"), F.when(i % 3 == 0, "").otherwise(F.coalesce("source", F.lit(""))).alias("model"), pick(["model", "rules_fallback", "rules"], i).alias("backend"),
        (i % 5 == 0).alias("needs_review"), (n % 3).alias("unresolved"), (i % 2).alias("warnings"), n.alias("words"), (n % 4).alias("changes_applied"), (n % 6).alias("findings_before"), (n % 2).alias("findings_after"),
        (n % 5).alias("model_segments"), (n % 9).alias("rule_segments"), (i % 4).alias("model_rejections"), (i % 6).alias("model_errors"), ((n % 100) / 100.0).alias("signal_before"), ((n % 50) / 100.0).alias("signal_after"), ((i % 10) / 20.0).alias("risk"),
        F.concat_ws(", ", pick(["spacing", "em_dash", "office"], i), pick(["spacing", "frame"], n)).alias("rules"), pick(["accepted", "rejected", "undecided"], n).alias("decision"),
    )


def _unit_issues(numbering: str):
    return lambda s, d: structure.unit_issues(_seeded(s, d), numbering)


STATUSES = ["ok", "ok", "failed_safety", "ok", "failed_quality", "model_unavailable"]
#: An office's style: phrases that it forbids, and terms with those it prefers.
FORBIDDEN, PREFERRED = ["istotne znaczenie", "z jednej strony"], {"lokal": "mieszkanie", "zapłat": "płatność"}


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Reviewed entries (here the benchmark's frequent words) and a new measurement, on the documents."""
    old = corpus.common_terms(_table(s, d, "benchmark")).select("term", F.col("n").cast("double").alias("z"), F.lit("rejected").alias("status"), F.lit("seen").alias("note"))
    return corpus.merged(old, corpus.common_terms(_docs(s, d)).select("term", F.col("n").cast("double").alias("z")))


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    """Documents whose labels lack a value take it from a fresh count."""
    labels = _table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    old = _docs(s, d).select("doc_id").join(labels, "doc_id", "left")
    return reports.backfilled(old, _docs(s, d).select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("quality")), "doc_id", ["quality"])


def _entries(s: SparkSession, d: str) -> DataFrame:
    """Words of the documents as entries of a reviewed list, their review made up from their lengths."""
    n, pick = F.char_length("term"), lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    e = corpus.protected(T.ngram_counts(_seeded(s, d), 1).select(F.col("ngram").alias("term")))
    return corpus.entry_problems(e.select("term", pick(["word", "opening_2", "phrase"], n).alias("kind"), pick(["accepted", "rejected", "candidate", "lost"], n).alias("status"), pick(["", "usual", " "], n + 1).alias("note"), "protected"))


def _deadline_status(s: SparkSession, d: str) -> DataFrame:
    return legal.deadline_status(_deadlines("day", 14)(s, d), F.lit("1996-01-15").cast("date"))


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    """How many documents hold each term of the catalogues."""
    rows = [("section", n, p) for n, _, _, ps in structure.SECTIONS for p in ps] + [("family", n, p) for n, ps in structure.FAMILIES for p in ps] + [("category", n, p) for n, *pss in structure.CATEGORIES for ps in pss for p in ps]
    terms = s.createDataFrame(sorted(set(rows)), "catalogue string, name string, term string")
    docs = _seeded(s, d).select(F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    each = docs.select(F.explode(F.filter(F.array(*[F.lit(t) for t in sorted({r[2] for r in rows})]), lambda x: F.contains(F.col("t"), x))).alias("term"))
    return terms.join(each.groupBy("term").agg(F.count("*").alias("documents")), "term", "left").select("catalogue", "name", "term", F.coalesce("documents", F.lit(0)).alias("documents"))


def _protected(s: SparkSession, d: str) -> DataFrame:
    return corpus.protected(T.ngram_counts(_seeded(s, d), 2).select(F.col("ngram").alias("term"))).where("protected").select("term")


def _redundant(s: SparkSession, d: str) -> DataFrame:
    return seeded(_docs(s, d), fixtures.REDUNDANT)


def _copies(s: SparkSession, d: str) -> DataFrame:
    return seeded(_docs(s, d), fixtures.COPIES)


def _template_check(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of documents with the template that they were written from, the findings of each, and the documents' ids by row."""
    templates = s.createDataFrame([(1, fixtures.TEMPLATE)], "item_id long, text string")
    docs = stored(with_rows(_copies(s, d)))
    theirs = cut(layout.blocks(templates.withColumnRenamed("item_id", "doc_id")))
    # The matcher goes by ids; here each row is one of its own.
    found = alignment.match_template(docs.select(F.col("row").alias("doc_id"), "text"), templates)
    items = theirs.select(F.col("row").alias("item"), F.col("doc_id").alias("item_id")).distinct()
    pairs = cut(found.select(F.col("doc_id").alias("row"), "item_id").join(F.broadcast(items), "item_id").select("row", "item"))
    ours = layout.blocks(dealt(docs, "row", by_size=True).join(pairs.select("row"), "row", "left_semi"), by_row=True)
    return pairs, layout_check.findings(pairs, ours, theirs), docs.select("row", "doc_id")


def _template_findings(s: SparkSession, d: str) -> DataFrame:
    _, found, ids = _template_check(s, d)
    return found.join(ids, "row").drop("row", "item")


def _template_verdicts(s: SparkSession, d: str) -> DataFrame:
    pairs, found, ids = _template_check(s, d)
    return layout_check.verdicts(pairs, found).join(ids, "row").drop("row", "item")


def _visible_changes(s: SparkSession, d: str) -> DataFrame:
    edits = rewrite.stepped(_seeded(s, d))[1]
    ids = edits.select("row", "doc_id").distinct()
    return changes.visible_changes(edits).join(ids, "row").drop("row")


def _heading_support(s: SparkSession, d: str) -> DataFrame:
    docs = _seeded(s, d)
    return corpus.heading_support(structure.headings(docs), docs.count())


def queries() -> dict:
    seed = lambda f: lambda s, d: f(_seeded(s, d))
    text = lambda f, name: lambda s, d: _docs(s, d).select("doc_id", f(F.coalesce("text", F.lit(""))).alias(name))
    return {
        "common_terms": lambda s, d: corpus.common_terms(_docs(s, d)), "merged_entries": _merged, "heading_support": _heading_support,
        "learnt_sections": seed(sections.sections), "learnt_numbering": seed(sections.numbering),
        "deontic_profile": seed(features.deontic_profile), "style_compliance": seed(lambda x: features.style_compliance(x, FORBIDDEN, PREFERRED)),
        "log_odds": _log_odds, "model_support": _model_support, "slop_candidates": _candidates, "detector_auc": _auc,
        "strip_markup": lambda s, d: _table(s, d, "pages").select("page_id", T.strip_markup(F.coalesce("html", F.lit(""))).alias("plain")),
        "drop_boilerplate": text(lambda t: T.drop_boilerplate(T.extract_reasoning(t)), "body"),
        "anonymisation_rate": text(T.anonymisation_rate, "rate"),
        "usable_documents": lambda s, d: _docs(s, d).where(T.word_count(F.col("text")) >= 150).select("doc_id", T.word_count(F.col("text")).alias("words")),
        "protect_restore": _protection,
        "sentence_features": seed(features.sentence_features), "paragraph_features": seed(features.paragraph_features), "anchor_retention": _anchors, "sensitive_inventory": seed(features.sensitive_inventory),
        "rewrite_candidates": seed(lambda x: rewrite.gates(rewrite.candidates(x)).drop("gen_order")), "rewrite_best": seed(rewrite.rewrite_best), "gate_reasons": _gate_reasons, "scored_candidates": seed(lambda x: rewrite.scored(rewrite.candidates(x)).drop("gen_order")), "rewrite_documents": seed(rewrite.rewrite),
        "headings": seed(structure.headings), "numbering_issues": seed(structure.numbering_issues), "section_check": seed(structure.section_check), "order_issues": seed(structure.order_issues), "section_bodies": seed(structure.section_bodies),
        "classify_family": seed(structure.classify_family), "classify_category": seed(structure.classify_category),
        "nearest_template": lambda s, d: structure.nearest_template(_docs(s, d), _table(s, d, "benchmark")),
        "statute_references": seed(legal.statute_references), "case_references": seed(legal.case_references), "verify_references": _verified, "letter_facts": seed(legal.letter_facts), "letter_remedies": seed(legal.remedies), "letter_parts": seed(legal.letter_parts),
        "bound_statutes": seed(references.statutes), "case_numbers": seed(references.cases), "reference_verdicts": _verdicts,
        "match_template": lambda s, d: alignment.match_template(_docs(s, d), _table(s, d, "benchmark")), "check_category": lambda s, d: alignment.check_category(_seeded(s, d), _table(s, d, "benchmark")),
        "letter_kind": seed(lambda x: replies.letter_kind(x, CATALOGUE).drop("text", "instruction")), "offered_replies": seed(lambda x: replies.offered(x, CATALOGUE)),
        "holidays": lambda s, d: legal.holidays(_table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()),
        "deadlines_days": _deadlines("day", 14), "deadlines_months": _deadlines("month", 1),
        "batch_summary": lambda s, d: reports.batch_summary(documents.document_signal(_seeded(s, d))), "rule_decisions": lambda s, d: reports.rule_decisions(_outcomes(s, d)),
        "readiness": lambda s, d: outcomes.readiness(_outcomes(s, d)).select("doc_id", "readiness"), "flow_summary": lambda s, d: outcomes.flow_summary(_outcomes(s, d)), "ai_use_summary": lambda s, d: outcomes.ai_use_summary(_outcomes(s, d)),
        "benchmark_summary": lambda s, d: outcomes.benchmark_summary(_outcomes(s, d)), "quality_summary": lambda s, d: outcomes.quality_summary(_outcomes(s, d)), "edit_rates": lambda s, d: outcomes.edit_rates(_outcomes(s, d), "lang", "en", "de"),
        "style_statistics": lambda s, d: outcomes.style_statistics(_docs(s, d)), "rule_separation": lambda s, d: outcomes.separation(_seeded(s, d), F.pmod("doc_id", F.lit(len(FRAGMENTS))) < 5),
        "protected_terms": _protected, "backfilled_labels": _backfilled, "family_profile": seed(structure.family_profile), "document_facts": seed(legal.document_facts),
        "roman_units": _unit_issues("roman"), "arabic_units": _unit_issues("arabic"), "paragraph_units": _unit_issues("paragraph"),
        "document_check": seed(structure.check_document), "corpus_partition": lambda s, d: structure.partition(seeded(_docs(s, d), first=True)), "classify_cascade": lambda s, d: structure.classify_cascade(_seeded(s, d), _table(s, d, "benchmark")),
        "redundancy_edits": lambda s, d: redundancy.edits(_redundant(s, d), fixtures.forms(s), fixtures.doublets(s)), "visible_changes": _visible_changes,
        "nominal_edits": lambda s, d: nominal.edits(_redundant(s, d), fixtures.forms(s)),
        "layout_blocks": lambda s, d: layout.blocks(_copies(s, d)).drop("row", "slots", "inline", "hint"), "layout_slots": lambda s, d: layout.slots(layout.blocks(_copies(s, d))).drop("row"),
        "template_findings": _template_findings, "template_verdicts": _template_verdicts,
        "slop_ngrams": seed(detect.slop_ngrams), "style_profile": seed(outcomes.style_profile),
        "signed_modality": seed(features.signed_modality), "entry_problems": _entries, "deadline_status": _deadline_status, "catalogue_terms": _catalogue,
        "slugs": text(lambda t: T.slug(t), "slug"), "masked_excerpts": lambda s, d: _seeded(s, d).select("doc_id", T.masked_excerpt(F.coalesce("text", F.lit(""))).alias("excerpt")),
        "resume_remaining": lambda s, d: reports.remaining(_docs(s, d).select("doc_id", "source"), _table(s, d, "labels"), "doc_id"),
        "embedding_similarity": lambda s, d: reports.label_similarity(_table(s, d, "embeddings")),
        "answer_signal": lambda s, d: documents.document_signal(_table(s, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 10000 + F.col("turn")).alias("doc_id"), "text")),
    }
