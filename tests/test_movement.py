"""What large tables may move: a document's text once, and nothing that is made of its lines or words."""

from pyspark.sql import functions as F

from wordloom.operators import layout, layout_check, structure
from wordloom.plans.fixtures import FILLED, TEMPLATE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_moved_once_texts_are_dealt(spark):
    docs = spark.createDataFrame([(1, FILLED), (1, TEMPLATE), (None, None)], "doc_id long, text string")
    p = plan(layout.blocks(docs))
    assert p.count("Exchange ") == 1 and p.index("Generate ") < p.index("Exchange ")  # the exchange is below


def test_word_pairs_are_not_moved_for_few_templates(spark, monkeypatch):
    texts = ["jeden dwa trzy cztery", "dwa trzy cztery pięć", "jeden dwa", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    templates = docs.where("doc_id < 4").select(F.col("doc_id").alias("item_id"), "text")
    near = structure.nearest_template(docs, templates, top=2)
    assert "SortMergeJoin" not in plan(near)
    monkeypatch.setattr(structure, "BROADCAST_ROWS", 0)
    moved = structure.nearest_template(docs, templates, top=2)
    assert "SortMergeJoin" in plan(moved)
    assert sorted(map(repr, near.collect())) == sorted(map(repr, moved.collect())) and near.count() > 4


def test_findings_move_only_texts_and_pairs(spark):
    docs = spark.createDataFrame([(1, FILLED), (2, TEMPLATE)], "doc_id long, text string")
    templates = spark.createDataFrame([(1, TEMPLATE)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 0)], "row long, item long")
    p = plan(layout_check.findings(pairs, layout.blocks(docs), layout.blocks(templates)))
    assert p.count("Exchange hashpartitioning") == 2  # one of the texts, one of the pairs
    assert p.count("Generate ") == 2 and "Union" not in p  # lines and findings are made once
