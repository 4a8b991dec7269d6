"""Toxicity learns from few labelled documents, and nothing from labels dealt by chance."""

from conftest import DATA
from pyspark.sql import functions as F

from clausewise.llm import queries, toxicity


def test_small_fit_scores_clear_words(spark):
    docs, labels = (queries.table(spark, f"{DATA}/sf0.001", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~queries._fold(5, 0)))
    assert len(model.words) and (model.scores > 0).all()
    out = toxicity.score(docs, model).join(labels, "doc_id")
    assert out.where("toxic = 1 and predicted = 1").count() >= 6 and out.where("toxic = 0 and predicted = 1").count() == 0


def test_labels_by_chance_teach_nothing(spark):
    docs, labels = (queries.table(spark, f"{DATA}/sf0.01", t) for t in ("documents", "labels"))
    dealt = labels.withColumn("toxic", (F.abs(F.xxhash64("doc_id", F.lit(5))) % 7 == 0).cast("int"))
    assert len(toxicity.fit(docs, dealt).words) <= 1
