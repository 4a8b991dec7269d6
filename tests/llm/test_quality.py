"""Operator 11: held-out labels, a plain restatement of its scores, and its edge rows."""

import math

import numpy as np
import zstandard
from conftest import DATA
from pyspark.sql import functions as F

from clausewise.llm import quality, queries


def plain(model, text):
    """The score of one text, block by block, from the model's dictionaries and weights."""
    raw, sizes = (text or "").encode(), []
    for data in model.dictionaries:
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(raw[i : i + 256])) for i in range(0, max(1, len(raw)), 256)))
    good, bad = sizes
    d, s, n = (bad - good) / (bad + good), math.log(min(sizes) / (len(raw) + 10)), math.log1p(len(raw))
    mean, scale, w = model.curve
    z = w[0] + sum(a * (x - m) / k for a, x, m, k in zip(w[1:], (d, s, n, d * n, d * s, s * s), mean, scale, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_held_out_labels(spark):
    out = queries.QUERIES["op11_quality_classifier"](spark, f"{DATA}/sf0.1").where("held_out").join(queries.table(spark, f"{DATA}/sf0.1", "labels"), "doc_id")
    rows = [(r["score"], r["predicted"], r["quality"]) for r in out.select("score", "predicted", "quality").collect()]
    score, predicted, label = (np.array(x) for x in zip(*rows, strict=True))
    assert all(p == (s >= 0.3) for s, p in zip(score, predicted, strict=True)) and score.min() >= 0 and score.max() <= 1
    pairs = (score[label == 1][:, None] > score[label == 0][None]).mean()
    assert pairs > 0.99 and predicted[label == 1].mean() > 0.99 and predicted[label == 0].mean() < 0.12


def test_scores_are_the_stated_ones(spark):
    docs, labels = (queries.table(spark, f"{DATA}/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~queries._fold(5, 0)))
    again = quality.fit(docs, labels.where(~queries._fold(5, 0)))
    assert model.dictionaries == again.dictionaries and np.allclose(model.curve[2], again.curve[2])
    assert all(len(d) <= quality.SIZE for d in model.dictionaries)
    hard = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "é" * 300_000), (-5, "a"), (-5, "a")], "doc_id long, text string")
    some = docs.select("doc_id", "text").where("doc_id < 150").unionByName(hard)
    got = quality.score(some.withColumn("score", F.lit("x")).withColumn("_c0", F.lit("y")), model).collect()
    assert len(got) == some.count()
    for r in got:
        assert abs(r["score"] - plain(model, r["text"])) < 1e-9 and r["_c0"] == "y"


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(i, 1) for i in range(20)], 1.0), ([(1, None), (None, 1)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["score"] for r in quality.score(docs, model).collect()} == {share}
    assert quality.score(docs.limit(0), model).count() == 0


def test_an_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 0), (7, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.curve is None and model.rate == 2 / 3


def test_few_blocks_make_a_dictionary():
    assert quality.dictionary([b"abc"]) == b"abc" and len(quality.dictionary([b"word %d " % i * 20 for i in range(2000)], 4096)) <= 4096
