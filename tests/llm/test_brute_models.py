"""Predictions and scores of whole tables against plain restatements of their definitions."""

import math
import re
from collections import Counter

import numpy as np
from conftest import DATA

from clausewise.llm import language_id, queries, toxicity
from clausewise.llm import text as tx


def grams(word):
    """Buckets of a word's trigrams, the word padded with a space on either side."""
    padded = b" " + word + b" "
    return [(int.from_bytes(padded[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> 16 for i in range(len(word))]


def letters(text):
    """Words of ASCII letters, folded, and of bytes above 127."""
    return re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


def mixture(like, use, rounds):
    """Proportions and log-likelihood of words (dicts of log-likelihoods) drawn from the languages in ``use``."""
    share = dict.fromkeys(use, 1 / len(use))
    odds = [{k: math.exp(w[k] - max(w[j] for j in use)) for k in use} for w in like]
    for _ in range(rounds):
        parts = [{k: o[k] * share[k] / sum(o[j] * share[j] for j in use) for k in use} for o in odds]
        share = {k: max(1e-12, sum(p[k] for p in parts) / len(parts)) for k in use}
    return share, sum(math.log(sum(o[k] * share[k] for k in use)) + max(w[k] for k in use) for o, w in zip(odds, like, strict=True))


def test_language_query_is_its_definition(spark):
    """All sets in the order of the first proportions are tried here, so the early end of the operator is tested too."""
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("h", queries._fold(4, 2)).collect()
    counts = {}
    for d in docs:
        if not d.h and d.lang is not None and d.text is not None:
            counts.setdefault(d.lang, Counter()).update(g for w in letters(d.text) for g in grams(w))
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + language_id.SMOOTH * language_id.BUCKETS for k in langs}
    score = lambda w: {k: sum(math.log((counts[k][g] + language_id.SMOOTH) / total[k]) for g in grams(w)) for k in langs}
    got = {r.doc_id: r for r in queries.op6_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        like = [score(w) for w in letters(d.text or "")]
        assert got[d.doc_id].held_out == d.h
        if not re.search(r"[^\W\d_]", d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)
            continue
        first, _ = mixture(like, langs, language_id.ROUNDS)
        order = sorted(langs, key=lambda k: -first[k])  # noqa: B023
        tried = []
        for size in range(1, len(langs) + 1):
            share, value = mixture(like, order[:size], language_id.ROUNDS if size > 1 else 0)
            tried.append((value - language_id.PENALTY * size * math.log(max(len(like), 2)), share))
        share = max(tried, key=lambda t: t[0])[1]
        best = max(sorted(share), key=share.get)
        assert got[d.doc_id].lang_pred == best and abs(got[d.doc_id].score - share[best]) < 1e-3


def best_segments(s):
    """The best segment, then those left and right of it."""
    out, work = [], [(0, len(s))]
    while work:
        lo, hi = work.pop()
        best, start, total = (0.0, 0, 0), lo, 0.0
        for i in range(lo, hi):
            if total <= 0:
                start, total = i, 0.0
            total += s[i]
            if total > best[0]:
                best = (total, start, i + 1)
        if best[0] > 0:
            out.append(best)
            work += [(lo, best[1]), (best[2], hi)]
    return out


def test_toxicity_query_is_its_definition(spark):
    """Every text scored word by word with the model that the query learns."""
    sf_dir = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries._fold(5, 0)))
    value = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    a, b = model.curve

    def hashed(word):
        data = np.frombuffer(word, np.uint8)
        return int(tx.hash_words(data, np.array([0]), np.array([len(data)]))[0])

    known, some = {}, 0
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for d in docs.select("doc_id", "text", queries._fold(5, 0).alias("h")).collect():
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (d.text or "").encode().lower())
        for w in set(words) - known.keys():
            known[w] = value.get(hashed(w), 0.0) - model.drift
        evidence = 0.0
        for s, _, _ in best_segments([known[w] for w in words]):
            surprise = model.lam * s - model.log_k - math.log(len(words))
            evidence += surprise if surprise > -math.log(toxicity.SIGNIFICANT) else 0.0
        some += evidence > 0
        want = 1 / (1 + math.exp(-(a + b * math.log1p(evidence))))
        assert got[d.doc_id].held_out == d.h and abs(got[d.doc_id].score - want) < 1e-6
        assert got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.5)
    assert some


def test_an_id_is_learned_from_once(spark):
    """Labels of one id are one by majority, its texts one by hash; a hot id in both tables makes no pairs."""
    rows = [(i, " ".join(f"{w} {k}{i}" for w, k in zip(("vile foul nasty" if i % 4 == 0 else "mild calm quiet").split(), "abc", strict=True)) + f" d{i} e{i} f{i}") for i in range(80)]
    labels = [(i, int(i % 4 == 0)) for i in range(80)]
    base = lambda rows, labels: toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    one, hot = base(rows, labels), base(rows + [rows[4]] * 3000, labels + [labels[4]] * 2000 + [(4, 0)] * 1000 + [(5, None)])
    assert len(one.words) and one.words.tolist() == hot.words.tolist() and np.allclose(one.scores, hot.scores) and np.allclose(one.curve, hot.curve)
