"""Toxicity by maximum-scoring segments.

Fit. The labelled documents that hold a word are counted by label, once each, and the word's log-odds
between the labels is taken under a Dirichlet prior, proportional to its overall frequency and half a document besides. Words whose
counts differ between the labels by an exact test are kept (at most ``WORDS`` of them, the surest). The test is corrected
for the number of words compared: the bound is the largest at which chance alone would keep no more than a share ``FALSE``
of the words kept, given in how many documents each word is, so that rare words, which cannot pass, cost small fits
nothing. Every other word scores nothing but the drift, so that clean text drifts downwards.
Near copies would make any word of theirs look decisive, so a document is learned from only if its id is
the least of all that share any of its ``MARKS`` min-hashes.

Scan. All maximal scoring segments of a text are found in one linear pass over its words (runs of
words that do not score are summed first). Segment scores are made comparable by extreme-value
statistics: lambda solves sum p(s) exp(lambda s) = 1 over clean text, K is fitted to the best segments of clean
documents, and a segment of score S in n words has the expected number E = K n exp(-lambda S). Segments
with E below ``SIGNIFICANT`` are toxic passages; -ln E summed over them is the evidence, and a logistic
curve fitted on the labelled documents turns it into a score from 0 to 1.

Scale. The fit reads at most ``SAMPLE`` labelled documents (chosen by a hash of their id); their ids go to
the executors, so no text is shuffled. Scoring is one narrow pass with a model of fixed size.

Defined results. Null and empty texts have no evidence and get the score of that. Null ids are never
learned from. An id counts once: of its labels those of the majority (toxic if even), of its texts that with the least
hash; null labels do not count. Without labels of both kinds
the score is the share of toxic labels (0 without any). Repeated rows and ties are scored alike; very long texts are scanned whole, word hashes of a megabyte at a time; an empty
table has no rows, and learned from it every score is that share. Other columns are kept; those named score, predicted and passages are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import cut, small_batches

SAMPLE = 20_000
WORDS = 50_000
FALSE = 0.05
MARKS = 8
PRIOR = 100.0
#: Documents that the prior adds to each word under either label, so that a word seen under one of them only scores by how often it was.
HALF = 0.5
DRIFT = 0.25
SIGNIFICANT = 0.05
U = tx.U

#: Words are runs of ASCII letters and digits and of bytes above 127; case is folded for ASCII.
_apart = np.array([not (chr(b).isalnum() or b > 127) if b < 128 else False for b in range(256)])
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] = _fold[ord("a") : ord("z") + 1]


def _hashed(data, offsets):
    """Word hashes of the rows of one piece and each row's first word."""
    starts, ends, first = tx.find_words(data, offsets, _apart)
    return tx.hash_words(_fold[data], starts, ends), first


def _word_counts(batches):
    for batch in batches:
        data, offsets = tx.column_bytes(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for lo, hi in tx.pieces(offsets, 8 << 20):
            words, first = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            words, first = tx.sorted_sets(words, first)
            bad = np.repeat(toxic[lo:hi], np.diff(first)) == 1
            word, at = np.unique(words, return_inverse=True)
            n = np.bincount(at, minlength=len(word))
            t = np.bincount(at[bad], minlength=len(word))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "bad": pa.array(t.astype(np.int64)), "good": pa.array((n - t).astype(np.int64))})


def _min_hashes(batches):
    """(id, which, mark): the least hashes of each text's five-word shingles under MARKS hash functions."""
    for batch in batches:
        data, offsets = tx.column_bytes(batch.column("text"))
        ids = batch.column("id").to_numpy()
        for lo, hi in tx.pieces(offsets):
            values, begin = tx.row_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 5)
            some = np.flatnonzero(np.diff(begin))
            for which in range(MARKS if len(some) else 0):
                mark = np.minimum.reduceat(tx.mix(values + U(which)), begin[some])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[lo + some]), "which": pa.array(np.full(len(some), which, np.int32)), "mark": pa.array(mark.view(np.int64))})


def segments(at, score, n, drift):
    """All maximal scoring segments of a sequence of n words: (start, end, score), in order.

    ``at`` and ``score`` give the words that score; all others score -drift. Linear: each candidate is
    merged into an earlier one at most once, found through links to the last lower prefix sum.
    """
    out = []  # candidates: start, end, prefix sum before, prefix sum after, link
    total, last = 0.0, 0
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - last)
        last = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, i + 1, left, total, j))
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, right - left) for a, b, left, right, _ in out]


class Model:
    """Scores of words and the calibration; a few hundred kilobytes at most."""

    def __init__(self, words, scores, drift=DRIFT):
        order = np.argsort(words)
        self.words, self.scores, self.drift = words[order], scores[order], drift
        self.rate, self.lam, self.log_k, self.curve = 0.0, 1.0, 0.0, None

    def passages(self, words):
        """Maximal segments of one text's word hashes."""
        if not len(self.words) or not len(words):
            return []
        spot = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        at = np.flatnonzero(self.words[spot] == words)
        score = self.scores[spot[at]] - self.drift
        if not (score > 0).any():
            return []
        return segments(at.tolist(), score.tolist(), len(words), self.drift)

    def log_e(self, score, n):
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def judge(self, words):
        """(evidence, passages as (start, end, -ln E)) of one text."""
        found = [(a, b, -self.log_e(s, len(words))) for a, b, s in self.passages(words)]
        found = [p for p in found if p[2] > -math.log(SIGNIFICANT)]
        return sum(p[2] for p in found), found

    def probability(self, evidence):
        if self.curve is None:
            return self.rate
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * math.log1p(evidence)))))


def _texts(batch, column="text"):
    """(row, word hashes) of every row of a batch."""
    data, offsets = tx.column_bytes(batch.column(column))
    for lo, hi in tx.pieces(offsets):
        words, first = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for r in range(hi - lo):
            yield lo + r, words[first[r] : first[r + 1]]


def _best_segments(model):
    """Per labelled document: its words and its best segment; used to fit K."""

    def job(batches):
        for batch in batches:
            n, best = [], []
            for _, words in _texts(batch):
                n.append(len(words))
                best.append(max((s for _, _, s in model.value.passages(words)), default=0.0))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "n": pa.array(n, pa.int64()), "best": pa.array(best, pa.float64())})

    return job


def _evidence(model):
    def job(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "evidence": pa.array([model.value.judge(w)[0] for _, w in _texts(batch)], pa.float64())})

    return job


def _lambda(score, share):
    """The positive root of sum share * exp(lambda * score) = 1 (the mean is negative)."""
    if not (score > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * score, 700))).sum())
    while value(hi) < 1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return hi


def _logistic(x, y):
    """Slope and intercept by Newton's method with a weak ridge; the slope is not negative."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def _exact(n, n_bad, n_good):
    """Toxic counts that a word of n documents can have, their chances and their two-sided p-values, labels being exchangeable."""
    total, k = n_bad + n_good, np.arange(max(0, n - n_good), min(n, n_bad) + 1)
    ln = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, total + 1)))))
    choose = lambda a, b: ln[a] - ln[b] - ln[a - b]
    chance = np.exp(choose(n_bad, k) + choose(n_good, n - k) - choose(total, n))
    return k, chance, np.minimum(1.0, 2 * np.minimum(np.cumsum(chance), np.cumsum(chance[::-1])[::-1]))


def _decisive(bad, good, words, n_bad, n_good):
    """Which pairs of counts, of so many words each, are kept (Benjamini and Hochberg's step-up rule for discrete tests)."""
    n, p = bad + good, np.ones(len(bad))
    sizes, spot = np.unique(n, return_inverse=True)
    for i, size in enumerate(sizes):
        k, _, value = _exact(size, n_bad, n_good)
        p[spot == i] = value[bad[spot == i] - k[0]]
    bounds, at = np.unique(p, return_inverse=True)
    found = np.cumsum(np.bincount(at, words))
    by_chance = np.zeros(len(bounds) + 1)
    for size, several in zip(sizes, np.bincount(spot, words), strict=True):
        _, chance, value = _exact(size, n_bad, n_good)
        np.add.at(by_chance, np.searchsorted(bounds, value), several * chance)
    ok = np.flatnonzero((bounds <= FALSE) & (np.cumsum(by_chance[:-1]) <= FALSE * found))
    return p <= (bounds[ok[-1]] if len(ok) else -1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled ids, those with the least hash."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    train = cut(base.join(F.broadcast(known), "id").select("id", "text", "toxic"), "labelled")
    if not train.groupBy("id").count().where("count > 1").isEmpty():  # combined before the shuffle, so an id that very many rows share is no load
        train = cut(train.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "toxic"), "labelled")
    marks = train.select("id", "text").mapInArrow(_min_hashes, "id long, which int, mark long").distinct()
    least = marks.groupBy("which", "mark").agg(F.min("id").alias("id")).groupBy("id").count().where(F.col("count") == MARKS).select("id")
    train = cut(train.join(F.broadcast(least), "id").select("text", "toxic"), "train")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = n.get(1, 0) / max(1, sum(n.values()))
    counts = cut(train.mapInArrow(_word_counts, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")
    r = {x["toxic"]: x["count"] for x in train.groupBy("toxic").count().collect()}
    bad, good = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        model = Model(np.zeros(0, U), np.zeros(0))
        model.rate = rate
        return model
    prior = F.col("bad").cast("double").__add__(F.col("good")) * (PRIOR / (bad + good)) + HALF
    odds = lambda c, total: F.log((F.col(c) + F.col("prior")) / (total + PRIOR - F.col(c) - F.col("prior")))
    rated = counts.withColumn("prior", prior).withColumn("score", odds("bad", bad) - odds("good", good))
    # Likelihood ratio of a word's documents by label against the labels' shares of all documents.
    n_bad, n_good = (r.get(x, 0) for x in (1, 0))
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("bad") + F.col("good")) * share))).otherwise(0.0)
    rated = rated.withColumn("ratio", 2 * (part("bad", n_bad / (n_bad + n_good)) + part("good", n_good / (n_bad + n_good))))
    pairs = counts.groupBy("bad", "good").agg(F.count("*").alias("words")).toArrow()
    ok = _decisive(*(pairs.column(c).to_numpy() for c in ("bad", "good", "words")), n_bad, n_good)
    chosen = spark.createDataFrame(pairs.filter(pa.array(ok)).select(["bad", "good"]))
    kept = rated.join(F.broadcast(chosen), ["bad", "good"]).orderBy(F.desc("ratio"), "word").limit(WORDS).select("word", "score", "good").toArrow()
    model = Model(kept.column("word").to_numpy().view(U), kept.column("score").to_numpy())
    model.rate = rate
    # Clean text: the kept words at their smoothed frequency, all other words at the drift.
    freq = (kept.column("good").to_numpy() + 0.5) / (good + 0.5 * max(1, len(kept)))
    score = np.append(kept.column("score").to_numpy() - DRIFT, -DRIFT)
    model.lam = _lambda(score, np.append(freq, max(0.0, 1 - freq.sum())))
    sent = spark.sparkContext.broadcast(model)
    # Maximum likelihood of K when lambda is known: documents / sum of n exp(-lambda best).
    fitted = train.where("toxic = 0").mapInArrow(_best_segments(sent), "toxic int, n long, best double").where("n > 0")
    mass, clean = fitted.agg(F.sum(F.col("n") * F.exp(-model.lam * F.col("best"))), F.count("*")).first()
    model.log_k = math.log(clean / mass) if mass else 0.0
    sent = spark.sparkContext.broadcast(model)
    seen = train.mapInArrow(_evidence(sent), "toxic int, evidence double").toArrow()
    model.curve = _logistic(np.log1p(seen.column("evidence").to_numpy()), seen.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted and passages (word ranges with -ln E); columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    added = ("score", "predicted", "passages")
    docs = docs.drop(*added)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    source = names[docs.columns.index(text_col)]
    base = docs.toDF(*names)
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())])
    out = T.StructType([*base.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(place))])
    schema = to_arrow_schema(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches):
        for batch in batches:
            scores, found = [], []
            for _, words in _texts(batch, source):
                evidence, passages = sent.value.judge(words)
                scores.append(sent.value.probability(evidence))
                found.append([{"start": a, "end": b, "evidence": e} for a, b, e in passages])
            new = {"score": scores, "predicted": [int(s >= 0.5) for s in scores], "passages": found}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return base.mapInArrow(job, out).toDF(*docs.columns, *added)
