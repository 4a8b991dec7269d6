"""Language identification by mixture inference.

Fit. Byte trigrams of the letters of labelled texts (ASCII case folded, everything that is not a letter
a space) are counted per language over 2**16 hash buckets, with additive smoothing.

Infer. A document is taken as a mixture of languages: every word is drawn from one of them. Words'
log-likelihoods come from the trigram models, and expectation-maximisation over the words estimates
the proportions, first over all learned languages. It then runs for the likeliest language of these, the
likeliest two and so on; the set with the best log-likelihood less a penalty of ``PENALTY`` * ln(words)
per language is selected. A document is left when no larger set can win: no mixture at all exceeds the
log-likelihood of the first by more than words * ln(largest gradient per word). The prediction is
the language with the largest proportion, which is also its score.

Scale. At most ``SAMPLE`` labelled documents per language are counted (those whose id has the least
hash, picked by a hash bound, not by sorting), of the ``LANGUAGES`` with the most documents; counting combines before the shuffle. Prediction is one
narrow pass with a table of 2**16 floats per language.

A piece is smaller the more languages there are, so memory follows the longest text alone.

Defined results. A null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing can be learned. Ties go to the language that sorts first. Null languages and null ids are not
learned from. A very long text is read whole. An empty table has no rows. Repeated rows are predicted alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SAMPLE = 4_000
#: Most languages that are learned: labels beyond the most frequent ones are not, so junk labels do not fill the driver.
LANGUAGES = 200
BUCKETS = 1 << 16
SMOOTH = 0.1
ROUNDS = 6
PENALTY = 2.0

_plain = np.full(256, 0x20, dtype=np.uint8)
_plain[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_plain[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_plain[128:] = np.arange(128, 256)


def trigrams(data, offsets):
    """Buckets of the trigrams, the first trigram of each word, and the first word of each row.

    A word is padded with a space on either side; it has as many trigrams as letters (bytes).
    """
    plain = _plain[data]
    starts, ends, first = tx.find_words(plain, offsets, _is_space)
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])
    code = plain.astype(np.uint32)
    left = np.concatenate(([np.uint32(32)], code))[at]
    right = np.concatenate((code, [np.uint32(32)]))[at + 1]
    if len(at):
        left[begin[:-1]] = 32
        right[begin[1:] - 1] = 32
    gram = (left << np.uint32(16)) | (code[at] << np.uint32(8)) | right
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), begin, first


_is_space = np.zeros(256, dtype=bool)
_is_space[0x20] = True


def _count(langs):
    def job(batches):
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            total = {}
            for lo, hi in tx.pieces(offsets):
                gram, begin, first = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(begin[first]))
                for k in np.unique(lang[lo:hi]):
                    n = np.bincount(gram[lang[lo:hi][row] == k], minlength=BUCKETS)
                    total[k] = total[k] + n if k in total else n
            for k, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(some), k, np.int32)), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(n[some].astype(np.int64))})

    return job


class Model:
    """Languages in order and log-probabilities (bucket, language)."""

    def __init__(self, langs, table):
        self.langs, self.table = langs, table


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learns from about ``sample`` documents of each of the ``languages`` labels that most documents have (of equally frequent ones those that sort first)."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    # A hash bound that lets about ``sample`` documents of each language pass.
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / n[k]))])
    picked = base.where(F.col("lang").isin(langs)).where(F.expr("pmod(xxhash64(id, 7), 1000000) / 1000000D") < share[F.col("lang")])
    counts = picked.select("text", "lang").mapInArrow(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    table[counts.column("bucket").to_numpy(), counts.column("lang").to_numpy()] += counts.column("n").to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def _mixture(like, row, begin, use, rounds):
    """Proportions, log-likelihood and a bound on that of any proportions per row when only the languages in ``use`` (rows, m) take part."""
    some = np.flatnonzero(np.diff(begin))
    share = use / np.maximum(use.sum(axis=1, keepdims=True), 1)
    top = np.where(use[row], like, -np.inf).max(axis=1) if len(row) else np.zeros(0)
    odds = np.exp(np.where(use[row], like, -np.inf) - top[:, None])
    n = np.diff(begin)[some, None]
    for _ in range(rounds):
        part = odds * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = share.copy()
        share[some] = np.add.reduceat(part, begin[some]) / n
        share[some] = np.maximum(share[some], np.where(use[some], 1e-12, 0))
    whole = (odds * share[row]).sum(axis=1)
    total, most = np.zeros(len(begin) - 1), np.zeros(len(begin) - 1)
    total[some] = np.add.reduceat(np.log(whole) + top, begin[some])
    gradient = np.add.reduceat(odds / whole[:, None], begin[some]) / n
    most[some] = total[some] + n[:, 0] * np.log(gradient.max(axis=1))
    return share, total, most


def infer(model, data, offsets):
    """Chosen language index, its proportion and all proportions (rows, languages) for one piece."""
    gram, begin, first = trigrams(data, offsets)
    rows, words, kinds = len(offsets) - 1, len(begin) - 1, len(model.langs)
    like = np.add.reduceat(model.table[gram], begin[:-1], axis=0).astype(np.float64) if words else np.zeros((0, kinds))
    row = np.repeat(np.arange(rows), np.diff(first))
    share, _, most = _mixture(like, row, first, np.ones((rows, kinds), dtype=bool), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    n = np.maximum(np.diff(first), 2)
    best, full = np.full(rows, -np.inf), share
    for size in range(1, kinds + 1):
        live = np.flatnonzero((size == 1) | (most - PENALTY * size * np.log(n) > best))
        if not len(live):
            break
        count = np.diff(first)[live]
        begin = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(first[live] - begin[:-1], count) + np.arange(begin[-1])
        got, value, _ = _mixture(like[at], np.repeat(np.arange(len(live)), count), begin, rank[live] < size, ROUNDS if size > 1 else 0)
        value = value - PENALTY * size * np.log(n[live])
        better = value > best[live]
        best[live[better]] = value[better]
        full[live[better]] = got[better]
    return full.argmax(axis=1), full.max(axis=1), full


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, proportions) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches):
        model = sent.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            pred, score, shares = [], [], []
            for lo, hi in tx.pieces(offsets, max(1 << 14, tx.PIECE * 4 // max(4, len(model.langs)))):
                if model.langs:
                    best, part, full = infer(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    known = letters[lo:hi]
                else:
                    best, part, full, known = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros((hi - lo, 0)), np.zeros(hi - lo, bool)
                pred += names[np.where(known, best, len(model.langs))].tolist()
                score += np.where(known, np.minimum(part, 1.0), 0.0).tolist()
                shares += [[(model.langs[k], float(x[k])) for k in np.flatnonzero(x > 1e-6)] if ok else [] for x, ok in zip(full, known, strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "proportions": pa.array(shares, pa.map_(pa.string(), pa.float64()))})

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(job, f"id {kind}, lang_pred string, score double, proportions map<string, double>").withColumnRenamed("id", id_col)
