"""Substring dedup: seed and extend over winnowed anchors.

A passage of ``window`` words that also starts earlier in the corpus (smaller id, or the same
document further left) is a repeat; every word that such a window covers is removed.

Seed. The k-word shingles of each document are winnowed: the least hash in each run of
``window - k + 1`` shingles (rightmost on ties) is an anchor. Every window of ``window`` words
holds the anchor chosen from its own words alone, so equal windows choose the same anchor at
the same place and documents need to be brought together on anchors only.

Extend. An anchor answers for the windows that chose it, a run of at most ``window - k + 1``
starts. Its *reach* is the words those windows span, to the left and to the right. Anchors
with equal reach form one class; all of a class but its earliest member are repeats over the
whole reach (no pairs are formed, the class is one aggregate). Where one anchor has several
reaches (the edges of a shared passage), the extension is decided window by window inside
the reach, again by one aggregate over (anchor, window). Neighbouring repeats are merged
per document, which leaves the maximal repeats of at least ``window`` words.

Scale. Only hashes travel until the end: (1) counts of anchor hashes, (2) the earliest member
of each class of the anchors that occur twice, (3) the earliest place of each window of the
anchors with several reaches, all three with map-side combining, so that a passage that a
third of all documents share costs one row per task. Which anchors occur twice, and which have
several reaches, is told to the tasks by bit filters while these stay within their bound
(``store.MOST_BITS``). Beyond it the same facts are joined: anchors with the repeated hashes
(a join that adaptive execution splits where one hash is hot), and each document with the places
of its own repeats. Texts are shuffled once with filters, twice without.

Defined results. A null text has no words; an empty table has no rows. Documents of fewer than ``window`` words lose
nothing. A null id comes after all others. Rows that share an id (null ids too) are ordered by a 64-bit hash of
their text, which is carried whole beside the id; rows that repeat id and text count as one document and get equal
results. Very long texts are one row of one batch, worked on whole. Windows are told apart by 128 bits of hash (the anchor
and its place, and the words). Other columns are passed on untouched, whatever their names (the names that this operator adds are replaced).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import Filter, cut, small_batches

SHINGLE = 5
LAST = (1 << 63) - 1
LISTS = ("_firsts", "_windows", "_repeats", "_edges")
ADDED = ("n_words", "n_removed", "spans", "kept_text")


class Anchors:
    """Anchors of the rows of one piece: their hash, reach, row and windows."""

    def __init__(self, data, offsets, window: int, k: int):
        starts, ends, self.first = tx.find_words(data, offsets)
        self.window = window
        self.n = len(starts)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        empty = np.zeros(0, dtype=np.int64)
        self.hash = self.reach = np.zeros(0, dtype=tx.U)
        self.lo = self.hi = self.at = empty
        if self.n < window:
            return
        words = tx.hash_words(data, starts, ends)
        grams, self.runs = tx.runs(words, k), tx.runs(words, window)
        chosen = tx.sliding_argmin(grams, window - k + 1)
        begin = np.flatnonzero(self.row[: self.n - window + 1] == self.row[window - 1 :])
        if not len(begin):
            return
        chosen = chosen[begin]
        edge = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        self.lo, self.hi = begin[edge], begin[np.concatenate((edge[1:], [len(begin)])) - 1]
        self.at = chosen[edge]
        self.hash = grams[self.at]
        # The first and the last window cover the whole reach between them.
        span = tx.join(self.runs[self.lo], self.runs[self.hi])
        self.reach = tx.join(span, ((self.at - self.lo) << 32 | (self.hi - self.lo)).astype(tx.U))

    def places(self, key, mark, lo):
        """Columns that say where the starts ``lo`` are: the row's key and mark, and the word in the row."""
        row = self.row[lo]
        return {"key": key[row], "mark": mark[row], "place": lo - self.first[row]}

    def windows(self, keep):
        """(anchor index, start) of every window of the kept anchors."""
        a = np.flatnonzero(keep)
        count = self.hi[a] - self.lo[a] + 1
        anchor = np.repeat(a, count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.lo[anchor]
        return anchor, start

    def window_keys(self, anchor, start):
        """128 bits for (anchor, place of the window around it, its words)."""
        return tx.mix(self.hash[anchor] + (self.at[anchor] - start).astype(tx.U)), self.runs[start]


def _pieces(batch, window, k):
    data, offsets = tx.column_bytes(batch.column("text"))
    for lo, hi in tx.pieces(offsets):
        yield lo, hi, Anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, k)


def _longs(**columns):
    return pa.RecordBatch.from_pydict({n: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for n, v in columns.items()})


def _hash_job(window, k):
    def job(batches):
        for batch in batches:
            for _, _, a in _pieces(batch, window, k):
                if len(a.hash):
                    yield _longs(h=a.hash)

    return job


def _reach_job(window, k, seen):
    def job(batches):
        for batch in batches:
            key, mark = batch.column("_key").to_numpy(), batch.column("_mark").to_numpy()
            for lo, hi, a in _pieces(batch, window, k):
                ok = seen.passes(a.hash) if seen else np.ones(len(a.hash), dtype=bool)
                if ok.any():
                    start = a.lo[ok]
                    yield _longs(h=a.hash[ok], reach=a.reach[ok], **a.places(key[lo:hi], mark[lo:hi], start))

    return job


def _window_job(window, k, seen, edges):
    """Windows of the anchors that pass both filters, or else of those that the document lists in ``_edges``."""

    def job(batches):
        for batch in batches:
            key, mark = batch.column("_key").to_numpy(), batch.column("_mark").to_numpy()
            own = None if edges else Listed(batch.column("_edges"))
            for lo, hi, a in _pieces(batch, window, k):
                anchor, start = a.windows(seen.passes(a.hash) & edges.passes(a.hash) if edges else own.holds(lo, hi, a, a.lo))
                if len(anchor):
                    seed, words = a.window_keys(anchor, start)
                    yield _longs(seed=seed, words=words, **a.places(key[lo:hi], mark[lo:hi], start))

    return job


class Listed:
    """Places in their own text that the rows of a list<bigint> column hold; nulls are empty."""

    def __init__(self, column):
        n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
        if column.null_count:
            n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, n)
        self.n, self.values = n, column.flatten().to_numpy().astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(n)))

    def holds(self, lo, hi, a, places):
        """Which of the ``places`` of the piece ``a`` of rows lo to hi are listed."""
        listed = self.values[self.begin[lo] : self.begin[hi]] + np.repeat(a.first[:-1], self.n[lo:hi])
        if not len(listed) or not len(places):
            return np.zeros(len(places), dtype=bool)
        listed.sort()
        spot = np.minimum(np.searchsorted(listed, places), len(listed) - 1)
        return listed[spot] == places


def _apply_job(window, k, seen, edges, schema):
    """Marks repeats in each text from the places that its own document lists.

    With filters: known anchors that are not the first of their class are repeats. Without: those in ``_repeats``.
    Windows of the first ones at edges are repeats unless they are listed as the first of their kind.
    """

    def job(batches):
        for batch in batches:
            firsts, windows, repeats, edge = (Listed(batch.column(c)) for c in LISTS)
            texts = batch.column("text")
            n_words, n_removed, spans, kept = [], [], [], []
            for lo, hi, a in _pieces(batch, window, k):
                if seen:
                    known, first = seen.passes(a.hash), firsts.holds(lo, hi, a, a.lo)
                    repeat, at_edge = known & ~first, known & first & edges.passes(a.hash)
                else:
                    repeat, at_edge = repeats.holds(lo, hi, a, a.lo), edge.holds(lo, hi, a, a.lo)
                gone = np.zeros(a.n + 1, dtype=np.int64)
                np.add.at(gone, a.lo[repeat], 1)
                np.add.at(gone, a.hi[repeat] + window, -1)
                _, start = a.windows(at_edge)
                start = start[~windows.holds(lo, hi, a, start)]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for r in range(lo, hi):
                    mine = gone[a.first[r - lo] : a.first[r - lo + 1]]
                    words = (texts[r].as_py() or "").encode("utf-8").split()
                    n_words.append(len(words))
                    n_removed.append(int(mine.sum()))
                    if n_removed[-1]:
                        step = np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                        words = itertools.compress(words, ~mine)
                    else:
                        spans.append([])
                    kept.append(b" ".join(words).decode("utf-8"))
            new = {"n_words": n_words, "n_removed": n_removed, "spans": spans, "kept_text": kept}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return job


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shingle: int = SHINGLE, most_bits: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (removed word ranges) and kept_text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 1 <= shingle <= window:
        raise ValueError("shingle must lie between 1 and window")
    small_batches(docs.sparkSession)
    docs = docs.drop(*ADDED)
    keep = [c for c in docs.columns if c not in (id_col, text_col)]
    # Columns travel under private names, so that none can clash with the operator's own.
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("_key"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_mark"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(keep)],
    )
    slim = base.select("_key", "_mark", "text")
    counts = slim.select("text").mapInArrow(_hash_job(window, shingle), "h long").groupBy("h").count()
    twice = cut(counts.where("count > 1").select("h"), "repeated")
    seen = Filter.make(twice, "h", most_bits)
    where = "key long, mark long, place long"
    places = slim.mapInArrow(_reach_job(window, shingle, seen), f"h long, reach long, {where}")
    if not seen:
        places = cut(places.join(twice, "h", "left_semi"), "places")
    # Earliest member of each class; with a filter also of anchors that only seem to be repeated.
    least = F.min(F.struct("key", "mark", "place")).alias("f")
    firsts = cut(places.groupBy("h", "reach").agg(least).select("h", "reach", "f.*"), "firsts")
    several = cut(firsts.groupBy("h").count().where("count > 1").select("h"), "edges")
    edges = Filter.make(several, "h", most_bits) if seen else None
    listed = lambda rows, name: rows.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), F.col("place").alias("at"), F.lit(name).alias("list"))
    source, lists = slim, []
    if edges:
        lists.append(listed(firsts, "_firsts"))
    else:
        if seen:  # too many edges for a filter: from here on by joins, with the places found so far
            places, seen = cut(places, "places"), None
        at_edge = cut(listed(firsts.join(several, "h", "left_semi"), "_edges"), "at_edge")
        per_doc = at_edge.groupBy("_key", "_mark").agg(F.collect_list("at").alias("_edges"))
        source = slim.join(per_doc, ["_key", "_mark"])
        first = firsts.select("h", "reach", F.struct("key", "mark", "place").alias("first"))
        later = places.join(first, ["h", "reach"]).where(F.struct("key", "mark", "place") != F.col("first"))
        lists += [at_edge, listed(later, "_repeats")]
    windows = source.mapInArrow(_window_job(window, shingle, seen, edges), f"seed long, words long, {where}")
    windows = windows.groupBy("seed", "words").agg(least).select("f.*")
    lists.append(listed(windows, "_windows"))
    rows = functools.reduce(DataFrame.unionByName, lists)
    own = rows.groupBy("_key", "_mark").agg(*[F.collect_list(F.when(F.col("list") == n, F.col("at"))).alias(n) for n in LISTS])
    joined = base.join(own, ["_key", "_mark"], "left")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_text", T.StringType())]
    out = T.StructType([f for f in joined.schema if f.name not in ("_key", "_mark", *LISTS)] + added)
    marked = joined.mapInArrow(_apply_job(window, shingle, seen, edges, to_arrow_schema(out)), out)
    back = {"_id": id_col, "text": text_col} | {f"_x{i}": c for i, c in enumerate(keep)}
    order = {c: i for i, c in enumerate(docs.columns)}
    named = sorted(back.items(), key=lambda p: order[p[1]])
    return marked.select(*[F.col(a).alias(b) for a, b in named], *[f.name for f in added])
