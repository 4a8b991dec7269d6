"""Hard negatives by norm-bucketed search.

Rows are labelled integer vectors (each component is floor(``SCALE`` times x)), scored by their inner product with an anchor. An anchor's positives are its ``positives``
best other rows of its label; for each of them the hard negatives are the ``k`` best rows of other labels whose scores lie in the positive's window,
from ``low`` to ``high`` percent of its score.

Search. Candidates are sorted by norm, largest first, and cut into buckets. By Cauchy-Schwarz no row of a bucket scores more than the anchor's norm
times the bucket's largest, so a bucket is passed over by each window whose lower limit, or whose running ``k``-th score, lies above that bound; as the norms only fall, the window is then done. The rest of
the bucket is scored by one matrix product. Positives are found by the same search with windows without limits.

Spark. Anchors and candidates meet in cells of an anchor block and a candidate block. For positives the blocks are shards of one label by hash, so each runs through all norms and its
running scores rise early. For negatives the candidate blocks are bands of norm (cut into shards where one norm is that frequent), the anchor blocks bands of
the least norm that an anchor's windows need: a band of candidates is sent only to the anchors that need no more than its largest norm, and an anchor only to the bands that its windows reach. The best of all cells are chosen per window, with a limit per group before the shuffle.

Scale. A stated anchor set meets all rows in blocks, at most ``CANDIDATES`` rows or ``HELD`` bytes of candidates and about ``ANCHORS`` anchors or ``ASKED`` bytes in a cell; labels, norms and repeated vectors may be as skewed as they like, as cells are dealt by hash within
them. The driver gets three numbers of each of at most ``BANDS`` bands.

Exactness. Products are exact integers: by float64 matrix products where the norms bound them (and so all their partial sums) below 2**53, by 64-bit
integers otherwise. Bounds are compared with a margin beyond rounding, towards keeping a bucket.

Defined results. Rows with a null id, label or vector, with null or non-finite components, without components or of another than the commonest length (the longer on ties) take no part, nor do rows of a scaled norm
of 2**28 or more, whose scores times 100 would not fit 64 bits. Ties go to the smaller id. Where ids repeat, each row is an anchor, a positive and a negative of its own, but a row of the anchor's id is no positive; an anchor without positives, or a
window without rows, has no rows in the result. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, small_batches

SCALE = 256
#: Most candidates and anchors in a cell, and most bytes of them.
CANDIDATES, HELD = 1 << 17, 64 << 20
ANCHORS, ASKED = 1 << 14, 16 << 20
#: Candidates of one norm bucket, and anchors that look at it together.
BUCKET = 1024
TOGETHER = 128
EXACT, MOST = 1 << 53, 1 << 28
MARGIN = 1 + 1e-9
#: Most bands of norm.
BANDS = 256
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Below all scores, and above them.
NONE, ALL = -(1 << 62), 1 << 62


def _matrix(column):
    """An Arrow list column of vectors of one length as an int64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def search(anchors, anchor_norm, windows, vectors, norm, ids, eligible, k: int, bucket: int = BUCKET):
    """The ``k`` best candidates in each window (window, candidate, score), and how many products were computed.

    ``windows`` are (anchor, low, high), ``norm`` falls, ``eligible(anchors, candidates)`` is the matrix of the pairs that count.
    """
    owner, low, high = windows
    exact = not len(vectors) or float(anchor_norm.max(initial=0.0)) * float(norm[0]) * MARGIN < EXACT
    kind = np.float64 if exact else np.int64
    best = [np.zeros(0, np.int64)] * 3
    kth = np.full(len(owner), NONE)
    live, scored = np.arange(len(owner)), 0
    x = anchors.astype(kind)
    for lo in range(0, len(vectors), bucket):
        bound = anchor_norm[owner[live]] * (float(norm[lo]) * MARGIN)
        live = live[(bound >= low[live]) & (bound >= kth[live])]
        if not len(live):
            break
        at = slice(lo, min(lo + bucket, len(vectors)))
        rows, of = np.unique(owner[live], return_inverse=True)
        scored += len(rows) * (at.stop - lo)
        product = x[rows] @ vectors[at].astype(kind).T
        ok, value = eligible(rows, at)[of], product[of]
        ok &= (value >= np.maximum(low[live], kth[live])[:, None]) & (value <= high[live][:, None])
        if k < ok.shape[1]:  # what lies below the bucket's own k-th best of a window cannot stay
            ok &= value >= np.partition(np.where(ok, value, NONE), ok.shape[1] - k, axis=1)[:, ok.shape[1] - k, None]
        w, c = np.nonzero(ok)
        if not len(w):
            continue
        new = live[w], lo + c, value[w, c].astype(np.int64)
        best = [np.concatenate(z) for z in zip(best, new, strict=True)]
        order = np.lexsort((ids[best[1]], -best[2], best[0]))
        best = [z[order] for z in best]
        place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [z[place < k] for z in best]
        last = place[place < k] == k - 1
        kth[best[0][last]] = best[2][last]
    return (*best, scored)


def _cell(same: bool, k: int, together: int = TOGETHER):
    """Search of one cell: anchors (id, label, norm, v, windows) and candidates (_row, _id, _label, _norm, _v)."""

    def job(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {c: [] for c in ("window", "row", "id", "score")}
        if asked.num_rows and held.num_rows:
            own = {c: held.column("_" + c).to_numpy() for c in ("norm", "id", "label", "row")}
            order = np.lexsort((own["id"], -own["norm"]))
            v, own = _matrix(held.column("_v"))[order], {c: x[order] for c, x in own.items()}
            norm, ids, label = own["norm"], own["id"], own["label"]
            for lo in range(0, asked.num_rows, together):
                part = asked.slice(lo, together).combine_chunks()
                a_id, a_label, a_norm = (part.column(c).to_numpy() for c in ("id", "label", "norm"))
                lists = part.column("windows").combine_chunks()
                flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                name, low, high = (flat.field(c).to_numpy() for c in ("window", "low", "high"))
                if same:
                    eligible = lambda rows, c: (label[c] == a_label[rows, None]) & (ids[c] != a_id[rows, None])  # noqa: B023, E731
                else:
                    eligible = lambda rows, c: label[c] != a_label[rows, None]  # noqa: B023, E731
                w, c, s, _ = search(_matrix(part.column("v")), a_norm, (owner, low, high), v, norm, ids, eligible, k)
                for column, x in (("window", name[w]), ("row", own["row"][c]), ("id", ids[c]), ("score", s)):
                    out[column].append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in out.items()})

    return job


def usable(vectors: DataFrame, label, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v as scaled integers, norm) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x")).where(
        "id is not null and label is not null and x is not null and size(x) > 0 and forall(x, y -> y is not null and not isnan(y) and abs(y) < double('infinity'))"
    )
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, y: total + F.pow(F.floor(y * scale).cast("double"), F.lit(2.0))))
    fit = rows.where(F.forall("x", lambda y: F.abs(y) < float(MOST // scale))).select("id", "label", F.transform("x", lambda y: F.floor(y * scale)).alias("v"), length.alias("norm")).where(F.col("norm") < float(MOST))
    common = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fit.where(F.size("v") == (common["d"] if common else 0))


def bands(rows: DataFrame, value: str, size: int, biggest: bool):
    """Cuts ``value`` into at most ``BANDS`` bands of about ``size`` rows: (the band of a row as a column, [(its extreme, its shards)])."""
    n = rows.count()
    parts = min(BANDS, max(1, math.ceil(n / size)))
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    extreme = F.max(value) if biggest else F.min(value)
    found = {r["band"]: (r["extreme"], math.ceil(r["n"] / size)) for r in rows.groupBy(band.alias("band")).agg(extreme.alias("extreme"), F.count("*").alias("n")).collect()}
    return band, found


def hard_negatives(
    vectors: DataFrame, label=None, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, candidates: int = CANDIDATES,
    anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by ``every``. ``label`` is a column expression."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(usable(vectors, F.col("label") if label is None else label, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    n = rows.count()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    dim = len(rows.select("v").first()["v"])
    anchors = min(anchors, max(64, ASKED // (8 * dim)))
    # So many cells that all cores have one, if there are rows for them.
    candidates = max(min(candidates, BUCKET), min(candidates, HELD // (8 * dim), math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    deal = lambda of, salt, row="row": F.pmod(F.xxhash64(row, F.lit(salt)), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), of.cast("int") - 1))
    schema = "window long, row long, id long, score long"
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id", "row"))
    limit = lambda low, high, window: F.struct(window.alias("window"), low.alias("low"), high.alias("high"))

    # Positives: shards of one label; the labels stay a table, as they may be many.
    shards = rows.groupBy("label").agg(F.ceil(F.count("*") / candidates).alias("h"), F.ceil(F.count(F.when(F.col("id") % every == 0, 1)) / anchors).alias("a")).where("a > 0")
    left = asked.withColumn("windows", F.array(limit(F.lit(NONE), F.lit(ALL), F.col("row")))).join(shards, "label").withColumn("x", deal(F.col("a"), 1)).withColumn("y", each(F.col("h")))
    every_row = rows.select(*(F.col(c).alias("_" + c) for c in rows.columns))
    right = every_row.join(shards.withColumnRenamed("label", "_label"), "_label").withColumn("y", deal(F.col("h"), 2, "_row")).withColumn("x", each(F.col("a")))
    found = left.drop("a", "h").groupBy("label", "x", "y").cogroup(right.drop("a", "h").groupBy("_label", "x", "y")).applyInArrow(_cell(True, positives), schema)
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    window = cut(best.select(F.col("window").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("window")), "windows")

    # Negatives: bands of norm against bands of the norm that windows need.
    least, most = (F.expr(f"({p} * positive_score {sign} pmod({way}{p} * positive_score, 100)) div 100") for p, sign, way in ((low, "+", "-"), (high, "-", "")))
    lists = window.select("anchor", limit(least, most, F.col("window")).alias("w")).where("w.low <= w.high").groupBy("anchor").agg(F.collect_list("w").alias("windows"))
    need = F.when(F.array_min("windows.low") <= 0, 0.0).otherwise(F.array_min("windows.low") / F.col("norm"))
    asking = cut(asked.join(lists, F.col("row") == F.col("anchor")).select("row", "id", "label", "norm", "v", "windows", need.alias("need")), "asking")
    if asking.isEmpty():
        return spark.createDataFrame([], RESULT)
    held_band, held = bands(every_row, "_norm", candidates, True)
    need_band, needed = bands(asking, "need", anchors, False)
    table = lambda found: F.array(*(F.struct(F.lit(b).alias("band"), F.lit(float(v)).alias("v"), F.lit(of).alias("of")) for b, (v, of) in sorted(found.items())))
    reached = lambda found, ok: F.explode(F.filter(table(found), ok))
    own = lambda band, found, *by: F.struct(band.alias("band"), deal(F.element_at(F.create_map(*(F.lit(x) for b, (_, of) in found.items() for x in (b, of))), band), *by).alias("shard"))
    left = asking.withColumn("a", own(need_band, needed, 3)).withColumn("to", reached(held, lambda b: F.col("need") <= b["v"] * MARGIN)).withColumn("to_shard", each(F.col("to.of"))).withColumn("c", F.struct(F.col("to.band"), F.col("to_shard").alias("shard")))
    largest = F.element_at(F.create_map(*(F.lit(x) for b, (v, _) in held.items() for x in (b, float(v)))), F.col("c.band"))
    right = every_row.withColumn("c", own(held_band, held, 4, "_row")).withColumn("to", reached(needed, lambda b: b["v"] <= largest * MARGIN)).withColumn("to_shard", each(F.col("to.of"))).withColumn("a", F.struct(F.col("to.band"), F.col("to_shard").alias("shard")))
    found = left.drop("to", "to_shard", "need", "row").groupBy("a", "c").cogroup(right.drop("to", "to_shard").groupBy("a", "c")).applyInArrow(_cell(False, k), schema)
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k).select("window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = window.join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").drop("anchor")
    return ranked.join(names, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
