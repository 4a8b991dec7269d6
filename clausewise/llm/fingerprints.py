"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` least distinct 64-bit hashes of a document's five-word shingles (fewer words:
one shingle of all of them). Sketches of parts merge into the sketch of the whole, and two sketches
estimate resemblance (Jaccard), containment and the number of distinct shingles; below ``k``
shingles all figures are exact. A fingerprint is a sketch in base64, values big-endian, ascending.

Defined results. Null texts count as empty; a text without words has the empty fingerprint, which is like
another empty one (1) and unlike all others (0). Rows come in the order of id, then of two hashes of
the text; null ids come last; each row is a document, repeated rows too (one of equal rows is followed by the next other
row, the rest by themselves). The only row of a table is followed by itself; an empty table has no rows. A very long text is
one row of one batch, read whole. Other columns are ignored, whatever their names.

Scale. The texts are shuffled once, in ranges of the order. A range that one id would fill is cut by the hash of its
texts, and equal rows travel as one row with a count, so an id (or none) that any share of the rows has is dealt over many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import cut, small_batches

K = 128
SHINGLE = 5
LAST = (1 << 63) - 1
U = tx.U


def pack(sketch) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode("ascii")


def unpack(fingerprint: str):
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(U)


def merge(a, b, k: int = K):
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def distinct(sketch, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * 2.0**64 / (float(sketch[k - 1]) + 1)


def resemblance(a, b, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a).__and__(np.isin(both, b)).sum()) / len(both)


def containment(a, b, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def sketches(texts, k: int = K, shingle: int = SHINGLE):
    """Sketches of an Arrow string column: (values, begin of each row)."""
    data, offsets = tx.column_bytes(texts)
    values, sizes = [], []
    for lo, hi in tx.pieces(offsets):
        v, begin = tx.sorted_sets(*tx.row_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle))
        n = np.minimum(np.diff(begin), k)
        values.append(v[np.repeat(begin[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        sizes.append(n)
    n = np.concatenate([[0], *sizes]).astype(np.int64)
    return np.concatenate([np.zeros(0, U), *values]), np.cumsum(n)


def rows_of(sketch, rows):
    """Some rows of (values, begin)."""
    values, begin = sketch
    n = np.diff(begin)[rows]
    ends = np.cumsum(n)
    return values[np.repeat(begin[:-1][rows] - ends + n, n) + np.arange(n.sum())], np.concatenate(([0], ends))


def alike(a, b, k: int = K):
    """``resemblance`` of many pairs; a and b are (values, begin) as ``sketches`` returns them."""
    rows = len(a[1]) - 1
    value = np.concatenate((a[0], b[0]))
    row = np.concatenate([np.repeat(np.arange(rows), np.diff(x[1])) for x in (a, b)])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    rank = np.cumsum(new)
    size = np.bincount(row, minlength=rows)
    rank -= (rank - new)[(np.cumsum(size) - size)[row]]
    twice = np.flatnonzero(~new)
    shared = np.bincount(row[twice[rank[twice] <= k]], minlength=rows)
    size = np.minimum(np.bincount(row[new], minlength=rows), k)
    return np.where(size > 0, shared / np.maximum(size, 1), 1.0)


def _packed(sketch):
    values, begin = sketch
    return [pack(values[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) of every row, without a shuffle."""

    def job(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fingerprint": pa.array(_packed(sketches(batch.column("text"), k, shingle)), pa.string())})

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(job, "id long, fingerprint string").withColumnRenamed("id", id_col)


ROW = ("key", "mark", "other")
#: Repeated rows of which the keys are sent to all executors (some 40 bytes each).
SENT = 250_000
#: Copies of one row that are written out together.
COPIES = 1000


def _array(values, kind="bigint"):
    return f"cast(array({','.join(map(str, values))}) as array<{kind}>)"


def _parts(slim: DataFrame, total: int, target: int, most: int):
    """Number of ranges, and the expression that gives a row's range from its key and mark."""
    count = max(1, min(most, math.ceil(total / target)))
    if count == 1:
        return 1, F.lit(0)
    at = [i / count for i in range(1, count)]
    found = Counter(int(x) for x in slim.agg(F.percentile_approx("key", at, min(1_000_000, 100 * count))).first()[0])
    bounds = sorted(found)
    # Binary search in two levels: the block, then the place in it.
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = f"size(filter({_array([b[0] for b in blocks])}, x -> x <= key))"
    inside = f"size(filter(element_at(array({','.join(_array(b) for b in blocks)}), {block}), x -> x <= key))"
    place = f"if({block} = 0, 0, ({block} - 1) * {step} + {inside})"
    if len(bounds) == count - 1:
        return count, F.expr(place)
    # A key that is several bounds has several ranges, by its rows' marks; its last one takes the keys up to the next bound too.
    widths = [1] + [found[b] for b in bounds]
    before = [0, *itertools.accumulate(widths)][:-1]
    sub = f"if(key = element_at({_array([bounds[0], *bounds])}, at + 1), shiftright(shiftright(mark, 32) * width, 31), width - 1)"
    return sum(widths), F.expr(
        f"element_at(transform(array({place}), at -> element_at({_array(before)}, at + 1) + element_at(transform(array(element_at({_array(widths)}, at + 1)), width -> {sub}), 1)), 1)"
    ).cast("int")


def in_order(base: DataFrame, target: int = 4 << 20, most: int = 20_000) -> tuple[DataFrame, bool]:
    """Rows (key, mark, other, id, text) in ranges of that order (``part``), equal ones as one with its number ``n``, each range with the row that follows it;
    and whether any rows are equal.

    Which row comes first in each range is found on the slim keys, at most ``most`` of which reach the driver; it is sent to the range before
    too, marked as its tail (``tail`` = 1). The last range is followed by the first row of all. One shuffle of the
    rows, to as many tasks as there are ranges of about ``target`` bytes.
    """
    slim = cut(base.select(*ROW, F.octet_length("text").alias("bytes")), "places")
    total = slim.agg(F.sum(F.col("bytes") + 32)).first()[0]
    empty = base.withColumns({"n": F.lit(1).cast("long"), "part": F.lit(0), "tail": F.lit(0)})
    if total is None:
        return empty, False
    rows = base.withColumn("n", F.lit(1).cast("long"))
    repeated = cut(slim.groupBy(*ROW).count().where("count > 1").select(*ROW), "repeated")
    if n := repeated.count():
        some = F.broadcast(repeated) if n <= SENT else repeated
        one = base.join(some, [*ROW], "left_semi").groupBy(*ROW).agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n"))
        rows = rows.join(some, [*ROW], "left_anti").unionByName(one)
    count, part = _parts(slim, total, target, most)
    first = sorted(slim.groupBy(part.alias("part")).agg(F.min(F.struct(*ROW)).alias("row")).collect())
    heads = [(*row, first[i - 1].part, 1) for i, (_, row) in enumerate(first)]
    heads = base.sparkSession.createDataFrame(heads, "key long, mark long, other long, part int, tail int")
    tails = rows.join(F.broadcast(heads), [*ROW]).select(*rows.columns, "part", "tail")
    rows = rows.withColumns({"part": part, "tail": F.lit(0)}).unionByName(tails)
    return rows.repartition(count, "part").sortWithinPartitions("part", "tail", *ROW), n > 0


def _edits(k, shingle):
    """Streams ordered rows and pairs each with the next one of its range."""

    def work(ids, copies, texts, after):
        half = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, after, half, strict=True)]
        # What follows a row is mostly the next row: only the rest is sketched beside them.
        rest = [i for i, n in enumerate(after) if n is not (texts[i + 1] if i + 1 < len(texts) else None) and n is not texts[i]]
        place = np.arange(len(texts)) + np.fromiter((n is not t for n, t in zip(after, texts, strict=True)), np.int64, len(texts))
        place[rest] = len(texts) + np.arange(len(rest))
        every = sketches(pa.array([*texts, *(after[i] for i in rest)], pa.large_string()), k, shingle)
        own, nxt, new = rows_of(every, np.arange(len(texts))), rows_of(every, place), sketches(pa.array(edited, pa.large_string()), k, shingle)
        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(_packed(own), pa.string()),
            "edited_fingerprint": pa.array(_packed(new), pa.string()),
            "near_edited": pa.array(alike(own, new, k), pa.float64()),
            "near_next": pa.array(alike(own, nxt, k), pa.float64()),
            "copies": pa.array(copies, pa.int64()),
        })

    def job(batches):
        held = None  # the row that still waits for its next one: (part, tail, id, n, text)
        for batch in batches:
            rows, size = [], 0
            columns = (batch.column(c).to_pylist() for c in ("part", "tail", "id", "n"))
            for row, (part, tail, i, n) in enumerate(zip(*columns, strict=True)):
                t = batch.column("text")[row].as_py() or ""
                if held is not None and held[0] == part and held[1] == 0:
                    rows.append((held[2], 1, held[4], t))
                    if held[3] > 1:
                        rows.append((held[2], held[3] - 1, held[4], held[4]))
                    size += len(held[4])
                held = (part, tail, i, n, t)
                if size > 4 << 20:
                    yield work(*zip(*rows, strict=True))
                    rows, size = [], 0
            if rows:
                yield work(*zip(*rows, strict=True))

    return job


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the next document's beginning."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("key"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("mark"), F.xxhash64(F.lit(1), text).alias("other"), text.alias("text"),
    )
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    rows, repeated = in_order(base)
    out = rows.select("part", "tail", "id", "n", "text").mapInArrow(_edits(k, shingle), schema)
    if repeated:  # many copies of a row are written out by several tasks
        out = out.withColumn("from", F.expr(f"explode(sequence(0, (copies - 1) div {COPIES}))")).repartition("id", "from", "near_next")
        out = out.withColumn("to", F.expr(f"explode(sequence(1, least({COPIES}, copies - from * {COPIES})))")).drop("from", "to")
    return out.drop("copies").withColumnRenamed("id", id_col)
