"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

Fit. Labelled documents are dealt in two halves by a hash of their id. Blocks of ``BLOCK`` bytes of one half train one dictionary for
each label, of equally many blocks: every document gives one block, chosen by hash, before any gives a second one. The other half, which no dictionary has seen, calibrates:
a text's blocks are compressed under both dictionaries, and a logistic curve with a ridge turns the normalised difference of the two sizes
(``(bad - good) / (bad + good)``) into a score, given how far the text compresses at all and its length, as short texts say little and texts that
repeat themselves are small under both. Copies are learned from as often as they occur, as they will also be scored: without them the curve takes the sizes of copies for signs of quality.

Scale. The fit reads at most ``SAMPLE`` labelled documents (those with the least hash of their id) and trains on at most ``BLOCKS`` blocks a label; the
ids of the sample go to the executors, so no text is shuffled but the sample's. Scoring is one narrow pass over whole texts, block by block, with two dictionaries of ``SIZE`` bytes at most.

Defined results. Null and empty texts are scored by their empty block, alike. Null ids and null labels are never learned from; an id counts once: of its labels those of the majority (good if
even), of its texts that with the least hash. Without labels of both kinds in both halves every score is the share of good labels (0 without any). Very long texts are compressed whole, in blocks, so memory does not
grow with them. Repeated rows and ties are scored alike; an empty table has no rows. Other columns are kept; those named score and predicted are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import cut, small_batches

SAMPLE = 20_000
BLOCK = 256
BLOCKS = 24_000
SIZE = 64 << 10
LEVEL = 3
RIDGE = 1e-2
#: Bytes that stand for the header of a compressed text, so that short texts do not look incompressible.
HEADER = 10


def dictionary(blocks: list[bytes], size: int = SIZE, level: int = LEVEL) -> bytes:
    """A dictionary of at most ``size`` bytes; the blocks themselves where they are too few to train one."""
    import zstandard as z

    size = max(256, min(size, sum(map(len, blocks)) // 4))
    try:
        return z.train_dictionary(size, blocks, level=level).as_bytes()
    except z.ZstdError:
        return b"".join(blocks)[-size:]


class Model:
    """Two dictionaries and the curve; the dictionaries are set up once in a worker."""

    def __init__(self, good: bytes, bad: bytes, rate: float = 0.0, level: int = LEVEL):
        self.dictionaries, self.rate, self.level, self.curve = (good, bad), rate, level, None

    def compressors(self):
        import zstandard as z

        key = hashlib.sha256(b"%d " % self.level + b"|".join(hashlib.sha256(d).digest() for d in self.dictionaries)).digest()
        if key not in _ready:
            _ready.clear()
            made = []
            for data in self.dictionaries:
                known = z.ZstdCompressionDict(data)
                known.precompute_compress(self.level)
                made.append(z.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
            _ready[key] = made
        return _ready[key]

    def sizes(self, data, lo: int, hi: int):
        """Compressed sizes of the bytes from lo to hi under the good and the bad dictionary."""
        good, bad = (c.compress for c in self.compressors())
        a = b = 0
        for at in range(lo, max(hi, lo + 1), BLOCK):
            block = data[at : min(at + BLOCK, hi)]
            a += len(good(block))
            b += len(bad(block))
        return a, b

    def probability(self, good, bad, n):
        """Scores from arrays of compressed sizes and lengths."""
        if self.curve is None:
            return np.full(len(n), self.rate)
        mean, scale, weights = self.curve
        x = (features(good, bad, n) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


_ready: dict = {}


def features(good, bad, n):
    """Normalised difference, log of the compressed share, log of the length, and their products."""
    difference = (bad - good) / (bad + good)
    share = np.log(np.minimum(good, bad) / (n + HEADER))
    length = np.log1p(n)
    return np.stack([difference, share, length, difference * length, difference * share, share * share], axis=1)


def logistic(x, y, ridge: float = RIDGE):
    """Intercept and weights by Newton's method on standardised columns."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    hold = np.eye(len(w)) * ridge
    hold[0, 0] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + hold, x.T @ (y - p) - hold @ w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return w


def _blocks(batches):
    """(good, nth, mark, block): every block of every text; ``nth`` is its place among its text's blocks by hash."""
    for batch in batches:
        data, offsets = tx.column_bytes(batch.column("text"))
        ids, good = batch.column("id").to_numpy(), batch.column("good").to_numpy()
        for lo, hi in tx.pieces(offsets):
            begin = np.concatenate([np.arange(offsets[r], offsets[r + 1], BLOCK) for r in range(lo, hi)])
            row = np.repeat(np.arange(lo, hi), (offsets[lo + 1 : hi + 1] - offsets[lo:hi] + BLOCK - 1) // BLOCK)
            mark = tx.mix(ids[row].astype(np.int64).view(tx.U) + tx.mix((begin - offsets[row]).astype(tx.U)))
            order = np.lexsort((mark, row))
            row, begin, mark = row[order], begin[order], mark[order]
            first = np.searchsorted(row, row)
            end = np.minimum(begin + BLOCK, offsets[row + 1])
            yield pa.RecordBatch.from_pydict({
                "good": pa.array(good[row]), "nth": pa.array((np.arange(len(row)) - first).astype(np.int64)), "mark": pa.array(mark.view(np.int64)),
                "block": pa.array([data[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
            })


def _sizes(model, keep):
    """A job that adds the compressed sizes and the length in bytes to the columns ``keep``."""

    def job(batches):
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            found = [model.value.sizes(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"a": pa.array(a), "b": pa.array(b), "n": pa.array(np.diff(offsets))})

    return job


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, blocks: int = BLOCKS) -> Model:
    """Learns from at most ``sample`` labelled ids and ``blocks`` blocks of text a label."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("good")).where("id is not null and good in (0, 1)")
    known = known.groupBy("id").agg((F.avg("good") >= 0.5).cast("int").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = base.join(F.broadcast(known), "id").groupBy("id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    learn = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    train = cut(found.select("id", "text", "good", learn.alias("learn")), "train")
    share = known.agg(F.avg("good").alias("share")).first()["share"] or 0.0
    parts = cut(train.where("learn").mapInArrow(_blocks, "good int, nth long, mark long, block binary"), "blocks")
    n = {r["good"]: r["count"] for r in parts.groupBy("good").count().collect()}
    rest = {r["good"] for r in train.where("not learn").select("good").distinct().collect()}
    model = Model(b"", b"", float(share))
    if len(n) < 2 or len(rest) < 2:
        return model
    most = min(*n.values(), blocks)
    chosen = {good: [bytes(r["block"]) for r in parts.where(F.col("good") == good).orderBy("nth", "mark", "block").limit(most).select("block").toLocalIterator()] for good in (1, 0)}
    model = Model(dictionary(chosen[1]), dictionary(chosen[0]), float(share))
    sent = spark.sparkContext.broadcast(model)
    seen = train.where("not learn").select("text", "good").mapInArrow(_sizes(sent, ["good"]), "good int, a long, b long, n long").toArrow().sort_by([(c, "ascending") for c in ("good", "a", "b", "n")])
    good, a, b, n = (seen.column(c).to_numpy().astype(float) for c in ("good", "a", "b", "n"))
    x = features(a, b, n)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.curve = mean, scale, logistic((x - mean) / scale, good)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (higher: better) and predicted (1 from ``threshold`` on); columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    added = ("score", "predicted")
    docs = docs.drop(*added)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    source = names[docs.columns.index(text_col)]
    base = docs.toDF(*names)
    out = T.StructType([*base.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    schema = to_arrow_schema(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches):
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(source))
            own = sent.value
            if own.curve is None:
                a, b = np.zeros((2, batch.num_rows))
            else:
                a, b = np.array([own.sizes(data, i, j) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=float).reshape(-1, 2).T
            p = own.probability(a, b, np.diff(offsets))
            new = {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return base.mapInArrow(job, out).toDF(*docs.columns, *added)
