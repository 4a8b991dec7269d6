"""Approximate nearest neighbours by inner product: anisotropic product quantisation.

Fit. Vectors are cut into subspaces of ``SUB`` dimensions with 16 codewords each. The loss is score-aware:
the part of the residual that is parallel to the vector weighs ``eta`` times the rest, as it moves large inner
products. Assignments descend coordinate by coordinate; codewords solve the weighted least squares subspace by subspace,
in ``SWEEPS`` passes, so the driver's memory is in proportion to the fitted vectors whatever their length. The codebooks are fitted
on at most ``SAMPLE`` vectors and ``FITTED`` bytes of them (those with the least hash of their id).

Index. The direction of every distinct vector is encoded once, four bits a subspace, two to a byte; its length and the length of what the
code leaves out stand beside it. Equal vectors are one entry that stands for its ``k`` + 1 least ids, so a vector that very many rows share neither
crowds others out nor costs more.

Search. Queries and codes meet in cells of a query block and a code block. In a cell each query scans the packed codes
through its table (one lookup a byte); the ``rerank`` best by the codes are scored exactly and set a mark. By Cauchy-Schwarz a row's product is at most its
rough score and the query's length times what the code left out: rows whose bound reaches the mark are scored exactly too, so no row is missed, however alike or
unevenly long the vectors are. Over all cells the best ``KEPT`` times ``k`` + 1 are ranked by the exact inner products in double precision, and the ``k`` best rows stay.

Scale. A stated query set meets all rows in blocks: what travels to every block of queries are vectors with their codes, and what travels to every block of codes are queries.
Blocks grow with the data up to ``QUERIES`` and ``CANDIDATES`` and up to ``ASKED`` and ``CODED`` bytes, which bounds a cell. Where the codes say little (near copies in
large numbers, products that are all alike) a query scores most rows exactly, as a matrix product of some queries at once: time, not memory, then grows.

Defined results. Vectors that are null, zero, of another than the commonest length (the longer on ties; their product with the rest is
not defined) or that hold null or non-finite components take no part, nor do null ids; very long ones only cost more. A query's own id is no candidate.
Rows that repeat an id are each candidates and each queries, equal rows are one query. Ties go to the smaller id. With fewer candidates than ``k`` all are returned;
an empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, small_batches

SUB = 2
CODES = 16
SAMPLE = 10_000
FITTED = 32 << 20
THRESHOLD = 0.2
ROUNDS = 4
SWEEPS = 3
#: Vectors of a cell that set a query's mark; how many times the results asked for a cell returns (room for rounding).
RERANK, KEPT = 400, 2
#: Most codes and queries in a cell.
CANDIDATES = 1 << 20
QUERIES = 1 << 14
#: Most bytes of query vectors and of vectors with their codes in a cell.
ASKED, CODED = 16 << 20, 64 << 20
#: Code bytes that are scanned together, distances to codewords and rough scores that are held together.
SCAN = 1 << 20
HELD = 1 << 21
#: The share of a group's scores from which they are one matrix product.
DENSE = 0.05
#: Most bytes of query vectors that are sent to all executors for reranking; more are joined by shuffle.
SENT = 16 << 20


class Index:
    """Codebooks (subspaces, 16, SUB) and the weight of parallel error."""

    def __init__(self, books, eta, dim):
        self.books, self.eta, self.dim = books, eta, dim

    def parts(self, x):
        """Vectors padded with zeros and cut: (n, subspaces, SUB)."""
        m = self.books.shape[0]
        wide = np.zeros((len(x), m * SUB))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), m, SUB)

    def encode(self, x, rounds: int = 2):
        """Codes (n, subspaces) by coordinate descent on the anisotropic loss."""
        step = max(1, HELD // (self.books.shape[0] * CODES))
        found = [self._encode(x[lo : lo + step], rounds) for lo in range(0, len(x), step)]
        return np.concatenate(found) if found else np.zeros((0, self.books.shape[0]), dtype=np.int64)

    def _encode(self, x, rounds):
        x = self.parts(x)
        unit = x / np.sqrt((x * x).sum(axis=(1, 2), keepdims=True))
        far = ((x[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)  # (n, m, 16)
        along = np.einsum("nmd,mcd->nmc", unit, self.books)
        code = far.argmin(axis=2)
        own = (x * unit).sum(axis=(1, 2))
        at = np.arange(len(x))
        hit = np.take_along_axis(along, code[:, :, None], axis=2)[:, :, 0]
        rest = own - hit.sum(axis=1)  # residual along the vector
        for _ in range(rounds):
            for m in range(self.books.shape[0]):
                without = rest + hit[:, m]
                best = (far[:, m] + (self.eta - 1) * (without[:, None] - along[:, m]) ** 2).argmin(axis=1)
                code[:, m], hit[:, m] = best, along[at, m, best]
                rest = without - hit[:, m]
        return code

    def decode(self, code):
        """The vectors that codes stand for."""
        return self.books[np.arange(self.books.shape[0]), code].reshape(len(code), -1)[:, : self.dim]

    def pack(self, code):
        """Two codes to a byte: (n, ceil(subspaces / 2)) uint8."""
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return (code[:, ::2] | code[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q):
        """Per query one table of 256 sums a packed byte: (n, bytes, 256) float32."""
        t = np.einsum("nmd,mcd->nmc", self.parts(q), self.books).astype(np.float32)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(q), -1, 256)


def fit(x, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> Index:
    """Codebooks for the rows of ``x``; ``threshold`` is the share of a norm from which scores matter."""
    n, dim = x.shape
    m = math.ceil(dim / SUB)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.Generator(np.random.PCG64(5))
    index = Index(np.zeros((m, CODES, SUB)), eta, dim)
    parts = index.parts(x)
    index.books = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), i] for i in range(m)])
    unit = parts / np.sqrt((parts * parts).sum(axis=(1, 2), keepdims=True))
    own = (parts * unit).sum(axis=(1, 2))
    at = np.arange(m)
    for _ in range(rounds):
        code = index.encode(x, 1)
        hit = np.einsum("nmd,nmd->nm", unit, index.books[at, code])
        rest = own - hit.sum(axis=1)
        for i in np.tile(at, SWEEPS):
            # Normal equations of |r|^2 + (eta - 1) (u r)^2 in the codewords of one subspace, the others as they are.
            c, p, u = code[:, i], parts[:, i], unit[:, i]
            without = rest + hit[:, i]
            total = lambda w: np.bincount(c, w, CODES)  # noqa: B023, E731
            a = np.stack([[total((eta - 1) * u[:, j] * u[:, k]) for k in range(SUB)] for j in range(SUB)]).transpose(2, 0, 1)
            b = np.stack([total(p[:, j] + (eta - 1) * without * u[:, j]) for j in range(SUB)], axis=1) + 1e-3 * index.books[i]
            a = a + (np.bincount(c, minlength=CODES) + 1e-3)[:, None, None] * np.eye(SUB)
            index.books[i] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            hit[:, i] = (u * index.books[i][c]).sum(axis=1)
            rest = without - hit[:, i]
    return index


def _vectors(column, dim):
    """An Arrow list column of vectors of one length as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lengths(x):
    """Norms of the rows; squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1))


def _rough(table, packed):
    """Sums of the tables over the packed codes: (queries, rows)."""
    out, step = np.empty((len(table), len(packed)), np.float32), max(256, SCAN // packed.shape[1])
    for begin in range(0, len(packed), step):
        columns = np.ascontiguousarray(packed[begin : begin + step].T).astype(np.int64)
        for row in range(len(table)):
            rough = table[row, 0][columns[0]]
            for b in range(1, len(columns)):
                rough += table[row, b][columns[b]]
            out[row, begin : begin + step] = rough
    return out


def search(index, q, packed, length, left_out, x, ids, rerank, keep):
    """The ``keep`` best rows of ``x`` for each query by inner product, ties by id: (query, row, score).

    ``length`` and ``left_out`` are the rows' norms and those of what their codes leave out.
    """
    out, group = [], max(1, min(64, HELD // len(packed)))
    for lo in range(0, len(q), group):
        asked = q[lo : lo + group]
        size = _lengths(asked)
        rough = _rough(index.tables(asked / size[:, None]), packed)
        need = np.ones(rough.shape, dtype=bool)
        if len(packed) > rerank:
            for row, guess in enumerate(rough):
                guess = guess * length
                top = np.argpartition(-guess, rerank)[:rerank]
                mark = np.partition(x[top] @ asked[row], rerank - keep)[rerank - keep]
                need[row] = (guess + left_out) * size[row] >= mark
        some = np.flatnonzero(need.any(axis=0))
        dense = need.sum() > DENSE * len(some) * len(asked)
        if dense:
            scores = asked @ (x if len(some) == len(x) else x[some]).T
        for row in range(len(asked)):
            if dense:
                inside = np.flatnonzero(need[row, some])
                at, score = some[inside], scores[row, inside]
            else:
                at = np.flatnonzero(need[row])
                score = x[at] @ asked[row]
            if len(at) > keep:
                best = np.flatnonzero(score >= np.partition(score, len(at) - keep)[len(at) - keep])
                at, score = at[best], score[best]
            first = np.lexsort((ids[at], -score))[:keep]
            out.append((np.full(len(first), lo + row), at[first], score[first]))
    return [np.concatenate(part) for part in zip(*out, strict=True)]


def _encoder(index):
    def job(batches):
        model = index.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("v"), model.dim)
                length = _lengths(x)
                unit = x / length[:, None]
                code = model.encode(unit)
                seen = model.decode(code)
                # The sums of the tables are rounded to single precision, a term for each subspace.
                rounding = 2e-7 * (code.shape[1] + 4) * np.maximum(1.0, np.sqrt((seen * seen).sum(axis=1)))
                left_out = length * (np.sqrt(((unit - seen) ** 2).sum(axis=1)) + rounding)
                own = {c: batch.column(c) for c in ("id", "a", "b", "v")}
                yield pa.RecordBatch.from_pydict(own | {"length": length, "left_out": left_out, "code": pa.array([c.tobytes() for c in model.pack(code)], pa.binary())})

    return job


def _cell(index, rerank, keep):
    def job(queries: pa.Table, codes: pa.Table) -> pa.Table:
        model, columns, own = index.value, ("query_id", "qa", "qb"), ("a", "b", "id")
        if not queries.num_rows or not codes.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in (*columns, *own)} | {"near": pa.array([], pa.float64())})
        packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        q, x = (_vectors(side.column("v").combine_chunks(), model.dim) for side in (queries, codes))
        length, left_out, ids = (codes.column(c).to_numpy() for c in ("length", "left_out", "id"))
        row, at, near = search(model, q, packed, length, left_out, x, ids, rerank, keep)
        found = {c: queries.column(c).to_numpy()[row] for c in columns} | {c: codes.column(c).to_numpy()[at] for c in own}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()} | {"near": pa.array(near, pa.float64())})

    return job


def blocks(m: int, n: int, queries: int, candidates: int, cells: int):
    """Numbers of query and of code blocks: blocks as large as allowed, but so many cells if there are rows for them."""
    while math.ceil(m / queries) * math.ceil(n / candidates) < cells and (queries > 256 or candidates > 4096):
        if candidates > 4096 and (candidates >= 16 * queries or queries <= 256):
            candidates = max(4096, candidates // 2)
        else:
            queries = max(256, queries // 2)
    return math.ceil(m / queries), math.ceil(n / candidates)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    )
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def mips_search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark)
    plain = usable(vectors, id_col, vector_col).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # no negative zeros
    rows = cut(plain.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b")), "vectors")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "a", "b"]).select(F.col("id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"), "v")
    n, m = rows.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(rows.select("v").first()["v"])
    sample = max(CODES, min(sample, FITTED // (8 * dim)))
    queries, candidates = min(queries, max(64, ASKED // (8 * dim))), min(candidates, max(256, CODED // (60 + 9 * dim)))
    known = rows.orderBy(F.xxhash64("id"), "id", "a").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(known), -1)
    index = spark.sparkContext.broadcast(fit(x / _lengths(x)[:, None]))
    codes = rows.select("id", "a", "b", "v").mapInArrow(_encoder(index), "id long, a long, b long, v array<double>, length double, left_out double, code binary")
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    entries = cut(codes.withColumn("nth", nth).where(F.col("nth") <= k + 1), "codes")
    members = entries.select("a", "b", F.col("id").alias("vec_id"))
    q_blocks, c_blocks = blocks(m, n, queries, candidates, 2 * spark.sparkContext.defaultParallelism)
    block = lambda of, salt, *by: F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(of)).cast("int")
    every_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = asked.withColumn("x", block(q_blocks, 1, "query_id", "qa")).withColumn("y", every_of(c_blocks)).groupBy("x", "y")
    right = entries.where("nth = 1").withColumn("y", block(c_blocks, 2, "a")).withColumn("x", every_of(q_blocks)).groupBy("x", "y")
    keep = KEPT * (k + 1)
    found = left.cogroup(right).applyInArrow(_cell(index, max(rerank, keep), keep), "query_id long, qa long, qb long, a long, b long, id long, near double")
    query = ("query_id", "qa", "qb")
    place = lambda *order: F.row_number().over(Window.partitionBy(*query).orderBy(*order))
    short = found.withColumn("place", place(F.desc("near"), "id")).where(F.col("place") <= keep).select(*query, "a", "b")
    distinct = entries.where("nth = 1").select("a", "b", "v", F.col("id").alias("least"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    asking = asked.withColumnRenamed("v", "q")
    asking = F.broadcast(asking) if m * dim * 8 <= SENT else asking
    scored = short.join(distinct, ["a", "b"]).join(asking, [*query]).select(*query, "a", "b", "least", product.alias("score"))
    # Each better vector has a better row, one of which may be the query's own.
    near = scored.withColumn("place", place(F.desc("score"), "least")).where(F.col("place") <= k + 1)
    ranked = near.join(members, ["a", "b"]).where("vec_id <> query_id").withColumn("rank", place(F.desc("score"), "vec_id")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
