"""N-gram Jaccard join by chosen paths.

Every document becomes the set of its five-word shingles. Documents with equal sets form one
class (one aggregate; copies are never compared with each other). Each class gets
``COORDS`` min-hashes, and the classes are split recursively on sampled coordinates: a node of
the tree picks one coordinate, or a second one so that 1 / threshold are picked in the mean, and each
class moves to the child named by its min-hash there. Nodes of at most ``SMALL`` classes are
compared by brute force on the min-hashes, larger ones are split again up to ``DEPTH`` times. What is then
still large holds near copies that no coordinate tells apart: its classes are compared with the least one
first, and only those unlike it are compared with the others, block by block. ``runs_for`` repeats the tree until
the stated recall, the loss by the sketch ``cutoff`` included.

Brute force on sketches only says which classes may be linked; it emits a spanning forest, not
pairs. Its components are disjoint, so each class's text travels once to its component, where the
exact Jaccard similarity of every pair decides. Components are sized in classes and in bytes of their sets (``BYTES`` make a full ``BLOCK``, so a cell holds two blocks of them at most, or a single longer set). In
components over ``BLOCK`` each class is first compared with the
least class of its component. Jaccard distances obey the triangle inequality, so two classes are linked for sure if their
distances to that pivot add up to no more than the allowed one, and unlinked if they differ by more: sure links are counted from a histogram
of distances, and only classes that leave some pair open are dealt in pairs of blocks. A template filled in a million ways
travels twice (once to its pivot's block), not once for each block of the others. Link counts are summed there; pairs are never written out. The class id is the
least id among all documents that exact links connect.

Defined results. Null ids and texts without words (null and empty included) have no links and are their own
class. Texts of one to four words have one shingle, all their words. Rows that share an id are one
document: its class is the least of its texts' classes, and it counts once for each different text. Sets are taken as equal if two 64-bit hashes over all their
shingles' hashes agree. A very long text is one row of one batch; an empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .store import Filter, cut, small_batches

COORDS = 64
SMALL = 4096
DEPTH = 3
BLOCK = 1000
#: Bytes of shingle hashes that stand for a full block: classes of long texts count as several.
BYTES = 16 << 20
#: Classes whose ids are sent to all executors rather than shuffling texts (16 bytes each).
SENT = 250_000
U = tx.U
_rng = np.random.Generator(np.random.PCG64(77))
MULT = _rng.integers(1, 2**63, COORDS, dtype=np.int64).astype(U) * U(2) + U(1)
PLUS = _rng.integers(0, 2**63, COORDS, dtype=np.int64).astype(U)


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a node after ``depth`` splits of one run."""
    second, alive = 1 / threshold - 1, 1.0
    for _ in range(depth):
        one = 1 - threshold * alive
        alive = 1 - (1 - second) * one - second * one * one
    return alive


def cutoff(threshold: float) -> int:
    """Coordinates in which a candidate pair must agree: five deviations below the mean of a pair at the threshold."""
    return max(1, math.floor(COORDS * threshold - 5 * math.sqrt(COORDS * threshold * (1 - threshold))))


def below_cutoff(threshold: float) -> float:
    """Chance that a pair at the threshold agrees in fewer coordinates. All runs share them, so no run repairs it."""
    return sum(math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k) for k in range(cutoff(threshold)))


def runs_for(recall: float, threshold: float, depth: int) -> int:
    wanted = recall / (1 - below_cutoff(threshold))
    if wanted >= 1:
        raise ValueError("recall is beyond what the sketches allow")
    return max(1, math.ceil(math.log(1 - wanted) / math.log(1 - survival(threshold, depth))))


def _signatures(k):
    def job(batches):
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for lo, hi in tx.pieces(offsets):
                values, begin = tx.row_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                values, begin = tx.sorted_sets(values, begin)
                some = np.flatnonzero(np.diff(begin))
                if not len(some):
                    continue
                at = begin[some]
                n = np.diff(begin)[some]
                sig = np.empty((len(some), COORDS), dtype=np.uint32)
                for c in range(COORDS):
                    sig[:, c] = np.minimum.reduceat(((values * MULT[c] + PLUS[c]) >> U(32)).astype(np.uint32), at)
                one = tx.mix(np.add.reduceat(tx.mix(values), at) + n.astype(U))
                two = tx.mix(np.bitwise_xor.reduceat(tx.mix(values ^ U(0x5851F42D4C957F2D)), at))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[lo:hi][some]), "mark": pa.array(marks[lo:hi][some]), "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64)), "sig": _binary(sig), "n": pa.array(n.astype(np.int64))})

    return job


def _binary(rows):
    """Rows of a C-contiguous 2-d array as an Arrow binary column."""
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column, kind, width):
    return tx.column_bytes(column)[0].view(kind).reshape(-1, width)


def _children(node, values, threshold):
    """The nodes that rows go to: ``node`` per row, ``values`` (rows, COORDS) min-hashes."""
    draw = tx.mix(node ^ U(0x2545F4914F6CDD1D))
    first = draw % U(COORDS)
    other = (first + U(1) + (draw >> U(8)) % U(COORDS - 1)) % U(COORDS)
    two = (draw >> U(40)).astype(np.float64) < (1 / threshold - 1) * 2.0**24
    rows = np.arange(len(node))
    for coord, go in ((first, np.ones(len(node), bool)), (other, two)):
        at = rows[go]
        c = coord[go]
        yield at, tx.mix(tx.mix(node[go] + (c + U(1)) * U(0x9E3779B97F4A7C15)) ^ values[at, c.astype(np.int64)].astype(U))


def _root(runs, threshold, known=None, whole=True):
    """(node, rep, sig) of each class in all runs, or the nodes alone; with a filter only of nodes that may have others."""

    def job(batches):
        for batch in batches:
            sig, rep = _matrix(batch.column("sig"), np.uint32, COORDS), batch.column("rep").to_numpy()
            low = (sig & np.uint32(255)).astype(np.uint8)
            for run in range(runs):
                root = np.full(len(rep), tx.mix(np.array([run + 1], dtype=U))[0])
                for at, node in _children(root, sig, threshold):
                    if known:
                        ok = known.passes(node)
                        at, node = at[ok], node[ok]
                    if len(at):
                        row = {"node": pa.array(node.view(np.int64))}
                        yield pa.RecordBatch.from_pydict(row | ({"rep": pa.array(rep[at]), "sig": _binary(low[at])} if whole else {}))

    return job


def _split(threshold):
    def job(batches):
        for batch in batches:
            sig, rep = _matrix(batch.column("sig"), np.uint8, COORDS), batch.column("rep").to_numpy()
            for at, node in _children(batch.column("node").to_numpy().view(U), sig, threshold):
                if len(at):
                    yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "rep": pa.array(rep[at]), "sig": _binary(sig[at])})

    return job


def runs_of(batches, key: str):
    """Whole groups of neighbouring rows with equal ``key``, across batches, as Arrow tables."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
                held = []
            else:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union of rows 0..n-1; the root of a tree is its least row."""

    def __init__(self, n):
        self.root = np.arange(n)

    def join(self, i, others):
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def links(self, ids):
        far = np.flatnonzero(self.root != np.arange(len(self.root)))
        return ids[self.root[far]], ids[far]


def _edge_batches(found, most: int = 2000):
    """(a, b) batches of an iterable of pairs of arrays."""
    out = []
    for a, b in found:
        if len(a):
            out.append((a, b))
        if len(out) >= most:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([a for a, _ in out])), "b": pa.array(np.concatenate([b for _, b in out]))})
            out = []
    if out:
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([a for a, _ in out])), "b": pa.array(np.concatenate([b for _, b in out]))})


def _candidates(least):
    """Spanning forests of the classes in one node whose sketches agree in ``least`` coordinates."""

    def forests(batches):
        for group in runs_of(batches, "node"):
            if group.num_rows < 2:
                continue
            rep = group.column("rep").to_numpy()
            sig = _matrix(group.column("sig"), np.uint8, COORDS)
            rep, at = np.unique(rep, return_index=True)
            # Only classes that are open (unlike their node's pivot, or of a node without one) start comparisons, with those at home in this block.
            sig, forest = sig[at], Forest(len(rep))
            isopen, home = (group.column(c).to_numpy(zero_copy_only=False)[at] for c in ("open", "home"))
            order = np.arange(len(rep))
            for i in np.flatnonzero(isopen):
                rest = np.flatnonzero(home & (forest.root != forest.root[i]) & (~isopen | (order > i)))
                if len(rest):
                    alike = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
                    if len(alike):
                        forest.join(i, alike)
            yield forest.links(rep)

    return lambda batches: _edge_batches(forests(batches))


def _near_pivot(least):
    """Whether each class of a large node agrees with the node's pivot."""

    def job(batches):
        for batch in batches:
            sig, pivot = (_matrix(batch.column(c), np.uint8, COORDS) for c in ("sig", "pivot_sig"))
            near = (sig == pivot).sum(axis=1) >= least
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("node", "rep", "sig", "count", "pivot")} | {"open": pa.array(~near)})

    return job


def _shared(values, begin):
    """Sizes of all pairwise intersections of sorted sets, as a dense (n, n) array."""
    n = len(begin) - 1
    both = np.zeros((n, n), dtype=np.float32)
    row = np.repeat(np.arange(n), np.diff(begin))
    _, col, count = np.unique(values, return_inverse=True, return_counts=True)
    more = count > 1
    name = np.cumsum(more) - 1
    use = more[col]
    row, col = row[use], name[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(more.sum()), 2048):
        i, j = np.searchsorted(col, (lo, lo + 2048))
        x = np.zeros((n, min(2048, int(more.sum()) - lo)), dtype=np.float32)
        x[row[i:j], col[i:j] - lo] = 1
        both += x @ x.T
    return both


#: Jaccard distances are counted in this many steps; rounding leaves a pair open, never sure.
STEPS = 1 << 18


def _allowed(threshold: float) -> int:
    """Steps that two linked classes may be apart for sure."""
    return math.floor((1 - threshold) * STEPS) - 2


def _steps(shared, size, other):
    """Jaccard distances, rounded up to steps."""
    union = size + other - shared
    return -((shared * STEPS) // np.maximum(union, 1)) + STEPS


def _pivot_distances(k):
    """Distance of each class of a block to the pivot of its component, whose row comes with every block."""

    def job(batches):
        for group in runs_of(batches, "cell"):
            rep, copies, pivot = (group.column(c).to_numpy() for c in ("rep", "copies", "label"))
            data, offsets = tx.column_bytes(group.column("text").cast(pa.large_string()))
            values, begin = tx.sorted_sets(*tx.row_shingles(data, offsets, k))
            first = int(np.flatnonzero(group.column("visit").to_numpy(zero_copy_only=False))[0])
            of_pivot = values[begin[first] : begin[first + 1]]
            inside = np.concatenate(([0], np.cumsum(np.isin(values, of_pivot))))
            steps = _steps((inside[begin[1:]] - inside[begin[:-1]]).astype(np.int64), np.diff(begin), len(of_pivot))
            own = np.flatnonzero(~group.column("visit").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"rep": pa.array(rep[own]), "label": pa.array(pivot[own]), "copies": pa.array(copies[own]), "steps": pa.array(steps[own])})

    return job


def _sure(allowed):
    """Per component: for each distance the number of documents that are linked for sure, and whether some pair is open."""

    def job(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("steps").to_numpy(), kind="stable")
        steps, documents, classes = (group.column(c).to_numpy()[order] for c in ("steps", "documents", "classes"))
        before = np.concatenate(([0], np.cumsum(documents)))
        sure = np.searchsorted(steps, allowed - steps, side="right")
        # Open: the sum is over the allowed distance, the difference is not known to be. A lone class is no pair with itself.
        low = np.maximum(sure, np.searchsorted(steps, steps - allowed - 4))
        high = np.searchsorted(steps, steps + allowed + 4, side="right")
        others = np.concatenate(([0], np.cumsum(classes)))
        me = (low <= np.arange(len(steps))) & (np.arange(len(steps)) < high)
        found = others[np.maximum(high, low)] - others[low] - me
        return pa.table({"label": group.column("label").take(pa.array(order)), "steps": pa.array(steps), "sure": pa.array(before[sure]), "open": pa.array(found > 0)})

    return job


def _verify(k, threshold):
    """Exact links inside one cell: (rep, links, peer), peers being a spanning forest."""
    allowed = _allowed(threshold)

    def job(batches):
        reps, links, peers = [], [], []

        def flush():
            out = pa.RecordBatch.from_pydict({"rep": pa.array(np.concatenate(reps)), "links": pa.array(np.concatenate(links)), "peer": pa.array(np.concatenate(peers))})
            reps.clear(), links.clear(), peers.clear()
            return out

        for group in runs_of(batches, "cell"):
            rep, copies, block, steps = (group.column(c).to_numpy() for c in ("rep", "copies", "block", "steps"))
            if len(rep) < 2:
                continue
            data, offsets = tx.column_bytes(group.column("text").cast(pa.large_string()))
            values, begin = tx.sorted_sets(*tx.row_shingles(data, offsets, k))
            size = np.diff(begin)
            both = _shared(values, begin)
            linked = both / np.maximum(size[:, None] + size[None, :] - both, 1).astype(np.float64) >= threshold
            np.fill_diagonal(linked, False)
            linked &= rep[:, None] != rep[None, :]
            if (block != block[0]).any():  # a pair of blocks: pairs inside one are another cell's
                linked &= block[:, None] != block[None, :]
            if steps[0] >= 0:  # sure links are counted already
                linked &= steps[:, None] + steps[None, :] > allowed
            count = linked @ copies
            forest = Forest(len(rep))
            for i in np.flatnonzero(count):
                forest.join(i, np.flatnonzero(linked[i]))
            a, b = forest.links(rep)
            reps += [rep[count > 0], b]
            links += [count[count > 0], np.zeros(len(b), dtype=np.int64)]
            peers += [rep[count > 0], a]
            if len(reps) >= 2000:
                yield flush()
        if reps:
            yield flush()

    return job


def _cells(rows: DataFrame, group: str, size: str, block: int, travels: str = "true") -> DataFrame:
    """Deal groups of over ``block`` rows in pairs of blocks: adds cell and block columns. Rows that do not travel go to the pair of their own block and to those of rows that do."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("block", F.when(n > 1, F.expr(f"cast(pmod(xxhash64(rep, 42), ceil({size} / {block})) as int)")).otherwise(0))
    if travels == "true":
        rows = rows.withColumn("other", F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))))
        return rows.withColumn("cell", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))
    # Cells are blocks: those rows that travel visit all of them.
    rows = rows.withColumn("other", F.explode(F.when(F.col(travels), F.sequence(F.lit(0), n - 1)).otherwise(F.array("block"))))
    return rows.withColumn("cell", F.xxhash64(group, "other"))


def _gather(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(F.col(key)).sortWithinPartitions(key)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.999, most_bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, class_id, n_copies (equal sets) and n_links (other documents at or over the threshold)."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keys = cut(base.where("id is not null and text is not null").mapInArrow(_signatures(k), "id long, mark long, one long, two long, sig binary, n long"), "keys")
    # A class is known by a hash of its set; the row of its least id gives its text.
    least = F.min(F.struct("id", "mark")).alias("f")
    classes = cut(keys.groupBy("one", "two").agg(least, F.countDistinct("id").alias("copies"), F.first("sig").alias("sig"), F.ceil(F.greatest(F.lit(1.0), F.max("n") * (8 * BLOCK / BYTES))).alias("load")).select("one", "two", "f.*", "copies", "sig", "load", F.col("one").alias("rep")), "classes")
    edges = _candidate_edges(classes.select("rep", "sig"), threshold, recall, most_bits)
    groups = components(edges)
    members = groups.withColumnRenamed("v", "rep").join(classes.select("rep", "copies", "id", "mark", "load"), "rep")
    members = members.join(members.groupBy("label").agg(F.sum("load").alias("size")), "label")
    members = cut(members.select("rep", "label", "size", "copies", "id", "mark", "load"), "members")
    repeated = not keys.groupBy("id", "mark").count().where("count > 1").isEmpty()

    def texts(some):
        """Rows of ``some`` with the text of their class, once each."""
        found = base.join(F.broadcast(some) if some.count() <= SENT else some, ["id", "mark"])
        return found.groupBy(*some.columns).agg(F.first("text").alias("text")) if repeated else found.select(*some.columns, "text")

    schema = "rep long, links long, peer long"
    small = texts(members.where(f"size <= {BLOCK}")).withColumns({"block": F.lit(0), "steps": F.lit(-1).cast("long"), "cell": F.xxhash64("label", F.lit(0), F.lit(0))})
    verified = lambda rows: _gather(rows, "cell").select("cell", "block", "rep", "copies", "steps", "text").mapInArrow(_verify(k, threshold), schema)
    found = verified(small)
    large = members.where(f"size > {BLOCK}")
    if not large.isEmpty():
        found = found.unionByName(_large(texts, large, verified, k, threshold))
    found = cut(found, "links")
    label = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")).where("a != b"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = classes.select("one", "two", "rep", "id", "copies").join(links, "rep", "left").join(label.withColumnRenamed("v", "rep"), "rep", "left")
    of_rep = cut(of_rep.select("one", "two", "id", "copies", "links", F.coalesce("label", "rep").alias("label")), "of_rep")
    named = of_rep.groupBy("label").agg(F.min("id").alias("class_id"))
    of_class = of_rep.drop("id").join(named, "label")
    of_doc = keys.select("id", "one", "two").distinct().join(of_class, ["one", "two"]).groupBy("id").agg(
        F.min("class_id").alias("class_id"), F.max("copies").alias("n_copies"), F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return (
        base.select("id").join(of_doc, "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )


def _large(texts, members: DataFrame, verified, k: int, threshold: float) -> DataFrame:
    """Links (rep, links, peer) in components over ``BLOCK``: sure ones from distances to the pivot (the least class, which names the component), open ones exactly."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = texts(members)
    # The pivot visits every block of its component.
    blocks = rows.withColumns({"block": F.expr(f"cast(pmod(xxhash64(rep, 42), ceil(size / {BLOCK})) as int)"), "visit": F.lit(False)})
    visits = rows.where("rep = label").withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("visit", F.lit(True))
    cells = blocks.unionByName(visits).withColumn("cell", F.xxhash64("label", "block"))
    far = cut(_gather(cells, "cell").select("cell", "rep", "label", "copies", "visit", "text").mapInArrow(_pivot_distances(k), "rep long, label long, copies long, steps long"), "distances")
    allowed = _allowed(threshold)
    count = far.groupBy("label", "steps").agg(F.sum("copies").alias("documents"), F.count("*").alias("classes"))
    sure = cut(count.groupBy("label").applyInArrow(_sure(allowed), "label long, steps long, sure long, open boolean"), "sure")
    known = cut(far.join(sure, ["label", "steps"]), "known")
    # A class counts itself among the sure ones where its own distance allows it. Two sure ones meet at the pivot.
    self = F.when(F.col("steps") * 2 <= allowed, F.col("copies")).otherwise(0)
    near = known.select("rep", (F.col("sure") - self).alias("links"), F.when(F.col("steps") <= allowed, F.col("label")).otherwise(F.col("rep")).alias("peer"))
    left = known.where("open")
    left = left.join(members.select("rep", "id", "mark", "load"), "rep")
    left = left.join(left.groupBy("label").agg(F.sum("load").alias("size")), "label")
    left = cut(left.select("rep", "label", "size", "copies", "steps", "id", "mark"), "open")
    if left.isEmpty():
        return near
    return near.unionByName(verified(_cells(texts(left), "label", "size", BLOCK)))


def _candidate_edges(classes: DataFrame, threshold: float, recall: float, most_bits: int | None = None) -> DataFrame:
    """Spanning edges among classes whose sketches agree; five deviations below the threshold count."""
    runs = runs_for(recall, threshold, DEPTH)
    least = cutoff(threshold)
    schema = "node long, rep long, sig binary"
    nodes = classes.mapInArrow(_root(runs, threshold, whole=False), "node long")
    counts = cut(nodes.groupBy("node").count().where("count > 1"), "nodes")
    known = Filter.make(counts, "node", most_bits)
    rows = classes.mapInArrow(_root(runs, threshold, known), schema)
    if not known:  # too many nodes for a filter
        rows = rows.join(counts.select("node"), "node", "left_semi")
    out, sure = [], []
    for depth in range(1, DEPTH + 1):
        big = counts.where(f"count > {SMALL}")
        if big.isEmpty():
            out.append(rows)
            break
        rows = cut(rows, "rows")
        out.append(rows.join(big, "node", "left_anti"))
        large = rows.join(big, "node")
        if depth == DEPTH:
            first = large.groupBy("node").agg(F.min_by(F.struct("rep", "sig"), "rep").alias("p")).select("node", F.col("p.rep").alias("pivot"), F.col("p.sig").alias("pivot_sig"))
            seen = large.select("node", "rep", "sig", "count").join(first, "node").mapInArrow(_near_pivot(least), "node long, rep long, sig binary, count long, pivot long, open boolean")
            seen = cut(seen, "near_pivot")
            sure.append(seen.where("not open and rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
            lone = seen.where("open").select("node").distinct()
            dealt = _cells(seen.join(lone, "node", "left_semi"), "node", "count", SMALL // 2, "open")
            out.append(dealt.select(F.col("cell").alias("node"), "rep", "sig", "open", (F.col("block") == F.col("other")).alias("home")))
        else:
            rows = cut(large.select("node", "rep", "sig").mapInArrow(_split(threshold), schema), "rows")
            counts = cut(rows.groupBy("node").count().where("count > 1"), "nodes")
    marked = [df if "open" in df.columns else df.select("node", "rep", "sig", F.lit(True).alias("open"), F.lit(True).alias("home")) for df in out]
    found = _gather(functools.reduce(DataFrame.unionByName, marked), "node").mapInArrow(_candidates(least), "a long, b long")
    return cut(functools.reduce(DataFrame.unionByName, sure, found).distinct(), "edges")
