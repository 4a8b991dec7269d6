"""Which of very many texts occur in which rows, without a product of rows and texts.

Letter case is folded character by character, as patterns that ignore case see it. The literals are counted first: up to ``MOST_BYTES`` of them go to all executors as one Aho–Corasick
automaton. More are joined: every place of a row's text gives its windows of the literals' lengths as hashes in constant time each, a bit array of the literals' hashes says which windows
may be literals, and those meet the literals by an equality join on the text itself. Rows and literals are read and dealt once each, so the work grows with rows plus literals (times the distinct lengths,
of which most are looked at only where a literal's beginning stands).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch

#: Most bytes of literals in one automaton, which is some forty times larger.
MOST_BYTES = 4 << 20
#: The bit array of the literals' hashes has 64 bits a literal, at most 2**28 (32 MB); with more literals more windows pass that are none.
MOST_BITS = 28
#: Characters hashed at once (a longer text stands alone), and literals of a task that hashes them.
AT_ONCE, LITERALS = 1 << 18, 50_000


class _Fold(dict):
    def __missing__(self, code):
        c = chr(code)
        low = up.lower() if len(up := c.upper()) == 1 else c.lower()
        self[code] = ord(low[0])
        return self[code]


_fold = _Fold()


def folded(text: str) -> str:
    """A text whose characters stand for all that are equal to them but for their case."""
    return text.translate(_fold)


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """``folded`` of a column."""
    return texts.map(lambda t: None if t is None else folded(t))


_automata: dict = {}


def automaton(pairs: Sequence[tuple[int, str]]):
    """The automaton of (id, folded literal); equal ones share a place."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, literal in pairs:
        if literal:
            made.add_word(literal, (*(made.get(literal, ())), i))
    made.make_automaton()
    return made


def _kept(pairs):
    """The worker's automaton, kept from task to task."""
    key = hashlib.sha256(repr(pairs).encode()).digest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(pairs)
    return _automata[key]


def found_in(made, text: str | None) -> list[int]:
    """Ids of the literals that occur in a text, in order."""
    if not text or not len(made):
        return []
    return sorted({i for _, ids in made.iter(folded(text)) for i in ids})


def _schema(rows: DataFrame, keys) -> T.StructType:
    return T.StructType([*(rows.schema[k] for k in keys), T.StructField("id", T.LongType())])


def _pairs(batch, keys, made) -> pa.RecordBatch:
    hits = [found_in(made, t) for t in batch.column("_text").to_pylist()]
    at = pa.array([r for r, ids in enumerate(hits) for _ in ids], pa.int64())
    own = {k: batch.column(k).take(at) for k in keys}
    return pa.RecordBatch.from_pydict(own | {"id": pa.array([i for ids in hits for i in ids], pa.int64())})


U = np.uint64
#: An odd factor of the running hashes, and what undoes it.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _mix(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int):
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of any windows of some texts, from running sums: equal windows have equal hashes. Whoever needs equality compares the texts."""

    def __init__(self, texts: Sequence[str]):
        self.joined = "".join(texts)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), "<u4").astype(U)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(_mix(codes + U(1)) * _powers(BASE, len(codes)), dtype=U)))
        self.back = _powers(BACK, len(codes) + 1)

    def hashes(self, at, size):
        """Of the windows of ``size`` characters from each place of ``at``."""
        return _mix((self.sums[at + size] - self.sums[at]) * self.back[at] + np.asarray(size).astype(U) * U(0xD6E8FEB86659FD93))

    def all(self, size: int):
        """``hashes`` of one size from every place."""
        n = max(0, len(self.joined) - size + 1)
        return _mix((self.sums[size : size + n] - self.sums[:n]) * self.back[:n] + np.asarray(size).astype(U) * U(0xD6E8FEB86659FD93))


def _head(size):
    """Characters of a literal that are looked for first: the largest power of two."""
    return 1 << size.bit_length() - 1


def _bits_of(h, bits: int):
    """The two places of a hash in the bit array."""
    return h & U((1 << bits) - 1), h >> U(64 - bits)


def _may_be(words, bits: int, h):
    low, high = ((words[(b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1) for b in _bits_of(h, bits))
    return (low & high) != 0


def _at_once(texts: Sequence[str]):
    """Ranges of texts of about ``AT_ONCE`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > AT_ONCE:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _hashed(batches):
    """Literals (id, literal) folded, with their length and the hashes of all of them and of their heads."""
    for batch in batches:
        texts = [folded(t) for t in batch.column("literal").to_pylist()]
        full, heads = [np.zeros(0, U)], [np.zeros(0, U)]
        for lo, hi in _at_once(texts):
            w, size = Windows(texts[lo:hi]), np.array([len(t) for t in texts[lo:hi]], np.int64)
            full.append(w.hashes(w.ends - size, size)), heads.append(w.hashes(w.ends - size, np.array([_head(len(t)) for t in texts[lo:hi]], np.int64)))
        numbers = [pa.array(np.concatenate(x).view(np.int64)) for x in (full, heads)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32()), *numbers], ["id", "literal", "size", "full", "head"])


def _bit_array(known: DataFrame, n: int):
    """(words, bits): the bits of the hashes of all literals and of their heads."""
    bits = max(16, min(MOST_BITS, math.ceil(math.log2(64 * max(1, n)))))
    places = F.array(*[e for h in ("full", "head") for e in (F.expr(f"{h} & {(1 << bits) - 1}L"), F.shiftrightunsigned(h, 64 - bits))])
    packed = known.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), U)
    words[packed.column("w").to_numpy()] = packed.column("v").to_numpy().view(U)
    return words, bits


def _likely(texts: Sequence[str], sizes: Sequence[int], words, bits: int) -> set[tuple[int, str]]:
    """(number of a text, window): the windows that may be literals, each once a text."""
    w, found = Windows(texts), set()
    by_head: dict[int, list[int]] = {}
    for size in sizes:
        by_head.setdefault(_head(size), []).append(size)
    for head, own in by_head.items():
        at = np.flatnonzero(_may_be(words, bits, w.all(head))) if len(own) > 1 else None
        for size in own:
            if at is None:
                inside = np.flatnonzero(_may_be(words, bits, w.all(size)))
            else:
                inside = at[at + size <= len(w.joined)]
                inside = inside[_may_be(words, bits, w.hashes(inside, size))]
            text = np.searchsorted(w.ends, inside, side="right")
            whole = inside + size <= w.ends[text] if len(inside) else np.zeros(0, bool)
            found.update((t, w.joined[i : i + size]) for t, i in zip(text[whole].tolist(), inside[whole].tolist(), strict=True))
    return found


def windows(rows: DataFrame, keys: Sequence[str], text: str, known: DataFrame) -> DataFrame:
    """(keys, literal): the windows of each row's text, folded, that may be among the ``hashed`` literals, each once a row."""
    keys = list(keys)
    shape = known.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(shape["sizes"])
    sent = rows.sparkSession.sparkContext.broadcast(_bit_array(known, shape["n"]))

    def scan(batches):
        words, bits = sent.value
        for batch in batches:
            texts = [folded(t or "") for t in batch.column("_text").to_pylist()]
            hits = sorted((lo + r, t) for lo, hi in _at_once(texts) for r, t in _likely(texts[lo:hi], sizes, words, bits))
            at = pa.array([r for r, _ in hits], pa.int64())
            yield pa.RecordBatch.from_pydict({k: batch.column(k).take(at) for k in keys} | {"literal": pa.array([t for _, t in hits], pa.string())})

    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(scan, T.StructType([*(rows.schema[k] for k in keys), T.StructField("literal", T.StringType())]))


def hashed(literals: DataFrame) -> DataFrame:
    """Literals (id bigint, literal) as ``windows`` wants them, written once; null and empty ones are left out."""
    given = literals.select(F.col("id").cast("long").alias("id"), "literal").where("literal is not null and literal <> ''").distinct()
    tasks = min(2000, math.ceil(given.count() / LITERALS) or 1)
    return scratch.written(given.repartition(tasks).mapInArrow(_hashed, "id long, literal string, size int, full long, head long"), "literals")


def occurring(rows: DataFrame, keys: Sequence[str], text: str, literals: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, id): the literals (id bigint, literal; an id names one) that occur in each row's text, letter case apart, each once a row. Null and empty literals occur nowhere."""
    keys = list(keys)
    given = literals.where("literal is not null and literal <> ''")
    size = given.agg(F.coalesce(F.sum(F.octet_length("literal") + 8), F.lit(0))).first()[0]
    if size <= most_bytes:
        known = given.select(F.col("id").cast("long").alias("id"), fold("literal").alias("literal")).distinct()
        sent = rows.sparkSession.sparkContext.broadcast(sorted((r["id"], r["literal"]) for r in known.collect()))

        def scan(batches):
            made = _kept(sent.value)
            for batch in batches:
                yield _pairs(batch, keys, made)

        return rows.select(*keys, F.col(text).alias("_text")).where("_text is not null").mapInArrow(scan, _schema(rows, keys))
    known = hashed(given)
    return windows(rows, keys, text, known).join(known.select("id", "literal"), "literal").select(*keys, "id")
