"""Alignment of two tokenizers: which of their tokens overlap, and which pairs of tokens go together in the corpus.

A text is cut into units before spaces that follow a character which is no white space. Tokenizer A (byte-level BPE) starts a token there by its pattern, tokenizer B (SentencePiece) because
no piece holds such a pair of characters (where one does, texts are not cut), so both encode each unit as they encode the whole text. A worker encodes and aligns each
unit once and remembers it (``KNOWN`` of them at most, told apart by 64-bit hashes of their bytes).

In every Arrow batch DuckDB holds the tokens of the new units as two interval tables over one line of bytes. A link is a pair of tokens whose bytes overlap: an ASOF join finds
the token of B in which each token of A starts, a range join the tokens of B that start inside a token of A. Places where both end cut the line into groups, numbered by window sums. The
units' sums and pairs are then added up for each document by how often it holds each unit.

Every batch also returns one row of partial counts: in how many of its documents each pair of ids is linked. Documents with their pairs and partial counts are written once;
Spark adds the counts up, finds each A id's best, and a second pass over the written pairs sums them for each document. Up to ``PAIRS`` counted pairs (17 bytes each) are sent to the
executors for that, after counting them; beyond, the pairs are joined: those held by more than one of ``HOT`` shares of all rows, at most so many, by broadcast, the others by a shuffle.

Defined results. A text has no tokens, and zeros in all columns, if it is null or empty or if the bytes of either tokenizer's tokens, joined, are not a space and the text (B turns U+2581 into a
space). Special tokens' strings are plain text. Very long texts are worked off in parts of ``PART`` bytes at places where units end, so memory grows only with a single unit (a stretch without cuts). Repeated rows, also of one id, are documents of their own;
ties in counts are all best. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sentencepiece import Slots
from .store import cut, small_batches

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PART = 1 << 20
#: Units that tokenizer A is given at once.
TOGETHER = 2048
#: Units that a worker remembers.
KNOWN = 3 << 18
U = tx.U
PAIRS = 4_000_000
HOT = 2_000
#: The id of a pair is A's id times this and B's id.
WIDTH = 1 << 32
#: After a token: another of its tokenizer, the other tokenizer's, the next group, nothing.
MARKS = (b",", b"|", b";", b"")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_alphabet():
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a worker."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        own, vocabulary = _byte_alphabet(), self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.tokens = [(np.frombuffer(b"".join(x), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in x])))) for x in (a_bytes, b_bytes)]
        # Every id as text with each of the marks that may stand after it.
        names = [b"%d%s" % (i, mark) for x in (a_bytes, b_bytes) for i in range(len(x)) for mark in MARKS]
        self.b_from, self.names, self.name_begin = len(a_bytes), np.frombuffer(b"".join(names), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in names])))

    def encode(self, units: list[str]):
        """Of A and of B: (ids, the first of each unit)."""
        some = [units[lo : lo + TOGETHER] for lo in range(0, len(units), TOGETHER)]  # A returns much more than ids
        for found in ([x.ids for part in some for x in self.a.encode_batch(part, add_special_tokens=False)], self.b.encode([u[1:] for u in units], num_threads=1)):
            first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
            yield np.fromiter(itertools.chain.from_iterable(found), np.int64, first[-1]), first

    def gives_back(self, which: int, ids, first, data, begin):
        """Which units' tokens, joined, are the units' bytes."""
        flat, at = self.tokens[which]
        size = np.diff(at)[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        ok = np.diff(ends[first]) == np.diff(begin)
        own = ok[np.repeat(np.arange(len(ok)), np.diff(first))]
        ids, size = ids[own], size[own]
        after = np.cumsum(size) - size
        joined = flat[np.repeat(at[ids] - after, size) + np.arange(size.sum())]
        unit = np.repeat(np.arange(len(ok)), np.diff(begin))
        differ = joined != data[ok[unit]]
        ok[unit[ok[unit]][differ]] = False
        return ok


def cut_units(data, offsets):
    """Where units start: at each text, and before spaces after a byte that ends no white-space character. ``data`` are texts with a space before each."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        before, second, third = data[:-1], np.append([0], data[:-2]), np.append([0, 0], data[:-3])[: len(data) - 1]
        # White space beyond ASCII: U+0085 and U+00A0 (C2), U+1680 and U+180E (E1 9A, E1 A0), U+2000 to U+205F (E2 80, E2 81), U+3000 (E3 80).
        blank = (second == 0xC2) | (third == 0xE1) & ((second == 0x9A) | (second == 0xA0)) | (third == 0xE2) & ((second == 0x80) | (second == 0x81)) | (third == 0xE3) & (second == 0x80)
        begin[1:-1] = (data[1:] == 0x20) & ((before > 0x20) & (before < 0x7F) | (before >= 0x80) & ~blank)
    begin[offsets[1:] - 1] = False  # a last space alone would be an empty text for B
    begin[offsets[:-1]] = True
    begin[offsets[-1]] = False
    return np.flatnonzero(begin)


LINKS = f"""
SELECT unit, pair, count(*) AS n FROM (
  SELECT a.unit, a.id * {WIDTH} + b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT a.unit, a.id * {WIDTH} + b.id AS pair FROM a JOIN b ON a.unit = b.unit AND b.s > a.s AND b.s < a.e
) GROUP BY ALL ORDER BY unit, pair
"""
GROUPS = """
SELECT unit, g, side, id FROM (
  SELECT a.unit, 0 AS side, a.id, a.s, CAST(sum(CASE WHEN b.s IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY a.s) AS BIGINT) AS g FROM a LEFT JOIN b ON a.s = b.s
  UNION ALL
  SELECT b.unit, 1 AS side, b.id, b.s, CAST(sum(CASE WHEN a.s IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY b.s) AS BIGINT) AS g FROM b LEFT JOIN a ON a.s = b.s
) ORDER BY g, side, s
"""


class Units:
    """What is known of units, by the 64-bit hash of their bytes: sums, groups as text and pairs. At most ``KNOWN`` are kept, then anew."""

    def __init__(self, own: Tokenizers):
        import duckdb

        self.own, self.db = own, duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.forget()

    def forget(self):
        self.slots, self.ok, self.sums, self.text = Slots(), Grown(bool), Grown(np.int64, len(COUNTS)), Grown(object)
        self.pair_slots, self.pair = Slots(), Grown(np.int64)
        self.held, self.links, self.pair_end = Grown(np.int32), Grown(np.int32), Grown(np.int64)

    def find(self, data, begin):
        """The numbers of units; new ones are aligned first."""
        hashes = tx.hash_words(data, begin[:-1], begin[1:])
        at = self.slots.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, pick = np.unique(hashes[new], return_index=True)
            if self.slots.n + len(pick) > KNOWN:
                self.forget()
                _, pick, new = *np.unique(hashes, return_index=True), np.arange(len(hashes))
            pick = new[pick]
            self.slots.add(hashes[pick])
            size = begin[pick + 1] - begin[pick]
            ends = np.cumsum(size)
            self.align(data[np.repeat(begin[pick] - ends + size, size) + np.arange(ends[-1])], np.concatenate(([0], ends)))
            at = self.slots.find(hashes)
        return at

    def align(self, data, begin):
        """Adds units: their tokens as interval tables, joined and grouped by DuckDB."""
        raw, n = data.tobytes(), len(begin) - 1
        coded = list(self.own.encode([raw[i:j].decode() for i, j in itertools.pairwise(begin.tolist())]))
        ok = np.ones(n, dtype=bool)
        for which, (ids, first) in enumerate(coded):
            ok &= self.own.gives_back(which, ids, first, data, begin)
        for which, name in enumerate("ab"):
            ids, first = coded[which]
            unit = np.repeat(np.arange(n), np.diff(first))
            ids, unit = ids[ok[unit]], unit[ok[unit]]
            size = np.diff(self.own.tokens[which][1])[ids]
            ends = np.cumsum(size)
            self.db.register(name, pa.table({"unit": unit, "id": ids, "s": ends - size, "e": ends}))
        unit, pair, links = (c.to_numpy() for c in self.db.sql(LINKS).to_arrow_table().columns)
        self.links.add(links)
        new = np.unique(pair)
        new = new[self.pair_slots.find(new.view(U)) < 0]
        self.pair_slots.add(new.view(U)), self.pair.add(new)
        self.held.add(self.pair_slots.find(pair.view(U)))
        self.pair_end.add(self.held.n - len(pair) + np.cumsum(np.bincount(unit, minlength=n)))
        of, group, side, ids = (c.to_numpy() for c in self.db.sql(GROUPS).to_arrow_table().columns)
        count = lambda x, w=None: np.bincount(x, w, n).astype(np.int64)
        opens = np.append(True, group[1:] != group[:-1])[: len(of)]
        self.sums.add(np.stack([count(of[side == 0]), count(of[side == 1]), count(of[opens]), count(unit, links)], axis=1))
        mark = np.append(np.where(of[1:] != of[:-1], 3, np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(np.int64))), 3)[: len(of)]
        name = (ids + side * self.own.b_from) * len(MARKS) + mark
        size = np.diff(self.own.name_begin)[name]
        ends = np.cumsum(size)
        text = self.own.names[np.repeat(self.own.name_begin[name] - ends + size, size) + np.arange(size.sum())].tobytes()
        cuts = np.concatenate(([0], np.cumsum(count(of, size)))).tolist()
        own = np.empty(n, dtype=object)
        own[:] = [text[i:j] for i, j in itertools.pairwise(cuts)]
        self.text.add(own)
        self.ok.add(ok)

    def pairs(self, at):
        """(index into ``at``, number of the pair, links) of units."""
        end = self.pair_end.all()
        start = np.where(at > 0, end[at - 1], 0)
        size = end[at] - start
        ends = np.cumsum(size)
        where = np.repeat(start - ends + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(at)), size), self.held.all()[where].astype(np.int64), self.links.all()[where]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind, columns: int = 0):
        self.n, self.data = 0, np.zeros((1024, columns) if columns else 1024, dtype=kind)

    def add(self, values):
        if self.n + len(values) > len(self.data):
            wider = np.zeros((max(2 * len(self.data), self.n + len(values)), *self.data.shape[1:]), dtype=self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self):
        return self.data[: self.n]


_own: dict = {}


def known_units(byte_bpe: bytes, pieces: bytes) -> Units:
    """The worker's own tokenizers and units, kept from task to task."""
    key = hashlib.sha256(byte_bpe).digest() + hashlib.sha256(pieces).digest()
    if key not in _own:
        _own.clear()
        _own[key] = Units(Tokenizers(byte_bpe, pieces))
    return _own[key]


def align_batch(units: Units, texts, part_bytes: int = PART):
    """For an Arrow column of texts: (sums, digests, (begin, pairs, links) of each text's pairs, (pairs, documents) of the batch)."""
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    n = len(texts)
    sums, digest = np.zeros((n, len(COUNTS)), dtype=np.int64), np.full(n, "", dtype=object)
    if not len(rows):
        return sums, digest, (np.zeros(n + 1, np.int64), *np.zeros((2, 0), np.int64)), np.zeros((2, 0), np.int64)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(rows)).cast(pa.large_string()), pa.scalar("", pa.large_string()))
    data, offsets = tx.column_bytes(spaced)
    begin = cut_units(data, offsets) if units.own.cuts else offsets[:-1]
    doc = rows[np.searchsorted(offsets, begin, side="right") - 1]
    begin = np.append(begin, len(data))
    bad, hashes, found = np.zeros(n, dtype=bool), {}, []
    for lo, hi in tx.pieces(begin, part_bytes):
        own = doc[lo:hi]
        at = units.find(data[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo])
        bad[own[~units.ok.all()[at]]] = True
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums[own[first]] += np.add.reduceat(units.sums.all()[at], first)
        text = units.text.all()[at].tolist()
        for r, i, j in zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            if r in hashes:
                hashes[r].update(b";")
            else:
                hashes[r] = hashlib.sha256()
            hashes[r].update(b";".join(text[i:j]))
        held, times = np.unique(own * units.slots.n + at, return_counts=True)
        which, pair, links = units.pairs(held % units.slots.n)
        d, pair, links = summed(held[which] // units.slots.n, pair, links * times[which], units.pair.n)
        found.append((d, units.pair.all()[pair], links))
    for r in rows[~bad[rows]]:
        digest[r] = hashes[r].hexdigest()
    sums[bad] = 0
    d, p, links = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = ~bad[d]
    known, of = np.unique(p[keep], return_inverse=True)
    d, p, links = summed(d[keep], of, links[keep], len(known)) if len(found) > 1 else (d[keep], of, links[keep])  # a text of several parts may hold a pair in each
    counted = np.bincount(p, minlength=len(known))
    return sums, digest, (np.searchsorted(d, np.arange(n + 1)), known[p], links), (known, counted)


def summed(doc, pair, links, pairs: int):
    """Links of each pair of each document, in order."""
    key = doc * max(1, pairs) + pair
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) > 0)[: len(key)])
    return doc[order[first]], pair[order[first]], np.add.reduceat(links[order], first) if len(links) else links


def _documents(byte_bpe, pieces, part_bytes):
    """A job: every document with its pairs, and the partial counts of the batch as a last row."""

    def job(batches):
        for batch in batches:
            sums, digest, (begin, pairs, links), (counted, held) = align_batch(known_units(byte_bpe.value, pieces.value), batch.column("text"), part_bytes)
            n = batch.num_rows
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(begin, len(pairs) + len(counted)), pa.int32()), pa.array(x, pa.int64()))  # noqa: B023, E731
            last = lambda column: pa.concat_arrays([column, pa.nulls(1, column.type)])
            yield pa.RecordBatch.from_pydict(
                {"row": last(batch.column("row")), "doc_id": last(batch.column("doc_id")), "partial": pa.array([False] * n + [True])}
                | {c: pa.array(np.append(sums[:, i], 0)) for i, c in enumerate(COUNTS)}
                | {"groups_sha256": pa.array([*digest, ""]), "pairs": lists(np.append(pairs, counted)), "links": lists(np.append(links, held))}
            )

    return job


def _sums(counts):
    """A job: n_best and count_sum of each document from the counted pairs (sorted pairs, counts, whether best)."""

    def job(batches):
        known, count, best = counts.value
        for batch in batches:
            column, links = batch.column("pairs"), batch.column("links").flatten().to_numpy()
            at = np.searchsorted(known, column.flatten().to_numpy())
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])  # noqa: B023, E731
            new = {"n_best": pa.array(total(links * best[at])), "count_sum": pa.array(total(links * count[at]))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", *COUNTS, "groups_sha256")} | new)

    return job


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, pair, documents, best: in how many documents each pair is linked, and whether that is its A id's highest."""
    counts = written.where("partial").select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("documents"))
    counts = cut(counts.select(F.expr(f"pair div {WIDTH}").alias("a"), F.expr(f"pair % {WIDTH}").alias("b"), "pair", "documents"), "pairs")
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, part_bytes: int = PART) -> DataFrame:
    """Written documents (row, doc_id, the sums, groups_sha256, pairs, links) and, where ``partial``, counts of pairs."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = []
    for path in (byte_bpe, pieces):
        with open(path, "rb") as f:
            sent.append(spark.sparkContext.broadcast(f.read()))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "row long, doc_id long, partial boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pairs array<long>, links array<long>"
    return cut(base.mapInArrow(_documents(*sent, part_bytes), schema), "aligned")


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, most_pairs: int = PAIRS, part_bytes: int = PART) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    written = align_documents(docs, id_col, text_col, byte_bpe, pieces, part_bytes)
    counts = pair_counts(written)
    own = written.where("not partial").drop("partial")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("documents"), F.lit(0))).first()
    if n <= most_pairs:
        known = counts.select("pair", "documents", "best").toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "documents", "best")))
        return own.mapInArrow(_sums(sent), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long")
    counts = cut(counts.select("pair", "documents", "best", (F.col("documents") * HOT > total).alias("hot")), "counts")
    held = own.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    hot = F.broadcast(counts.where("hot").drop("hot"))  # fewer than HOT, as their documents make up less than all
    found = held.join(hot, "pair").unionByName(held.join(F.broadcast(counts.where("hot").select("pair")), "pair", "left_anti").join(counts.where("not hot").drop("hot"), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum"))
    out = own.join(sums, "row", "left").select("doc_id", *COUNTS, "groups_sha256", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
    return out
