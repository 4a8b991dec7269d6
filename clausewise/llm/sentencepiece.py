"""SentencePiece encoding and decoding in batches with numpy.

A text is cut into units between characters that no piece holds next to each other: no piece crosses such a
place, so each unit is encoded alone, and each distinct unit of a batch once. Units of equal length
advance together through one Viterbi pass: at each position the hashes of all substrings that end there, grown by
one character, probe the piece keys, and the vectorised maximum over all pieces that end there is
kept with a backpointer; the backpointers are followed from the end. A hash only proposes: units of equal hash, and the
pieces of each best path, are compared by their characters.

* Unigram models: a piece gains its score.
* BPE models: their scores are merge ranks, whose sum means nothing, so a piece gains 0 if merging leaves it
  and the piece before it apart, and is barred if not. A sequence of pieces is what merging
  gives exactly if that holds for all its neighbours (merges inside a span keep their order whatever lies
  around it), and every beginning of a unit has one such sequence, so the best path is the model's own
  encoding and one backpointer a position suffices. Which pairs stay apart is found by replaying the merges of the
  two pieces beside each other (``Merges``), once a pair, and remembered by the worker (``PAIRS`` of them at most, then anew).

Characters that no piece covers become byte pieces where the model has them, the unknown piece otherwise.
Decoding joins piece bytes by one gather and gives the normalised text back exactly.

Defined results. Null texts stay null (no ids); empty texts have no ids; an empty table has no rows. U+2581 is a space, as in the model's
own escape. Models whose normaliser changes characters, that hold user-defined pieces, or BPE models with a piece of which a
character is no piece raise ValueError. Units longer than ``LONG`` characters (very long texts without spaces, or of spaces) go through the
same Viterbi pass one by one, in linear time. Repeated rows are encoded alike; other columns are kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 40
#: Characters times units that advance together.
GROUP = 1 << 18
PAIRS = 500_000
KNOWN = (1 << 20) - 1
SPACE = "▁"
U = tx.U
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces of a model file, with their hashes sorted for probing."""

    def __init__(self, data: bytes):
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        pieces, scores, types = [], [], []
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b""))
                scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("the model's normaliser changes characters")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or USER in types:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        types = np.array(types)
        blank = SPACE.encode()
        self.unknown = int(np.flatnonzero(types == UNKNOWN)[0])
        self.bytes = [b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(blank, b" ") for p, t in zip(pieces, types, strict=True)]
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for i in np.flatnonzero(types == BYTE):
            self.byte_id[self.bytes[i][0]] = i
        whole = np.flatnonzero(types == NORMAL)
        self.score = np.array(scores, dtype=np.float32)
        self.lowest = float(self.score[whole].min()) - 10
        self.by_text = {self.bytes[i].decode("utf-8"): int(i) for i in whole}
        if self.kind == BPE and not all(c in self.by_text for piece in self.by_text for c in piece):
            raise ValueError("a piece holds a character that is no piece")
        self.longest = max(map(len, self.by_text))
        self.chars = np.zeros((len(pieces), self.longest), dtype=np.uint32)
        self.size = np.zeros(len(pieces), dtype=np.int64)
        for text, i in self.by_text.items():
            self.chars[i, : len(text)] = _codes(text)
            self.size[i] = len(text)
        keys = np.zeros(len(whole), dtype=U)
        for at in range(self.longest):
            more = self.size[whole] > at
            keys[more] = tx.join(keys[more], self.chars[whole[more], at].astype(U))
        order = np.argsort(keys)
        self.ids, self.slots = whole[order].astype(np.int32), Slots(keys[order])
        self.known = np.zeros(KNOWN + 1, dtype=bool)
        self.known[(keys & U(KNOWN)).astype(np.int64)] = True
        self.bigrams = np.zeros(KNOWN + 1, dtype=bool)
        for at in range(self.longest - 1):
            more = whole[self.size[whole] > at + 1]
            self.bigrams[_bigram(self.chars[more, at], self.chars[more, at + 1])] = True
        self.pairs, self.are_apart, self.apart_one = Slots(), np.zeros(0, dtype=bool), {}
        self.merges = Merges(self) if self.kind == BPE else None
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes])))

    def probe(self, hashes):
        """Pieces (start, unit, id) among the substrings of which ``hashes`` (starts, units) are given."""
        start, unit = np.nonzero(self.known[(hashes & U(KNOWN)).astype(np.int64)])
        at = self.slots.find(hashes[start, unit])
        hit = np.flatnonzero(at >= 0)
        return start[hit], unit[hit], self.ids[at[hit]]

    def apart(self, left, right):
        """Whether merging leaves each pair of pieces as it is."""
        pair = left.astype(np.int64) * len(self.size) + right
        at = self.pairs.find(pair.view(U))
        new = np.unique(pair[at < 0])
        if len(new):
            if self.pairs.n + len(new) > PAIRS:
                self.pairs, self.are_apart, new = Slots(), np.zeros(0, dtype=bool), np.unique(pair)
            self.pairs.add(new.view(U))
            self.are_apart = np.append(self.are_apart, self.merges.apart(new // len(self.size), new % len(self.size)))
            at = self.pairs.find(pair.view(U))
        return self.are_apart[at]

    def spells(self, ids, codes, starts, sizes):
        """Whether each piece (-1: any character) has the characters of its place."""
        ok = (ids < 0) | (self.size[ids] == sizes)
        for at in range(self.longest):
            more = np.flatnonzero(ok & (ids >= 0) & (sizes > at))
            if not len(more):
                break
            ok[more] = self.chars[ids[more], at] == codes[starts[more] + at]
        return ok

    def crossed(self, codes):
        """Whether some piece may hold each character and the next one; never False where one does."""
        return self.bigrams[_bigram(codes[:-1], codes[1:])]


class Slots:
    """Numbers of uint64 keys in order of arrival, looked up in a few tables of one slot a hash each."""

    def __init__(self, keys=(), bits: int = 16):
        self.n, self.bits, self.keys, self.tables = 0, bits, np.zeros(0, dtype=U), []
        self.add(np.asarray(keys, dtype=U))

    def _slot(self, keys, level):
        return (((keys + U(level)) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits + 3 * (level > 0))).astype(np.int64)

    def add(self, keys):
        """Adds distinct new keys."""
        self.keys = np.append(self.keys, keys)
        rest = np.arange(self.n, len(self.keys))
        self.n = len(self.keys)
        if self.n * 2 > 1 << self.bits:
            self.bits, self.tables, rest = max(self.bits, self.n.bit_length() + 2), [], np.arange(self.n)
        level = 0
        while len(rest):
            if level == len(self.tables):
                self.tables.append(np.full(1 << self.bits - 3 * (level > 0), -1, dtype=np.int32))
            table, slot = self.tables[level], self._slot(self.keys[rest], level)
            free = table[slot] < 0
            table[slot[free]] = rest[free]
            rest = rest[table[slot] != rest]
            level += 1

    def find(self, keys):
        """The number of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, table in enumerate(self.tables):
            at = table[self._slot(keys[rest], level)]
            some = at >= 0  # an empty slot ends the search
            hit = some & (self.keys[at] == keys[rest])
            out[rest[hit]] = at[hit]
            rest = rest[some & ~hit]
            if not len(rest):
                break
        return out


def _bigram(a, b):
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(12)


def _codes(text: str):
    """Code points of a string."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _grown(model, codes):
    """For each end, (end, hashes of the substrings of all units that end there, from the last starts on)."""
    n, length = codes.shape
    hashes = np.zeros((length, n), dtype=U)
    for j in range(1, length + 1):
        lo = max(0, j - model.longest)
        hashes[lo:j] = tx.join(hashes[lo:j], codes[:, j - 1].astype(U))
        yield j, hashes[lo:j]


def _tables(model, codes):
    """Piece ids (units, from, to) of all substrings; -1 where there is none."""
    n, length = codes.shape
    ids = np.full((n, length, length + 1), -1, dtype=np.int32)
    for j, hashes in _grown(model, codes):
        start, unit, own = model.probe(hashes)
        ids[unit, j - len(hashes) + start, j] = own
    return ids


def viterbi(model, codes):
    """Best paths of units of one length, (units, characters): the end of the piece that starts at each position (0: none) and its id (-1: a character without one)."""
    n, length = codes.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), dtype=np.int32)
    last = np.full((length + 1, n), -1, dtype=np.int32)
    for j, hashes in _grown(model, codes):
        lo = j - len(hashes)
        start, unit, own = model.probe(hashes)
        gain = np.full((j - lo, n), -np.inf)
        piece = np.full((j - lo, n), -1, dtype=np.int32)
        gain[-1] = 0.0 if model.kind == BPE else model.lowest
        piece[start, unit] = own
        if model.kind == BPE:
            before = last[lo + start, unit]
            free = before < 0  # nothing before it, or a character that no piece holds
            free[~free] = model.apart(before[~free], own[~free])
            gain[start, unit] = np.where(free, 0.0, -np.inf)
        else:
            gain[start, unit] = model.score[own]
        value = best[lo:j] + gain
        k = value.argmax(axis=0)
        at = np.arange(n)
        best[j], back[j], last[j] = value[k, at], lo + k, piece[k, at]
    ends, ids = np.zeros((n, length), dtype=np.int64), np.full((n, length), -1, dtype=np.int32)
    at, rows = np.full(n, length), np.arange(n)
    while len(rows):
        frm = back[at[rows], rows]
        ends[rows, frm], ids[rows, frm] = at[rows], last[at[rows], rows]
        at[rows] = frm
        rows = rows[frm > 0]
    return ends, ids


class Merges:
    """How each piece of a BPE model comes about by merging alone, and which piece two neighbours make.

    ``steps`` (pieces, longest): scores of the merges in their order, -inf after the last. ``left`` and ``right``: the first and the last
    part after so many merges. ``whole``: whether merging ends with the piece itself.
    """

    def __init__(self, model):
        count, longest = model.chars.shape
        self.steps = np.full((count, longest), -np.inf, dtype=np.float32)
        self.left, self.right = np.full((2, count, longest), -1, dtype=np.int32)
        self.whole = np.zeros(count, dtype=bool)
        keys, scores = [], []
        for size in np.unique(model.size[model.size > 0]):
            own = np.flatnonzero(model.size == size)
            ids = _tables(model, model.chars[own, :size])
            self._run(model, own, ids)
            for k in range(1, size):
                both = np.flatnonzero((ids[:, 0, k] >= 0) & (ids[:, k, size] >= 0))
                keys.append(ids[both, 0, k].astype(np.int64) * count + ids[both, k, size])
                scores.append(model.score[own[both]])
        keys, scores = np.concatenate(keys), np.concatenate(scores)
        self.made, self.count = Slots(keys.view(U)), count
        self.score = np.append(scores, np.float32(-np.inf))

    def _run(self, model, own, ids):
        """Merges the pieces ``own`` of one length: the best-scoring pair of neighbours first, the leftmost on ties."""
        n, length = ids.shape[:2]
        score = np.where(ids >= 0, model.score[ids], -np.inf).astype(np.float32)
        ends = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length - 1), (n, 1))
        pair = np.full((n, length), -np.inf, dtype=np.float32)
        for i in range(length - 1):
            pair[:, i] = score[:, i, i + 2]
        rows, tail = np.arange(n), np.full(n, length - 1)
        self.left[own, 0], self.right[own, 0] = ids[:, 0, 1], ids[:, length - 1, length]
        for step in range(length - 1):
            i = pair[rows].argmax(axis=1)
            go = pair[rows, i] > -np.inf
            rows, i = rows[go], i[go]
            if not len(rows):
                break
            self.steps[own[rows], step] = pair[rows, i]
            j = ends[rows, i]  # where the pair's second half starts
            end = ends[rows, j]
            ends[rows, i], ends[rows, j] = end, 0
            pair[rows, j] = -np.inf
            right = end < length
            pair[rows, i] = -np.inf
            r, a, e = rows[right], i[right], end[right]
            before[r, e] = a
            pair[r, a] = score[r, a, ends[r, e]]
            left = before[rows, i]
            some = left >= 0
            r, a = rows[some], left[some]
            pair[r, a] = score[r, a, end[some]]
            tail[rows[~right]] = i[~right]
            self.left[own[rows], step + 1] = ids[rows, 0, ends[rows, 0]]
            self.right[own[rows], step + 1] = ids[rows, tail[rows], length]
        self.whole[own] = ends[:, 0] == length

    def apart(self, a, b):
        """Whether merging leaves the pieces a and b next to each other as they are.

        Each piece's own merges keep their order; of both next ones and the merge across the border, the best goes first (the leftmost on ties).
        """
        out = self.whole[a] & self.whole[b]
        u, v = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(out)
        longest = self.steps.shape[1]
        while len(live):
            x, y, s, t = a[live], b[live], u[live], v[live]
            own, other = self.steps[x, np.minimum(s, longest - 1)], self.steps[y, np.minimum(t, longest - 1)]
            across = self.score[self.made.find((self.right[x, s].astype(np.int64) * self.count + self.left[y, t]).view(U))]
            joined = (across > own) & (across >= other)
            out[live[joined]] = False
            first = own >= other
            on = ~joined & (np.maximum(own, other) > -np.inf)
            u[live[on & first]] += 1
            v[live[on & ~first]] += 1
            live = live[on]
        return out


def _one(model, unit: str):
    """``viterbi`` of one long unit: (end, id) of the pieces in order."""
    n, bpe, known = len(unit), model.kind == BPE, model.apart_one
    best, back, last = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - model.longest), j):
            own = model.by_text.get(unit[i:j], -1)
            if own < 0 and i < j - 1 or best[i] == -np.inf:
                continue
            if not bpe:
                value = best[i] + (float(model.score[own]) if own >= 0 else model.lowest)
            elif own < 0 or last[i] < 0:
                value = 0.0
            else:
                pair = (last[i], own)
                if pair not in known:
                    if len(known) >= PAIRS:
                        known.clear()
                    known[pair] = bool(model.apart(np.array([last[i]]), np.array([own]))[0])
                value = 0.0 if known[pair] else -np.inf
            if value > best[j]:
                best[j], back[j], last[j] = value, i, own
    out, at = [], n
    while at:
        out.append((at, last[at]))
        at = back[at]
    return out[::-1]


def _utf8(codes, which):
    """The byte number ``which`` of each code point's UTF-8 form."""
    size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    own = codes >> (6 * (size - 1 - which)).astype(np.uint32)
    return np.where(which > 0, own & 0x3F | 0x80, own | np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[size]).astype(np.uint8)


def _units(model, codes, starts, ends):
    """Token ids of distinct units: (ids, begin of each unit)."""
    n, length = len(starts), ends - starts
    out_unit, out_from, out_piece, out_to = [], [], [], []
    doubtful = [np.flatnonzero(length > LONG)]
    for size in np.unique(length[length <= LONG]):
        mine = np.flatnonzero(length == size)
        step = max(1, GROUP // int(size))
        for lo in range(0, len(mine), step):
            part = mine[lo : lo + step]
            to, ids = viterbi(model, codes[starts[part][:, None] + np.arange(size)])
            unit, frm = np.nonzero(to)
            false = np.unique(unit[~model.spells(ids[unit, frm], codes, starts[part[unit]] + frm, to[unit, frm] - frm)])
            if len(false):  # a hash of a piece without its characters
                doubtful.append(part[false])
                keep = ~np.isin(unit, false)
                unit, frm = unit[keep], frm[keep]
            first = starts[part[unit]]
            out_unit.append(part[unit]), out_from.append(first + frm), out_piece.append(ids[unit, frm]), out_to.append(first + to[unit, frm])
    for u in np.concatenate(doubtful):
        found = np.array(_one(model, codes[starts[u] : ends[u]].tobytes().decode("utf-32-le")))
        to = starts[u] + found[:, 0]
        out_unit.append(np.full(len(found), u)), out_from.append(np.concatenate(([starts[u]], to[:-1]))), out_to.append(to), out_piece.append(found[:, 1].astype(np.int32))
    if not out_unit:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    unit, frm, piece, to = (np.concatenate(x) for x in (out_unit, out_from, out_piece, out_to))
    order = np.lexsort((frm, unit))
    unit, frm, piece, to = unit[order], frm[order], piece[order], to[order]
    # Characters without a piece: one id per byte, or the unknown piece.
    own = codes[frm]
    size = np.where((piece < 0) & (model.byte_id[0] >= 0), 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF), 1)
    begin = np.concatenate(([0], np.cumsum(size)))
    tokens = np.repeat(piece, size)
    lost = np.flatnonzero(tokens < 0)
    if len(lost) and model.byte_id[0] >= 0:
        which = (np.arange(begin[-1]) - np.repeat(begin[:-1], size))[lost]
        tokens[lost] = model.byte_id[_utf8(np.repeat(own, size)[lost], which)]
    tokens[tokens < 0] = model.unknown
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(np.repeat(unit, size), minlength=n))))


def normalise(model, text: str) -> str:
    """What the model reads, spaces unescaped; decoding gives this back."""
    text = text.replace(SPACE, " ")
    if model.squeeze:
        text = " ".join(x for x in text.split(" ") if x)
    return text


def encode(model, texts):
    """Token ids of a list of strings: (ids, begin of each text)."""
    raw = [(" " if model.prefix else "") + t if (t := normalise(model, x)) else "" for x in texts]
    codes = _codes("".join(raw))
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    begin = np.zeros(len(codes), dtype=bool)
    begin[1:] = ~model.crossed(codes)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(codes))
    data = codes.view(np.uint8)
    _, pick, inverse = np.unique(tx.hash_words(data, 4 * starts, 4 * ends), return_index=True, return_inverse=True)
    # Units of equal hash but other characters stand for themselves.
    alike = pick[inverse]
    other = np.flatnonzero((ends - starts != ends[alike] - starts[alike]) | ~tx.same_bytes(data, 4 * starts, 4 * starts[alike], 4 * np.minimum(ends - starts, ends[alike] - starts[alike])))
    inverse[other] = len(pick) + np.arange(len(other))
    pick = np.append(pick, other)
    tokens, of = _units(model, codes, starts[pick], ends[pick])
    size = np.diff(of)[inverse]
    after = np.concatenate(([0], np.cumsum(size)))
    ids = tokens[np.repeat(of[:-1][inverse] - after[:-1], size) + np.arange(after[-1])]
    return ids, after[np.searchsorted(starts, offsets)]


def decode(model, ids, begin, step: int = 1 << 18):
    """UTF-8 bytes of each text, by gathers over the pieces' bytes of about ``step`` tokens at a time."""
    out, drop, lo = [], 1 if model.prefix else 0, 0
    while lo < len(begin) - 1:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + step, side="right")) - 1)
        own = ids[begin[lo] : begin[hi]]
        size = np.diff(model.begin)[own]
        after = np.concatenate(([0], np.cumsum(size)))
        data = model.flat[np.repeat(model.begin[:-1][own] - after[:-1], size) + np.arange(after[-1])].tobytes()
        cut = after[begin[lo : hi + 1] - begin[lo]]
        out += [data[i + drop if data[i : i + drop] == b" " * drop else i : j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        lo = hi
    return out


_models = {}


def _model(data: bytes) -> Model:
    """The worker's own copy of a model, kept from task to task with the pairs it has met."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def encode_documents(docs: DataFrame, text_col: str = "text", model_file: str = MODEL, piece_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with ids (array<int>), n_tokens, decoded (string) and round_trip (decoded equals the normalised text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    with open(model_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ("ids", "n_tokens", "decoded", "round_trip")
    docs = docs.drop(*added)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    base = docs.toDF(*names)
    source = names[docs.columns.index(text_col)]
    out = T.StructType([*base.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType()), T.StructField("round_trip", T.BooleanType())])
    schema = to_arrow_schema(out)

    def job(batches):
        model = _model(sent.value)
        for batch in batches:
            column = batch.column(source)
            _, offsets = tx.column_bytes(column)
            for lo, hi in tx.pieces(offsets, piece_bytes):
                texts = column.slice(lo, hi - lo).to_pylist()
                ids, begin = encode(model, [t or "" for t in texts])
                back = [b.decode("utf-8", "replace") for b in decode(model, ids, begin)]
                null = [t is None for t in texts]
                n = np.diff(begin)
                # A null list takes no values: its text is empty.
                lists = pa.ListArray.from_arrays(pa.array([None if z else int(b) for z, b in zip(null, begin[:-1], strict=True)] + [int(begin[-1])], pa.int32()), pa.array(ids, pa.int32()))
                new = {
                    "ids": lists, "n_tokens": pa.array(n, pa.int64(), mask=np.array(null)), "decoded": pa.array([None if z else b for z, b in zip(null, back, strict=True)], pa.string()),
                    "round_trip": pa.array([None if t is None else b == normalise(model, t) for t, b in zip(texts, back, strict=True)], pa.bool_()),
                }
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else part.column(f.name) for f in schema], schema=schema)

    return base.mapInArrow(job, out).toDF(*docs.columns, *added)
