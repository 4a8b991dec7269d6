"""Operator 12 against whole texts encoded at once and token ranges compared one by one."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clausewise.llm import alignment as al
from clausewise.llm import queries

HARD = [
    None, "", " ", "  two  spaces ", "a\nb c d e", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b c", "日本語 テキスト　です", "don't we'll \t\t tab", "😀 emoji 👩‍💻 z", "x" * 5000 + " y",
    " " * 3000 + "z", "é é   line  sep \u0085 nel", "\x00 nul \x1f unit\x7f del", "same text here", "same text here", "ß᠎ w  thin ﻿bom", "1234567890 12 3.14 $$$ ###",
]


def brute(rows):
    """Rows of the contract by plain loops; texts go to the libraries whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.PIECES)
    alphabet = al._byte_alphabet()
    docs, held = [], Counter()
    for doc_id, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if not b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
                x, y = [], []
            i = j = p = q = 0
            while i < len(x):
                left, right, start = [], [], (p, q)
                while not left or p != q:
                    if p <= q:
                        left.append((x[i][0], p, p := p + len(x[i][1])))
                        i += 1
                    else:
                        right.append((y[j][0], q, q := q + len(y[j][1])))
                        j += 1
                assert start[0] == start[1]
                links += [(u, v) for u, s, e in left for v, s2, e2 in right if s < e2 and s2 < e]
                groups.append(",".join(str(u) for u, *_ in left) + "|" + ",".join(str(v) for v, *_ in right))
        held.update(set(links))
        docs.append((doc_id, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    return sorted(((d, na, nb, ng, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), h) for d, na, nb, ng, ls, h in docs), key=str)


def got(out):
    names = ("doc_id", *al.COUNTS, "n_best", "count_sum", "groups_sha256")
    return sorted(((*r,) for r in out.select(*names).collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").collect()]
    return rows + [(1000 + i, t) for i, t in enumerate(HARD)] + [(5, "an id twice"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("most_pairs,part_bytes", [(al.PAIRS, al.PART), (0, 700)])
def test_alignment_is_brute_force(spark, documents, most_pairs, part_bytes):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    for c in ("pair", "row", "links", "n_a", "partial"):
        docs = docs.withColumn(c, F.lit("x"))
    assert got(al.align_tokenizers(docs, most_pairs=most_pairs, part_bytes=part_bytes)) == brute(documents)


def test_units_are_forgotten_and_learned_anew(documents, monkeypatch):
    monkeypatch.setattr(al, "KNOWN", 300)
    read = [open(p, "rb").read() for p in (al.BYTE_BPE, al.PIECES)]
    texts = pa.array([t for _, t in documents], pa.string())
    small, large = (al.align_batch(al.Units(al.Tokenizers(*read)), texts, part) for part in (900, al.PART))
    assert (small[0] == large[0]).all() and (small[1] == large[1]).all()
    assert [x.tolist() for x in (*small[2], *small[3])] == [x.tolist() for x in (*large[2], *large[3])]


def test_empty_and_tokenless_tables(spark):
    assert al.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = got(al.align_tokenizers(spark.createDataFrame([(1, None), (2, ""), (2, "▁")], "doc_id long, text string")))
    assert out == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pair_counts_are_by_document(spark):
    counts = al.pair_counts(al.align_documents(spark.createDataFrame([(1, "tea tea tea"), (2, "tea"), (3, "teapot")], "doc_id long, text string")))
    assert counts.agg(F.max("documents")).first()[0] == 2 and counts.where("best").select("a").distinct().count() == counts.select("a").distinct().count()
