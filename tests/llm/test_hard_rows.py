"""Rows that are hard on an operator: blank, one-word and very long texts in any order, ids that repeat or are null, words of equal structure."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import dedup_brute, frame, join_brute, sets, words

from clausewise.llm import fingerprints, jaccard_join, language_id, mips, mixing, sentencepiece, token_counts, toxicity, warc
from clausewise.llm import text as tx
from clausewise.llm.substring_dedup import substring_dedup

BLANK = [None, "", " " * 50, "one", "\n " * 500_000, "five words are in here", "w" * 300_000, "two three " * 30_000]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


TWINS = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def orders():
    """Every hard text first, last and after every other one."""
    r, short = random.Random(4), [t and t[:2000] for t in BLANK]
    for k in range(len(BLANK)):
        rest = short[:k] + short[k + 1 :]
        r.shuffle(rest)
        yield [short[k], *rest]
        yield [*rest, short[k]]


@pytest.mark.parametrize("texts", [list(itertools.chain(*orders())), BLANK[::-1], [BLANK[2], BLANK[4]]], ids=["orders", "long", "blank"])
def test_every_operator_takes_hard_texts(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).coalesce(1)
    n = {i: len(words(t)) for i, t in rows}
    s = mixing.sizes(docs)
    assert {r.id: r["size"] for r in mixing.mix(s, mixing.by_rule(s)).collect()} == n
    with open(token_counts.RANKS, "rb") as f:
        enc = token_counts.encoder(f.read(), token_counts.PATTERN)
    lengths = Counter(token_counts.length(enc, t or "") for t in texts)
    assert {r.n_tokens: r.n_docs for r in token_counts.length_profile(token_counts.length_histogram(docs)).collect()} == lengths
    folder = warc.archive_folder(spark)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(warc.write_archives(pages, folder), folder).collect()} == {i: len(t or "") for i, t in rows}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()} == dedup_brute(rows)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {i: "x" if any(c.isalpha() for c in t or "") else "und" for i, t in rows}
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.ngram_jaccard_join(docs).collect()} == join_brute(rows)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == len(rows)
    assert all(r.round_trip is (None if r.text is None else True) for r in sentencepiece.encode_documents(docs).collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        shared = [sets([(0, x)]).get(0, set()) for x in (t, edited, after)]
        assert [got[i].near_edited, got[i].near_next] == pytest.approx([len(shared[0] & x) / len(shared[0] | x) if shared[0] | x else 1.0 for x in shared[1:]])


def test_vectors_repeat_and_share_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (2, None), (None, [9.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cb", F.lit(1)).withColumn("code", F.lit(1))
    got = Counter((r.query_id, r.vec_id, r.score) for r in mips.mips_search(table).collect())
    assert got.keys() == {(0, 1, 9.0)} and got[(0, 1, 9.0)] in (2, 4)


def test_long_vectors_are_found_in_bounded_cells(spark, monkeypatch):
    """Vectors of 1,536 components: fitted, dealt and scanned in the bytes that are allowed, found as short ones are."""
    monkeypatch.setattr(mips, "FITTED", 2 << 20)
    monkeypatch.setattr(mips, "SCAN", 1 << 17)
    r = np.random.default_rng(4)
    x = r.normal(size=(20, 1536))[r.integers(0, 20, 900)] + r.normal(size=(900, 1536))
    got = mips.mips_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=60, k=10).toPandas()
    d = x @ x[::60].T
    d[np.arange(0, 900, 60), np.arange(15)] = -np.inf
    best = np.argsort(-d, axis=0)[:10]
    assert len(got) == 150 and np.mean([len(set(best[:, q // 60]) & set(part.vec_id)) / 10 for q, part in got.groupby("query_id")]) > 0.95


@pytest.mark.parametrize("kind", ["lengths", "near copies", "one axis", "whole numbers"])
def test_vectors_of_any_shape_are_all_found(spark, kind):
    """Lengths of many orders, clusters of near copies, one large component, products that tie: none of the nearest is missed."""
    r = np.random.default_rng(9)
    x = r.normal(size=(4000, 32))
    if kind == "lengths":
        x *= np.exp(3 * r.normal(size=(4000, 1)))
    elif kind == "near copies":
        x = r.normal(size=(4, 32))[r.integers(0, 4, 4000)] + 1e-3 * x
    elif kind == "one axis":
        x[:, 0] = 100 + 0.01 * x[:, 0]
    else:
        x = r.integers(-1, 2, size=(4000, 32)).astype(float)
        x[:, 0] = 1
    got = mips.mips_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=200, k=20).toPandas()
    assert len(got) == 20 * 20
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        assert part.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(4000), -score))[:20].tolist()


def test_words_of_equal_structure_differ(spark):
    """Thue-Morse words: polynomials modulo a power of two cannot tell them apart."""
    data, offsets = tx.column_bytes(pa.array([" ".join(TWINS)]))
    starts, ends, _ = tx.find_words(data, offsets)
    assert len(set(tx.hash_words(data, starts, ends).tolist())) == 2
    runs = [tx.runs(tx.hash_words(*[tx.column_bytes(pa.array([" ".join(t)]))[0], *tx.find_words(*tx.column_bytes(pa.array([" ".join(t)])))[:2]]), 1024) for t in TWINS]
    assert runs[0][0] != runs[1][0]
    around = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*around[:20], t, *around[20:]])) for i, t in enumerate(TWINS)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == dedup_brute(rows) and got[1][1] == 40
    short = [(i, " ".join(["a", "b", t, "c", "d"])) for i, t in enumerate(TWINS)]
    assert {r.doc_id: r.n_links for r in jaccard_join.ngram_jaccard_join(frame(spark, short)).collect()} == {0: 0, 1: 0}
    assert all(r.round_trip for r in sentencepiece.encode_documents(frame(spark, [*short, (3, " ".join(TWINS))]).coalesce(1)).collect())
    print_of = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, short)).collect()}
    assert print_of[0].fingerprint != print_of[1].fingerprint and print_of[0].near_next == 0


def test_equal_hashes_do_not_make_equal_units(monkeypatch):
    """Encoding compares what it finds by hash: here all words and all runs get one of few hashes."""
    with open(sentencepiece.MODEL, "rb") as f:
        model = sentencepiece.Model(f.read())
    texts = ["some words and others", "other words, the same length", "abc abd abe", ""]
    want = sentencepiece.encode(model, texts)
    few = tx.hash_words
    monkeypatch.setattr(tx, "hash_words", lambda *a: few(*a) & tx.U(1))
    got = sentencepiece.encode(model, texts)
    assert all((a == b).all() for a, b in zip(got, want))
    # A key of a piece that is not in the text.
    model.spells = lambda ids, codes, starts, sizes: ids < 0
    got = sentencepiece.encode(model, texts)
    assert all((a == b).all() for a, b in zip(got, want))


@pytest.mark.parametrize("bits", [None, 0])
def test_rows_without_id_keep_apart(spark, bits):
    """Many rows of one id and without any, far more than would collide in a short mark."""
    r = random.Random(8)
    say = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    passage = say(50)
    rows = [(None, f"pre{i} {passage} null{i}") for i in range(5000)] + [(7, f"pro{i} {passage} seven{i}") for i in range(20)]
    got = substring_dedup(frame(spark, rows), most_bits=bits)
    assert sorted(x.n_removed for x in got.where("doc_id is null").collect()) == [50] * 5000
    assert sorted(x.n_removed for x in got.where("doc_id = 7").collect()) == [0] + [50] * 19


@pytest.mark.parametrize("bits", [8, 9, 10, 11])
def test_filters_may_give_way_half_way(spark, bits):
    """Few repeated anchors fit the filter, too many edges do not: the rest goes by joins over what was found."""
    from test_operators import corpus

    rows = corpus(bits)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, rows), most_bits=bits).collect()} == dedup_brute(rows)


def test_fingerprints_of_one_hot_id(spark, monkeypatch):
    """Ids that are all null, or one id with equal rows, are dealt over many ranges; each row is followed by the next."""
    monkeypatch.setattr(fingerprints.in_order, "__defaults__", (2000, 20_000))
    monkeypatch.setattr(fingerprints, "COPIES", 10)
    r = random.Random(3)
    rows = [(None, " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(0, 60)))) for _ in range(200)] + [(3, "x y z")] * 57 + [(None, None)] * 30 + [(i, "tail") for i in range(5)]
    docs = frame(spark, rows)
    out = fingerprints.fingerprint_edits(docs).collect()
    assert Counter((x.doc_id, x.n_chars) for x in out) == Counter((i, len(t or "")) for i, t in rows)
    marks = {x.text: (x.a, x.b) for x in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().selectExpr("text", "shiftrightunsigned(xxhash64(text), 1) a", "xxhash64(1, text) b").collect()}
    ordered = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is None, x[0] or 0, *marks[x[1]]))
    want = Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        want[(i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest())] += 1
    assert Counter((x.doc_id, x.edited_sha256) for x in out) == want
    base = docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(fingerprints.LAST)).alias("key"), F.expr("shiftrightunsigned(xxhash64(coalesce(text, '')), 1)").alias("mark"), F.expr("xxhash64(1, coalesce(text, ''))").alias("other"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, repeated = fingerprints.in_order(base)
    assert repeated and dealt.where("tail = 0 and id is null").select("part").distinct().count() > 5


def test_held_out_toxicity(spark):
    """Precision and recall on the held-out labels of a given table."""
    from clausewise.llm import queries

    out = queries.op8_toxicity(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").where("held_out")
    hit, said, toxic = out.agg(F.sum(F.expr("predicted * toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / said > 0.9 and hit / toxic > 0.85


def test_mixing_of_one_hot_id(spark, monkeypatch):
    """Rows of one id enter the sums by size; every word of a source is still placed once a pass."""
    r = random.Random(5)
    rows = [(None, "s", "x " * r.choice([0, 3, 3, 8])) for _ in range(300)] + [(7, r.choice("st"), "x " * r.randint(0, 9)) for _ in range(200)] + [(i, r.choice("st"), "x " * 5) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    s = mixing.sizes(docs, keep=True)
    plain = Counter((x.id, x.source, x["size"], tuple(x.copies)) for x in mixing.mix(mixing.sizes(docs), mixing.by_rule(s)).collect())
    monkeypatch.setattr(mixing, "MANY", 20)
    assert Counter((x.id, x.source, x["size"], tuple(x.copies)) for x in mixing.mix(mixing.sizes(docs), mixing.by_rule(s)).collect()) == plain
    monkeypatch.setattr(mixing, "PER_BUCKET", 1)
    out = mixing.training_order(s, mixing.by_rule(s)).collect()
    assert len(out) == sum(len(k[3]) * n for k, n in plain.items()) and all(x.doc.text.split() == ["x"] * len(x.doc.text.split()) and x.doc.doc_id == x.id for x in out)


def test_blank_runs_of_any_length_take_linear_time():
    """A megabyte of runs takes about as long whatever the runs' length, and runs are counted as the library counts them."""
    import time

    from clausewise.llm import token_counts as tc

    with open(tc.RANKS, "rb") as f:
        enc = tc.encoder(f.read(), tc.PATTERN)
    for n in (1, 62, 63, 64, 65, 66, 127, 500):
        for form in (" ", "\n", "\t \u00a0", "\u3000", "\r\n"):
            for text in (form * n, "a" + form * n, form * n + "b", f"a{form * n}b{form * n}1{form * n}!", f"x {form * n}\n'{form * n}"):
                assert tc.length(enc, text) == len(enc.encode_ordinary(text)), (n, form)
    for n in (64, 1000, 9_999, 100_000, 1_000_000):
        text = (" " * n + "word ") * (1_000_000 // n)
        began = time.perf_counter()
        tc.length(enc, text)
        assert time.perf_counter() - began < 3, n
