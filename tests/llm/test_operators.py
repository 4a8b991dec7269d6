"""Each operator against brute force, a round trip or held-out accuracy, and its edge rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clausewise.llm import fingerprints, jaccard_join, language_id, mips, mixing, queries, sentencepiece, toxicity, warc
from clausewise.llm import text as tx
from clausewise.llm import token_counts
from clausewise.llm.substring_dedup import substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (5, "a"), (None, "null id words here now five"), (6, "é😀 日本 ▁x  y\x0bz"), (7, "w " * 5000)]


def words(text):
    return WORDS.findall(text or "")


def corpus(seed=3, n=60):
    """Random documents with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, rows = say(30), []
    for i in range(n):
        w = say(r.choice([0, 3, 19, 20, 21, 60, 200]))
        kind = r.random()
        if kind < 0.3:
            at = r.randint(0, len(w))
            w = w[:at] + passage[r.randint(0, 4) : r.randint(24, 30)] + w[at:]
        elif kind < 0.6 and rows:
            w = words(r.choice(rows)[1])
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = "edit"
        elif kind < 0.7:
            w = ["same"] * r.randint(1, 70)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    return rows


def frame(spark, rows, extra=False):
    """Documents; ``extra`` adds columns whose names clash with the operators' own."""
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("key", "id", "mark", "h", "start", "n_words", "ids", "score", "part", "tail", "rank", "size", "bucket", "cell", "node", "_c0") if extra else ():
        out = out.withColumn(c, F.lit("x"))
    return out


# Words and hashes


@pytest.mark.parametrize("texts", [["a b", "", None, " x\ty ", "ab", "a", "b c"], [], [None], ["x" * 3_000_000 + " y", "y"]])
def test_words_and_hashes(texts):
    data, offsets = tx.column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = tx.find_words(data, offsets)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in itertools.pairwise(first)]
    assert got == [words(t) for t in texts]
    flat, hashes = [w for g in got for w in g], tx.hash_words(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(flat)) and len(dict(zip(flat, hashes.tolist()))) == len(set(flat))


def test_sliding_argmin_prefers_the_right():
    v = np.array([3, 1, 1, 2, 0, 5, 0, 7])
    for w in (1, 2, 3, 5, 8):
        assert tx.sliding_argmin(v, w).tolist() == [max(range(i, i + w), key=lambda j: (-v[j], j)) for i in range(len(v) - w + 1)]


# 5 Substring dedup


def dedup_brute(rows, window=20):
    """Ids differ here, so documents are ordered by id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            gone |= set(range(s, s + window)) if k in seen else set()
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 0)])
def test_substring_dedup_is_exact(spark, seed, bits):
    """With filters, and with the joins that take their place."""
    rows = corpus(seed)
    got = substring_dedup(frame(spark, rows, extra=True), most_bits=bits)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == dedup_brute(rows)
    assert "key" in got.columns and got.columns.count("n_words") == 1


def test_substring_dedup_edges(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [*EDGE, (8, long), (None, long), (9, long), (9, long)]
    got = substring_dedup(frame(spark, rows)).collect()
    removed = {(r.doc_id, r.n_words): r.n_removed for r in got}
    assert len(got) == len(rows) and removed[(8, 30)] == 0 and removed[(9, 30)] == 30 and removed[(None, 30)] == 30 and removed[(1, 0)] == 0
    assert removed[(7, 5000)] == 4999 and [r.spans for r in got if r.doc_id == 7][0] == [(1, 5000)]
    assert substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_oracles(spark, duck, name):
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    rows = lambda t: sorted(zip(*[[show(v) for v in t.column(c).to_pylist()] for c in sorted(t.column_names)], strict=True))
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toArrow()
    want = duck.sql(queries.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


# 7 Jaccard join


def sets(rows, k=5):
    out = {}
    for i, t in rows:
        w = words(t)
        if w:
            out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    return out


def join_brute(rows):
    s = sets(rows)
    links = {i: {j for j in s if j != i and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8} for i in s}
    label = {i: i for i, _ in rows}
    for _ in rows:
        label = {i: min([label[i], *(label[j] for j in links.get(i, ()))]) for i in label}
    return {i: (label[i], len(links.get(i, ()))) for i, _ in rows}


@pytest.mark.parametrize("small,block", [(4096, 1000), (8, 5)])
def test_jaccard_join_finds_all_links(spark, monkeypatch, small, block):
    """Also with limits so small that nodes are split, dealt in blocks, and components are dealt in pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{r.randrange(300)}" for _ in range(120)]
    rows = corpus(4)
    for i in range(30):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        rows.append((1000 + i, " ".join(w)))
    got = jaccard_join.ngram_jaccard_join(frame(spark, rows, extra=True), most_bits=None if small > 8 else 0).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == join_brute(rows)


def test_jaccard_join_edges(spark):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.ngram_jaccard_join(frame(spark, EDGE)).collect())
    assert got[(4, 4, 1)] == 1 and got[(5, 4, 1)] == 2 and got[(1, 1, 0)] == 1 and got[(2, 2, 0)] == 1 and got[(None, None, 0)] == 1 and sum(got.values()) == len(EDGE)
    assert jaccard_join.ngram_jaccard_join(frame(spark, [])).count() == 0


def test_chosen_path_recall_is_planned():
    assert 0.8 < jaccard_join.survival(0.8, 1) < 0.9 and jaccard_join.runs_for(0.999, 0.8, 3) >= 5


# 10 Fingerprints


def test_sketch_estimates_and_merges():
    r = random.Random(1)
    a = [f"x{r.randrange(10**6)}" for _ in range(4000)]
    b = a[:2000] + [f"y{r.randrange(10**6)}" for _ in range(2000)]
    sk = lambda w: fingerprints.sketches(pa.array([" ".join(w)]))[0]
    sa, sb = sk(a), sk(b)
    assert abs(fingerprints.resemblance(sa, sb) - 1 / 3) < 0.13 and abs(fingerprints.containment(sa, sb) - 0.5) < 0.17 and abs(fingerprints.distinct(sa) / 3996 - 1) < 0.3
    parts = fingerprints.merge(sk(a[:2004]), sk(a[2000:]))
    assert (parts == sa).all() and (fingerprints.unpack(fingerprints.pack(sa)) == sa).all()
    assert fingerprints.resemblance(sk(["q"] * 9), sk(["q"] * 5)) == 1.0 and fingerprints.distinct(sk(a[:50])) == 46


def test_fingerprint_query(spark, monkeypatch):
    monkeypatch.setattr(fingerprints.in_order, "__defaults__", (2000, 100_000))  # many ranges
    rows = corpus(7)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows, extra=True)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        s = [set(x) for x in (sets([(0, t)]).get(0, set()), sets([(0, edited)]).get(0, set()), sets([(0, n)]).get(0, set()))]
        near = [len(s[0] & x) / len(s[0] | x) if s[0] | x else 1.0 for x in s[1:]]
        assert abs(got[i].near_edited - near[0]) < 0.2 and abs(got[i].near_next - near[1]) < 0.2
        if len(s[0] | s[1]) < fingerprints.K:
            assert got[i].near_edited == pytest.approx(near[0])
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_edges(spark):
    got = fingerprints.fingerprint_edits(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and {r.doc_id: r.n_chars for r in got}[1] == 0 and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_edits(frame(spark, [(1, "a b c d")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert fingerprints.fingerprint(frame(spark, EDGE)).count() == len(EDGE)


# 2 Token counts


def test_token_counts(spark):
    rows = [*corpus(2), *EDGE]
    with open(token_counts.RANKS, "rb") as f:
        enc = token_counts.encoder(f.read(), token_counts.PATTERN)
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in rows]
    profile = token_counts.length_profile(token_counts.length_histogram(frame(spark, rows, extra=True))).cache()
    got = {r.n_tokens: r for r in profile.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert (r.docs_from, r.tokens_from, r.kept_tokens, r.all_tokens) == (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k), sum(min(x, k) for x in lengths), sum(lengths))
        assert r.share_up_to == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    for limit in (0, 7, 100, 10**6):
        assert token_counts.kept_at(profile, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(profile, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2 if len(lengths) % 2 else len(lengths) // 2 - 1]
    assert token_counts.length_profile(token_counts.length_histogram(frame(spark, []))).count() == 0


# 3 WARC


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (None, "n", big), (4, "s", "small"), (5, "s", "small"), (6, "", None), (7, "x", ""), (8, "c", "line\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("path", F.lit("y")).repartition(2)
    for sent in (250_000, 0):  # digests sent to all, and joined by shuffle
        monkeypatch.setattr(warc, "SENT", sent)
        folder = f"file://{tmp_path}/{sent}"
        index = warc.write_archives(pages, folder)
        got = warc.read_archives(index, folder).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter(
            [(1, "revisit", 3, 1200), (2, "revisit", 3, 1200), (3, "response", None, 1200), (3, "response", None, 1200), (None, "revisit", 3, 1200), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 16)]
        )
        for r in got:
            want = next(h for p, _, h in rows if p == r.page_id) or ""
            assert r.payload_digest == hashlib.sha1(want.encode()).hexdigest() and (r.payload is None) == (r.record_type == "revisit")
            assert r.payload is None or bytes(r.payload).decode() == want
        some = warc.read_archives(index.where("page_id in (4, 8)"), folder)
        assert sorted(r.page_id for r in some.collect()) == [4, 8]
    empty = pages.where("false")
    assert warc.read_archives(warc.write_archives(empty, f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


# 4 Inner-product search


def test_mips_recall_ties_and_edges(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 24)).astype(np.float32) * r.uniform(0.5, 2, size=(600, 1)).astype(np.float32)
    x[300:400] = x[300]  # a hundred equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [1.0]), (None, [1.0] * 24), (780, [None] + [1.0] * 23)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("qb", F.lit(1))
    got = mips.mips_search(table, every=20, k=20, candidates=150, queries=8).toPandas()
    d, hit = x.astype(np.float64), 0
    assert sorted(got.query_id.unique()) == list(range(0, 600, 20))
    for q, part in got.groupby("query_id"):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        part = part.sort_values("rank")
        hit += len(set(best) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21)) and part.score.tolist() == pytest.approx(s[part.vec_id].tolist())
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
    assert hit / (30 * 20) > 0.95
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in mips.mips_search(few).orderBy("rank").collect()] == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
    assert mips.mips_search(few.where("false")).count() == 0


def test_anisotropic_loss_falls():
    x = np.random.default_rng(1).normal(size=(800, 10))
    def loss(index):
        approx = np.stack([index.books[m, c] for m, c in enumerate(index.encode(x).T)], axis=1).reshape(len(x), -1)
        res, u = x - approx, x / np.linalg.norm(x, axis=1, keepdims=True)
        return ((res**2).sum(axis=1) + (index.eta - 1) * (res * u).sum(axis=1) ** 2).sum()
    assert loss(mips.fit(x, rounds=4)) < 0.8 * loss(mips.fit(x, rounds=0))


# 6 Language, 8 toxicity


def test_language_id_on_held_out_documents(spark):
    out = queries.op6_language_id(spark, f"{DATA}/sf0.01")
    lang = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    assert out.count() == lang.count()
    assert out.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_mixtures_and_edges(spark):
    r = random.Random(1)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcde", 30), "x") for i in range(40)] + [(100 + i, say("vwxyz", 30), "y") for i in range(40)] + [(900, "abc", None), (None, "vwx", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["x", "y"]
    asked = [(1, say("abcde", 30) + " " + say("vwxyz", 10)), (2, None), (3, ""), (4, "123 ... !"), (5, say("vwxyz", 1)), (5, say("vwxyz", 1)), (6, "😀"), (7, say("abcde", 20000))]
    got = {x.doc_id: x for x in language_id.predict(frame(spark, asked, extra=True), model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["x", "und", "und", "und", "y", "und", "x"]
    assert abs(got[1].proportions["y"] - 0.25) < 0.02 and got[2].score == 0 and got[7].proportions.keys() == {"x"}
    none = language_id.fit(docs.where("false"))
    assert {x.lang_pred for x in language_id.predict(frame(spark, asked), none).collect()} == {"und"}
    assert language_id.predict(frame(spark, []), model).count() == 0


def test_segments_are_the_maximal_ones():
    def brute(s):
        """Ruzzo and Tompa's recursive definition: take a best segment, then left and right of it."""
        def go(lo, hi):
            best = max(((round(sum(s[i:j]), 9), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            return [] if best is None or best[0] <= 0 else go(lo, best[3]) + [(best[3], best[4], best[0])] + go(best[4], hi)
        return go(0, len(s))
    r = random.Random(2)
    for _ in range(200):
        n, drift = r.randint(0, 12), 0.25
        at = sorted(r.sample(range(n), r.randint(0, n)))
        score = [r.choice([-2.03, 1.07, 2.11, 3.3]) + r.random() / 100 for _ in at]
        s = [-drift] * n
        for i, x in zip(at, score):
            s[i] = x
        got = [(a, b, round(v, 9)) for a, b, v in toxicity.segments(at, score, n, drift)]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(s)]


def test_toxicity_finds_planted_words(spark):
    r = random.Random(9)
    clean = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w, bad = clean(r.randint(20, 200)), i % 5 == 0
        for _ in range(4 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["Vile,", "NASTY!", "grim"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id % 2 = 0"))
    asked = [*rows, (1000, None), (1001, ""), (1002, "x " * 30000 + "vile nasty"), (1003, "vile"), (1003, "vile")]
    got = {x.doc_id: x for x in toxicity.score(frame(spark, asked, extra=True), model).collect()}
    assert sum(got[i].predicted != bad for i, bad in labels) <= 4 and got[1000].predicted == 0 and got[1001].score == got[1000].score
    assert [p.start for p in got[1002].passages][:1] == [30000] and toxicity.score(frame(spark, []), model).count() == 0
    for part, want in ((known.where("toxic = 0"), 0.0), (known.where("false"), 0.0), (known.where("toxic = 1"), 1.0)):
        assert {x.score for x in toxicity.score(docs.limit(3), toxicity.fit(docs, part)).collect()} == {want}


# 9 SentencePiece

PIECES = ["", " ", "   ", "\x00a", "a" * 300 + " b", "日本語テキスト " * 20, "▁x▁▁ y", "ünï\n\n\nx  ", "Abc,def... (foo)" * 5, "日本" * 100, " lead", "trail "]


def texts():
    r = random.Random(1)
    return PIECES + ["".join(r.choice("ab cé\n日xyz  ▁😀t") for _ in range(r.randint(0, 60))) for _ in range(300)] + [t for _, t in corpus(1)]


def model_file(unigram):
    with open(sentencepiece.MODEL, "rb") as f:
        data = f.read()
    if unigram:  # the same pieces, read as a unigram model
        i = data.rindex(b"\x12\x06tok_v0\x18\x02")
        data = data[: i + 9] + b"\x01" + data[i + 10 :]
    return data


@pytest.mark.parametrize("unigram", [False, True])
def test_encoding_is_the_librarys(unigram):
    import sentencepiece as library

    model, own = sentencepiece.Model(model_file(unigram)), library.SentencePieceProcessor(model_proto=model_file(unigram))
    ids, begin = sentencepiece.encode(model, texts())
    got = [ids[a:b].tolist() for a, b in itertools.pairwise(begin)]
    assert got == [own.encode(t) for t in texts()]
    assert [b.decode() for b in sentencepiece.decode(model, ids, begin)] == [sentencepiece.normalise(model, t) for t in texts()]


def test_viterbi_is_the_best_path():
    """Against all cuts of short units: the best sum of scores."""
    model = sentencepiece.Model(model_file(unigram=True))
    for unit in (" hello", " the", "abcab", " aüz"):
        ends, ids = (x[0] for x in sentencepiece.viterbi(model, sentencepiece._codes(unit)[None]))
        def cost(cuts):
            own = [model.by_text.get(unit[a:b]) for a, b in itertools.pairwise(cuts)]
            return sum(float(model.score[i]) if i is not None else (model.lowest if b == a + 1 else -np.inf) for i, (a, b) in zip(own, itertools.pairwise(cuts)))
        n = len(unit)
        best = max(cost([0, *c, n]) for k in range(n) for c in itertools.combinations(range(1, n), k))
        cuts = [0, *[e for e in ends if e]]
        assert cost(cuts) == best and [ids[a] for a in cuts[:-1]] == [model.by_text.get(unit[a:b], -1) for a, b in itertools.pairwise(cuts)]


def merged(model, unit):
    """Pieces of a unit by merging the best-scoring pair of neighbours, leftmost on ties."""
    parts = list(unit)
    while True:
        found = [(-float(model.score[model.by_text[a + b]]), i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in model.by_text]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_viterbi_over_merge_ranks_is_the_one_path_whose_neighbours_stay_apart():
    model = sentencepiece.Model(model_file(unigram=False))
    r, pieces = random.Random(6), list(model.by_text)
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(2000)]
    pairs += [(w[:k], w[k:]) for w in r.sample([p for p in pieces if len(p) > 3], 500) for k in range(1, len(w)) if w[:k] in model.by_text and w[k:] in model.by_text]
    got = model.apart(*(np.array([model.by_text[p[i]] for p in pairs]) for i in (0, 1)))
    assert got.tolist() == [merged(model, a + b) == [a, b] for a, b in pairs] and 100 < got.sum() < len(got) - 100
    for unit in ["".join(r.choice(pieces) for _ in range(r.randint(1, 3)))[:30] for _ in range(300)]:
        ends, ids = (x[0] for x in sentencepiece.viterbi(model, sentencepiece._codes(unit)[None]))
        cuts = [0, *[e for e in ends if e]]
        assert [unit[a:b] for a, b in itertools.pairwise(cuts)] == merged(model, unit)


def test_long_units_and_few_remembered_pairs(monkeypatch):
    model = sentencepiece.Model(model_file(unigram=False))
    want = sentencepiece.encode(model, texts())
    monkeypatch.setattr(sentencepiece, "LONG", 3)
    monkeypatch.setattr(sentencepiece, "PAIRS", 50)
    got = sentencepiece.encode(sentencepiece.Model(model_file(unigram=False)), texts())
    assert all((a == b).all() for a, b in zip(got, want))


def test_encode_documents(spark):
    rows = [*EDGE, *corpus(1, 20)]
    got = sentencepiece.encode_documents(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows) and all(r.round_trip in (True, None) for r in got)
    null = [r for r in got if r.text is None][0]
    assert null.ids is None and null.n_tokens is None and [r.ids for r in got if r.text == ""][0] == []
    assert sentencepiece.encode_documents(frame(spark, [])).count() == 0


# 1 Mixing


def slim(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("bucket", F.lit(1))
    return mixing.sizes(docs)


def test_mixing_meets_targets_and_edges(spark):
    r = random.Random(4)
    rows = [(i, r.choice("aaab") if i % 9 else None, " ".join(["x"] * r.randint(0, 40))) for i in range(300)] + [(500, "c", "x y z"), (500, "c", "x y z"), (None, "c", None), (501, "d", "")]
    s = slim(spark, rows)
    got = mixing.mix(s, mixing.by_rule(s)).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, _, t in rows)
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 3 * x["size"] and x.target <= 3 * x.source_size + 1e-9
    target = {x.source: x.target for x in got}
    assert sum(target.values()) == pytest.approx(total) and all(abs(taken[k] - v) < 1 for k, v in target.items()) and target["c"] == 18 and target["d"] == 0
    again = mixing.mix(s, mixing.by_rule(s)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    placed = [x.first_position for x in got if x.first_position is not None]
    assert all(0 <= p < 1 for p in placed)
    empty = slim(spark, [])
    assert mixing.mix(empty, mixing.by_rule(empty)).count() == 0


def test_curriculum_shifts_sources_over_time(spark):
    rows = [(i, "early" if i % 2 else "late", "x " * 10) for i in range(400)]
    s = slim(spark, rows)
    schedule = spark.createDataFrame([("early", 0.0, 3.0), ("early", 0.5, 1.0), ("early", 1.0, 0.0), ("late", 0.0, 0.0), ("late", 0.5, 1.0), ("late", 1.0, 3.0)], "source string, t double, weight double")
    order = mixing.training_order(s, schedule).join(s.select("id", "source").distinct(), "id")
    half = {(x.source, x.first): x.words for x in order.groupBy("source", (F.col("position") < 0.5).alias("first")).agg(F.sum("words").alias("words")).collect()}
    # First half: early integrates to 1, late to 0.25; the second half mirrors it.
    assert half[("early", True)] == pytest.approx(4000 * 0.5 * 0.8, abs=12) and half[("late", True)] == pytest.approx(4000 * 0.5 * 0.2, abs=12) and half[("late", False)] == pytest.approx(4000 * 0.5 * 0.8, abs=12)
