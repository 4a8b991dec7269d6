"""The planned recall of the Jaccard join includes what the sketch cutoff loses."""

import itertools
import random
import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from clausewise.llm import jaccard_join as jj


def test_pair_at_threshold_passes_the_cutoff():
    sig = np.zeros((2, jj.COORDS), dtype=np.uint8)
    sig[1, : jj.COORDS - 38] = 1
    passes = 1 - sum(comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(jj.cutoff(0.8)))
    runs = jj.runs_for(0.999, 0.8, jj.DEPTH)
    assert (1 - (1 - jj.survival(0.8, jj.DEPTH)) ** runs) * passes >= 0.999
    batch = pa.RecordBatch.from_pydict({"node": [1, 1], "rep": [10, 20], "sig": jj._binary(sig), "open": [True, True], "home": [True, True]})
    found = list(jj._candidates(jj.cutoff(0.8))([batch]))
    assert found and found[0].to_pydict() == {"a": [10], "b": [20]}


def near_copies(n, words=120, edits=2):
    """Texts of one template, each with some words of its own; and looser ones."""
    r = random.Random(n)
    template = [f"w{i}" for i in range(words)]
    for i in range(n):
        w = list(template)
        for _ in range(r.choice([0, 1, edits] if i % 10 else [2 * edits, 4 * edits])):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        yield i, " ".join(w)


def brute(rows, k=5):
    """Number of links and class of each document, from all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    names = {}
    x = np.zeros((len(rows), 200_000), dtype=np.float32)
    for i, s in enumerate(sets):
        for g in s:
            x[i, names.setdefault(g, len(names))] = 1
    x = x[:, : len(names)]
    both, size = x @ x.T, x.sum(axis=1)
    linked = both / (size[:, None] + size[None, :] - both) >= 0.8
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        low = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(rows))])
        if (low == label).all():
            return {rows[i][0]: (rows[label[i]][0], int(linked[i].sum())) for i in range(len(rows))}
        label = low


@pytest.mark.parametrize("small,block", [(4096, 100), (64, 50)])
def test_large_groups_are_counted_by_distances(spark, monkeypatch, small, block):
    """Sure links by the pivot, open ones exactly: the same counts as all pairs."""
    monkeypatch.setattr(jj, "SMALL", small)
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = list(near_copies(700, edits=3)) + [(5000 + i, t) for i, t in near_copies(300, words=40, edits=1)]
    got = jj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len({n for _, n in want.values()}) > 20
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want


def test_many_near_copies_travel_a_bounded_number_of_times(spark, monkeypatch):
    rows = [(i, " ".join([f"u{i}", *(f"w{j}" for j in range(80)), f"v{i}"])) for i in range(20_000)]
    sent = []
    cells = jj._cells
    monkeypatch.setattr(jj, "_cells", lambda rows, *a: (sent.append(a), cells(rows, *a))[1])
    got = jj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.groupBy("class_id", "n_links").count().collect() == [(0, 19_999, 20_000)]
    assert not [a for a in sent if a[0] == "label"]  # no text is dealt in pairs of blocks


def test_one_id_with_two_texts_links_by_text(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " x"), (3, say("b") + " y"), (4, say("c"))]
    got = {(r.doc_id, r.class_id, r.n_links) for r in jj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 0)}


def test_recall_on_a_given_table(spark):
    """Every linked pair of the smallest table of a hundred documents and more is found."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w:
            sets[i] = {hash(tuple(w[j : j + 5])) for j in range(max(1, len(w) - 4))}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    want = Counter()
    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            want[i] += 1
            want[j] += 1
    got = {r.doc_id: r.n_links for r in jj.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(got.values()) / sum(want.values())
    assert 0.99 <= found <= 1 and all(got[i] <= want[i] for i in got)


def test_long_near_copies_are_dealt_by_bytes(spark, monkeypatch):
    """A component of few but long sets is dealt in blocks of so many bytes; the counts stay those of all pairs."""
    monkeypatch.setattr(jj, "BYTES", 100_000)
    rows = list(near_copies(1200))
    held = []
    verify, distances = jj._verify, jj._pivot_distances
    for name, own in (("_verify", verify), ("_pivot_distances", distances)):
        monkeypatch.setattr(jj, name, lambda *a, own=own: held.append(own.__name__) or own(*a))
    out = jj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "_pivot_distances" in held and {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute(rows)
