"""Operator 13 against brute force and DuckDB; what the norm bounds pass over."""

import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from clausewise.llm import negatives, queries

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every, positives=5, k=5):
    """Rows (id, label, vector) by plain loops."""
    rows = [(i, c, [math.floor(256 * float(x)) for x in v]) for i, c, v in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, own, v in rows:
        if a % every:
            continue
        scored = [(-dot(v, w), i, c) for i, c, w in rows]
        for p, pid, _ in sorted(x for x in scored if x[2] == own and x[1] != a)[:positives]:
            found = sorted(x for x in scored if x[2] != own and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(found)]
    return sorted(out)


def got(out):
    return sorted((*r,) for r in out.select(*COLUMNS).collect())


def table(seed, n=400, dim=7, spread=3.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = math.exp(r.uniform(-spread, spread))
        rows.append((i, r.choice([0, 0, 0, 1, 2, 3]), [r.gauss(0.6, 1) * size for _ in range(dim)]))
    same = [0.5] * dim
    return rows + [(n + i, i % 2, same) for i in range(n // 3)] + [(9000, 1, [0.0] * dim), (9100, 1, [-1.0] * dim), (9200, 77, same)]


HARD = [(None, 1, [1.0] * 7), (9300, None, [1.0] * 7), (9400, 1, None), (9500, 1, []), (9600, 1, [1.0] * 6 + [None]), (9700, 1, [1.0] * 6 + [float("nan")]), (9800, 1, [1.0] * 6 + [float("inf")]), (9900, 1, [1.0] * 5)]


@pytest.mark.parametrize("seed,candidates,anchors", [(1, negatives.CANDIDATES, negatives.ANCHORS), (2, 40, 3), (3, 100, 2)])
def test_hard_negatives_are_brute_force(spark, monkeypatch, seed, candidates, anchors):
    monkeypatch.setattr(negatives, "BUCKET", 16 if seed > 1 else 1024)
    monkeypatch.setattr(negatives, "ASKED", 1)
    rows = table(seed)
    df = spark.createDataFrame(rows + HARD, "vec_id long, label int, embedding array<double>").repartition(3).withColumn("row", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("window", F.lit(2))
    assert got(negatives.hard_negatives(df, every=20, candidates=candidates, anchors=anchors)) == brute([r for r in rows + HARD if not r[2] or len(r[2]) == 7], 20)


def test_query_matches_oracle(spark, duck):
    want = sorted(duck.sql("SELECT " + ", ".join(COLUMNS) + f" FROM ({queries.OP13_SQL.strip()})").fetchall())
    assert got(queries.QUERIES["op13_hard_negatives"](spark, f"{DATA}/sf0.001")) == want and want


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [2.0, 2.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (3, 2, [0.9, 1.0])]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))) == brute(rows, 100)


@pytest.mark.parametrize("rows", [[], [(0, None, [1.0])], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])], [(1, 1, [1.0]), (2, 2, [1.0])]])
def test_without_anchors_positives_or_windows(spark, rows):
    out = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    assert got(out) == [] and out.columns == list(COLUMNS)


def test_large_products_stay_exact(spark):
    r = random.Random(7)
    rows = [(i, i % 2, [r.uniform(-1e5, 2.4e5) for _ in range(4)]) for i in range(60)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=10)) == brute(rows, 10)


def test_buckets_beyond_the_bounds_are_not_scored():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (4000, 8)) * np.repeat([[20], [1]], [200, 3800], axis=0)
    norm = np.sqrt((v * v).sum(axis=1).astype(float))
    order = np.argsort(-norm)
    v, norm = v[order], norm[order]
    q = v[:3].astype(np.int64)
    every = lambda rows, at: np.ones((len(rows), at.stop - at.start), dtype=bool)
    full = (np.arange(3), np.full(3, negatives.NONE), np.full(3, negatives.ALL))
    w, c, s, scored = negatives.search(q, norm[:3], full, v, norm, np.arange(4000), every, 5, 100)
    assert scored <= 3 * 300  # the running fifth score ends the search among the long vectors
    score = q @ v.T
    assert [sorted(s[w == i], reverse=True) for i in range(3)] == [sorted(score[i], reverse=True)[:5] for i in range(3)]
    low = (np.arange(3), (norm[:3] * norm[50]).astype(np.int64), np.full(3, negatives.ALL))
    assert negatives.search(q, norm[:3], low, v, norm, np.arange(4000), every, 10_000, 10)[3] <= 3 * 70  # the window's lower limit does
