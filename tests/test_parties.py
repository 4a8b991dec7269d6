"""Many parties at once: the automaton's candidates, its shards, and the rules of the single-party search."""

import random
import re

import pytest

from clausewise.functions import literals as li
from clausewise.functions import patterns as pt
from clausewise.operators import parties as ps
from clausewise.operators import search as se


@pytest.mark.parametrize("most_bytes", [li.MOST_BYTES, 60])
def test_occurring_is_contains(spark, most_bytes):
    r = random.Random(4)
    words = ["Acme", "acme ltd", "ÖLWERK", "ſtern", "Иванов", "x", "straße", "ab", "b", "", None]
    texts = [(i, " ".join(w for w in r.sample(words, 3) if w) + r.choice(["", " ACME LTD", " STERN", " ölwerk"])) for i in range(40)] + [(99, None), (98, "")]
    literals = spark.createDataFrame(list(enumerate(words)), "id long, literal string")
    out = li.occurring(spark.createDataFrame(texts, "k int, t string").repartition(3), ["k"], "t", literals, most_bytes).collect()
    want = {(k, i) for k, t in texts if t for i, w in enumerate(words) if w and li.folded(w) in li.folded(t)}
    assert {(x["k"], x["id"]) for x in out} == want and len(out) == len(want)
    assert li.occurring(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", literals.limit(0)).count() == 0


def test_required_texts_stand_in_every_match():
    known = {
        r"Lessor: *_{3,}": "Lessor:", r"[_\.]{5,} */Ivanov": "/Ivanov", r"_{3,}": None, r"(?:ab|cd)x": None, r"(abc)?def": "def", r"a{4}": "aaaa", r"(?:abc){2,}": "abc", r"x\b(?=q)yz1": "xyz1", r"(?i:Name)s": "Name", r"([": None, r"a": None,
        r"Tenant Customer#1: _": "Tenant Customer#1: _",
    }
    assert {p: pt.required(p) for p in known} == known
    for p, text in (("(?:foo|fob)ar+", "fooarr"), (r"\s+abc\d{2}x", "  ABC12X"), (r"(?>ab)c++d", "abccd")):
        assert pt.required(p) is None or pt.required(p).lower() in re.search(p, text, re.I).group().lower()


@pytest.mark.parametrize("most_bytes", [li.MOST_BYTES, 40])
def test_each_party_is_searched_as_alone(spark, most_bytes):
    pages = spark.createDataFrame([
        (1, 0, "Tenant Acme: _____ /x/\nOwner Beta: ______\n"), (1, 1, "Acme and Beta: ______\n_____ /Acme\n"), (2, 0, "no line for Acme\n"), (2, 1, "начальник Acme _____ \nBeta [____ here\n"), (3, 0, "Tenant ACME: _____\n"),
    ], "doc_id long, page_num int, text string")
    parties = [
        (1, "Acme", [r"Tenant Acme: _{3,}", r"Acme and \w+: _{3,}", r"(a)?(?(1)b|c)", r"_{3,} /Acme"], ["Acme"], None, ["Gamma"]), (2, "Beta", [r"Owner Beta: _{3,}", r"and Beta: _{3,}", r"Beta [[]?_{3,}", r"_{3,}"], ["Beta"], "", None),
        (3, "Acme too", [r"Acme _{3,}", "(["], ["Acme"], "", []), (4, "none", [None], None, None, None),
    ]
    table = spark.createDataFrame(parties, "party_id long, name string, patterns array<string>, aliases array<string>, signer string, other_aliases array<string>")
    columns = ("doc_id", "match_id", "page_num", "x0", "y0", "x1", "y1", "context", "pattern")
    for rivals in (False, True):
        got = {}
        for r in ps.find_parties(pages, table, rivals, most_bytes).collect():
            got.setdefault(r["party_id"], set()).add(tuple(r[c] for c in columns))
        want = {}
        for i, name, patterns, aliases, signer, others in parties:
            rest = [a for j, *_, al, _, _ in parties if j != i for a in al or []] if rivals else []
            own = se.Party(name, tuple(p for p in patterns if p), tuple(aliases or ()), signer or "", (*(others or ()), *rest))
            if found := {tuple(r[c] for c in columns) for r in se.find_signatures(pages, own).collect()}:
                want[i] = found
        assert got == want and len(want) >= (1 if rivals else 2)


def test_first_known_party_by_position(spark):
    names = [(1, " Acme "), (2, "the acme group"), (3, "cm"), (4, "zzz"), (5, ""), (6, None), (7, "BETA"), (1, "beta holding")]
    parties = [(10, 2, "Acme", ["Alpha"]), (20, 1, "ACME GmbH", []), (30, 0, "Beta Holding AG", None), (40, 3, "", ["cm"])]
    out = ps.known_parties(spark.createDataFrame(names, "name_id long, name string"), spark.createDataFrame(parties, "party_id long, pos int, name string, aliases array<string>"))
    assert sorted((r["name_id"], r["party_id"] or 0) for r in out.collect()) == [(1, 20), (1, 30), (2, 10), (3, 20), (4, 0), (5, 0), (6, 0), (7, 30)]
    plain = spark.createDataFrame([(i, n) for i, n in names if n], "name_id long, name string")
    assert sorted((r["name_id"], r["party_id"] or 0) for r in ps.known_parties(plain, spark.createDataFrame(parties, "party_id long, pos int, name string, aliases array<string>"), 5).collect()) == [(1, 20), (1, 30), (2, 10), (3, 20), (4, 0), (7, 30)]


def test_many_literals_are_joined(spark):
    """Beyond the automaton rows and literals are joined: no row meets every shard of 60 bytes, which took rows times shards."""
    import time

    literals = [(i, f"Firm{i} {'x' * (i % 9)}") for i in range(20_000)]
    texts = [(k, f"between FIRM{k * 7} and firm{k} xxx or firm{k}") for k in range(2_000)]
    begin = time.perf_counter()
    out = {(r["k"], r["id"]) for r in li.occurring(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", spark.createDataFrame(literals, "id long, literal string"), 60).collect()}
    assert time.perf_counter() - begin < 60
    own = {li.folded(t): i for i, t in literals}
    sizes = {len(t) for t in own}
    assert out == {(k, own[t[i : i + n]]) for k, t in ((k, li.folded(t)) for k, t in texts) for n in sizes for i in range(len(t) - n + 1) if t[i : i + n] in own} and len(out) > 1_000


def test_windows_of_texts_apart_are_none():
    """A window never runs from one text into the next, and a text longer than what is hashed at once is whole."""
    words, bits = [(1 << 64) - 1] * 1024, 16
    import numpy as np

    full = np.array(words, np.uint64)
    assert li._likely(["ab", "", "cde"], [2, 3], full, bits) == {(0, "ab"), (2, "cd"), (2, "de"), (2, "cde")}
    assert list(li._at_once(["x" * (li.AT_ONCE + 5), "y", "z"])) == [(0, 1), (1, 3)]


def test_patterns_are_parsed_once(monkeypatch):
    calls = []
    parse = pt.parser.parse
    monkeypatch.setattr(pt.parser, "parse", lambda *a, **k: calls.append(a) or parse(*a, **k))
    assert pt.translated_and_required("Tenant Acme: _{3,}") == (pt.FLAGS + r"Tenant\x{20}Acme\x{3A}\x{20}(?:\x{5F}){3,}", "Tenant Acme: ") and len(calls) == 1


@pytest.mark.parametrize("rivals", [False, True])
def test_parties_alike_but_for_their_id(spark, rivals):
    pages = spark.createDataFrame([(1, 0, "Tenant Acme: _____ /x/\nOwner Beta: ______\n"), (2, 0, "Tenant Acme: _____\n")], "doc_id long, page_num int, text string")
    one = lambda i, name, role: (i, [f"{role} {name}: _{{3,}}"], [name], "", None)
    table = [one(1, "Acme", "Tenant"), one(2, "Beta", "Owner"), one(3, "Acme", "Tenant"), one(4, "Acme", "Tenant")]
    out = ps.find_parties(pages, spark.createDataFrame(table, "party_id long, patterns array<string>, aliases array<string>, signer string, other_aliases array<string>"), rivals).collect()
    # With rivals, each of the three stands in the others' way, as they have one name.
    assert sorted((r["doc_id"], r["party_id"]) for r in out) == ([(1, 2)] if rivals else [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4)])
