"""Prompts hold the whole contract text."""

from conftest import DATA

import __spark_entry__ as entry
from clausewise.sources.contracts import contracts

HEAD = 'Language {}: - "Lessor" (синонимы/языковые варианты: Owner, Арендодатель; отображение: Side A)\n- "Lessee" (Lessee)\n'


def test_prompts_hold_whole_texts(spark):
    import hashlib

    sf_dir = f"{DATA}/sf0.001"
    got = {r.doc_id: (r.size, r.digest) for r in entry.queries()["prompts_whole"](spark, sf_dir).collect()}
    want = {r.doc_id: HEAD.format(r.language) + r.text for r in contracts(spark, sf_dir).select("doc_id", "language", "text").collect()}
    assert max(map(len, want.values())) > 10_000
    assert got == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}
