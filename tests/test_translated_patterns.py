"""Python patterns in Java's engine give the matches of ``re.finditer``, in all callers, and none ends a query."""

import re

import pytest
from pyspark.sql import functions as F

from clausewise.functions import patterns as pt
from clausewise.functions import text as tx
from clausewise.operators import search as se

PATTERNS = (
    r"Lessor {name} _{3,}", r"[[]?_{3,}", r"_{,9}_{3,}", r"(?P<x>_)(?P=x){3,}", r"a{", r"a{,}", r"a{1", r"x{2,3}?", r"[]a]+", r"[^]a]+", r"[a&&b]+", r"[a-c[x-z]]+", r"\{[^}]*\}", r"}{", r"\bfoo\b", r"\Boo", r"^\w+",
    r"(?m)^\w+$", r"\w+$", r"\Z", r".+", r"(?s).+", r"(?s:a.b)|c.", r"\s+", r"\S+", r"\d+", r"[\W\d]+", r"[^\W\d]+", r"(?a:\w+)", r"(?a)k+", r"(?a:[\w-]+)", r"(?i:(?a:s)|k)", r"(?i:k)+", r"(?-i:Lessor)", r"(a|b)\1", r"(?P<q>['\"]).*?(?P=q)", r"a++b", r"(?>a+)b",
    r"(?<=: )_+", r"(?<!x)_{3,}", r"(?=_)_(?!_)", r"(?:ab|a)(?:c|bcd)", r"_*", r"(?:|_)+?", r"a*?", r"x?", r"(?:(?:a)|b)*", "(?x) l e s s o r  # spaces\n : ", r"\N{LATIN SMALL LETTER A}+", r"[А-Я]+", r"é+", r"[\u00e0-\u00ff]+", r"\x41\t|\.", r"ſ", r"\\",
    r"#", r"(?#c)b", r"[\d-]+", r"[--/]+", r"p\Z", r"(?:a{2}){2}", r"\0?b", r"[\b]", r"😀+", r"[😀-😎]", r"((a)(b))?c\Z", r"(?!)", r"$^",
)
REFUSED = (r"(a)?(?(1)b|c)", r"(a)(?<=\1)b", "([", r"*a", r"(?<=a+)b", r"\p{L}", r"a{99999999999}", r"(?P<x>", r"x{4294967294}")
TEXTS = (
    "", "Lessor {name} _____ [___ ____", "a{ a{,} a{1 aaa xxxx ]a] a&&b xyz", "foo\nfoo bar\n", "oo foofoo\r\nx\u2028y z\u00a0w\x1c!", "No 12 3٣ _é4 Ünï", "aab abb 'q' \"r\" \"s'", "Lessor: ______ /Ivanov/ x____",
    "abcd abc acbcd", "ПОДПИСЬ é É à ÿ", "ſ s S K k K", "a\tA. \\ # {x} }{ 1-2", "😀😀 😎 p", "aaaa ab \x08 c", "lessor : LESSOR:", "__a_", "\n", "ab\n\nab",
)


def test_matches_are_pythons(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for start in range(0, len(PATTERNS), 16):
        some = PATTERNS[start : start + 16]
        java = [pt.compiled(spark, p) for p in some]
        assert None not in java, [p for p, j in zip(some, java, strict=True) if j is None]
        got = rows.select("i", *[F.transform(tx.spans(F.col("text"), j), lambda s: F.struct(s["start"], s["matched"])).alias(f"p{n}") for n, j in enumerate(java)]).collect()
        for r in got:
            for n, p in enumerate(some):
                want = [(m.start(), m.group()) for m in re.finditer(p, TEXTS[r["i"]], re.IGNORECASE) if m.group()]
                assert [tuple(x) for x in r[f"p{n}"]] == want, (p, TEXTS[r["i"]])


def test_refused_patterns_have_a_reason(spark):
    for p in REFUSED:
        java, reason = pt.translated(p)
        assert java is None and reason, p
        assert pt.compiled(spark, p) is None and not se.admissible(p)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, 0, "Lessor {name} _____ here\nno [____ x\n"), (2, 0, "Lessor: ______ /Ivanov/\n"), (3, 0, "nothing\n")]
    return spark.createDataFrame(rows, "doc_id long, page_num int, text string")


def test_no_pattern_ends_a_search(spark, pages):
    own = (*PATTERNS, *REFUSED)
    found = {(r["doc_id"], r["pattern"]) for r in se.raw_matches(pages, se.Party("x", own)).select("doc_id", F.explode("raw").alias("m")).select("doc_id", F.get(F.array(*map(F.lit, own)), F.col("m.s.pattern_idx")).alias("pattern")).collect()}
    assert (1, r"Lessor {name} _{3,}") in found and (1, r"[[]?_{3,}") in found and (2, r"[[]?_{3,}") in found and (2, r"Lessor {name} _{3,}") not in found and not {p for _, p in found} & set(REFUSED)
    counts = {(r["doc_id"], r["pattern_idx"]): r["n"] for r in se.count_patterns(pages, own[:12] + REFUSED).collect()}
    assert counts[1, 0] == 1 and counts[1, 1] == 2 and counts[2, 0] == 0 and all(counts[1, 12 + i] == -1 for i in range(len(REFUSED)))


def test_no_stored_anchor_ends_a_batch(spark, pages):
    own = (*PATTERNS, *REFUSED, None)
    anchors = spark.createDataFrame([(d, i, p, "any", "", "t", (0.0, 0.0, 9.0, 9.0)) for d in (1, 2) for i, p in enumerate(own)], "doc_id long, anchor_idx int, pattern string, page_hint string, context_before string, anchor_text string, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    rows = se.apply_anchors(pages, anchors).collect()
    assert any(r["pattern"] == r"Lessor {name} _{3,}" and r["doc_id"] == 1 and r["x0"] == 50 for r in rows)
    assert {r["pattern"] for r in rows if r["pattern"].startswith("[bbox_fallback]")} >= {f"[bbox_fallback] {p or ''}" for p in (*REFUSED, None)}


def test_no_reply_ends_the_flow(spark, pages):
    from clausewise.operators import auto

    side = '{"our_side_index": 0, "confidence": 0.8, "our_side_synonyms": {"legal_entity": "Acme", "roles": ["Lessor"], "signer": ""}, "all_parties": [{"legal_entity": "Acme", "role": "Lessor", "signer": ""}]}'
    found = spark.createDataFrame([(1, ["(a)?(?(1)b|c)", r"Lessor {name} _{3,}"]), (2, [r"Lessor: _{3,}", "(["])], "doc_id long, patterns array<string>")
    sides = spark.createDataFrame([(1, "step3", side), (2, "step3", side)], "doc_id long, step string, raw string")
    parsed = auto.sides(sides).select("doc_id", "side").join(found.withColumn("patterns", auto.valid_patterns("patterns")), "doc_id").withColumn("error", F.lit(None).cast("string"))
    got = {(r["doc_id"], r["pattern"]) for r in auto.matches(pages, parsed).collect()}
    assert got == {(1, r"Lessor {name} _{3,}"), (2, r"Lessor: _{3,}")}


def test_contexts_of_odd_patterns(spark):
    rows = [(1, "a", 0, p, "Lessor {name} _____ here", 0.0, 0.0, 1.0, 1.0) for p in (*PATTERNS, *REFUSED, "[bbox_fallback] x{")]
    out = se.matches_to_anchors(spark.createDataFrame(rows, "doc_id long, match_id string, page_num int, pattern string, context string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r["generated_pattern"]: (r["context_before"], r["context_after"]) for r in out}[r"Lessor {name} _{3,}"] == ("", " here") and len(out) == len(rows)
