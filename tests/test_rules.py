"""Edge rows of single operators, with values taken by hand from the rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from clausewise.functions import geometry as geo
from clausewise.functions import similarity as sim
from clausewise.functions import text as tx
from clausewise.operators import matcher, registry, replies, search
from clausewise.sources.files import Catalog, decoded, documents
from clausewise.sources.llm import LanguageModel
from clausewise.streaming import each_batch

TEMPLATE = "template_id string, t_name string, t_language string, t_created_at string, t_page_count long, t_total_chars long"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("text,pattern", [("a__b___c", "_{2,}"), ("___", "_"), ("x", "_"), ("", "_+"), ("é__😀__", "_{2}"), ("Имя____\n имя", "имя")])
def test_spans_are_those_of_finditer(spark, text, pattern):
    got = one(spark, tx.spans(F.lit(text), "(?iu)" + pattern).alias("s"))["s"]
    assert [(s["start"], s["stop"], s["matched"]) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text, re.I)]


def test_words_and_tokens(spark):
    row = one(spark, tx.anchor_words(F.lit("Подпись____ имя Имя ab abc")), tx.alias_tokens(F.lit("ООО «Ромашка» Ромашка плюс")), tx.distinctive_tokens(F.lit("не указан")), tx.distinctive_tokens(F.lit('ООО "Вектор Плюс" Директор')))
    assert list(row) == [["Подпись", "имя", "abc"], ["Ромашка", "плюс"], [], ["Вектор Плюс", "Вектор", "Плюс"]]


def test_role_phrase(spark):
    say = lambda before: tx.in_role_phrase(F.lit(before), F.lit("Ivanov ____"), F.array(F.lit("Ivanov")))
    assert list(one(spark, say("начальник "), say("начальник a b "), say("начальник a b c "), say(""))) == [True, True, False, False]


def test_pattern_rules():
    assert not search.admissible(r"_{3,}[\s\S]{0,60}x") and search.admissible(r"x[\s\S]_{3,}") and not search.admissible("([") and not search.admissible(r"(?:\.{5,}[\s\S]x")


def test_similarities(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    vec = lambda *xs: sim.unit(F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>"))
    row = one(
        spark, sim.simhash_similarity(F.lit(-1), F.lit(0)), sim.simhash_similarity(F.lit(None).cast("long"), F.lit(0)), sim.jaccard(arr(), arr()), sim.jaccard(arr("A "), arr()), sim.jaccard(arr("A "), arr("a", "b")),
        sim.cosine(vec(1, 2), vec(1, 2, 0)), sim.cosine(vec(), vec(1)), sim.cosine(vec(0, 0), vec(1, 1)), sim.page_similarity(F.lit(0), F.lit(0)), sim.page_similarity(F.lit(2), F.lit(4)),
    )
    assert [round(x, 9) for x in row] == [0.0, 0.0, 1.0, 0.0, 0.5, 1.0, 0.0, 0.0, 1.0, 0.5]


def test_parse_simhash(spark):
    row = one(spark, *[sim.parse_simhash(F.lit(x)).alias(f"c{i}") for i, x in enumerate(["18446744073709551615", "ff", "0xFF", "zz", "", " 12 ", "-3"])])
    assert list(row) == [-1, 255, 255, None, None, 12, -3]


def test_quick_filter_is_exact_at_its_edges(spark):
    templates = spark.createDataFrame([("a", "a", "en", "1", 5, 1000), ("b", "b", "en", "1", 5, 0), ("c", "c", "pl", "1", 5, 1000)], TEMPLATE)
    docs = spark.createDataFrame([(i, "en", p, c) for i, (p, c) in enumerate([(5, 800), (5, 1250), (5, 799), (5, 1251), (3, 1000), (7, 1000), (2, 1000), (8, 1000), (5, 0)])], "doc_id long, language string, page_count long, total_chars long")
    got = {(r.doc_id, r.template_id) for r in matcher.candidates(docs, templates).collect()}
    assert got == {(i, "a") for i in (0, 1, 4, 5)} | {(i, "b") for i in (0, 1, 2, 3, 4, 5, 8)}


def top(spark, scores):
    rows = [(1, t, s, d, True, 0.0, 0.0) for t, s, d in scores]
    frame = spark.createDataFrame(rows, "doc_id long, template_id string, score double, t_created_at string, synonyms_match boolean, simhash_sim double, jaccard_sim double").withColumn("t_name", F.col("template_id"))
    ranked = matcher.ranked(frame)
    order = [r.template_id for r in ranked.orderBy("rank").collect()]
    return order, matcher.decisions(spark.createDataFrame([(1,)], "doc_id long"), ranked).first()


def test_top_five_zones_and_collisions(spark):
    order, d = top(spark, [("a", 0.995, "2024"), ("b", 0.995, "2025"), ("c", 1.0, "2020")])
    assert order == ["c", "b", "a"] and d.traffic_light == "green" and not d.collision
    order, d = top(spark, [("a", 0.98, "2024"), ("b", 0.95, "2025"), ("c", 0.9, "2026")])
    assert order == ["b", "a", "c"] and d.traffic_light == "yellow" and d.collision
    order, d = top(spark, [("a", 0.97, "2024"), ("b", 0.9, "2025")])
    assert order == ["a", "b"] and d.traffic_light == "green"
    order, d = top(spark, [("b", 0.5, "1"), ("a", 0.5, "2"), *((f"z{i}", 0.1, "1") for i in range(5))])
    assert order == ["a", "b", "z0", "z1", "z2"] and d.n_candidates == 7 and d.traffic_light == "yellow"
    assert matcher.decisions(spark.createDataFrame([(2,)], "doc_id long"), matcher.ranked(spark.createDataFrame([], "doc_id long, template_id string, score double, t_created_at string, synonyms_match boolean, simhash_sim double, jaccard_sim double, t_name string"))).first().traffic_light == "yellow"


def test_suppression_edges(spark):
    box = lambda s, *r: F.struct(F.lit(s).alias("seq"), geo.rect(*[F.lit(float(x)) for x in r]).alias("r"))
    kept = lambda f, *bs: [b["seq"] for b in one(spark, f(F.array(*bs)).alias("k"))["k"]]
    assert kept(geo.without_overlaps, box(1, 0, 0, 10, 10), box(2, 3, 0, 13, 10), box(3, 2, 0, 12, 10)) == [1, 2]  # ratio 0.70 stays
    assert kept(geo.one_per_row, box(1, 0, 0, 20, 10), box(2, 5, 6, 10, 16), box(3, 20, 0, 30, 10), box(4, 0, 7, 4, 17)) == [4, 2, 3]
    assert kept(geo.one_per_row, box(1, 0, 0, 10, 10), box(2, 5, 7, 15, 17)) == [1, 2]  # rows 7 apart


def test_positions(spark):
    r = geo.rect(*[F.lit(float(x)) for x in (0, 0, 100, 10)])
    at = lambda x, y: tuple(one(spark, geo.position(r, F.lit(float(x)), F.lit(float(y))).alias("p"))["p"])
    assert [at(55, 5), at(56, 20), at(44, 5), at(50, 21), at(50, -11)] == [("on", 0.0), ("right", 6.0), ("left", 6.0), ("below", 16.0), ("above", 16.0)]


def test_replies_are_parsed_strictly(spark):
    row = one(spark, *[replies.json_array(F.lit(x)).isNotNull().alias(f"c{i}") for i, x in enumerate(["[1]", "x [1] y", '["a"], "b": ["c"]', "[1]]", "{}", ""])])
    assert list(row) == [True, True, False, False, False, False]


def test_registry_rules(spark):
    names = spark.createDataFrame([("1", "t", "en"), ("2", "t_v2", "en"), ("3", "t_v4", "en"), ("4", "u_v3", "en"), ("5", "t_v3", "pl")], "template_id string, name string, language string")
    got = {r.template_id: r.new_name for r in registry.next_version(names, names).collect()}
    assert got == {"1": "t_v3", "2": "t_v3", "3": "t_v3", "4": "u_v2", "5": "t_v2"}
    left, archive = registry.deleted(names, spark.createDataFrame([("2",), ("9",)], "template_id string"), "s")
    assert left.count() == 4 and [r.archive_path for r in archive.collect()] == ["templates/_archive/2_s.json"]


def test_catalog_files_and_boundaries(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/root")
    for bad in ("../x", "a/../../x", "/etc/x"):
        with pytest.raises(ValueError):
            catalog.path(bad)
    assert catalog.read_text("a.json") is None and not catalog.delete("a.json")
    for name in ("templates/t2.json", "templates/t1.json", "settings.json"):
        catalog.write_text(name, '{"я": 1}')
    assert catalog.read_text("settings.json") == '{"я": 1}'
    assert [r.path for r in catalog.list_prefix("templates/").collect()] == ["templates/t1.json", "templates/t2.json"]
    assert catalog.delete("settings.json") and not catalog.exists("settings.json")
    catalog.write_table(spark.range(3), "numbers")
    catalog.write_table(spark.range(4), "numbers")
    assert catalog.read_table("numbers").count() == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"p1|p2")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    pages = decoded(documents(spark, str(tmp_path / "in")), {"pdf": lambda raw: raw.decode().split("|")}).orderBy("path", "page_num").collect()
    assert [(p.page_num, p.text, p.error is None) for p in pages] == [(0, "p1", True), (1, "p2", True), (None, None, False)]
    model = LanguageModel(lambda prompt, n: 1 / 0 if prompt == "bad" else prompt.upper())
    got = model.complete(spark.createDataFrame([(1, "a"), (2, "bad")], "doc_id long, prompt string"), "step3").collect()
    assert sorted((r.doc_id, r.step, r.raw) for r in got) == [(1, "step3", "A"), (2, "step3", None)]


def test_documents_as_they_arrive(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    each_batch(stream, lambda b: b.withColumn("x", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_ink(spark):
    c = lambda *m: tuple(one(spark, registry.ink_confidence(*[F.lit(float(x)) for x in m]).alias("r"))["r"])
    assert c(0.25, 120, 100, 1000, 1000) == (1.0, [])
    got = c(0.26, 100, 100, 110, 110)
    assert math.isclose(got[0], 0.0) and got[1] == ["dense", "narrow", "whole"]


def test_stored_hashes(spark):
    from clausewise.functions import similarity as sim

    known = {
        "12": 12, " +7 ": 7, "-5": -5, "18446744073709551615": -1, "18446744073709551616": None, "9223372036854775808": -(1 << 63), "-9223372036854775809": None, "1_000": 1000, "1__0": None, "_1": None, "0x1f": 31, "0X_1f": 31, "ff": 255,
        "f_f": 255, "ffffffffffffffff": -1, "1ffffffffffffffff": None, "0x0000000000000000ff": 255, "": None, "zz": None, "9" * 60: None, "00ff": 255,
    }
    rows = spark.createDataFrame([(k,) for k in known], "t string").select("t", sim.parse_simhash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == known


def test_boxes_behind_a_letter_with_a_longer_lower_case(spark):
    from clausewise.functions import geometry as geo

    row = spark.range(1).select(geo.on_lines(F.array(F.lit("İİ Lessor: ___")))(F.lit("lessor")).alias("a"), geo.on_lines(F.array(F.lit("x İstanbul")))(F.lit("İSTANBUL")).alias("b")).first()
    assert [(r["x0"], r["x1"]) for r in row["a"]] == [(65.0, 95.0)] and [(r["x0"], r["x1"]) for r in row["b"]] == [(60.0, 100.0)]
