"""Storage, settings, ink and the facade's templates."""

import pytest
from pyspark.sql import functions as F

from clausewise import engine
from clausewise.operators import ink, matcher, patterns
from clausewise.sources import settings
from clausewise.sources.files import Catalog, catalog


@pytest.fixture
def store(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}")


def test_objects(store):
    assert store.read_bytes("a/b.bin") is None and store.read_json("a/b.json") is None and not store.delete("a/b.bin")
    store.write_bytes("a/b.bin", b"\x00\xff")
    store.write_json("a/b.json", {"k": "ключ", "n": [1, None]})
    assert store.read_bytes("a/b.bin") == b"\x00\xff" and store.read_json("a/b.json") == {"k": "ключ", "n": [1, None]} and "ключ" in store.read_text("a/b.json")
    assert [r.path for r in store.list_prefix("a/").collect()] == ["a/b.bin", "a/b.json"]
    assert store.delete("a/b.bin") and not store.exists("a/b.bin")
    for work in (lambda: store.read_bytes("../x"), lambda: store.write_bytes("../x", b"")):
        with pytest.raises(ValueError):
            work()


def test_tables_are_replaced(spark, store):
    store.write_table(spark.range(3), "t")
    store.write_table(spark.range(5), "t")
    assert store.read_table("t").count() == 5 and not store.exists("t.old") and not store.exists("t.new")


def test_catalog_by_mode(spark, tmp_path):
    env = {"STORAGE_MODE": "gcs", "GCS_BUCKET": "b"}
    assert catalog(spark, env=env).root == "gs://b" and catalog(spark, env={"GCS_BUCKET": "b"}).root == "gs://b"
    assert catalog(spark, "local", str(tmp_path), env).root == f"file://{tmp_path}" and catalog(spark, env={"STORAGE_PATH": str(tmp_path)}).root == f"file://{tmp_path}"
    for mode in ("nonsense", "gcs"):
        with pytest.raises(ValueError):
            catalog(spark, mode, env={})


def test_settings(store):
    defaults = {"languages": {"en": {"marker_words": ["Sign"]}}}
    assert settings.markers(None, defaults) == defaults and settings.markers_of(store, defaults, "EN-us") == {"marker_words": ["Sign"]} and settings.markers_of(store, defaults, None) == {}
    store.write_json(settings.MARKERS, {"languages": {"pl": {}}})
    assert settings.markers(store, defaults) == {"languages": {"pl": {}}}
    assert settings.profile(store) == settings.NO_PROFILE and settings.prompts(store, {"a": "1"}) == {"a": "1"}
    settings.save_profile(store, {"company_aliases": [{"language": "ru", "value": "Ромашка"}, {"language": "en", "value": " "}]})
    store.write_json(settings.PROMPTS, {"b": "2"})
    assert settings.profile(store)["version"] == "1.0" and settings.profile(store)["updated_at"] and settings.aliases(store, "en") == {"company": ["Ромашка"], "signer": []}
    assert settings.prompts(store, {"a": "1", "b": "1"}) == {"a": "1", "b": "2"}
    assert settings.thresholds(store) == matcher.Decision()
    settings.save_thresholds(store, matcher.Decision(0.9))
    assert settings.thresholds(store).green_threshold == 0.9
    store.write_json(settings.THRESHOLDS[0], {"green_threshold": 0.8})
    assert settings.thresholds(store) == matcher.Decision(0.8)
    store.write_json(settings.THRESHOLDS[0], {"unknown": 1})
    store.write_text(settings.PROFILE, "{")
    assert settings.thresholds(store).green_threshold == 0.9 and settings.profile(store) == settings.NO_PROFILE


def test_providers(store):
    known, env = {"one": "ONE_KEY", "two": "TWO_KEY", "three": "THREE_KEY"}, {"ONE_KEY": " e1 ", "TWO_KEY": "e2", "LLM_PROVIDER": "One"}
    own = settings.Providers(store, known, env)
    assert own.active() == "one" and own.key("one") == "e1" and own.configured() == ["one", "two"]
    own.prefer(" TWO ")
    assert own.active() == "two" and own.key("two") == "e2" and own.configured() == ["two", "one"]
    own.prefer("three")
    assert own.active() == "one" and own.configured() == ["one", "two"]
    empty = settings.Providers(None, known, {"LLM_PROVIDER": "one"})
    assert empty.configured() == []
    for work in (empty.active, lambda: empty.key("one"), lambda: settings.Providers(store, known, {"ONE_KEY": "e1"}).active()):
        with pytest.raises(RuntimeError):
            work()
    store.write_text(settings.PROVIDERS, "{")
    assert own.configured() == ["one", "two"]


def test_keys_are_never_written(store):
    settings.Providers(store, {"one": "ONE_KEY"}, {"ONE_KEY": "secret"}).prefer("one")
    assert store.read_json(settings.PROVIDERS) == {"active_provider": "one"}


def test_ink(spark):
    def mask(w, h, x0, y0, x1, y1):
        return bytearray(b"".join(bytes(1 if x0 <= x < x1 and y0 <= y < y1 else 0 for x in range(w)) for y in range(h)))

    rows = [(0, 100, 50, mask(100, 50, 30, 20, 60, 25)), (1, 40, 40, mask(40, 40, 0, 0, 40, 40)), (2, 10, 10, bytearray(100)), (3, 10, 10, None)]
    got = ink.measured(spark.createDataFrame(rows, "id int, width int, height int, ink binary")).orderBy("id").collect()
    assert tuple(got[0].bbox) == (18, 8, 54, 29) and got[0].coverage == pytest.approx(150 / (54 * 29)) and got[0].confidence == 1.0 and got[0].warnings == []
    assert tuple(got[1].bbox) == (0, 0, 40, 40) and got[1].confidence == 0.0 and got[1].warnings == ["dense", "narrow", "whole"]
    assert [(r.confidence, r.warnings) for r in got[2:]] == [(0.0, ["no ink"])] * 2


def test_replies_with_patterns(spark):
    rows = spark.createDataFrame([(0, '```json\n["a", 1, "b"]\n```'), (1, "{}"), (2, None), (3, "[]")], "doc_id long, raw string")
    got = patterns.answered(rows).orderBy("doc_id").collect()
    assert [(r.patterns, r.error) for r in got] == [(["a", "b"], None)] + [([], "no patterns")] * 3
    pages = F.array(*[F.lit(x).cast("int") for x in (3, 1, None, 3, 0, -2)])
    counts = F.array(F.struct(F.lit("a_").alias("pattern"), F.lit(2).alias("n")), F.struct(F.lit("([").alias("pattern"), F.lit(-1).alias("n")))
    row = spark.range(1).select(patterns.page_indexes(pages).alias("p"), patterns.count_lines(counts).alias("c")).first()
    assert row.p == [0, 2] and row.c == '  - "a_" → 2 матчей\n  - "([" → -1 матчей'


def test_analysis_saves_templates_that_are_found_again(spark):
    import json

    text = "LEASE AGREEMENT hereinafter the Lessor\n" + "terms of the lease " * 20 + "\nLessor: ________ /Ivanov/\n"
    docs = spark.createDataFrame([(1, "en", False, text.rstrip("\n")), (2, "pl", False, "nothing to sign")], "doc_id long, language string, is_template boolean, text string")
    from clausewise.sources.contracts import lines, pages

    side = json.dumps({"our_side_index": 0, "confidence": 0.9, "our_side_synonyms": {"legal_entity": "Firm", "roles": ["Lessor"], "signer": "Ivanov"}})
    replies = spark.createDataFrame([(1, "step3", side), (1, "step4", '{"patterns": ["Lessor: _{3,}"]}')], "doc_id long, step string, raw string")
    ask = lambda ids: replies.join(ids, "doc_id", "left_semi")
    none = "template_id string, t_name string, t_language string, t_created_at string, t_page_count long, t_total_chars long, t_chars_per_page array<int>, t_unit_pages array<double>, t_simhash long, t_titles array<string>"
    no_anchors = "template_id string, anchor_idx int, pattern string, page_hint string, context_before string, anchor_text string, bbox struct<x0: double, y0: double, x1: double, y1: double>"
    first = engine.analyze(docs, pages(docs), lines(docs), spark.createDataFrame([], none), spark.createDataFrame([], no_anchors), ask)
    got = {r.doc_id: r for r in first.results.collect()}
    assert (got[1].traffic_light, got[1].path, got[1].n_matches, got[1].error, got[1].our_side.legal_entity) == ("yellow", "model", 1, None, "Firm")
    assert got[2].path == "model" and got[2].error and got[2].n_matches == 0 and first.events.count() == 0
    templates, anchors = engine.saved_templates(first, "2024-01-01")
    row = templates.first()
    assert (templates.count(), row.template_id, row.t_name, row.t_roles, row.times_applied) == (1, "tpl_2024-01-01_1", "pipelineAuto1_2024-01-01_en_Firm", ["Lessor"], 0)
    box = F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    stored = anchors.select("template_id", F.lit(0).alias("anchor_idx"), F.col("generated_pattern").alias("pattern"), "page_hint", "context_before", "anchor_text", box.alias("bbox"))
    again = engine.analyze(docs, pages(docs), lines(docs), templates, stored, ask)
    got = {r.doc_id: r for r in again.results.collect()}
    assert (got[1].traffic_light, got[1].path, got[1].n_matches, got[1].template_id) == ("green", "template", 1, "tpl_2024-01-01_1") and got[2].path == "model"
    assert [tuple(r)[:2] for r in again.events.collect()] == [("tpl_2024-01-01_1", "applied")]
    assert [(r.match_id, r.pattern) for r in again.matches.collect()] == [("tpl_001", "Lessor: _{3,}")]
