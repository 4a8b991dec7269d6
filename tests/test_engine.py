"""The engine as one object, its settings, counters from a stream, and functions of SQL."""

import json

import pytest
from pyspark.sql import functions as F

from clausewise import engine, streaming
from clausewise.config import Config
from clausewise.functions import exports
from clausewise.operators import registry
from clausewise.sources.files import Catalog, Page
from clausewise.sources.llm import LanguageModel


@pytest.fixture
def store(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store")


def test_config(spark):
    assert Config.from_env({}) == Config() and Config.from_env({"GCS_BUCKET": "b"}).storage_mode == "gcs"
    own = Config.from_env({"STORAGE_MODE": "LOCAL", "GCS_BUCKET": "b", "STORAGE_PATH": "/x", "LLM_MODEL": "m"}, storage_path="/y")
    assert (own.storage_mode, own.storage_path, own.model) == ("local", "/y", "m") and own.catalog(spark).root == "file:///y"
    for bad in (lambda: Config.from_env({}, colour="red"), lambda: Config.from_env({"STORAGE_MODE": "ftp"}), lambda: own.validate({}), lambda: Config(storage_path="").validate({"LLM_API_KEY": "k"}), lambda: Config("gcs").validate({"LLM_API_KEY": "k"})):
        with pytest.raises(ValueError):
            bad()
    own.validate({"LLM_API_KEY": "k"})
    assert "k" not in repr(own).split("key_variable")[0].split("=")


def test_engine_from_files_to_saved_templates(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    text = "LEASE AGREEMENT hereinafter the Lessor\n" + "terms of the lease " * 20 + "\nLessor: ________ /Ivanov/\n"
    for name in ("a.pdf", "b.pdf", "bad.pdf"):
        (tmp_path / "in" / name).write_text(name + text if name != "bad.pdf" else "!")

    def pdf(raw):
        own = raw.decode()
        if own == "!":
            raise ValueError("damaged")
        own = own[5:]
        words = [(w, 50.0 + 9 * i, 50.0 + 20 * n, 58.0 + 9 * i, 62.0 + 20 * n) for n, line in enumerate(own.split("\n")) for i, w in enumerate(line.split())]
        yield Page(own, words, "en")

    side = json.dumps({"our_side_index": 0, "confidence": 0.9, "our_side_synonyms": {"legal_entity": "Firm", "roles": ["Lessor"], "signer": "Ivanov"}})
    model = LanguageModel(lambda prompt, n: side if prompt.startswith("side") else json.dumps({"patterns": [r"Lessor: _{3,}"]}), "m", store)
    own = engine.Engine(spark, Config(storage_path=str(tmp_path)), store, model)
    pages, failed = own.read(str(tmp_path / "in"), {"pdf": pdf})
    docs = pages.select("doc_id", "language", F.lit(False).alias("is_template")).distinct()
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    prompts = lambda ids: ids.select("doc_id", F.explode(F.array(F.lit("step3"), F.lit("step4"))).alias("step")).withColumn("prompt", F.when(F.col("step") == "step3", "side?").otherwise("patterns?"))
    pages = pages.withColumn("is_template", F.lit(False))
    a = own.analyze(docs, pages, lines, prompts, failed)
    got = sorted((r["traffic_light"], r["path"], r["n_matches"], r["error"]) for r in a.results.select("traffic_light", "path", "n_matches", F.coalesce("error", F.lit("")).alias("error")).fillna("", ["path"]).collect())
    assert got == [("no_match", "", 0, "damaged"), ("yellow", "model", 1, ""), ("yellow", "model", 1, "")]
    assert {(r["x0"], r["x1"], r["y0"]) for r in a.matches.collect()} == {(50.0, 67.0, 90.0)}
    placed = own.placements(a.matches.withColumn("status", F.lit("candidate")).withColumn("operator_excluded", F.lit(False)), pages).collect()
    assert len(placed) == 2 and all(r["sig_x0"] == 79.0 for r in placed)  # 20 points into the line
    click = spark.createDataFrame([(1, a.matches.first()["doc_id"], 0, 70.0, 96.0)], "click_id long, doc_id long, page_num int, x double, y double")
    assert own.anchors_from_clicks(click, pages).first()["anchor_text"] == "Lessor: ________ /Ivanov/"
    stored = {"template_id": "t1", "name": "n", "language": "en", "created_at": "2024", "created_by": "x", "fingerprint": {}, "anchors": [{"id": "a"}], "synonyms_used": {}}
    store.write_json("templates/t1.json", stored)
    assert own.template("t1").count() == 1 and own.templates("pl").count() == 0 and own.thresholds().green_threshold == 0.95
    new = spark.createDataFrame([("a", "again"), ("b", "new"), ("b", "twice"), (None, "null")], "id string, anchor_text string")
    assert own.add_anchors("t1", new) and not own.add_anchors("t2", new)
    assert [(x["id"], x["anchor_text"]) for x in own.template("t1").first()["anchors"]] == [("a", None), ("b", "new"), (None, "null")]
    assert own.delete("t1", "s") and not own.delete("t1", "s")


def test_replayed_batches_count_once(spark, store, tmp_path):
    kinds = ("applied", "confirmed", "rejected", "other")
    rows = [(f"t{i % 5}" if i % 11 else None, kinds[i % 4], f"2024-01-{1 + i % 28:02d}") for i in range(200)]
    events = lambda some: spark.createDataFrame(some, "template_id string, event string, ts string")
    known = spark.createDataFrame([(f"t{i}",) for i in range(7)], "template_id string")
    show = lambda df: sorted((*map(str, r),) for r in df.collect())
    assert show(streaming.usage_of(store, "usage", known)) == show(registry.usage(known, events([])))
    for n, lo in enumerate((0, 70, 150)):
        part = events(rows[lo : (70, 150, 200)[n]])
        assert streaming.merge_usage(store, "usage", part, n) and not streaming.merge_usage(store, "usage", part, n)
    assert not streaming.merge_usage(store, "usage", events(rows[:70]), 0)
    want = show(registry.usage(known, events(rows)))
    assert show(streaming.usage_of(store, "usage", known)) == want
    for n, lo in enumerate((0, 120)):
        events(rows[lo : (120, 200)[n]]).coalesce(1).write.mode("append").json(f"{tmp_path}/events")
        stream = spark.readStream.schema("template_id string, event string, ts string").json(f"{tmp_path}/events")
        streaming.usage_counters(stream, store, "streamed", f"{tmp_path}/marks").awaitTermination()
    assert show(streaming.usage_of(store, "streamed", known)) == want


def test_functions_of_sql(spark):
    names = exports.register(spark)
    assert set(names) >= {"signature_spans", "signature_line", "java_pattern", "simhash64"} and exports.register(spark) == names
    got = spark.sql(r"SELECT s.* FROM VALUES ('a ___ B __'), (null) AS v(t), LATERAL signature_spans(t, r'_{,9}|b') AS s").collect()
    assert [tuple(r) for r in got] == [(2, 5, "___"), (6, 7, "B"), (8, 10, "__")]
    assert spark.sql("SELECT * FROM signature_spans('a', '(')").count() == 0
    row = spark.sql("SELECT java_pattern('([') AS j, masked_key('a-b-c-d') AS k, simhash_similarity(1, 3) AS s, page_similarity(2, 4) AS p, signature_line('..... x') AS l").first()
    assert tuple(row) == (None, "a-b-c-***", 1 - 1 / 64, 0.5, True)


def test_settled_rows_are_not_sent_through_the_driver(spark):
    """Files of ids and few distinct values are small, their rows of many documents are not: by the files' size they were broadcast."""
    rows = engine.settled(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 300).alias("side")))
    other = spark.range(100).select(F.col("id").alias("doc_id"))
    for joined in (other.join(rows.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi"), other.join(rows.groupBy("doc_id").agg(F.max("side").alias("s")), "doc_id", "left")):
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString() and joined.count() in (50, 100)
