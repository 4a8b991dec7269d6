"""Templates in their stored form, versions of tables, the store of replies, and documents that cannot be read."""

import json

import pytest
from pyspark.sql import functions as F

from clausewise import engine
from clausewise.sources import scratch, templates
from clausewise.sources.files import Catalog, Page, decoded, documents
from clausewise.sources.llm import LanguageModel

ANCHOR = {
    "id": "a1", "anchor_type": "text_proximity", "anchor_level": 1, "anchor_text": "Lessor", "position": "right", "offset_pt": 5.0, "generated_pattern": r"Lessor: _{3,}", "context_before": "", "context_after": "", "page_hint": "last",
    "added_by": "auto_regex", "added_at": "2024-01-01", "bbox": [1.0, 2.0, 3.0, 4.0],
}
FINGERPRINT = {"page_count": 1, "total_chars": 20, "chars_per_page": [20], "header_simhash": "0x1f", "section_titles": ["1. Я"], "language": "en"}


def template(i, **more):
    own = {"template_id": i, "name": f"n {i}", "language": "en", "created_at": "2024-01-01", "created_by": "pipeline_auto_1", "fingerprint": FINGERPRINT, "anchors": [ANCHOR], "synonyms_used": {"legal_entity": "Firm", "roles": ["Lessor"], "signer": None}}
    return {k: v for k, v in (own | more).items() if v != "gone"}


@pytest.fixture
def store(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store")


def test_stored_templates(spark, store):
    assert templates.stored(store).count() == 0 and templates.skipped(store).count() == 0
    old = {k: v for k, v in ANCHOR.items() if k not in ("anchor_type", "offset_pt", "context_before", "context_after", "added_at")}
    rows = {
        "b": template("b", anchors=[ANCHOR, old, {"id": "x"}]), "a": template("a", language="pl", usage_stats={"times_applied": 3, "times_confirmed": 0, "times_rejected": 0, "last_used": None}), "c": template("c", synonyms_used={}, fingerprint={}, anchors=[]),
        "d": template("d", synonyms_used={"legal_entity": None}), "x1": template("x1", name="gone"), "x2": template("x2", other=1), "x4": [1],
    }
    for name, value in rows.items():
        store.write_json(f"templates/{name}.json", value)
    store.write_text("templates/x3.json", "{")
    store.write_text("templates/note.txt", "no template")
    store.write_json("templates/_archive/z_2024.json", template("z"))
    found = templates.stored(store).orderBy("path").collect()
    assert [(r["template_id"], r["recorded"]) for r in found] == [("a", True), ("b", True), ("c", False), ("d", True)]
    assert found[0]["usage_stats"]["times_applied"] == 3 and found[1]["usage_stats"] is None and found[1]["anchors"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert [r["template_id"] for r in templates.stored(store, "pl").collect()] == ["a"]
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in templates.skipped(store).collect()} == {"x1.json": "fields are missing", "x2.json": "unknown fields", "x3.json": "not a JSON object", "x4.json": "not a JSON object"}
    known = {r["template_id"]: r for r in templates.registry(templates.stored(store)).collect()}
    assert known["a"]["t_simhash"] == 31 and known["a"]["t_titles"] == ["1. Я"] and known["c"]["t_total_chars"] == 0 and known["c"]["t_roles"] is None and known["d"]["t_roles"] == []
    own = templates.anchors(templates.stored(store)).where("template_id = 'b'").orderBy("anchor_idx").collect()
    assert [(r["anchor_idx"], r["page_hint"], r["offset_pt"], tuple(r["bbox"])) for r in own] == [(0, "last", 5.0, (1, 2, 3, 4)), (1, "last", 0.0, (1, 2, 3, 4))]
    changed = templates.stored(store).where("template_id = 'b'").withColumn("template_id", F.lit("e"))
    assert templates.save(store, changed) == 1 and store.read_json("templates/e.json")["anchors"][0] == ANCHOR
    assert templates.delete(store, "e", "20240101") and not templates.delete(store, "e", "20240101") and store.exists("templates/_archive/e_20240101.json")
    assert {r["template_id"] for r in templates.stored(store).collect()} == {"a", "b", "c", "d"}


def test_a_write_that_ends_early_leaves_the_old_version(spark, store):
    assert store.read_table("t") is None
    assert store.write_table(spark.range(3), "t") == 1
    before = store.read_table("t")
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.write_table(broken, "t")
    assert store.read_table("t").count() == 3 and store.read_table("t", 2) is None
    (tmp := spark.range(9)).write.parquet(store.path("t/v=7"))
    store._fs(store.path("t/v=7/_SUCCESS"))[0].delete(store._fs(store.path("t/v=7/_SUCCESS"))[1], False)
    assert store.read_table("t").count() == 3 and tmp
    assert store.write_table(spark.range(4), "t") == 8 and store.read_table("t").count() == 4 and before.count() == 3
    assert store.write_table(before.unionByName(store.read_table("t")), "t") == 9 and store.read_table("t").count() == 7 and not store.exists("t/v=1") and store.read_table("t", 8).count() == 4


def counting(folder, answer):
    """A client that leaves one line a call."""

    def client(prompt, n):
        with open(f"{folder}/calls", "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return answer(prompt)

    return client, lambda: sorted(open(f"{folder}/calls").read().splitlines()) if (folder / "calls").exists() else []


def test_each_prompt_is_asked_once(spark, store, tmp_path):
    client, calls = counting(tmp_path, lambda p: 1 / 0 if p == "bad" else p.upper())
    model = LanguageModel(client, "m1", store, rounds=2)
    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a"), (4, None), (5, "b")], "doc_id long, prompt string").repartition(3)
    want = [(1, "A", False), (2, None, True), (3, "A", False), (4, None, False), (5, "B", False)]
    show = lambda out: sorted((r["doc_id"], r["raw"], r["error"] is not None) for r in out.collect())
    out = model.complete(prompts, "s")
    assert show(out) == want and show(out) == want and calls() == ["a", "b", "bad"]
    more = prompts.unionByName(spark.createDataFrame([(6, "c")], "doc_id long, prompt string"))
    assert show(model.complete(more, "s"))[:5] == want and calls() == ["a", "b", "bad", "bad", "c"]  # what failed is asked again
    LanguageModel(client, "m2", store).complete(prompts.where("doc_id = 1"), "s").count()
    assert calls().count("a") == 2  # another model, another reply
    LanguageModel(client, "m1").complete(prompts.where("doc_id = 1"), "s").count()
    assert calls().count("a") == 3  # without a store, once a run
    assert model.is_available() and not LanguageModel(None).is_available()


def test_structured_replies(spark, store, tmp_path):
    turn = lambda p: "```json\n{\"x\": 1}\n```" if "good" in p else ("{}" if "lacks" in p else "no JSON")
    client, calls = counting(tmp_path, turn)
    model = LanguageModel(client, "m", store)
    rows = spark.createDataFrame([(1, "sys", "good"), (2, "sys", "lacks"), (3, "sys", "odd"), (4, "sys", "good")], "doc_id long, system string, user string")
    got = {r["doc_id"]: (r["raw"] is not None, r["error"]) for r in model.complete_structured(rows, {"type": "object", "required": ["x"]}, "s").collect()}
    assert got[1] == got[4] == (True, None) and got[2][0] is got[3][0] is False and got[2][1] and got[3][1]
    asked = calls()
    assert len(asked) == 5 and all('Schema: {"type": "object", "required": ["x"]}' in c for c in asked)  # one good, two bad ones twice
    model.complete_structured(rows, {"type": "object", "required": ["x"]}, "s").count()
    assert len(calls()) == 5


def test_scratch_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return "file:/tmp/w" if "warehouse" in key else default

    class Context:
        master = "spark://elsewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        scratch.root(Session())


def test_unreadable_documents_have_a_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.pdf").write_bytes(b"LEASE\nLessor: ______ /x/\n")
    (tmp_path / "in/2.pdf").write_bytes(b"%")
    (tmp_path / "in/3.xyz").write_bytes(b"x")

    def pdf(raw):
        if len(raw) < 4:
            raise ValueError("an empty file")
        yield Page(raw.decode(), [("LEASE", 50, 50, 90, 62), ("Lessor:", 50, 70, 90, 82), ("______", 95, 70, 140, 82), ("/x/", 145, 70, 160, 82)], "en")

    files = decoded(documents(spark, str(tmp_path / "in")), {"pdf": pdf}).withColumn("doc_id", F.regexp_extract("path", r"([0-9])\.[a-z]+$", 1).cast("long")).cache()
    pages = files.where("error is null").select("doc_id", "language", F.lit(False).alias("is_template"), "page_num", "text", "words")
    docs = files.select("doc_id", F.coalesce("language", F.lit("ru")).alias("language"), F.lit(False).alias("is_template")).distinct()
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    side = json.dumps({"our_side_index": 0, "confidence": 0.9, "our_side_synonyms": {"legal_entity": "Firm", "roles": ["Lessor"], "signer": ""}})
    replies = spark.createDataFrame([(1, "step3", side), (1, "step4", json.dumps({"patterns": ["Lessor: {nobody}", r"Lessor: _{3,}"]}))], "doc_id long, step string, raw string")
    registry = templates.registry(templates.stored(Catalog(spark, f"file://{tmp_path}/none")))
    anchors = templates.anchors(templates.stored(Catalog(spark, f"file://{tmp_path}/none")))
    a = engine.analyze(docs, pages, lines, registry, anchors, lambda ids: replies.join(ids, "doc_id", "left_semi"), failed=files.where("error is not null").select("doc_id", "error"))
    got = {r["doc_id"]: (r["traffic_light"], r["n_matches"], r["error"]) for r in a.results.collect()}
    assert got[1] == ("yellow", 1, None) and got[2] == ("no_match", 0, "an empty file") and got[3][:2] == ("no_match", 0) and "unsupported" in got[3][2]
    assert [(r["x0"], r["x1"], r["y0"]) for r in a.matches.collect()] == [(50.0, 140.0, 70.0)]
