"""Patterns as users write them: classes of all scripts, and stored ones that do not compile."""

from pyspark.sql import functions as F

from clausewise.operators import registry, search


def pages(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_num int, text string")


def test_classes_are_those_of_all_scripts(spark):
    party = search.Party("Lessor", (r"Lessor:\s*_{3,}", r"\bПодпись\w*\s*_{3,}"))
    got = search.find_signatures(pages(spark, ["Lessor: _____\n", "Lessor: _____\n", "ПОДПИСЬЮ _____\n", "none\n"]), party)
    assert {r.doc_id for r in got.collect()} == {0, 1, 2}
    assert [r.n for r in search.count_patterns(pages(spark, ["a b a b\n"]), [r"a\sb", "(["]).orderBy("pattern_idx").collect()] == [2, -1]


def test_stored_patterns_that_do_not_compile_fall_back(spark):
    box = "struct(1d as x0, 2d as y0, 3d as x1, 4d as y1)"
    anchors = spark.createDataFrame([(0, 0, "(["), (0, 1, r"Lessor:\s*_{3,}"), (0, 2, None)], "doc_id long, anchor_idx int, pattern string")
    anchors = anchors.select("*", F.lit("any").alias("page_hint"), F.lit("").alias("context_before"), F.lit("own").alias("anchor_text"), F.expr(box).alias("bbox"))
    got = search.apply_anchors(pages(spark, ["Lessor: _____\n"]), anchors).orderBy("match_id").collect()
    assert [(r.match_id, r.pattern) for r in got] == [("tpl_001", "[bbox_fallback] (["), ("tpl_002", r"Lessor:\s*_{3,}"), ("tpl_003", "[bbox_fallback] ")]
    assert [r.x0 for r in got] == [1.0, 50.0, 1.0]


def test_new_versions_start_without_usage(spark):
    rows = [("a", "tpl_x", "en", "2024-01-01", 5, "2024-02-01"), ("b", "tpl_x_v2", "en", "2024-01-02", 1, None), ("c", "tpl_y", "pl", "2024-01-03", 0, None)]
    table = spark.createDataFrame(rows, "template_id string, name string, language string, created_at string, times_applied int, last_used string")
    wanted = spark.createDataFrame([("a",), ("c",), ("zz",)], "template_id string")
    got = registry.new_version(table, wanted, "2025-01-01").orderBy("template_id").collect()
    assert [tuple(r) for r in got] == [("a_v3", "tpl_x_v3", "en", "2025-01-01", 0, None), ("c_v2", "tpl_y_v2", "pl", "2025-01-01", 0, None)]
