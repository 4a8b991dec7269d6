"""Values of prompts."""

import json

from pyspark.sql import functions as F

from clausewise.operators import prompts


def test_indented_json_is_the_usual_one(spark):
    rows = [([(1, 'a "b"\n\\', 0.5), (None, "п/é", None)],), ([],)]
    df = spark.createDataFrame(rows, "items array<struct<page: int, context: string, score: double>>")
    got = [r[0] for r in df.select(prompts.indented_json(F.col("items"), ("page", "context", "score"))).collect()]
    assert got == [json.dumps([dict(zip(("page", "context", "score"), x)) for x in items], ensure_ascii=False, indent=2) for (items,) in rows]


def test_places_in_values_are_filled_by_one_way_only(spark):
    values = {"a": F.lit("{b}"), "b": F.lit("x")}
    row = spark.range(1).select(prompts.filled("{a} {c}", values), prompts.filled_once("{a} {b} {c} {", values)).first()
    assert tuple(row) == ("x {c}", "{b} x {c} {")
