"""Mixtures of more than three languages, of more than four learned ones."""

import random

from clausewise.llm import language_id


def test_all_languages_of_a_mixture_are_found(spark):
    r = random.Random(2)
    letters = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst", "f": "uvwx"}
    say = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(40 * i + j, say(k, 30), k) for i, k in enumerate(letters) for j in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = lambda sizes: " ".join(say(k, n) for k, n in sizes.items())
    want = [{"a": 40}, {"b": 30, "e": 10}, {"a": 40, "c": 20, "e": 20, "f": 20}, {"a": 20, "b": 20, "c": 20, "d": 20, "f": 40}, dict.fromkeys(letters, 20)]
    asked = spark.createDataFrame([(i, mixed(x)) for i, x in enumerate(want)], "doc_id long, text string")
    got = {x.doc_id: x for x in language_id.predict(asked, model).collect()}
    for i, sizes in enumerate(want):
        assert got[i].proportions.keys() == sizes.keys()
        assert all(abs(got[i].proportions[k] - n / sum(sizes.values())) < 0.02 for k, n in sizes.items())
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["a", "b", "a", "f"]
