import pytest

from quaylog.llm import hot_keys, simhash, suffixes


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_and_lose_no_row(spark, monkeypatch, how):
    monkeypatch.setattr(hot_keys, "LEAST_ROWS", 10)
    keys = [7] * 95 + [8] * 10 + [9] * 11 + [None] * 3 + list(range(100, 120))
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k int")
    answers = rows.where("k is not null and k < 110").groupBy("k").count()
    got = hot_keys.salted_join(rows, answers, "k", "count", len(keys), how)
    assert sorted(map(str, got.select("id", "k", "count").collect())) == sorted(map(str, rows.join(answers, "k", how).select("id", "k", "count").collect()))


def test_copies_beyond_the_bound(spark, monkeypatch):
    texts = ["", None, "alpha beta gamma delta " * 20] * 9 + ["one two three four five", "epsilon " * 40]
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = [sorted(map(str, f(docs).collect())) for f in (simhash.near_duplicates, suffixes.remove_repeats)]
    monkeypatch.setattr(hot_keys, "LEAST_ROWS", 2)
    assert plain == [sorted(map(str, f(docs).collect())) for f in (simhash.near_duplicates, suffixes.remove_repeats)]
