"""The sampled table keeps its columns, whatever these are called."""

from collections import Counter

from factloom.llm import mixing


def test_columns_may_be_called_anything(spark):
    plain = [(i, None if i % 7 == 0 else f"w{i % 5} text of {i}", ["a", "b", None][i % 3], "en", i) for i in range(300)] + [(None, "x", "a", "en", 1), (5, "w0 text of 5", "a", "en", 9)]
    names = "doc_id long, text string, source string, lang string, n int"
    rows = spark.createDataFrame(plain, names)
    want = Counter(map(tuple, mixing.sampled(rows).collect()))
    assert 0 < sum(want.values()) < len(plain)
    clashing = rows.withColumnsRenamed({"n": "probability"}).selectExpr("*", "1 as drawn", "2 as row", "3 as `__mix_p`", "4 as `a.b`", "'s' as n_tokens")
    got = mixing.sampled(clashing)
    assert got.columns == clashing.columns
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert {tuple(r)[5:] for r in got.collect()} == {(1, 2, 3, 4, "s")}
    assert mixing.sampled(clashing.limit(0)).collect() == []
