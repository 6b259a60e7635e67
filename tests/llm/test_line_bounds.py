from mailspan.llm import lines


def test_words_put_in_and_left_out_are_walked_over(spark):
    x = " ".join(f"word{i} of line" for i in range(40))
    pairs = [(x, x.replace("word7 of ", "")), (x, x.replace("word9 ", "word9 and more ")), (x, x.replace("line word20", "lime word20")), (x, "other " * 90), ("a", "b c"), ("語" * 60, "語" * 59 + "文")]
    limit = "((100 - 90) * greatest(length(x), length(y)) div 100)"
    got = spark.createDataFrame(pairs, "x string, y string").selectExpr("levenshtein(x, y) d", f"{limit} l", f"{lines.walked('x', 'y', limit)} w", f"{lines.similar('x', 'y')} s").collect()
    assert all(r.w >= r.d if r.w <= r.l else True for r in got)
    assert [r.w <= r.l for r in got[:4]] == [True, True, True, False]
    assert [r.s for r in got] == [r.d <= r.l for r in got]
