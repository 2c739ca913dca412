from collections import Counter

from quireforge.operators import skew


def test_heavy_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 900)] + [(None, 0)] * 400, "k long, v long")
    assert [r[0] for r in skew.heavy_keys(df, ["k"]).collect()] == [1]
    assert skew.heavy_keys(df.limit(0), ["k"]) is None and skew.heavy_keys(spark.range(1000).withColumnRenamed("id", "k"), ["k"]) is None
    assert skew.heavy_keys(df, ["k"], 1) is None


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(1, "a", i) for i in range(300)] + [(i % 9, "b", i) for i in range(90)] + [(None, "a", 0)] * 5, "k long, w string, v long")
    small = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "b", "z"), (77, "a", "q"), (None, "a", "n")], "k long, w string, s string")
    heavy = {"k": skew.heavy_keys(big, ["k"], 5), "w": None}
    for how in ("inner", "left"):
        got = skew.salted_join(big, small, ["k", "w"], heavy, ["v"], how)
        assert got.columns == big.join(small, ["k", "w"], how).columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, big.join(small, ["k", "w"], how).collect()))
