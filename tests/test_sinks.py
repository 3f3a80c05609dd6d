from loomgraph.sources.sinks import as_strings


def test_strings(spark):
    rows = spark.createDataFrame([(1, 2.0, 2.5, True, "x", None, ["a", "b"], (1,))], "a long, b double, c double, d boolean, e string, `f.g` string, h array<string>, i struct<p: long>")
    got = as_strings(rows).first()
    assert tuple(got) == ("1", "2", "2.5", "true", "x", "<nil>", "[a b]", '{"p":1}')
