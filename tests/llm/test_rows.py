import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontam, neardup, substring, suffixes

from .fixtures import frame, prose


@pytest.fixture(scope="module")
def pair(spark):
    """Two different texts with the same 32-bit hash."""
    i = F.col("id").cast("string")
    texts = spark.range(300_000).select(F.concat(*[x for k in range(8) for x in (F.lit(f"v{k}"), i, F.lit(" "))]).alias("text"))
    found = texts.groupBy(F.hash("text").alias("h")).agg(F.sort_array(F.collect_list("text")).alias("t")).filter(F.size("t") > 1).orderBy("h").first()
    return found.t[:2]


def test_texts_without_id_stay_apart(spark, pair):
    kept = neardup.one_of_each(frame(spark, [(None, pair[0], "s"), (None, pair[1], "s"), (None, pair[1], "s")], True))
    assert sorted(r.text for r in kept.collect()) == sorted(pair)


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "s")] * 3 + [(None, "", "s")] * 2 + [(7, " \n", "s")] * 2 + [(8, "some words", "s")] * 2
    docs = frame(spark, rows, True)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t, _ in rows[:-1])


def test_a_clean_text_stays_beside_a_contaminated_one(spark, pair):
    benchmark = spark.createDataFrame([("b", pair[0])], "item_id string, text string")
    docs = frame(spark, [(None, pair[0], "s"), (None, pair[1], "s")])
    assert sorted(r.contaminated for r in decontam.find_contamination(docs, benchmark).collect()) == [False, True]
    assert [r.text for r in decontam.clean_documents(docs, benchmark).collect()] == [pair[1]]


def test_one_texts_ranges_are_not_the_others(spark, pair):
    """The first text's words come again, the second one's don't."""
    rows = [(None, pair[0], "s"), (None, pair[1], "s"), (5, pair[0], "s")]
    for found in (substring.remove_repeats(frame(spark, rows), 8, 3), suffixes.remove_repeats(frame(spark, rows), 40, 8)):
        assert sorted(r.n_removed > 0 for r in found.collect()) == [False, True, True]
