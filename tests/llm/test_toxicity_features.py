import random

from pyspark.sql import functions as F

from loomgraph.llm import toxicity

from .fixtures import frame, prose


def right(spark, texts_and_labels):
    """The share of held-out rows that are predicted right."""
    docs = frame(spark, [(i, t, "s") for i, (t, _) in enumerate(texts_and_labels)])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts_and_labels)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    rows = docs.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", toxicity.score(spark, F.col("text"), machine).alias("score")).collect()
    return sum((r.score >= toxicity.THRESHOLD) == texts_and_labels[r.doc_id][1] for r in rows) / len(rows)


def mixed(rng, *words):
    all_words = prose(rng, rng.choice((10, 30, 60))).split() + list(words)
    rng.shuffle(all_words)
    return " ".join(all_words)


def test_half_of_the_labels_toxic(spark):
    rng = random.Random(3)
    assert right(spark, [(mixed(rng, *["badslur"] * (i % 2)), i % 2) for i in range(1200)]) > 0.97


def test_a_name_that_is_mostly_clean_alone(spark):
    rng = random.Random(4)
    words = {0: ["badslur"], 1: ["meanie", "groupies"], 2: ["meanie"]} | {k: ["groupies"] for k in range(3, 10)}
    assert right(spark, [(mixed(rng, *words.get(i % 12, [])), int(i % 12 < 2)) for i in range(2400)]) > 0.97
