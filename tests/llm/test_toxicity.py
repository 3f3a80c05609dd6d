import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from loomgraph.llm import toxicity

from .fixtures import DOCS, documents, frame, prose, write_tables


def labelled(spark, n=1800):
    """Toxic texts hold a slur, or a soft insult together with a group's name; either alone is clean."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        kind = i % 12
        words = prose(rng, rng.choice((10, 30, 60))).split()
        words += {0: ["badslur"], 1: ["meanie", "groupies"], 2: ["meanie"], 3: ["groupies"]}.get(kind, [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(kind < 2)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_pairs_and_keeps_its_rows(spark, tmp_path):
    docs, labels = labelled(spark)
    folder = write_tables(spark, tmp_path, documents=docs, labels=labels)
    got = toxicity.op4_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert len(got) == 1800
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_held_out_labels_and_other_columns_are_not_read(spark, tmp_path):
    docs, labels = labelled(spark, 600)
    folder = write_tables(spark, tmp_path, documents=docs, labels=labels)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = write_tables(spark, tmp_path / "other", documents=docs.withColumns({"source": F.lit("elsewhere"), "lang": F.lit("xx"), "n_chars": F.lit(0).cast("long")}), labels=labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    scores = [{r.doc_id: (r.held_out, round(r.score, 9)) for r in toxicity.op4_toxicity(spark, f).collect()} for f in (folder, other)]
    assert scores[0] == scores[1] and len(scores[0]) == 600
    # Held-out texts are ranked by what was learned from the others.
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    one, none = ([s for i, (h, s) in scores[0].items() if h and toxic[i] == k] for k in (1, 0))
    assert sum(a > b for a in one for b in none) / (len(one) * len(none)) > 0.95


def test_what_is_broadcast_needs_no_class_of_the_library(spark):
    machine = toxicity.train(*labelled(spark, 120))
    assert b"loomgraph" not in pickle.dumps(tuple(machine))


def test_machine_scores_equal_the_formula():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=20), rng.normal(size=(20, toxicity.FACTORS))
    machine = toxicity.Machine(np.zeros(0), 0.3, w, v)
    sets = [[1, 4, 5], [], [0], [2, 3, 4, 5, 19]]
    row = np.repeat(np.arange(4), [len(s) for s in sets])
    got = machine.scores(row, np.array(sum(sets, [])), 4)
    for s, x in zip(sets, got, strict=True):
        raw = 0.3 + sum(w[i] for i in s) + sum(v[a] @ v[b] for k, a in enumerate(s) for b in s[k + 1 :])
        assert abs(x - 1 / (1 + np.exp(-raw))) < 1e-9


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, None), (None, 1, 1), (3, 0, 1)]])
def test_awkward_rows_and_labels(spark, labels):
    docs = frame(spark, documents(n=25), extra=True)
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = [r[0] for r in docs.select(toxicity.score(spark, F.col("text"), machine)).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores) and len(set(scores)) == 1


def test_empty_documents(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.clean_documents(none, labels).count() == 0


def test_texts_are_scored_as_arrow_has_them(spark):
    # Python's strings of a batch would take several times its room in a worker.
    machine = toxicity.Machine(np.arange(toxicity.BUCKETS, dtype=np.int32) % 5, -0.5, np.linspace(-1, 1, 5), np.full((5, 2), 0.1))
    rows = documents(4)
    out = frame(spark, rows).select("text", toxicity.score(spark, F.col("text"), machine).alias("s"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    texts = [r[1] for r in rows]
    want = dict(zip(texts, machine.of_texts(pa.array(texts)).tolist(), strict=True))
    got = out.collect()
    assert len(got) == len(rows) and all(r.s == want[r.text] for r in got)
