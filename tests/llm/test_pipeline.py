import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, neardup, toxicity

from .fixtures import DOCS, documents, frame, write_tables
from .test_decontam import brute as leaked
from .test_mixing import oracle
from .test_neardup import brute as grouped
from .test_tokens import expected


def tables(spark, tmp_path, extra=False):
    rows = documents(31, 40)
    bench = spark.createDataFrame([(0, rows[2][1]), (1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra)
    return docs, bench, labels, write_tables(spark, tmp_path, documents=docs, benchmark=bench, labels=labels)


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.mark.parametrize("extra", [False, True])
def test_each_stage_equals_brute_force_on_what_it_is_given(spark, tmp_path, extra):
    docs, bench, labels, folder = tables(spark, tmp_path, extra)
    machine = toxicity.train(docs, labels)
    scores = docs.select("doc_id", "text", "source", toxicity.score(spark, F.col("text"), machine).alias("s")).collect()
    clean = [(r.doc_id, r.text, r.source) for r in scores if r.s < 0.7]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, folder)
    assert one.columns == docs.columns and Counter(plain(one)) == Counter(clean)
    two = stages["near_duplicates"](spark, one, folder).persist()
    kept = plain(two)
    groups = grouped(clean, 5)
    worded = [r for r in kept if (r[1] or "").split()]
    assert two.columns == docs.columns and not Counter(kept) - Counter(clean)
    assert {i for i, *_ in worded if i is not None} == {c for _, n, c, _ in groups if n and c is not None}
    assert Counter(r for r in kept if r not in worded) == Counter(r for r in clean if not (r[1] or "").split())
    three = stages["decontamination"](spark, two, folder).persist()
    bad = leaked(kept, [(r.item_id, r.text) for r in bench.collect()])
    assert three.columns == docs.columns and Counter(plain(three)) == Counter(r for r, b in zip(kept, bad, strict=True) if not b[5])
    four = stages["mixing"](spark, three, folder).persist()
    there = write_tables(spark, tmp_path / "mixed", documents=three)
    taken = mixing.mix_sources(three).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in taken) == sorted((str(r[0]), r[1], r[4]) for r in oracle(there, mixing.ORACLE, "documents"))
    assert four.columns == docs.columns and Counter(i for i, *_ in plain(four)) == Counter({i: n for i in {r.doc_id for r in taken} if (n := sum(r.copies for r in taken if r.doc_id == i))})
    got = stages["token_output"](spark, four, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expected(plain(four)))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = write_tables(spark, tmp_path, documents=none, benchmark=bench, labels=labels)
    assert corpus_pipeline.run(spark, folder).collect() == []
    # Without labels and items nothing is toxic or leaked.
    folder = write_tables(spark, tmp_path / "some", documents=frame(spark, [(1, "a b c", "x"), (None, None, None)]), benchmark=bench, labels=labels)
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r.doc_id for r in got} <= {1, None} and all(r.ids_crc32 == zlib.crc32(np.array([0], dtype="<u4").tobytes()) for r in got if r.doc_id is None)
