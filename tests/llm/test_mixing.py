import random

import duckdb
import pytest

from loomgraph.llm import mixing

from .fixtures import documents, frame, prose, write_tables


def oracle(folder, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return c.execute(sql).fetchall()


@pytest.mark.parametrize("extra", [False, True])
def test_query_equals_sql_and_reruns_agree(spark, tmp_path, extra):
    folder = write_tables(spark, tmp_path, documents=frame(spark, documents(), extra))
    rows = lambda: sorted(map(tuple, mixing.op9_mix_sources(spark, folder).collect()), key=str)
    got = rows()
    assert got == rows()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(key, got)) == sorted(map(key, oracle(folder, mixing.ORACLE, "documents")))


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 2000), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.mix_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    weight = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    size = {r.source: r.source_size for r in sizes.collect()}
    want, total, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        share = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not over:
            break
        want |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    want |= {s: share * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 30)), rng.choice(("a", "b", "b", "b", "c", None))) for i in range(1500)]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        by.setdefault((r.source, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 30
    docs = docs.selectExpr("*", "1 as _copy", "2 as _copies", "3 as row", "4 as h", "5 as size", "6 as full", "7 as cut", "8 as `odd.name`")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_one_source_and_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    got = mixing.mix_sources(frame(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y")])).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 3), (1, 3), (2, 0)]
    assert mixing.mixed_documents(frame(spark, [])).collect() == []
