import hashlib
import pickle
import random
import re

import pytest

from loomgraph.llm import decontam

from .fixtures import documents, frame, prose, write_tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    for i, text, _ in rows:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            size = min(10, len(x))
            for win in {tuple(x[a : a + size]) for a in range(len(x) - size + 1)} if x else ():
                for a in range(len(w) - size + 1):
                    if tuple(w[a : a + size]) == win:
                        hit.update(range(a, a + size))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case(n=60):
    rows = documents(3, n)
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice((15, 30)))) for k in range(8)]
    items += [(50, "short item of six words here"), (51, "One"), (52, None), (53, "..."), (54, "short ITEM, of six-words here"), (11, rows[7][1]), (None, "no item id but nine words are all here"), (50, "short item of six words here")]
    rows += [
        (400, f"{prose(rng, 20)} {items[2][1]} {prose(rng, 5)}", "s1"), (401, " ".join(items[3][1].split()[2:13]).upper(), "s1"), (402, " ".join(items[3][1].split()[2:11]), "s1"),
        (403, "a Short item, OF six; words here!", "s2"), (404, "short item of six words", "s2"), (405, f"{items[4][1]} {items[5][1]}", "s2"), (406, "no item id but nine words are all here", "s1"),
    ]
    return rows, items


def run(spark, rows, items, extra=False):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(frame(spark, rows, extra), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_equals_brute_force(spark, extra):
    rows, items = case()
    assert run(spark, rows, items, extra) == sorted(brute(rows, items), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_a_benchmark_that_stays_a_table(spark, monkeypatch, extra):
    monkeypatch.setattr(decontam, "LOCAL_WINDOWS", 0)
    monkeypatch.setattr(decontam, "local_index", None)
    rows, items = case()
    assert run(spark, rows, items, extra) == sorted(brute(rows, items), key=str)
    assert run(spark, [], items) == []


def test_what_is_broadcast_needs_no_class_of_the_library(spark):
    _, items = case(15)
    windows = decontam.benchmark_windows(spark.createDataFrame(items, "item_id long, text string"))
    assert b"loomgraph" not in pickle.dumps(tuple(decontam.local_index(windows)))


def test_empty_tables(spark):
    rows, items = case(25)
    assert run(spark, [], items) == []
    assert run(spark, rows, []) == sorted(brute(rows, []), key=str)


def test_query_and_cleaning(spark, tmp_path):
    rows, items = case(25)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    folder = write_tables(spark, tmp_path, documents=docs, benchmark=bench)
    want = brute(rows, items)
    assert sorted(map(tuple, decontam.op3_decontaminate(spark, folder).collect()), key=str) == sorted(want, key=str)
    docs = docs.selectExpr("*", "1 as did", "'x' as tid", "2 as row", "3 as _did", "4 as _tid")
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in want)
